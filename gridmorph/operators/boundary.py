"""Boundary candidates of a site: metrics, limits with overrides, scores and the choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import equal_area, haversine_km, ring_area
from ..functions.scalars import folded, looked_up

#: Limits of a plausible boundary and the scores of its kind and type.
MAX_AREA_KM2, MAX_DIAGONAL_KM = 10_000.0, 300.0
KIND_SCORES = {"city": 100, "municipality": 90, "town": 80, "borough": 65, "city district": 60, "administrative": 45, "county": 30, "state": 25, "province": 20, "region": 10, "country": -100}
TYPE_SCORES = {"relation": 20, "way": 10, "node": -100}
COARSE_KINDS = ("country", "region", "province", "state", "county")


def metrics(boundaries: DataFrame) -> DataFrame:
    """boundaries(..., polygons: rings of (lon, lat), outer ring first) with their bounds, diagonal and area in km2.

    Rows without a polygon are dropped.
    """
    points = F.flatten(F.flatten("polygons"))

    def area(polygon):
        sizes = F.transform(polygon, lambda ring: F.abs(ring_area(F.transform(ring, lambda p: equal_area(p["x"], p["y"])))))
        return 2 * sizes[0] - F.aggregate(sizes, F.lit(0.0), lambda s, x: s + x)  # the outer ring less the holes

    out = boundaries.where(F.size("polygons") > 0).withColumns(_bounds(points))
    km2 = F.aggregate(F.transform("polygons", area), F.lit(0.0), lambda s, x: s + x) / 1e6
    return out.withColumn("diagonal_km", haversine_km(F.col("min_lon"), F.col("min_lat"), F.col("max_lon"), F.col("max_lat"))).withColumn("area_km2", km2)


def _bounds(points: Column) -> dict[str, Column]:
    lon, lat = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return {"min_lon": F.array_min(lon), "max_lon": F.array_max(lon), "min_lat": F.array_min(lat), "max_lat": F.array_max(lat)}


def validated(candidates: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """candidates(site, area_km2, diagonal_km, ...) with the limits they break, by name, and whether they are accepted.

    overrides(site, max_area_km2, max_diagonal_km) replaces the limits of some sites; null keeps the default.
    """
    own = candidates if overrides is None else candidates.join(overrides, "site", "left")
    area = F.coalesce("max_area_km2", F.lit(MAX_AREA_KM2)) if overrides is not None else F.lit(MAX_AREA_KM2)
    diagonal = F.coalesce("max_diagonal_km", F.lit(MAX_DIAGONAL_KM)) if overrides is not None else F.lit(MAX_DIAGONAL_KM)
    broken = F.concat_ws("; ", F.when(F.col("area_km2") > area, "area"), F.when(F.col("diagonal_km") > diagonal, "diagonal"))
    return own.withColumn("problems", broken).withColumn("accepted", broken == "").drop("max_area_km2", "max_diagonal_km")


def scored(candidates: DataFrame) -> DataFrame:
    """candidates(wanted, name, display_name, kind, osm_type, area_km2, importance, ...) with their score."""
    c = candidates.withColumns({"wanted_": folded(F.split("wanted", ",")[0]), "name_": folded(F.col("name")), "display_": folded(F.col("display_name"))})
    wanted = F.col("wanted_")
    by_name = F.when(wanted == "", 0).when(F.col("name_") == wanted, 80).when(F.contains("name_", wanted), 55).when(F.contains("display_", wanted), 35).otherwise(0)
    by_kind = looked_up(KIND_SCORES, folded(F.col("kind")), 0)
    by_type = looked_up(TYPE_SCORES, folded(F.col("osm_type")), 0)
    by_area = F.when(F.col("area_km2").between(1, 3000), 20).when(F.col("area_km2") <= MAX_AREA_KM2, 5).otherwise(0)
    score = (by_name + by_kind + by_type + by_area).cast("double") + 10 * F.coalesce(F.col("importance").cast("double"), F.lit(0.0))
    return c.withColumn("score", score).drop("wanted_", "name_", "display_")


def needs_search(candidates: DataFrame) -> DataFrame:
    """site, search: whether the automatic candidate (the first attempt) is missing, refused or too coarse a kind."""
    first = candidates.groupBy("site").agg(F.min_by(F.struct("accepted", "kind"), "attempt").alias("auto"))
    return first.select("site", (~F.col("auto.accepted") | folded(F.col("auto.kind")).isin(*COARSE_KINDS)).alias("search"))


def chosen(candidates: DataFrame) -> DataFrame:
    """The accepted candidate of each site with the best score; of the same object and of equal scores the earliest attempt."""
    object_ = Window.partitionBy("site", "osm_type", "osm_id").orderBy("attempt")
    once = candidates.where("accepted").withColumn("again", F.row_number().over(object_)).where("again = 1").drop("again")
    best = Window.partitionBy("site").orderBy(F.desc("score"), "attempt")
    return once.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")
