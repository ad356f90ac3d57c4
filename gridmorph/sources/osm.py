"""Map data by place or boundary, through a Python data source with retries over several endpoints.

Options: ``kind`` (buildings, roads or boundary), ``place`` or ``ring``, and
those of Settings. An endpoint is a URL; a ``file:`` endpoint answers with its
file, which serves tests and archived answers. Answers are JSON lists of
elements with type, id, tags and geometry.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scalars import osm_reference
from .files import kept_columns, nonempty

SCHEMA = "osm_type string, osm_id long, tags map<string,string>, polygons array<array<array<struct<x double, y double>>>>, rank int"
#: The columns that downloads keep.
BUILDING_TAGS = ("building", "name", "height", "building:height", "building:levels", "levels", "roof:height", "roof:levels", "amenity", "landuse", "addr:housenumber")
ROAD_TAGS = ("highway", "name", "lanes", "maxspeed", "oneway", "length", "bridge", "tunnel")


@dataclass(frozen=True)
class Settings:
    endpoints: str = ""
    attempts: int = 2
    wait_s: float = 8.0
    timeout_s: int = 300
    max_results: int = 8

    @staticmethod
    def of(options) -> Settings:
        given = {f.name: options.get(f.name) for f in fields(Settings) if options.get(f.name) is not None}
        kinds = {"attempts": int, "wait_s": float, "timeout_s": int, "max_results": int}
        return Settings(**{k: kinds.get(k, str)(v) for k, v in given.items()})


def retried(fetch: Callable[[str], object], endpoints: list[str], attempts: int, wait_s: float):
    """fetch(endpoint) of the first endpoint that answers, each tried ``attempts`` times; the last error if none does."""
    last: Exception | None = None
    for endpoint in endpoints:
        for attempt in range(attempts):
            try:
                return fetch(endpoint)
            except (OSError, ValueError) as e:
                last = e
                if attempt + 1 < attempts:
                    time.sleep(wait_s)
    raise OSError(f"no endpoint answered: {last}") from last


def _polygons(element: dict) -> list | None:
    """Rings of a way or relation: outer rings, each a polygon; inner rings join the first."""
    ring = lambda g: [{"x": float(p["lon"]), "y": float(p["lat"])} for p in g]
    if element.get("geometry"):
        return [[ring(element["geometry"])]]
    outer = [[ring(m["geometry"])] for m in element.get("members", []) if m.get("role") == "outer" and m.get("geometry")]
    inner = [ring(m["geometry"]) for m in element.get("members", []) if m.get("role") == "inner" and m.get("geometry")]
    if outer and inner:
        outer[0] += inner
    return outer or None


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        # imported where it runs: readers travel to the workers by value
        import json
        import urllib.parse
        import urllib.request

        settings = Settings.of(self.options)
        endpoints = [e for e in settings.endpoints.split(",") if e]
        if not endpoints:
            raise OSError("no endpoint is configured for map data")
        ask = {k: self.options[k] for k in ("kind", "place", "ring") if k in self.options}

        def fetch(endpoint):
            url = endpoint if endpoint.startswith("file:") else f"{endpoint}?{urllib.parse.urlencode(ask)}"
            with urllib.request.urlopen(url, timeout=settings.timeout_s) as answer:
                return json.loads(answer.read())

        found = retried(fetch, endpoints, settings.attempts, settings.wait_s)
        elements = found["elements"] if isinstance(found, dict) else found
        for rank, e in enumerate(elements):
            yield e.get("type"), int(e["id"]), {str(k): str(v) for k, v in (e.get("tags") or {}).items()}, _polygons(e), rank


class MapData(DataSource):
    """The data source ``map_data``."""

    @classmethod
    def name(cls):
        return "map_data"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def _read(spark: SparkSession, kind: str, options: dict) -> DataFrame:
    spark.dataSource.register(MapData)
    given = {k: str(v) for k, v in options.items() if v is not None}
    return spark.read.format("map_data").options(kind=kind, **given).load()


def buildings(spark: SparkSession, place: str | None = None, ring: str | None = None, site: int = 0, **settings) -> DataFrame:
    """Building polygons of a place or inside a ring, with the tags that downloads keep."""
    found = _read(spark, "buildings", {"place": place, "ring": ring} | settings).where("polygons is not null")
    kept = F.map_filter("tags", lambda k, _: k.isin(*BUILDING_TAGS))
    return found.select(F.lit(site).cast("long").alias("site"), F.col("rank").cast("long").alias("feature"), "osm_type", "osm_id", kept.alias("attrs"), "polygons", F.flatten("polygons").alias("rings"), F.lit("EPSG:4326").alias("crs"), F.lit(True).alias("geographic"))


def roads(spark: SparkSession, ring: str, **settings) -> DataFrame:
    """Road lines inside a ring: id, the tags that downloads keep, and their points."""
    found = _read(spark, "roads", {"ring": ring} | settings).where("polygons is not null")
    return found.select("osm_id", *[F.try_element_at("tags", F.lit(t)).alias(t) for t in ROAD_TAGS], F.col("polygons")[0][0].alias("points"))


def boundary(spark: SparkSession, place: str, site: int = 0, **settings) -> DataFrame:
    """The best boundary of a place."""
    found = _read(spark, "boundary", {"place": place} | settings).where("polygons is not null").orderBy("rank").limit(1)
    if found.isEmpty():
        raise OSError(f"no boundary for {place}")
    return found.select(F.lit(site).cast("long").alias("site"), F.col("rank").cast("long").alias("feature"), F.col("tags").alias("attrs"), "polygons", F.flatten("polygons").alias("rings"), F.lit("EPSG:4326").alias("crs"), F.lit(True).alias("geographic"))


def candidates(spark: SparkSession, place: str, site: int = 0, **settings) -> DataFrame:
    """All boundaries that a place's name may mean, as operators.boundary takes them; the first is the automatic one."""
    most = Settings.of({k: v for k, v in settings.items()}).max_results
    found = _read(spark, "boundary", {"place": place} | settings).where(F.col("polygons").isNotNull() & (F.col("rank") <= most))
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    return found.select(
        F.lit(site).cast("long").alias("site"), F.lit(place).alias("wanted"), "osm_type", "osm_id", osm_reference(F.col("osm_type"), F.col("osm_id")).alias("osm_ref"), tag("name").alias("name"), tag("display_name").alias("display_name"),
        F.coalesce(tag("addresstype"), tag("type"), tag("class")).alias("kind"), tag("importance").try_cast("double").alias("importance"), F.col("rank").alias("attempt"), "polygons",
    )


def resolved_boundary(spark: SparkSession, place: str, site: int = 0, overrides: DataFrame | None = None, **settings) -> DataFrame:
    """The chosen boundary of a place by metrics, limits, scores and rank."""
    from ..operators import boundary as rules

    return rules.chosen(rules.scored(rules.validated(rules.metrics(candidates(spark, place, site, **settings)), overrides)))


def outstanding(spark: SparkSession, catalog: DataFrame, data_root: str, boundaries_only: bool = False) -> DataFrame:
    """The catalog's sites that lack a boundary file or, unless only those are wanted, a file of buildings."""
    done = nonempty(spark, data_root, "boundary.geojson")
    if not boundaries_only:
        done = done.join(nonempty(spark, data_root, "buildings.geojson"), ["subset", "slug"])
    return catalog.join(done, ["subset", "slug"], "left_anti")


def geojson_text(features: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the features (rings in longitude and latitude, the columns as properties) as a GeoJSON text."""
    own = kept_columns(features, columns)
    properties = F.struct(*[F.col(f"`{c}`") for c in own.columns])
    points = F.transform("polygons", lambda p: F.transform(p, lambda r: F.transform(F.when(r[0] == F.element_at(r, -1), r).otherwise(F.concat(r, F.array(r[0]))), lambda q: F.array(q["x"], q["y"]))))
    feature = F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit("MultiPolygon").alias("type"), points.alias("coordinates")).alias("geometry"))
    return features.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("text"))  # the features of one site


def download(spark: SparkSession, catalog: DataFrame, data_root: str, boundaries_only: bool = False, overwrite: bool = False, **settings) -> DataFrame:
    """Fetches what the catalog's sites lack, site by site, and gives a manifest row for each: done or the error."""
    from .files import write_text_whole

    rows = []
    wanted = catalog if overwrite or not _exists(spark, data_root) else outstanding(spark, catalog, data_root, boundaries_only)
    for r in wanted.collect():  # a row for each site of the catalog
        at = f"{data_root.rstrip('/')}/{r['subset']}/{r['slug']}"
        try:
            edge = boundary(spark, r["query"], **settings)
            write_text_whole(spark, geojson_text(edge, []).first()["text"], f"{at}/boundary.geojson")
            if not boundaries_only:
                own = buildings(spark, r["query"], **settings)
                write_text_whole(spark, geojson_text(own.select("*", *[F.try_element_at("attrs", F.lit(t)).alias(t) for t in BUILDING_TAGS]), ["osm_type", "osm_id", *BUILDING_TAGS]).first()["text"], f"{at}/buildings.geojson")
            rows.append((r["subset"], r["slug"], "ok", None))
        except Exception as e:  # the manifest keeps the error, and the next site goes on
            rows.append((r["subset"], r["slug"], "error", f"{type(e).__name__}: {e}"[-2000:]))
    return spark.createDataFrame(rows, "subset string, slug string, status string, error string")


def _exists(spark: SparkSession, path: str) -> bool:
    from .files import path_exists

    return path_exists(spark, path)
