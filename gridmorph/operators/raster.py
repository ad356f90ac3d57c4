"""Polygons to cells: scanlines meet edges, crossings pair up, spans explode into cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def polygon_edges(polygons: DataFrame) -> DataFrame:
    """site, feature, value, x0, y0, x1, y1 for polygons(site, feature, value, rings: array<array<struct<x,y>>>)."""
    r = polygons.select("site", "feature", "value", F.posexplode("rings").alias("ring", "points"))
    n = F.size("points")
    following = F.concat(F.slice("points", F.lit(2), n - 1), F.slice("points", F.lit(1), F.lit(1)))
    sides = r.select("site", "feature", "value", F.explode(F.arrays_zip(F.col("points").alias("a"), following.alias("b"))).alias("s"))
    return sides.select("site", "feature", "value", F.col("s.a.x").alias("x0"), F.col("s.a.y").alias("y0"), F.col("s.b.x").alias("x1"), F.col("s.b.y").alias("y1"))


def rasterized(polygons: DataFrame, min_x: float, max_y: float, n_rows: int, n_cols: int, px: float) -> DataFrame:
    """site, feature, value, y, x: cells whose centre lies inside; row 0 is the top.

    Each edge generates the scanlines that it crosses (half-open in y), so no
    range join is needed; crossings of a scanline are paired in order of x.
    """
    e = polygon_edges(polygons).where("y0 <> y1")
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    # row r has its centre at max_y - (r + 0.5) px
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.lit(max_y) - high) / px - 0.5) + 1)
    last = F.least(F.lit(n_rows - 1).cast("long"), F.floor((F.lit(max_y) - low) / px - 0.5))
    lines = e.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("y"))
    yc = F.lit(max_y) - (F.col("y") + 0.5) * px
    at = F.col("x0") + (yc - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    crossing = lines.select("site", "feature", "value", "y", at.alias("cx"))
    w = Window.partitionBy("site", "feature", "y").orderBy("cx")
    spans = crossing.withColumn("i", F.row_number().over(w)).withColumn("end", F.lead("cx").over(w)).where("i % 2 = 1")
    a = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("cx") - min_x) / px - 0.5))
    b = F.least(F.lit(n_cols - 1).cast("long"), F.ceil((F.col("end") - min_x) / px - 0.5) - 1)
    return spans.where(a <= b).select("site", "feature", "value", "y", F.explode(F.sequence(a, b)).alias("x"))


def touched(polygons: DataFrame, min_x: float, max_y: float, n_rows: int, n_cols: int, px: float) -> DataFrame:
    """site, feature, value, y, x: cells that a polygon touches at all: those with their centre inside, and all that an edge crosses."""
    e = polygon_edges(polygons)
    top, bottom = (F.lit(max_y) - F.greatest("y0", "y1")) / px, (F.lit(max_y) - F.least("y0", "y1")) / px
    first, last = F.greatest(F.lit(0).cast("long"), F.floor(top)), F.least(F.lit(n_rows - 1).cast("long"), F.greatest(F.ceil(bottom) - 1, F.floor(top)))
    lines = e.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("y"))
    # the part of the edge within the row's band
    high, low = F.lit(max_y) - F.col("y") * px, F.lit(max_y) - (F.col("y") + 1) * px
    flat = F.col("y0") == F.col("y1")
    at = lambda yc: F.when(flat, F.col("x0")).otherwise(F.col("x0") + (F.greatest(F.least(yc, F.greatest("y0", "y1")), F.least("y0", "y1")) - F.col("y0")) * (F.col("x1") - F.col("x0")) / F.nullif(F.col("y1") - F.col("y0"), F.lit(0.0)))
    left, right = F.when(flat, F.least("x0", "x1")).otherwise(F.least(at(low), at(high))), F.when(flat, F.greatest("x0", "x1")).otherwise(F.greatest(at(low), at(high)))
    a, b = F.floor((left - min_x) / px), F.greatest(F.ceil((right - min_x) / px) - 1, F.floor((left - min_x) / px))
    a, b = F.greatest(F.lit(0).cast("long"), a), F.least(F.lit(n_cols - 1).cast("long"), b)
    crossed = lines.where(a <= b).select("site", "feature", "value", "y", F.explode(F.sequence(a, b)).alias("x"))
    return crossed.unionByName(rasterized(polygons, min_x, max_y, n_rows, n_cols, px)).distinct()


def grid_of(bounds: DataFrame, px: float) -> DataFrame:
    """bounds(site, min_x, min_y, max_x, max_y) with the north-up grid of square cells that covers them: n_rows, n_cols; bad bounds are an error."""
    if px <= 0:
        raise ValueError("the cell size must be positive")
    n_cols, n_rows = F.ceil((F.col("max_x") - F.col("min_x")) / px), F.ceil((F.col("max_y") - F.col("min_y")) / px)
    fine = F.coalesce((n_cols > 0) & (n_rows > 0), F.lit(False))
    checked = F.when(fine, n_cols).otherwise(F.raise_error(F.lit("invalid raster bounds")).cast("long"))
    return bounds.withColumns({"n_cols": checked, "n_rows": n_rows})


def bounds_of(polygons: DataFrame, buffer: float = 0.0) -> DataFrame:
    """site, min_x, min_y, max_x, max_y of all rings, widened by a buffer."""
    points = F.flatten("rings")
    one = polygons.where(F.size("rings") > 0).select("site", F.transform(points, lambda p: p["x"]).alias("xs"), F.transform(points, lambda p: p["y"]).alias("ys"))
    return one.groupBy("site").agg(
        (F.min(F.array_min("xs")) - buffer).alias("min_x"), (F.min(F.array_min("ys")) - buffer).alias("min_y"), (F.max(F.array_max("xs")) + buffer).alias("max_x"), (F.max(F.array_max("ys")) + buffer).alias("max_y")
    )


def valid_shapes(polygons: DataFrame) -> DataFrame:
    """Features with a ring of three points or more; rings that close on their first point are cut there, repeated points are dropped, other rings go."""
    def cleaned(ring):
        once = F.filter(ring, lambda p, i: (i == 0) | ~((p["x"] == F.try_element_at(ring, i)["x"]) & (p["y"] == F.try_element_at(ring, i)["y"])))
        closed = (F.size(once) > 1) & (once[0]["x"] == F.try_element_at(once, F.lit(-1))["x"]) & (once[0]["y"] == F.try_element_at(once, F.lit(-1))["y"])
        return F.when(closed, F.slice(once, F.lit(1), F.size(once) - 1)).otherwise(once)

    finite = lambda ring: F.forall(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    rings = F.filter(F.transform(F.filter("rings", finite), cleaned), lambda r: F.size(r) >= 3)
    return polygons.where(F.col("rings").isNotNull()).withColumn("rings", rings).where(F.size("rings") > 0)


def burned(cells: DataFrame, reduce: str = "max") -> DataFrame:
    """site, y, x, value: overlaps reduced by max, sum (add) or the last feature (replace); null, NaN and infinite values are skipped."""
    how = {"max": F.max("value"), "add": F.sum("value"), "replace": F.max_by("value", "feature")}[reduce]
    fine = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    return cells.where(fine).groupBy("site", "y", "x").agg(how.alias("value"))


def diagnostics(cells: DataFrame, domain: DataFrame, plan: DataFrame, px: float) -> DataFrame:
    """plan(site, n_rows, n_cols, footprint_area, plan_area) with counts of the cells inside the domain, areas, their relative errors and shares."""
    inside = cells.join(domain.select("site", "y", "x"), ["site", "y", "x"], "left_semi").groupBy("site").agg(F.count(F.lit(1)).alias("n_pixels_buildings"))
    whole = domain.groupBy("site").agg(F.count(F.lit(1)).alias("n_pixels_domain"))
    out = plan.join(whole, "site", "left").join(inside, "site", "left").withColumns({"n_pixels_domain": F.coalesce("n_pixels_domain", F.lit(0).cast("long")), "n_pixels_buildings": F.coalesce("n_pixels_buildings", F.lit(0).cast("long"))})
    area = lambda c: F.col(c) * float(px * px)
    error = lambda raster, vector: F.when(F.col(vector) > 0, F.abs(area(raster) - F.col(vector)) / F.nullif(F.col(vector), F.lit(0.0)))
    box = F.col("n_rows") * F.col("n_cols")
    return out.withColumns({
        "n_pixels_bbox": box, "building_area_raster_m2": area("n_pixels_buildings"), "boundary_area_raster_m2": area("n_pixels_domain"), "raster_area_error_rel": error("n_pixels_buildings", "footprint_area"),
        "boundary_raster_area_error_rel": error("n_pixels_domain", "plan_area"), "domain_fraction_of_bbox": F.when(box > 0, F.col("n_pixels_domain") / F.nullif(box, F.lit(0))),
        "foreground_fraction_within_domain": F.when(F.col("n_pixels_domain") > 0, F.col("n_pixels_buildings") / F.nullif(F.col("n_pixels_domain"), F.lit(0))),
    })


def layered_extrusion(heights: DataFrame, px: float = 1.0) -> DataFrame:
    """Volume, roof and wall area of a height field heights(site, y, x, value): a cell is as high as its tallest cover.

    Walls stand where neighbours differ in height; each row and column of cells
    is walked by a window, so no neighbour join is needed.
    """
    def walls(line: str, along: str):
        w = Window.partitionBy("site", line).orderBy(along)
        near = F.when(F.lead(along).over(w) == F.col(along) + 1, F.lead("value").over(w)).otherwise(0.0)
        starts = F.when(F.coalesce(F.lag(along).over(w), F.lit(-2)) == F.col(along) - 1, 0.0).otherwise(F.col("value"))
        return F.abs(F.col("value") - near) + starts

    h = heights.withColumn("wx", walls("y", "x")).withColumn("wy", walls("x", "y"))
    return h.groupBy("site").agg((F.sum("value") * px * px).alias("volume"), (F.count(F.lit(1)) * F.lit(px * px)).alias("roof_area"), (F.sum(F.col("wx") + F.col("wy")) * px).alias("wall_area"))
