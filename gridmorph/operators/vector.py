"""Exact measures of overlapping polygons: unions, layered extrusions, clipping by a boundary.

The plane is swept in slabs between neighbouring heights of vertices and
crossings, in which edges do not cross: a slab falls into trapezoids, and what
covers a trapezoid is known by parity. Features are dealt to square tiles, so a
task holds the polygons of a tile; measures of tiles add up.

Tables: polygons(site, feature, height, known, rings: array<array<struct<x, y>>>),
rings by parity, so holes and parts need no marks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import ring_area, ring_perimeter

#: Tiles begin here, so that their borders hardly ever run along an edge.
ORIGIN = 0.3183098861837907
RINGS = "array<array<struct<x double, y double>>>"


def _edges(shapes: list) -> tuple[np.ndarray, np.ndarray]:
    """Edges (x0, y0, x1, y1) with y0 < y1 of all rings, and the number of their shape; level edges are left out."""
    out, owner = [], []
    for k, rings in enumerate(shapes):
        for ring in rings:
            p = np.array([(q["x"], q["y"]) for q in ring], float).reshape(-1, 2)
            if len(p) >= 3:
                e = np.hstack([p, np.roll(p, -1, axis=0)])
                e = e[e[:, 1] != e[:, 3]]
                down = e[:, 1] > e[:, 3]
                e[down] = e[down][:, [2, 3, 0, 1]]
                out.append(e)
                owner.append(np.full(len(e), k))
    if not out:
        return np.zeros((0, 4)), np.zeros(0, np.int64)
    return np.vstack(out), np.concatenate(owner)


def _crossings(e: np.ndarray) -> np.ndarray:
    """Heights at which two edges cross."""
    found = []
    for i in range(len(e) - 1):
        a, b = e[i], e[i + 1 :]
        near = (b[:, 1] < a[3]) & (b[:, 3] > a[1]) & (np.minimum(b[:, 0], b[:, 2]) <= max(a[0], a[2])) & (np.maximum(b[:, 0], b[:, 2]) >= min(a[0], a[2]))
        b = b[near]
        if len(b):
            sa, sb = (a[2] - a[0]) / (a[3] - a[1]), (b[:, 2] - b[:, 0]) / (b[:, 3] - b[:, 1])
            with np.errstate(divide="ignore", invalid="ignore"):
                y = (b[:, 0] - a[0] + sa * a[1] - sb * b[:, 1]) / (sa - sb)
            found.append(y[np.isfinite(y) & (y > np.maximum(a[1], b[:, 1])) & (y < np.minimum(a[3], b[:, 3]))])
    return np.concatenate(found) if found else np.zeros(0)


def _slabs(e: np.ndarray, owner: np.ndarray, box):
    """For each slab inside the box: its heights, and the trapezoids' left and right ends below and above, whether a left end lies within the box, what covers them (shapes x trapezoids), and those shapes."""
    x_low, y_low, x_high, y_high = box
    levels = [e[:, 1], e[:, 3], _crossings(e)]
    for side in (x_low, x_high):  # where edges leave the box sideways
        across = (e[:, 0] - side) * (e[:, 2] - side) < 0
        c = e[across]
        levels.append(c[:, 1] + (side - c[:, 0]) * (c[:, 3] - c[:, 1]) / (c[:, 2] - c[:, 0]))
    y = np.unique(np.concatenate(levels)) if len(e) else np.zeros(0)
    y = np.unique(np.concatenate([y[(y > y_low) & (y < y_high)], [v for v in (y_low, y_high) if np.isfinite(v)]]))
    slope = (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
    for low, high in zip(y[:-1].tolist(), y[1:].tolist(), strict=True):
        middle = (low + high) / 2
        on = np.flatnonzero((e[:, 1] < middle) & (e[:, 3] > middle))
        if not len(on):
            yield low, high, np.zeros(0), np.zeros(0), np.zeros(0, bool), np.zeros((0, 0), bool), np.zeros(0, np.int64)
            continue
        at = e[on, 0] + (middle - e[on, 1]) * slope[on]
        order = np.argsort(at, kind="stable")
        on, at = on[order], at[order]
        here, row = np.unique(owner[on], return_inverse=True)
        toggles = np.zeros((len(here), len(on)), np.int64)
        toggles[row, np.arange(len(on))] = 1
        inside = np.cumsum(toggles, axis=1) % 2 == 1
        # edges that run together are one line: what covers the strip behind it is known after the last
        last = np.append(np.abs(np.diff(at)) > 1e-9 * (1 + np.abs(at[1:])), True)
        below = np.clip(e[on, 0] + (low - e[on, 1]) * slope[on], x_low, x_high)[last]
        above = np.clip(e[on, 0] + (high - e[on, 1]) * slope[on], x_low, x_high)[last]
        yield low, high, below, above, ((at > x_low) & (at < x_high))[last], inside[:, last], here


def _steps(xa, va, xb, vb) -> float:
    """The integral of |a - b| over a line, of two step functions given by ascending breaks and the values behind each."""
    x = np.unique(np.concatenate([xa, xb]))
    if len(x) < 2:
        return 0.0
    middle = (x[1:] + x[:-1]) / 2

    def value(breaks, values):
        k = np.searchsorted(breaks, middle, "right") - 1
        return np.where(k >= 0, np.append(values, 0.0)[k], 0.0) if len(breaks) else np.zeros(len(middle))

    return float((np.abs(value(xa, va) - value(xb, vb)) * np.diff(x)).sum())


def tile_measures(shapes: list, heights: np.ndarray, known: np.ndarray, box) -> tuple[float, float, float, float, float]:
    """Union area and perimeter, volume and exposed walls under the tallest cover, and the union area of shapes of known height."""
    e, owner = _edges(shapes)
    area = length = volume = walls = known_area = 0.0
    seen = (np.zeros(0), np.zeros(0))
    for low, high, below, above, within, inside, here in _slabs(e, owner, box):
        tall = (inside * heights[here, None]).max(axis=0) if inside.size else np.zeros(0)
        if len(below):
            width = ((np.diff(below) + np.diff(above)) / 2) * (high - low)
            area += float(width[tall[:-1] > 0].sum())
            volume += float((width * tall[:-1]).sum())
            known_area += float(width[(inside & known[here, None])[:, :-1].any(axis=0)].sum())
            side = np.hypot(high - low, above - below) * within  # not along the box's own sides
            left = np.concatenate([[0.0], tall[:-1]])
            walls += float((side * np.abs(tall - left)).sum())
            length += float((side * ((tall > 0) != (left > 0))).sum())
        # level edges: what changes between the slab below and this one
        if np.isfinite(low) and low > box[1]:
            walls += _steps(*seen, below, tall)
            length += _steps(seen[0], (seen[1] > 0).astype(float), below, (tall > 0).astype(float))
        seen = (above, tall)
    if not np.isfinite(box[3]) or not len(e):
        walls += _steps(*seen, np.zeros(0), np.zeros(0))
        length += _steps(seen[0], (seen[1] > 0).astype(float), np.zeros(0), np.zeros(0))
    return area, length, volume, walls, known_area


def clip_shape(shape: list, boundary: list) -> tuple[list, float]:
    """The trapezoids of a shape inside a boundary, as rings, and their area."""
    e, owner = _edges([shape, boundary])
    rings, area = [], 0.0
    for low, high, below, above, _, inside, here in _slabs(e, owner, (-np.inf, -np.inf, np.inf, np.inf)):
        for k in np.flatnonzero(inside.all(axis=0)[:-1]).tolist() if len(here) == 2 else ():
            a, b, c, d = below[k], below[k + 1], above[k + 1], above[k]
            rings.append([{"x": float(x), "y": float(y)} for x, y in ((a, low), (b, low), (c, high), (d, high))])
            area += ((b - a) + (c - d)) / 2 * (high - low)
    return rings, float(area)


def _extent(c: str) -> tuple[Column, Column, Column, Column]:
    points = F.flatten(c)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def union_measures(polygons: DataFrame, tile: float = 500.0) -> DataFrame:
    """site, area, perimeter, volume, wall_area, known_area of the union of each site's polygons, extruded to their heights.

    Shared walls and overlaps count once; a step between two heights is a wall.
    """
    x0, y0, x1, y1 = _extent("rings")
    number = lambda v: F.floor((v - ORIGIN) / tile)
    dealt = polygons.where(F.size(F.flatten("rings")) > 0).select("site", "height", "known", "rings", F.explode(F.sequence(number(x0), number(x1))).alias("tx"), number(y0).alias("ty0"), number(y1).alias("ty1"))
    dealt = dealt.select("site", "height", "known", "rings", "tx", F.explode(F.sequence("ty0", "ty1")).alias("ty"))

    def measure(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1).to_pylist()[0]
        tx, ty = first["tx"], first["ty"]
        box = (ORIGIN + tx * tile, ORIGIN + ty * tile, ORIGIN + (tx + 1) * tile, ORIGIN + (ty + 1) * tile)
        found = tile_measures(table.column("rings").to_pylist(), np.array(table.column("height").to_pylist(), float), np.array(table.column("known").to_pylist(), bool), box)
        return pa.table({k: [v] for k, v in zip(("site", "area", "perimeter", "volume", "wall_area", "known_area"), (first["site"], *found), strict=True)})

    parts = dealt.groupBy("site", "tx", "ty").applyInArrow(measure, "site long, area double, perimeter double, volume double, wall_area double, known_area double")
    return parts.groupBy("site").agg(*[F.sum(c).alias(c) for c in ("area", "perimeter", "volume", "wall_area", "known_area")])


def clipped(polygons: DataFrame, boundaries: DataFrame, shares: int = 16, tolerance: float = 1e-9) -> DataFrame:
    """The polygons inside their site's boundary: those within it as they are, those that cross it as trapezoids, with ``part`` within or crossing.

    boundaries(site, rings) has a row for each site; a site's polygons are dealt
    into ``shares`` groups, each of which gets the boundary.
    """
    own = polygons.select("site", "feature", "rings").withColumn("share", F.pmod(F.xxhash64("feature"), F.lit(shares)))
    all_ = boundaries.select("site", F.col("rings").alias("boundary"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("share"))

    ring_type = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))

    def cut(features: pa.Table, boundary: pa.Table) -> pa.Table:
        rows = []
        if boundary.num_rows:
            limits = boundary.column("boundary").to_pylist()[0]
            p = np.array([(q["x"], q["y"]) for ring in limits for q in ring])
            low, high = p.min(axis=0), p.max(axis=0)
            for site, feature, rings in zip(*[features.column(c).to_pylist() for c in ("site", "feature", "rings")], strict=True):
                q = np.array([(v["x"], v["y"]) for ring in rings for v in ring])
                if not len(q) or (q.max(axis=0) < low).any() or (q.min(axis=0) > high).any():
                    continue
                inside, area = clip_shape(list(rings), list(limits))
                whole = clip_shape(list(rings), list(rings))[1]
                if area > tolerance * max(whole, 1.0):
                    within = area >= whole * (1 - tolerance)
                    rows.append((site, feature, "within" if within else "crossing", rings if within else inside))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.table({k: pa.array(list(c), t) for k, c, t in zip(("site", "feature", "part", "rings"), columns, (pa.int64(), pa.int64(), pa.string(), ring_type), strict=True)})

    found = own.groupBy("site", "share").cogroup(all_.groupBy("site", "share")).applyInArrow(cut, f"site long, feature long, part string, rings {RINGS}")
    rest = [c for c in polygons.columns if c != "rings"]
    return polygons.select(*rest).join(found, ["site", "feature"]).select(*rest, "part", "rings")


def shape_measures(polygons: DataFrame) -> DataFrame:
    """Each polygon with its own area and perimeter, from its rings; the first ring is the outer one, others are holes or, if disjoint, trapezoids of a clip."""
    area = F.when(F.col("part") == "crossing", F.aggregate(F.transform("rings", lambda r: F.abs(ring_area(r))), F.lit(0.0), lambda s, x: s + x)).otherwise(
        2 * F.abs(ring_area(F.col("rings")[0])) - F.aggregate(F.transform("rings", lambda r: F.abs(ring_area(r))), F.lit(0.0), lambda s, x: s + x)
    )
    return polygons.withColumn("area", area).withColumn("perimeter", F.aggregate(F.transform("rings", ring_perimeter), F.lit(0.0), lambda s, x: s + x))


def surface_summary(polygons: DataFrame, roof_factor: float = 1.0, tile: float = 500.0) -> DataFrame:
    """One row for each site: counts, raw and union areas and perimeters, overlap, volume, walls, envelope and closed surface, heights.

    polygons also holds ``source``, where its height comes from; ``default`` is not known.
    """
    layered = polygons.withColumn("height", F.round("height", 3)).where("height > 0")
    union = union_measures(layered.withColumn("known", F.col("source") != "default"), tile)
    each = shape_measures(polygons if "part" in polygons.columns else polygons.withColumn("part", F.lit("within")))
    raw = each.groupBy("site").agg(
        F.count(F.lit(1)).alias("n_buildings"), F.sum("area").alias("footprint_area_raw_sum_m2"), F.sum("perimeter").alias("footprint_perimeter_raw_sum_m"), F.sum(F.col("perimeter") * F.col("height")).alias("wall_area_gross_m2"),
        F.avg("height").alias("mean_height_m"), F.median("height").alias("median_height_m"), F.avg((F.col("source") != "default").cast("double")).alias("height_source_known_fraction"), F.count_distinct(F.round("height", 3)).alias("height_layer_count"),
    )
    out = raw.join(union, "site").withColumnsRenamed({"area": "footprint_area_m2", "perimeter": "footprint_perimeter_m", "volume": "volume_m3", "wall_area": "wall_area_m2"})
    ground = F.col("footprint_area_m2")
    raw_area = F.nullif(F.col("footprint_area_raw_sum_m2"), F.lit(0.0))
    out = out.withColumns({
        "footprint_overlap_fraction": F.greatest((raw_area - ground) / raw_area, F.lit(0.0)), "height_source_known_area_fraction": F.least(F.col("known_area") / F.nullif(ground, F.lit(0.0)), F.lit(1.0)),
        "geometric_roof_area_m2": ground, "thermal_roof_area_m2": ground * float(roof_factor), "roof_area_m2": ground * float(roof_factor), "ground_contact_area_m2": ground,
        "envelope_area_m2": ground * float(roof_factor) + F.col("wall_area_m2"), "closed_surface_area_m2": 2 * ground + F.col("wall_area_m2"),
    })
    return out.drop("known_area")


def replaced_defaults(polygons: DataFrame, height: Column | float) -> DataFrame:
    """The polygons with another height where theirs is the default."""
    return polygons.withColumn("height", F.when(F.col("source") == "default", F.lit(height) if isinstance(height, (int, float)) else height).otherwise(F.col("height")))


def height_scenarios(polygons: DataFrame, scenarios: tuple[float, ...], default: float = 12.0, roof_factor: float = 1.0, tile: float = 500.0) -> DataFrame:
    """surface_summary() of each site for each positive default height, the primary one marked."""
    out = None
    for h in sorted({float(x) for x in (*scenarios, default) if float(x) > 0}):  # a handful
        rows = surface_summary(replaced_defaults(polygons, h), roof_factor, tile).withColumns({"default_height_m": F.lit(h), "is_primary": F.lit(abs(h - default) <= 1e-8 + 1e-5 * abs(default))})
        out = rows if out is None else out.unionByName(rows)
    return out
