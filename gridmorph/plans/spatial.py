"""Queries of the vector, raster, topology, transport, sweep and statistics operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import site as analysis
from ..functions import geometry as g
from ..operators import fractal, raster, stats, sweep, topology, transport, vector
from .fixtures import FEATURES, HEIGHTS, QS, SIDE, SITES, SIZES, SQUARE, customer_features, heights, sites, square, table
from .morphology import _FIT, _LACUNARITY, _RANKS, _counts, _r, _spectrum, query

# --- boxes as polygons ------------------------------------------------------------------

_BOXES = "b AS (SELECT s_suppkey AS f, (s_suppkey % 50)::DOUBLE AS x0, ((s_suppkey * 7) % 50)::DOUBLE AS y0, (1 + s_suppkey % 9)::DOUBLE AS w, (1 + s_suppkey % 5)::DOUBLE AS d, 3.0::DOUBLE * (1 + s_suppkey % 6) AS height, s_suppkey % 4 <> 0 AS known FROM supplier)"
_UNITS = f"{_BOXES}, u AS (SELECT y::BIGINT AS y, x::BIGINT AS x, max(height) AS h, bool_or(known) AS k FROM b, range(64) r(y), range(64) c(x) WHERE x >= x0 AND x < x0 + w AND y >= y0 AND y < y0 + d GROUP BY 1, 2)"
_SIDES = "near AS (SELECT u.*, e.h AS e, w.h AS w, n.h AS n, s.h AS s FROM u LEFT JOIN u e ON e.y = u.y AND e.x = u.x + 1 LEFT JOIN u w ON w.y = u.y AND w.x = u.x - 1 LEFT JOIN u n ON n.y = u.y + 1 AND n.x = u.x LEFT JOIN u s ON s.y = u.y - 1 AND s.x = u.x)"
#: A wall between two cells is counted once, from the cell behind it; one towards nothing from its own cell.
_WALLS = "sum(abs(h - coalesce(e, 0)) + CASE WHEN w IS NULL THEN h ELSE 0 END + abs(h - coalesce(n, 0)) + CASE WHEN s IS NULL THEN h ELSE 0 END)"
_EDGES = "sum((e IS NULL)::INT + (w IS NULL)::INT + (n IS NULL)::INT + (s IS NULL)::INT)::DOUBLE"


def boxes(spark, sf_dir, scale: float = 1.0):
    """site, feature, height, source, known, value, rings: a rectangle for each supplier."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    x0, y0 = (k % 50).cast("double") * scale, ((k * 7) % 50).cast("double") * scale
    x1, y1 = x0 + (1 + k % 9) * scale, y0 + (1 + k % 5) * scale
    ring = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])
    source = F.when(k % 4 == 0, "default").otherwise("height")
    height = 3.0 * (1 + k % 6)
    return s.select(F.lit(0).cast("long").alias("site"), k.cast("long").alias("feature"), height.alias("height"), source.alias("source"), (k % 4 != 0).alias("known"), F.round("s_acctbal", 2).alias("value"), F.array(ring).alias("rings"))


def rectangle(spark, x0: float, y0: float, x1: float, y1: float):
    ring = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])
    return spark.range(1).select(F.lit(0).cast("long").alias("site"), F.array(ring).alias("rings"))


@query(f"WITH {_UNITS}, {_SIDES} SELECT 0::BIGINT AS site, count(*)::DOUBLE AS area, {_EDGES} AS perimeter, sum(h) AS volume, {_WALLS} AS wall_area, (count(*) FILTER (k))::DOUBLE AS known_area FROM near")
def polygon_union(spark, sf_dir):
    return vector.union_measures(boxes(spark, sf_dir), tile=20.0)


@query(f"""WITH {_BOXES}, c AS (SELECT f, w * d AS whole, greatest(0, least(x0 + w, 40) - greatest(x0, 10)) * greatest(0, least(y0 + d, 45) - greatest(y0, 5)) AS area FROM b)
 SELECT f::BIGINT AS feature, CASE WHEN area = whole THEN 'within' ELSE 'crossing' END AS part, round(area, 6) AS area FROM c WHERE area > 0""")
def polygon_clip(spark, sf_dir):
    inside = vector.clipped(boxes(spark, sf_dir), rectangle(spark, 10, 5, 40, 45), shares=4)
    return vector.shape_measures(inside).select("feature", "part", "area")


@query(f"""WITH {_UNITS}, {_SIDES}, m AS (SELECT count(*)::DOUBLE AS ground, {_EDGES} AS edge, sum(h) AS volume, {_WALLS} AS walls, (count(*) FILTER (k))::DOUBLE AS known FROM near),
 raw AS (SELECT count(*) AS n, sum(w * d) AS area, sum(2 * (w + d)) AS edge, sum(2 * (w + d) * height) AS gross, avg(height) AS mean_h, median(height) AS median_h, avg(known::INT) AS share, count(DISTINCT height) AS layers FROM b)
 SELECT 0::BIGINT AS site, n AS n_buildings, ground AS footprint_area_m2, area AS footprint_area_raw_sum_m2, round(greatest((area - ground) / area, 0), 6) AS footprint_overlap_fraction, m.edge AS footprint_perimeter_m, raw.edge AS footprint_perimeter_raw_sum_m, volume AS volume_m3,
 ground * 1.1 AS thermal_roof_area_m2, walls AS wall_area_m2, gross AS wall_area_gross_m2, round(ground * 1.1 + walls, 6) AS envelope_area_m2, 2 * ground + walls AS closed_surface_area_m2, round(mean_h, 6) AS mean_height_m, median_h AS median_height_m, round(share, 6) AS height_source_known_fraction,
 round(known / ground, 6) AS height_source_known_area_fraction, layers AS height_layer_count FROM m, raw""".replace("ground * 1.1 AS", "round(ground * 1.1, 6) AS"))
def surface_summary(spark, sf_dir):
    names = ["site", "n_buildings", "footprint_area_m2", "footprint_area_raw_sum_m2", "footprint_overlap_fraction", "footprint_perimeter_m", "footprint_perimeter_raw_sum_m", "volume_m3", "thermal_roof_area_m2", "wall_area_m2", "wall_area_gross_m2", "envelope_area_m2", "closed_surface_area_m2", "mean_height_m", "median_height_m", "height_source_known_fraction", "height_source_known_area_fraction", "height_layer_count"]
    return vector.surface_summary(boxes(spark, sf_dir), 1.1, tile=20.0).select(*names)


_SCENARIO = f"""s AS (SELECT v::DOUBLE AS v FROM (VALUES (9), (12), (15)) s(v)), sb AS (SELECT s.v, b.*, CASE WHEN known THEN height ELSE s.v END AS hh FROM b, s), su AS (SELECT v, y, x, max(hh) AS h FROM sb, range(64) r(y), range(64) c(x) WHERE x >= x0 AND x < x0 + w AND y >= y0 AND y < y0 + d GROUP BY 1, 2, 3)"""


@query(f"WITH {_BOXES}, {_SCENARIO} SELECT v AS default_height_m, sum(h) AS volume_m3, v = 12 AS is_primary FROM su GROUP BY 1")
def surface_scenarios(spark, sf_dir):
    return vector.height_scenarios(boxes(spark, sf_dir), (15.0, 9.0, -1.0), 12.0, tile=20.0).select("default_height_m", "volume_m3", "is_primary")


# --- raster -----------------------------------------------------------------------------


@query(f"WITH {_BOXES} SELECT n.n_nationkey::BIGINT AS site, min(x0 - 2) AS min_x, max(y0 + d + 2) AS max_y, ceil((max(x0 + w) - min(x0) + 4) / 2.5)::BIGINT AS n_cols, ceil((max(y0 + d) - min(y0) + 4) / 2.5)::BIGINT AS n_rows FROM b JOIN supplier ON s_suppkey = f JOIN nation n ON n_nationkey = s_nationkey GROUP BY 1")
def grid_definition(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("feature"), F.col("s_nationkey").cast("long").alias("nation"))
    own = raster.valid_shapes(boxes(spark, sf_dir)).join(s, "feature").withColumn("site", F.col("nation"))
    return raster.grid_of(raster.bounds_of(own, 2.0), 2.5).select("site", "min_x", "max_y", "n_cols", "n_rows")


@query(f"""WITH {_BOXES}, t AS (SELECT DISTINCT y::BIGINT AS y, x::BIGINT AS x, f FROM b, range(26) r(y), range(26) c(x) WHERE 2.5 * x < x0 + w AND 2.5 * (x + 1) > x0 AND 64 - 2.5 * (y + 1) < y0 + d AND 64 - 2.5 * y > y0)
 SELECT y, x, count(*) AS n FROM t GROUP BY 1, 2""")
def rasterize_touched(spark, sf_dir):
    # an edge that runs along a cell's border touches both sides; cells are counted where the polygon's inside reaches
    inner = boxes(spark, sf_dir).withColumn("rings", F.transform("rings", lambda r: F.transform(r, lambda p: F.struct((p["x"] + F.when(p["x"] == r[0]["x"], 1e-9).otherwise(-1e-9)).alias("x"), (p["y"] + F.when(p["y"] == r[0]["y"], 1e-9).otherwise(-1e-9)).alias("y")))))
    return raster.touched(inner, 0.0, 64.0, 26, 26, 2.5).groupBy("y", "x").agg(F.count(F.lit(1)).alias("n"))


_BURN = f"{_BOXES}, c AS (SELECT 63 - y::BIGINT AS y, x::BIGINT AS x, f, round(s_acctbal, 2) AS v FROM b JOIN supplier ON s_suppkey = f, range(64) r(y), range(64) c(x) WHERE x >= x0 AND x < x0 + w AND y >= y0 AND y < y0 + d)"


@query(f"WITH {_BURN} SELECT y, x, round(sum(v), 2) + 0.0 AS added, arg_max(v, f) AS replaced, max(v) AS most FROM c GROUP BY 1, 2")
def rasterize_weighted(spark, sf_dir):
    # values that are no numbers are skipped
    odd = boxes(spark, sf_dir).withColumns({"value": F.when(F.col("feature") % 2 == 0, float("inf")), "feature": F.col("feature") + 1_000_000})
    c = raster.rasterized(boxes(spark, sf_dir).unionByName(odd), 0.0, 64.0, 64, 64, 1.0)
    out = {name: raster.burned(c, how).select("y", "x", F.col("value").alias(name)) for name, how in (("added", "add"), ("replaced", "replace"), ("most", "max"))}
    return out["added"].withColumn("added", F.round("added", 2)).join(out["replaced"], ["y", "x"]).join(out["most"], ["y", "x"])


@query(f"WITH {HEIGHTS}, {SQUARE}, d AS (SELECT * FROM square WHERE x < 200), i AS (SELECT count(*) AS n FROM heights JOIN d USING (y, x)) SELECT 0::BIGINT AS site, 65536::BIGINT AS n_pixels_bbox, 51200::BIGINT AS n_pixels_domain, n AS n_pixels_buildings, n * 4.0::DOUBLE AS building_area_raster_m2, round(abs(n * 4.0::DOUBLE - 15000) / 15000, 6) AS raster_area_error_rel, round(4800 / 200000.0::DOUBLE, 6) AS boundary_raster_area_error_rel, round(51200 / 65536.0::DOUBLE, 6) AS domain_fraction_of_bbox, round(n / 51200, 6) AS foreground_fraction_within_domain FROM i")
def raster_diagnostics(spark, sf_dir):
    plan = spark.createDataFrame([(0, 256, 256, 15000.0, 200000.0)], "site long, n_rows long, n_cols long, footprint_area double, plan_area double")
    out = raster.diagnostics(heights(spark, sf_dir), square(spark).where("x < 200"), plan, 2.0)
    return out.select("site", "n_pixels_bbox", "n_pixels_domain", "n_pixels_buildings", "building_area_raster_m2", "raster_area_error_rel", "boundary_raster_area_error_rel", "domain_fraction_of_bbox", "foreground_fraction_within_domain")


# --- fractal ----------------------------------------------------------------------------


@query("""WITH s AS (SELECT n_nationkey::BIGINT AS site, (16 + 20 * n_nationkey)::BIGINT AS side FROM nation) SELECT site, list_filter([(2::BIGINT << i) for i in range(40)], lambda n : n <= greatest(2, floor(side * 0.25)) OR (n <= side AND n <= 64) OR n <= least(side, 128))::VARCHAR AS sizes FROM s""")
def box_sizes(spark, sf_dir):
    side = F.col("n_nationkey").cast("long") * 20 + 16
    sizes = fractal.box_sizes(side, F.lit(25.0))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("site"), F.concat(F.lit("["), F.array_join(sizes.cast("array<string>"), ", "), F.lit("]")).alias("sizes"))


_SCALED = f"{_counts('sites', SITES)}, used AS (SELECT site, bs, -ln(bs * 25.0::DOUBLE) AS u, ln(count_fit) AS v FROM counts WHERE bs <= 16)"


@query(f"""WITH {_SCALED}, fit AS (SELECT site, {_FIT} FROM used GROUP BY 1), o AS (SELECT site, k, regr_slope(ln(n), u) AS slope, count(*) AS c FROM n JOIN used USING (site, bs) GROUP BY 1, 2), og AS (SELECT site, coalesce(stddev_samp(slope), 0) AS sd FROM o WHERE c = 4 GROUP BY 1),
 l AS (SELECT a.site, a.bs, regr_slope(b.v, b.u) AS slope FROM used a JOIN used b ON a.site = b.site AND a.bs <> b.bs GROUP BY 1, 2), lg AS (SELECT site, stddev_samp(slope) AS sd FROM l GROUP BY 1)
 SELECT site, round(slope, 6) AS dimension, n_points, 'box_counting_fixed_physical_range_multi_origin' AS method, round(og.sd, 6) AS grid_offset_std, round(og.sd / abs(slope), 6) AS grid_offset_cv, round(lg.sd, 6) AS leave_one_out_std, round(lg.sd / abs(slope), 6) AS leave_one_out_cv, round(log10(8), 6) AS scale_span_decades FROM fit JOIN og USING (site) JOIN lg USING (site)""")
def scaling_fit(spark, sf_dir):
    out = fractal.scaling_fit(sites(spark, sf_dir), SIZES[:-1], 25.0, 4, 50.0, 400.0)
    return out.select("site", "dimension", "n_points", "method", "grid_offset_std", "grid_offset_cv", "leave_one_out_std", "leave_one_out_cv", "scale_span_decades")


@query(f"WITH {HEIGHTS}, {SQUARE}, r AS (SELECT y, x, sum(CASE WHEN h IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY y ORDER BY x) AS s FROM square LEFT JOIN heights USING (site, y, x)) SELECT 0::BIGINT AS site, y, x, (sum(s) OVER (PARTITION BY x ORDER BY y))::BIGINT AS total FROM r")
def integral_image(spark, sf_dir):
    return fractal.integral_image(heights(spark, sf_dir), SIDE, SIDE)


@query(f"SELECT site, min(lacunarity) AS min, max(lacunarity) AS max, round(avg(lacunarity), 5) AS mean, arg_max(ws, lacunarity) * 25.0::DOUBLE AS peak_window_m FROM ({_LACUNARITY}) GROUP BY 1")
def lacunarity_summary(spark, sf_dir):
    from .fixtures import disk

    d = disk(spark)
    curve = fractal.lacunarity(heights(spark, sf_dir).join(d, ["site", "y", "x"], "left_semi"), d, (4, 8, 16, 32), SIDE, SIDE)
    return fractal.lacunarity_summary(curve, 25.0).withColumn("mean", F.round("mean", 5))


@query(_spectrum("1.0") + """, e AS (SELECT *, r2 >= 0.95 AS fine FROM d), s AS (SELECT site, q, "Dq" - lag("Dq") OVER w AS step, "Dq" - lag("Dq") OVER w - 2 * sqrt(se * se + lag(se) OVER w * lag(se) OVER w) AS excess FROM e WHERE fine AND q >= 0 WINDOW w AS (PARTITION BY site ORDER BY q)),
 a AS (SELECT site, q, "Dq" - lag("Dq") OVER w AS step, "Dq" - lag("Dq") OVER w - 2 * sqrt(se * se + lag(se) OVER w * lag(se) OVER w) AS excess FROM e WHERE fine WINDOW w AS (PARTITION BY site ORDER BY q))
 SELECT (SELECT count(*) FROM s) AS n_q, coalesce((SELECT max(excess) <= 1e-12 AND count(*) >= 2 FROM s), false) AS monotone, (SELECT count(*) FROM a) AS n_q_all_fitted, coalesce((SELECT max(excess) <= 1e-12 AND count(*) >= 2 FROM a), false) AS monotone_all_fitted, (SELECT bool_and("Dq" <= 2 + 2 * se + 1e-12) FROM e) AS embedding_pass""")
def spectrum_checks(spark, sf_dir):
    raw = fractal.moments(heights(spark, sf_dir).withColumn("mass", F.lit(1.0)), SIZES, QS)
    return fractal.spectrum_checks(fractal.spectrum(raw)).select("n_q", "monotone", "n_q_all_fitted", "monotone_all_fitted", "embedding_pass")


# --- topology ---------------------------------------------------------------------------

#: Two islands, so that the largest component's extent is not the domain's.
_ISLES = SQUARE + ", isles AS (SELECT * FROM square WHERE (y - 128) * (y - 128) + (x - 100) * (x - 100) <= 8100 OR (y - 128) * (y - 128) + (x - 230) * (x - 230) <= 225)"


def isles(spark):
    return square(spark).where("(y - 128) * (y - 128) + (x - 100) * (x - 100) <= 8100 or (y - 128) * (y - 128) + (x - 230) * (x - 230) <= 225")


def _near(reach: int, cells: str) -> str:
    return f"near AS (SELECT y + a.dy AS y, x + b.dx AS x, min(a.dy * a.dy + b.dx * b.dx) AS d2 FROM {cells}, range(-{reach}, {reach + 1}) a(dy), range(-{reach}, {reach + 1}) b(dx) WHERE a.dy * a.dy + b.dx * b.dx <= {reach * reach} AND y + a.dy BETWEEN 0 AND 255 AND x + b.dx BETWEEN 0 AND 255 GROUP BY 1, 2)"


@query(f"WITH {HEIGHTS}, {_near(16, 'heights')} SELECT d2::BIGINT AS d2, count(*) AS n FROM near GROUP BY 1")
def distances_wide(spark, sf_dir):
    return topology.distances(heights(spark, sf_dir), 16, SIDE, SIDE).groupBy(F.col("d2").cast("long").alias("d2")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_ISLES}, b AS (SELECT a.* FROM isles a WHERE (SELECT count(*) FROM isles o WHERE (o.y = a.y AND abs(o.x - a.x) = 1) OR (o.x = a.x AND abs(o.y - a.y) = 1)) < 4) SELECT site, y, x FROM b")
def domain_boundary(spark, sf_dir):
    return topology.domain_boundary(isles(spark))


_PROFILE = f"""WITH RECURSIVE {HEIGHTS}, {_ISLES}, inner_ AS (SELECT y, x FROM heights JOIN isles USING (site, y, x)), {_near(2, 'inner_')}, masks AS (SELECT r::BIGINT AS r, y, x FROM near JOIN isles USING (y, x), (VALUES (0), (1), (2)) v(r) WHERE d2 <= r * r),
 both_ AS (SELECT 0 AS kind, r, y, x FROM masks UNION ALL SELECT 1, v.r::BIGINT, y, x FROM isles CROSS JOIN (VALUES (0), (1), (2)) v(r) WHERE NOT EXISTS (SELECT 1 FROM masks m WHERE m.r = v.r AND m.y = isles.y AND m.x = isles.x)),
 edge AS (SELECT a.y, a.x FROM isles a LEFT JOIN isles e ON e.y = a.y AND e.x = a.x + 1 LEFT JOIN isles w ON w.y = a.y AND w.x = a.x - 1 LEFT JOIN isles n ON n.y = a.y + 1 AND n.x = a.x LEFT JOIN isles s ON s.y = a.y - 1 AND s.x = a.x WHERE e.x IS NULL OR w.x IS NULL OR n.x IS NULL OR s.x IS NULL),
 run AS (SELECT kind, r, y, min(x) AS x0, max(x) AS x1, count(*) AS n, min(((kind * 4 + r) * 256 + y) * 256 + x) AS id, bool_or(edge.x IS NOT NULL) AS open_ FROM (SELECT *, x - row_number() OVER (PARTITION BY kind, r, y ORDER BY x) AS g FROM both_) LEFT JOIN edge USING (y, x) GROUP BY kind, r, y, g),
 e0 AS (SELECT a.id AS s, b.id AS t FROM run a JOIN run b ON b.kind = a.kind AND b.r = a.r AND b.y = a.y + 1 AND b.x0 <= a.x1 + a.kind AND b.x1 >= a.x0 - a.kind), e AS (SELECT s, t FROM e0 UNION ALL SELECT t, s FROM e0),
 lab(id, l) USING KEY (id) AS (SELECT id, id FROM run UNION SELECT e.t, min(q.l) FROM lab q JOIN e ON e.s = q.id JOIN recurring.lab k ON k.id = e.t WHERE q.l < k.l GROUP BY e.t),
 comp AS (SELECT kind, r, l, sum(n) AS n, bool_or(open_) AS open_, bool_or(x0 <= 10) AS bl, bool_or(x1 >= 245) AS br, bool_or(y <= 38) AS bt, bool_or(y >= 218) AS bb, bool_or(x0 <= 10 AND x1 <= 190) AS ml, bool_or(x1 >= 190 AND x1 <= 190) AS mr, bool_or(y <= 38 AND x1 <= 190) AS mt, bool_or(y >= 218 AND x1 <= 190) AS mb FROM run JOIN lab USING (id) GROUP BY 1, 2, 3),
 pairs AS (SELECT a.r, count(*) AS f, count(e.x) AS eh, count(v.x) AS ev, count(d.x) AS ed, count(n.x) AS ea FROM masks a LEFT JOIN masks e ON e.r = a.r AND e.y = a.y AND e.x = a.x + 1 LEFT JOIN masks v ON v.r = a.r AND v.y = a.y + 1 AND v.x = a.x LEFT JOIN masks d ON d.r = a.r AND d.y = a.y + 1 AND d.x = a.x + 1 LEFT JOIN masks n ON n.r = a.r AND n.y = a.y - 1 AND n.x = a.x + 1 GROUP BY 1),
 prof AS (SELECT r, count(*) FILTER (kind = 0) AS beta0, count(*) FILTER (kind = 1 AND NOT open_) AS beta1, (sum(n) FILTER (kind = 0))::BIGINT AS area_px, (max(n) FILTER (kind = 0))::BIGINT AS largest, count(*) FILTER (kind = 0 AND bl AND br) AS lr, count(*) FILTER (kind = 0 AND bt AND bb) AS tb, count(*) FILTER (kind = 0 AND ml AND mr) AS mlr, count(*) FILTER (kind = 0 AND mt AND mb) AS mtb FROM comp GROUP BY 1),
 p AS (SELECT prof.*, 10 * pi() / 4 * ((2 * f - eh - ev) + (2 * f - ed - ea) / sqrt(2)) AS perimeter, (SELECT count(*) FROM isles)::BIGINT AS room, (SELECT count(*) FROM isles WHERE x <= 190)::BIGINT AS core, first_value(beta0) OVER (ORDER BY r) AS initial FROM prof JOIN pairs USING (r))"""


@query(_PROFILE + """ SELECT 0::BIGINT AS site, r, beta0, beta1, beta0 - beta1 AS chi, area_px, largest AS largest_component_px, round(largest / area_px, 6) AS giant_fraction, lr AS beta0_lr, tb AS beta0_tb, mlr AS beta0_lr_main_component, mtb AS beta0_tb_main_component, round(perimeter, 6) AS perimeter_m,
 2::BIGINT AS domain_component_count, round(core / room, 6) AS largest_domain_component_fraction, round(beta0 / initial, 6) AS beta0_per_initial_component, round(perimeter / sqrt(room * 100), 6) AS perimeter_per_characteristic_length, round(10 * r / sqrt(room * 100), 6) + 0.0 AS radius_relative_to_characteristic_length FROM p""")
def domain_profile(spark, sf_dir):
    p = topology.domain_topology(heights(spark, sf_dir), isles(spark), [0, 1, 2], SIDE, SIDE, 10.0)
    return p.select("site", "r", "beta0", "beta1", "chi", "area_px", "largest_component_px", "giant_fraction", "beta0_lr", "beta0_tb", "beta0_lr_main_component", "beta0_tb_main_component", "perimeter_m", "domain_component_count", "largest_domain_component_fraction", "beta0_per_initial_component", "perimeter_per_characteristic_length", "radius_relative_to_characteristic_length")


@query(_PROFILE + """, c AS (SELECT *, 10.0::DOUBLE * r AS m, beta0 - beta1 AS chi, lag(beta0 - beta1) OVER w AS chi0, lag(10.0::DOUBLE * r) OVER w AS m0, lag(beta0) OVER w AS b0, lag(beta1) OVER w AS b1, lag(perimeter) OVER w AS p0 FROM p WINDOW w AS (ORDER BY r)),
 a AS (SELECT min(m) FILTER (largest / area_px >= 0.1) AS giant_component_radius_m, min(m) FILTER (lr > 0) AS lr, min(m) FILTER (tb > 0) AS tb, min(m) FILTER (mlr > 0) AS mlr, min(m) FILTER (mtb > 0) AS mtb, arg_min(beta0, r) AS z0, arg_min(beta1, r) AS z1, min(beta0) AS beta0_min, max(beta0) AS beta0_max, min(chi) AS chi_min, max(chi) AS chi_max, arg_max(m, beta1) AS peak,
  coalesce(min(m) FILTER (chi = 0), min(m0 - chi0 * (m - m0) / (chi - chi0)) FILTER (sign(chi0) <> sign(chi))) AS zero, sum((ln(m) - ln(m0)) * (beta0 + b0) / 2) FILTER (m0 > 0) AS arch, sum((ln(m) - ln(m0)) * (beta1 + b1) / 2) FILTER (m0 > 0) AS void, sum((ln(m) - ln(m0)) * (perimeter + p0) / 2) FILTER (m0 > 0) AS bdry, sqrt(any_value(room) * 100) AS lc FROM c)
 SELECT giant_component_radius_m, lr AS spanning_radius_lr_m, least(mlr, mtb) AS spanning_radius_any_recommended_m, 'largest_component' AS spanning_reference_recommended, false AS full_domain_spanning_interpretable, z0 AS beta0_at_zero, z1 AS beta1_at_zero, beta0_min, beta0_max, chi_min, chi_max, peak AS beta1_peak_radius_m,
 round(zero, 6) AS chi_zero_crossing_radius_m, round(arch, 6) AS archipelago_index, round(void, 6) AS void_index, round(bdry, 6) AS boundary_complexity_index, round(lc, 6) AS characteristic_length_m, round(ln(2), 6) AS log_radius_span, round(arch / ln(2), 6) AS archipelago_index_mean, round(void / ln(2) / z0, 6) AS void_index_per_component,
 round(bdry / ln(2) / lc, 6) AS boundary_index_per_characteristic_length FROM a""")
def domain_topology_summary(spark, sf_dir):
    p = topology.domain_topology(heights(spark, sf_dir), isles(spark), [0, 1, 2], SIDE, SIDE, 10.0)
    names = ["giant_component_radius_m", "spanning_radius_lr_m", "spanning_radius_any_recommended_m", "spanning_reference_recommended", "full_domain_spanning_interpretable", "beta0_at_zero", "beta1_at_zero", "beta0_min", "beta0_max", "chi_min", "chi_max", "beta1_peak_radius_m", "chi_zero_crossing_radius_m",
             "archipelago_index", "void_index", "boundary_complexity_index", "characteristic_length_m", "log_radius_span", "archipelago_index_mean", "void_index_per_component", "boundary_index_per_characteristic_length"]
    return topology.domain_profile_summary(p, 0.1).select(*names)


# --- transport --------------------------------------------------------------------------

#: Grids of 24 x 20 cells whose building fraction changes along x only, so that both directions have closed forms.
_LAYERED = "f AS (SELECT n_nationkey::BIGINT AS site, x, ((n_nationkey * 7 + x * 3) % 10) / 10.0::DOUBLE AS fraction FROM nation, range(20) c(x)), k AS (SELECT site, x, phase, exp(ln(0.001::DOUBLE) * CASE phase WHEN 'open_space' THEN fraction ELSE 1 - fraction END) AS k FROM f, (VALUES ('open_space'), ('buildings')) p(phase))"
_CLOSED = _LAYERED + """, lr AS (SELECT a.site, a.phase, 24 / sum((a.k + b.k) / (2 * a.k * b.k)) AS g FROM k a JOIN k b ON a.site = b.site AND a.phase = b.phase AND b.x = a.x + 1 GROUP BY 1, 2), tb AS (SELECT site, phase, sum(k) / 23 AS g FROM k GROUP BY 1, 2),
 both_ AS (SELECT site, phase, 'lr' AS direction, g, 24 / 19.0::DOUBLE AS base, 19 / 24.0::DOUBLE AS shape FROM lr UNION ALL SELECT site, phase, 'tb', g, 20 / 23.0::DOUBLE, 23 / 20.0::DOUBLE FROM tb)"""


def _layered(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("site"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("x"))
    return n.select("site", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("y"), "x", ((F.col("site") * 7 + F.col("x") * 3) % 10 / 10.0).alias("fraction"))


@query(f"WITH {_CLOSED} SELECT site, phase, direction, round(g, 6) AS conductance, round(1 / g, 4) AS resistance, round(g / base, 6) AS relative_conductance, round(g * shape, 6) AS effective_conductivity_bbox, 480::BIGINT AS active_cells, CASE direction WHEN 'lr' THEN 432 ELSE 440 END::BIGINT AS unknown_cells, 0::BIGINT AS excluded_unanchored_cells, true AS energy_pass, true AS converged FROM both_")
def layered_conductance(spark, sf_dir):
    out = transport.conductances(_layered(spark, sf_dir), 24, 20)
    return out.select("site", "phase", "direction", "conductance", F.round("resistance", 4).alias("resistance"), "relative_conductance", "effective_conductivity_bbox", "active_cells", "unknown_cells", "excluded_unanchored_cells", (F.col("energy_error") <= 1e-5).alias("energy_pass"), "converged")


@query(f"WITH {_CLOSED} SELECT a.site, a.phase, 'ok' AS status, round((a.g / a.base) / (b.g / b.base), 6) AS anisotropy_relative_conductance, true AS energy_pass FROM both_ a JOIN both_ b ON a.site = b.site AND a.phase = b.phase AND a.direction = 'lr' AND b.direction = 'tb'")
def transport_summary(spark, sf_dir):
    out = transport.transport_summary(transport.conductances(_layered(spark, sf_dir), 24, 20))
    return out.select("site", "phase", "status", "anisotropy_relative_conductance", (F.col("max_energy_identity_relative_error") <= 1e-5).alias("energy_pass"))


@query(f"WITH {_CLOSED} SELECT site, round(g, 6) AS energy, round(g, 6) AS flux FROM both_ WHERE phase = 'open_space' AND direction = 'lr'")
def dissipation(spark, sf_dir):
    f = _layered(spark, sf_dir)
    k = f.select("site", "y", "x", transport.conductivity(F.col("fraction"), 1000.0, "open_space").alias("k"))
    return transport.dissipation(k, transport.potentials(f, 24, 20, "open_space", 1000.0, "lr"))


@query(f"""WITH {HEIGHTS}, {_ISLES}, c AS (SELECT y // 3 AS y, x // 3 AS x, count(*) AS room, count(h) AS full_ FROM isles LEFT JOIN heights USING (site, y, x) GROUP BY 1, 2)
 SELECT 0::BIGINT AS site, y, x, round(full_ / room, 6) AS fraction, 3::BIGINT AS factor FROM c WHERE room >= 4.5""")
def transport_grid(spark, sf_dir):
    return transport.transport_grid(heights(spark, sf_dir), isles(spark), 3000)


# --- sweep ------------------------------------------------------------------------------

_RUNS = """runs AS (SELECT s_suppkey % 20 AS site, (10 + s_suppkey)::DOUBLE AS px, CASE WHEN s_suppkey % 11 = 0 THEN 'error' ELSE 'ok' END AS status, 1.5 + ((s_suppkey * 13) % 20) / 200.0::DOUBLE AS d, CASE WHEN s_suppkey % 9 = 0 THEN 0.9 ELSE 0.99 END AS r2, (5 + s_suppkey % 4)::DOUBLE AS n,
 CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE (s_suppkey % 7) / 100.0::DOUBLE END AS err, CASE WHEN s_suppkey % 20 < 10 THEN (100 + s_suppkey % 17)::DOUBLE END AS span FROM supplier)"""


@query(f"""WITH {_RUNS}, q AS (SELECT * FROM runs WHERE status = 'ok' AND err <= 0.05 AND r2 >= 0.95 AND n >= 6), t AS (SELECT site, count(*) AS n_runs_total, count(*) FILTER (status = 'ok') AS n_runs_ok FROM runs GROUP BY 1),
 a AS (SELECT site, count(*) AS n, CASE WHEN count(*) >= 2 THEN stddev_samp(d) / abs(avg(d)) END AS dcv, CASE WHEN count(span) >= 2 THEN stddev_samp(span) / abs(avg(span)) END AS scv, median(px) AS mid FROM q GROUP BY 1), j AS (SELECT *, coalesce(n >= 2 AND dcv <= 0.05 AND coalesce(scv <= 0.10, true), false) AS stable FROM t LEFT JOIN a USING (site))
 SELECT site, n_runs_total, n_runs_ok, coalesce(n, 0) AS n_runs_quality, round(dcv, 6) AS "D_build_cv", round(scv, 6) AS spanning_radius_cv, stable, CASE WHEN stable THEN mid END AS recommended_pixel_size_m FROM j""")
def sweep_stability(spark, sf_dir):
    k = F.col("s_suppkey")
    runs = table(spark, sf_dir, "supplier").select(
        (k % 20).alias("site"), (k + 10).cast("double").alias("pixel_size_m"), F.when(k % 11 == 0, "error").otherwise("ok").alias("status"), (1.5 + ((k * 13) % 20) / 200.0).alias("D_build"), F.when(k % 9 == 0, 0.9).otherwise(0.99).alias("D_r2"), (5 + k % 4).cast("double").alias("D_n_points"),
        F.when(k % 7 != 0, (k % 7) / 100.0).alias("raster_area_error_rel"), F.when(k % 20 < 10, (100 + k % 17).cast("double")).alias("spanning_radius_any_m"),
    )
    return sweep.stability(runs).select("site", "n_runs_total", "n_runs_ok", "n_runs_quality", "D_build_cv", "spanning_radius_cv", "stable", "recommended_pixel_size_m")


# --- statistics -------------------------------------------------------------------------

#: Student's two-sided tail for odd and even degrees of freedom, by the same finite sums in SQL.
_TAIL = """CASE WHEN df % 2 = 1 THEN 1 - 2 / pi() * (a + CASE WHEN df > 1 THEN sin(a) * list_sum([pow(cos(a), 2 * j + 1) * exp(j * ln(4) + 2 * lgamma(j + 1) - lgamma(2 * j + 2)) for j in range(0, ((df - 1) / 2)::BIGINT)]) ELSE 0 END)
 ELSE 1 - sin(a) * list_sum([pow(cos(a), 2 * j) * exp(lgamma(2 * j + 1) - j * ln(4) - 2 * lgamma(j + 1)) for j in range(0, (df / 2)::BIGINT)]) END"""


@query(f"""WITH {_RANKS}, c AS (SELECT a.feature, b.feature AS other, corr(a.rk, b.rk) AS rho, count(*) AS n FROM ranks a JOIN ranks b USING (site) GROUP BY 1, 2), t AS (SELECT *, n - 2 AS df, atan(abs(rho) / sqrt(1 - least(rho * rho, 1 - 1e-12))) AS a FROM c)
 SELECT feature, other, n, CASE WHEN feature = other THEN 0 WHEN n < 4 THEN NULL ELSE round({_TAIL}, 5) + 0.0 END AS p FROM t""")
def spearman_p_values(spark, sf_dir):
    return stats.spearman_p(stats.spearman(customer_features(spark, sf_dir))).select("feature", "other", "n", F.round("p", 5).alias("p"))


@query(f"""WITH {FEATURES}, w AS (SELECT site, feature, CASE WHEN (site + length(feature)) % 5 = 0 AND feature <> 'price' THEN NULL WHEN feature = 'price' AND site % 2 = 0 THEN NULL ELSE value END AS value FROM features), q AS (SELECT feature, median(value) AS med FROM w GROUP BY 1 HAVING avg((value IS NULL)::INT) <= 0.3 AND var_pop(value) > 0)
 SELECT site, feature, round(coalesce(value, med), 4) + 0.0 AS value FROM w JOIN q USING (feature)""")
def imputed_features(spark, sf_dir):
    f = customer_features(spark, sf_dir).select("site", "feature", "value")
    gone = ((F.col("site") + F.length("feature")) % 5 == 0) & (F.col("feature") != "price") | (F.col("feature") == "price") & (F.col("site") % 2 == 0)
    return stats.imputed(f.withColumn("value", F.when(~gone, F.col("value")))).withColumn("value", F.round("value", 4))


_ORDER = ("customers", "orders", "price", "balance", "top_balance")


@query(f"""WITH RECURSIVE {_RANKS}, c AS (SELECT a.feature, b.feature AS other, corr(a.rk, b.rk) AS rho FROM ranks a JOIN ranks b USING (site) GROUP BY 1, 2), m AS (SELECT map_from_entries(list(struct_pack(k := feature || '|' || other, v := rho))) AS m FROM c),
 o AS (SELECT i, f FROM (VALUES (1, 'customers'), (2, 'orders'), (3, 'price'), (4, 'balance'), (5, 'top_balance')) o(i, f)), g(i, f, kept, hit) AS (SELECT 0, '', []::VARCHAR[], NULL::VARCHAR UNION ALL
 SELECT o.i, o.f, CASE WHEN len(list_filter(g.kept, lambda k : abs(m.m[o.f || '|' || k]) >= 0.3)) = 0 THEN list_append(g.kept, o.f) ELSE g.kept END, list_filter(g.kept, lambda k : abs(m.m[o.f || '|' || k]) >= 0.3)[1] FROM g JOIN o ON o.i = g.i + 1, m)
 SELECT f AS feature, CASE WHEN hit IS NULL THEN 'keep' ELSE 'drop_redundant' END AS status, coalesce(hit, '') AS redundant_with, CASE WHEN hit IS NOT NULL THEN round(m.m[f || '|' || hit], 6) END AS spearman_rho FROM g, m WHERE i > 0""")
def feature_redundancy(spark, sf_dir):
    return stats.redundancy(spark, list(_ORDER), stats.spearman(customer_features(spark, sf_dir)), 0.3)


_PHI = "1 - 2 * exp(-d * d / 2) / sqrt(2 * pi()) * list_sum([exp((2 * j + 1) * ln(d) - lgamma(2 * j + 2) + j * ln(2) + lgamma(j + 1)) for j in range(0, 200)])"


@query(f"""WITH x AS (SELECT o_orderpriority AS feature, o_orderstatus = 'F' AS a, round(o_totalprice, -3) AS value FROM orders WHERE o_orderstatus IN ('F', 'O')), r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rk FROM x), t AS (SELECT feature, sum(c * c * c - c) AS ties FROM (SELECT feature, value, count(*)::DOUBLE AS c FROM r GROUP BY 1, 2) GROUP BY 1),
 s AS (SELECT feature, count(*) FILTER (a) AS n1, count(*) FILTER (NOT a) AS n2, sum(rk) FILTER (a) AS r1 FROM r GROUP BY 1), d AS (SELECT feature, greatest(abs(r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2.0) - 0.5, 0) / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS d FROM s JOIN t USING (feature)),
 p AS (SELECT feature, round(CASE WHEN d > 8 THEN 0 WHEN d = 0 THEN 1 ELSE {_PHI} END, 5) AS p FROM d), h AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, feature) AS raw FROM p) SELECT feature, p, round(least(min(raw) OVER (ORDER BY p DESC, feature DESC ROWS UNBOUNDED PRECEDING), 1.0), 6) AS p_fdr_bh FROM h""")
def group_tests(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("site"), F.col("o_orderpriority").alias("feature"), F.col("o_orderstatus").alias("grp"), F.round("o_totalprice", -3).alias("value"))
    t = stats.mann_whitney(x, "grp", "F", "O").select(F.col("feature").alias("name"), F.round("p", 5).alias("p"))
    return stats.benjamini_hochberg(t).select(F.col("name").alias("feature"), "p", F.col("p_adjusted").alias("p_fdr_bh"))


@query("""WITH p AS (SELECT p_brand AS name, CASE WHEN p_brand LIKE '%3' THEN NULL ELSE round(count(*) FILTER (p_size > 40) / count(*), 6) END AS p FROM part GROUP BY 1), r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, name) AS raw FROM p WHERE p IS NOT NULL)
 SELECT name, p, round(least(min(raw) OVER (ORDER BY p DESC, name DESC ROWS UNBOUNDED PRECEDING), 1.0), 6) AS p_adjusted FROM r UNION ALL SELECT name, NULL, NULL FROM p WHERE p IS NULL""")
def bh_with_missing(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.round(F.count_if(F.col("p_size") > 40) / F.count(F.lit(1)), 6).alias("p"))
    return stats.benjamini_hochberg(p.withColumn("p", F.when(~F.col("name").endswith("3"), F.col("p"))))


# --- a whole site -----------------------------------------------------------------------

_SITE = f"{_UNITS}, sitecells AS (SELECT 0::BIGINT AS site, 63 - y AS y, x, h FROM u)"


@query(f"""WITH {_counts('sitecells', _SITE)}, {_SIDES}, f AS (SELECT site, {_FIT} FROM (SELECT site, ln(count_fit) AS v, -ln(bs * 25.0::DOUBLE) AS u FROM counts) GROUP BY 1), m AS (SELECT count(*) AS n, sum(h) AS volume, {_WALLS} AS walls FROM near)
 SELECT (SELECT count(*) FROM b) AS n_buildings, n * 625.0::DOUBLE AS footprint_area_m2, round(volume * 625.0::DOUBLE, 3) AS volume_m3, round(walls * 25.0::DOUBLE, 3) AS wall_area_m2, 64::BIGINT AS n_rows, 4096::BIGINT AS n_pixels_domain, n AS n_pixels_buildings, true AS areas_agree, round(slope, 6) AS dimension, n_points::DOUBLE AS n_points, round(n / 4096, 6) AS foreground, 0.785398::DOUBLE AS compactness, false AS fallback FROM m, f""")
def site_analysis(spark, sf_dir):
    own = boxes(spark, sf_dir, 25.0).withColumns({"attrs": F.when(F.col("source") != "default", F.create_map(F.lit("height"), F.col("height").cast("string"))).otherwise(F.create_map(F.lit("building:levels"), (F.col("height") / 3).cast("string"))), "geographic": F.lit(False)}).drop("height", "source", "known", "value")
    edge = rectangle(spark, 0, 0, 1600, 1600).withColumns({"feature": F.lit(0).cast("long"), "attrs": F.create_map(F.lit("name"), F.lit("x")), "geographic": F.lit(False)})
    doc = F.col("doc")
    d, s, f, p = doc["raster_diagnostics"], doc["building_surfaces"], doc["fractal_dimension_building_footprints"], doc["planar_boundary"]
    out = analysis.analyzed(spark, own, edge, analysis.AnalysisConfig())["document"]
    return out.select(
        s["n_buildings"].alias("n_buildings"), s["footprint_area_m2"].alias("footprint_area_m2"), F.round(s["volume_m3"], 3).alias("volume_m3"), F.round(s["wall_area_m2"], 3).alias("wall_area_m2"), d["n_rows"].alias("n_rows"), d["n_pixels_domain"].alias("n_pixels_domain"), d["n_pixels_buildings"].alias("n_pixels_buildings"),
        ((d["raster_area_error_rel"] < 1e-9) & (d["boundary_raster_area_error_rel"] < 1e-9)).alias("areas_agree"), f["dimension"].alias("dimension"), f["n_points"].alias("n_points"), d["foreground_fraction_within_domain"].alias("foreground"), p["compactness_2d_analysis_boundary"].alias("compactness"), p["fallback_used"].alias("fallback"),
    )


@query("SELECT c_custkey, 32600 + floor((c_custkey % 300 - 150 + 180) / 6)::INT + 1 + CASE WHEN c_custkey % 80 - 40 < 0 THEN 100 ELSE 0 END AS near, 3857 AS polar FROM customer")
def metric_reference(spark, sf_dir):
    k = F.col("c_custkey")
    lon, lat = (k % 300 - 150).cast("double"), (k % 80 - 40).cast("double")
    return table(spark, sf_dir, "customer").select("c_custkey", g.metric_srid(lon - 0.001, lat - 0.001, lon + 0.001, lat + 0.003).cast("int").alias("near"), g.metric_srid(lon, F.lit(88.0), lon, F.lit(89.0)).cast("int").alias("polar"))
