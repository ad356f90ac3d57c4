"""Registered queries of the engine's own operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import atlas, fractal, raster, stats, topology, transport
from ..streaming import results
from .fixtures import DISK, FEATURES, HEIGHTS, QS, RADII, SIDE, SITES, SIZES, SQUARE, customer_features, disk, heights, sites, table

QUERIES: dict = {}
SQL: dict = {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to ``places``, without negative zeros."""
    return df.select(*[(F.round(F.col(f"`{c}`"), places) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n.split('.')[-1]}" for n in names)


_OFFSETS = "offs AS (SELECT bs::BIGINT AS bs, k::BIGINT AS k, CASE WHEN k >= 2 THEN bs // 2 ELSE 0 END AS sy, CASE WHEN k % 2 = 1 THEN bs // 2 ELSE 0 END AS sx FROM (VALUES (2),(4),(8),(16),(32),(64)) s(bs), range(4) r(k))"


def _counts(cells: str, source: str) -> str:
    return f"{source}, {_OFFSETS}, n AS (SELECT site, bs, k, count(*) AS n FROM (SELECT DISTINCT site, bs, k, (y + sy) // bs AS by_, (x + sx) // bs AS bx FROM {cells}, offs) GROUP BY 1, 2, 3), counts AS (SELECT site, bs, min(n) AS count_fit, avg(n) AS count_mean, min(n) AS count_min, max(n) AS count_max, coalesce(stddev_samp(n), 0) AS count_std, count(*) AS n_grid_offsets FROM n GROUP BY 1, 2)"


_FIT = "regr_slope(v, u) AS slope, regr_intercept(v, u) AS intercept, regr_r2(v, u) AS r2, sqrt(greatest(regr_syy(v, u) - regr_slope(v, u) * regr_slope(v, u) * regr_sxx(v, u), 0) / (count(*) - 2) / regr_sxx(v, u)) AS stderr, count(*) AS n_points"


@query(f"WITH {_counts('heights', HEIGHTS)} SELECT site, bs, count_fit, {_r('count_mean')}, count_min, count_max, {_r('count_std')}, n_grid_offsets, round(count_std / count_mean, 6) + 0.0 AS count_cv, bs::DOUBLE AS scale_m FROM counts")
def box_counts(spark, sf_dir):
    return fractal.box_counts(heights(spark, sf_dir), SIZES)


@query(f"WITH {_counts('heights', HEIGHTS)}, f AS (SELECT site, {_FIT} FROM (SELECT site, ln(count_fit) AS v, -ln(bs) AS u FROM counts) GROUP BY 1) SELECT site, round(slope, 6) AS dimension, {_r('intercept', 'r2', 'stderr')}, n_points FROM f")
def box_dimension(spark, sf_dir):
    return fractal.box_dimension(fractal.box_counts(heights(spark, sf_dir), SIZES)).select("site", "dimension", "intercept", "r2", "stderr", "n_points")


@query(f"WITH {_counts('sites', SITES)}, f AS (SELECT site, {_FIT} FROM (SELECT site, ln(count_fit) AS v, -ln(bs) AS u FROM counts WHERE bs <= 32) GROUP BY 1) SELECT site, round(slope, 6) AS dimension, {_r('intercept', 'r2', 'stderr')}, n_points FROM f")
def box_dimension_sites(spark, sf_dir):
    return fractal.box_dimension(fractal.box_counts(sites(spark, sf_dir), SIZES[:-1])).select("site", "dimension", "intercept", "r2", "stderr", "n_points")


@query(f"WITH {_counts('heights', HEIGHTS)}, f AS (SELECT site, k, {_FIT} FROM (SELECT site, k, ln(n) AS v, -ln(bs) AS u FROM n) GROUP BY 1, 2) SELECT site, k, {_r('slope', 'intercept', 'r2', 'stderr')}, n_points FROM f")
def box_offset_slopes(spark, sf_dir):
    return fractal.offset_slopes(fractal.offset_counts(heights(spark, sf_dir), SIZES))


@query(f"WITH {_counts('heights', HEIGHTS)}, p AS (SELECT site, bs, ln(count_fit) AS v, -ln(bs) AS u FROM counts) SELECT a.site, a.bs, round(regr_slope(b.v, b.u), 6) + 0.0 AS slope FROM p a JOIN p b ON a.site = b.site AND a.bs <> b.bs GROUP BY 1, 2")
def box_leave_one_out(spark, sf_dir):
    return fractal.leave_one_out(fractal.box_counts(heights(spark, sf_dir), SIZES))


@query(f"""WITH {_counts('heights', HEIGHTS)}, p AS (SELECT site, row_number() OVER (PARTITION BY site ORDER BY bs) AS i, ln(count_fit) AS v, -ln(bs) AS u FROM counts),
 f AS (SELECT a.site, a.i AS start, b.i AS stop, regr_slope(v, u) AS slope, regr_r2(v, u) AS r2, count(*) AS n_points, max(u) - min(u) AS span FROM p a JOIN p b ON a.site = b.site AND b.i - a.i + 1 >= 4 JOIN (SELECT site, i AS j, v, u FROM p) c ON c.site = a.site AND c.j BETWEEN a.i AND b.i GROUP BY 1, 2, 3)
 SELECT site, start, stop, {_r('slope', 'r2')}, n_points, round(r2 + 0.01 * n_points + 0.01 * span - 0.5 * greatest(0.95 - r2, 0), 6) + 0.0 AS score FROM f""".replace("SELECT a.site, a.i AS start, b.i AS stop, regr_slope(v, u)", "SELECT a.site, a.i AS start, b.i AS stop, regr_slope(c.v, c.u)").replace("regr_r2(v, u) AS r2, count(*) AS n_points, max(u) - min(u)", "regr_r2(c.v, c.u) AS r2, count(*) AS n_points, max(c.u) - min(c.u)"))
def scaling_windows_top(spark, sf_dir):
    out = fractal.window_fits(fractal.box_counts(heights(spark, sf_dir), SIZES)).where("rank <= 200")
    return out.select("site", F.col("start").cast("long"), F.col("stop").cast("long"), "slope", "r2", "n_points", "score")


def _moments(mass: str) -> str:
    return f"""{HEIGHTS}, b AS (SELECT site, bs::BIGINT AS bs, y // bs AS by_, x // bs AS bx, sum({mass}) AS m FROM heights, (VALUES (2),(4),(8),(16),(32),(64)) s(bs) GROUP BY 1, 2, 3, 4), p AS (SELECT site, bs, m / sum(m) OVER (PARTITION BY site, bs) AS p FROM b),
 raw AS (SELECT site, bs, q::DOUBLE AS q, sum(CASE WHEN q = 1 THEN p * ln(p) ELSE pow(p, q) END) AS value, count(*) AS n_positive_boxes FROM p, (VALUES (-2),(0),(1),(2)) v(q) GROUP BY 1, 2, 3)"""


@query(f"WITH {_moments('1.0')} SELECT site, bs, q, round(ln(abs(value)), 6) + 0.0 AS ln_value, n_positive_boxes FROM raw")
def mf_moments(spark, sf_dir):
    return fractal.moments(heights(spark, sf_dir).withColumn("mass", F.lit(1.0)), SIZES, QS).select("site", "bs", "q", F.ln(F.abs("value")).alias("ln_value"), "n_positive_boxes")


def _spectrum(mass: str) -> str:
    return f"""WITH {_moments(mass)}, f AS (SELECT site, q, {_FIT} FROM (SELECT site, q, CASE WHEN q = 1 THEN value ELSE ln(value) END AS v, ln(bs) AS u FROM raw) GROUP BY 1, 2),
 d AS (SELECT site, q, CASE WHEN q = 1 THEN slope ELSE slope / (q - 1) END AS "Dq", CASE WHEN q = 1 THEN stderr ELSE stderr / abs(q - 1) END AS se, r2, n_points FROM f)"""


@query(_spectrum("1.0") + ' SELECT site, q, round("Dq", 6) AS "Dq", round(r2, 6) AS r2, round(se, 6) AS stderr, n_points FROM d')
def mf_spectrum(spark, sf_dir):
    raw = fractal.moments(heights(spark, sf_dir).withColumn("mass", F.lit(1.0)), SIZES, QS)
    return fractal.spectrum(raw).select("site", "q", "Dq", "r2", "stderr", "n_points")


@query(_spectrum("h") + ' SELECT site, q, round("Dq", 6) AS "Dq", round(r2, 6) AS r2, round(se, 6) AS stderr, n_points FROM d')
def mf_spectrum_height(spark, sf_dir):
    raw = fractal.moments(heights(spark, sf_dir).withColumn("mass", F.col("h")), SIZES, QS)
    return fractal.spectrum(raw).select("site", "q", "Dq", "r2", "stderr", "n_points")


@query(_spectrum("1.0") + """, s AS (SELECT site, "Dq", se, "Dq" - lag("Dq") OVER w AS step, "Dq" - lag("Dq") OVER w - 2 * sqrt(se * se + lag(se) OVER w * lag(se) OVER w) AS excess FROM d WINDOW w AS (PARTITION BY site ORDER BY q))
 SELECT site, count(*) AS n_q, round(max(step), 6) + 0.0 AS max_step, round(max(excess), 6) + 0.0 AS max_excess, max(excess) <= 1e-12 AS monotone, bool_and("Dq" <= 2 + 2 * se + 1e-12) AS embedding_pass FROM s GROUP BY 1""")
def mf_order_diagnostics(spark, sf_dir):
    raw = fractal.moments(heights(spark, sf_dir).withColumn("mass", F.lit(1.0)), SIZES, QS)
    return fractal.order_diagnostics(fractal.spectrum(raw))


_LACUNARITY = f"""WITH {HEIGHTS}, {DISK}, w AS (SELECT ws::BIGINT AS ws, greatest(1, ws // 4) AS st FROM (VALUES (4),(8),(16),(32)) v(ws)),
 integral AS (SELECT y, x, sum(sum_r) OVER (PARTITION BY x ORDER BY y) AS s, sum(room_r) OVER (PARTITION BY x ORDER BY y) AS room FROM (SELECT q.y, q.x, sum(CASE WHEN h.h IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY q.y ORDER BY q.x) AS sum_r, sum(CASE WHEN d.y IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY q.y ORDER BY q.x) AS room_r FROM square q LEFT JOIN disk d ON d.y = q.y AND d.x = q.x LEFT JOIN heights h ON h.y = d.y AND h.x = d.x)),
 pos AS (SELECT ws, wy * st AS y0, wx * st AS x0 FROM w, range(256) a(wy), range(256) b(wx) WHERE wy * st + ws <= 256 AND wx * st + ws <= 256),
 m AS (SELECT ws, d.s - coalesce(b.s, 0) - coalesce(c.s, 0) + coalesce(a.s, 0) AS mass, d.room - coalesce(b.room, 0) - coalesce(c.room, 0) + coalesce(a.room, 0) AS room FROM pos JOIN integral d ON d.y = y0 + ws - 1 AND d.x = x0 + ws - 1 LEFT JOIN integral b ON b.y = y0 - 1 AND b.x = x0 + ws - 1 LEFT JOIN integral c ON c.y = y0 + ws - 1 AND c.x = x0 - 1 LEFT JOIN integral a ON a.y = y0 - 1 AND a.x = x0 - 1)
 SELECT 0::BIGINT AS site, ws, count(*) AS n_windows, round(avg(mass), 6) AS mean_mass, round(var_pop(mass), 6) AS var_mass, round(avg(mass / room), 6) AS mean_occupancy, round(var_pop(mass) / (avg(mass) * avg(mass)) + 1, 6) AS lacunarity FROM m WHERE room >= 0.95 * ws * ws GROUP BY 2"""


@query(_LACUNARITY)
def lacunarity(spark, sf_dir):
    d = disk(spark)
    return fractal.lacunarity(heights(spark, sf_dir).join(d, ["site", "y", "x"], "left_semi"), d, (4, 8, 16, 32), SIDE, SIDE)


_NEAR = f"{HEIGHTS}, near AS (SELECT site, y + a.dy AS y, x + b.dx AS x, min(a.dy * a.dy + b.dx * b.dx) AS d2 FROM heights, range(-4, 5) a(dy), range(-4, 5) b(dx) WHERE a.dy * a.dy + b.dx * b.dx <= 16 AND y + a.dy BETWEEN 0 AND 255 AND x + b.dx BETWEEN 0 AND 255 GROUP BY 1, 2, 3), masks AS (SELECT site, r::BIGINT AS r, y, x FROM near, range(5) v(r) WHERE d2 <= r * r)"


def _masks(spark, sf_dir):
    return topology.dilated(topology.distances(heights(spark, sf_dir), RADII[-1], SIDE, SIDE), RADII)


@query(f"WITH {_NEAR} SELECT site, d2::BIGINT AS d2, count(*) AS n FROM near GROUP BY 1, 2")
def edt_histogram(spark, sf_dir):
    return topology.distances(heights(spark, sf_dir), RADII[-1], SIDE, SIDE).groupBy("site", F.col("d2").cast("long").alias("d2")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_NEAR}, {DISK} SELECT m.site, m.r, count(*) AS area_px FROM masks m JOIN disk d ON d.y = m.y AND d.x = m.x GROUP BY 1, 2")
def minkowski_area(spark, sf_dir):
    return _masks(spark, sf_dir).join(disk(spark), ["site", "y", "x"], "left_semi").groupBy("site", "r").agg(F.count(F.lit(1)).alias("area_px"))


@query(f"""WITH {_NEAR}, c AS (SELECT a.r, count(*) AS area, count(e.x) AS eh, count(v.x) AS ev, count(d.x) AS ed, count(n.x) AS ea FROM masks a LEFT JOIN masks e ON e.r = a.r AND e.y = a.y AND e.x = a.x + 1 LEFT JOIN masks v ON v.r = a.r AND v.y = a.y + 1 AND v.x = a.x LEFT JOIN masks d ON d.r = a.r AND d.y = a.y + 1 AND d.x = a.x + 1 LEFT JOIN masks n ON n.r = a.r AND n.y = a.y - 1 AND n.x = a.x + 1 GROUP BY 1)
 SELECT 0::BIGINT AS site, r, area, eh, ev, ed, ea, round(pi() / 4 * ((2 * area - eh - ev) + (2 * area - ed - ea) / sqrt(2)), 6) AS perimeter_m FROM c""")
def crofton_profile(spark, sf_dir):
    return topology.crofton(topology.pair_counts(_masks(spark, sf_dir))).select("site", "r", "area", "eh", "ev", "ed", "ea", "perimeter_m")


_LABELS = f"""WITH RECURSIVE {_NEAR}, run AS (SELECT r, y, min(x) AS x0, max(x) AS x1, count(*) AS n, min(r * 65536 + y * 256 + x) AS id FROM (SELECT r, y, x, x - row_number() OVER (PARTITION BY r, y ORDER BY x) AS g FROM masks) GROUP BY r, y, g),
 e0 AS (SELECT a.id AS s, b.id AS t FROM run a JOIN run b ON b.r = a.r AND b.y = a.y + 1 AND b.x0 <= a.x1 AND b.x1 >= a.x0), e AS (SELECT s, t FROM e0 UNION ALL SELECT t, s FROM e0),
 lab(id, l) USING KEY (id) AS (SELECT id, id FROM run UNION SELECT e.t, min(q.l) FROM lab q JOIN e ON e.s = q.id JOIN recurring.lab k ON k.id = e.t WHERE q.l < k.l GROUP BY e.t),
 comp AS (SELECT r, l, sum(n) AS n, bool_or(x0 = 0) AS le, bool_or(x1 = 255) AS ri, bool_or(y = 0) AS top, bool_or(y = 255) AS bo FROM run JOIN lab USING (id) GROUP BY 1, 2)"""


@query(_LABELS + """, euler AS (SELECT a.r, count(*) - count(e.x) - count(v.x) + count(q.x) AS chi FROM masks a LEFT JOIN masks e ON e.r = a.r AND e.y = a.y AND e.x = a.x + 1 LEFT JOIN masks v ON v.r = a.r AND v.y = a.y + 1 AND v.x = a.x LEFT JOIN masks q ON q.r = a.r AND q.y = a.y + 1 AND q.x = a.x + 1 AND e.x IS NOT NULL AND v.x IS NOT NULL GROUP BY 1)
 SELECT 0::BIGINT AS site, r, count(*) AS beta0, count(*) - any_value(chi) AS beta1, any_value(chi) AS chi, sum(n)::BIGINT AS area, max(n)::BIGINT AS largest, count(*) FILTER (le AND ri) AS spans_lr, count(*) FILTER (top AND bo) AS spans_tb, round(max(n) / sum(n), 6) AS giant_fraction FROM comp JOIN euler USING (r) GROUP BY r""")
def betti_profile(spark, sf_dir):
    return topology.component_profile(_masks(spark, sf_dir), SIDE, SIDE)


@query(_LABELS + " SELECT 0::BIGINT AS site, r, n::BIGINT AS size, count(*) AS components FROM comp GROUP BY 2, 3")
def component_size_histogram(spark, sf_dir):
    return topology.component_sizes(_masks(spark, sf_dir)).groupBy("site", "r", F.col("n").alias("size")).agg(F.count(F.lit(1)).alias("components"))


@query()
def topology_summary(spark, sf_dir):
    return topology.profile_summary(topology.component_profile(_masks(spark, sf_dir), SIDE, SIDE))


_COARSE = HEIGHTS + ", coarse AS (SELECT site, y // 4 AS y, x // 4 AS x, count(*) / 16.0::DOUBLE AS fraction FROM heights GROUP BY 1, 2, 3)"


@query(f"WITH {_COARSE} SELECT site, y, x, fraction::DOUBLE AS fraction FROM coarse")
def coarsen_grid(spark, sf_dir):
    return transport.coarsened(heights(spark, sf_dir), 4)


def _full(spark, sf_dir):
    """Fractions of the coarse 64 x 64 grid, empty blocks included."""
    grid = spark.range(64 * 64).select(F.lit(0).cast("long").alias("site"), F.expr("id div 64").alias("y"), (F.col("id") % 64).alias("x"))
    return grid.join(transport.coarsened(heights(spark, sf_dir), 4), ["site", "y", "x"], "left").withColumn("fraction", F.coalesce("fraction", F.lit(0.0)))


_K = _COARSE + ", k AS (SELECT 0::BIGINT AS site, a.y::BIGINT AS y, b.x::BIGINT AS x, coalesce(fraction, 0)::DOUBLE AS fraction, exp(coalesce(fraction, 0)::DOUBLE * ln(0.001::DOUBLE)) AS k FROM range(64) a(y) CROSS JOIN range(64) b(x) LEFT JOIN coarse c ON c.y = a.y AND c.x = b.x)"


@query(f"WITH {_K} SELECT site, y, x, round(k, 6) AS open_space, round(exp((1 - fraction) * ln(0.001::DOUBLE)), 6) AS buildings FROM k")
def conductivity(spark, sf_dir):
    f = _full(spark, sf_dir)
    return f.select("site", "y", "x", transport.conductivity(F.col("fraction"), 1000.0, "open_space").alias("open_space"), transport.conductivity(F.col("fraction"), 1000.0, "buildings").alias("buildings"))


@query(f"WITH {_K}, e AS (SELECT a.y, a.x, b.x AS ox, 2 * a.k * b.k / (a.k + b.k) AS g FROM k a JOIN k b ON (b.y = a.y AND abs(b.x - a.x) = 1) OR (b.x = a.x AND abs(b.y - a.y) = 1)) SELECT 0::BIGINT AS site, y, x, round(sum(g), 6) AS diagonal, round(sum(CASE WHEN ox = 0 THEN g ELSE 0 END), 6) + 0.0 AS rhs FROM e WHERE x BETWEEN 1 AND 62 GROUP BY 2, 3")
def fv_diag_rhs(spark, sf_dir):
    k = _full(spark, sf_dir).withColumn("k", transport.conductivity(F.col("fraction"), 1000.0, "open_space")).select("site", "y", "x", "k")
    return transport.assembled(k)


@query()
def conductance(spark, sf_dir):
    out = transport.conductances(_full(spark, sf_dir), 64, 64)
    return out.select("site", "phase", "contrast", "direction", "conductance", "resistance", "relative_conductance", (F.col("energy_error") <= 1e-5).alias("energy_pass"), "converged")


@query()
def conductance_by_direction(spark, sf_dir):
    return transport.by_direction(transport.conductances(_full(spark, sf_dir), 64, 64))


@query("SELECT p_partkey, CASE WHEN v > 0 THEN round(v, 6) END AS height_m FROM (SELECT p_partkey, try_cast(replace(regexp_extract(t, '([-+]?\\d+(?:[.,]\\d+)?)', 1), ',', '.') AS DOUBLE) * CASE WHEN contains(t, 'ft') THEN 0.3048 ELSE 1 END AS v FROM (SELECT p_partkey, lower(trim(CASE p_partkey % 4 WHEN 0 THEN p_size || ' ft' WHEN 1 THEN p_size || ',5 m' WHEN 2 THEN 'none' ELSE ' ' || p_size END)) AS t FROM part))")
def height_parse(spark, sf_dir):
    size = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat(size, F.lit(" ft"))).when(k == 1, F.concat(size, F.lit(",5 m"))).when(k == 2, "none").otherwise(F.concat(F.lit(" "), size))
    return table(spark, sf_dir, "part").select("p_partkey", g.parsed_height(text).alias("height_m"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN 3.0 * p_size ELSE 12.0 END AS value, CASE p_partkey % 3 WHEN 0 THEN 'Height' WHEN 1 THEN 'levels' ELSE 'default' END AS source FROM part")
def height_coalesce(spark, sf_dir):
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    attrs = F.create_map(F.lit("Height"), F.when(k == 0, size), F.lit("levels"), F.when(k == 1, size))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(g.height_and_source(_with_keys(attrs)))).alias("h")).select("p_partkey", "h.value", "h.source")


def _with_keys(attrs):
    """The map with every known key, absent ones null, so that lookups never fail."""
    keys = F.array(*[F.lit(k) for k in (*g.METRE_KEYS, *g.LEVEL_KEYS)])
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.try_element_at(attrs, k)))


@query(f"WITH {HEIGHTS}, n AS (SELECT a.h, abs(a.h - coalesce(e.h, 0)) + CASE WHEN w.h IS NULL THEN a.h ELSE 0 END + abs(a.h - coalesce(s.h, 0)) + CASE WHEN t.h IS NULL THEN a.h ELSE 0 END AS wall FROM heights a LEFT JOIN heights e ON e.y = a.y AND e.x = a.x + 1 LEFT JOIN heights w ON w.y = a.y AND w.x = a.x - 1 LEFT JOIN heights s ON s.x = a.x AND s.y = a.y + 1 LEFT JOIN heights t ON t.x = a.x AND t.y = a.y - 1) SELECT 0::BIGINT AS site, sum(h) AS volume, count(*)::DOUBLE AS roof_area, sum(wall) AS wall_area FROM n")
def layered_volume(spark, sf_dir):
    return raster.layered_extrusion(heights(spark, sf_dir).withColumnRenamed("h", "value"))


@query("SELECT s.v::DOUBLE AS default_height_m, count(*) AS n, round(sum(CASE WHEN p_size % 2 = 0 THEN p_size ELSE s.v END)::DOUBLE, 6) AS volume, s.v = 12 AS is_primary FROM part, (VALUES (9.0), (12.0), (15.0)) s(v) GROUP BY 1, 4")
def height_scenarios(spark, sf_dir):
    scenarios = F.explode(F.array_sort(F.array_distinct(F.array(F.lit(15.0), F.lit(9.0), F.lit(12.0), F.lit(9.0))))).alias("default_height_m")
    h = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("double")).otherwise(F.col("default_height_m"))
    return table(spark, sf_dir, "part").select("p_size", scenarios).groupBy("default_height_m").agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("volume")).withColumn("is_primary", F.col("default_height_m") == 12.0)


@query("SELECT n_nationkey::BIGINT AS site, r_name AS subset, n_name AS slug, count(c_custkey) AS customers FROM nation LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2, 3")
def catalog_left_join(spark, sf_dir):
    n, r, c = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    counts = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    j = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(counts, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.select(F.col("n_nationkey").cast("long").alias("site"), F.col("r_name").alias("subset"), F.col("n_name").alias("slug"), F.coalesce("customers", F.lit(0)).alias("customers"))


@query("""SELECT o_custkey, concat_ws(';', CASE WHEN t < 100000 THEN 'low_total' END, CASE WHEN n < 2 THEN 'few_orders' END) AS fail_reasons, concat_ws(';', CASE WHEN f > 3 THEN 'many_finished' END) AS warning_reasons,
 CASE WHEN t < 100000 OR n < 2 THEN 'fail' WHEN f > 3 THEN 'warning' ELSE 'pass' END AS quality_status FROM (SELECT o_custkey, sum(o_totalprice) AS t, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY 1)""")
def audit_status(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    return atlas.audited(rows, {"low_total": F.col("t") < 100000, "few_orders": F.col("n") < 2}, {"many_finished": F.col("f") > 3}).select("o_custkey", "fail_reasons", "warning_reasons", "quality_status")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND abs(o_totalprice - 250000) <= 100000)")
def skip_compatible_anti(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    fits = atlas.compatible({"status": F.col("o_orderstatus"), "price": F.col("o_totalprice")}, {"status": "F", "price": 250000.0}, 100000.0)
    return atlas.outstanding(table(spark, sf_dir, "customer").select("c_custkey"), o, ["c_custkey"], fits)


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def flatten_summary(spark, sf_dir):
    from ..sources.files import flattened

    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("props"))
    return flattened(e, "props")


@query("SELECT n_nationkey::BIGINT AS site, CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN n_nationkey::VARCHAR END AS value FROM nation")
def alias_resolution(spark, sf_dir):
    k = F.col("n_nationkey") % 3
    flat = F.create_map(F.when(k == 0, "area.mean").otherwise("x"), F.col("n_name"), F.when(k == 1, "deep.size").otherwise("y"), F.col("n_nationkey").cast("string"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("site"), atlas.first_alias(flat, ["area.mean", "size"]).alias("value"))


@query("SELECT s_nationkey::BIGINT AS site, sum(l_quantity) FILTER (l_returnflag = 'A') AS a, sum(l_quantity) FILTER (l_returnflag = 'N') AS n, sum(l_quantity) FILTER (l_returnflag = 'R') AS r FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def phase_pivot(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("site"))
    p = table(spark, sf_dir, "lineitem").join(s, "l_suppkey").groupBy("site").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    return p.select("site", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


_RANKS = FEATURES + ", ranks AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rk FROM features WHERE value IS NOT NULL)"


@query(f"WITH {_RANKS} SELECT a.feature, b.feature AS other, round(corr(a.rk, b.rk), 6) + 0.0 AS rho, count(*) AS n FROM ranks a JOIN ranks b USING (site) GROUP BY 1, 2")
def spearman_matrix(spark, sf_dir):
    return stats.spearman(customer_features(spark, sf_dir)).select("feature", "other", "rho", "n")


_RZ = FEATURES + f", m AS (SELECT *, median(value) OVER (PARTITION BY feature) AS med, avg(value) OVER (PARTITION BY feature) AS mu, stddev_pop(value) OVER (PARTITION BY feature) AS sd FROM features WHERE value IS NOT NULL), m2 AS (SELECT *, median(abs(value - med)) OVER (PARTITION BY feature) AS mad FROM m), z AS (SELECT site, feature, CASE WHEN mad > 0 THEN {stats.MAD_SCALE} * (value - med) / mad WHEN sd > 0 THEN (value - mu) / sd ELSE 0 END AS z FROM m2)"


@query(f"WITH {_RZ} SELECT site, feature, round(abs(z), 6) AS score, round(z, 6) + 0.0 AS z FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY round(abs(z), 9) DESC, feature) AS i FROM z) WHERE i = 1")
def robust_outliers(spark, sf_dir):
    return stats.outliers(customer_features(spark, sf_dir))


@query(f"WITH {FEATURES} SELECT site, feature, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) + 0.0 AS z FROM features WHERE value IS NOT NULL WINDOW w AS (PARTITION BY feature)")
def standardize(spark, sf_dir):
    return stats.standardized(customer_features(spark, sf_dir)).select("site", "feature", "z")


@query(f"WITH {FEATURES} SELECT feature, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0 END), 6) AS missing, round(var_pop(value), 4) AS variance, round(median(value), 6) AS median, CASE WHEN avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0 END) > 0.3 THEN 'drop_missing' WHEN coalesce(var_pop(value), 0) <= 0 THEN 'drop_zero_variance' ELSE 'keep' END AS verdict FROM features GROUP BY 1")
def feature_quality(spark, sf_dir):
    return stats.feature_quality(customer_features(spark, sf_dir)).withColumn("variance", F.round("variance", 4))


@query("""WITH p AS (SELECT p_brand AS name, round(count(*) FILTER (p_size > 40) / count(*), 6) AS p FROM part GROUP BY 1), r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, name) AS raw FROM p)
 SELECT name, p, round(least(min(raw) OVER (ORDER BY p DESC, name DESC ROWS UNBOUNDED PRECEDING), 1.0), 6) AS p_adjusted FROM r""")
def bh_fdr(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.round(F.count_if(F.col("p_size") > 40) / F.count(F.lit(1)), 6).alias("p"))
    return stats.benjamini_hochberg(p)


@query("""WITH x AS (SELECT o_orderpriority AS feature, CASE WHEN o_orderstatus = 'F' THEN 'f' ELSE 'o' END AS grp, round(o_totalprice, -3) AS value FROM orders),
 r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rk FROM x),
 t AS (SELECT feature, sum(c * c * c - c) AS ties FROM (SELECT feature, value, count(*)::DOUBLE AS c FROM r GROUP BY 1, 2) GROUP BY 1),
 s AS (SELECT feature, count(*) FILTER (grp = 'f') AS n1, count(*) FILTER (grp = 'o') AS n2, sum(rk) FILTER (grp = 'f') AS r1, median(value) FILTER (grp = 'f') AS median_a, median(value) FILTER (grp = 'o') AS median_b FROM r GROUP BY 1)
 SELECT feature, n1, n2, (r1 - n1 * (n1 + 1) / 2)::DOUBLE AS u, median_a, median_b, median_a - median_b AS difference, round(greatest(abs(r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2.0) - 0.5, 0) / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS deviate FROM s JOIN t USING (feature)""")
def mann_whitney_u(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("site"), F.col("o_orderpriority").alias("feature"), F.when(F.col("o_orderstatus") == "F", "f").otherwise("o").alias("grp"), F.round("o_totalprice", -3).alias("value"))
    return stats.mann_whitney(x, "grp", "f", "o").drop("p")


@query("""WITH c AS (SELECT c_mktsegment AS a, c_nationkey % 5 AS b, count(*)::DOUBLE AS n FROM customer GROUP BY 1, 2), k AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS both_, (SELECT sum(n) FROM c) AS t, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY a)) AS sa, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY b)) AS sb)
 SELECT round((both_ - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) + 0.0 AS ari FROM k""")
def adjusted_rand(spark, sf_dir):
    return stats.adjusted_rand(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("a"), (F.col("c_nationkey") % 5).alias("b")))


_SIL = FEATURES + ", s AS (SELECT site, feature, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS z FROM features WHERE value IS NOT NULL WINDOW w AS (PARTITION BY feature)), d AS (SELECT a.site, a.site % 3 AS label, b.site % 3 AS label2, b.site AS site2, sqrt(sum((a.z - b.z) * (a.z - b.z))) AS d FROM s a JOIN s b ON a.feature = b.feature AND a.site <> b.site GROUP BY 1, 2, 3, 4), m AS (SELECT site, label, label2, avg(d) AS d FROM d GROUP BY 1, 2, 3), ab AS (SELECT site, label, coalesce(min(d) FILTER (label = label2), 0) AS a, min(d) FILTER (label <> label2) AS b FROM m GROUP BY 1, 2)"


@query(f"WITH {_SIL} SELECT site AS id, label, round((b - a) / greatest(a, b), 6) + 0.0 AS silhouette FROM ab")
def silhouette(spark, sf_dir):
    z = stats.standardized(customer_features(spark, sf_dir))
    points = z.groupBy("site").agg(F.transform(F.sort_array(F.collect_list(F.struct("feature", "z"))), lambda p: p["z"]).alias("vec"))
    return stats.silhouette(points.select(F.col("site").alias("id"), "vec", (F.col("site") % 3).alias("label")))


@query(f"WITH {FEATURES} SELECT site % 3 AS cluster, feature, round(avg(value), 4) AS mean, count(*) AS n FROM features GROUP BY 1, 2")
def cluster_profiles(spark, sf_dir):
    return customer_features(spark, sf_dir).groupBy((F.col("site") % 3).alias("cluster"), "feature").agg(F.round(F.avg("value"), 4).alias("mean"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SITES}, p AS (SELECT site, bs::BIGINT AS bs, bs / sqrt(10.0 + site) AS rho, count(DISTINCT (y // bs) * 64 + x // bs)::DOUBLE AS v FROM sites, (VALUES (1), (2), (4), (8), (16)) s(bs) GROUP BY 1, 2, 3),
 span AS (SELECT max(a) AS low, min(b) AS high FROM (SELECT min(rho) AS a, max(rho) AS b FROM p GROUP BY site)),
 q AS (SELECT site, ln(low) AS low, ln(high) AS high, ln(rho) AS x1, v AS v1, lag(ln(rho)) OVER w AS x0, lag(v) OVER w AS v0 FROM p, span WINDOW w AS (PARTITION BY site ORDER BY rho)), c AS (SELECT *, greatest(x0, low) AS a, least(x1, high) AS b FROM q WHERE x0 IS NOT NULL)
 SELECT site, round(sum(CASE WHEN b > a THEN (b - a) * (v0 + (v1 - v0) / (x1 - x0) * (a - x0) + v0 + (v1 - v0) / (x1 - x0) * (b - x0)) / 2 END) / any_value(high - low), 6) AS mean_value FROM c GROUP BY 1""")
def topology_harmonized(spark, sf_dir):
    s = sites(spark, sf_dir).select("site", "y", "x", F.explode(F.array(*[F.lit(b).cast("long") for b in (1, 2, 4, 8, 16)])).alias("bs"))
    v = s.select("site", "bs", F.expr("y div bs").alias("by"), F.expr("x div bs").alias("bx")).distinct().groupBy("site", "bs").agg(F.count(F.lit(1)).cast("double").alias("v"))
    return stats.harmonized(v.withColumn("rho", F.col("bs") / F.sqrt(F.col("site") + 10.0)), "v")


@query("SELECT n_nationkey::BIGINT AS site, (10.0::DOUBLE + n_nationkey) * 4 AS area, round(2 * (10.0::DOUBLE + n_nationkey) + 8, 6) AS perimeter, round(4 * pi() * (10.0 + n_nationkey) * 4 / pow(2 * (10.0 + n_nationkey) + 8, 2), 6) AS compactness FROM nation")
def polygon_area(spark, sf_dir):
    w = F.col("n_nationkey") + 10.0
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero, four = F.lit(0.0), F.lit(4.0)
    ring = F.array(pt(zero, zero), pt(w, zero), pt(w, four), pt(zero, four))
    area, length = g.ring_area(ring), g.ring_perimeter(ring)
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("site"), area.alias("area"), length.alias("perimeter"), g.compactness_2d(area, length).alias("compactness"))


@query("""WITH b AS (SELECT s_suppkey AS f, s_suppkey % 50 AS x0, (s_suppkey * 7) % 50 AS y0, 1 + s_suppkey % 9 AS w, 1 + s_suppkey % 5 AS h, round(s_acctbal, 2) AS value FROM supplier)
 SELECT 0::BIGINT AS site, y::BIGINT AS y, x::BIGINT AS x, max(value) AS value FROM b, range(64) r(y), range(64) c(x) WHERE x + 0.5 >= x0 AND x + 0.5 < x0 + w AND 64 - (y + 0.5) >= y0 AND 64 - (y + 0.5) < y0 + h GROUP BY 2, 3""")
def rasterize_boxes(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    x0, y0 = (F.col("s_suppkey") % 50).cast("double"), ((F.col("s_suppkey") * 7) % 50).cast("double")
    x1, y1 = x0 + 1 + F.col("s_suppkey") % 9, y0 + 1 + F.col("s_suppkey") % 5
    ring = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])
    polygons = s.select(F.lit(0).cast("long").alias("site"), F.col("s_suppkey").alias("feature"), F.round("s_acctbal", 2).alias("value"), F.array(ring).alias("rings"))
    return raster.burned(raster.rasterized(polygons, 0.0, 64.0, 64, 64, 1.0))


@query("SELECT event_id, round(6371.0088 * 2 * asin(sqrt(pow(sin(radians(user_id % 60 - value / 100) / 2), 2) + cos(radians(value / 100)) * cos(radians(user_id % 60)) * pow(sin(radians(user_id % 90) / 2), 2))), 6) AS km, 32600 + floor((user_id % 90 + 180) / 6)::INT + 1 AS srid FROM events")
def haversine_and_zone(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    lon, lat = (F.col("user_id") % 90).cast("double"), (F.col("user_id") % 60).cast("double")
    return e.select("event_id", g.haversine_km(F.lit(0.0), F.col("value") / 100, lon, lat).alias("km"), g.utm_srid(lon, lat).alias("srid"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def events_windowed(spark, sf_dir):
    return results.windowed_counts(table(spark, sf_dir, "events"), "ts", "1 hour", "event_type")


@query("SELECT user_id, event_type, count(*) AS n, round(max(value), 6) AS top FROM (SELECT DISTINCT event_id, user_id, event_type, value FROM events) GROUP BY 1, 2")
def events_dedup_incremental(spark, sf_dir):
    e = results.latest_per_key(table(spark, sf_dir, "events"), "event_id", "ts")
    return e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))


def _space(spark, sf_dir):
    """Sites, standardized features, explained shares and the scores of the retained components."""
    names, m = stats.matrix_of(stats.standardized(customer_features(spark, sf_dir)), ["orders", "price", "customers", "balance", "top_balance"])
    scores, shares, _ = stats.pca_full(m)
    return names, m, shares, scores[:, : stats.retained(shares)]


@query()
def pca_explained(spark, sf_dir):
    return stats.component_table(spark, _space(spark, sf_dir)[2])


@query()
def ward_clusters(spark, sf_dir):
    names, _, _, space = _space(spark, sf_dir)
    return spark.createDataFrame(list(zip(names, map(int, stats.ward(space, 3)), strict=True)), "site long, cluster long")


@query()
def ward_merges(spark, sf_dir):
    return spark.createDataFrame([(i + 1, *m) for i, m in enumerate(stats.ward_merges(_space(spark, sf_dir)[3]))], "step long, left long, right long, height double, size long")


@query()
def cluster_stability(spark, sf_dir):
    _, m, _, space = _space(spark, sf_dir)
    return stats.stability_summary(stats.cluster_stability(spark, m, stats.ward(space, 3), 3))


@query()
def cluster_count(spark, sf_dir):
    return stats.cluster_count(spark, _space(spark, sf_dir)[3])


@query("""WITH p AS (SELECT c_custkey, (c_custkey * 37 % 3600) / 10.0::DOUBLE - 180 AS lon, (c_custkey * 53 % 1600) / 10.0::DOUBLE - 80 AS lat FROM customer),
 c AS (SELECT 1 / 298.257223563::DOUBLE AS f), k AS (SELECT f, f * (2 - f) AS e2, f / (2 - f) AS n FROM c),
 a AS (SELECT *, 0.9996::DOUBLE * 6378137 / (1 + n) * (1 + n * n / 4 + pow(n, 4) / 64) AS r, sqrt(e2) AS e, n / 2 - 2 * n * n / 3 + 5 * pow(n, 3) / 16 AS a1, 13 * n * n / 48 - 3 * pow(n, 3) / 5 AS a2, 61 * pow(n, 3) / 240 AS a3,
  cos(radians(30)) / sqrt(1 - e2 * pow(sin(radians(30)), 2)) AS k0, sin(radians(lat)) AS s, least(floor((lon + 180) / 6), 59) AS zone FROM p, k),
 t AS (SELECT *, sinh(atanh(s) - e * atanh(e * s)) AS t, radians(lon - (zone * 6 - 177)) AS d FROM a),
 g AS (SELECT *, atan2(t, cos(d)) AS xi, atanh(sin(d) / sqrt(1 + t * t)) AS eta FROM t)
 SELECT c_custkey, round(500000 + r * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)), 3) AS x,
  round(r * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)) + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END, 3) AS y,
  round(6378137 * k0 * radians(lon), 3) AS equal_x, round(6378137 / (2 * k0) * (1 - e2) * (s / (1 - e2 * s * s) + atanh(e * s) / e), 3) + 0.0 AS equal_y FROM g""")
def projections(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_custkey") * 37 % 3600) / 10.0 - 180).alias("lon"), ((F.col("c_custkey") * 53 % 1600) / 10.0 - 80).alias("lat"))
    both = c.select("c_custkey", g.utm(F.col("lon"), F.col("lat")).alias("u"), g.equal_area(F.col("lon"), F.col("lat")).alias("e"))
    return rounded(both.select("c_custkey", "u.x", "u.y", F.col("e.x").alias("equal_x"), F.col("e.y").alias("equal_y")), 3)
