"""Box counting and generalized dimensions of sparse cell tables cells(site, y, x[, mass]).

A cell is sent to its boxes by integer division of its row and column; boxes
are made distinct, or summed, before they are counted, so each step is one
partial aggregate and one shuffle of box keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _offsets(sizes: Sequence[int]) -> Column:
    out = []
    for bs in sorted(set(sizes)):
        half = bs // 2
        shifts = [(0, 0)] if half == 0 else [(0, 0), (0, half), (half, 0), (half, half)]
        out += [F.struct(F.lit(bs).cast("long").alias("bs"), F.lit(k).cast("long").alias("k"), F.lit(sy).cast("long").alias("sy"), F.lit(sx).cast("long").alias("sx")) for k, (sy, sx) in enumerate(shifts)]
    return F.array(*out)


def offset_counts(cells: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """site, bs, k, n: occupied boxes for each size and grid origin."""
    o = cells.select("site", "y", "x", F.explode(_offsets(sizes)).alias("o"))
    boxes = o.select("site", "o.bs", "o.k", F.expr("(y + o.sy) div o.bs").alias("by"), F.expr("(x + o.sx) div o.bs").alias("bx")).distinct()
    return boxes.groupBy("site", "bs", "k").agg(F.count(F.lit(1)).alias("n"))


def box_counts(cells: DataFrame, sizes: Sequence[int], px: float = 1.0) -> DataFrame:
    """Multi-origin counts: the least is fitted; mean, sample deviation and its ratio to the mean describe the origins."""
    n = offset_counts(cells, sizes).groupBy("site", "bs").agg(
        F.min("n").alias("count_fit"), F.avg("n").alias("count_mean"), F.min("n").alias("count_min"), F.max("n").alias("count_max"),
        F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("count_std"), F.count(F.lit(1)).alias("n_grid_offsets"),
    )
    return n.withColumn("count_cv", F.when(F.col("count_mean") > 0, F.col("count_std") / F.col("count_mean"))).withColumn("scale_m", F.col("bs") * F.lit(float(px)))


def line_fit(y: Column, x: Column) -> list[Column]:
    """Aggregates of a least-squares line: slope, intercept, r2, stderr of the slope, n."""
    slope, sxx, n = F.regr_slope(y, x), F.regr_sxx(y, x), F.regr_count(y, x)
    rest = F.greatest(F.regr_syy(y, x) - slope * slope * sxx, F.lit(0.0))
    return [
        slope.alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.when(F.regr_syy(y, x) == 0, F.lit(1.0)).otherwise(F.regr_r2(y, x)).alias("r2"),
        F.when(n > 2, F.sqrt(rest / F.nullif(n - 2, F.lit(0)) / sxx)).alias("stderr"), n.alias("n_points"),
    ]


def box_dimension(counts: DataFrame) -> DataFrame:
    """One fit for each site: ln count on ln (1 / scale)."""
    fits = counts.groupBy("site").agg(*line_fit(F.ln("count_fit"), -F.ln("scale_m")), F.min("scale_m").alias("scale_min"), F.max("scale_m").alias("scale_max"), F.avg("count_cv").alias("count_cv_mean"))
    return fits.withColumnRenamed("slope", "dimension").withColumn("scale_span_decades", F.log10(F.col("scale_max") / F.col("scale_min")))


def in_range(counts: DataFrame, low: float | None, high: float | None, least: int) -> DataFrame:
    """Scales in [low, high]; a site with fewer than ``least`` of them keeps all, marked as fallback."""
    inside = F.lit(True)
    if low is not None:
        inside &= F.col("scale_m") >= low
    if high is not None:
        inside &= F.col("scale_m") <= high
    n = F.sum(inside.cast("int")).over(Window.partitionBy("site"))
    return counts.withColumn("fallback", n < least).where(inside | F.col("fallback"))


def offset_slopes(offsets: DataFrame, px: float = 1.0) -> DataFrame:
    """Slope of each grid origin that all sizes have."""
    return offsets.groupBy("site", "k").agg(*line_fit(F.ln("n"), -F.ln(F.col("bs") * px)))


def leave_one_out(counts: DataFrame) -> DataFrame:
    """Slopes without each scale in turn, from the site's sums: no self join."""
    w = Window.partitionBy("site")
    x, y = -F.ln("scale_m"), F.ln("count_fit")
    sums = counts.select("site", "bs", x.alias("x"), y.alias("y")).select(
        "site", "bs", (F.count(F.lit(1)).over(w) - 1).alias("n"), (F.sum("x").over(w) - F.col("x")).alias("sx"), (F.sum("y").over(w) - F.col("y")).alias("sy"),
        (F.sum(F.col("x") * F.col("x")).over(w) - F.col("x") * F.col("x")).alias("sxx"), (F.sum(F.col("x") * F.col("y")).over(w) - F.col("x") * F.col("y")).alias("sxy"),
    )
    return sums.select("site", "bs", ((F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))).alias("slope"))


def window_fits(counts: DataFrame, least: int = 4) -> DataFrame:
    """Fits over all contiguous runs of at least ``least`` scales with their scores, best first within the site."""
    ranked = counts.withColumn("i", F.row_number().over(Window.partitionBy("site").orderBy("scale_m")))
    starts, stops = ranked.select("site", F.col("i").alias("start")), ranked.select("site", F.col("i").alias("stop"))
    runs = starts.join(stops, "site").where(F.col("stop") - F.col("start") + 1 >= least)
    fits = runs.join(ranked, "site").where(F.col("i").between(F.col("start"), F.col("stop"))).groupBy("site", "start", "stop").agg(*line_fit(F.ln("count_fit"), -F.ln("scale_m")), (F.ln(F.max("scale_m")) - F.ln(F.min("scale_m"))).alias("span"))
    score = F.col("r2") + 0.01 * F.col("n_points") + 0.01 * F.col("span") - 0.5 * F.greatest(F.lit(0.95) - F.col("r2"), F.lit(0.0))
    return fits.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy(F.desc(F.round("score", 9)), "start", "stop")))


def box_sizes(side: Column, px: Column, min_px: int = 2, fraction: float = 0.25, points: int = 6, scale_max: float = 3200.0) -> Column:
    """Box sizes of a grid by its shorter side: min_px doubled up to a fraction of the side, on until there are ``points`` of them or the
    side is reached, and on up to the scale that all sites share."""
    sizes = F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: F.struct(i.alias("i"), (F.pow(F.lit(2.0), i) * max(1, min_px)).cast("long").alias("n")))
    widest = F.greatest(F.lit(2).cast("long"), F.floor(side * fraction))
    common = F.least(side, F.greatest(F.lit(1).cast("long"), F.floor(F.lit(float(scale_max)) / px)))
    kept = F.filter(sizes, lambda s: (s["n"] <= widest) | ((s["i"] < points) & (s["n"] <= side)) | (s["n"] <= common))
    return F.transform(kept, lambda s: s["n"])


def scaling_fit(cells: DataFrame, sizes: Sequence[int], px: float = 1.0, points: int = 6, scale_min: float | None = 50.0, scale_max: float | None = 3200.0) -> DataFrame:
    """The fitted dimension of each site with the deviations of its slopes over grid origins and over scales left out, and the method used.

    Scales lie in [scale_min, scale_max]; a site with fewer than ``points`` of
    them takes all it has. Origins count whose boxes all scales have.
    """
    offsets = offset_counts(cells, sizes)
    counts = in_range(box_counts(cells, sizes, px), scale_min, scale_max, points)
    fit = box_dimension(counts)
    used = counts.select("site", "bs", "scale_m", F.count(F.lit(1)).over(Window.partitionBy("site")).alias("scales"), "fallback")
    slopes = offsets.join(used, ["site", "bs"]).groupBy("site", "k").agg(F.regr_slope(F.ln("n"), -F.ln("scale_m")).alias("slope"), F.count(F.lit(1)).alias("n"), F.first("scales").alias("scales"))
    by_origin = slopes.where("n = scales").groupBy("site").agg(F.coalesce(F.stddev_samp("slope"), F.lit(0.0)).alias("grid_offset_std"))
    left_out = leave_one_out(counts).groupBy("site").agg(F.when(F.count(F.lit(1)) >= 4, F.stddev_samp("slope")).otherwise(0.0).alias("leave_one_out_std"))
    how = used.groupBy("site").agg(F.when(F.bool_or("fallback"), "box_counting_available_range_multi_origin_fallback").otherwise("box_counting_fixed_physical_range_multi_origin").alias("method"))
    out = fit.join(by_origin, "site", "left").join(left_out, "site", "left").join(how, "site")
    steep = F.when(F.abs("dimension") > 1e-15, F.abs("dimension"))
    out = out.withColumn("grid_offset_std", F.coalesce("grid_offset_std", F.lit(0.0)))
    return out.withColumns({"grid_offset_cv": F.col("grid_offset_std") / steep, "leave_one_out_cv": F.col("leave_one_out_std") / steep})


def integral_image(cells: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """site, y, x, total: occupied cells up to each cell of the rectangle, inclusive, by two running sums."""
    sites = cells.select("site").distinct()
    rows = sites.select("site", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_rows - 1).cast("long"))).alias("y"))
    grid = rows.select("site", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_cols - 1).cast("long"))).alias("x"))
    marked = grid.join(cells.select("site", "y", "x", F.lit(1).alias("m")).distinct(), ["site", "y", "x"], "left")
    along = F.sum(F.coalesce("m", F.lit(0))).over(Window.partitionBy("site", "y").orderBy("x"))
    return marked.select("site", "y", "x", along.alias("row")).select("site", "y", "x", F.sum("row").over(Window.partitionBy("site", "x").orderBy("y")).alias("total"))


def lacunarity_summary(curve: DataFrame, px: float = 1.0) -> DataFrame:
    """site, least, greatest and mean lacunarity, and the window where it peaks (of equals the smallest)."""
    fine = curve.where("lacunarity is not null and not isnan(lacunarity)")
    peak = F.max(F.struct("lacunarity", (-F.col("ws")).alias("back")))["back"]
    return fine.groupBy("site").agg(F.min("lacunarity").alias("min"), F.max("lacunarity").alias("max"), F.avg("lacunarity").alias("mean"), (-peak * float(px)).alias("peak_window_m"))


def moments(cells: DataFrame, sizes: Sequence[int], qs: Sequence[float], px: float = 1.0) -> DataFrame:
    """site, bs, q, value: sum of p^q over the boxes, or of p ln p at q = 1."""
    o = cells.where("mass > 0").select("site", "y", "x", "mass", F.explode(F.array(*[F.lit(s).cast("long") for s in sorted(set(sizes))])).alias("bs"))
    boxes = o.groupBy("site", "bs", F.expr("y div bs").alias("by"), F.expr("x div bs").alias("bx")).agg(F.sum("mass").alias("m"))
    p = F.col("m") / F.sum("m").over(Window.partitionBy("site", "bs"))
    shares = boxes.select("site", "bs", p.alias("p"))  # before the rows are repeated for each q
    spread = shares.select("site", "bs", "p", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"))
    value = F.when(F.col("q") == 1, F.col("p") * F.ln("p")).otherwise(F.pow("p", "q"))
    return spread.groupBy("site", "bs", "q").agg(F.sum(value).alias("value"), F.count(F.lit(1)).alias("n_positive_boxes"), F.sum("p").alias("probability_sum"), F.min("p").alias("min_positive_probability"), F.max("p").alias("max_probability")).withColumn("scale_m", F.col("bs") * F.lit(float(px)))


def spectrum(raw: DataFrame, least: int = 3, r2_least: float = 0.95) -> DataFrame:
    """Generalized dimensions D_q with their errors; tau = (q - 1) D_q."""
    response = F.when(F.col("q") == 1, F.col("value")).otherwise(F.ln("value"))
    fits = raw.groupBy("site", "q").agg(*line_fit(response, F.ln("scale_m"))).where(F.col("n_points") >= least)
    one = F.col("q") == 1
    dq = F.when(one, F.col("slope")).otherwise(F.col("slope") / F.when(one, F.lit(1.0)).otherwise(F.col("q") - 1))
    se = F.when(one, F.col("stderr")).otherwise(F.col("stderr") / F.abs(F.when(one, F.lit(1.0)).otherwise(F.col("q") - 1)))
    out = fits.select("site", "q", dq.alias("Dq"), F.when(one, F.lit(0.0)).otherwise(F.col("slope")).alias("tau"), "r2", se.alias("stderr"), F.col("stderr").alias("slope_stderr"), "n_points")
    return out.withColumn("fit_pass", F.coalesce(F.col("r2") >= r2_least, F.lit(False))).withColumn("atlas_eligible", F.col("fit_pass") & (F.col("q") >= 0))


def order_diagnostics(spec: DataFrame) -> DataFrame:
    """Whether D_q falls with q within two joint standard errors, and stays within the embedding dimension."""
    w = Window.partitionBy("site").orderBy("q")
    d = F.col("Dq") - F.lag("Dq").over(w)
    slack = 2 * F.sqrt(F.pow(F.coalesce("stderr", F.lit(0.0)), 2) + F.pow(F.coalesce(F.lag("stderr").over(w), F.lit(0.0)), 2))
    steps = spec.select("site", "q", "Dq", "stderr", d.alias("step"), (d - slack).alias("excess"))
    return steps.groupBy("site").agg(
        F.count(F.lit(1)).alias("n_q"), F.max("step").alias("max_step"), F.max("excess").alias("max_excess"),
        (F.coalesce(F.max("excess") <= 1e-12, F.lit(True)) & (F.count(F.lit(1)) >= 2)).alias("monotone"),
        F.bool_and(F.col("Dq") <= 2 + 2 * F.coalesce("stderr", F.lit(0.0)) + 1e-12).alias("embedding_pass"),
    )


def spectrum_checks(spec: DataFrame) -> DataFrame:
    """site, the order diagnostics of the eligible orders (q >= 0, well fitted) and of all well fitted ones, and whether all orders stay
    within the embedding dimension; fewer than two orders fail."""
    def diagnosed(chosen, suffix):
        d = order_diagnostics(spec.where(chosen))
        return d.select("site", *[F.col(c).alias(c + suffix) for c in ("n_q", "max_step", "max_excess", "monotone")])

    every = order_diagnostics(spec).select("site", "embedding_pass")
    out = every.join(diagnosed(F.col("atlas_eligible"), ""), "site", "left").join(diagnosed(F.col("fit_pass"), "_all_fitted"), "site", "left")
    names = {f"monotone{x}": F.coalesce(f"monotone{x}", F.lit(False)) for x in ("", "_all_fitted")} | {f"n_q{x}": F.coalesce(f"n_q{x}", F.lit(0).cast("long")) for x in ("", "_all_fitted")}
    return out.withColumns(names)


def window_masses(cells: DataFrame, sizes: Sequence[int], n_rows: int, n_cols: int) -> DataFrame:
    """site, ws, wy, wx, mass: cells in each sliding window (stride a quarter of its size) that has any."""
    both = F.explode(F.array(*[F.struct(F.lit(w).cast("long").alias("ws"), F.lit(max(1, w // 4)).cast("long").alias("st")) for w in sorted(set(sizes)) if w <= min(n_rows, n_cols)])).alias("w")
    o = cells.select("site", "y", "x", both).select("site", "y", "x", "w.ws", "w.st")

    def starts(at: str, n: int) -> Column:
        low = F.expr(f"greatest(0, ({at} - ws + st) div st)")
        high = F.least(F.expr(f"{at} div st"), F.floor((F.lit(n) - F.col("ws")) / F.col("st")))
        return F.when(F.expr(f"{at} - ws + st < 0"), F.sequence(F.lit(0).cast("long"), high)).otherwise(F.when(low <= high, F.sequence(low, high)).otherwise(F.expr("cast(array() as array<bigint>)")))

    spread = o.select("site", "ws", "x", "st", F.explode(starts("y", n_rows)).alias("wy")).select("site", "ws", "wy", F.explode(starts("x", n_cols)).alias("wx"))
    return spread.groupBy("site", "ws", "wy", "wx").agg(F.count(F.lit(1)).alias("mass"))


def lacunarity(cells: DataFrame, domain: DataFrame, sizes: Sequence[int], n_rows: int, n_cols: int, least: float = 0.95) -> DataFrame:
    """Variance over squared mean, plus one, of the masses of windows that the domain fills; empty windows count."""
    d = window_masses(domain, sizes, n_rows, n_cols).withColumnRenamed("mass", "room").where(F.col("room") >= least * F.col("ws") * F.col("ws"))
    m = window_masses(cells, sizes, n_rows, n_cols)
    all_ = d.join(m, ["site", "ws", "wy", "wx"], "left").withColumn("mass", F.coalesce("mass", F.lit(0)).cast("double"))
    out = all_.groupBy("site", "ws").agg(F.count(F.lit(1)).alias("n_windows"), F.avg("mass").alias("mean_mass"), F.var_pop("mass").alias("var_mass"), F.avg(F.col("mass") / F.col("room")).alias("mean_occupancy"))
    return out.withColumn("lacunarity", F.when(F.col("mean_mass") > 0, F.col("var_mass") / (F.col("mean_mass") * F.col("mean_mass")) + 1))
