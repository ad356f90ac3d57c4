"""Dilation profiles: distances, areas, perimeters, components and holes of cell tables.

Distances come from two passes, along columns and then along rows, and follow
the cells within reach. Components are labelled on runs of cells, never on
cells; what is asked of components (sizes, sides touched, holes) are plain
aggregates over the labelled runs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distances(cells: DataFrame, reach: int, n_rows: int, n_cols: int) -> DataFrame:
    """site, y, x, d2: squared Euclidean distance to the nearest occupied cell, where it is at most reach.

    First pass: each cell of a column takes the rows that lie nearer to it than
    to its neighbours in the column, so every grid cell gets one row. Second
    pass: these spread along their row as far as they can still be within reach.
    """
    w = Window.partitionBy("site", "x").orderBy("y")
    up, down = F.lag("y").over(w), F.lead("y").over(w)
    low = F.greatest(F.lit(0).cast("long"), F.col("y") - reach, F.coalesce(F.floor((up + F.col("y")) / 2) + 1, F.lit(0).cast("long")))
    high = F.least(F.lit(n_rows - 1).cast("long"), F.col("y") + reach, F.coalesce(F.floor((F.col("y") + down) / 2), F.lit(n_rows - 1).cast("long")))
    column = cells.select("site", "y", "x").distinct().select("site", "x", F.col("y").alias("own"), low.alias("low"), high.alias("high")).where("low <= high")
    first = column.select("site", "x", "own", F.explode(F.sequence("low", "high")).alias("y")).withColumn("dy", F.col("y") - F.col("own"))
    wide = F.floor(F.sqrt(F.lit(float(reach * reach)) - F.col("dy") * F.col("dy")))
    row = first.select("site", "y", "x", "dy", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("x") - wide), F.least(F.lit(n_cols - 1).cast("long"), F.col("x") + wide))).alias("to"))
    d2 = F.col("dy") * F.col("dy") + (F.col("to") - F.col("x")) * (F.col("to") - F.col("x"))
    return row.groupBy("site", "y", F.col("to").alias("x")).agg(F.min(d2).alias("d2"))


def dilated(near: DataFrame, radii: list[int]) -> DataFrame:
    """site, r, y, x: the mask at each radius."""
    return near.select("site", "y", "x", "d2", F.explode(F.array(*[F.lit(r).cast("long") for r in radii])).alias("r")).where("d2 <= r * r").select("site", "r", "y", "x")


def default_radii(side: int, fraction: float = 0.25, n: int = 18) -> list[int]:
    most = max(1, int(side * fraction))
    if most <= 1:
        return [0, 1]
    return [0, *sorted({int(np.round(v)) for v in np.geomspace(1, most, n)})]


def pair_counts(masks: DataFrame) -> DataFrame:
    """site, r, area and adjacent pairs along rows, columns and both diagonals: windows over four orders, no join."""
    out = masks
    for name, line, along in (("eh", F.col("y"), "x"), ("ev", F.col("x"), "y"), ("ed", F.col("y") - F.col("x"), "x"), ("ea", F.col("y") + F.col("x"), "x")):
        w = Window.partitionBy("site", "r", line).orderBy(along)
        out = out.withColumn(name, (F.lead(along).over(w) == F.col(along) + 1).cast("long"))
    return out.groupBy("site", "r").agg(F.count(F.lit(1)).alias("area"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("eh", "ev", "ed", "ea")])


def crofton(pairs: DataFrame, px: float = 1.0) -> DataFrame:
    """Perimeter by the four-direction Cauchy-Crofton sum."""
    a = 2 * F.col("area")
    p = F.lit(math.pi / 4 * px) * ((a - F.col("eh") - F.col("ev")) + (a - F.col("ed") - F.col("ea")) / math.sqrt(2))
    return pairs.withColumn("perimeter_m", p).withColumn("area_m2", F.col("area") * F.lit(float(px * px)))


def runs(masks: DataFrame) -> DataFrame:
    """site, r, y, x0, x1: maximal runs of consecutive cells in a row."""
    island = F.col("x") - F.row_number().over(Window.partitionBy("site", "r", "y").orderBy("x"))
    return masks.withColumn("g", island).groupBy("site", "r", "y", "g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("g")


def _labels(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, diagonal: int) -> np.ndarray:
    """Component number of each run, runs sorted by (y, x0); runs touch if they overlap in adjacent rows."""
    n = len(y)
    if not n:
        return np.zeros(0, np.int64)
    width = int(max(x1.max(), x0.max())) + 4
    start, stop = y * width + x0, y * width + x1
    a = np.searchsorted(stop, (y + 1) * width + x0 - diagonal, "left")  # first run of the next row that reaches back far enough
    b = np.searchsorted(start, (y + 1) * width + x1 + diagonal, "right")
    b = np.minimum(b, np.searchsorted(y, y + 1, "right"))
    a = np.maximum(a, np.searchsorted(y, y + 1, "left"))
    count = np.maximum(b - a, 0)
    s = np.repeat(np.arange(n), count)
    t = np.repeat(a, count) + np.arange(len(s)) - np.repeat(np.cumsum(count) - count, count)
    label = np.arange(n)
    while True:
        low = np.minimum(label[s], label[t])
        new = label.copy()
        np.minimum.at(new, label[s], low)
        np.minimum.at(new, label[t], low)
        new = np.minimum(new, new[new])
        new = new[new]
        if (new == label).all():
            return label
        label = new


#: Runs that one mask may have: what a labelling task holds.
MOST_RUNS = 20_000_000


def labelled_runs(masks: DataFrame, connectivity: int = 1) -> DataFrame:
    """site, r, y, x0, x1, component: the runs of each mask with the number of their component's first run in raster order."""
    return _labelled(runs(masks), connectivity)


def _labelled(found: DataFrame, connectivity: int) -> DataFrame:
    """A mask's runs are one group, of three numbers a run; a mask with more than MOST_RUNS is refused."""

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MOST_RUNS:
            raise ValueError(f"a mask of {len(pdf)} runs is too large for one task; coarsen it first")
        pdf = pdf.sort_values(["y", "x0"])
        y, x0, x1 = (pdf[c].to_numpy(np.int64) for c in ("y", "x0", "x1"))
        return pdf.assign(component=_labels(y, x0, x1, 0 if connectivity == 1 else 1))

    return found.groupBy("site", "r").applyInPandas(label, "site long, r long, y long, x0 long, x1 long, component long")


def dual_connectivity(connectivity: int) -> int:
    """The background's connectivity: 1 (four neighbours) and 2 (eight) go together."""
    if connectivity not in (1, 2):
        raise ValueError("connectivity must be 1 or 2")
    return 3 - connectivity


def domain_boundary(domain: DataFrame) -> DataFrame:
    """site, y, x: the domain's cells that lack a neighbour on one of their four sides."""
    out = domain.select("site", "y", "x")
    for line, along in (("y", "x"), ("x", "y")):
        w = Window.partitionBy("site", line).orderBy(along)
        both = (F.lag(along).over(w) == F.col(along) - 1) & (F.lead(along).over(w) == F.col(along) + 1)
        out = out.withColumn(f"inner_{along}", F.coalesce(both, F.lit(False)))
    return out.where("not (inner_x and inner_y)").select("site", "y", "x")


def domain_components(domain: DataFrame) -> DataFrame:
    """site, y, x0, x1, main: the domain's runs and whether they belong to its largest 4-connected component (of equals the first)."""
    labelled = labelled_runs(domain.select("site", F.lit(0).cast("long").alias("r"), "y", "x")).drop("r")
    size = F.sum(F.col("x1") - F.col("x0") + 1)
    sizes = labelled.groupBy("site", "component").agg(size.alias("n"))
    first = Window.partitionBy("site").orderBy(F.desc("n"), "component")
    main = sizes.withColumn("place", F.row_number().over(first)).where("place = 1").select("site", F.col("component").alias("main_"))
    return labelled.join(main, "site").withColumn("main", F.col("component") == F.col("main_")).drop("main_")


def domain_summary(components: DataFrame, px: float = 1.0) -> DataFrame:
    """One row for each site of domain_components(): area, components, share of the largest, and the extremes of the whole and of the largest."""
    size = F.col("x1") - F.col("x0") + 1
    sides = []
    for name, condition in (("bbox", F.lit(True)), ("main", F.col("main"))):
        for side, fold, c in (("left", F.min, "x0"), ("right", F.max, "x1"), ("top", F.min, "y"), ("bottom", F.max, "y")):
            sides.append(fold(F.when(condition, F.col(c))).alias(f"{name}_{side}"))
    out = components.groupBy("site").agg(F.sum(size).alias("domain_px"), F.count_distinct("component").alias("domain_component_count"), F.sum(F.when(F.col("main"), size)).alias("main_px"), *sides)
    return out.withColumns({"domain_area_m2": F.col("domain_px") * float(px * px), "largest_domain_component_fraction": F.col("main_px") / F.col("domain_px")})


def domain_profile(masks: DataFrame, domain: DataFrame, radii: list[int], px: float = 1.0, connectivity: int = 1, band: int = 1) -> DataFrame:
    """The profile of masks(site, r, y, x) inside an irregular domain(site, y, x): a row for each site and radius.

    Holes are background components of the domain, by the dual connectivity,
    that hold none of its boundary cells. Components span if they touch both
    opposite bands, of the domain's bounding box and, apart from that, of its
    largest component. A radius without cells has zeros.
    """
    inside = masks.join(domain.select("site", "y", "x"), ["site", "y", "x"], "left_semi").select("site", "r", "y", "x")
    parts = domain_components(domain)
    extremes = domain_summary(parts, px)
    at = F.explode(F.array(*[F.lit(int(r)).cast("long") for r in sorted(set(radii))])).alias("r")
    every = extremes.select("*", at)

    runs_ = labelled_runs(inside, connectivity).join(parts.select("site", "y", F.col("x0").alias("a"), F.col("x1").alias("b"), "main"), ["site", "y"]).where("x0 between a and b").drop("a", "b")
    touching = {}
    for name in ("bbox", "main"):
        own = F.col("main") if name == "main" else F.lit(True)
        touching[f"{name}_l"] = own & (F.col("x0") <= F.col(f"{name}_left") + band - 1)
        touching[f"{name}_r"] = own & (F.col("x1") >= F.col(f"{name}_right") - band + 1)
        touching[f"{name}_t"] = own & (F.col("y") <= F.col(f"{name}_top") + band - 1)
        touching[f"{name}_b"] = own & (F.col("y") >= F.col(f"{name}_bottom") - band + 1)
    sided = runs_.join(extremes, "site").groupBy("site", "r", "component").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n"), *[F.bool_or(c).alias(k) for k, c in touching.items()])
    spans = [F.count_if(F.col(f"{n}_{a}") & F.col(f"{n}_{b}")).alias(k) for k, n, a, b in (("beta0_lr", "bbox", "l", "r"), ("beta0_tb", "bbox", "t", "b"), ("beta0_lr_main_component", "main", "l", "r"), ("beta0_tb_main_component", "main", "t", "b"))]
    front = sided.groupBy("site", "r").agg(F.count(F.lit(1)).alias("beta0"), F.sum("n").alias("area_px"), F.max("n").alias("largest_component_px"), *spans)

    edge = domain_boundary(domain).withColumn("edge", F.lit(True))
    outside = domain.select("site", "y", "x", at).join(inside, ["site", "r", "y", "x"], "left_anti")
    background = labelled_runs(outside, dual_connectivity(connectivity))
    holds = background.join(edge, ["site", "y"]).where("x between x0 and x1").select("site", "r", "component").distinct()
    holes = background.select("site", "r", "component").distinct().join(holds, ["site", "r", "component"], "left_anti").groupBy("site", "r").agg(F.count(F.lit(1)).alias("beta1"))

    lengths = crofton(pair_counts(inside), px).select("site", "r", "perimeter_m")
    out = every.join(front, ["site", "r"], "left").join(holes, ["site", "r"], "left").join(lengths, ["site", "r"], "left")
    counts = ["beta0", "beta1", "area_px", "largest_component_px", "beta0_lr", "beta0_tb", "beta0_lr_main_component", "beta0_tb_main_component"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in counts} | {"perimeter_m": F.coalesce("perimeter_m", F.lit(0.0))})
    # a mask without cells has no holes, whatever the domain's shape
    out = out.withColumn("beta1", F.when(F.col("area_px") > 0, F.col("beta1")).otherwise(F.lit(0).cast("long")))
    initial = F.greatest(F.first_value("beta0").over(Window.partitionBy("site").orderBy("r")), F.lit(1).cast("long"))
    length = F.sqrt("domain_area_m2")
    new = {
        "radius_m": F.col("r") * float(px), "radius_relative_to_characteristic_length": F.col("r") * float(px) / length, "area_m2": F.col("area_px") * float(px * px), "chi": F.col("beta0") - F.col("beta1"),
        "giant_fraction": F.when(F.col("area_px") > 0, F.col("largest_component_px") / F.col("area_px")), "spans_lr": F.col("beta0_lr") > 0, "spans_tb": F.col("beta0_tb") > 0, "spans_lr_main_component": F.col("beta0_lr_main_component") > 0,
        "spans_tb_main_component": F.col("beta0_tb_main_component") > 0, "beta0_per_initial_component": F.col("beta0") / initial, "beta1_per_initial_component": F.col("beta1") / initial, "perimeter_per_characteristic_length": F.col("perimeter_m") / length,
    }
    return out.withColumns(new).drop(*[f"{n}_{s}" for n in ("bbox", "main") for s in ("left", "right", "top", "bottom")])


def domain_topology(cells: DataFrame, domain: DataFrame, radii: list[int], n_rows: int, n_cols: int, px: float = 1.0, connectivity: int = 1) -> DataFrame:
    """domain_profile() of the cells inside the domain, dilated by each radius."""
    inside = cells.join(domain.select("site", "y", "x"), ["site", "y", "x"], "left_semi")
    return domain_profile(dilated(distances(inside, max(radii), n_rows, n_cols), sorted(set(radii))), domain, radii, px, connectivity)


def component_profile(masks: DataFrame, n_rows: int, n_cols: int, connectivity: int = 1) -> DataFrame:
    """beta0, beta1, chi, the largest component and spanning components of each mask on a full rectangle.

    The foreground is labelled with the connectivity, the background with its
    dual; background components that touch the border are no holes.
    """
    size = F.col("x1") - F.col("x0") + 1
    sided = labelled_runs(masks, connectivity).groupBy("site", "r", "component").agg(
        F.sum(size).alias("n"), F.bool_or(F.col("x0") == 0).alias("l"), F.bool_or(F.col("x1") == n_cols - 1).alias("e"), F.bool_or(F.col("y") == 0).alias("t"), F.bool_or(F.col("y") == n_rows - 1).alias("b")
    )
    front = sided.groupBy("site", "r").agg(F.count(F.lit(1)).alias("beta0"), F.sum("n").alias("area"), F.max("n").alias("largest"), F.count_if(F.col("l") & F.col("e")).alias("spans_lr"), F.count_if(F.col("t") & F.col("b")).alias("spans_tb"))
    # the gaps between runs, and the rows without any, are the background's runs
    rows = front.select("site", "r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_rows - 1).cast("long"))).alias("y"))
    w = Window.partitionBy("site", "r", "y").orderBy("x0")
    found = runs(masks)
    before = found.select("site", "r", "y", (F.coalesce(F.lag("x1").over(w), F.lit(-1).cast("long")) + 1).alias("x0"), (F.col("x0") - 1).alias("x1"))
    after = rows.join(found.groupBy("site", "r", "y").agg(F.max("x1").alias("end")), ["site", "r", "y"], "left").select("site", "r", "y", (F.coalesce("end", F.lit(-1).cast("long")) + 1).alias("x0"), F.lit(n_cols - 1).cast("long").alias("x1"))
    gaps = before.unionByName(after).where("x0 <= x1")
    labelled = _labelled(gaps, dual_connectivity(connectivity))
    open_ = F.bool_or((F.col("y") == 0) | (F.col("y") == n_rows - 1) | (F.col("x0") == 0) | (F.col("x1") == n_cols - 1))
    holes = labelled.groupBy("site", "r", "component").agg(open_.alias("open")).groupBy("site", "r").agg(F.count_if(~F.col("open")).alias("beta1"))
    out = front.join(holes, ["site", "r"], "left").withColumn("beta1", F.coalesce("beta1", F.lit(0).cast("long")))
    return out.select("site", "r", "beta0", "beta1", (F.col("beta0") - F.col("beta1")).alias("chi"), "area", "largest", "spans_lr", "spans_tb", (F.col("largest") / F.col("area")).alias("giant_fraction"))


def component_sizes(masks: DataFrame, connectivity: int = 1) -> DataFrame:
    """site, r, component, n: sizes of the components."""
    return labelled_runs(masks, connectivity).groupBy("site", "r", "component").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n"))


def profile_summary(profile: DataFrame, giant: float = 0.5) -> DataFrame:
    """First radii, extremes, the zero crossing of chi and integrals over ln r of a profile with r, beta0, beta1, chi."""
    w = Window.partitionBy("site").orderBy("r")
    r, chi = F.col("r").cast("double"), F.col("chi").cast("double")
    p = profile.select("*", F.lag(chi).over(w).alias("chi0"), F.lag(r).over(w).alias("r0"), *[F.lag(F.col(c).cast("double")).over(w).alias(f"{c}0_") for c in ("beta0", "beta1")])
    crossing = F.when(F.col("chi0") * chi < 0, F.col("r0") + (r - F.col("r0")) * F.col("chi0") / (F.col("chi0") - chi))
    step = F.when(F.col("r0") > 0, F.ln(r) - F.ln("r0"))
    return p.groupBy("site").agg(
        F.min(F.when(F.col("giant_fraction") >= giant, r)).alias("giant_radius"), F.min(F.when((F.col("spans_lr") > 0) | (F.col("spans_tb") > 0), r)).alias("spanning_radius"),
        F.coalesce(F.min(F.when(chi == 0, r)), F.min(crossing)).alias("chi_zero"), F.min("chi").alias("chi_min"), F.max("beta1").alias("beta1_max"),
        F.sum(step * (F.col("beta0") + F.col("beta00_")) / 2).alias("beta0_integral"), F.sum(step * (F.col("beta1") + F.col("beta10_")) / 2).alias("beta1_integral"),
    )


def domain_profile_summary(profile: DataFrame, giant: float = 0.5, connectivity: int = 1) -> DataFrame:
    """One row for each site of domain_profile(): first radii, extremes, the zero crossing of chi, integrals over ln r and their norms."""
    w = Window.partitionBy("site").orderBy("r")
    m, chi = F.col("radius_m"), F.col("chi").cast("double")
    series = {"archipelago_index": "beta0", "void_index": "beta1", "boundary_complexity_index": "perimeter_m"}
    p = profile.select("*", F.lag("chi").over(w).cast("double").alias("chi_"), F.lag("radius_m").over(w).alias("m_"), *[F.lag(c).over(w).cast("double").alias(f"{c}_") for c in series.values()])
    crossing = F.when(F.signum("chi_") != F.signum(chi), F.struct(F.col("r"), (F.col("m_") - F.col("chi_") * (m - F.col("m_")) / F.nullif(chi - F.col("chi_"), F.lit(0.0))).alias("m")))
    step = F.when(F.col("m_") > 0, F.ln(m) - F.ln(F.nullif(F.col("m_"), F.lit(0.0))))
    where = lambda c: F.min(F.when(c, m))
    initial = lambda c: F.min_by(c, "r")
    positive = F.when(m > 0, m)
    out = p.groupBy("site").agg(
        where(F.col("giant_fraction") >= giant).alias("giant_component_radius_m"), where(F.col("spans_lr")).alias("spanning_radius_lr_m"), where(F.col("spans_tb")).alias("spanning_radius_tb_m"),
        where(F.col("spans_lr_main_component")).alias("spanning_radius_lr_main_component_m"), where(F.col("spans_tb_main_component")).alias("spanning_radius_tb_main_component_m"),
        F.first("domain_component_count").alias("domain_component_count"), F.first("largest_domain_component_fraction").alias("largest_domain_component_fraction"),
        *[initial(c).alias(f"{c}_at_zero") for c in ("beta0", "beta1", "beta0_lr", "beta0_tb", "beta0_lr_main_component", "beta0_tb_main_component")],
        *[f(c).alias(f"{c}_{n}") for c in ("beta0", "beta1", "chi") for n, f in (("min", F.min), ("max", F.max))],
        # of equal peaks the first radius
        F.max(F.struct("beta1", (-F.col("r")).alias("back"), m.alias("m")))["m"].alias("beta1_peak_radius_m"),
        F.coalesce(where(chi == 0), F.min(crossing)["m"]).alias("chi_zero_crossing_radius_m"),
        *[F.sum(step * (F.col(c) + F.col(f"{c}_")) / 2).alias(k) for k, c in series.items()],
        F.sqrt(F.first("domain_area_m2")).alias("characteristic_length_m"), F.min(positive).alias("topology_radius_min_positive_m"), F.max(positive).alias("topology_radius_max_m"),
    )
    main = F.col("domain_component_count") > 1
    out = out.withColumns({
        "n_components": F.col("beta0_at_zero"), "log_radius_span": F.when(F.col("topology_radius_max_m") > F.col("topology_radius_min_positive_m"), F.ln(F.col("topology_radius_max_m") / F.col("topology_radius_min_positive_m"))),
        "spanning_radius_any_m": F.least("spanning_radius_lr_m", "spanning_radius_tb_m"), "spanning_radius_any_main_component_m": F.least("spanning_radius_lr_main_component_m", "spanning_radius_tb_main_component_m"),
        "spanning_radius_lr_recommended_m": F.when(main, F.col("spanning_radius_lr_main_component_m")).otherwise(F.col("spanning_radius_lr_m")),
        "spanning_radius_tb_recommended_m": F.when(main, F.col("spanning_radius_tb_main_component_m")).otherwise(F.col("spanning_radius_tb_m")),
        "spanning_reference_recommended": F.when(main, "largest_component").otherwise("bbox"), "full_domain_spanning_interpretable": ~main, "giant_threshold": F.lit(float(giant)),
        "normalized_indices_radius_interval_comparable": F.lit(False), "foreground_connectivity": F.lit(connectivity), "background_connectivity": F.lit(dual_connectivity(connectivity)),
    })
    out = out.withColumn("spanning_radius_any_recommended_m", F.least("spanning_radius_lr_recommended_m", "spanning_radius_tb_recommended_m"))
    out = out.withColumns({f"{k}_mean": F.col(k) / F.nullif(F.col("log_radius_span"), F.lit(0.0)) for k in series})
    pieces = F.nullif(F.col("n_components").cast("double"), F.lit(0.0))
    return out.withColumns({
        "archipelago_index_per_component": F.col("archipelago_index_mean") / pieces, "void_index_per_component": F.col("void_index_mean") / pieces,
        "boundary_index_per_characteristic_length": F.col("boundary_complexity_index_mean") / F.nullif(F.col("characteristic_length_m"), F.lit(0.0)),
    })
