"""Cross-site statistics over long tables features(site, feature, value) and small feature matrices."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the normal quartile that scales a median absolute deviation.
MAD_SCALE = 0.67448975


def materialised(df: DataFrame) -> DataFrame:
    """df computed once: checkpointed where the session names a folder for it, else cached."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.cache()


def ranked_values(long: DataFrame, *sums: Column) -> DataFrame:
    """feature, value, peers, rank (the average rank of the value's rows within its feature), and further aggregates of each value's rows.

    Values are dealt by range, so no task sees a whole feature: ranks run
    within a range and start where the ranges before it end.
    """
    values = long.where("value is not null").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("peers"), *sums)
    ordered = materialised(values.repartitionByRange("feature", "value").withColumn("range_", F.spark_partition_id()))
    totals = ordered.groupBy("feature", "range_").agg(F.sum("peers").alias("n_"))
    before = totals.select("feature", "range_", (F.sum("n_").over(Window.partitionBy("feature").orderBy("range_")) - F.col("n_")).alias("before_"))  # a row for each range
    upto = F.sum("peers").over(Window.partitionBy("feature", "range_").orderBy("value"))
    out = ordered.withColumn("upto_", upto).join(F.broadcast(before), ["feature", "range_"])
    return out.withColumn("rank", F.col("before_") + F.col("upto_") - (F.col("peers") - 1) / 2.0).drop("range_", "before_", "upto_")


def average_ranks(long: DataFrame) -> DataFrame:
    """The rows with their average rank within the feature; null values go."""
    return long.join(ranked_values(long).select("feature", "value", "rank"), ["feature", "value"])


def spearman(long: DataFrame) -> DataFrame:
    """Rank correlation of each pair of features with complete values, and its p-value's t statistic."""
    r = average_ranks(long)
    other = r.select("site", F.col("feature").alias("other"), F.col("rank").alias("rank2"))
    out = r.join(other, "site").groupBy("feature", "other").agg(F.corr("rank", "rank2").alias("rho"), F.count(F.lit(1)).alias("n"))
    t = F.when((F.col("n") > 3) & (F.abs("rho") < 1), F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho"))))
    return out.withColumn("t", t)


def robust_z(long: DataFrame) -> DataFrame:
    """z by median and MAD; by mean and population deviation where the MAD is 0; 0 where that is 0 too."""
    known = long.where("value is not null")
    middle = known.groupBy("feature").agg(F.median("value").alias("med"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    centred = known.join(F.broadcast(middle), "feature")  # a row for each feature
    mad = centred.groupBy("feature").agg(F.median(F.abs(F.col("value") - F.col("med"))).alias("mad"))
    z = F.when(F.col("mad") > 0, MAD_SCALE * (F.col("value") - F.col("med")) / F.nullif(F.col("mad"), F.lit(0.0))).when(F.col("sd") > 0, (F.col("value") - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0))).otherwise(0.0)
    return centred.join(F.broadcast(mad), "feature").select("site", "feature", "value", z.alias("z"))


def outliers(long: DataFrame) -> DataFrame:
    """Each site's most extreme feature (ties to the first name)."""
    w = Window.partitionBy("site").orderBy(F.desc(F.round(F.abs("z"), 9)), "feature")
    return robust_z(long).withColumn("i", F.row_number().over(w)).where("i = 1").select("site", "feature", F.abs("z").alias("score"), "z")


def standardized(long: DataFrame) -> DataFrame:
    """The rows with z by their feature's mean and population deviation, null where that is 0; null values go."""
    known = long.where("value is not null")
    own = known.groupBy("feature").agg(F.avg("value").alias("mean_"), F.stddev_pop("value").alias("sd_"))
    z = F.when(F.col("sd_") > 0, (F.col("value") - F.col("mean_")) / F.nullif(F.col("sd_"), F.lit(0.0)))
    return known.join(F.broadcast(own), "feature").withColumn("z", z).drop("mean_", "sd_")  # a row for each feature


def feature_quality(long: DataFrame, most_missing: float = 0.30) -> DataFrame:
    out = long.groupBy("feature").agg(F.avg(F.col("value").isNull().cast("double")).alias("missing"), F.var_pop("value").alias("variance"), F.median("value").alias("median"))
    verdict = F.when(F.col("missing") > most_missing, "drop_missing").when(F.coalesce("variance", F.lit(0.0)) <= 0, "drop_zero_variance").otherwise("keep")
    return out.withColumn("verdict", verdict)


def benjamini_hochberg(p: DataFrame) -> DataFrame:
    """Adjusted p-values of p(name, p); a null or NaN p is not counted and stays null.

    One window over all tests: a row for each of some dozens of features.
    """
    known = F.col("p").isNotNull() & ~F.isnan("p")
    valid = p.where(known)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    raw = valid.withColumn("raw", F.col("p") * n / F.row_number().over(Window.orderBy("p", "name")))
    back = Window.orderBy(F.desc("p"), F.desc("name")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    adjusted = raw.select("name", "p", F.least(F.min("raw").over(back), F.lit(1.0)).alias("p_adjusted"))
    return adjusted.unionByName(p.where(~known).select("name", "p", F.lit(None).cast("double").alias("p_adjusted")))


def normal_tail(z: Column) -> Column:
    """Two-sided p-value of a standard normal deviate, by the series of the distribution function; 0 beyond 8."""
    x2 = z * z
    total = F.aggregate(F.sequence(F.lit(1), F.lit(200)), F.struct(F.abs(z).alias("term"), F.abs(z).alias("sum")), lambda a, k: F.struct((a["term"] * x2 / (2 * k + 1)).alias("term"), (a["sum"] + a["term"] * x2 / (2 * k + 1)).alias("sum")))["sum"]
    return F.when(F.abs(z) > 8, 0.0).otherwise(F.greatest(1 - 2 * total * F.exp(-x2 / 2) / math.sqrt(2 * math.pi), F.lit(0.0)))


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t with a whole number of degrees of freedom, by its finite trigonometric sum."""
    angle = F.atan(F.abs(t) / F.sqrt(df))
    c2 = F.cos(angle) * F.cos(angle)
    odd = df % 2 == 1
    # terms 1, 2/3 c2, 2/3 4/5 c2^2 ... for odd df, 1, 1/2 c2, 1/2 3/4 c2^2 ... for even ones
    n = F.when(odd, (df - 1) / 2).otherwise(df / 2).cast("int")
    def step(a, k):
        term = a["term"] * c2 * F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    total = F.aggregate(F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), step)["sum"]
    total = F.when(n > 0, total).otherwise(0.0)
    within = F.when(odd, 2 / math.pi * (angle + F.sin(angle) * F.cos(angle) * total)).otherwise(F.sin(angle) * total)
    return F.greatest(1 - within, F.lit(0.0))


def spearman_p(rho: DataFrame) -> DataFrame:
    """spearman() with p: 0 on the diagonal and for perfect correlation, null below four complete pairs."""
    p = F.when(F.col("feature") == F.col("other"), 0.0).when(F.col("n") < 4, F.lit(None)).when(F.abs("rho") >= 1, 0.0).otherwise(student_p(F.col("t"), F.col("n") - 2))
    return rho.withColumn("p", p)


def imputed(long: DataFrame, most_missing: float = 0.30) -> DataFrame:
    """long(site, feature, value) of the features that feature_quality() keeps, missing values replaced by their feature's median."""
    kept = feature_quality(long, most_missing).where("verdict = 'keep'").select("feature", "median")
    return long.join(F.broadcast(kept), "feature").select("site", "feature", F.coalesce(F.when(~F.isnan("value"), F.col("value")), F.col("median")).alias("value"))  # a row for each feature


def redundancy(spark, order: list[str], rho: DataFrame, threshold: float = 0.90) -> DataFrame:
    """feature, status, redundant_with, rho for the features in candidate order: one that correlates at the threshold with one kept before is dropped.

    rho(feature, other, rho) is collected: a row for each pair of some dozens of features.
    """
    known = {(r["feature"], r["other"]): r["rho"] for r in rho.select("feature", "other", "rho").collect()}
    kept, rows = [], []
    for f in order:
        against = next((k for k in kept if known.get((f, k)) is not None and abs(known[f, k]) >= threshold), None)
        rows.append((f, "drop_redundant" if against else "keep", against or "", known[f, against] if against else None))
        if not against:
            kept.append(f)
    return spark.createDataFrame(rows, "feature string, status string, redundant_with string, spearman_rho double")


def mann_whitney(long: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """U of group a against b for each feature, with medians, the tie- and continuity-corrected normal deviate and its two-sided p."""
    x = long.where(F.col(group).isin(a, b) & F.col("value").isNotNull())
    is_a = F.col(group) == a
    r = ranked_values(x, F.count_if(is_a).alias("of_a"))
    s = r.groupBy("feature").agg(F.sum("of_a").alias("n1"), F.sum(F.col("peers") - F.col("of_a")).alias("n2"), F.sum(F.col("rank") * F.col("of_a")).alias("r1"), F.sum(F.pow("peers", F.lit(3)) - F.col("peers")).alias("ties"))
    medians = x.groupBy("feature").agg(F.median(F.when(is_a, F.col("value"))).alias("median_a"), F.median(F.when(~is_a, F.col("value"))).alias("median_b"))
    s = s.join(medians, "feature").where("n1 >= 3 and n2 >= 3")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    n = F.col("n1") + F.col("n2")
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * (n + 1 - F.col("ties") / (n * (n - 1))))
    d = F.abs(u - F.col("n1") * F.col("n2") / 2.0)
    out = s.select("feature", "n1", "n2", u.alias("u"), "median_a", "median_b", (F.col("median_a") - F.col("median_b")).alias("difference"), F.when(sd > 0, F.greatest(d - 0.5, F.lit(0.0)) / sd).alias("deviate"))
    return out.withColumn("p", normal_tail(F.col("deviate")))


def adjusted_rand(pairs: DataFrame) -> DataFrame:
    """Adjusted Rand index of two labelings pairs(a, b), from their contingency table."""
    def c2(c):
        return F.col(c) * (F.col(c) - 1) / 2.0

    cells = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    both = cells.agg(F.sum(c2("n")).alias("both"), F.sum("n").alias("total"))
    ra = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(c2("n")).alias("sa"))
    rb = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(c2("n")).alias("sb"))
    j = both.crossJoin(F.broadcast(ra)).crossJoin(F.broadcast(rb))  # one row each
    expected = F.col("sa") * F.col("sb") / (F.col("total") * (F.col("total") - 1) / 2.0)
    most = (F.col("sa") + F.col("sb")) / 2
    return j.select(F.when(most == expected, F.lit(1.0)).otherwise((F.col("both") - expected) / F.nullif(most - expected, F.lit(0.0))).alias("ari"))


def silhouette(points: DataFrame, group: Column | None = None) -> DataFrame:
    """Silhouette of each of at most MOST_SITES points(id, vec, label) a group: a singleton's own distance is 0. All pairs of a group meet."""
    points = points.withColumn("group", F.lit(0) if group is None else group)
    if not points.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_SITES).isEmpty():
        raise ValueError("too many points for all pairs")
    p2 = points.select("group", F.col("id").alias("id2"), F.col("vec").alias("vec2"), F.col("label").alias("label2"))
    d = F.sqrt(F.aggregate(F.zip_with("vec", "vec2", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    means = points.join(p2, "group").where("id <> id2").groupBy("id", "label", "label2").agg(F.avg(d).alias("d"))
    s = means.groupBy("id", "label").agg(F.coalesce(F.min(F.when(F.col("label") == F.col("label2"), F.col("d"))), F.lit(0.0)).alias("a"), F.min(F.when(F.col("label") != F.col("label2"), F.col("d"))).alias("b"))
    return s.select("id", "label", F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0).alias("silhouette"))


def cluster_count(spark, matrix: np.ndarray, most: int = 8) -> DataFrame:
    """k, mean silhouette and whether k is chosen, for Ward's clusters of 2 .. min(most, n - 1): the best mean, of equal ones the least k."""
    labelled = [(int(i), row.tolist(), k, int(c)) for k in range(2, min(most, len(matrix) - 1) + 1) for (i, row), c in zip(enumerate(matrix), ward(matrix, k), strict=True)]
    points = spark.createDataFrame(labelled, "id long, vec array<double>, k long, label long")
    own = points.select(F.struct("k", "id").alias("id"), "vec", F.struct("k", "label").alias("label"))
    score = silhouette(own, F.col("id.k")).groupBy(F.col("id.k").alias("k")).agg(F.avg("silhouette").alias("silhouette"))
    return score.withColumn("chosen", F.row_number().over(Window.orderBy(F.desc(F.round("silhouette", 12)), "k")) == 1)  # at most 7 rows


def student_tail(t: float, n: int) -> float:
    """Two-sided p-value of Student's t with n degrees of freedom, by the incomplete beta fraction."""
    x = n / (n + t * t)
    a, b = n / 2, 0.5
    if x in (0.0, 1.0):
        return float(x)

    def fraction(a, b, x):
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / (d if abs(d) > 1e-300 else 1e-300)
                c = 1 + num / c
                c = c if abs(c) > 1e-300 else 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    if x < (a + 1) / (a + b + 2):
        return front * fraction(a, b, x) / a
    return 1 - front * fraction(b, a, 1 - x) / b


def redundant(order: list[str], rho: dict[tuple[str, str], float], threshold: float = 0.90) -> list[str]:
    """Features kept in candidate order: none correlates at the threshold with one kept before."""
    kept: list[str] = []
    for f in order:
        if all(abs(rho.get((f, k), 0.0)) < threshold for k in kept):
            kept.append(f)
    return kept


def matrix_of(z: DataFrame, features: list[str]) -> tuple[list, np.ndarray]:
    """Sites in order and the matrix of their standardized features; a row for each of MOST_SITES sites at most."""
    wide = z.groupBy("site").pivot("feature", features).agg(F.first("z")).orderBy("site")
    rows = wide.limit(MOST_SITES + 1).toPandas()
    if len(rows) > MOST_SITES:
        raise ValueError("too many sites for the driver")
    return rows["site"].tolist(), rows[features].fillna(0.0).to_numpy(float)


def pca_full(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, explained shares and loadings."""
    x = matrix - matrix.mean(axis=0)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    n = min(x.shape[1], max(1, x.shape[0] - 1))
    share = s**2 / (s**2).sum() if (s**2).sum() > 0 else np.zeros_like(s)
    return (u * s)[:, :n], share[:n], vt[:n].T


def component_table(spark, shares: np.ndarray) -> DataFrame:
    """component, explained, cumulative, and whether clusters are sought in it."""
    k = retained(shares)
    return spark.createDataFrame([(i + 1, float(s), float(c), i < k) for i, (s, c) in enumerate(zip(shares, np.cumsum(shares), strict=True))], "component long, explained double, cumulative double, retained boolean")


def stability_summary(rounds: DataFrame) -> DataFrame:
    return rounds.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.avg("ari").alias("mean"), F.median("ari").alias("median"), F.min("ari").alias("least"), F.max("ari").alias("most"))


def pca(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and explained shares of the standardized columns; sites are few, so this runs on the driver."""
    x = matrix - matrix.mean(axis=0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    n = min(x.shape[1], max(1, x.shape[0] - 1))
    share = s**2 / (s**2).sum() if (s**2).sum() > 0 else np.zeros_like(s)
    return (u * s)[:, :n], share[:n]


def retained(shares, least: float = 0.90) -> int:
    """Components kept for clustering: the first whose shares sum up to ``least``, two at least, all at most."""
    total = np.cumsum(shares)
    return int(max(2, min(np.searchsorted(total, least) + 1, len(total))))


#: Sites that the driver clusters: the distance matrix has their square.
MOST_SITES = 5_000


def ward_merges(points: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Ward's merges as (left, right, height, size), clusters numbered 0..n-1 for points and n + step for merges."""
    n = len(points)
    if n > MOST_SITES:
        raise ValueError(f"{n} sites are too many to cluster on the driver")
    d = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    size, name, out = np.ones(n), np.arange(n), []
    for step in range(n - 1):
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        total = size[i] + size[j] + size
        row = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / total
        row[~np.isfinite(row)] = np.inf
        out.append((int(min(name[i], name[j])), int(max(name[i], name[j])), float(np.sqrt(d[i, j])), int(size[i] + size[j])))
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        name[i] = n + step
    return out


def ward(points: np.ndarray, k: int) -> np.ndarray:
    """Labels 1..k of Ward's clustering by the Lance-Williams recurrence (hundreds of sites, on the driver)."""
    n = len(points)
    if n > MOST_SITES:
        raise ValueError(f"{n} sites are too many to cluster on the driver")
    d = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(n), np.arange(n)
    for _ in range(max(0, n - k)):
        i, j = np.unravel_index(np.argmin(d), d.shape)
        i, j = min(i, j), max(i, j)
        total = size[i] + size[j] + size
        row = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / total
        row[~np.isfinite(row)] = np.inf
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1] + 1


def cluster_stability(spark, matrix: np.ndarray, labels: np.ndarray, k: int, rounds: int = 100, seed: int = 42) -> DataFrame:
    """Adjusted Rand index of Ward's clusters under noise and feature subsampling; each round is a row, run in parallel."""
    def run(batches):
        for b in batches:
            out = []
            for i in b["i"]:
                rng = np.random.default_rng([seed, int(i)])
                if i % 2 == 0:
                    mode, x = "noise", matrix + rng.normal(0, 0.05, matrix.shape)
                else:
                    keep = rng.choice(matrix.shape[1], max(2, math.ceil(0.8 * matrix.shape[1])), replace=False)
                    mode, x = "features", matrix[:, keep]
                table = pd.crosstab(labels, ward(x, k)).to_numpy(float)
                c2 = lambda v: v * (v - 1) / 2
                both, sa, sb = c2(table).sum(), c2(table.sum(axis=1)).sum(), c2(table.sum(axis=0)).sum()
                expected = sa * sb / c2(table.sum())
                out.append((int(i), mode, 1.0 if (sa + sb) / 2 == expected else float((both - expected) / ((sa + sb) / 2 - expected))))
            yield pd.DataFrame(out, columns=["i", "mode", "ari"])

    return spark.range(rounds).withColumnRenamed("id", "i").mapInPandas(run, "i long, mode string, ari double")


def harmonized(profiles: DataFrame, value: str) -> DataFrame:
    """Mean of a profile over ln(rho) on the interval that all sites cover; profiles(site, rho, <value>), rho > 0."""
    span = profiles.groupBy("site").agg(F.min("rho").alias("a"), F.max("rho").alias("b")).agg(F.max("a").alias("low"), F.min("b").alias("high"))
    w = Window.partitionBy("site").orderBy("rho")
    p = profiles.crossJoin(F.broadcast(span))  # one row
    x, v = F.ln("rho"), F.col(value).cast("double")
    p = p.select("site", "low", "high", x.alias("x1"), v.alias("v1"), F.lag(x).over(w).alias("x0"), F.lag(v).over(w).alias("v0"))
    a, b = F.greatest("x0", F.ln("low")), F.least("x1", F.ln("high"))
    slope = (F.col("v1") - F.col("v0")) / (F.col("x1") - F.col("x0"))
    at = lambda z: F.col("v0") + slope * (z - F.col("x0"))
    part = F.when(b > a, (b - a) * (at(a) + at(b)) / 2)
    return p.groupBy("site").agg((F.sum(part) / F.nullif(F.ln(F.first("high")) - F.ln(F.first("low")), F.lit(0.0))).alias("mean_value"))
