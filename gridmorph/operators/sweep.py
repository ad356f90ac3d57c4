"""Resolution sweeps: one site analysed at several cell sizes, and whether its figures are stable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite


def finite_cv(c: Column) -> Column:
    """Aggregate: the sample deviation over the mean's size of the finite values; null for fewer than two or a mean of about 0."""
    v = finite(c)
    return F.when((F.count(v) >= 2) & (F.abs(F.avg(v)) >= 1e-15), F.stddev_samp(v) / F.nullif(F.abs(F.avg(v)), F.lit(0.0)))


def quality_runs(runs: DataFrame, area_error: float = 0.05, r2: float = 0.95, points: int = 6) -> DataFrame:
    """The runs that ended well, keep the raster's area and are well fitted."""
    fine = (F.col("status") == "ok") & (finite(F.col("raster_area_error_rel")) <= area_error) & (finite(F.col("D_r2")) >= r2) & (finite(F.col("D_n_points")) >= points)
    return runs.where(F.coalesce(fine, F.lit(False)))


def stability(runs: DataFrame, area_error: float = 0.05, r2: float = 0.95, points: int = 6, dimension_cv: float = 0.05, radius_cv: float = 0.10) -> DataFrame:
    """One row for each site of runs(site, pixel_size_m, status, D_build, D_r2, D_n_points, raster_area_error_rel, spanning_radius_any_m):
    counts of runs, the variation of dimension and spanning radius over the good ones, the verdict, and the median cell size if stable."""
    totals = runs.groupBy("site").agg(F.count(F.lit(1)).alias("n_runs_total"), F.count_if(F.col("status") == "ok").alias("n_runs_ok"))
    good = quality_runs(runs, area_error, r2, points).groupBy("site").agg(
        F.count(F.lit(1)).alias("n_runs_quality"), finite_cv(F.col("D_build")).alias("D_build_cv"), finite_cv(F.col("spanning_radius_any_m")).alias("spanning_radius_cv"), F.array_sort(F.collect_list("pixel_size_m")).alias("quality_resolutions_m"), F.median("pixel_size_m").alias("middle")
    )
    out = totals.join(good, "site", "left").withColumn("n_runs_quality", F.coalesce("n_runs_quality", F.lit(0).cast("long")))
    fine = (F.col("n_runs_quality") >= 2) & (F.col("D_build_cv") <= dimension_cv) & F.coalesce(F.col("spanning_radius_cv") <= radius_cv, F.lit(True))
    out = out.withColumn("stable", F.coalesce(fine, F.lit(False)))
    return out.withColumn("recommended_pixel_size_m", F.when(F.col("stable"), F.col("middle"))).drop("middle")
