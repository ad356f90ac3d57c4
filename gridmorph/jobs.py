"""Batch jobs over a catalog: modes, plans of work, results, audit, atlas statistics and reports."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import site
from .functions.scalars import joined_path
from .operators import atlas, presentation, stats, summary
from .sources import files

#: The features that the atlas compares.
MORPHOLOGY = (
    "D_build", "lacunarity_mean", "compactness_boundary", "foreground_fraction", "spanning_radius_lr_norm", "spanning_radius_tb_norm", "giant_component_radius_norm", "beta0_density_km2", "beta1_density_km2",
    "archipelago_index_harmonized", "void_index_harmonized", "boundary_complexity_harmonized", "Dq_1", "multifractal_width",
)
TRANSPORT = tuple(f"{phase}_{figure}" for phase in ("open_space", "buildings") for figure in ("relative_conductance_lr", "relative_conductance_tb", "transport_anisotropy"))

#: What each mode switches on.
MODES = {"quick": {}, "topology": {"topology": True}, "sweep": {"topology": True}, "final": {"topology": True, "multifractal": True, "transport": True}}


@dataclass(frozen=True)
class Batch:
    """One batch: which sites, where, how."""

    catalog: str
    data_root: str
    results_root: str
    mode: str = "final"
    subset: str = "all"
    slugs: tuple[str, ...] = ()
    start: int = 0
    limit: int | None = None
    resolutions: tuple[float, ...] = (10.0, 20.0, 50.0)
    skip_compatible: bool = True
    go_on: bool = True


#: The batches that are run by name.
PRESETS = {
    "quick_100": {"mode": "quick", "limit": 100}, "quick_200": {"mode": "quick"}, "sweep_100": {"mode": "sweep", "limit": 100}, "sweep_200": {"mode": "sweep"}, "final_50m": {"mode": "final"},
    "final_25m": {"mode": "final"}, "moscow": {"mode": "final", "slugs": ("moscow",)},
}
PRESET_PIXELS = {"quick_100": 50.0, "quick_200": 50.0, "final_50m": 50.0}


def configured(base: site.AnalysisConfig, mode: str) -> site.AnalysisConfig:
    """The configuration with what the mode switches on."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    return replace(base, **MODES[mode])


def method_of(cfg: site.AnalysisConfig, batch: Batch) -> summary.Method:
    shared = {k: getattr(cfg, k) for k in summary.Method.__dataclass_fields__ if hasattr(cfg, k)}
    return summary.Method(mode=batch.mode, resolutions=batch.resolutions, **shared)


def planned(spark: SparkSession, batch: Batch, cfg: site.AnalysisConfig) -> DataFrame:
    """The selected sites with their paths and what is to be done: missing_data, skip or run."""
    chosen = files.selected(files.read_catalog(spark, batch.catalog), batch.subset, list(batch.slugs), batch.start, batch.limit)
    at = lambda root, *more: joined_path(F.lit(root.rstrip("/")), *more)
    own = chosen.withColumns({
        "buildings": at(batch.data_root, F.col("subset"), F.col("slug"), F.lit("buildings.geojson")), "boundary": at(batch.data_root, F.col("subset"), F.col("slug"), F.lit("boundary.geojson")),
        "output": at(batch.results_root, F.lit(batch.mode), F.col("subset"), F.col("slug")),
    })
    there = files.nonempty(spark, batch.data_root, "buildings.geojson").join(files.nonempty(spark, batch.data_root, "boundary.geojson"), ["subset", "slug"])
    out = own.join(there.withColumn("data", F.lit(True)), ["subset", "slug"], "left")
    done = spark.createDataFrame([], "subset string, slug string, done boolean")
    if batch.skip_compatible and files.path_exists(spark, f"{batch.results_root.rstrip('/')}/{batch.mode}"):
        docs = files.read_summaries(spark, batch.results_root, summary.SCHEMA, mode=batch.mode)
        done = docs.where(summary.compatible_result(F.col("doc"), method_of(cfg, batch))).select("subset", "slug", F.lit(True).alias("done"))
    out = out.join(done, ["subset", "slug"], "left")
    action = F.when(F.col("data").isNull(), "missing_data").when(F.col("done"), "skip").otherwise("run")
    return out.withColumn("action", action).drop("data", "done").orderBy("idx")


def run(spark: SparkSession, batch: Batch, base: site.AnalysisConfig | None = None) -> DataFrame:
    """Runs the batch and gives its manifest: a row for each site with what was done, and the error's last 2000 characters."""
    cfg = configured(base or site.AnalysisConfig(), batch.mode)
    rows = []
    for r in planned(spark, batch, cfg).collect():  # a row for each site of the catalog
        own = replace(cfg, city_name=r["name"], buildings_path=r["buildings"], boundary_path=r["boundary"], output_dir=r["output"])
        status, error = r["action"], None
        if status == "run":
            try:
                if batch.mode == "sweep":
                    runs, verdict = site.resolution_sweep(spark, *site.load_inputs(spark, own), own, batch.resolutions, batch.go_on)
                    files.write_csv(runs, f"{r['output']}/resolution_sweep_summary")
                    files.write_document(verdict, f"{r['output']}/resolution_sweep_summary.json")
                else:
                    site.analyze(spark, own)
                status = "ok"
            except Exception as e:  # the manifest keeps the error, and the next site goes on
                if not batch.go_on:
                    raise
                status, error = "error", f"{type(e).__name__}: {e}"[-2000:]
        rows.append((r["subset"], r["slug"], r["name"], status, error, r["output"]))
    manifest = spark.createDataFrame(rows, "subset string, slug string, name string, status string, error string, output string")
    files.write_manifest(manifest, f"{batch.results_root.rstrip('/')}/{batch.mode}_manifest")
    return manifest


def collected(spark: SparkSession, results_root: str, modes: tuple[str, ...] = ("quick", "topology", "sweep", "final")) -> DataFrame:
    """All result documents of the modes as one wide table of dotted columns, ordered by name."""
    out = None
    for mode in modes:
        if files.path_exists(spark, f"{results_root.rstrip('/')}/{mode}"):
            name = "resolution_sweep_summary.json" if mode == "sweep" else "summary.json"
            schema = "stable boolean, D_build_cv double, spanning_radius_cv double, n_runs_total long, n_runs_quality long, recommended_pixel_size_m double" if mode == "sweep" else summary.SCHEMA
            rows = files.flattened(files.read_summaries(spark, results_root, schema, name, mode), "doc")
            out = rows if out is None else files.union_manifests(out, rows)
    if out is None:
        raise ValueError(f"no results below {results_root}")
    return out.select(*[F.col(f"`{c}`") for c in sorted(out.columns)])


def audit(spark: SparkSession, catalog: DataFrame, data_root: str, results_root: str, mode: str = "final", want: summary.Method | None = None, limits: summary.Limits | None = None) -> DataFrame:
    """The audit of every site of a catalog: complete or not, status and reasons."""
    keys = ["subset", "slug"]
    data = files.nonempty(spark, data_root, "boundary.geojson").join(files.nonempty(spark, data_root, "buildings.geojson"), keys).withColumn("data_", F.lit(True))
    docs = files.read_summaries(spark, results_root, summary.SCHEMA, mode=mode).select(*keys, "doc")
    rows = catalog.select(*keys, "name").join(data, keys, "left").join(docs, keys, "left").withColumn("data_complete", F.coalesce("data_", F.lit(False))).drop("data_")
    return summary.audited_results(rows, want, limits)


def harmonized_topology(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Atlas rows(subset, slug, plan_area_m2, analysis_eligible) with the three topology indices on the radii, relative to the plan's size, that all eligible sites cover."""
    keys = ["subset", "slug"]
    area = rows.where(F.col("analysis_eligible") & (F.col("plan_area_m2") > 0)).select(*keys, "plan_area_m2")
    p = profiles.join(area, keys).withColumn("site", F.concat_ws("/", *keys))
    first = F.min_by("beta0", "radius_m").over(stats.Window.partitionBy("site"))
    p = p.withColumn("n0", first).where("radius_m > 0 and n0 > 0").withColumn("rho", F.col("radius_m") / F.sqrt("plan_area_m2"))
    p = p.withColumn("points_", F.count(F.lit(1)).over(stats.Window.partitionBy("site"))).where("points_ >= 2")
    values = {"archipelago_index_harmonized": F.col("beta0") / F.col("n0"), "void_index_harmonized": F.col("beta1") / F.col("n0"), "boundary_complexity_harmonized": F.col("perimeter_m") / F.sqrt("plan_area_m2")}
    out = rows.withColumn("site_", F.concat_ws("/", *keys))
    for name, value in values.items():
        mean = stats.harmonized(p.withColumn("v_", value), "v_").select(F.col("site").alias("site_"), F.col("mean_value").alias(name))
        out = out.join(mean, "site_", "left")
    return out.drop("site_")


def atlas_statistics(spark: SparkSession, rows: DataFrame, threshold: float = 0.90, rounds: int = 100, features: tuple[str, ...] = MORPHOLOGY, groups: tuple[str, str] = ("russia", "world")) -> dict[str, DataFrame]:
    """The tables of the atlas for its eligible rows: feature quality and redundancy, correlations, components, clusters, stability, outliers and group tests."""
    own = rows.where("analysis_eligible").withColumn("site", F.concat_ws("/", "subset", "slug"))
    n = own.count()
    if n < 3:
        raise ValueError(f"only {n} sites pass the quality gates")
    unpivot = lambda names: own.select("site", "subset", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in names if c in own.columns])).alias("f")).select("site", "subset", "f.feature", "f.value")
    long = unpivot(features)
    out = {"feature_quality": stats.feature_quality(long)}
    filled = stats.imputed(long)
    kept = [f for f in features if f in {r["feature"] for r in filled.select("feature").distinct().collect()}]  # some dozens of features
    out["feature_redundancy"] = stats.redundancy(spark, kept, stats.spearman(filled), threshold)
    used = [r["feature"] for r in out["feature_redundancy"].where("status = 'keep'").collect()]
    out["correlations"] = stats.spearman_p(stats.spearman(unpivot((*features, *TRANSPORT)).where("value is not null")))
    z = stats.standardized(filled.where(F.col("feature").isin(*used)))
    sites, matrix = stats.matrix_of(z, used)
    scores, shares, loadings = stats.pca_full(matrix)
    k = stats.retained(shares)
    space = scores[:, :k]
    out["components"] = stats.component_table(spark, shares)
    out["scores"] = spark.createDataFrame([(s, *map(float, v)) for s, v in zip(sites, scores, strict=True)], "site string, " + ", ".join(f"PC{i + 1} double" for i in range(scores.shape[1])))
    out["loadings"] = spark.createDataFrame([(f, *map(float, v)) for f, v in zip(used, loadings, strict=True)], "feature string, " + ", ".join(f"PC{i + 1} double" for i in range(loadings.shape[1])))
    out["cluster_selection"] = stats.cluster_count(spark, space)
    best = next((r["k"] for r in out["cluster_selection"].where("chosen").collect()), 2)
    labels = stats.ward(space, best)
    out["merges"] = spark.createDataFrame([(i + 1, *m) for i, m in enumerate(stats.ward_merges(space))], "step long, left long, right long, height double, size long")
    out["clusters"] = spark.createDataFrame(list(zip(sites, map(int, labels), strict=True)), "site string, cluster long")
    out["cluster_stability"] = stats.cluster_stability(spark, matrix, labels, best, rounds)
    out["stability_summary"] = stats.stability_summary(out["cluster_stability"])
    out["cluster_profiles"] = z.join(out["clusters"], "site").groupBy("cluster", "feature").agg(F.avg("z").alias("mean"))
    out["outliers"] = stats.outliers(filled.where(F.col("feature").isin(*used)))
    tests = stats.mann_whitney(unpivot((*used, *TRANSPORT)).where("value is not null"), "subset", *groups)
    out["group_tests"] = tests.join(stats.benjamini_hochberg(tests.select(F.col("feature").alias("name"), "p")).select(F.col("name").alias("feature"), F.col("p_adjusted").alias("p_fdr_bh")), "feature")
    return out


def postprocess(spark: SparkSession, catalog: DataFrame, data_root: str, results_root: str, out_root: str, mode: str = "final") -> dict[str, DataFrame]:
    """Audit, atlas rows and statistics of a batch's results, written below out_root with a report."""
    checked = audit(spark, catalog, data_root, results_root, mode).cache()
    docs = files.read_summaries(spark, results_root, summary.SCHEMA, mode=mode).where("doc is not null")
    rows = summary.eligible(summary.atlas_rows(docs), checked).join(catalog.select("subset", "slug", "name", "query"), ["subset", "slug"], "left").withColumn("city", F.coalesce("name", "slug"))
    tables = {"audit": checked.drop("doc"), "status_counts": summary.status_counts(checked), "atlas": rows} | atlas_statistics(spark, rows)
    for name, df in tables.items():
        files.write_csv(files.stringified(df), f"{out_root}/{name}")
    cut = {"clusters": 100, "outliers": 30, "feature_quality": 50}
    shown = {k: presentation.head(df, cut.get(k, 50), F.col(df.columns[0])) for k, df in tables.items() if k in ("status_counts", "feature_quality", "feature_redundancy", "components", "cluster_selection", "stability_summary", "group_tests", "outliers")}
    files.write_text_whole(spark, presentation.report("Spatial morphology atlas", shown), f"{out_root}/report.html")
    return tables


def outstanding_inputs(spark: SparkSession, catalog: DataFrame, data_root: str) -> DataFrame:
    """Sites of the catalog without data."""
    return atlas.outstanding(catalog, files.nonempty(spark, data_root, "buildings.geojson"), ["subset", "slug"], F.lit(True))
