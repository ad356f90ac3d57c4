"""The analysis of one site, from footprints and a boundary to its result document, and of one site at several resolutions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as g
from .functions.scalars import safe_ratio
from .operators import fractal, raster, summary, sweep, topology, transport, vector
from .sources import files, osm

#: Orders of the generalized dimensions.
ORDERS = (-5.0, -2.0, -1.0, 0.0, 1.0, 2.0, 5.0)


@dataclass(frozen=True)
class AnalysisConfig:
    city_name: str | None = None
    buildings_path: str | None = None
    boundary_path: str | None = None
    output_dir: str = "results"
    pixel_size_m: float = 25.0
    floor_height_m: float = 3.0
    default_height_m: float = 12.0
    height_scenarios_m: tuple[float, ...] = (9.0, 12.0, 15.0)
    roof_factor: float = 1.0
    buffer_m: float = 0.0
    min_box_px: int = 2
    max_box_fraction: float = 0.25
    min_scaling_points: int = 6
    scaling_scale_min_m: float = 50.0
    scaling_scale_max_m: float = 3200.0
    lacunarity_windows_px: tuple[int, ...] | None = None
    lacunarity_min_domain_fraction: float = 0.95
    multifractal: bool = False
    topology: bool = False
    topology_radii_px: tuple[int, ...] | None = None
    topology_max_radius_fraction: float = 0.25
    topology_n_radii: int = 18
    topology_connectivity: int = 1
    giant_threshold: float = 0.5
    all_touched: bool = False
    transport: bool = False
    transport_phases: tuple[str, ...] = ("open_space", "buildings")
    transport_contrasts: tuple[float, ...] = (1000.0,)
    transport_max_active_cells: int = 250_000


def load_inputs(spark: SparkSession, cfg: AnalysisConfig) -> tuple[DataFrame, DataFrame | None]:
    """Footprints and boundary: files win over a place name; a name's boundary that cannot be had is left out."""
    if cfg.buildings_path:
        buildings = files.read_vector(spark, cfg.buildings_path)
    elif cfg.city_name:
        buildings = osm.buildings(spark, cfg.city_name)
    else:
        raise ValueError("either buildings_path or city_name is needed")
    if cfg.boundary_path:
        return buildings, files.read_vector(spark, cfg.boundary_path)
    if cfg.city_name:
        try:
            return buildings, osm.boundary(spark, cfg.city_name)
        except OSError:
            return buildings, None
    return buildings, None


def _box(bounds: DataFrame) -> DataFrame:
    """site, rings of bounds(site, min_x, ...)."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("min_x", "min_y"), corner("max_x", "min_y"), corner("max_x", "max_y"), corner("min_x", "max_y"))
    return bounds.select("site", F.array(ring).alias("rings"))


def _metric(features: DataFrame, srid: int | None) -> DataFrame:
    """Cleaned features in metres."""
    fine = raster.valid_shapes(features)
    if srid is None:
        return fine
    return fine.withColumn("rings", F.when(F.col("geographic"), g.to_metric(F.col("rings"), F.lit(srid))).otherwise(F.col("rings")))


def prepared(buildings: DataFrame, boundary: DataFrame | None, cfg: AnalysisConfig) -> tuple[DataFrame, DataFrame, bool]:
    """Footprints (site, feature, height, source, part, rings) inside the boundary (site, rings), both in metres, and whether the boundary is only the footprints' box.

    Both frames hold one site.
    """
    buildings = raster.valid_shapes(buildings)
    first = raster.bounds_of(buildings).join(buildings.select("geographic").limit(1)).first()
    if first is None:
        raise ValueError("no building polygons after cleaning")
    srid = None
    if first["geographic"]:
        one = buildings.sparkSession.createDataFrame([tuple(first[c] for c in ("min_x", "min_y", "max_x", "max_y"))], "a double, b double, c double, d double")
        srid = one.select(g.metric_srid(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("s")).first()["s"]
    metric = g.with_heights(_metric(buildings, srid), cfg.floor_height_m, cfg.default_height_m).select("site", "feature", "height", "source", "rings")
    edge, fallback = None, True
    if boundary is not None:
        # all rings of all features by parity: one outline
        edge = _metric(boundary, srid).groupBy("site").agg(F.flatten(F.collect_list("rings")).alias("rings"))
        area = vector.union_measures(edge.withColumns({"height": F.lit(1.0), "known": F.lit(True)})).first()
        fallback = area is None or area["area"] <= 0
    if fallback:
        edge = _box(raster.bounds_of(metric, cfg.buffer_m))
    inside = vector.clipped(metric, edge).cache()
    if inside.isEmpty():
        raise ValueError("no building polygons inside the boundary")
    return inside, edge, fallback


def _few(df: DataFrame) -> DataFrame:
    """A table of some dozens of rows for a site, held by the driver: what is built on it need not repeat the work behind it."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def analyzed(spark: SparkSession, buildings: DataFrame, boundary: DataFrame | None, cfg: AnalysisConfig) -> dict[str, DataFrame]:
    """The tables of one site's analysis, by name; ``document`` is its result document (site, doc)."""
    px = cfg.pixel_size_m
    inside, edge, fallback = prepared(buildings, boundary, cfg)
    surfaces = _few(vector.surface_summary(inside, cfg.roof_factor))
    plan = _few(vector.union_measures(edge.withColumns({"height": F.lit(1.0), "known": F.lit(True)})).select("site", F.col("area").alias("plan_area"), F.col("perimeter").alias("plan_perimeter")))
    grid = raster.grid_of(raster.bounds_of(edge), px).first()  # one site
    n_rows, n_cols, min_x, max_y = int(grid["n_rows"]), int(grid["n_cols"]), grid["min_x"], grid["max_y"]

    outline = edge.withColumns({"feature": F.lit(0).cast("long"), "value": F.lit(1.0)})
    domain = raster.rasterized(outline, min_x, max_y, n_rows, n_cols, px).select("site", "y", "x").distinct().cache()
    if domain.isEmpty():
        raise ValueError("the boundary has no cells at this resolution")
    burn = raster.touched if cfg.all_touched else raster.rasterized
    cells = raster.burned(burn(inside.withColumnRenamed("height", "value"), min_x, max_y, n_rows, n_cols, px)).withColumnRenamed("value", "h").join(domain, ["site", "y", "x"], "left_semi").cache()
    if cells.isEmpty():
        raise ValueError("no building cells inside the boundary")

    side = min(n_rows, n_cols)
    sizes = [int(x) for x in spark.range(1).select(fractal.box_sizes(F.lit(side).cast("long"), F.lit(px), cfg.min_box_px, cfg.max_box_fraction, cfg.min_scaling_points, cfg.scaling_scale_max_m).alias("s")).first()["s"] if x <= max(n_rows, n_cols)]
    out = {"surfaces": surfaces, "scenarios": _few(vector.height_scenarios(inside, cfg.height_scenarios_m, cfg.default_height_m, cfg.roof_factor)), "domain": domain, "cells": cells}
    out["box_counts"] = _few(fractal.box_counts(cells, sizes, px))
    out["fit"] = _few(fractal.scaling_fit(cells, sizes, px, cfg.min_scaling_points, cfg.scaling_scale_min_m, cfg.scaling_scale_max_m))
    if out["fit"].first()["n_points"] < cfg.min_scaling_points:
        raise ValueError(f"the grid has {out['fit'].first()['n_points']} scales; {cfg.min_scaling_points} are needed")
    out["windows"] = _few(fractal.window_fits(out["box_counts"], cfg.min_scaling_points).where("rank <= 200"))
    out["lacunarity"] = _few(fractal.lacunarity(cells, domain, cfg.lacunarity_windows_px or sizes, n_rows, n_cols, cfg.lacunarity_min_domain_fraction))
    sized = plan.join(surfaces.select("site", F.col("footprint_area_m2").alias("footprint_area")), "site").withColumns({"n_rows": F.lit(n_rows).cast("long"), "n_cols": F.lit(n_cols).cast("long")})
    out["diagnostics"] = _few(raster.diagnostics(cells, domain, sized, px))

    if cfg.topology:
        radii = list(cfg.topology_radii_px) if cfg.topology_radii_px else topology.default_radii(side, cfg.topology_max_radius_fraction, cfg.topology_n_radii)
        out["topology_profile"] = _few(topology.domain_topology(cells, domain, radii, n_rows, n_cols, px, cfg.topology_connectivity))
        out["topology"] = _few(topology.domain_profile_summary(out["topology_profile"], cfg.giant_threshold, cfg.topology_connectivity))
    if cfg.multifractal:
        for name, mass in (("spectrum", F.lit(1.0)), ("height_spectrum", F.col("h"))):
            out[f"{name}_raw"] = _few(fractal.moments(cells.withColumn("mass", mass), sizes, ORDERS, px))
            out[name] = _few(fractal.spectrum(out[f"{name}_raw"], cfg.min_scaling_points))
            out[f"{name}_checks"] = _few(fractal.spectrum_checks(out[name]))
    if cfg.transport:
        coarse = transport.transport_grid(cells, domain, cfg.transport_max_active_cells).cache()
        factor = coarse.agg(F.first("factor")).first()[0]
        out["transport_results"] = transport.conductances(coarse.select("site", "y", "x", "fraction"), -(-n_rows // factor), -(-n_cols // factor), cfg.transport_contrasts, cfg.transport_phases).withColumns({"pixel_size_m": F.lit(px * factor), "coarsening_factor": F.lit(int(factor))})
        out["transport_results"] = _few(out["transport_results"])
        out["transport"] = _few(transport.transport_summary(out["transport_results"]))
    out["document"] = _few(_document(out, cfg, fallback))
    return out


def _document(tables: dict[str, DataFrame], cfg: AnalysisConfig, fallback: bool) -> DataFrame:
    """site, doc: the result document as a struct of its sections."""
    def section(name: str, **columns) -> DataFrame:
        return tables[name].select("site", F.struct(*[c.alias(k) for k, c in columns.items()]).alias(f"{name}_"))

    c = F.col
    whole = lambda name, **more: tables[name].select("site", F.struct(*[c(x) for x in tables[name].columns if x != "site"], *[v.alias(k) for k, v in more.items()]).alias(f"{name}_"))
    fit = {"scale_min": c("scale_min"), "scale_max": c("scale_max"), "dimension": c("dimension"), "intercept": c("intercept"), "r2": c("r2"), "stderr": c("stderr"), "n_points": c("n_points").cast("double"), "method": c("method")}
    fit |= {k: c(k) for k in ("scale_span_decades", "grid_offset_std", "grid_offset_cv", "leave_one_out_std", "leave_one_out_cv", "count_cv_mean")}
    out = whole("surfaces").join(whole("diagnostics"), "site").join(section("fit", **fit), "site")
    tables["lacunarity_summary"] = fractal.lacunarity_summary(tables["lacunarity"], cfg.pixel_size_m)
    out = out.join(whole("lacunarity_summary"), "site", "left")
    if "topology" in tables:
        out = out.join(whole("topology"), "site", "left")
    for name in ("spectrum", "height_spectrum"):
        if name in tables:
            rows = tables[name].groupBy("site").agg(F.array_sort(F.collect_list(F.struct(*[c(x) for x in tables[name].columns if x != "site"]))).alias(f"{name}_"))
            out = out.join(rows, "site", "left").join(whole(f"{name}_checks"), "site", "left")
    if "transport" in tables:
        results = tables["transport_results"].groupBy("site").agg(F.sort_array(F.collect_list(F.struct(*[c(x) for x in tables["transport_results"].columns if x != "site"]))).alias("results_"), F.first("pixel_size_m").alias("px_"), F.first("coarsening_factor").alias("factor_"))
        one = tables["transport"].groupBy("site").agg(F.first("status").alias("status_"), F.first("max_energy_identity_relative_error").alias("energy_"))
        out = out.join(results, "site", "left").join(one, "site", "left")

    s, d, f = c("surfaces_"), c("diagnostics_"), c("fit_")
    energy = c("energy_") if "transport" in tables else F.lit(None).cast("double")
    gates = summary.quality_gates(
        out.select("site", d["raster_area_error_rel"].alias("raster_area_error_rel"), d["boundary_raster_area_error_rel"].alias("boundary_raster_area_error_rel"), f["r2"].alias("r2"), f["n_points"].alias("n_points"), f["grid_offset_cv"].alias("grid_offset_cv"),
                   f["leave_one_out_cv"].alias("leave_one_out_cv"), f["scale_span_decades"].alias("scale_span_decades"), s["height_source_known_area_fraction"].alias("known_height_area"), energy.alias("energy_error"), F.lit(fallback).alias("fallback_used")),
        min_points=cfg.min_scaling_points,
    )
    names = [x for x in gates.columns if x.endswith("_pass") or x in ("boundary_source", "height_completeness_for_intercity_2_5d")]
    out = out.join(gates.select("site", F.struct(*names).alias("gates_")), "site")

    def checked(name, field):
        return c(f"{name}_checks_")[field] if name in tables else F.lit(None).cast("boolean")

    known = s["height_source_known_area_fraction"] >= 0.5
    quality = [c("gates_")[n].alias(n) for n in names] + [
        checked("spectrum", "monotone").alias("multifractal_footprint_monotonic_within_uncertainty"), checked("height_spectrum", "monotone").alias("multifractal_height_weighted_monotonic_within_uncertainty"),
        checked("spectrum", "monotone_all_fitted").alias("multifractal_footprint_monotonic_all_fitted_within_uncertainty"), checked("height_spectrum", "monotone_all_fitted").alias("multifractal_height_weighted_monotonic_all_fitted_within_uncertainty"),
        (known if cfg.multifractal else F.lit(None).cast("boolean")).alias("multifractal_height_weighted_intercity_eligible"), F.lit("not_assessed_without_independent_reference").alias("osm_building_completeness"),
    ]
    lit = lambda v: F.array(*[F.lit(x) for x in v]) if isinstance(v, tuple) else F.lit(v)
    given = F.struct(*[lit(v).alias(k) for k, v in vars(cfg).items() if v is not None])
    plan, length = d["plan_area"], d["plan_perimeter"]
    sections = {
        "software": F.struct(F.lit(summary.VERSION).alias("version")), "input": given,
        "planar_boundary": F.struct(plan.alias("area_m2"), length.alias("perimeter_m"), g.compactness_2d(plan, length).alias("compactness_2d_analysis_boundary"), F.lit(fallback).alias("fallback_used")),
        "building_surfaces": s, "raster_diagnostics": d,
        "derived_2_5d": F.struct(
            g.ratio(s["envelope_area_m2"], plan).alias("surface_amplification_thermal_envelope_over_plan"), g.compactness_3d(s["volume_m3"], s["closed_surface_area_m2"]).alias("isoperimetric_compactness_3d_closed_surface"),
            safe_ratio(s["envelope_area_m2"], s["volume_m3"]).alias("thermal_surface_to_volume_1_per_m"), known.alias("intercity_comparison_eligible"),
        ),
        "fractal_dimension_building_footprints": f, "lacunarity_building_footprints": c("lacunarity_summary_"), "quality_control": F.struct(*quality),
    }
    if "topology" in tables:
        sections["topological_morphology_building_footprints"] = c("topology_")
    for name, key in (("spectrum", "multifractal_spectrum_building_footprints"), ("height_spectrum", "multifractal_spectrum_height_weighted_buildings")):
        if name in tables:
            sections[key] = c(f"{name}_")
    if "transport" in tables:
        sections["two_phase_transport"] = F.struct(c("status_").alias("status"), c("px_").alias("analysis_pixel_size_m"), c("factor_").cast("double").alias("coarsening_factor"), c("energy_").alias("max_energy_identity_relative_error"), c("results_").alias("results"))
    return out.select("site", F.struct(*[v.alias(k) for k, v in sections.items()]).alias("doc"))


def analyze(spark: SparkSession, cfg: AnalysisConfig) -> dict[str, DataFrame]:
    """Reads the inputs that the configuration names, analyses them and writes all tables below its output folder."""
    tables = analyzed(spark, *load_inputs(spark, cfg), cfg)
    for name, df in tables.items():
        if name == "document":
            files.write_document(df.select("doc.*"), f"{cfg.output_dir}/summary.json")
        elif name in ("cells", "domain"):
            files.write_cells(df, f"{cfg.output_dir}/{name}")
        else:
            files.write_csv(df.select(*[c for c, t in df.dtypes if not t.startswith(("array", "struct"))]), f"{cfg.output_dir}/{name}")
    return tables


#: A row of a sweep.
RUN = "site long, pixel_size_m double, status string, D_build double, D_r2 double, D_n_points double, raster_area_error_rel double, spanning_radius_any_m double, giant_component_radius_m double, lacunarity_mean double, error string"


def resolution_sweep(spark: SparkSession, buildings: DataFrame, boundary: DataFrame | None, cfg: AnalysisConfig, sizes: tuple[float, ...], go_on: bool = False, **limits) -> tuple[DataFrame, DataFrame]:
    """A run for each positive cell size, without transport, and the verdict on their stability. A failed run is an error, or a row if the sweep goes on."""
    runs = None
    for px in sorted({float(x) for x in sizes if float(x) > 0}):  # a handful of sizes
        try:
            doc = analyzed(spark, buildings, boundary, replace(cfg, pixel_size_m=px, transport=False))["document"]
            d = F.col("doc")
            fit, topo = d["fractal_dimension_building_footprints"], d["topological_morphology_building_footprints"] if cfg.topology else None
            none = F.lit(None).cast("double")
            row = doc.select(
                "site", F.lit(px).alias("pixel_size_m"), F.lit("ok").alias("status"), fit["dimension"].alias("D_build"), fit["r2"].alias("D_r2"), fit["n_points"].alias("D_n_points"), d["raster_diagnostics"]["raster_area_error_rel"].alias("raster_area_error_rel"),
                (topo["spanning_radius_any_m"] if topo is not None else none).alias("spanning_radius_any_m"), (topo["giant_component_radius_m"] if topo is not None else none).alias("giant_component_radius_m"), d["lacunarity_building_footprints"]["mean"].alias("lacunarity_mean"), F.lit(None).cast("string").alias("error"),
            )
        except ValueError as e:
            if not go_on:
                raise
            row = spark.createDataFrame([(0, px, "error", *[None] * 7, f"{type(e).__name__}: {e}")], RUN)
        runs = row if runs is None else runs.unionByName(row)
    return runs, sweep.stability(runs, points=cfg.min_scaling_points, **limits)
