"""The result document of one site, and what is read from it: compatibility, audit, quality gates and the atlas row.

Documents are structs; a field that a document lacks is null. Every rule is a
column expression, so one plan judges any number of documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import close, every, finite, number, order_key, safe_ratio, truthy
from .atlas import audited

VERSION = "1"

#: The sections and fields of a result document that rules and the atlas read.
_FIT = "dimension double, intercept double, r2 double, stderr double, scale_min double, scale_max double, n_points double, method string, scale_span_decades double, grid_offset_std double, grid_offset_cv double, leave_one_out_std double, leave_one_out_cv double, count_cv_mean double"
_SPECTRUM = "array<struct<q double, Dq double, tau double, r2 double, stderr double, fit_pass boolean, atlas_eligible boolean>>"
_TOPOLOGY = (
    "giant_component_radius_m double, spanning_radius_lr_m double, spanning_radius_tb_m double, spanning_radius_any_m double, spanning_radius_lr_recommended_m double, spanning_radius_tb_recommended_m double, spanning_reference_recommended string,"
    " domain_component_count double, largest_domain_component_fraction double, beta0_at_zero double, beta1_at_zero double, beta0_lr_at_zero double, beta0_tb_at_zero double, beta1_peak_radius_m double, archipelago_index double, void_index double,"
    " boundary_complexity_index double, archipelago_index_per_component double, void_index_per_component double, boundary_index_per_characteristic_length double, topology_radius_min_positive_m double, topology_radius_max_m double, normalized_indices_radius_interval_comparable boolean"
)
_TRANSPORT = "status string, analysis_pixel_size_m double, coarsening_factor double, max_energy_identity_relative_error double, results array<struct<phase string, direction string, contrast double, relative_conductance double, conductance double, resistance double>>"
_INPUT = (
    "pixel_size_m double, all_touched boolean, min_scaling_points double, scaling_scale_min_m double, scaling_scale_max_m double, topology_max_radius_fraction double, topology_n_radii double, topology_connectivity double, giant_threshold double,"
    " topology boolean, multifractal boolean, transport boolean, transport_phases array<string>, transport_contrasts array<double>, transport_max_active_cells double"
)
SECTIONS = {
    "software": "version string",
    "input": _INPUT,
    "planar_boundary": "area_m2 double, perimeter_m double, compactness_2d_analysis_boundary double, fallback_used boolean",
    "building_surfaces": "n_buildings double, footprint_area_m2 double, footprint_overlap_fraction double, height_source_known_fraction double, height_source_known_area_fraction double",
    "raster_diagnostics": "raster_area_error_rel double, boundary_raster_area_error_rel double, domain_fraction_of_bbox double, foreground_fraction_within_domain double",
    "derived_2_5d": "surface_amplification_thermal_envelope_over_plan double, isoperimetric_compactness_3d_closed_surface double, thermal_surface_to_volume_1_per_m double, intercity_comparison_eligible boolean",
    "fractal_dimension_building_footprints": _FIT,
    "lacunarity_building_footprints": "min double, max double, mean double, peak_window_m double",
    "topological_morphology_building_footprints": _TOPOLOGY,
    "two_phase_transport": _TRANSPORT,
    "quality_control": "osm_building_completeness string, multifractal_footprint_monotonic_within_uncertainty boolean, multifractal_height_weighted_intercity_eligible boolean, core_2d_analysis_pass boolean",
}
SCHEMA = ", ".join([*[f"{k} struct<{v}>" for k, v in SECTIONS.items()], f"multifractal_spectrum_building_footprints {_SPECTRUM}", f"multifractal_spectrum_height_weighted_buildings {_SPECTRUM}", "resolutions array<struct<pixel_size_m double>>"])


@dataclass(frozen=True)
class Method:
    """Parameters that a stored result must share to be used again."""

    mode: str = "final"
    pixel_size_m: float = 25.0
    all_touched: bool = False
    min_scaling_points: int = 6
    scaling_scale_min_m: float = 50.0
    scaling_scale_max_m: float = 3200.0
    topology_max_radius_fraction: float = 0.25
    topology_n_radii: int = 18
    topology_connectivity: int = 1
    giant_threshold: float = 0.5
    transport_phases: tuple[str, ...] = ("open_space", "buildings")
    transport_contrasts: tuple[float, ...] = (1000.0,)
    transport_max_active_cells: int = 250_000
    resolutions: tuple[float, ...] = (10.0, 20.0, 50.0)
    version: str = VERSION


def _numbers_match(have: Column, want: tuple[float, ...], tolerance: float) -> Column:
    pairs = F.zip_with(have, F.array(*[F.lit(float(x)) for x in want]), lambda a, b: F.coalesce(F.abs(a - b) <= tolerance, F.lit(False)))
    return (F.size(have) == len(want)) & F.forall(pairs, lambda x: x)


def compatible_result(doc: Column, want: Method) -> Column:
    """Whether a stored document was made by the wanted method: version, resolution, raster rule, scale range, topology and transport."""
    same = doc["software"]["version"] == want.version
    if want.mode == "sweep":
        got = F.array_sort(F.filter(F.transform(doc["resolutions"], lambda r: r["pixel_size_m"]), lambda x: x.isNotNull()))
        return every(same, _numbers_match(got, tuple(sorted(want.resolutions)), 1e-9))
    have = doc["input"]
    rules = [same, F.abs(have["pixel_size_m"] - want.pixel_size_m) <= 1e-9, F.coalesce(have["all_touched"], F.lit(False)) == want.all_touched]
    for name in ("min_scaling_points", "scaling_scale_min_m", "scaling_scale_max_m", "topology_max_radius_fraction", "topology_n_radii", "topology_connectivity", "giant_threshold"):
        rules.append(F.abs(have[name] - float(getattr(want, name))) <= 1e-12)
    if want.mode in ("topology", "final"):
        rules.append(have["topology"])
    if want.mode == "final":
        rules += [have["multifractal"], have["transport"], have["transport_phases"] == F.array(*[F.lit(x) for x in want.transport_phases])]
        rules += [_numbers_match(have["transport_contrasts"], want.transport_contrasts, 1e-12), have["transport_max_active_cells"] == float(want.transport_max_active_cells)]
    return every(*rules)


@dataclass(frozen=True)
class Limits:
    """The audit's and the gates' thresholds."""

    area_error: float = 0.05
    boundary_area_error: float = 0.03
    r2: float = 0.95
    points: int = 6
    offset_cv: float = 0.05
    leave_one_out_cv: float = 0.05
    energy_error: float = 1e-5
    scale_span: float = 1.0
    known_height_area: float = 0.5
    domain_fraction: float = 0.2
    overlap: float = 0.05


def cv_or_fallback(cv: Column, deviation: Column, dimension: Column) -> Column:
    """The coefficient of variation, or where a document lacks it the deviation over the dimension's size."""
    return F.coalesce(number(cv), number(deviation) / F.nullif(F.abs(number(dimension)), F.lit(0.0)))


def audited_results(rows: DataFrame, want: Method | None = None, limits: Limits | None = None) -> DataFrame:
    """rows(data_complete, doc, ...) with quality_status, fail_reasons and warning_reasons by the audit's rules.

    A null document is a missing result; its other rules do not apply.
    """
    want, limits = want or Method(), limits or Limits()
    doc = F.col("doc")
    raster, fit, topology, transport = doc["raster_diagnostics"], doc["fractal_dimension_building_footprints"], doc["topological_morphology_building_footprints"], doc["two_phase_transport"]
    there = doc.isNotNull()

    def beyond(c: Column, most: float) -> Column:
        return there & F.coalesce(number(c) > most, F.lit(True))

    def below(c: Column, least: float) -> Column:
        return there & F.coalesce(number(c) < least, F.lit(True))

    spanning = F.coalesce(topology["spanning_radius_lr_recommended_m"], topology["spanning_radius_lr_m"])
    failures = {
        "data_missing": ~F.col("data_complete"),
        "result_missing": ~there,
        "method_version_incompatible": there & ~F.coalesce(doc["software"]["version"] == want.version, F.lit(False)),
        "pixel_not_25m": there & F.coalesce(F.abs(doc["input"]["pixel_size_m"] - want.pixel_size_m) > 1e-9, F.lit(True)),
        "all_touched_not_false": there & F.coalesce(doc["input"]["all_touched"], F.lit(True)),
        "building_raster_area_error": beyond(raster["raster_area_error_rel"], limits.area_error),
        "boundary_raster_area_error": beyond(raster["boundary_raster_area_error_rel"], limits.boundary_area_error),
        "fractal_r2": below(fit["r2"], limits.r2),
        "fractal_points": below(fit["n_points"], limits.points),
        "fractal_grid_origin_instability": beyond(cv_or_fallback(fit["grid_offset_cv"], fit["grid_offset_std"], fit["dimension"]), limits.offset_cv),
        "fractal_leave_one_out_instability": beyond(cv_or_fallback(fit["leave_one_out_cv"], fit["leave_one_out_std"], fit["dimension"]), limits.leave_one_out_cv),
        "boundary_fallback": doc["planar_boundary"]["fallback_used"],
        "directional_spanning_missing": there & spanning.isNull(),
        "transport_missing": there & transport.isNull(),
        "transport_energy_identity": transport.isNotNull() & beyond(transport["max_energy_identity_relative_error"], limits.energy_error),
    }
    quality = doc["quality_control"]
    warnings = {
        "2_5d_height_completeness_low": below(doc["building_surfaces"]["height_source_known_area_fraction"], limits.known_height_area),
        "complex_or_sparse_boundary_in_bbox": number(raster["domain_fraction_of_bbox"]) < limits.domain_fraction,
        "building_footprint_overlap_high": number(doc["building_surfaces"]["footprint_overlap_fraction"]) > limits.overlap,
        "osm_completeness_unassessed": quality["osm_building_completeness"] == "not_assessed_without_independent_reference",
        "topology_radius_interval_requires_harmonization": ~topology["normalized_indices_radius_interval_comparable"],
        "multifractal_footprint_qc_failed": ~quality["multifractal_footprint_monotonic_within_uncertainty"],
        "multifractal_height_weighted_not_intercity_eligible": ~quality["multifractal_height_weighted_intercity_eligible"],
    }
    return audited(rows, failures, warnings, warned="pass_with_warnings")


def status_counts(audit: DataFrame) -> DataFrame:
    """quality_status and its number of sites."""
    return audit.groupBy("quality_status").agg(F.count(F.lit(1)).alias("n"))


def completeness(audit: DataFrame) -> DataFrame:
    """One row: sites of the catalog, those with data and those with a result."""
    return audit.agg(F.count(F.lit(1)).alias("catalog_sites"), F.count_if("data_complete").alias("data_complete"), F.count_if(F.col("doc").isNotNull()).alias("result_complete"))


def quality_gates(rows: DataFrame, limits: Limits | None = None, min_points: int = 6) -> DataFrame:
    """rows(raster_area_error_rel, boundary_raster_area_error_rel, r2, n_points, grid_offset_cv, leave_one_out_cv, scale_span_decades,
    known_height_area, energy_error, fallback_used) with a boolean for each gate and core_2d_analysis_pass: all critical ones, and no fallback.

    A null energy error means that no transport was asked for; its gate is null and not critical.
    """
    limits = limits or Limits()
    gates = {
        "raster_building_area_pass": F.col("raster_area_error_rel") <= limits.area_error,
        "raster_boundary_area_pass": F.col("boundary_raster_area_error_rel") <= limits.boundary_area_error,
        "fractal_r2_pass": F.col("r2") >= limits.r2,
        "fractal_min_points_pass": F.col("n_points") >= min_points,
        "fractal_grid_origin_stability_pass": F.col("grid_offset_cv") <= limits.offset_cv,
        "fractal_leave_one_scale_out_pass": F.col("leave_one_out_cv") <= limits.leave_one_out_cv,
        "fractal_scale_span_pass": F.col("scale_span_decades") >= limits.scale_span,
    }
    out = rows.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in gates.items()})
    out = out.withColumn("height_completeness_for_intercity_2_5d", F.coalesce(F.col("known_height_area") >= limits.known_height_area, F.lit(False)))
    out = out.withColumn("transport_energy_identity_pass", F.col("energy_error") <= limits.energy_error)
    critical = [F.col(k) for k in gates] + [F.coalesce("transport_energy_identity_pass", F.lit(True)), ~F.coalesce("fallback_used", F.lit(False))]
    return out.withColumn("boundary_source", F.when(F.col("fallback_used"), "fallback_building_bbox").otherwise("provided_or_osm_boundary")).withColumn("core_2d_analysis_pass", every(*critical))


# --- atlas ------------------------------------------------------------------------------


def eligible_orders(spectrum: Column) -> Column:
    """(q, Dq) of a spectrum's orders that count: marked so, or of an older document those of q >= 0 whose fit did not fail; by q."""
    def counts(x):
        return finite(x["q"]).isNotNull() & finite(x["Dq"]).isNotNull() & F.coalesce(x["atlas_eligible"], F.coalesce(x["fit_pass"], F.lit(True)) & (x["q"] >= 0))

    return F.array_sort(F.transform(F.filter(spectrum, counts), lambda x: F.struct(x["q"].alias("q"), x["Dq"].alias("Dq"))))


def spectrum_columns(spectrum: Column, prefix: str, orders: tuple[float, ...] = (0, 1, 2, 5)) -> dict[str, Column]:
    """Dq by order, the width (first minus last by q) and the range (greatest minus least) of a spectrum."""
    kept = eligible_orders(spectrum)
    dq = F.transform(kept, lambda x: x["Dq"])
    by_key = F.map_from_entries(F.transform(kept, lambda x: F.struct(order_key(x["q"]).alias("key"), x["Dq"].alias("value"))))
    out = {f"{prefix}Dq_{q:g}": F.try_element_at(by_key, F.lit(f"Dq_{q:g}")) for q in orders}
    out[f"{prefix}multifractal_width"] = F.try_element_at(dq, F.lit(1)) - F.try_element_at(dq, F.lit(-1))
    out[f"{prefix}multifractal_range"] = F.array_max(dq) - F.array_min(dq)
    return out


def _results_of(results: Column, phase: str, direction: str, contrast: Column) -> Column:
    return F.filter(results, lambda r: (r["phase"] == phase) & (r["direction"] == direction) & close(finite(r["contrast"]), contrast))


def transport_columns(transport: Column, phases=("open_space", "buildings"), directions=("lr", "tb")) -> dict[str, Column]:
    """The results of the highest contrast, a column for each phase, direction and figure, and the anisotropy lr / tb of each phase."""
    results = transport["results"]
    principal = F.array_max(F.filter(F.transform(results, lambda r: finite(r["contrast"])), lambda c: c.isNotNull()))
    out = {
        "transport_status": transport["status"], "transport_pixel_size_m": finite(transport["analysis_pixel_size_m"]), "transport_coarsening_factor": finite(transport["coarsening_factor"]),
        "transport_energy_error": finite(transport["max_energy_identity_relative_error"]), "transport_principal_contrast": principal,
    }
    for phase in phases:
        own = {}
        for d in directions:
            last = F.try_element_at(_results_of(results, phase, d, principal), F.lit(-1))
            own[d] = finite(last["relative_conductance"])
            out |= {f"{phase}_{k}_{d}": finite(last[k]) for k in ("relative_conductance", "conductance", "resistance")}
        out[f"{phase}_transport_anisotropy"] = safe_ratio(own["lr"], own["tb"])
    return out


#: The atlas column of each plain field, by section.
FIELDS = {
    "input": {"pixel_size_m": "pixel_size_m"},
    "planar_boundary": {"plan_area_m2": "area_m2", "plan_perimeter_m": "perimeter_m", "compactness_boundary": "compactness_2d_analysis_boundary"},
    "raster_diagnostics": {"domain_fraction_of_bbox": "domain_fraction_of_bbox", "foreground_fraction": "foreground_fraction_within_domain", "raster_area_error_rel": "raster_area_error_rel", "boundary_raster_area_error_rel": "boundary_raster_area_error_rel"},
    "building_surfaces": {"building_count": "n_buildings", "footprint_area_m2": "footprint_area_m2", "footprint_overlap_fraction": "footprint_overlap_fraction", "known_height_fraction": "height_source_known_fraction", "known_height_area_fraction": "height_source_known_area_fraction"},
    "derived_2_5d": {"thermal_surface_amplification": "surface_amplification_thermal_envelope_over_plan", "closed_3d_compactness": "isoperimetric_compactness_3d_closed_surface", "thermal_surface_to_volume_1_per_m": "thermal_surface_to_volume_1_per_m"},
    "fractal_dimension_building_footprints": {
        "D_build": "dimension", "D_r2": "r2", "D_stderr": "stderr", "D_scale_min_m": "scale_min", "D_scale_max_m": "scale_max", "D_n_points": "n_points", "D_grid_offset_std": "grid_offset_std", "D_grid_offset_cv": "grid_offset_cv",
        "D_leave_one_out_std": "leave_one_out_std", "D_leave_one_out_cv": "leave_one_out_cv", "D_scale_span_decades": "scale_span_decades",
    },
    "lacunarity_building_footprints": {"lacunarity_min": "min", "lacunarity_max": "max", "lacunarity_mean": "mean"},
    "topological_morphology_building_footprints": {
        "giant_component_radius_m": "giant_component_radius_m", "beta0_at_zero": "beta0_at_zero", "beta1_at_zero": "beta1_at_zero", "beta0_lr_at_zero": "beta0_lr_at_zero", "beta0_tb_at_zero": "beta0_tb_at_zero", "beta1_peak_radius_m": "beta1_peak_radius_m",
        "archipelago_index": "archipelago_index", "void_index": "void_index", "boundary_complexity_index": "boundary_complexity_index", "archipelago_index_norm": "archipelago_index_per_component", "void_index_norm": "void_index_per_component",
        "boundary_complexity_norm": "boundary_index_per_characteristic_length", "topology_radius_min_m": "topology_radius_min_positive_m", "topology_radius_max_m": "topology_radius_max_m",
    },
}


def size_normalised(rows: DataFrame) -> DataFrame:
    """Radii over the square root of the plan's area, counts and integrals per square kilometre; null without a positive area."""
    area = F.when(F.col("plan_area_m2") > 0, F.col("plan_area_m2"))
    km2, root = area / 1e6, F.sqrt(area)
    out = {"plan_area_km2": km2, "footprint_area_km2": F.when(area.isNotNull(), F.col("footprint_area_m2") / 1e6)}
    out |= {f"{k}_norm": F.col(f"{k}_m") / root for k in ("spanning_radius_lr", "spanning_radius_tb", "giant_component_radius")}
    out |= {f"{new}_density_km2": F.col(old) / km2 for new, old in (("beta0", "beta0_at_zero"), ("beta1", "beta1_at_zero"), ("archipelago", "archipelago_index"), ("void", "void_index"))}
    return rows.withColumns(out)


def atlas_rows(documents: DataFrame, orders: tuple[float, ...] = (0, 1, 2, 5)) -> DataFrame:
    """The atlas row of each document of documents(subset, slug, doc)."""
    doc = F.col("doc")
    topology, columns = doc["topological_morphology_building_footprints"], {}
    for section, names in FIELDS.items():
        columns |= {new: finite(doc[section][old]) for new, old in names.items()}
    for d in ("lr", "tb"):
        columns[f"spanning_radius_{d}_m"] = finite(F.coalesce(topology[f"spanning_radius_{d}_recommended_m"], topology[f"spanning_radius_{d}_m"]))
    columns |= {
        "software_version": doc["software"]["version"], "all_touched": doc["input"]["all_touched"], "boundary_fallback": doc["planar_boundary"]["fallback_used"], "2_5d_intercity_eligible": doc["derived_2_5d"]["intercity_comparison_eligible"],
        "spanning_reference_recommended": F.coalesce(topology["spanning_reference_recommended"], F.lit("bbox")), "domain_component_count": F.coalesce(finite(topology["domain_component_count"]), F.lit(1.0)),
        "largest_domain_component_fraction": F.coalesce(finite(topology["largest_domain_component_fraction"]), F.lit(1.0)), "core_2d_analysis_pass": doc["quality_control"]["core_2d_analysis_pass"],
    }
    columns |= spectrum_columns(doc["multifractal_spectrum_building_footprints"], "", orders)
    columns |= spectrum_columns(doc["multifractal_spectrum_height_weighted_buildings"], "height_", orders)
    columns |= transport_columns(doc["two_phase_transport"])
    return size_normalised(documents.select("subset", "slug", *[c.alias(k) for k, c in columns.items()]))


def eligible(rows: DataFrame, audit: DataFrame | None, version: str = VERSION) -> DataFrame:
    """Atlas rows with the audit's verdict and analysis_eligible: it passed, the core gates passed and the version is the wanted one.

    Without an audit every row passes it, with the status audit_missing.
    """
    if audit is None:
        out = rows.withColumns({"quality_status": F.lit("audit_missing"), "fail_reasons": F.lit(None).cast("string"), "warning_reasons": F.lit(None).cast("string")})
        passed = F.lit(True)
    else:
        out = rows.join(audit.select("subset", "slug", "quality_status", "fail_reasons", "warning_reasons"), ["subset", "slug"], "left")
        passed = F.col("quality_status").isin("pass", "pass_with_warnings")
    return out.withColumn("analysis_eligible", every(passed, truthy(F.col("core_2d_analysis_pass")), F.col("software_version") == version))
