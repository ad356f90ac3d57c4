"""Queries over result documents: compatibility, audit, gates, atlas rows, boundary candidates, names and reports.

The documents are made from the supplier table by expressions that Spark and the oracle share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import boundary, presentation, summary
from .fixtures import table
from .morphology import query

K = "s_suppkey"
#: Columns of one document each, in the SQL that both engines read.
FLAT = {
    "k": K,
    "subset": f"CASE WHEN {K} % 2 = 0 THEN 'north' ELSE 'south' END",
    "slug": "s_name",
    "data_complete": f"{K} % 19 <> 0",
    "has_doc": f"{K} % 17 <> 0",
    "version": f"CASE WHEN {K} % 7 = 0 THEN '0' ELSE '1' END",
    "pixel": f"CASE WHEN {K} % 9 = 0 THEN 50e0 WHEN {K} % 23 = 0 THEN CAST(NULL AS DOUBLE) ELSE 25e0 END",
    "touched": f"CASE WHEN {K} % 11 = 0 THEN CAST(NULL AS BOOLEAN) ELSE {K} % 10 = 0 END",
    "fallback": f"CASE WHEN {K} % 29 = 0 THEN CAST(NULL AS BOOLEAN) ELSE {K} % 12 = 0 END",
    "area": f"CASE WHEN {K} % 31 = 0 THEN 0e0 ELSE 1e6 * (1 + {K} % 40) END",
    "area_err": f"CASE WHEN {K} % 13 = 0 THEN CAST(NULL AS DOUBLE) ELSE ({K} % 7) / 1e2 END",
    "bound_err": f"({K} % 5) / 1e2",
    "r2": f"CASE WHEN {K} % 37 = 0 THEN CAST('NaN' AS DOUBLE) ELSE 1e0 - ({K} % 8) / 1e2 END",
    "points": f"CAST(5 + {K} % 4 AS DOUBLE)",
    "dimension": f"CASE WHEN {K} % 41 = 0 THEN 0e0 ELSE 1e0 + ({K} % 90) / 1e2 END",
    "offset_std": f"({K} % 6) / 1e2",
    "offset_cv": f"CASE WHEN {K} % 3 = 0 THEN CAST(NULL AS DOUBLE) ELSE ({K} % 7) / 1e2 END",
    "loo_std": f"({K} % 9) / 1e2",
    "loo_cv": f"CASE WHEN {K} % 4 = 0 THEN CAST(NULL AS DOUBLE) ELSE ({K} % 10) / 1e2 END",
    "span_decades": f"({K} % 20) / 1e1",
    "span_lr": f"CASE WHEN {K} % 14 = 0 THEN CAST(NULL AS DOUBLE) ELSE 25e0 * ({K} % 30) END",
    "span_lr_rec": f"CASE WHEN {K} % 6 = 0 THEN 50e0 * ({K} % 12) END",
    "interval_fine": f"CASE WHEN {K} % 8 <> 0 THEN {K} % 3 = 0 END",
    "beta0": f"CAST(1 + {K} % 500 AS DOUBLE)",
    "void": f"({K} % 77) / 1e0",
    "has_transport": f"{K} % 15 <> 0",
    "energy": f"CASE WHEN {K} % 16 = 0 THEN 1e-3 WHEN {K} % 25 = 0 THEN CAST(NULL AS DOUBLE) ELSE 1e-9 END",
    "known": f"CASE WHEN {K} % 18 = 0 THEN CAST(NULL AS DOUBLE) ELSE ({K} % 10) / 1e1 END",
    "domain_fraction": f"({K} % 10) / 1e1",
    "overlap": f"({K} % 12) / 1e2",
    "completeness": f"CASE WHEN {K} % 2 = 0 THEN 'not_assessed_without_independent_reference' END",
    "mono": f"CASE WHEN {K} % 3 <> 0 THEN {K} % 5 <> 0 END",
    "height_fine": f"CASE WHEN {K} % 4 <> 0 THEN {K} % 2 = 0 END",
    "core": f"CASE WHEN {K} % 5 <> 0 THEN {K} % 3 <> 0 END",
    "phases_fine": f"{K} % 20 <> 0",
    "contrast": f"CASE WHEN {K} % 21 = 0 THEN 100e0 ELSE 1000e0 END",
}
DOCS = "flat AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in FLAT.items()) + " FROM supplier)"


def flat(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(*[f"{v} AS {k}" for k, v in FLAT.items()])


def documents(spark, sf_dir) -> DataFrame:
    """k, subset, slug, data_complete, doc."""
    f = F.col
    both = F.array(F.lit("open_space"), F.when(f("phases_fine"), "buildings").otherwise("other"))
    one = lambda phase, d, c, v: F.struct(F.lit(phase).alias("phase"), F.lit(d).alias("direction"), c.alias("contrast"), v.alias("relative_conductance"), (v / 2).alias("conductance"), (2 / v).alias("resistance"))
    base = 0.1 + (f("k") % 9) / 10.0
    results = F.array(*[one(p, d, c, base * x) for p, d, c, x in (("open_space", "lr", F.lit(10.0), 9.0), ("open_space", "lr", f("contrast"), 1.0), ("open_space", "tb", f("contrast"), 2.0), ("buildings", "lr", f("contrast"), 0.5))])
    order = lambda q, d, e, p: F.struct(F.lit(float(q)).alias("q"), d.alias("Dq"), e.alias("atlas_eligible"), p.alias("fit_pass"))
    yes, none = F.lit(True), F.lit(None).cast("boolean")
    d0 = f("dimension")
    spectrum = F.array(order(2, d0 - 0.2, none, f("k") % 3 != 0), order(0, d0, yes, yes), order(1, d0 - 0.1, yes, yes), order(-2, d0 + 0.5, none, yes), order(5, F.lit(float("nan")), yes, yes))
    given = {
        "software": {"version": f("version")},
        "input": {
            "pixel_size_m": f("pixel"), "all_touched": f("touched"), "min_scaling_points": F.lit(6.0), "scaling_scale_min_m": F.lit(50.0), "scaling_scale_max_m": F.lit(3200.0), "topology_max_radius_fraction": F.lit(0.25), "topology_n_radii": F.lit(18.0),
            "topology_connectivity": F.lit(1.0), "giant_threshold": F.lit(0.5), "topology": yes, "multifractal": f("k") % 27 != 0, "transport": yes, "transport_phases": both, "transport_contrasts": F.array(f("contrast")), "transport_max_active_cells": F.lit(250000.0),
        },
        "planar_boundary": {"area_m2": f("area"), "fallback_used": f("fallback")},
        "building_surfaces": {"height_source_known_area_fraction": f("known"), "footprint_overlap_fraction": f("overlap"), "footprint_area_m2": f("area") / 4},
        "raster_diagnostics": {"raster_area_error_rel": f("area_err"), "boundary_raster_area_error_rel": f("bound_err"), "domain_fraction_of_bbox": f("domain_fraction")},
        "fractal_dimension_building_footprints": {"dimension": d0, "r2": f("r2"), "n_points": f("points"), "grid_offset_std": f("offset_std"), "grid_offset_cv": f("offset_cv"), "leave_one_out_std": f("loo_std"), "leave_one_out_cv": f("loo_cv")},
        "topological_morphology_building_footprints": {"spanning_radius_lr_m": f("span_lr"), "spanning_radius_lr_recommended_m": f("span_lr_rec"), "normalized_indices_radius_interval_comparable": f("interval_fine"), "beta0_at_zero": f("beta0"), "void_index": f("void")},
        "quality_control": {"osm_building_completeness": f("completeness"), "multifractal_footprint_monotonic_within_uncertainty": f("mono"), "multifractal_height_weighted_intercity_eligible": f("height_fine"), "core_2d_analysis_pass": f("core")},
        "two_phase_transport": {"max_energy_identity_relative_error": f("energy"), "results": results},
    }
    sections = {k: F.struct(*[c.alias(n) for n, c in v.items()]) for k, v in given.items()}
    sections["two_phase_transport"] = F.when(f("has_transport"), sections["two_phase_transport"])
    sections["multifractal_spectrum_building_footprints"] = spectrum
    sections["resolutions"] = F.array(*[F.struct(c.alias("pixel_size_m")) for c in (F.lit(50.0), F.when(f("k") % 4 != 0, 10.0), F.lit(20.0))])
    # through JSON, as stored documents come: what is not given is null
    text = F.to_json(F.struct(*[c.alias(k) for k, c in sections.items()]))
    doc = F.when(f("has_doc"), F.from_json(text, summary.SCHEMA))
    return flat(spark, sf_dir).select("k", "subset", "slug", "data_complete", doc.alias("doc"))


@query(f"""WITH {DOCS} SELECT k, coalesce(has_doc AND version = '1' AND pixel = 25 AND coalesce(touched, false) = false AND k % 27 <> 0 AND phases_fine AND contrast = 1000, false) AS final_fits,
 coalesce(has_doc AND version = '1' AND pixel = 25 AND coalesce(touched, false) = false, false) AS topology_fits, coalesce(has_doc AND version = '1' AND k % 4 <> 0, false) AS sweep_fits FROM flat""")
def result_compatibility(spark, sf_dir):
    doc = F.col("doc")
    fits = {f"{m}_fits": summary.compatible_result(doc, summary.Method(mode=m)) for m in ("final", "topology", "sweep")}
    return documents(spark, sf_dir).select("k", *[c.alias(k) for k, c in fits.items()])


_NUM = "CASE WHEN isnan({0}) THEN NULL ELSE {0} END"
_AUDIT = f"""{DOCS}, cv AS (SELECT *, {_NUM.format('r2')} AS r2n, coalesce(offset_cv, offset_std / nullif(abs(dimension), 0)) AS ocv, coalesce(loo_cv, loo_std / nullif(abs(dimension), 0)) AS lcv, coalesce(span_lr_rec, span_lr) AS span FROM flat),
 judged AS (SELECT *, concat_ws(';', CASE WHEN NOT data_complete THEN 'data_missing' END, CASE WHEN NOT has_doc THEN 'result_missing' END, CASE WHEN has_doc THEN nullif(concat_ws(';', CASE WHEN version <> '1' THEN 'method_version_incompatible' END,
  CASE WHEN pixel IS NULL OR pixel <> 25 THEN 'pixel_not_25m' END, CASE WHEN touched IS DISTINCT FROM false THEN 'all_touched_not_false' END, CASE WHEN area_err IS NULL OR area_err > 5e-2 THEN 'building_raster_area_error' END,
  CASE WHEN bound_err > 3e-2 THEN 'boundary_raster_area_error' END, CASE WHEN r2n IS NULL OR r2n < 95e-2 THEN 'fractal_r2' END, CASE WHEN points < 6 THEN 'fractal_points' END,
  CASE WHEN ocv IS NULL OR ocv > 5e-2 THEN 'fractal_grid_origin_instability' END, CASE WHEN lcv IS NULL OR lcv > 5e-2 THEN 'fractal_leave_one_out_instability' END, CASE WHEN fallback THEN 'boundary_fallback' END,
  CASE WHEN span IS NULL THEN 'directional_spanning_missing' END, CASE WHEN NOT has_transport THEN 'transport_missing' WHEN energy IS NULL OR energy > 1e-5 THEN 'transport_energy_identity' END), '') END) AS fail_reasons,
 coalesce(CASE WHEN has_doc THEN concat_ws(';', CASE WHEN known IS NULL OR known < 5e-1 THEN '2_5d_height_completeness_low' END, CASE WHEN domain_fraction < 2e-1 THEN 'complex_or_sparse_boundary_in_bbox' END,
  CASE WHEN overlap > 5e-2 THEN 'building_footprint_overlap_high' END, CASE WHEN completeness IS NOT NULL THEN 'osm_completeness_unassessed' END, CASE WHEN NOT interval_fine THEN 'topology_radius_interval_requires_harmonization' END,
  CASE WHEN NOT mono THEN 'multifractal_footprint_qc_failed' END, CASE WHEN NOT height_fine THEN 'multifractal_height_weighted_not_intercity_eligible' END) END, '') AS warning_reasons FROM cv),
 audit AS (SELECT *, CASE WHEN fail_reasons <> '' THEN 'fail' WHEN warning_reasons <> '' THEN 'pass_with_warnings' ELSE 'pass' END AS quality_status FROM judged)"""


@query(f"WITH {_AUDIT} SELECT subset, slug, fail_reasons, warning_reasons, quality_status FROM audit")
def audit_rules(spark, sf_dir):
    return summary.audited_results(documents(spark, sf_dir)).select("subset", "slug", "fail_reasons", "warning_reasons", "quality_status")


@query(f"WITH {_AUDIT} SELECT quality_status, count(*) AS n FROM audit GROUP BY 1")
def status_counts(spark, sf_dir):
    return summary.status_counts(summary.audited_results(documents(spark, sf_dir)))


@query(f"WITH {DOCS} SELECT count(*) AS catalog_sites, count(*) FILTER (data_complete) AS data_complete, count(*) FILTER (has_doc) AS result_complete FROM flat")
def audit_counters(spark, sf_dir):
    return summary.completeness(documents(spark, sf_dir))


_GATES = {"raster_building_area_pass": "area_err <= 5e-2", "raster_boundary_area_pass": "bound_err <= 3e-2", "fractal_r2_pass": "r2 >= 95e-2 AND NOT isnan(r2)", "fractal_min_points_pass": "points >= 6", "fractal_grid_origin_stability_pass": "offset_cv <= 5e-2", "fractal_leave_one_scale_out_pass": "loo_cv <= 5e-2", "fractal_scale_span_pass": "span_decades >= 1"}


@query(f"WITH {DOCS}, g AS (SELECT *, " + ", ".join(f"coalesce({v}, false) AS {k}" for k, v in _GATES.items()) + f""" FROM flat) SELECT k, {', '.join(_GATES)}, coalesce(known >= 5e-1, false) AS height_completeness_for_intercity_2_5d, energy <= 1e-5 AS transport_energy_identity_pass,
 CASE WHEN fallback THEN 'fallback_building_bbox' ELSE 'provided_or_osm_boundary' END AS boundary_source, {' AND '.join(_GATES)} AND coalesce(energy <= 1e-5, true) AND NOT coalesce(fallback, false) AS core_2d_analysis_pass FROM g""")
def quality_gates(spark, sf_dir):
    rows = flat(spark, sf_dir).select(
        "k", F.col("area_err").alias("raster_area_error_rel"), F.col("bound_err").alias("boundary_raster_area_error_rel"), sc.finite(F.col("r2")).alias("r2"), F.col("points").alias("n_points"), F.col("offset_cv").alias("grid_offset_cv"),
        F.col("loo_cv").alias("leave_one_out_cv"), F.col("span_decades").alias("scale_span_decades"), F.col("known").alias("known_height_area"), F.col("energy").alias("energy_error"), F.col("fallback").alias("fallback_used"),
    )
    return summary.quality_gates(rows).select("k", *_GATES, "height_completeness_for_intercity_2_5d", "transport_energy_identity_pass", "boundary_source", "core_2d_analysis_pass")


_ATLAS = f"{DOCS}, rows_ AS (SELECT *, CASE WHEN has_doc THEN coalesce(span_lr_rec, span_lr) END AS span, CASE WHEN has_doc AND area > 0 THEN area END AS a FROM flat)"


@query(f"""WITH {_ATLAS} SELECT subset, slug, CASE WHEN has_doc THEN round(dimension, 6) END AS "D_build", CASE WHEN has_doc AND NOT isnan(r2) THEN round(r2, 6) END AS "D_r2", CASE WHEN has_doc THEN area_err END AS raster_area_error_rel, span AS spanning_radius_lr_m,
 'bbox' AS spanning_reference_recommended, 1.0::DOUBLE AS domain_component_count, round(a / 1e6, 6) AS plan_area_km2, round(a / 4e6, 6) AS footprint_area_km2, round(span / sqrt(a), 6) AS spanning_radius_lr_norm, round(beta0 / (a / 1e6), 6) AS beta0_density_km2,
 round(void / (a / 1e6), 6) AS void_density_km2, CASE WHEN has_doc THEN version END AS software_version FROM rows_""")
def atlas_row(spark, sf_dir):
    names = ["D_build", "D_r2", "raster_area_error_rel", "spanning_radius_lr_m", "spanning_reference_recommended", "domain_component_count", "plan_area_km2", "footprint_area_km2", "spanning_radius_lr_norm", "beta0_density_km2", "void_density_km2", "software_version"]
    return summary.atlas_rows(documents(spark, sf_dir)).select("subset", "slug", *names)


@query(f"""WITH {DOCS} SELECT slug, CASE WHEN has_doc THEN round(dimension, 6) END AS "Dq_0", CASE WHEN has_doc THEN round(dimension - 1e-1, 6) + 0.0 END AS "Dq_1", CASE WHEN has_doc AND k % 3 <> 0 THEN round(dimension - 2e-1, 6) + 0.0 END AS "Dq_2",
 CASE WHEN has_doc THEN CASE WHEN k % 3 <> 0 THEN 2e-1 ELSE 1e-1 END END AS multifractal_width, CASE WHEN has_doc THEN CASE WHEN k % 3 <> 0 THEN 2e-1 ELSE 1e-1 END END AS multifractal_range FROM flat""")
def spectrum_columns(spark, sf_dir):
    return summary.atlas_rows(documents(spark, sf_dir)).select("slug", "Dq_0", "Dq_1", "Dq_2", "multifractal_width", "multifractal_range")


@query(f"""WITH {DOCS}, b AS (SELECT *, 1e-1 + (k % 9) / 1e1 AS v, has_doc AND has_transport AS t FROM flat) SELECT slug, CASE WHEN t THEN contrast END AS transport_principal_contrast, CASE WHEN t THEN round(v, 6) END AS open_space_relative_conductance_lr,
 CASE WHEN t THEN round(2 * v, 6) END AS open_space_relative_conductance_tb, CASE WHEN t THEN round(v / 2, 6) END AS open_space_conductance_lr, CASE WHEN t THEN round(4 / v, 6) END AS buildings_resistance_lr,
 CASE WHEN t THEN 5e-1 END AS open_space_transport_anisotropy, NULL::DOUBLE AS buildings_transport_anisotropy FROM b""")
def transport_principal(spark, sf_dir):
    names = ["transport_principal_contrast", "open_space_relative_conductance_lr", "open_space_relative_conductance_tb", "open_space_conductance_lr", "buildings_resistance_lr", "open_space_transport_anisotropy", "buildings_transport_anisotropy"]
    return summary.atlas_rows(documents(spark, sf_dir)).select("slug", *names)


@query(f"WITH {_AUDIT} SELECT subset, slug, quality_status, quality_status <> 'fail' AND coalesce(core, false) AND version = '1' AS analysis_eligible FROM audit")
def atlas_eligible(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = summary.eligible(summary.atlas_rows(docs), summary.audited_results(docs))
    return rows.select("subset", "slug", "quality_status", "analysis_eligible")


# --- scalars ----------------------------------------------------------------------------


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'NaN' WHEN 1 THEN 'x' WHEN 2 THEN '-inf' WHEN 3 THEN p_size || '.5' ELSE ' ' || p_size END AS t, p_size::DOUBLE AS s FROM part),
 n AS (SELECT *, CASE p_partkey % 5 WHEN 3 THEN s + 5e-1 WHEN 4 THEN s END AS f FROM p) SELECT p_partkey, f AS finite, CASE WHEN p_partkey % 5 = 2 THEN '-Infinity'::DOUBLE ELSE f END AS number, p_partkey % 3 = 0 AS flag, f / nullif(s - 10, 0) IS NOT NULL AS has_ratio,
 least(f, s - 1) AS first_any, CASE p_partkey % 4 WHEN 0 THEN 90 WHEN 1 THEN 35 ELSE 0 END AS score, 'px_' || replace(CASE WHEN s = floor(s) THEN s::BIGINT::VARCHAR END, '.', 'p') || 'm' AS label,
 CASE p_partkey % 2 WHEN 0 THEN 'Dq_' || p_size ELSE 'Dq_m' || p_size || 'p5' END AS order_key, right(p_name, 4) AS tail, p_size || 'p25' AS quarter FROM n JOIN part USING (p_partkey)""")
def scalar_cleaning(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k, s = F.col("p_partkey"), F.col("p_size").cast("double")
    size = F.col("p_size").cast("string")
    t = F.when(k % 5 == 0, "NaN").when(k % 5 == 1, "x").when(k % 5 == 2, "-inf").when(k % 5 == 3, F.concat(size, F.lit(".5"))).otherwise(F.concat(F.lit(" "), size))
    flag = F.when(k % 3 == 0, F.when(k % 2 == 0, "True").otherwise("1")).when(k % 3 == 1, "no")
    grade = sc.looked_up({"a": 90, "b": 35}, F.when(k % 4 == 0, "a").when(k % 4 == 1, "b").otherwise("c"), 0)
    q = F.when(k % 2 == 0, s).otherwise(-s - 0.5)
    return p.select(
        "p_partkey", sc.finite(t).alias("finite"), sc.number(t).alias("number"), sc.truthy(flag).alias("flag"), sc.safe_ratio(sc.finite(t), s - 10).isNotNull().alias("has_ratio"), sc.least_present(sc.finite(t), s - 1).alias("first_any"),
        grade.alias("score"), sc.pixel_label(s).alias("label"), sc.order_key(q).alias("order_key"), sc.tail(F.col("p_name"), 4).alias("tail"), F.replace(sc.general(s + 0.25), F.lit("."), F.lit("p")).alias("quarter"),
    )


@query("SELECT c_custkey, trim(regexp_replace(lower(strip_accents(c_name || ' É-Ñ ' || c_mktsegment)), '[^a-z0-9]+', ' ', 'g')) AS folded, CASE c_custkey % 2 WHEN 0 THEN c_mktsegment ELSE 'town_' || c_nationkey END AS title, 'c' AS parent, true AS listed, c_nationkey AS first_entry FROM customer")
def text_cleaning(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    folder = F.concat(F.lit("town_"), F.col("c_nationkey").cast("string"), F.lit("_25m"))
    path = F.concat_ws("/", F.lit("a"), F.lit("c"), folder)
    numbers = sc.listed(F.concat(F.lit(" "), F.col("c_nationkey").cast("string"), F.lit(", ,7")), "bigint")
    return c.select(
        "c_custkey", sc.folded(F.concat("c_name", F.lit(" É-Ñ "), "c_mktsegment")).alias("folded"), sc.site_title(sc.path_part(path, 1), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("")).alias("title"),
        sc.path_part(path, 2).alias("parent"), (F.size(numbers) == 2).alias("listed"), numbers[0].alias("first_entry"),
    )


# --- boundaries -------------------------------------------------------------------------

_CANDIDATES = """cand AS (SELECT c_nationkey::BIGINT AS site, n_name AS wanted, c_custkey AS osm_id, CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN 'Greater ' || n_name WHEN 2 THEN 'Elsewhere' ELSE 'Other' END AS name,
 CASE c_custkey % 4 WHEN 2 THEN 'Place, ' || n_name ELSE 'Place' END AS display_name, CASE c_custkey % 5 WHEN 0 THEN 'city' WHEN 1 THEN 'town' WHEN 2 THEN 'country' WHEN 3 THEN 'City-District' ELSE 'hamlet' END AS kind,
 CASE c_custkey % 3 WHEN 0 THEN 'relation' WHEN 1 THEN 'way' ELSE 'node' END AS osm_type, (c_custkey * 7 % 12000)::DOUBLE AS area_km2, (c_custkey * 13 % 400)::DOUBLE AS diagonal, (c_custkey % 10) / 1e1 AS importance FROM customer JOIN nation ON n_nationkey = c_nationkey),
 scored AS (SELECT *, (CASE WHEN lower(name) = lower(wanted) THEN 80 WHEN contains(lower(name), lower(wanted)) THEN 55 WHEN contains(lower(display_name), lower(wanted)) THEN 35 ELSE 0 END + CASE kind WHEN 'city' THEN 100 WHEN 'town' THEN 80 WHEN 'country' THEN -100 WHEN 'City-District' THEN 60 ELSE 0 END
  + CASE osm_type WHEN 'relation' THEN 20 WHEN 'way' THEN 10 ELSE -100 END + CASE WHEN area_km2 BETWEEN 1 AND 3000 THEN 20 WHEN area_km2 <= 10000 THEN 5 ELSE 0 END + 10 * importance)::DOUBLE AS score, CASE WHEN site % 6 = 0 THEN 12000 ELSE 10000 END AS most,
  concat_ws('; ', CASE WHEN area_km2 > CASE WHEN site % 6 = 0 THEN 12000 ELSE 10000 END THEN 'area' END, CASE WHEN diagonal > 300 THEN 'diagonal' END) AS problems FROM cand)"""


def _candidates(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    j = c.join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    k, wanted = F.col("c_custkey"), F.col("n_name")
    pick = lambda m, *v: F.element_at(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in v]), (k % m + 1).cast("int"))
    return j.select(
        F.col("c_nationkey").cast("long").alias("site"), wanted.alias("wanted"), k.alias("osm_id"), pick(4, wanted, F.concat(F.lit("Greater "), wanted), "Elsewhere", "Other").alias("name"), F.when(k % 4 == 2, F.concat(F.lit("Place, "), wanted)).otherwise("Place").alias("display_name"),
        pick(5, "city", "town", "country", "City-District", "hamlet").alias("kind"), pick(3, "relation", "way", "node").alias("osm_type"), (k * 7 % 12000).cast("double").alias("area_km2"), (k * 13 % 400).cast("double").alias("diagonal_km"), ((k % 10) / 10.0).alias("importance"),
    )


def _limits(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.where("n_nationkey % 6 = 0").select(F.col("n_nationkey").cast("long").alias("site"), F.lit(12000.0).alias("max_area_km2"), F.lit(None).cast("double").alias("max_diagonal_km"))


@query(f"WITH {_CANDIDATES} SELECT site, osm_id, round(score, 6) AS score, problems, problems = '' AS accepted, upper(substr(osm_type, 1, 1)) || osm_id AS osm_ref FROM scored")
def boundary_candidates(spark, sf_dir):
    return boundary.scored(boundary.validated(_candidates(spark, sf_dir), _limits(spark, sf_dir))).select("site", "osm_id", "score", "problems", "accepted", sc.osm_reference(F.col("osm_type").substr(1, 100), F.col("osm_id")).alias("osm_ref"))


@query(f"WITH {_CANDIDATES} SELECT site, osm_id, round(score, 6) AS score FROM scored WHERE problems = '' QUALIFY row_number() OVER (PARTITION BY site ORDER BY score DESC, osm_id) = 1")
def boundary_choice(spark, sf_dir):
    c = boundary.scored(boundary.validated(_candidates(spark, sf_dir).withColumn("attempt", F.col("osm_id")), _limits(spark, sf_dir)))
    return boundary.chosen(c).select("site", "osm_id", "score")


# --- presentation -----------------------------------------------------------------------


@query("SELECT n_name AS name, v AS value FROM (SELECT n_name, round(sum(c_acctbal), 2) AS v FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1) ORDER BY v DESC, n_name LIMIT 10")
def rank_bars(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    v = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_name").agg(F.round(F.sum("c_acctbal"), 2).alias("v"))
    return presentation.rank_bars(v, "n_name", "v", 10)


@query(f"WITH {DOCS} SELECT slug AS name, round(dimension, 6) AS x, round(r2, 6) AS y, CASE WHEN (SELECT count(*) FROM flat WHERE NOT isnan(r2)) <= 35 THEN true ELSE false END AS labelled FROM flat WHERE NOT isnan(r2)")
def scatter_pairs(spark, sf_dir):
    return presentation.scatter(flat(spark, sf_dir), "slug", "dimension", "r2")


@query("""WITH p AS (SELECT o_custkey % 40 AS site, (o_orderkey % 8 + 1)::DOUBLE AS x, sum(o_totalprice) AS v FROM orders WHERE o_custkey % 40 <> 7 OR o_orderkey % 8 = 0 GROUP BY 1, 2), k AS (SELECT *, count(*) OVER (PARTITION BY site) AS n FROM p)
 SELECT site, x, round(ln(1 / x), 6) + 0.0 AS u, round(v / first_value(v) OVER (PARTITION BY site ORDER BY x), 6) AS relative, 'outside' AS legend FROM k WHERE n >= 2""")
def site_profiles(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_custkey % 40 <> 7 or o_orderkey % 8 = 0")
    p = o.groupBy((F.col("o_custkey") % 40).alias("site"), (F.col("o_orderkey") % 8 + 1).cast("double").alias("x")).agg(F.sum("o_totalprice").alias("v"))
    out = presentation.profiles(p, "site", "x", "v")
    return out.select("site", "x", F.ln(1 / F.col("x")).alias("u"), "relative", "legend")


@query(f"WITH {DOCS} SELECT slug, round(abs(dimension - 1.4e0), 6) AS score FROM flat ORDER BY abs(dimension - 1.4e0) DESC, slug LIMIT 25")
def top_outliers(spark, sf_dir):
    return presentation.head(flat(spark, sf_dir).select("slug", F.abs(F.col("dimension") - 1.4).alias("score")), 25, F.desc("score"), F.col("slug"))


@query(f"""WITH {DOCS}, b AS (SELECT *, 1e-1 + (k % 9) / 1e1 AS v, has_doc AND has_transport AS t FROM flat) SELECT slug AS city, subset, CASE WHEN has_doc THEN round(dimension, 6) END AS "D_build", CASE WHEN has_doc THEN area END AS plan_area_m2,
 CASE WHEN t THEN round(2 * v, 6) END AS transport_open_space_tb_relative_conductance, CASE WHEN t THEN round(4 / v, 6) END AS transport_buildings_lr_resistance FROM b""")
def report_rows(spark, sf_dir):
    out = presentation.report_rows(documents(spark, sf_dir))
    return out.select("city", "subset", "D_build", "plan_area_m2", "transport_open_space_tb_relative_conductance", "transport_buildings_lr_resistance")
