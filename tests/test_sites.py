import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmorph import cli, jobs, site
from gridmorph.functions import geometry as g
from gridmorph.functions import scalars as sc
from gridmorph.operators import boundary, presentation, raster, stats, summary, sweep, topology, transport, vector
from gridmorph.sources import files, osm

SHAPES = "site long, feature long, height double, known boolean, source string, rings array<array<struct<x double, y double>>>"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def box(x0, y0, x1, y1):
    return [ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


def shapes(spark, *rows):
    return spark.createDataFrame([(0, i, float(h), known, "height" if known else "default", rings) for i, (h, known, rings) in enumerate(rows)], SHAPES)


def cells(spark, mask):
    y, x = np.nonzero(mask)
    return spark.createDataFrame([(0, int(a), int(b)) for a, b in zip(y, x, strict=True)], "site long, y long, x long")


def profile(spark, mask, domain, radii=(0,)):
    return topology.domain_topology(cells(spark, mask), cells(spark, domain), list(radii), *domain.shape).orderBy("r").collect()


# --- vector -----------------------------------------------------------------------------


def test_overlap_shared_wall_and_step(spark):
    two = shapes(spark, (10, True, box(0, 0, 2, 2)), (20, True, box(1, 0, 3, 2)))
    r = vector.union_measures(two, 1000.0).first()
    assert (r["area"], r["perimeter"], r["volume"]) == (6.0, 10.0, 10 * 2 + 20 * 4) and r["wall_area"] == 10 * (1 + 2 + 1) + 20 * (2 + 2 + 2) + 10 * 2
    beside = vector.union_measures(shapes(spark, (10, True, box(0, 0, 10, 10)), (10, False, box(10, 0, 20, 10)))).first()
    assert np.allclose([beside["wall_area"], beside["area"], beside["known_area"]], [600.0, 200.0, 100.0])


def test_slanted_union_matches_its_halves(spark):
    # a square and the same square turned by 45 degrees: an eight-pointed star
    s = math.sqrt(2)
    star = shapes(spark, (1, True, box(-1, -1, 1, 1)), (1, True, [ring((s, 0), (0, s), (-s, 0), (0, -s))]))

    for tile in (0.7, 5.0):
        r = vector.union_measures(star, tile).first()
        octagon = 8 * (s - 1)
        assert abs(r["area"] - (4 + 4 - octagon)) < 1e-9 and abs(r["perimeter"] - 16 * (2 - s)) < 1e-9


def test_hole_counts_by_parity(spark):
    donut = [*box(0, 0, 10, 10), ring((3, 3), (3, 7), (7, 7), (7, 3))]
    r = vector.union_measures(shapes(spark, (2, True, donut)), 4.0).first()
    assert abs(r["area"] - 84) < 1e-9 and abs(r["perimeter"] - 56) < 1e-9 and abs(r["wall_area"] - 112) < 1e-9


def test_clip_by_a_concave_boundary(spark):
    edge = spark.createDataFrame([(0, [ring((0, 0), (100, 0), (100, 40), (40, 40), (40, 100), (0, 100))])], "site long, rings array<array<struct<x double, y double>>>")
    own = shapes(spark, (5, True, box(10, 10, 20, 20)), (5, True, box(30, 30, 60, 60)), (5, True, box(70, 70, 80, 80)), (5, True, [ring((90, 30), (110, 30), (100, 50))]))
    got = {r["feature"]: (r["part"], round(r["area"], 6)) for r in vector.shape_measures(vector.clipped(own, edge, 3)).collect()}
    assert got == {0: ("within", 100.0), 1: ("crossing", 900.0 - 400.0), 3: ("crossing", 75.0)}


def test_cleaning_of_rings(spark):
    closed = box(0, 0, 2, 2)[0]
    rows = shapes(spark, (1, True, [[*closed, closed[0]]]), (1, True, [ring((0, 0), (1, 1))]), (1, True, [[closed[0], closed[0], *closed[1:]]]), (1, True, [ring((0, 0), (float("nan"), 1), (2, 2))]))
    out = {r["feature"]: len(r["rings"][0]) for r in raster.valid_shapes(rows).collect()}
    assert out == {0: 4, 2: 4}


# --- raster and topology ----------------------------------------------------------------


def test_touched_is_wider_than_centres(spark):
    thin = spark.createDataFrame([(0, 1, 1.0, [ring((1, 1), (29, 14), (29, 15), (1, 2))])], "site long, feature long, value double, rings array<array<struct<x double, y double>>>")
    inside = {(r["y"], r["x"]) for r in raster.rasterized(thin, 0.0, 30.0, 10, 10, 3.0).collect()}
    touched = {(r["y"], r["x"]) for r in raster.touched(thin, 0.0, 30.0, 10, 10, 3.0).collect()}
    assert inside < touched and (9, 0) in touched and (5, 9) in touched


def test_grid_is_refused_without_extent(spark):
    with pytest.raises(ValueError, match="positive"):
        raster.grid_of(spark.range(1), 0)
    empty = spark.createDataFrame([(0, 1.0, 1.0, 1.0, 1.0)], "site long, min_x double, min_y double, max_x double, max_y double")
    with pytest.raises(Exception, match="invalid raster bounds"):
        raster.grid_of(empty, 1.0).collect()


def test_holes_are_judged_by_the_domains_edge(spark):
    domain = np.ones((9, 9), bool)
    domain[0, :] = domain[:, 0] = False
    ring_ = np.zeros((9, 9), bool)
    ring_[2:7, 2:7] = True
    ring_[3:6, 3:6] = False
    r = profile(spark, ring_, domain)[0]
    assert (r["beta0"], r["beta1"], r["chi"]) == (1, 1, 0)
    # the same ring cut by the domain: its inside now reaches the domain's edge
    cut = domain.copy()
    cut[4, 4] = False
    assert profile(spark, ring_, cut)[0]["beta1"] == 0
    assert profile(spark, ring_, domain)[0]["domain_component_count"] == 1


def test_detached_part_does_not_hide_spanning(spark):
    domain = np.zeros((20, 40), bool)
    domain[:, :20] = True
    domain[8:12, 30:34] = True
    mask = np.zeros((20, 40), bool)
    mask[10, :20] = True
    r = profile(spark, mask, domain)[0]
    assert (r["beta0_lr"], r["beta0_lr_main_component"], r["beta0_tb"]) == (0, 1, 0) and r["domain_component_count"] == 2
    s = topology.domain_profile_summary(topology.domain_topology(cells(spark, mask), cells(spark, domain), [0, 1], 20, 40)).first()
    assert s["spanning_reference_recommended"] == "largest_component" and s["spanning_radius_lr_recommended_m"] == 0 and s["spanning_radius_lr_m"] is None


def test_profile_of_a_whole_rectangle_agrees(spark):
    mask = np.random.default_rng(3).random((24, 24)) < 0.35
    a = profile(spark, mask, np.ones((24, 24), bool), (0, 1, 2))
    near = topology.distances(cells(spark, mask), 2, 24, 24)
    b = topology.component_profile(topology.dilated(near, [0, 1, 2]), 24, 24).orderBy("r").collect()
    assert [(x["beta0"], x["beta1"], x["area_px"], x["beta0_lr"]) for x in a] == [(x["beta0"], x["beta1"], x["area"], x["spans_lr"]) for x in b]


def test_distances_are_exact(spark):
    mask = np.random.default_rng(4).random((30, 26)) < 0.02
    y, x = np.nonzero(mask)
    got = {(r["y"], r["x"]): r["d2"] for r in topology.distances(cells(spark, mask), 9, 30, 26).collect()}
    for i in range(30):
        for j in range(26):
            d = int(((y - i) ** 2 + (x - j) ** 2).min())
            assert got.get((i, j)) == (d if d <= 81 else None)


# --- transport --------------------------------------------------------------------------


def test_unanchored_cells_and_coinciding_sides():
    domain = np.ones((6, 8), bool)
    domain[:, 5] = False
    domain[0, 5] = True
    domain[2:4, 3] = False
    r = transport.solve(np.ones((6, 8)), domain, "lr")
    assert r["excluded_unanchored_cells"] == 0 and abs(r["energy"] - r["conductance"]) < 1e-9
    island = np.ones((7, 7), bool)
    island[2:5, 2:5] = False
    island[3, 3] = True
    assert transport.solve(np.ones((7, 7)), island, "lr")["excluded_unanchored_cells"] == 1
    with pytest.raises(ValueError, match="coincide"):
        transport.solve(np.ones((5, 1)), np.ones((5, 1), bool), "lr")


def test_contrast_and_phase_are_checked():
    with pytest.raises(ValueError, match="contrast"):
        transport.conductivity(F.lit(0.5), 1.0, "buildings")
    with pytest.raises(ValueError, match="phase"):
        transport.conductivity(F.lit(0.5), 10.0, "water")


# --- statistics -------------------------------------------------------------------------


def test_missing_p_values_are_not_counted(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", None), ("d", float("nan"))], "name string, p double")
    got = {r["name"]: r["p_adjusted"] for r in stats.benjamini_hochberg(p).collect()}
    assert got == {"a": 0.02, "b": 0.04, "c": None, "d": None}


@pytest.mark.parametrize(("t", "n"), [(2.228139, 10), (1.0, 1), (0.3, 7), (3.1, 22), (2.0, 2)])
def test_student_sum_agrees_with_the_fraction(spark, t, n):
    got = spark.range(1).select(stats.student_p(F.lit(t), F.lit(n)).alias("p")).first()["p"]
    assert abs(got - stats.student_tail(t, n)) < 1e-9


def test_normal_tail(spark):
    z = spark.createDataFrame([(x,) for x in (0.0, 0.5, 1.959964, 3.0, 9.0)], "z double")
    got = [r["p"] for r in z.select(stats.normal_tail(F.col("z")).alias("p")).collect()]
    assert np.allclose(got, [math.erfc(x / math.sqrt(2)) for x in (0.0, 0.5, 1.959964, 3.0)] + [0.0], atol=1e-9)


def test_retained_components_and_merges():
    assert stats.retained([0.95, 0.03, 0.02]) == 2 and stats.retained([0.5, 0.3, 0.15, 0.05]) == 3
    merges = stats.ward_merges(np.array([[0, 0], [0.1, 0], [5, 5], [5.1, 5]]))
    assert sorted(m[:2] for m in merges[:2]) == [(0, 1), (2, 3)] and merges[-1][3] == 4 and merges[-1][2] > merges[0][2]


def test_sweep_verdicts(spark):
    rows = [(0, 10.0, "ok", 1.50, 0.99, 7, 0.01, 100.0), (0, 20.0, "ok", 1.52, 0.99, 7, 0.02, 102.0), (0, 50.0, "ok", 1.9, 0.80, 7, 0.2, 500.0), (1, 10.0, "ok", 1.2, 0.99, 7, 0.01, None), (1, 20.0, "error", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "site long, pixel_size_m double, status string, D_build double, D_r2 double, D_n_points long, raster_area_error_rel double, spanning_radius_any_m double")
    got = {r["site"]: r for r in sweep.stability(df).collect()}
    assert got[0]["stable"] and got[0]["recommended_pixel_size_m"] == 15.0 and got[0]["n_runs_quality"] == 2
    assert not got[1]["stable"] and got[1]["recommended_pixel_size_m"] is None and got[1]["n_runs_ok"] == 1


# --- documents and reports --------------------------------------------------------------


def test_documents_with_bare_nan_and_broken_text(spark, tmp_path):
    for slug, text in (("a", '{"software": {"version": "1"}, "planar_boundary": {"area_m2": NaN}, "lacunarity_building_footprints": {"mean": 2.5}}'), ("b", "no document"), ("c", "")):
        at = tmp_path / "final" / "north" / slug
        at.mkdir(parents=True)
        (at / "summary.json").write_text(text)
    rows = {r["slug"]: r["doc"] for r in files.read_summaries(spark, str(tmp_path), summary.SCHEMA, mode="final").collect()}
    assert math.isnan(rows["a"]["planar_boundary"]["area_m2"]) and rows["b"] is None and rows.get("c") is None
    atlas = summary.atlas_rows(files.read_summaries(spark, str(tmp_path), summary.SCHEMA, mode="final").where("doc is not null")).first()
    assert atlas["plan_area_m2"] is None and atlas["lacunarity_mean"] == 2.5 and atlas["spanning_radius_lr_norm"] is None


def test_numbers_as_reports_print_them(spark):
    values = [0.0, 25.0, 0.1, 1234567.0, 0.0000123456, 999999.7, -2.5, 3.14159265, 100000.0, None]
    got = [r["t"] for r in spark.createDataFrame([(v,) for v in values], "v double").select(sc.general(F.col("v")).alias("t")).collect()]
    assert got == ["" if v is None else f"{v:.6g}" for v in values]


def test_report_escapes(spark):
    df = spark.createDataFrame([("<b>", 1.25), ("a|b", float("nan"))], "name string, v double")
    text = presentation.report("T & T", {"rows": df})
    assert "&lt;b&gt;" in text and "1.25" in text and "T &amp; T" in text
    assert "a\\|b" in presentation.markdown_table(df)
    assert presentation.ordered_columns(df.withColumn("b", F.lit(1)), ["v", "missing"]).columns == ["v", "b", "name"]


def test_mask_image(spark):
    domain = np.zeros((3, 3), bool)
    domain[:, 1:] = True
    mask = np.zeros((3, 3), bool)
    mask[1, 1] = True
    got = {(r["y"], r["x"]): r["value"] for r in presentation.mask_image(cells(spark, mask), cells(spark, domain), 3, 3).collect()}
    assert got[0, 0] is None and got[0, 1] == 0 and got[1, 1] == 1 and len(got) == 9


def test_boundary_metrics_and_choice(spark):
    square = [[{"x": 37.0, "y": 55.0}, {"x": 37.1, "y": 55.0}, {"x": 37.1, "y": 55.1}, {"x": 37.0, "y": 55.1}]]
    df = spark.createDataFrame([(0, [square])], "site long, polygons array<array<array<struct<x double, y double>>>>")
    m = boundary.metrics(df).first()
    side = math.radians(0.1) * 6371.0088
    assert abs(m["area_km2"] / (side * side * math.cos(math.radians(55.05))) - 1) < 0.01 and 12 < m["diagonal_km"] < 14
    rows = [(0, 1, False, "country"), (0, 2, True, "city"), (1, 1, True, "town")]
    got = {r["site"]: r["search"] for r in boundary.needs_search(spark.createDataFrame(rows, "site long, attempt int, accepted boolean, kind string")).collect()}
    assert got == {0: True, 1: False}


# --- sources ----------------------------------------------------------------------------


def test_catalog_index_and_lookup(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿subset,slug,name,query,morphotype\nnorth, a ,A,qa,x\nsouth,b,,qb,y\nnorth,c,C,qc,z\n")
    c = files.read_catalog(spark, str(tmp_path / "c.csv"), True)
    assert [(r["idx"], r["slug"]) for r in c.orderBy("idx").collect()] == [(0, "a"), (1, "c")]
    assert files.picked(c, 1).first()["slug"] == "c" and files.picked(c, slug="a").first()["idx"] == 0
    with pytest.raises(ValueError, match="outside"):
        files.picked(c, 2)
    assert files.read_catalog(spark, str(tmp_path / "c.csv"), trim=False, needed_values=()).count() == 3
    with pytest.raises(ValueError, match="lacks"):
        (tmp_path / "d.csv").write_text("subset,slug\na,b\n")
        files.read_catalog(spark, str(tmp_path / "d.csv"))


def test_manifest_and_side_tables(spark, tmp_path):
    a, b = spark.createDataFrame([("x", [1, 2])], "slug string, list array<int>"), spark.createDataFrame([("y", "ok")], "slug string, status string")
    files.write_manifest(files.union_manifests(a, b), str(tmp_path / "m"))
    assert {r["slug"]: r["status"] for r in json.loads((tmp_path / "m.json").read_text())} == {"x": None, "y": "ok"} and (tmp_path / "m.csv").read_text().startswith("list,slug,status")
    at = tmp_path / "north" / "a"
    at.mkdir(parents=True)
    (at / "p.csv").write_text("radius_m,beta0\n0,5\n25,3\n")
    rows = files.read_side_tables(spark, str(tmp_path), "p.csv", "radius_m double, beta0 double").collect()
    assert sorted((r["subset"], r["slug"], r["beta0"]) for r in rows) == [("north", "a", 3.0), ("north", "a", 5.0)]
    (at / "empty.csv").write_text("")
    assert files.nonempty(spark, str(tmp_path), "p.csv").count() == 1 and files.nonempty(spark, str(tmp_path), "empty.csv").count() == 0


def test_map_data_retries_and_gives_up(spark, tmp_path):
    calls = []

    def fetch(endpoint):
        calls.append(endpoint)
        if endpoint == "b" and len(calls) > 3:
            return "answer"
        raise OSError("down")

    assert osm.retried(fetch, ["a", "b"], 2, 0) == "answer" and calls == ["a", "a", "b", "b"]
    with pytest.raises(OSError, match="no endpoint"):
        osm.retried(lambda e: (_ for _ in ()).throw(ValueError("bad")), ["a"], 1, 0)
    geometry = [{"lon": x, "lat": y} for x, y in ((37.0, 55.0), (37.001, 55.0), (37.001, 55.001), (37.0, 55.001))]
    answer = {"elements": [{"type": "way", "id": 7, "tags": {"building": "yes", "height": "9", "secret": "x"}, "geometry": geometry}, {"type": "node", "id": 8}]}
    (tmp_path / "answer.json").write_text(json.dumps(answer))
    rows = osm.buildings(spark, "Town", endpoints=f"file:{tmp_path}/answer.json", attempts=1, wait_s=0).collect()
    assert [(r["osm_id"], r["attrs"], len(r["rings"][0])) for r in rows] == [(7, {"building": "yes", "height": "9"}, 4)]
    with pytest.raises(Exception, match="no endpoint"):
        osm.buildings(spark, "Town").count()


# --- whole sites ------------------------------------------------------------------------


def town(n, seed, lon=37.0, lat=55.0, size=0.02):
    """A GeoJSON town of n rectangles and its boundary, in degrees."""
    r = np.random.default_rng(seed)
    loop = lambda x0, y0, x1, y1: [[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]
    features = []
    for i in range(n):
        x, y = lon + size * r.random(), lat + size * r.random()
        w, h = 0.0002 + 0.0006 * r.random(2)
        features.append({"type": "Feature", "properties": {"height": str(3 + i % 9)} if i % 3 else {"building:levels": "2"}, "geometry": {"type": "Polygon", "coordinates": loop(x, y, x + w, y + h)}})
    edge = [{"type": "Feature", "properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [loop(lon, lat, lon + size, lat + size)]}}]
    return [json.dumps({"type": "FeatureCollection", "features": f}) for f in (features, edge)]


def test_inputs_are_checked(spark, tmp_path):
    with pytest.raises(ValueError, match="needed"):
        site.load_inputs(spark, site.AnalysisConfig())
    with pytest.raises(FileNotFoundError):
        files.read_vector(spark, str(tmp_path / "none.geojson"))
    with pytest.raises(SystemExit):
        cli.configuration(cli.parser().parse_args(["site", "--buildings", "x", "--transport-phases", "water"]))
    with pytest.raises(ValueError, match="unknown mode"):
        jobs.configured(site.AnalysisConfig(), "fast")


def test_one_site_from_the_command_line(spark, tmp_path):
    own, edge = town(60, 1)
    (tmp_path / "b.geojson").write_text(own)
    (tmp_path / "e.geojson").write_text(edge)
    cli.main(["site", "--buildings", str(tmp_path / "b.geojson"), "--boundary", str(tmp_path / "e.geojson"), "--out", str(tmp_path / "out"), "--topology", "--topology-radii", "0,1,2", "--min-scaling-points", "5", "--multifractal", "--transport"], spark)
    doc = json.loads((tmp_path / "out" / "summary.json").read_text())
    assert doc["building_surfaces"]["n_buildings"] > 40 and 0.5 < doc["fractal_dimension_building_footprints"]["dimension"] < 2
    assert doc["raster_diagnostics"]["boundary_raster_area_error_rel"] < 0.02 and doc["two_phase_transport"]["status"] == "ok"
    assert doc["two_phase_transport"]["max_energy_identity_relative_error"] < 1e-5 and doc["planar_boundary"]["fallback_used"] is False
    assert doc["topological_morphology_building_footprints"]["beta0_at_zero"] > 5 and len(doc["multifractal_spectrum_building_footprints"]) >= 3
    assert "core_2d_analysis_pass" in doc["quality_control"]


def test_batch_and_atlas(spark, tmp_path):
    lines = ["subset,slug,name,query,morphotype"]
    for i in range(4):
        subset = "russia" if i % 2 else "world"
        at = tmp_path / "data" / subset / f"t{i}"
        at.mkdir(parents=True)
        own, edge = town(40 + 10 * i, i)
        (at / "buildings.geojson").write_text(own)
        (at / "boundary.geojson").write_text(edge)
        lines.append(f"{subset},t{i},Town {i},q{i},m")
    lines.append("world,missing,Missing,q,m")
    (tmp_path / "c.csv").write_text("\n".join(lines) + "\n")
    batch = jobs.Batch(str(tmp_path / "c.csv"), str(tmp_path / "data"), str(tmp_path / "results"), "topology", slugs=("t0", "t1", "missing"))
    cfg = site.AnalysisConfig(topology_radii_px=(0, 1, 2), height_scenarios_m=(12.0,), min_scaling_points=4)
    first = {r["slug"]: r["status"] for r in jobs.run(spark, batch, cfg).collect()}
    assert first == {"t0": "ok", "t1": "ok", "missing": "missing_data"}
    again = {r["slug"]: r["action"] for r in jobs.planned(spark, batch, jobs.configured(cfg, "topology")).collect()}
    assert again == {"t0": "skip", "t1": "skip", "missing": "missing_data"}
    catalog = files.read_catalog(spark, str(tmp_path / "c.csv"))
    audit = {r["slug"]: r["fail_reasons"] for r in jobs.audit(spark, catalog, str(tmp_path / "data"), str(tmp_path / "results"), "topology").collect()}
    assert "result_missing" in audit["t2"] and "data_missing" in audit["missing"] and "transport_missing" in audit["t0"] and "result_missing" not in audit["t0"]
    wide = jobs.collected(spark, str(tmp_path / "results"))
    assert wide.count() == 2 and wide.columns == sorted(wide.columns) and "building_surfaces.n_buildings" in wide.columns


def test_atlas_statistics(spark):
    r = np.random.default_rng(5)
    rows = []
    for i in range(24):
        a = r.normal(3 * (i % 3), 0.3)
        rows.append(("russia" if i % 2 else "world", f"s{i}", True, float(a), float(a * 2 + 1), float(r.normal()), None if i % 10 == 0 else float(r.normal(i % 3, 0.2)), 5.0))
    df = spark.createDataFrame(rows, "subset string, slug string, analysis_eligible boolean, D_build double, lacunarity_mean double, foreground_fraction double, Dq_1 double, compactness_boundary double")
    t = jobs.atlas_statistics(spark, df, rounds=10, features=("D_build", "lacunarity_mean", "foreground_fraction", "Dq_1", "compactness_boundary"))
    status = {x["feature"]: (x["status"], x["redundant_with"]) for x in t["feature_redundancy"].collect()}
    assert status["lacunarity_mean"] == ("drop_redundant", "D_build") and status["D_build"][0] == "keep" and "compactness_boundary" not in status
    assert t["clusters"].count() == 24 and t["merges"].count() == 23 and t["stability_summary"].count() == 2 and t["group_tests"].count() >= 2
    assert all(x["p_fdr_bh"] >= x["p"] - 1e-12 for x in t["group_tests"].collect())
    with pytest.raises(ValueError, match="only"):
        jobs.atlas_statistics(spark, df.limit(2))


def test_sweep_of_one_site(spark, tmp_path):
    own, edge = town(50, 9)
    (tmp_path / "b.geojson").write_text(own)
    (tmp_path / "e.geojson").write_text(edge)
    cfg = site.AnalysisConfig(buildings_path=str(tmp_path / "b.geojson"), boundary_path=str(tmp_path / "e.geojson"), height_scenarios_m=(12.0,), min_scaling_points=4)
    runs, verdict = site.resolution_sweep(spark, *site.load_inputs(spark, cfg), cfg, (25.0, 50.0, -1.0, 5000.0), True)
    got = {r["pixel_size_m"]: r["status"] for r in runs.collect()}
    assert got[25.0] == got[50.0] == "ok" and set(got) == {25.0, 50.0, 5000.0} and verdict.first()["n_runs_total"] == 3


def test_metric_grids(spark):
    df = spark.createDataFrame([(3.0, 0.0)], "lon double, lat double")
    r = df.select(g.web_mercator(F.col("lon"), F.col("lat")).alias("w"), g.utm(F.col("lon"), F.col("lat"), F.lit(30), F.lit(False)).alias("u")).first()
    assert abs(r["w"]["x"] - 333958.4724) < 1e-3 and abs(r["w"]["y"]) < 1e-6 and r["u"]["x"] == 500_000
