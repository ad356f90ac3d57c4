import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmorph.functions import geometry as g
from gridmorph.operators import atlas, fractal, raster, stats, topology, transport


def cells(spark, mask):
    y, x = np.nonzero(mask)
    return spark.createDataFrame([(0, int(a), int(b)) for a, b in zip(y, x, strict=True)], "site long, y long, x long")


def block(n, *spans):
    m = np.zeros((n, n), bool)
    for a, b, c, d in spans:
        m[a:b, c:d] = True
    return m


def profile(spark, mask, connectivity=1):
    c = cells(spark, mask).withColumn("r", F.lit(0).cast("long"))
    return topology.component_profile(c, *mask.shape, connectivity).first()


def test_filled_square_has_dimension_two(spark):
    d = fractal.box_dimension(fractal.box_counts(cells(spark, np.ones((64, 64), bool)), (2, 4, 8, 16, 32))).first()
    assert abs(d["dimension"] - 2) < 0.1 and d["r2"] > 0.99


def test_uniform_field_has_lacunarity_one(spark):
    c = cells(spark, np.ones((32, 32), bool))
    assert all(abs(r["lacunarity"] - 1) < 1e-12 for r in fractal.lacunarity(c, c, (4, 8), 32, 32).collect())


def test_square_and_ring(spark):
    s = profile(spark, block(20, (5, 15, 5, 15)))
    assert (s["beta0"], s["beta1"], s["chi"], s["largest"]) == (1, 0, 1, 100)
    m = block(30, (5, 25, 5, 25))
    m[10:20, 10:20] = False
    r = profile(spark, m)
    assert (r["beta0"], r["beta1"], r["chi"], r["largest"]) == (1, 1, 0, 300)


def test_diagonal_pair_by_connectivity(spark):
    m = np.zeros((5, 5), bool)
    m[1, 1] = m[2, 2] = True
    assert profile(spark, m, 1)["beta0"] == 2 and profile(spark, m, 2)["beta0"] == 1


def test_island_does_not_span(spark):
    m = block(30, (10, 20, 10, 20))
    assert profile(spark, m)["spans_lr"] == 0
    m[14:16] = True
    r = profile(spark, m)
    assert (r["spans_lr"], r["spans_tb"]) == (1, 0)


def test_dilation_merges_blobs(spark):
    near = topology.distances(cells(spark, block(40, (10, 14, 10, 14), (10, 14, 20, 24))), 4, 40, 40)
    out = {r["r"]: r["beta0"] for r in topology.component_profile(topology.dilated(near, [0, 4]), 40, 40).collect()}
    assert out == {0: 2, 4: 1}


def test_chi_equals_local_euler_count(spark):
    m = np.random.default_rng(0).random((30, 30)) < 0.4
    local = m.sum() - (m[:, 1:] & m[:, :-1]).sum() - (m[1:] & m[:-1]).sum() + (m[1:, 1:] & m[1:, :-1] & m[:-1, 1:] & m[:-1, :-1]).sum()
    assert profile(spark, m)["chi"] == local


def test_carpet_is_monofractal(spark):
    m = np.ones((1, 1))
    for _ in range(4):
        m = np.kron(m, [[1, 1, 1], [1, 0, 1], [1, 1, 1]])
    c = cells(spark, m > 0).withColumn("mass", F.lit(1.0))
    raw = fractal.moments(c, (1, 3, 9, 27), (-2.0, -1.0, 0.0, 1.0, 2.0))
    assert all(abs(r["probability_sum"] - 1) < 1e-12 for r in raw.collect())
    spec = fractal.spectrum(raw)
    assert all(abs(r["Dq"] - math.log(8) / math.log(3)) < 1e-9 for r in spec.collect())
    assert fractal.order_diagnostics(spec).first()["monotone"]


def test_homogeneous_conductance():
    s = transport.solve(np.ones((20, 20)), np.ones((20, 20), bool), "lr")
    assert s["converged"] and abs(s["conductance"] - 20 / 19) < 1e-9 and abs(s["energy"] - s["conductance"]) < 1e-9


def test_l_domain_and_overlap(spark):
    ring = [(0, 0), (100, 0), (100, 40), (40, 40), (40, 100), (0, 100)]
    rows = [(0, 1, 1.0, [[{"x": float(a), "y": float(b)} for a, b in ring]])]
    schema = "site long, feature long, value double, rings array<array<struct<x double, y double>>>"
    got = {(r["y"], r["x"]) for r in raster.rasterized(spark.createDataFrame(rows, schema), 0.0, 100.0, 10, 10, 10.0).collect()}
    assert len(got) == 64 and (1, 8) not in got

    def box(x0, y0, x1, y1):
        return [[{"x": float(a), "y": float(b)} for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]]

    two = spark.createDataFrame([(0, 1, 10.0, box(0, 0, 2, 2)), (0, 2, 20.0, box(1, 0, 3, 2))], schema)
    h = {(r["y"], r["x"]): r["value"] for r in raster.burned(raster.rasterized(two, 0.0, 2.0, 2, 3, 1.0)).collect()}
    assert h == {(y, x): 10.0 if x == 0 else 20.0 for y in range(2) for x in range(3)}


def test_shared_wall(spark):
    h = spark.createDataFrame([(0, y, x, 10.0) for y in range(10) for x in range(20)], "site long, y long, x long, value double")
    r = raster.layered_extrusion(h).first()
    assert (r["volume"], r["roof_area"], r["wall_area"]) == (2000.0, 200.0, 600.0)


@pytest.mark.parametrize(("text", "metres"), [("12", 12.0), ("12,5 m", 12.5), ("10 ft", 3.048), ("none", None), ("-3", None), ("", None), (None, None)])
def test_height_literals(spark, text, metres):
    got = spark.createDataFrame([(text,)], "t string").select(g.parsed_height(F.col("t")).alias("h")).first()["h"]
    assert got is None if metres is None else abs(got - metres) < 1e-12


def test_fdr_and_redundancy(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.20)], "name string, p double")
    got = {r["name"]: round(r["p_adjusted"], 6) for r in stats.benjamini_hochberg(p).collect()}
    assert got == {"a": 0.04, "b": 0.053333, "c": 0.053333, "d": 0.2}
    assert stats.redundant(["a", "b", "c"], {("b", "a"): 1.0, ("c", "a"): 0.1}) == ["a", "c"]


def test_silhouette_and_ward(spark):
    x = np.array([[0, 0], [0.1, 0], [5, 5], [5.1, 5]])
    labels = stats.ward(x, 2)
    assert labels[0] == labels[1] != labels[2] == labels[3]
    pts = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels, strict=True))], "id long, vec array<double>, label long")
    assert min(r["silhouette"] for r in stats.silhouette(pts).collect()) > 0.9


def test_student_tail():
    assert abs(stats.student_tail(2.228139, 10) - 0.05) < 1e-6
    assert abs(stats.student_tail(1.0, 1) - 0.5) < 1e-9


def test_harmonized_twins_agree(spark):
    rows = [(s, r / k, float(v)) for s, k in ((0, 100.0), (1, 200.0)) for r, v in zip((10, 20, 40) if s == 0 else (20, 40, 80), (8, 6, 4), strict=True)]
    out = [r["mean_value"] for r in stats.harmonized(spark.createDataFrame(rows, "site long, rho double, b double"), "b").collect()]
    assert abs(out[0] - out[1]) < 1e-12


def test_audit_and_reuse(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.99), (3, None)], "id long, r2 double")
    got = {r["id"]: (r["quality_status"], r["fail_reasons"]) for r in atlas.audited(df, {"low_r2": F.col("r2") < 0.95, "missing": F.col("r2").isNull()}, {}).collect()}
    assert got == {1: ("fail", "low_r2"), 2: ("pass", ""), 3: ("fail", "missing")}
    left = atlas.outstanding(df.select("id"), df, ["id"], atlas.compatible({"r2": F.col("r2")}, {"r2": 0.99}))
    assert sorted(r["id"] for r in left.collect()) == [1, 3]


def test_default_radii():
    assert topology.default_radii(328) == [0, 1, 2, 3, 4, 5, 6, 8, 10, 13, 17, 22, 29, 38, 49, 63, 82]


def test_sources(spark, tmp_path):
    from gridmorph.sources import files

    (tmp_path / "c.csv").write_text('subset,slug,name,query,morphotype\nworld, a ,A,"A, B",x\nworld,,B,q,y\n')
    cat = files.selected(files.read_catalog(spark, str(tmp_path / "c.csv"), True), "world").collect()
    assert [(r["slug"], r["query"]) for r in cat] == [("a", "A, B")]
    (tmp_path / "f.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"height":"7"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,0]]]}}]}')
    f = files.read_geojson(spark, str(tmp_path / "f.geojson")).first()
    assert f["attrs"]["height"] == "7" and len(f["rings"][0]) == 4


def test_registered_queries_have_their_sql():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_projections_hit_known_points(spark):
    points = spark.createDataFrame([(3.0, 0.0), (-79.387139, 43.642567), (180.0, 90.0)], "lon double, lat double")
    rows = points.select(g.utm(F.col("lon"), F.col("lat")).alias("u"), g.equal_area(F.col("lon"), F.col("lat")).alias("e")).collect()
    assert rows[0]["u"]["x"] == 500_000 and rows[0]["u"]["y"] == 0
    assert abs(rows[1]["u"]["x"] - 630_084) < 1 and abs(rows[1]["u"]["y"] - 4_833_439) < 1
    assert abs(4 * rows[2]["e"]["x"] * rows[2]["e"]["y"] / 1e6 - 510_065_621.724) < 1  # the ellipsoid's surface


def test_cluster_count_finds_the_groups(spark):
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(c, 0.05, (8, 3)) for c in (0, 3, 9, 20)])
    out = {row["k"]: row for row in stats.cluster_count(spark, x).collect()}
    assert set(out) == set(range(2, 9)) and [k for k in out if out[k]["chosen"]] == [4] and out[4]["silhouette"] > 0.9


def test_cluster_stability_query_runs_a_hundred_rounds(spark):
    from gridmorph.plans import morphology

    rows = morphology.QUERIES["cluster_stability"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 2 and all(r["n"] == 50 for r in rows)
