import math

import pytest
from pyspark.sql import functions as F

from strandframe.functions import geometry as G
from strandframe.operators import building, clustering, spatial, stats


def test_histogram(spark):
    df = spark.createDataFrame([(x,) for x in (1.11, 1.49, 1.51, -0.1)], "x double")
    assert {r.bin: r.weight for r in stats.histogram(df, "x", 0.5).collect()} == {2: 2.0, 3: 1.0, -1: 1.0}
    nd = spark.createDataFrame([(2.9, -0.5)], "x double, y double")
    assert tuple(stats.histogram_nd(nd, ["x", "y"], [1.0, 0.5]).first()) == (2, -1, 1.0)


def test_densities(spark):
    row = spark.range(1).select(stats.normal_pdf(F.lit(1.0), 2.0, 1.5), stats.normal_pdf(F.lit(1.0), 0.0, 3.0)).first()
    assert row[0] == pytest.approx(0.21297, abs=1e-5) and row[1] == pytest.approx(0.12579, abs=1e-5)
    df = spark.createDataFrame([(1.0, 0.0)], "a double, b double")
    assert df.select(stats.multinormal_logpdf(["a", "b"], [0.1, 0.1], [[0.2, 0.1], [0.1, 2.0]])).first()[0] == pytest.approx(-3.469637, abs=1e-6)


def test_weighted(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 3.0), (100.0, 0.0)], "x double, w double")
    r = stats.weighted_moments(df, ["x"], "w").first()
    assert (r.mean_x, r.var_x) == (2.5, 0.75)


def test_autocorrelation_forms_agree(spark):
    df = spark.createDataFrame([(1, i, float((i * 7) % 5)) for i in range(20)], "k int, i int, x double")
    a = [r.value for r in stats.autocorrelation(df, "i", ["x"], 5).orderBy("lag").collect()]
    b = [r.value for r in stats.autocorrelation_fft(df, ["k"], "i", ["x"]).orderBy("lag").limit(6).collect()]
    assert a == pytest.approx(b)


def test_geometry(spark):
    p = [G.vec(*v) for v in ((1, 0, 0), (0, 0, 0), (0, 1, 0), (0, 1, 1))]
    row = spark.range(1).select(G.planar_angle3(*p[:3]), G.dihedral_angle4(*p), G.det(G.matrix([[2, 0, 0], [0, 3, 0], [0, 0, 4]])), G.apply(G.around_axis((0, 0, 0), (1, 1, 1), 2 * math.pi / 3), G.vec(1, 2, 3))).first()
    assert row[0] == pytest.approx(math.pi / 2) and abs(row[1]) == pytest.approx(math.pi / 2) and row[2] == 24.0
    assert tuple(row[3]) == pytest.approx((3, 1, 2))


def test_build_matches_measure(spark):
    rows = [(1, *x[:1], *x[2:]) for x in building.backbone_definition(10, -60.0, -40.0)]
    xyz = building.build_chains(spark.createDataFrame(rows, "chain int, ord long, r double, planar double, dihedral double"), ["chain"]).orderBy("ord").collect()
    pts = [G.vec(r.x, r.y, r.z) for r in xyz[6:10]]
    got = spark.range(1).select(F.degrees(G.dihedral_angle4(*pts)), G.distance(pts[2], pts[3])).first()
    assert got[0] == pytest.approx(-40.0, abs=1e-6) and got[1] == pytest.approx(1.329, abs=1e-6)


def test_grid_join_against_all_pairs(spark):
    pts = [(i, (i * 37 % 50) / 10, (i * 11 % 40) / 10, (i * 7 % 30) / 10) for i in range(120)]
    df = spark.createDataFrame(pts, "id long, x double, y double, z double")
    got = {(r.a_id, r.b_id) for r in spatial.within(df, df, ["x", "y", "z"], 0.8).collect()}
    assert got == {(a[0], b[0]) for a in pts for b in pts if math.dist(a[1:], b[1:]) <= 0.8}
    assert spatial.neighbors(df, "id", ["x", "y", "z"], 0.8).count() == 120


def test_dendrogram():
    import numpy as np

    x = [6, 2, 2.5, 5.9]
    d = np.abs(np.subtract.outer(x, x))
    merges = clustering.dendrogram(d, "single")
    assert sorted(map(sorted, clustering.cut_tree(merges, 4, 1.0))) == [[0, 3], [1, 2]]
    assert [x[i] for i in clustering.balance(merges, 4, d)] in ([6, 5.9, 2.5, 2], [2, 2.5, 5.9, 6])
    for rule in clustering.LINKAGES:
        assert len(clustering.dendrogram(d, rule)) == 3


def test_kmeans_and_components(spark):
    pts = [(i, [float(i % 2 * 10 + i / 10), 0.0]) for i in range(12)]
    df = spark.createDataFrame(pts, "id long, features array<double>")
    got = {r.id: r.cluster for r in clustering.kmeans(df, 2, repeats=2)[0].collect()}
    assert len({got[i] for i in range(0, 12, 2)}) == 1 and got[0] != got[1]
    d = spark.createDataFrame([(0, 1, 0.1), (1, 2, 0.1), (3, 4, 0.1), (0, 4, 5.0)], "i long, j long, d double")
    one = {r.id: r.cluster for r in clustering.single_link(d, spark.range(6), 0.11).collect()}
    assert one == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}


def test_optics_small():
    pts = [0.0, 0.1, 0.2, 5.0, 5.1, 9.0]
    near = {i: sorted((abs(a - b), j) for j, b in enumerate(pts) if abs(a - b) <= 1) for i, a in enumerate(pts)}
    order, reach = clustering.optics_order(near, 6, 1.0, 2)
    assert sorted(map(sorted, clustering.optics_clusters(order, reach, 1.0))) == [[0, 1, 2], [3, 4], [5]]


def test_greedy_clusters():
    assert clustering.greedy_clusters([(0, "MKTAYIAKQRQISFVKSHFTRQ"), (1, "MKTAYIAKQRQISFVKSHFTRA"), (2, "GGGGGGGGGGGGGGGGGGGGGG")], 0.9) == [[0, 1], [2]]
