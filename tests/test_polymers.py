import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandframe import cli
from strandframe.functions import entities as E
from strandframe.functions import geometry as G
from strandframe.operators import align, building, clustering, polymers, spatial, state, taxonomy
from strandframe.plans import polymer_queries as Q
from strandframe.sources import files, writers


@pytest.fixture(scope="module")
def known(spark):
    return Q._definitions(spark).cache()


def _chain(spark, n):
    return spark.createDataFrame([("p", i, "aa_") for i in range(n)], "chain string, res_ord int, block string")


def test_patched_polymer(spark, known):
    ends = spark.createDataFrame([("p", 1, "patch_end")], "chain string, res_ord int, block string")
    atoms = polymers.patch(polymers.polymer(_chain(spark, 2), known, ["chain"]), ends, known, ["chain"])
    assert [(r["first"], r["last"], r["n_atoms"]) for r in polymers.atom_ranges(atoms, ["chain"]).orderBy("res_ord").collect()] == [(0, 3, 4), (4, 8, 5)]
    got = polymers.build(atoms, ["chain"]).orderBy("ord").collect()
    assert [r.name.strip() for r in got] == ["N", "CA", "C", "O", "N", "CA", "C", "O", "OXT"]
    xyz = np.array([[r.x, r.y, r.z] for r in got])
    assert np.linalg.norm(xyz[4] - xyz[2]) == pytest.approx(1.33)  # the bond between the residues
    assert np.linalg.norm(xyz[8] - xyz[6]) == pytest.approx(1.22) and np.linalg.norm(xyz[7] - xyz[6]) == pytest.approx(1.25)
    assert polymers.named_dihedrals(atoms, "Phi", ["chain"]).first().dihedral == pytest.approx(np.radians(-120))


def test_faults_of_polymers_raise(spark, known):
    for atoms in (polymers.polymer(_chain(spark, 2), known, ["chain"]),):  # the last O stands on an N that is not there
        with pytest.raises(PySparkException, match="no atom"):
            polymers.references(atoms, ["chain"]).collect()
    with pytest.raises(PySparkException, match="no definition"):
        polymers.polymer(_chain(spark, 1).withColumn("block", F.lit("other")), known, ["chain"]).collect()
    beyond = spark.createDataFrame([("p", 7, "patch_end")], "chain string, res_ord int, block string")
    with pytest.raises(PySparkException, match="no residue"):
        polymers.patch(polymers.polymer(_chain(spark, 2), known, ["chain"]), beyond, known, ["chain"]).collect()
    with pytest.raises(ValueError, match="ring"):
        building.build_order(np.array([[0, 0, 0], [0, 0, 0], [0, 0, 0], [0, 1, 4], [0, 1, 3]]))


def test_kinds(spark):
    one = spark.createDataFrame([("x", None)], "a string, b string")
    assert one.select(E.polymer_kind(F.lit("a DNA/RNA hybrid")).alias("k"), E.polymer_kind("b").alias("n")).first() == ("DNA", None)
    for f in (E.entity_kind, E.polymer_kind, E.source_kind, E.parse_bool, E.locator):
        assert one.select(f("b")).first()[0] is None
        with pytest.raises(PySparkException):
            one.select(f(F.lit("?!"))).collect()


def test_ordered_rank(spark):
    rng = np.random.default_rng(0)
    values = [int(x) for x in rng.permutation(500)]
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(5)
    assert all(r.v == r.k for r in state.ordered_rank(df, ["v"], "k").collect())
    assert state.ordered_rank(df.limit(0), ["v"], "k").count() == 0


def test_point_medoids_over_tiles(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x, c = rng.normal(size=(60, 3)), [i % 2 for i in range(60)]
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], c[i]) for i in range(60)], "id long, v array<double>, c int")
    monkeypatch.setattr(spatial, "TILE", 7)
    got = {r.cluster: (r.id, round(r.distance, 9)) for r in spatial.point_medoids(df, "id", "v", "c").collect()}
    for k in (0, 1):
        own = [i for i in range(60) if c[i] == k]
        worst = {i: max(float(np.linalg.norm(x[i] - x[j])) for j in own) for i in own}
        best = min(own, key=lambda i: (worst[i], i))
        assert got[k] == (best, round(worst[best], 9))


def test_reports_share_one_table(spark):
    pairs = spark.createDataFrame([("ACD", "A-D", 1), ("AAA", "AAA", 2)], "q string, t string, k int")
    out = align.reports(pairs, {"rows": lambda d: d.select("k"), "text": lambda d: d.select(align.pairwise_blocks("q", "t", F.lit("query"), F.lit("t"), 5, 2).alias("v"))})
    assert sorted(r.k for r in out["rows"].collect()) == [1, 2]
    assert any(r.v.startswith("query     1 AC     2\n            | ") for r in out["text"].collect())


def test_tree_walks():
    merges = clustering.dendrogram(np.array([[0, 1, 5], [1, 0, 4], [5, 4, 0]], dtype=float))
    assert clustering.in_preorder(merges, 4, 3) == [4, 2, 3, 0, 1]
    assert clustering.in_order(merges, 4, 3) == [2, 4, 0, 3, 1]
    turned = clustering.mirrored(merges, 4, 3)
    assert clustering.in_order(turned, 4, 3) == clustering.in_order(merges, 4, 3)[::-1]
    assert clustering.mirrored(merges, 3, 3)[1] == merges[1] and clustering.mirrored(turned, 4, 3) == merges


def test_random_seeds_are_distinct(spark):
    df = spark.createDataFrame([([float(i % 5), 0.0],) for i in range(40)], "features array<double>")
    got = clustering.random_seeds(df, 3, 7)
    assert len({tuple(x) for x in got}) == 3 and clustering.random_seeds(df, 3, 7) == got and len(clustering.random_seeds(df, 9, 7)) == 5


def test_path_counts(spark):
    df = spark.createDataFrame([("**-*|",), ("",), (None,)], "p string")
    assert [r[0] and tuple(r[0]) for r in df.select(align.path_counts("p")).collect()] == [(3, 1, 1), (0, 0, 0), None]
    with pytest.raises(PySparkException, match="no alignment steps"):
        spark.createDataFrame([("*x",)], "p string").select(align.path_counts("p")).collect()


def test_identity_matrix_changes_nothing(spark):
    v = G.vec(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    a, b = spark.range(1).select(v, G.mat_vec(G.identity(), v)).first()
    assert a == b


def test_saved_taxonomy_and_blocks(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 1, "no rank", "root")], "id long, parent long, rank string, name string")
    names = spark.createDataFrame([(1, "root")], "tax_id long, name string")
    taxonomy.save(nodes, names, str(tmp_path / "tax"))
    assert [d.collect() for d in taxonomy.load(spark, str(tmp_path / "tax"))] == [nodes.collect(), names.collect()]
    (tmp_path / "a.cif").write_text("data_x\n_a.b 'c d'\nloop_\n_l.i\n_l.j\n1 2\n3 ?\n")
    values = files.read_cif(spark, str(tmp_path / "a.cif"))
    text = writers.cif_block_text(values).first().value
    assert text == "data_x\n_a.b 'c d'\nloop_\n_l.i\n_l.j\n1 2\n3 ?\n"


def test_commands(spark, tmp_path):
    (tmp_path / "n.txt").write_text("".join(f"{i % 2 * 10 + i / 100} {i / 100}\n" for i in range(20)))
    run = lambda *a: cli.main([a[0], str(tmp_path / "n.txt"), *a[1:]], spark)
    assert {r.n for r in run("kmeans", "--clusters", "2").groupBy("cluster").agg(F.count("*").alias("n")).collect()} == {10}
    assert run("optics", "--radius", "2", "--min-points", "3", "--min-size", "5").select("cluster").distinct().count() == 2
    assert run("normal").count() > 0
    (tmp_path / "m.sto").write_text("# STOCKHOLM 1.0\na AC-D\nb ACCD\n//\n")
    rows = cli.main(["stockholm-to-fasta", str(tmp_path / "m.sto"), "--ungapped"], spark)
    assert sorted(r.seq for r in rows.collect()) == ["ACCD", "ACD"]
