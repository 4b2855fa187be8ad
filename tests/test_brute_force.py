"""Operators that SQL cannot express, against plain versions over all possibilities."""

from functools import lru_cache

import numpy as np
import pytest

from strandframe.functions.scoring import blosum62
from strandframe.operators import align, clustering

LETTERS = "ARNDCQEGHILKMFPSTWYV"


def _best_score(q, t, scores, first, more, local):
    """Affine gaps by trying every length of the last gap."""
    pair = lambda a, b: int(scores.rows[scores.letters.index(a), scores.letters.index(b)])
    gap = lambda n: first + (n - 1) * more

    @lru_cache(None)
    def best(i, j):
        if i == 0 and j == 0:
            return 0
        options = [0] if local else []
        if i and j:
            options.append(best(i - 1, j - 1) + pair(q[i - 1], t[j - 1]))
        options += [best(i - n, j) + gap(n) for n in range(1, i + 1)] + [best(i, j - n) + gap(n) for n in range(1, j + 1)]
        return max(options)

    return max(best(i, j) for i in range(len(q) + 1) for j in range(len(t) + 1)) if local else best(len(q), len(t))


@pytest.mark.parametrize("seed", range(12))
def test_alignment_scores(seed):
    rng = np.random.default_rng(seed)
    q, t = ("".join(rng.choice(list(LETTERS), rng.integers(1, 13))) for _ in range(2))
    scores = blosum62()
    for first, more in ((-10, -2), (-4, -1), (-3, -3)):
        assert align.global_alignment(q, t, scores, first, more)[0] == _best_score(q, t, scores, first, more, False)
        assert align.local_alignment(q, t, scores, first, more)[0] == _best_score(q, t, scores, first, more, True)


@pytest.mark.parametrize("linkage", ["single", "complete", "average"])
def test_merges_equal_linkage_over_all_members(linkage):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(14, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    of = {"single": np.min, "complete": np.max, "average": np.mean}[linkage]
    held, n = {i: [i] for i in range(len(d))}, len(d)
    for node, left, right, far, size in clustering.dendrogram(d, linkage):
        apart = {(a, b): of(d[np.ix_(held[a], held[b])]) for a in held for b in held if a < b}
        assert far == pytest.approx(min(apart.values())) and apart[min(left, right), max(left, right)] == pytest.approx(far)
        held[node] = held.pop(left) + held.pop(right)
        assert size == len(held[node])
    assert list(map(len, held.values())) == [n]


def test_kmeans_ends_at_a_fixed_point(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.2, size=(20, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, features array<double>")
    got, centers, _ = clustering.kmeans(df, 3, repeats=3)
    rows = {r.id: (r.cluster, r.cost) for r in got.collect()}
    d2 = ((x[:, None] - np.array(centers)[None]) ** 2).sum(axis=2)
    assert [rows[i][0] for i in range(len(x))] == d2.argmin(axis=1).tolist()
    assert [rows[i][1] for i in range(len(x))] == pytest.approx(d2.min(axis=1))
    for k, c in enumerate(centers):
        assert x[d2.argmin(axis=1) == k].mean(axis=0) == pytest.approx(c)
    assert sorted(np.bincount(d2.argmin(axis=1))) == [20, 20, 20]


def test_optics_clusters_are_parts_of_the_eps_graph(spark):
    rng = np.random.default_rng(7)
    x, eps, least = rng.uniform(0, 10, size=(120, 2)), 0.9, 3
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, x double, y double")
    rows = {r.id: (r.cluster, r.reachability) for r in clustering.optics(df, "id", ["x", "y"], eps, least).collect()}
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= eps
    core = near.sum(axis=1) >= least
    part = list(range(len(x)))  # cores within eps of each other share a part
    for i in range(len(x)):
        for j in range(len(x)):
            if core[i] and core[j] and near[i, j] and part[i] != part[j]:
                part = [part[i] if p == part[j] else p for p in part]
    for i in range(len(x)):
        for j in range(len(x)):
            if core[i] and core[j]:
                assert (rows[i][0] == rows[j][0]) == (part[i] == part[j])
        if not core[i] and not (near[i] & core).any():
            assert all(rows[i][0] != rows[j][0] for j in range(len(x)) if j != i)  # alone


def test_identity_clusters_hold_the_level(spark):
    rng = np.random.default_rng(9)
    seqs = []
    for _ in range(6):
        base = rng.choice(list(LETTERS), 60)
        for _ in range(4):
            own = base.copy()
            own[rng.integers(0, 60, 2)] = "A"
            seqs.append("".join(own))
    df = spark.createDataFrame(list(enumerate(seqs)), "ord long, seq string")
    rows = clustering.bucket_clustering(df, 0.9, lots=3).collect()
    of = {r.ord: r.cluster for r in rows}
    assert {i: i // 4 for i in of} == {i: sorted(set(of.values()), key=lambda c: min(k for k in of if of[k] == c)).index(of[i]) for i in of}


def test_components_of_few_links_take_no_rounds(spark, monkeypatch):
    import random

    from strandframe.operators import components

    rng = random.Random(3)
    links = spark.createDataFrame([(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(None, 1), (7, 7)], "u long, v long")
    monkeypatch.setattr(components, "FEW_LINKS", 0)
    rounds = sorted(map(tuple, components.connected_components(links).collect()))
    monkeypatch.setattr(components, "FEW_LINKS", 1 << 18)
    monkeypatch.setattr(components, "large_star", None)
    assert sorted(map(tuple, components.connected_components(links).collect())) == rounds


def test_greedy_clusters_align_few_pairs(monkeypatch):
    """Names that share most words: the common letters decide what word counts leave open."""
    calls, align_ = [], clustering.global_alignment
    monkeypatch.setattr(clustering, "global_alignment", lambda *a: calls.append(1) or align_(*a))
    items = [(i, f"Supplier#{i * 7919 % 60000:09d}") for i in range(40)]
    items += [(i + 40, s) for i, s in items]
    got = clustering.greedy_clusters(items, 0.9)
    assert sorted(x for c in got for x in c) == list(range(80)) and len(calls) <= 80
    assert all({x % 40 for x in c} == {x for x in c if x < 40} for c in got)
    assert clustering.common_letters("ABCBDAB", "BDCABA") == 4
    assert clustering.greedy_clusters([(0, "A-"), (1, "A-"), (2, ""), (3, "")], 0.9) == [[0], [1], [2], [3]]


def test_identities_and_medoids_by_tiles(spark, monkeypatch):
    """Several tiles, gaps, rows of other lengths, null rows, an alignment of one row; letters are not walked in the plan."""
    import random

    from strandframe.functions import sequences as S
    from strandframe.operators import sequences

    monkeypatch.setattr(sequences, "TILE_ROWS", 7)
    monkeypatch.setattr(sequences, "BLOCK_PAIRS", 20)
    monkeypatch.setattr(S, "count_identical", None)
    rng = random.Random(5)
    rows = [(m, i, "".join(rng.choice("AC-_é") for _ in range(9 if i % 5 else 8))) for m in "ab" for i in range(25)] + [("a", 50, None), ("b", 51, "---------"), ("c", 1, "ACD")]
    msa = spark.createDataFrame(rows, "msa string, ord int, seq string")
    same = lambda x, y: None if x is None or y is None or len(x) != len(y) else sum(p == q and p not in "-_" for p, q in zip(x, y, strict=True))
    short = lambda x, y: min(sum(c not in "-_" for c in s) for s in (x, y))
    wanted, best = {}, {}
    for m, i, x in rows:
        least = []
        for n, j, y in rows:
            if m == n and i != j:
                v = same(x, y)
                least.append(v)
                if i > j:
                    wanted[m, i, j] = (v, None if v is None or not short(x, y) else 100.0 * v / short(x, y))
        known = [v for v in least if v is not None]
        if least:
            key = (min(known) if known else -1, sum(c not in "-_" for c in x or ""), -i)
            best[m] = max(best.get(m, ((-2,),)), (key, i))
    got = sequences.identity_pairs(msa, ["msa"]).collect()
    assert {(r.msa, r.i, r.j): (r.identical, r.percent) for r in got} == wanted and len(got) == len(wanted)
    assert {r.msa: r.ord for r in sequences.medoid_sequence(msa, ["msa"]).collect()} == {m: b[1] for m, b in best.items()}


def test_clusters_of_points_equal_those_of_all_distances(spark):
    from pyspark.sql import functions as F

    from strandframe.operators.spatial import squared_distance

    rng = np.random.default_rng(11)
    rows = [(int(k), i, [float(v) for v in rng.normal(rng.integers(0, 3), 0.6, 2)]) for i, k in enumerate(rng.integers(0, 3, 150))] + [(9, 1000, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "key int, id long, v array<float>")
    a, b = df.select("key", F.col("id").alias("i"), F.col("v").alias("a")), df.select("key", F.col("id").alias("j"), F.col("v").alias("b"))
    d = a.join(b, "key").where("i < j").select("key", "i", "j", F.sqrt(squared_distance("a", "b")).alias("d"))
    for linkage in clustering.REDUCIBLE:
        wanted = [tuple(r) for r in clustering.hierarchical(d, ["key"], linkage, 0.5).collect()]
        got = [tuple(r) for r in clustering.hierarchical_points(df, ["key"], "id", "v", linkage, 0.5).collect()]
        assert sorted(got) == sorted([*wanted, (9, 1000, 0)])  # a point alone in its key is a cluster
        assert 0 < len({g[::2] for g in got}) < len(got) - 20
    with pytest.raises(ValueError):
        clustering.hierarchical_points(df, ["key"], "id", "v", "centroid", 0.5)


def test_large_dendrogram_ends_in_time():
    import time

    rng = np.random.default_rng(12)
    x = rng.normal(size=(1500, 8))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    began = time.process_time()
    merges = clustering.dendrogram(d, "average")
    assert len(merges) == 1499 and merges[-1][4] == 1500
    assert sum(map(len, clustering.cut_tree(merges, 1500, float(np.median(d))))) == 1500
    assert time.process_time() - began < 4


def test_optics_orders_points_without_a_list_of_pairs(spark, monkeypatch):
    from strandframe.operators import spatial

    rng = np.random.default_rng(13)
    x = np.round(rng.uniform(0, 12, size=(400, 2)), 1)  # with equal points and equal distances
    x[300:] += 100
    eps, least = 0.8, 3
    apart = np.sqrt((x[:, None, 0] - x[None, :, 0]) ** 2 + (x[:, None, 1] - x[None, :, 1]) ** 2)
    near = {i: sorted((float(apart[i, j]), j) for j in range(len(x)) if apart[i, j] <= eps) for i in range(len(x))}
    order, reach = clustering.optics_order(near, len(x), eps, least)
    part = list(range(len(x)))
    for _ in x:
        part = [min(part[j] for _, j in near[i]) for i in range(len(x))]
    head = {p: g[0] for g in clustering.optics_clusters(order, reach, eps) for p in g}
    counted, wanted = {}, {}
    for p in order:
        wanted[p] = (head[p], counted.get(part[p], 0), reach[p])
        counted[part[p]] = counted.get(part[p], 0) + 1
    monkeypatch.setattr(spatial, "within", None)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(900, None, 1.0)], "id long, x double, y double")
    got = {r.id: (r.cluster, r.position, r.reachability) for r in clustering.optics(df, "id", ["x", "y"], eps, least).collect()}
    assert got == wanted


def test_rounding_equals_that_of_columns(spark):
    from pyspark.sql import functions as F

    from strandframe.operators.spatial import rounded

    rng = np.random.default_rng(14)
    halves = (rng.integers(0, 10**9, 3000) * 10 + 5) / 10.0**7
    x = np.concatenate([rng.uniform(-50, 50, 3000), halves, -halves, 100.0 * np.arange(1, 19) / 18, [0.0, 1e14, 2.5e-7, 1.0000005]])
    wanted = [r[0] for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, v double").orderBy("i").select(F.round("v", 6)).collect()]
    assert rounded(x, 6).tolist() == wanted


def test_identity_pairs_round_in_their_tiles(spark, monkeypatch):
    from pyspark.sql import functions as F

    from strandframe.operators import sequences

    monkeypatch.setattr(sequences, "TILE_ROWS", 10)
    rng = np.random.default_rng(15)
    rows = [(1, i, "".join(rng.choice(list("AC-"), 7 + (i % 9 == 0)))) for i in range(45)] + [(1, 45, None), (1, 46, "-------")]
    msa = spark.createDataFrame(rows, "msa int, ord long, seq string")
    plain = sequences.identity_pairs(msa, ["msa"]).withColumn("percent", F.round("percent", 6)).collect()
    assert sorted(map(str, sequences.identity_pairs(msa, ["msa"], digits=6).collect())) == sorted(map(str, plain)) and len(plain) == 47 * 46 // 2


def _model_atoms(spark, n, deposits=2):
    rng = np.random.default_rng(16)
    rows = []
    for d in range(deposits):
        at, ord_ = rng.uniform(-9, 9, size=(n, 3)), 0
        for r in range(n):
            for k in range(1 + r % 3):
                x, y, z = (float(v) for v in np.round(at[r] + rng.normal(0, 0.8, 3), 1))
                rows.append((f"d{d}", 1, ord_, "ABC"[r % 3], r, " ", " X  ", x, None if r == 5 else y, z))
                ord_ += 1
    kinds = "deposit_id string, model int, atom_ord int, chain_id string, res_seq int, i_code string, name string, x double, y double, z double"
    return spark.createDataFrame(rows, kinds), rows


def _apart(a, b):
    return None if a[8] is None or b[8] is None else float(np.sqrt((a[7] - b[7]) * (a[7] - b[7]) + (a[8] - b[8]) * (a[8] - b[8]) + (a[9] - b[9]) * (a[9] - b[9])))


def _top_down(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_distance_map_sends_pairs_on_without_a_shuffle(spark, monkeypatch):
    from strandframe.operators import structure

    atoms, rows = _model_atoms(spark, 40)
    wanted = {}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[4] > b[4]:
                d, key = _apart(a, b), (a[0], a[4], b[4])
                wanted[key] = d if wanted.get(key) is None else wanted[key] if d is None else min(d, wanted[key])
    for block in (structure.BLOCK, 60):
        monkeypatch.setattr(structure, "BLOCK", block)
        got = structure.distance_map(atoms, 7)
        assert {(r.deposit_id, r.a_res_ord, r.b_res_ord): r.distance for r in got.collect()} == wanted and got.count() == len(wanted)
    plan = _top_down(structure.distance_map(atoms, 7))
    assert plan.index("MapInArrow") < plan.index("Exchange")


def test_contacts_of_many_atoms_in_little_space(spark, monkeypatch):
    from strandframe.operators import spatial, structure

    atoms, rows = _model_atoms(spark, 90)
    wanted = {(a[0], a[2], b[2]): _apart(a, b) for a in rows for b in rows if a[0] == b[0] and a[4] > b[4]}
    for block, cutoff in ((spatial.BLOCK, 3.0), (40, 1.7)):
        monkeypatch.setattr(spatial, "BLOCK", block)
        monkeypatch.setattr(spatial, "BATCH", block)
        near = {k: d for k, d in wanted.items() if d is not None and d <= cutoff}
        found = structure.contacts(atoms, cutoff).collect()
        assert {(r.a_deposit_id, r.a_atom_ord, r.b_atom_ord): r.distance for r in found} == near and len(found) == len(near) > 50
        assert all((r.a_res_seq, r.b_name, r.b_chain_id) == (r.a_res_ord, " X  ", "ABC"[r.b_res_ord % 3]) for r in found)
    plan = _top_down(structure.contacts(atoms, 3.0, ["atom_ord"]))
    assert "Join" not in plan and plan.index("MapInArrow") < plan.index("Exchange")


def test_contacts_are_measured_in_small_blocks_and_sent_in_few_batches():
    import tracemalloc

    from strandframe.operators import spatial

    rng = np.random.default_rng(17)
    x, rank = rng.uniform(0, 6, size=(1500, 3)), np.arange(1500)
    tracemalloc.start()
    blocks, peak = 0, 0
    for a, _, _ in spatial._ranked_neighbours(x, rank, np.ones(1500, bool), 4.0):
        blocks, peak = blocks + 1, max(peak, tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert blocks > 10 and peak < 8_000_000
    apart = [(np.arange(n), np.full(n, float(n))) for n in (3, 0, 4, 1, 9, 2)]
    got = list(spatial.gathered(iter(apart), 8))
    assert [len(i) for i, _ in got] == [8, 9, 2] and np.concatenate([d for _, d in got]).tolist() == np.concatenate([d for _, d in apart]).tolist()
    assert list(spatial.gathered(iter([]), 8)) == []


def test_distance_maps_are_measured_in_small_blocks():
    import tracemalloc

    from strandframe.operators import structure

    rng = np.random.default_rng(18)
    r, x = np.arange(2000), rng.uniform(0, 20, size=(2000, 3))
    tracemalloc.start()
    pairs, peak = 0, 0
    for i, _, _ in structure._least_distances(r, x, r, x):
        pairs, peak = pairs + len(i), max(peak, tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert pairs == 2000 * 1999 // 2 and peak < 8_000_000
