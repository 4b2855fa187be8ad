import pytest

from strandframe.functions.scoring import blosum62
from strandframe.operators import align

SCORES = blosum62()


@pytest.mark.parametrize(
    "query, template, path, score, rows",
    [("A", "AW", "*-", -6, ("A-", "AW")), ("AR", "ARK", "**-", -1, ("AR-", "ARK")), ("MAVRLLKTHL", "MKNITCYL", "*||*******", -2, ("MAVRLLKTHL", "M--KNITCYL"))],
)
def test_global(query, template, path, score, rows):
    assert align.global_alignment(query, template, SCORES, -10, -2) == (score, path)
    assert align.aligned_strings(path, query, template) == rows
    assert align.global_alignment(template, query, SCORES, -10, -2)[0] == score


@pytest.mark.parametrize(
    "query, template, rows, starts, score",
    [
        ("MNPQRAAVVGSTKLTQAAIDYKGYEVNVRHDF", "WCEGAVVGSTKLSQAAIKGYEVTVKLPF", ("AVVGSTKLTQAAIDYKGYEVNVRHDF", "AVVGSTKLSQAAI--KGYEVTVKLPF"), (6, 4), 77),
        ("GHMTRQILDSLGNPTAEEVKAAFDKLMNQERWP", "PPYQILDSLGAEEVRAAFDKLQERFA", ("QILDSLGNPTAEEVKAAFDKLMNQERW", "QILDSLG---AEEVRAAFDKL--QERF"), (5, 3), 72),
        ("TSAILDSLGAEEIRAYLP", "MQRPILDSLGNPTAEEVKAFHW", ("ILDSLG---AEEIRAY", "ILDSLGNPTAEEVKAF"), (3, 4), 40),
    ],
)
def test_local(query, template, rows, starts, score):
    got, path, a, b = align.local_alignment(query, template, SCORES, -10, -2)
    assert (got, (a, b)) == (score, starts)
    assert align.aligned_strings(path, query[a:], template[b:]) == rows


def test_matrix_values():
    assert [SCORES.score(*p) for p in ("CC", "WW", "AW", "AA")] == [9, 11, -3, 4]


def test_all_pairs(spark):
    df = spark.createDataFrame([(0, "ARNDC"), (1, "ARNDC"), (2, "WWWWW")], "ord long, seq string")
    got = {(r.q, r.t): r.percent_identity for r in align.align_all_pairs(df).collect()}
    assert got[(1, 0)] == 100.0 and set(got) == {(1, 0), (2, 0), (2, 1)}
    assert align.align_all_pairs(df, low=50.0).count() == 1
