from strandframe.functions import sequences as S
from strandframe.functions.ids import id_text, parse_ids
from strandframe.operators import sequences as O


def test_motif():
    assert S.motif_to_regex("C-x(2,4)-[ST]-{P}-x") == "C.{2,4}[ST][^P]."
    assert S.motif_to_regex("<A-x>") == "^A.$"


def test_predicates(spark):
    df = spark.createDataFrame([("ACGT", ), ("", ), ("AC-T", ), ("MKX*", )], "seq string")
    got = df.select(S.is_nucleic(), S.is_protein(), S.contains_x(1), S.shorter_than(4), S.longer_than(4)).collect()
    assert [tuple(r) for r in got] == [(True, True, False, True, True), (True, True, False, True, False), (False, False, False, True, True), (False, True, True, True, True)]


def test_gaps_and_identity(spark):
    row = spark.createDataFrame([("A-CD_", "AACDE")], "a string, b string").select(S.ungapped("a"), S.len_ungapped("a"), S.count_identical("a", "b"), S.count_aligned("a", "b"), S.percent_identity("a", "b"), S.a3m_to_fasta("a")).first()
    assert tuple(row) == ("ACD", 3, 3, 3, 100.0, "A-CD_")


def test_alignment_operators(spark):
    rows = [(0, "r", "A-C-"), (1, "s", "AGC-"), (2, "t", "TGC-")]
    msa = spark.createDataFrame([(1, *r) for r in rows], "msa long, ord long, description string, seq string")
    assert [r.seq for r in O.remove_gapped_columns(msa, ["msa"]).orderBy("ord").collect()] == ["A-C", "AGC", "TGC"]
    assert [r.seq for r in O.remove_gaps_by_reference(msa, "A-C-").orderBy("ord").collect()] == ["AC", "AC", "TC"]
    assert [r.seq for r in O.trim_by_reference(msa, "-GC-").orderBy("ord").collect()] == ["-C", "GC", "GC"]
    assert O.consensus(msa, ["msa"]).first().consensus == "AGC-"
    assert O.longest_sequence(msa, ["msa"]).first().ord == 1
    assert O.medoid_sequence(msa, ["msa"]).first().ord == 1
    check = O.check_msa(msa, ["msa"]).first()
    assert (check.n, check.equal_lengths, check.unique_names, check.common_length) == (3, True, True, 4)
    cttaga = spark.createDataFrame([(1, i, "x", s) for i, s in enumerate(("cttaga", "ctcaga", "ctaagg", "cttaga"))], "msa long, ord long, description string, seq string")
    assert O.profile(cttaga, ["msa"], "acgt").where("pos = 0 and aa = 'c'").first().fraction == 1.0


def test_subsequence_hits_do_not_overlap(spark):
    df = spark.createDataFrame([(0, "AAAAB")], "ord long, seq string")
    got = O.find_subsequences(df, spark.createDataFrame([("AA",), ("B",), ("Z",)], "query string")).orderBy("query", "start").collect()
    assert [(r.query, r.start, r.end, r.percent) for r in got] == [("AA", 0, 2, 40.0), ("AA", 2, 4, 40.0), ("B", 4, 5, 20.0)]


def test_ids():
    kinds = lambda d: [(k, v) for _, _, k, v in sorted(parse_ids(d))]
    assert kinds(" EU958043 ") == [("GenBank", "EU958043")]
    assert kinds("[taxid=9606]") == [("TaxId", "9606")]
    assert kinds("dbj|BAE93469.1") == [("DDBJ", "BAE93469.1")]
    assert kinds("2[4Fe-4S]ST9|2FDN") == [("PDB", "2FDN")]
    assert "|".join(id_text(k, v) for k, v in kinds("sp|A0A009IHW8|ABTIR_ACIB9 2' domain [taxid=1310613]")) == "sp|A0A009IHW8|ABTIR_ACIB9|taxid=1310613"
    assert [k for k, _ in kinds("gi|5524211|gb|AAD44166.1| cytochrome b [Elephas maximus maximus]")] == ["GenBank", "NCBIGI", "Organism"]
    assert len(kinds("taxid=123,234|")) == 2
    assert len(kinds(">pdb|2aza|pdb|2gb1|pdb_00002aza")) == 3
    assert kinds("something else") == [("Default", "something")]


def test_queries_beyond_a_lot_lose_nothing(spark, monkeypatch):
    from strandframe.operators import sequences, spatial

    df = spark.createDataFrame([(1, "aaaa banana x"), (2, None), (3, "nanana"), (4, "")], "ord long, seq string")
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(["aa", "nana", "an", "x", "", "aa", "é"])], "item long, query string")
    rows = lambda d: sorted((r.ord, r.item, r.hit, r.start, r.end, round(r.percent, 6)) for r in d.collect())
    whole = rows(sequences.find_subsequences(df, asked))
    assert (1, 0, 1, 0, 2, round(200 / 13, 6)) in whole and (1, 0, 2, 2, 4, round(200 / 13, 6)) in whole and (3, 1, 1, 0, 4, round(400 / 6, 6)) in whole
    monkeypatch.setattr(sequences, "BROADCAST_ROWS", 2)
    assert rows(sequences.find_subsequences(df, asked)) == whole and len(whole) == 2 * 2 + 2 + 4 + 1
    points = spark.createDataFrame([(i, [float(i * i % 37), float(i % 5)]) for i in range(60)], "id long, v array<double>")
    near = lambda: sorted(map(tuple, spatial.nearest(points, points, "id", "v", other_only=True).collect()))
    one = near()
    monkeypatch.setattr(spatial, "BROADCAST_POINTS", 7)
    assert near() == one and len(one) == 60


def test_frequent_kmers_are_dealt_into_lots(spark, monkeypatch):
    df = spark.createDataFrame([(i, "ACDE" if i % 3 else "ACDF") for i in range(30)], "ord long, seq string")
    whole = {(r.i, r.j, r.shared) for r in O.kmer_overlaps(df, 3).collect()}
    monkeypatch.setattr(O, "LOT_HOLDERS", 4)
    assert {(r.i, r.j, r.shared) for r in O.kmer_overlaps(df, 3).collect()} == whole
    assert whole == {(i, j, 2 if bool(i % 3) == bool(j % 3) else 1) for i in range(30) for j in range(i + 1, 30)}
