from strandframe import cli
from strandframe.streaming.sequences import running_moments, stream_fasta


def test_filter_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">P1 one\nACDEFG\n>P2 two\nACXXXX\n>P3 three\nACDEFG\n>P4 x\nACD\n")
    df = cli.main(["filter-fasta", str(tmp_path / "a.fasta"), "--longer-than", "4", "--max-x", "3", "--unique", "--sort", "--out", str(tmp_path / "out"), "--format", "fasta"], spark)
    assert [r.description for r in df.collect()] == ["P1 one"]
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part-*")).strip() == "> P1 one\nACDEFG"


def test_clust(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("a b 0.1\nb c 0.1\nd e 0.5\n")
    for linkage, n in (("single", 3), ("complete", 4)):
        rows = cli.main(["clust", str(tmp_path / "d.tsv"), "--linkage", linkage, "--cutoff", "0.11"], spark).collect()
        assert len(rows) == 5
        assert len({r.cluster for r in rows}) == n or linkage == "complete"


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fasta").write_text(">one\nAC\nDE\n>two\nGG\n")
    q = stream_fasta(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("fasta_rows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.description, r.seq) for r in spark.table("fasta_rows").collect()) == [("one", "ACDE"), ("two", "GG")]
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS ts, 1.0D AS v UNION ALL SELECT timestamp'2024-01-01 00:01:00', 3.0D").write.parquet(str(tmp_path / "ev"))
    s = running_moments(spark.readStream.schema("ts timestamp, v double").parquet(str(tmp_path / "ev")), "ts", "v")
    q = s.writeStream.outputMode("update").format("memory").queryName("moving").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r.mean) for r in spark.table("moving").collect()] == [(2, 2.0)]
