"""Queries on tables with keys beyond those of the driver's small tables."""

import shutil

import pytest
from pyspark.sql import functions as F

from strandframe.plans.queries import ORACLES, QUERIES
from tests.test_queries import SF, _rows

KEYS = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey"}


@pytest.fixture
def grown(spark, tmp_path):
    """f(shift of the keys by table) -> (folder of tables with a few rows of large keys, the rows of a query and of its SQL there)."""
    import duckdb

    def of(name: str, **shifts: int):
        con = duckdb.connect()
        shutil.copytree(SF, tmp_path / "t")
        for t in (p.name.removesuffix(".parquet") for p in (tmp_path / "t").iterdir()):
            at = str(tmp_path / "t" / f"{t}.parquet")
            if t in shifts:
                rows = spark.read.parquet(f"{SF}/{t}.parquet")
                more = rows.orderBy(KEYS[t]).limit(40).withColumn(KEYS[t], F.col(KEYS[t]) + shifts[t])
                at = str(tmp_path / f"{t}.parquet")
                rows.unionByName(more).coalesce(1).write.parquet(at)
                shutil.rmtree(tmp_path / "t" / f"{t}.parquet", ignore_errors=True)
                (tmp_path / "t" / f"{t}.parquet").unlink(missing_ok=True)
                shutil.move(at, tmp_path / "t" / f"{t}.parquet")
                at = str(tmp_path / "t" / f"{t}.parquet" / "*.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}'")
        return _rows(QUERIES[name](spark, str(tmp_path / "t")).toPandas()), _rows(con.execute(ORACLES[name]).df())

    return of


def test_uniprot_keys_of_six_digits(grown):
    got, wanted = grown("uniprot_round_trip", customer=123_400)
    assert got == wanted


def test_structures_with_numbers_beyond_their_columns(grown):
    got, wanted = grown("structures_of_any_format", customer=890_000)
    assert got == wanted


def test_written_texts_are_of_bounded_files(spark, monkeypatch):
    from strandframe.plans import structure_queries as Q

    monkeypatch.setattr(Q, "FILE_ROWS", 10)
    path = Q._written(spark.range(35).coalesce(1).selectExpr("cast(id as string) as value"), "bounded")
    sizes = [r["n"] for r in spark.read.text(path).groupBy("_metadata.file_path").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sorted(sizes) == [5, 10, 10, 10]
