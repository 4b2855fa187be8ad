"""Shared storage for intermediate tables, and ranks that no single task has to count."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only on local[...] where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="strandframe-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """Write narrow rows to the checkpoint folder and go on from there, without the plan before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write wide rows as a Parquet table in the shared folder and read them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/strandframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandframe_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete what `table` wrote; nothing that is still to be computed may read it."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._strandframe_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def ordered_rank(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Number all rows from 0 in order, without gaps and without a task that holds all of them.

    Rows are dealt by ranges of `order` and written with their range, whose sizes then give each
    range its first number. Rows that tie are numbered in any order.
    """
    part, first = f"__part_{out}", f"__first_{out}"
    dealt = cut(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    sizes = dealt.groupBy(part).agg(F.count(F.lit(1)).alias(first))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range only
    starts = sizes.select(part, F.coalesce(F.sum(first).over(before), F.lit(0)).alias(first))
    within = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return dealt.withColumn(out, within).join(F.broadcast(starts), part).withColumn(out, F.col(out) + F.col(first)).drop(part, first)


def salted_rank(df: DataFrame, keys: list[str], row_id: str, out: str, salts: int = 256) -> DataFrame:
    """Number the rows of each key from 0 without gaps.

    A key's rows are dealt over `salts` lots by a hash of `row_id`; a window numbers each lot and
    the lots' sizes give each lot its first number. No task holds a whole key, so a key with a
    third of all rows is no hot spot. Rows with equal `row_id` are numbered in any order.
    """
    lot, first, size, within = (f"__{x}_{out}" for x in ("lot", "first", "size", "within"))
    dealt = df.withColumn(lot, F.pmod(F.xxhash64(F.col(row_id)), F.lit(salts)).cast("int"))
    numbered = dealt.withColumn(within, F.row_number().over(Window.partitionBy(*keys, lot).orderBy(row_id)) - 1)
    sizes = dealt.groupBy(*keys, lot).agg(F.count(F.lit(1)).alias(size))
    before = Window.partitionBy(*keys).orderBy(lot).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn(first, F.coalesce(F.sum(size).over(before), F.lit(0))).drop(size)
    return numbered.join(starts, [*keys, lot]).withColumn(out, (F.col(first) + F.col(within)).cast("long")).drop(lot, first, within)
