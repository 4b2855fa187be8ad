"""Streams of sequences: records arriving in a folder, and running statistics over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_fasta(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """description, seq of plain FASTA files as they arrive."""
    rows = spark.readStream.option("lineSep", ">").option("maxFilesPerTrigger", max_files).text(folder).where(F.trim("value") != "")
    head = F.trim(F.regexp_extract("value", r"(?s)^([^\n]*)", 1))
    seq = F.regexp_replace(F.regexp_extract("value", r"(?s)^[^\n]*\n(.*)$", 1), r"\s", "")
    return rows.select(head.alias("description"), seq.alias("seq")).where("seq <> ''")


def running_moments(stream: DataFrame, time: str, x: str, window: str = "5 minutes", late: str = "10 minutes", keys: tuple[str, ...] = ()) -> DataFrame:
    """Count, extremes, mean and sample variance of each time window, with late rows up to a watermark."""
    v = F.col(x).cast("double")
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.var_samp(v).alias("var_samp"))
