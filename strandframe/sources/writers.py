"""Text forms of tables and their sinks. Rows become text in the tasks; Spark writes the parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions.sequences import fasta_text, sanitize_file_name
from strandframe.operators.structure import atom_line


def write_fasta(df: DataFrame, path: str, width: int = 80, mode: str = "error") -> None:
    df.select(fasta_text(width).alias("value")).write.mode(mode).text(path)


def write_fasta_each(df: DataFrame, path: str, name: Column, width: int = 80, mode: str = "error") -> None:
    """A folder for each sequence, named by a file-safe form of `name`."""
    df.select(fasta_text(width).alias("value"), sanitize_file_name(name).alias("file")).write.mode(mode).partitionBy("file").text(path)


def write_pdb(atoms: DataFrame, path: str, mode: str = "error") -> None:
    """ATOM records, sorted within deposits and models."""
    lines = atoms.select("deposit_id", "model", "atom_ord", atom_line().alias("value"))
    lines.repartition("deposit_id").sortWithinPartitions("deposit_id", "model", "atom_ord").select("deposit_id", "value").write.mode(mode).partitionBy("deposit_id").text(path)


def stockholm_text(msa: DataFrame, keys: list[str], width: int = 40) -> DataFrame:
    """keys, value: each alignment as Stockholm text; an alignment's own size bounds the row."""
    row = F.concat(F.rpad(F.substring("description", 1, width), width, " "), F.lit(" "), F.col("seq"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", row.alias("r")))), lambda x: x["r"]), "\n")
    return msa.groupBy(*keys).agg(F.concat(F.lit("# STOCKHOLM 1.0\n"), rows, F.lit("\n//\n")).alias("value"))


def cif_text(values: DataFrame) -> DataFrame:
    """path, value: items of each block, sorted by name, as CIF text."""
    quoted = F.when(F.col("value").rlike(r"\s") | (F.col("value") == ""), F.concat(F.lit("'"), "value", F.lit("'"))).otherwise(F.col("value"))
    lines = values.where("kind = 'item'").select("path", "block", F.concat_ws(" ", "name", quoted).alias("line"))
    return lines.groupBy("path", "block").agg(F.concat(F.lit("data_"), F.first("block"), F.lit("\n"), F.array_join(F.array_sort(F.collect_list("line")), "\n"), F.lit("\n")).alias("value")).select("path", "value")


def cif_loop_text(values: DataFrame) -> DataFrame:
    """path, block, loop_idx, value: each loop as CIF text, columns sorted by name, a row on a line."""
    quoted = F.when(F.col("value").rlike(r"\s") | (F.col("value") == ""), F.concat(F.lit("'"), "value", F.lit("'"))).otherwise(F.col("value"))
    own = values.where("kind = 'loop'").withColumn("cell", quoted)
    first = own.where("row_idx = 0").groupBy("path", "block_idx", "block", "loop_idx").agg(F.collect_list("name").alias("names"))
    rows = own.groupBy("path", "block_idx", "loop_idx", "row_idx").agg(F.map_from_entries(F.collect_list(F.struct("name", "cell"))).alias("cells"))
    lines = rows.join(first, ["path", "block_idx", "loop_idx"]).withColumn("names", F.array_sort("names"))
    line = F.struct("row_idx", F.array_join(F.transform("names", lambda n: F.element_at("cells", n)), " ").alias("line"))
    body = lines.groupBy("path", "block", "loop_idx").agg(F.first("names").alias("names"), F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]).alias("lines"))
    return body.select("path", "block", "loop_idx", F.array_join(F.concat(F.array(F.lit("loop_")), "names", "lines"), "\n").alias("value"))


def cif_block_text(values: DataFrame) -> DataFrame:
    """path, value: whole blocks as CIF text: items first, then loops in their order."""
    items = cif_text(values.withColumn("path", F.struct("path", "block"))).select(F.col("path.path").alias("path"), F.col("path.block").alias("block"), F.col("value").alias("items"))
    loops = cif_loop_text(values).groupBy("path", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("loop_idx", "value"))), lambda x: x["value"]), "\n").alias("loops"))
    both = items.join(loops, ["path", "block"], "full")
    head = F.coalesce("items", F.concat(F.lit("data_"), "block", F.lit("\n")))
    return both.select("path", F.concat(head, F.coalesce(F.concat("loops", F.lit("\n")), F.lit(""))).alias("value"))


def deposit_info(deposits: DataFrame) -> DataFrame:
    """path, info: a deposit's metadata as JSON."""
    return deposits.select("path", F.to_json(F.struct(*(c for c in deposits.columns if c != "path"))).alias("info"))
