"""Hierarchies: lineages, nearest rank, and names found in descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions.chemistry import RANKS
from strandframe.functions.sequences import blank_punctuation
from strandframe.operators.state import cut


def closure(nodes: DataFrame, max_depth: int = 128) -> DataFrame:
    """id, ancestor, up: every node with itself (up = 0) and each ancestor. nodes: id, parent.

    Paths double in length each round, so depth d takes log2(d) joins; a node that is its own
    parent, or whose parent is missing, is a root.
    """
    parents = cut(nodes.select("id", F.when(F.col("parent") != F.col("id"), F.col("parent")).alias("parent")))
    known = parents.select(F.col("id").alias("ancestor"))
    paths = cut(parents.where("parent is not null").join(known, F.col("parent") == F.col("ancestor")).select("id", "ancestor", F.lit(1).alias("up")))
    reach = 1
    while reach < max_depth:
        top = paths.where(F.col("up") == reach).select(F.col("id"), F.col("ancestor").alias("via"))
        further = paths.select(F.col("id").alias("via"), "ancestor", "up")
        more = cut(top.join(further, "via").select("id", "ancestor", (F.col("up") + reach).cast("int").alias("up")))
        if more.isEmpty():
            break
        paths = cut(paths.unionByName(more))
        reach *= 2
    return paths.unionByName(parents.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("up")))


def save(nodes: DataFrame, names: DataFrame, folder: str, mode: str = "error") -> None:
    """Keep a read dump as Parquet, which loads without parsing."""
    for part, df in (("nodes", nodes), ("names", names)):
        df.write.mode(mode).parquet(f"{folder.rstrip('/')}/{part}")


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """nodes and names as they were saved."""
    return tuple(spark.read.parquet(f"{folder.rstrip('/')}/{part}") for part in ("nodes", "names"))


def lineage(paths: DataFrame, ids: DataFrame) -> DataFrame:
    """id, depth, ancestor for the listed ids: depth 0 is the root."""
    own = paths.join(ids.select("id").distinct(), "id", "left_semi")
    top = own.groupBy("id").agg(F.max("up").alias("top"))
    return own.join(top, "id").select("id", (F.col("top") - F.col("up")).alias("depth"), "ancestor")


def nearest_rank(paths: DataFrame, nodes: DataFrame, rank: str) -> DataFrame:
    """id, ancestor: the node itself or its nearest ancestor of a rank; ids without one do not appear."""
    of_rank = nodes.where(F.lower("rank") == rank.lower()).select(F.col("id").alias("ancestor"))
    return paths.join(of_rank, "ancestor").groupBy("id").agg(F.min_by("ancestor", "up").alias("ancestor"))


def rank_table(paths: DataFrame, nodes: DataFrame, ranks: list[str]) -> DataFrame:
    """One row for each id, one column for each rank: the ancestor's name or null."""
    named = paths.join(nodes.select(F.col("id").alias("ancestor"), F.lower("rank").alias("rank"), "name"), "ancestor")
    return named.groupBy("id").pivot("rank", [r.lower() for r in ranks]).agg(F.min_by("name", "up"))


def names_of(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """All names of the taxa in `wanted` (tax_id), sorted."""
    got = names.join(wanted.select("tax_id").distinct(), "tax_id", "left_semi")
    return got.groupBy("tax_id").agg(F.array_sort(F.collect_set("name")).alias("names"))


def taxids_of(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """name, tax_id of the names in `wanted`, matched exactly; the least id of a name that several taxa share."""
    got = names.join(wanted.select("name").distinct(), "name", "left_semi")
    return got.groupBy("name").agg(F.min("tax_id").alias("tax_id"))


def rank_order(rank) -> object:
    """Place of a rank's name in the order of preference; unknown ranks come last."""
    out = F.lit(255)
    for i, r in enumerate(RANKS):
        out = F.when(F.lower(rank) == r, i).otherwise(out)
    return out


def match_names(texts: DataFrame, names: DataFrame, id_col: str = "ord", text: str = "description", max_words: int = 8) -> DataFrame:
    """id, tax_id, name: the best of all names that stand in each text as whole words.

    names: name, tax_id, rank_order. Texts and names lose punctuation. Runs of 1 to max_words words
    of a text meet the names in an equi-join. Best is the least rank order, then most words, then
    the name. Names of more words are found by their own length if max_words is raised.
    """
    words = texts.select(id_col, F.filter(F.split(blank_punctuation(text), " "), lambda w: w != "").alias("__w"))
    longest = F.least(F.size("__w"), F.lit(max_words))
    runs = F.flatten(F.transform(F.filter(F.sequence(F.lit(1), F.greatest(longest, F.lit(1))), lambda k: k <= F.size(F.col("__w"))), lambda k: F.transform(F.sequence(F.lit(1), F.size(F.col("__w")) - k + 1), lambda i: F.array_join(F.slice(F.col("__w"), i, k), " "))))
    parts = words.select(id_col, F.explode(F.array_distinct(runs)).alias("__key"))
    keyed = names.withColumn("__key", F.trim(blank_punctuation("name"))).withColumn("__n", F.size(F.split("__key", " ")))
    met = parts.join(keyed, "__key")
    best = met.groupBy(id_col).agg(F.min(F.struct("rank_order", (-F.col("__n")).alias("words"), "name", "tax_id")).alias("m"))
    return best.select(id_col, F.col("m.tax_id").alias("tax_id"), F.col("m.name").alias("name"))
