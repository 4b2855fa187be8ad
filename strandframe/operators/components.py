"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.operators.state import cut

#: Links that one task may join by itself; more go through the stars.
FEW_LINKS = 1 << 18


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all nodes of the links, by union-find under the lesser root."""
    root: dict = {}

    def find(x):
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = list(root)
    for i in range(0, len(nodes), 10_000):
        part = nodes[i : i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([find(x) for x in part], kind)], ["node", "component"])


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """u, m: the least of u and its neighbours. Cut off, so that a join may split a hot u."""
    return cut(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))


def large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of u to the least of u and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbour(both)
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Link u and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least_neighbour(down)
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """node, component: component is the least node reachable; nodes without a link do not appear.

    Edges are any orderable ids; null ends, loops and repeated links are ignored. FEW_LINKS whole
    numbers at most are joined in one task, whose memory they bound. More go in rounds: each is
    a partial aggregate and a join on the node, cut at the shared folder; a round which changes
    no edge ends the loop. Nothing but two numbers a round reaches the driver.
    """
    edges = cut(links.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null and u <> v").distinct())
    kinds = {edges.schema[c].dataType.simpleString() for c in ("u", "v")}
    if kinds in ({"int"}, {"bigint"}) and edges.count() <= FEW_LINKS:
        kind = kinds.pop()
        return edges.coalesce(1).mapInArrow(_joined, f"node {kind}, component {kind}")
    print_of = None
    for _ in range(max_rounds):
        edges = cut(small_star(large_star(edges)))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if print_of == tuple(now):
            break
        print_of = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
