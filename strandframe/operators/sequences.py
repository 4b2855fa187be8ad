"""Operators on tables of sequences and alignments: (ord, description, seq) and, by msa_id, aligned rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from strandframe.functions import sequences as S
from strandframe.operators.spatial import rounded
from strandframe.operators.state import table

#: Rows of an alignment that a tile of all pairs holds on either side.
TILE_ROWS = 1000
#: Pairs of rows compared side by side.
BLOCK_PAIRS = 100_000
#: Sequences of a lot that hold one k-mer.
LOT_HOLDERS = 1000
#: A side is broadcast up to so many rows; beyond, Spark plans the join by its own statistics.
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def filter_sequences(df: DataFrame, *conditions: Column) -> DataFrame:
    return df.where(S.all_of(*conditions))


def unique_sequences(df: DataFrame, seq: str = "seq", ord_: str = "ord") -> DataFrame:
    """The first record of each distinct sequence. A partial aggregate, so copies shrink before the shuffle."""
    rest = [c for c in df.columns if c not in (seq, ord_)]
    first = df.groupBy(seq).agg(F.min_by(F.struct(ord_, *rest), ord_).alias("r"))
    return first.select(*(F.col(c) if c == seq else F.col(f"r.{c}") for c in df.columns))


def map_identical(df: DataFrame, seq: str = "seq", ord_: str = "ord") -> DataFrame:
    """seq_hash, first_ord, n: one row for each group of identical sequences."""
    return df.groupBy(seq).agg(F.min(ord_).alias("first_ord"), F.count(F.lit(1)).alias("n")).select(F.xxhash64(seq).alias("seq_hash"), "first_ord", "n")


def identical_members(df: DataFrame, seq: str = "seq", ord_: str = "ord") -> DataFrame:
    """first_ord, ord: each record with the first record of its group, without gathering groups."""
    firsts = df.groupBy(seq).agg(F.min(ord_).alias("first_ord"))
    return df.join(firsts, seq).select("first_ord", ord_)


def sort_by_length(df: DataFrame, seq: str = "seq", ord_: str = "ord") -> DataFrame:
    """Ascending, ties in file order. A range sort over all partitions."""
    return df.orderBy(F.length(seq), ord_)


def retrieve(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """The records whose id is in the list."""
    return df.join(bounded(ids.select(on).distinct()), on, "left_semi")


def find_subsequences(df: DataFrame, queries: DataFrame, seq: str = "seq", query: str = "query") -> DataFrame:
    """One row for each hit of a query in a sequence, with start (from 0), end and percent covered.

    Hits of one query do not overlap. One automaton finds all queries in a pass over each
    sequence; more than BROADCAST_ROWS queries are dealt into lots, with a pass for each.
    """
    asked = table(queries.where(F.length(query) > 0).withColumn("__q", F.monotonically_increasing_id()), "queries")
    lots = max(1, -(-asked.count() // BROADCAST_ROWS))
    found = []
    for k in range(lots):
        own = asked.where(F.pmod(F.xxhash64("__q"), F.lit(lots)) == k)
        words = [(r[1], r[0]) for r in own.select("__q", query).collect()]
        found.append(_hits_of_lot(df, words, seq).join(F.broadcast(own), "__q"))
    return reduce(DataFrame.unionByName, found).drop("__q").withColumn("percent", 100.0 * F.length(query) / F.length(seq))


def _hits_of_lot(df: DataFrame, words: list[tuple[str, int]], seq: str) -> DataFrame:
    """`df` with __q, hit (from 1), start and end of each hit of the numbered words."""
    held = df.sparkSession.sparkContext.broadcast(words)
    hit = pa.list_(pa.struct([("__q", pa.int64()), ("hit", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        numbers: dict[str, list[int]] = {}
        for w, q in held.value:
            numbers.setdefault(w, []).append(q)
        automaton = ahocorasick.Automaton()
        for w in numbers:
            automaton.add_word(w, w)
        automaton.make_automaton()
        for batch in batches:
            rows: list[list[dict]] = []
            for text in batch.column(seq).to_pylist():
                last: dict[str, tuple[int, int]] = {}
                out: list[dict] = []
                for end, w in automaton.iter(text) if text and numbers else ():
                    n, free = last.get(w, (0, 0))
                    start = end + 1 - len(w)
                    if start >= free:
                        last[w] = (n + 1, end + 1)
                        out += [{"__q": q, "hit": n + 1, "start": start, "end": end + 1} for q in numbers[w]]
                rows.append(out)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, hit)], [*batch.schema.names, "__hits"])

    schema = StructType([*df.schema.fields, *StructType.fromDDL("__hits array<struct<__q:long,hit:int,start:int,end:int>>").fields])
    return df.mapInArrow(search, schema).select("*", F.inline("__hits")).drop("__hits")


def label(df: DataFrame, style: str, width: int, description: str = "description") -> DataFrame:
    """`label`: first_id (right-aligned, cut to width), or description (cut to width)."""
    if style == "first_id":
        first = F.regexp_extract(description, r"^\s*(\S*)", 1)
        return df.withColumn("label", F.lpad(F.substring(first, 1, width), width, " "))
    if style == "description":
        return df.withColumn("label", F.substring(description, 1, width))
    raise ValueError(style)


# --- alignments -----------------------------------------------------------------------------


def residues(msa: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """One row for each place of each row: keys, ord, pos (from 0), aa."""
    return msa.select(*keys, "ord", F.posexplode(S.letters(seq)).alias("pos", "aa"))


def check_msa(msa: DataFrame, keys: list[str], seq: str = "seq", description: str = "description") -> DataFrame:
    """n, equal_lengths, unique_names, common_length for each alignment."""
    by_length = msa.groupBy(*keys, F.length(seq).alias("len")).agg(F.count(F.lit(1)).alias("n"))
    lengths = by_length.groupBy(*keys).agg(F.sum("n").alias("n"), (F.count(F.lit(1)) == 1).alias("equal_lengths"), F.max_by("len", F.struct("n", -F.col("len"))).alias("common_length"))
    names = msa.groupBy(*keys).agg((F.count_distinct(description) == F.count(F.lit(1))).alias("unique_names"))
    return lengths.join(names, keys) if keys else lengths.crossJoin(names)


def profile(msa: DataFrame, keys: list[str], alphabet: str | None = None, seq: str = "seq") -> DataFrame:
    """keys, pos, aa, n, fraction: letter frequencies of each column; letters outside the alphabet are "other"."""
    cells = residues(msa, keys, seq)
    if alphabet is not None:
        cells = cells.withColumn("aa", F.when(F.col("aa").isin(*alphabet), F.col("aa")).otherwise("other"))
    counts = cells.groupBy(*keys, "pos", "aa").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "pos")))


def consensus(msa: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """keys, consensus: the most frequent letter of each column; ties go to the later letter."""
    counts = residues(msa, keys, seq).groupBy(*keys, "pos", "aa").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*keys, "pos").agg(F.max_by("aa", F.struct("n", "aa")).alias("aa"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "aa"))), lambda x: x["aa"]), "")
    return best.groupBy(*keys).agg(text.alias("consensus"))


def column_at(msa: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    return msa.withColumn("aa", S.char_at(n, seq))


def remove_gapped_columns(msa: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Drop the columns that are gaps in all rows."""
    cells = residues(msa, keys, seq)
    kept = cells.groupBy(*keys, "pos").agg(F.bool_or(~F.col("aa").isin(*S.GAPS)).alias("some")).where("some")
    places = kept.groupBy(*keys).agg(F.array_sort(F.collect_list("pos")).alias("__keep"))
    joined = msa.join(places, keys, "left") if keys else msa.crossJoin(places)
    return joined.withColumn(seq, _picked(seq)).drop("__keep")


def _picked(seq: str) -> Column:
    return F.coalesce(F.array_join(F.transform("__keep", lambda p: F.substr(F.col(seq), p + 1, F.lit(1))), ""), F.lit(""))


def remove_gaps_by_reference(msa: DataFrame, reference: str, seq: str = "seq") -> DataFrame:
    """Drop the columns in which the reference row has a gap."""
    keep = [i for i, c in enumerate(reference) if c not in S.GAPS]
    return msa.withColumn("__keep", F.array(*map(F.lit, keep)) if keep else F.array().cast("array<int>")).withColumn(seq, _picked(seq)).drop("__keep")


def trim_by_reference(msa: DataFrame, reference: str, seq: str = "seq") -> DataFrame:
    """Cut to the reference row's first to last residue."""
    at = [i for i, c in enumerate(reference) if c not in S.GAPS]
    return msa.withColumn(seq, F.substring(seq, at[0] + 1, at[-1] - at[0] + 1) if at else F.lit(""))


def longest_sequence(msa: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """keys, ord, seq of the first row with the greatest ungapped length."""
    best = F.max_by(F.struct("ord", seq), F.struct(S.len_ungapped(seq), -F.col("ord"))).alias("r")
    return msa.groupBy(*keys).agg(best).select(*keys, "r.*")


def _letter_rows(texts: list[str | None], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters as numbers in rows filled up with `pad`, lengths (-1: null), ungapped lengths."""
    whole = [t or "" for t in texts]
    sizes = np.array([-1 if t is None else len(t) for t in texts], np.int32)
    joined = np.frombuffer("".join(whole).encode("utf-32-le"), np.uint32)
    filled = np.maximum(sizes, 0)
    rows = np.full((len(whole), int(filled.max(initial=0))), pad, np.uint32)
    rows[np.arange(rows.shape[1]) < filled[:, None]] = joined
    gaps = np.isin(rows, [ord(g) for g in S.GAPS])
    ungapped = filled - gaps.sum(axis=1).astype(np.int32)
    rows[gaps] = pad
    return rows, sizes, ungapped


def _identities(a: list[str | None], b: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, identical positions, whether lengths agree, shorter ungapped lengths) of blocks of a's rows with all of b's."""
    (x, nx, ux), (y, ny, uy) = _letter_rows(a, 0x110000), _letter_rows(b, 0x110001)
    if max(x.max(initial=0, where=x < 0x110000), y.max(initial=0, where=y < 0x110000)) < 254:
        x, y = np.minimum(x, 254).astype(np.uint8), np.where(y < 254, y, 255).astype(np.uint8)
    columns = np.ascontiguousarray(y.T)
    step = max(1, BLOCK_PAIRS // max(1, len(b)))
    for i in range(0, len(a), step):
        same = np.zeros((len(x[i : i + step]), len(b)), np.uint8 if x.shape[1] < 256 else np.int32)
        for p in range(min(x.shape[1], y.shape[1])):
            same += x[i : i + step, p, None] == columns[p]
        yield i, same, (nx[i : i + step, None] == ny) & (ny >= 0), np.minimum(ux[i : i + step, None], uy)


def _tile_pairs(msa: DataFrame, keys: list[str], seq: str, run: Callable, kinds: str) -> DataFrame:
    """keys and what `run` makes of (ids and texts of one tile, those of another or the same) for every two tiles of an alignment.

    A tile is one row of about TILE_ROWS by the size of the largest alignment, and every two meet
    in an equi-join, so that an alignment with most of the rows is spread over all tasks.
    """
    largest = msa.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    tiles = -(-largest // TILE_ROWS)
    own = F.pmod(F.xxhash64("ord"), F.lit(tiles)).cast("int")
    held = msa.select(*keys, own.alias("__t"), F.col("ord").alias("o"), F.col(seq).alias("s")).groupBy(*keys, "__t").agg(F.collect_list(F.struct("o", "s")).alias("rows"))
    a = held.select(*keys, F.col("rows").alias("a"), F.col("__t").alias("__ta"), F.explode(F.sequence(F.col("__t"), F.lit(tiles - 1))).alias("__tb"))
    b = held.select(*keys, F.col("rows").alias("b"), F.col("__t").alias("__tb"), F.explode(F.sequence(F.lit(0), F.col("__t"))).alias("__ta"))
    met = a.hint("merge").join(b, [*keys, "__ta", "__tb"]).select(*keys, "a", "b", (F.col("__ta") == F.col("__tb")).alias("__one"))
    fields = msa.select(*keys).schema.fields
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    names = [*keys, *(k.split()[0] for k in kinds.split(", "))]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                x, y = (batch.column(c).slice(r, 1).flatten() for c in ("a", "b"))
                for columns in run(x.field("o"), x.field("s").to_pylist(), y.field("o"), y.field("s").to_pylist(), batch.column("__one")[r].as_py()):
                    at = pa.array(np.full(len(columns[0]), r))
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), *columns], names)

    return met.mapInArrow(each, head + kinds)


def _percents(n: np.ndarray, least: np.ndarray, digits: int | None) -> np.ndarray:
    """100 n / least, rounded as `round` of a column does; the few different values are rounded once."""
    if digits is None or not len(n):
        return np.divide(100.0 * n, least, out=np.zeros(len(n)), where=least > 0)
    width = int(least.max()) + 1
    key = n.astype(np.int64) * width + least
    values = np.nonzero(np.bincount(key))[0] if (int(n.max()) + 1) * width < 1 << 20 else np.unique(key)
    top, low = values // width, values % width
    percents = rounded(np.divide(100.0 * top, low, out=np.zeros(len(values)), where=low > 0), digits)
    if values[-1] >= 1 << 20:
        return percents[np.searchsorted(values, key)]
    table = np.zeros(values[-1] + 1)
    table[values] = percents
    return table[key]


def identity_pairs(msa: DataFrame, keys: list[str], seq: str = "seq", digits: int | None = None) -> DataFrame:
    """keys, i, j, identical, percent for i > j: all pairs of rows of one alignment, tile by tile; percent to some digits, if given."""
    kind = msa.schema["ord"].dataType.simpleString()

    def run(oa: pa.Array, a: list, ob: pa.Array, b: list, one: bool) -> Iterator[list[pa.Array]]:
        ia, ib = oa.to_numpy(zero_copy_only=False), ob.to_numpy(zero_copy_only=False)
        for first, same, fit, short in _identities(a, b):
            rows = ia[first : first + len(same), None]
            met = ib < rows if one else ib != rows
            pick = (lambda m: np.broadcast_to(m, met.shape).ravel()) if met.all() else (lambda m: np.broadcast_to(m, met.shape)[met])  # noqa: B023, E731
            x, y, n, ok, least = pick(rows), pick(ib), pick(same).astype(np.int32), pick(fit), pick(short)
            some = (lambda m: None if m.all() else ~m)
            yield [pa.array(np.maximum(x, y), oa.type), pa.array(np.minimum(x, y), oa.type), pa.array(n, mask=some(ok)), pa.array(_percents(n, least, digits), mask=some(ok & (least > 0)))]

    return _tile_pairs(msa, keys, seq, run, f"i {kind}, j {kind}, identical int, percent double")


def medoid_sequence(msa: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """keys, ord: the row whose least identity to the others is greatest; ties: longer ungapped, earlier."""
    kind = msa.schema["ord"].dataType.simpleString()

    def run(oa: pa.Array, a: list, ob: pa.Array, b: list, one: bool) -> Iterator[list[pa.Array]]:
        ia, ib = oa.to_numpy(zero_copy_only=False), ob.to_numpy(zero_copy_only=False)
        none = np.iinfo(np.int32).max
        of_b, met_b = np.full(len(ib), none), np.zeros(len(ib), bool)
        for first, same, fit, _ in _identities(a, b):
            rows = ia[first : first + len(same)]
            other = rows[:, None] != ib
            n = np.where(other & fit, same.astype(np.int32), np.int32(none))
            of_a, met_a = n.min(axis=1), other.any(axis=1)
            yield [pa.array(rows[met_a], oa.type), pa.array(of_a[met_a].astype(np.int32), mask=of_a[met_a] == none)]
            if not one:
                of_b, met_b = np.minimum(of_b, n.min(axis=0)), met_b | other.any(axis=0)
        yield [pa.array(ib[met_b], oa.type), pa.array(of_b[met_b].astype(np.int32), mask=of_b[met_b] == none)]

    least = _tile_pairs(msa, keys, seq, run, f"ord {kind}, least int").groupBy(*keys, "ord").agg(F.min("least").alias("least"))
    lengths = msa.select(*keys, "ord", S.len_ungapped(seq).alias("len"))
    joined = least.join(lengths, [*keys, "ord"])
    return joined.groupBy(*keys).agg(F.max_by("ord", F.struct("least", "len", -F.col("ord"))).alias("ord"))


def msa_info(msa: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """n, columns, shortest, longest and the upper median of the ungapped lengths."""
    n = S.len_ungapped(seq)
    counts = msa.groupBy(*keys, n.alias("len")).agg(F.count(F.lit(1)).alias("c"), F.max(F.length(seq)).alias("columns"))
    w = Window.partitionBy(*keys).orderBy("len")
    ranked = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("len"))).alias("median")
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), F.max("columns").alias("columns"), F.min("len").alias("shortest"), F.max("len").alias("longest"), middle)


def kmer_overlaps(df: DataFrame, k: int, least: int = 1, seq: str = "seq", ord_: str = "ord") -> DataFrame:
    """i, j, shared for i < j: pairs of sequences that share k-mers, by an equi-join on the k-mer.

    K-mers of one sequence only leave before the join. The holders of a frequent k-mer are dealt
    into lots of about LOT_HOLDERS, which meet all holders each in a task of its own.
    """
    words = df.select(F.col(ord_).alias("ord"), F.explode(S.kmers(k, seq)).alias("w"))
    lots = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w", F.ceil(F.col("n") / LOT_HOLDERS).cast("int").alias("lots"))
    held = words.join(lots, "w")
    a = held.select(F.col("ord").alias("i"), "w", F.pmod(F.xxhash64("ord"), F.col("lots")).cast("int").alias("lot"))
    b = held.select(F.col("ord").alias("j"), "w", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"))
    return a.join(b, ["w", "lot"]).where("i < j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)
