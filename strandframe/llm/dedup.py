"""MinHash near-duplicates: universal hash minima, banding, verification on full sets, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.text import Hashes, lean, picked, small_batches, sorted_groups, utf8, windows, word_hashes
from strandframe.operators.components import connected_components
from strandframe.operators.state import cut, drop, table

WIDTH = 5
MINIMA = 120
#: A link: 100 * intersection >= percent * union; PERCENT where none is given.
PERCENT = 85
#: Greatest probability that a pair of the wanted similarity shares no band.
MISS = 1e-6
#: Documents of one side of a comparison block; a bucket beyond it is compared block by block.
BLOCK = 96


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows over the minima: the longest bands, of 5 rows at most, by which a pair is missed with at most MISS."""
    fits = (r for r in (5, 4, 3, 2) if (1 - (percent / 100) ** r) ** (MINIMA // r) <= MISS)
    rows = next(fits, 1)
    return MINIMA // rows, rows


def least_agreement(percent: int) -> float:
    """Agreement of two signatures below which sets of the wanted similarity are not met in practice: five standard deviations under it."""
    p = percent / 100
    return p - 5.1 * (p * (1 - p) / MINIMA) ** 0.5


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    draw = lambda: rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return draw()[:, None], draw()[:, None]


def shingle_set(text: bytes, words: Hashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles."""
    return np.unique(windows(word_hashes(text, words), width))


def signature(shingles: np.ndarray, n: int = MINIMA) -> np.ndarray:
    """Minima of n multiply-shift hashes of the set, 32 bits each."""
    a, b = _signature_tables(n)
    x = shingles >> np.uint64(32)
    low = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(x), 1024):
        np.minimum(low, (a * x[i : i + 1024] + b).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _signature_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _tables:
        _tables[n] = _multipliers(n)
    return _tables[n]


def _sketch(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    words, shape = Hashes(), banding(percent)
    for batch in batches:
        out: list[list] = [[], [], []]
        for text in batch.column(1).to_pylist():
            s = shingle_set(text, words)
            out[0].append(len(s))
            if len(s):
                out[1].append(xxhash.xxh3_128_digest(s.tobytes()))
                bands = signature(s).reshape(shape)
                out[2].append([xxhash.xxh3_64_intdigest(x.tobytes(), seed=i + 1) - 2**63 for i, x in enumerate(bands)])
            else:
                out[1].append(None)
                out[2].append([])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.list_(pa.int64()))], ["id", "n_shingles", "same", "bands"])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Hashes()
    for batch in batches:
        sigs = [signature(shingle_set(t, words)).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sigs, pa.binary())], ["id", "text", "sig"])


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets reach the similarity, in whole numbers."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures may agree and whose full sets do. Pairs come sorted by a."""
    words, at, held = Hashes(), None, None
    floor = least_agreement(percent)
    for batch in batches:
        d = batch.to_pydict()
        a, b = [], []
        for i, j, x, y, p, q in zip(d["a"], d["b"], d["ta"], d["tb"], d["sa"], d["sb"], strict=True):
            if (np.frombuffer(p, np.uint32) == np.frombuffer(q, np.uint32)).mean() < floor:
                continue
            if at != i:
                at, held = i, shingle_set(x, words)
            if linked(held, shingle_set(y, words), percent):
                a.append(i)
                b.append(j)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])


def _block_links(group: list[dict], words: Hashes, percent: int) -> list[tuple[int, int]]:
    """A forest of confirmed links between the components of one block."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    sigs = np.stack([np.frombuffer(r["sig"], np.uint32) for r in group])
    comp = np.array([r["comp"] for r in group])
    pairs, floor = [], least_agreement(percent)
    for i in range(len(group) - 1):
        agree = (sigs[i + 1 :] == sigs[i]).mean(axis=1)
        pairs += [(-agree[j], i, i + 1 + j) for j in np.nonzero((agree >= floor) & (comp[i + 1 :] != comp[i]))[0]]
    sets: dict[int, np.ndarray] = {}
    out = []
    for _, i, j in sorted(pairs):
        if find(int(comp[i])) != find(int(comp[j])):
            for k in (i, j):
                if k not in sets:
                    sets[k] = shingle_set(group[k]["text"], words)
            if linked(sets[i], sets[j], percent):
                root[find(int(comp[i]))] = find(int(comp[j]))
                out.append((group[i]["id"], group[j]["id"]))
    return out


def _blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    words = Hashes()
    for group in sorted_groups(batches, "block"):
        if out := _block_links(group, words, percent):
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["u", "v"])


def _repeats(docs: DataFrame, id_col: str) -> bool:
    """Whether an id stands on more than one row."""
    ids = docs.select(F.col(id_col).alias("id")).where("id is not null")
    return not ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def _numbered(docs: DataFrame, id_col: str, number: str) -> DataFrame:
    """A table of the rows with numbers that rise with their ids."""
    return table(docs.orderBy(id_col).withColumn(number, F.monotonically_increasing_id()), "numbered")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, component_id, kept for every row of `docs`.

    A-Z are lower-cased; a document's set has its distinct 5-word shingles, or its whole word
    sequence if shorter. Two documents are linked if 100 * intersection >= `percent` * union; null,
    empty and blank texts have no set and no link. component_id is the least id reachable and
    kept marks that document. Rows of equal id are judged each by its own text; a null id comes
    back alone, linked with nothing. Columns beside the two named are not read.

    1. One pass sketches every text: the set's size and digest, and band keys over 120 minima
       (24 of 5 at 85 percent, 30 of 4 at 80), by which a pair of the wanted similarity is missed
       with probability MISS at most.
    2. Equal sets collapse into their least id by a partial aggregate.
    3. Each band bucket links its members to its least member: as many pairs as members, not all.
       Signatures screen the pairs, full sets confirm them, and components form.
    4. Buckets that still hold several components are compared in blocks of bounded size, only
       across components, and each block returns a forest of confirmed links: a link that the
       stars of step 3 could not show is found here, whatever the bucket's size.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text"))
    if _repeats(source, "id"):
        rows = _numbered(source, "id", "row")
        found = _components(rows.select(F.when(F.col("id").isNotNull(), F.col("row")).alias("id"), "text"), percent).withColumnRenamed("id", "row")
        ids = rows.select("row", "id")
        named = ids.select(F.col("row").alias("component"), F.col("id").alias("component_id"))
        out = found.join(ids, "row", "left").join(named, "component", "left")
    else:
        out = _components(source, percent).withColumnRenamed("component", "component_id")
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def _components(source: DataFrame, percent: int) -> DataFrame:
    """id, n_shingles, component of (id, text) rows whose ids are null or unique."""
    small_batches(source.sparkSession, 500)
    base = table(source.mapInArrow(lean(lambda b: _sketch(b, percent)), "id long, n_shingles long, same binary, bands array<long>"), "sketch")
    reps = table(base.where("id is not null and n_shingles > 0").groupBy("same").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")), "sets")
    spread = reps.select("rep", F.explode("bands").alias("band"))
    shared = cut(spread.groupBy("band").agg(F.count(F.lit(1)).alias("members"), F.min("rep").alias("star")).where("members > 1"))
    members = table(spread.join(shared, "band"), "buckets")
    wanted = table(members.select(F.col("rep").alias("id")).distinct(), "wanted")
    texts = table(picked(source, wanted, "id", "left_semi").mapInArrow(lean(_signed), "id long, text binary, sig binary"), "candidates")

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"), F.col("sig").alias("sa"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"), F.col("sig").alias("sb"))
    stars = members.where("rep <> star").select(F.col("star").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = stars.join(right, "b").join(left, "a").select("a", "b", "ta", "tb", "sa", "sb")
    links = cut(pairs.sortWithinPartitions("a").mapInArrow(lean(lambda b: _verify(b, percent)), "u long, v long"))
    first = cut(connected_components(links))

    known = members.join(first.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("comp"))
    parts = known.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("band").agg(F.count(F.lit(1)).alias("comps"), F.sum("n").alias("members"), F.max("n").alias("most"), F.max_by("comp", F.struct("n", "comp")).alias("main"))
    mixed = cut(mixed.where("comps > 1 and members > 2"))
    spot = known.join(mixed, "band").withColumn("is_main", F.col("comp") == F.col("main"))
    lots = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(float(BLOCK)))).cast("long")
    spot = spot.withColumn("main_lots", lots(F.col("most"))).withColumn("other_lots", lots(F.col("members") - F.col("most")))
    lot = F.pmod(F.xxhash64("rep"), F.when(F.col("is_main"), F.col("main_lots")).otherwise(F.col("other_lots")))
    spot = spot.withColumn("lot", lot)
    count_up = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    with_main = F.transform(count_up(F.col("main_lots")), lambda j: F.concat_ws(":", F.col("band"), F.col("lot"), F.lit("m"), j))
    with_other = F.transform(count_up(F.col("other_lots")), lambda j: F.concat_ws(":", F.col("band"), F.least("lot", j), F.lit("o"), F.greatest("lot", j)))
    of_main = F.transform(count_up(F.col("other_lots")), lambda i: F.concat_ws(":", F.col("band"), i, F.lit("m"), F.col("lot")))
    single = F.array(F.concat_ws(":", F.col("band"), F.lit("all")))
    few = F.col("members") <= BLOCK
    spot = spot.select(F.col("rep").alias("id"), "comp", F.explode(F.when(few, single).when(F.col("is_main"), of_main).otherwise(F.concat(with_main, with_other))).alias("block"))
    blocks = spot.join(texts, "id").repartition("block").sortWithinPartitions("block", "id")
    more = cut(blocks.select("block", "id", "comp", "text", "sig").mapInArrow(lean(lambda b: _blocks(b, percent)), "u long, v long"))

    if more.isEmpty():
        final = first
    else:
        final = cut(connected_components(links.unionByName(more)))
    named = table(reps.select("same", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select("same", F.coalesce("component", "rep").alias("component")), "classes")
    drop(reps, members, wanted, texts)
    out = base.select("id", "n_shingles", "same").join(named, "same", "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "id"))
    return out.select("id", "n_shingles", component.alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row of each group of near copies, the one with the least id, and all that have no near copy.

    Where ids repeat, rows are told apart by a number that rises with the id: a row goes only if
    its own text near-copies that of a row before, and of equal rows one stays. Rows without an
    id stay.
    """
    key, rows = id_col, docs
    if _repeats(docs, id_col):
        key = "__strandframe_row"
        rows = _numbered(docs, id_col, key)
    number = F.when(F.col(id_col).isNotNull(), F.col(key)).cast("long")
    found = _components(rows.select(number.alias("id"), utf8(text_col).alias("text")), percent)
    gone = table(found.where("id <> component").select(F.col("id").alias(key)), "gone")
    return picked(rows, gone, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
