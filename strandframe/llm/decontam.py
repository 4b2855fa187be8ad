"""Benchmark decontamination: templates with typed placeholders, window joins, slot consistency."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.text import KEEPERS, lean, picked, small_batches, utf8, windows
from strandframe.operators.state import table

WINDOW = 8
#: Words of a window that must not be placeholders.
LITERALS = 3
#: Share of an item's windows that a document must hold, and of its slots that must agree.
COVERAGE, CONSISTENCY = 0.5, 0.75
#: Items' windows are broadcast up to so many; beyond, documents' windows are all joined by shuffle.
BROADCAST_WINDOWS = 1_000_000

#: Names of units of measure, as they stand after numbers.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg lb oz t ml l s sec min h hr hrs day days week weeks month months year years ms hz khz mhz ghz w kw v a j kj cal kcal pa kpa c f k usd eur gbp $ € £ % percent degrees meters metres kilometers miles grams kilograms pounds liters litres hours minutes seconds dollars euros cents".split())
_NUMBER = re.compile(r"[-+$€£]?[0-9][0-9.,:/]*(?:st|nd|rd|th|%)?")
_WITH_UNIT = re.compile(r"([-+]?[0-9][0-9.,]*)([a-zA-Z%]+)")
_EDGES = ".,;:!?\"'()[]{}<>*#&$%|~`“”«»¿¡"
#: Words that a worker keeps canonical until another operator's task; bounds its memory.
_KEPT = 200_000

LITERAL, NUMBER, UNIT, NAME = range(4)


class Canon(dict):
    """raw word -> its number in the tables: hashes as a sentence's first word and inside one, kind, sentence end, bare word."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.clear()
        n = 1 << 16
        self.first, self.inside, self.word = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.kind, self.ends, self.full = np.zeros(n, np.int8), np.zeros(n, bool), np.zeros(n, bool)
        self.low: list[str] = []

    def __missing__(self, raw: str) -> int:
        bare = raw.strip(_EDGES)
        low = bare.lower()
        literal = xxhash.xxh3_64_intdigest(low)
        if bare.isalpha():  # most words; neither a number nor one with its unit
            kind = UNIT if len(low) > 1 and low in UNITS else LITERAL
        else:
            kind = NUMBER if _NUMBER.fullmatch(bare) else UNIT if low in UNITS and len(low) > 1 or raw in ("%", "$", "€", "£") else LITERAL
            if kind == LITERAL and (m := _WITH_UNIT.fullmatch(bare)) and m[2].lower() in UNITS:
                kind = NUMBER
        first = inside = literal if kind == LITERAL else kind
        if kind == LITERAL and (bare[:1].isupper() and bare[1:2].islower() or len(bare) == 1 and bare.isupper()):
            inside = kind = NAME
        k = len(self.low)
        if k == len(self.first):
            for name in ("first", "inside", "word", "kind", "ends", "full"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        self.first[k], self.inside[k], self.word[k], self.kind[k], self.full[k] = first, inside, literal, kind, low != ""
        self.ends[k] = not bare or raw[-1] in ".!?:\"”" or raw.endswith("|")
        self.low.append(low)
        self[raw] = k
        return k


def template(text: str, canon: Canon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and kinds of the words, and their numbers in the tables; words of punctuation only are left out."""
    if len(canon) > _KEPT:
        canon.reset()
    raw = text.split()
    at = np.fromiter(map(canon.__getitem__, raw), np.intp, len(raw))
    at = at[canon.full[at]]
    kinds, ends = canon.kind[at], canon.ends[at]
    starts = np.concatenate([[True], ends[:-1]]) if len(at) else ends
    kinds = np.where(starts & (kinds == NAME), LITERAL, kinds)
    return np.where(starts, canon.first[at], canon.inside[at]), kinds, at


#: Which windows a text gives: of templates, of the words as they stand, or both.
TEMPLATES, WORDS, BOTH = range(3)


def template_windows(text: str, canon: Canon, wanted: Wanted | None = None, widths: tuple[int, ...] = (), mode: int = TEMPLATES) -> list[tuple[int, int, list[str], int]]:
    """(hash, place, slot values, width) of the windows with enough literal words; only wanted hashes.

    Windows are WINDOW words or a whole shorter text, and of each of `widths` below that. Windows
    of the words as they stand have no slots and need no literal words.
    """
    hashes, kinds, at = template(text, canon)
    n = len(hashes)
    if n == 0:
        return []
    out = []
    if mode != TEMPLATES:
        for k in sorted({min(WINDOW, n), *(w for w in widths if w < min(WINDOW, n))}):
            found = (windows(canon.word[at], k) ^ np.uint64(0x5851F42D4C957F2D)).view(np.int64)
            keep = np.nonzero(wanted.among(found))[0] if wanted is not None else range(len(found))
            out += [(int(found[i]), int(i), [], k) for i in keep]
    if mode == WORDS:
        return out
    literal = np.concatenate([[0], np.cumsum(kinds == LITERAL)])
    for k in sorted({min(WINDOW, n), *(w for w in widths if w < min(WINDOW, n))}):
        found = windows(hashes, k).view(np.int64)
        ok = literal[k:] - literal[: n - k + 1] >= min(LITERALS, k)
        if wanted is not None:
            ok &= wanted.among(found)
        out += [(int(found[i]), int(i), [f"{kinds[j]}={canon.low[at[j]]}" for j in range(i, i + k) if kinds[j] != LITERAL], k) for i in np.nonzero(ok)[0]]
    return out


class Wanted:
    """A sorted array of hashes; a table of their low bits answers most questions alone."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes
        self.mask = np.int64((1 << (18 if len(hashes) < 50_000 else 22)) - 1)
        self.low = np.zeros(int(self.mask) + 1, bool)
        self.low[hashes & self.mask] = True

    def among(self, found: np.ndarray) -> np.ndarray:
        """Which of the hashes are wanted."""
        out = self.low[found & self.mask]
        may = np.nonzero(out)[0]
        if len(may):
            own = found[may]
            out[may] = self.hashes[np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)] == own
        return out


_canon = Canon()


def _forget() -> None:
    _canon.reset()


KEEPERS.append(_forget)


_KINDS = "id long, window long, place int, slots array<string>, width int"


def _rows(batches: Iterator[pa.RecordBatch], wanted: np.ndarray | None, widths: tuple[int, ...] = (), mode: int = TEMPLATES) -> Iterator[pa.RecordBatch]:
    sought = None if wanted is None else Wanted(wanted)
    for batch in batches:
        out = [(i, *w) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in template_windows(text.decode(), _canon, sought, widths, mode)]
        for k in range(0, len(out), 50_000):
            cols = zip(*out[k : k + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.int32()), strict=True)], ["id", "window", "place", "slots", "width"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """id, item, coverage, consistency, n_slots: the documents that hold a benchmark item.

    Words become templates: numbers, units of measure and names (capitals within a sentence)
    turn into typed placeholders, others are lower-cased and bared of punctuation. Windows of 8
    template words, or of a whole shorter item's length, join on their hash. A pair counts if the document
    holds half of the item's distinct windows and the slots agree: each of the item's values
    answers to one value of the document, as in a copy or in a question put with other numbers
    and names; and the other way, where one clash is let pass, as two numbers may become the same.
    Items that have too few literal words in every window are sought as they stand, without
    placeholders. Both are asked of the whole document and of each occurrence in it: hits of one
    alignment (document place minus item place), and hits whose alignments differ by less than
    half the item's length, as words put in or left out shift them. The pair counts if any
    passes; its figures are those of the passing one with the greatest coverage. Texts without words and null ids give nothing; repeated rows count once.
    Columns beside the three named are not read.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), utf8(text_col)).where("id is not null")
    once = lambda d: table(d.groupBy("id", "window", "slots", "width").agg(F.min("place").alias("place")).withColumnsRenamed({"id": "item", "slots": "item_slots", "place": "item_place"}), "asked")
    asked = once(items.mapInArrow(lean(lambda b: _rows(b, None)), _KINDS))
    bare = items.join(asked.select(F.col("item").alias("id")).distinct(), "id", "left_anti")
    plain = once(bare.mapInArrow(lean(lambda b: _rows(b, None, (), WORDS)), _KINDS))
    mode = TEMPLATES if plain.isEmpty() else BOTH
    asked = asked.unionByName(plain)
    widths = tuple(r[0] for r in asked.select("width").distinct().collect() if r[0] < WINDOW)
    few = asked.count() <= BROADCAST_WINDOWS
    wanted = None
    if few:
        wanted = spark.sparkContext.broadcast(np.array(sorted(r[0] for r in asked.select("window").distinct().collect()), dtype=np.int64))
    sizes = asked.groupBy("item").agg(F.count_distinct("window").alias("n_windows"), (F.max("item_place") + F.max("width")).alias("n_words"))
    source = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col)).where("id is not null")
    seen = source.mapInArrow(lean(lambda b: _rows(b, wanted.value if wanted else None, widths, mode), _forget), _KINDS).drop("width")
    hits = table(seen.join(F.broadcast(asked.drop("width")) if few else asked.drop("width"), "window"), "hits")
    lengths = F.broadcast(sizes) if few else sizes
    whole = hits.groupBy("id", "item").agg(F.count_distinct("window").alias("matched")).join(lengths, "item")
    whole = table(whole.where(F.col("matched") / F.col("n_windows") >= COVERAGE).drop("matched"), "held")
    shift = F.col("place") - F.col("item_place")
    band = lambda offset: F.floor((shift + F.floor(F.col("n_words") * offset)) / F.col("n_words"))
    keys = F.array(F.lit("all"), F.concat(F.lit("at"), shift), F.concat(F.lit("a"), band(0)), F.concat(F.lit("b"), band(0.5)))
    spots = hits.join(whole, ["id", "item"]).withColumn("spot", F.explode(keys))
    per = spots.groupBy("id", "item", "spot").agg(F.count_distinct("window").alias("matched"), F.first("n_windows").alias("n_windows"))
    per = per.withColumn("coverage", F.col("matched") / F.col("n_windows")).where(F.col("coverage") >= COVERAGE)
    pairs = F.when(F.size("slots") == F.size("item_slots"), F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b")))
    slots = spots.select("id", "item", "spot", F.explode(pairs).alias("p")).select("id", "item", "spot", "p.a", "p.b").distinct()
    agreed = slots.groupBy("id", "item", "spot").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("a").alias("values"), F.count_distinct("b").alias("answers"))
    per = per.join(agreed, ["id", "item", "spot"], "left").withColumn("consistency", F.coalesce(F.col("values") / F.col("pairs"), F.lit(1.0)))
    back = F.col("answers").isNull() | (F.col("answers") / F.col("pairs") >= CONSISTENCY) | (F.col("pairs") - F.col("answers") <= 1)
    best = per.where((F.col("consistency") >= CONSISTENCY) & back).groupBy("id", "item").agg(F.max(F.struct("coverage", "consistency", F.coalesce("values", F.lit(0)).alias("n_slots"))).alias("best"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "best.coverage", "best.consistency", "best.n_slots")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of `docs` that hold no benchmark item; of rows with one id one that leaks takes all, and rows without an id stay."""
    bad = table(find_leaks(docs, benchmark, id_col, text_col, item_col).select(id_col).distinct(), "leaks")
    return picked(docs, bad, id_col, "left_anti")
