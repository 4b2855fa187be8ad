"""Pattern packing: few-document length patterns fitted to the length histogram, residuals best-fit."""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.text import KEEPERS, lean, small_batches, utf8
from strandframe.operators.state import salted_rank, table

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: Words and word parts that a worker keeps encoded until another operator's task; bounds its memory.
KEPT_WORDS, KEPT_PARTS = 350_000, 200_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class WordIds(dict):
    """White-space-free piece of UTF-8 text -> its token ids as little-endian 32-bit bytes.

    White space always parts tokens, so a text's ids are its pieces' ids in turn. Pieces of
    printable Latin-1 are split as the tokenizer's own pattern splits them and each part goes to
    the merge model once; any other piece goes through the whole tokenizer. With a tokenizer file
    of another split, whole texts go through it, as white space may be part of its tokens.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.known = _split_is_known(path)
        self.parts: dict[str, bytes] = {}
        self.plain = re.compile("[!-~¡-ÿ]+")
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in seen]
        self.letters = {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            ids = [t.id for t in self.whole.model.tokenize(part.encode().decode("latin-1").translate(self.letters))]
            got = struct.pack(f"<{len(ids)}I", *ids)
            if len(self.parts) < KEPT_PARTS:
                self.parts[part] = got
        return got

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if "<|" not in text and self.plain.fullmatch(text):
            got = b"".join(map(self._part, self.split.findall(text.lower())))
        else:
            ids = self.whole.encode(text, add_special_tokens=False).ids
            got = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < KEPT_WORDS:
            self[word] = got
        return got

    def encode(self, text: bytes) -> bytes:
        if not self.known:
            ids = self.whole.encode(text.decode(), add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.__getitem__, text.split()))

    def forget(self) -> None:
        """Let go of all that was kept; the tokenizer stays."""
        self.clear()
        self.parts.clear()


#: The split that WordIds makes itself, as tokenizer files write it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _split_is_known(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    splits = [x for x in (parts.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"]
    lower = [x["type"] for x in (parts.get("normalizer") or {}).get("normalizers", [])]
    return [x["pattern"].get("Regex") for x in splits] == [SPLIT] and "Lowercase" in lower


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def forget_all() -> None:
    for e in _encoders.values():
        e.forget()


KEEPERS.append(forget_all)


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """One row for each piece; only documents longer than the capacity have more than one."""
    names = ["id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = ids.encode(text) + b"\0\0\0\0"
                for k in range(0, len(data), 4 * capacity):
                    part = data[k : k + 4 * capacity]
                    rows.append((i, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    source = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col))
    return source.mapInArrow(lean(cut_up, forget_all), "id long, piece int, start long, length long, ids_crc32 long")


def patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """Rows a <= b <= c of present lengths that fill the capacity exactly; a may be 0."""
    have = np.zeros(capacity + 1, dtype=bool)
    have[present] = True
    out = []
    first = np.concatenate([[0], np.nonzero(have)[0]])
    for a in first[first * 3 <= capacity]:
        b = np.arange(max(a, 1), (capacity - a) // 2 + 1)
        c = capacity - a - b
        ok = have[b] & have[c]
        out.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), dtype=int)


def fit_counts(rows: np.ndarray, histogram: np.ndarray, steps: int = 300) -> np.ndarray:
    """Non-negative repeat counts whose pattern lengths come nearest to the histogram.

    Least squares by accelerated projected gradient; a step reads each pattern's three lengths.
    Place 0 stands for "no document" and is not fitted.
    """
    if not len(rows):
        return np.zeros(0)
    size, scale = len(histogram), max(1.0, float(histogram.max()))
    goal = histogram / scale
    goal[0] = 0

    def ahead(x: np.ndarray) -> np.ndarray:
        y = sum(np.bincount(rows[:, k], weights=x, minlength=size) for k in range(3))
        y[0] = 0
        return y

    v = np.ones(len(rows))
    for _ in range(12):  # the largest eigenvalue, for the step
        r = ahead(v)
        w = r[rows].sum(axis=1)
        top = np.linalg.norm(w) / max(np.linalg.norm(v), 1e-300)
        v = w / max(np.linalg.norm(w), 1e-300)
    x = np.zeros(len(rows))
    z, t = x, 1.0
    for _ in range(steps):
        r = ahead(z) - goal
        r[0] = 0
        new = np.maximum(0, z - r[rows].sum(axis=1) / (1.05 * top))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x * scale


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(length, first rank, ranks, first sequence, offset) rows and the number of sequences.

    The rank-th piece of a length goes to first sequence + (rank - first rank) at that offset.
    Patterns come first: their fitted counts are rounded so that running totals stay true and
    are cut to the pieces there are. What remains is packed best-fit from the longest down,
    equal sequences together. Work and size follow the distinct lengths, not the pieces.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    used = np.zeros(capacity + 1, dtype=np.int64)
    out: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        out.append((int(length), int(used[length]), int(n), int(first), int(offset)))
        used[length] += n
        left[length] -= n

    if left[capacity]:
        put(capacity, left[capacity], 0, 0)
        sequences = int(used[capacity])
    rows = patterns(np.nonzero(left)[0], capacity)
    repeats = np.diff(np.floor(np.concatenate([[0], np.cumsum(fit_counts(rows, left.astype(float)))]) + 0.5)).astype(np.int64)
    for k in np.nonzero(repeats)[0]:
        members = [int(x) for x in rows[k] if x]
        n = min([int(repeats[k]), *(int(left[x]) // members.count(x) for x in members)])
        if n > 0:
            offset = 0
            for x in sorted(members, reverse=True):
                put(x, n, sequences, offset)
                offset += x
            sequences += n

    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> (first sequence, how many)
    frees: list[int] = []

    def keep(free: int, first: int, n: int) -> None:
        if free > 0:
            if not room[free]:
                insort(frees, free)
            room[free].append((first, n))

    for length in range(capacity - 1, 0, -1):
        while left[length] > 0:
            at = bisect_left(frees, length)
            if at < len(frees):
                free = frees[at]
                first, n = room[free].pop()
                if not room[free]:
                    frees.pop(at)
                k = min(n, int(left[length]))
                if k < n:
                    keep(free, first + k, n - k)
            else:
                free, first, k = capacity, sequences, -(-int(left[length]) // (capacity // length))
                sequences += k
            put(length, k, first, capacity - free)
            keep(free - length, first, k)
    return out, sequences


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row.

    A row's ids are its text's, then id 0; null and empty texts have that one id. Rows longer
    than the capacity are cut into full pieces and a rest. The driver sees the histogram of
    lengths, at most `capacity` counts; the plan made from it is broadcast and its size follows
    the distinct lengths. Null ids and repeated rows are packed like others. Columns beside the
    two named are not read.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    tokenizer = tokenizer or default_tokenizer()
    pieces = table(pieces_of(docs, tokenizer, capacity, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count(F.lit(1))).collect()}
    plan, _ = plan_packing(histogram, capacity)
    plan.sort()
    rows = np.array(plan, dtype=np.int64).reshape(-1, 5)
    keys = spark.sparkContext.broadcast(((rows[:, 0] << 45) | rows[:, 1], rows[:, 1], rows[:, 3], rows[:, 4]))
    names = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, sequence, offset = keys.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, (length << 45) | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:5]), pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], names)

    ranked = salted_rank(pieces, ["length"], "row", "rank").select(*names[:5], "rank")
    out = ranked.mapInArrow(place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
