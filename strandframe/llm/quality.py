"""Quality rules: zstandard compression bands over whole documents and fixed chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.text import lean, small_batches, utf8

LEVEL = 3
#: (texts of fewer bytes than this, least ratio, greatest ratio) of bytes to compressed bytes.
#: Short texts compress little whatever they say, so the bands rise with the length.
BANDS = (
    (256, 0.0, 1.60), (512, 0.0, 2.00), (1024, 1.20, 2.10), (2048, 1.38, 2.20), (4096, 1.50, 2.30), (8192, 1.60, 2.40),
    (16384, 1.60, 2.48), (32768, 1.60, 2.56), (65536, 1.60, 2.65), (float("inf"), 1.60, 2.80),
)
#: Bytes of a chunk, the band of a chunk's ratio, and the share of chunks outside it that rejects.
CHUNK, CHUNK_BAND, CHUNK_SHARE = 2048, (1.35, 2.50), 0.25

SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"

_SCHEMA = pa.schema(
    [("id", pa.int64())] + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()), ("bad_chunks", pa.int64()), ("n_chunks", pa.int64()), ("reason", pa.string())]
)


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more."""
    if len(words) < 3:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.uint64, count=len(words))
    _, pair = np.unique(ids[:-1] * np.uint64(len(number)) + ids[1:], return_inverse=True)
    _, at, n = np.unique(pair[:-1].astype(np.uint64) * np.uint64(len(number)) + ids[2:], return_inverse=True, return_counts=True)
    again = n[at] > 1
    inside = np.zeros(len(words), dtype=bool)
    for k in range(3):
        inside[k : len(again) + k] |= again
    return int(inside.sum())


def counts(text: str, data: bytes) -> tuple[int, int, int, int, int]:
    words = data.split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def compression(data: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, int, int, str | None]:
    """The whole text's ratio, chunks outside their band, all full chunks, and what rejects it."""
    if not data:
        return 0.0, 0, 0, "empty"
    ratio = len(data) / len(packer.compress(data))
    low, high = next((a, b) for top, a, b in BANDS if len(data) < top)
    chunks = [CHUNK / len(packer.compress(data[i : i + CHUNK])) for i in range(0, len(data) - CHUNK + 1, CHUNK)]
    bad = sum(not CHUNK_BAND[0] <= x <= CHUNK_BAND[1] for x in chunks)
    why = "incompressible" if ratio < low else "repetitive" if ratio > high else "chunks" if bad > CHUNK_SHARE * len(chunks) else None
    return ratio, bad, len(chunks), why


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        rows = []
        for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            base = counts(data.decode(), data)
            failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
            ratio, bad, n, why = compression(data, packer)
            rows.append((i, *base, failed, not failed and why is None, ratio, bad, n, "base" if failed else why))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)] if rows else [pa.array([], f.type) for f in _SCHEMA], schema=_SCHEMA)


def compression_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, verdict and ratios of every row of `docs`, in one pass without a shuffle.

    kept is false if base_failed (under 50 words, or over half of them in repeated 3-word
    windows), if the whole text's zstandard ratio leaves the band of its length, or if over
    CHUNK_SHARE of its full chunks leave theirs; `reason` names the first of these. Null and
    empty texts have counts 0 and fail the base. Null ids and repeated rows come back as they
    are. A text is held in one worker; its whole length counts. Other columns are not read.
    """
    small_batches(docs.sparkSession, 500)
    kinds = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks long, n_chunks long, reason string"
    return docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col)).mapInArrow(lean(_rules), kinds).withColumnRenamed("id", id_col)
