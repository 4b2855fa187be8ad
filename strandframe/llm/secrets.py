"""Secret scans: base patterns, and novelty against a zstandard dictionary of the surroundings."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.text import lean, small_batches, utf8

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_HINT = re.compile(rb"pass(?:word|wd)|secret|token|api_?key|credential|auth|private|bearer|\bkey\b|\bpwd\b", re.IGNORECASE)
#: A candidate: a run of identifier and encoding characters, of any length, beside a sensitive word.
_RUN = re.compile(r"[A-Za-z0-9+/_.=~!^-]{12,}")
#: Between the lines of a block: a run after it goes with the one before.
_BREAK = re.compile(r"[\x20\t\r]*\n[\x20\t]*")
#: Words of identifiers: the text's own prime the dictionary.
_NAME = re.compile(r"[A-Za-z]{4,}")

#: Characters before and after a sensitive word in which candidates are sought.
BEFORE, AFTER = 24, 120
#: Characters of the surroundings that prime the dictionary, on either side.
AROUND = 600
#: Marginal compressed bytes to a character from which a candidate is novel.
NOVEL = 0.72
#: Identifier and placeholder words that prime every dictionary, beside the text's own.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key secret_key private_key client_id client_secret authorization bearer "
    "username user_name hostname localhost example changeme placeholder your_token_here undefined null none true false string "
    "config settings environment variable function return import public static final const default value enabled disabled "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ xxxxxxxxxxxxxxxx 00000000000000000000 https://www.example.com/"
).encode()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, in code points, in their order."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6] if _HINTED(text) else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _HINTED(text: str) -> bool:
    return ("=" in text or ":" in text) and _ANY.search(text) is not None


_ANY = re.compile(r"[oO][rR][dD]|[sS][wW][dD]|[rR][eE][tT]|[kK][eE][nN]|[kK][eE][yY]")


def _packer(primer: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)


def marginal_bytes(candidate: bytes, packer: zstandard.ZstdCompressor) -> int:
    """Bytes that the candidate adds to an empty frame of a primed compressor."""
    return len(packer.compress(candidate)) - len(packer.compress(b""))


def runs_in_reach(text: str, hints: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs from BEFORE characters ahead of a sensitive word to AFTER behind one, and those that follow such a run on the next line."""
    out: list[tuple[int, int]] = []
    k = 0
    for m in _RUN.finditer(text):
        a, b = m.span()
        while k < len(hints) and hints[k][1] + AFTER < a:  # hints end in rising order; this one is behind every later run
            k += 1
        near = k < len(hints) and hints[k][0] - BEFORE <= b
        if near or out and (gap := a - out[-1][1]) < 80 and _BREAK.fullmatch(text, a - gap, a):
            out.append((a, b))
    return out


def novel_spans(text: str, data: bytes, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates beside sensitive words that neither their surroundings nor the text's identifiers explain.

    A candidate mixes digits with letters, overlaps no base span, and costs at least NOVEL bytes a
    character against either of two dictionaries: AROUND characters on each side of it, and the
    words of four letters or more that identifiers outside the candidates hold anywhere in the
    text; IDENTIFIERS stands in both. Each character is looked at a bounded number of times.
    """
    if not _HINT.search(data):
        return []
    spans = sorted((a, b) for a, _, b in taken)
    found, k = [], 0
    for a, b in runs_in_reach(text, [m.span() for m in _HINT_TEXT.finditer(text)]):
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        word = text[a:b]
        if not (k < len(spans) and spans[k][0] < b) and _DIGIT.search(word) and _LETTER.search(word):
            found.append((a, b))
    if not found:
        return []
    names: dict[str, None] = {}
    at = 0
    for a, b in [*found, (len(text), len(text))]:
        names.update(dict.fromkeys(_NAME.findall(text, at, a)))
        at = b
    own = _packer(IDENTIFIERS + b"\n" + " ".join(names).encode())
    out = []
    for a, b in found:
        word = text[a:b].encode()
        if marginal_bytes(word, own) >= NOVEL * len(word):
            near = _packer(IDENTIFIERS + b"\n" + (text[max(0, a - AROUND) : a] + text[b : b + AROUND]).encode())
            if marginal_bytes(word, near) >= NOVEL * len(word):
                out.append((a, 3, b))
    return out


_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
_HINT_TEXT = re.compile(_HINT.pattern.decode(), re.IGNORECASE | re.ASCII)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_SCHEMA = pa.schema([("id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_novel", pa.int64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[] for _ in _SCHEMA]
        for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = data.decode()
            base = base_spans(text)
            more = novel_spans(text, data, base)
            kinds = [k for _, k, _ in base]
            row = (i, kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(listed(base).encode()).hexdigest(), listed(sorted(base + more)), len(more))
            for col, x in zip(cols, row, strict=True):
                col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every row of `docs`, in one pass without a shuffle.

    Spans are kind:start:end in code points, ends exclusive, by start and then kind. The base
    kinds are assign, access and hex; `novel` spans are candidates beside a sensitive word whose
    marginal zstandard bytes reach NOVEL a character, against a dictionary of the surroundings and
    against one of the whole text's identifiers. Candidates may have any length. Null and empty texts have no span and the digest of "". Null ids
    and repeated rows come back as they are; other columns are not read.
    """
    small_batches(docs.sparkSession, 500)
    kinds = "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"
    return docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col)).mapInArrow(lean(_scan), kinds).withColumnRenamed("id", id_col)
