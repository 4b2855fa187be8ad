"""LM scoring: online logistic mixing of context bit predictors over a code tree and a speller, beside a unigram base."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.text import CACHE_WORDS, lean, slices, small_batches, utf8
from strandframe.operators.state import drop, table

#: A text's end as a token: a byte string that no word can be.
END = b"\n"
#: Words of at least this share of the training tokens have a path in the code tree; there are at most 1 / LEAST_SHARE.
LEAST_SHARE = 2.0**-17
#: Words whose counts are broadcast; the counts of others come by a join.
NEAR_WORDS = 150_000
#: A text's class is the one of the CLASSES commonest words that it holds most beyond its share.
CLASSES = 64
#: Words before are told apart by rank in the first rows of their table; rarer ones share HASHED rows.
HASHED = 64
#: Slots of the table of words before: an eighth of the training tokens, between these powers of 2.
LEAST_LOG, MOST_LOG = 12, 24
#: log2 of the slots of each speller table: as many as the words beyond the tree, between these.
SPELL_LOGS = (16, 20)
GATES, CONTEXTS, SPELL_CONTEXTS = 12, 3, 4
#: The speller learns from the training words met so often at most, and from all that are not broadcast.
RARE = 8
#: Weights that every text starts with (no context, class, word before), and those that its spelling starts with.
START = (-0.5, 0.9, 0.6)
SPELL_WEIGHTS = (0.3, 0.4, 0.2, 0.3)
#: Observations that a context's counts are held back by, towards those of the shorter context.
HOLD, SPELL_HOLD = 3.0, 4.0
#: Tokens of a text before its weights first learn; each later block is as long as all before it. New words, for those of the spelling.
FIRST, SPELL_FIRST = 16, 2
RATE, PAST = 1.0, 20.0
SPELL_RATE, SPELL_PAST = 1.0, 20.0
#: Bytes of texts coded at once, and words spelled at once.
SLICE, LOT = 2 << 20, 20_000


def code_lengths(counts: list[int]) -> list[int]:
    """Lengths of an optimal prefix code."""
    if len(counts) == 1:
        return [1]
    heap = [(c, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    above: dict[int, int] = {}
    nxt = len(counts)
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        above[i] = above[j] = nxt
        heapq.heappush(heap, (a + b, nxt))
        nxt += 1
    depth = [0] * nxt
    for i in range(nxt - 2, -1, -1):
        depth[i] = depth[above[i]] + 1
    return depth[: len(counts)]


def code_tree(counts: list[int], first_node: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each symbol's path, nodes along the paths, bits along them); nodes from first_node."""
    lengths = code_lengths(counts)
    order = sorted(range(len(counts)), key=lambda i: (lengths[i], i))
    paths: list[list[int]] = [[] for _ in counts]
    code, last = 0, 0
    number: dict[tuple[int, int], int] = {}
    for i in order:
        code <<= lengths[i] - last
        last = lengths[i]
        paths[i] = [(code >> (last - 1 - k)) & 1 for k in range(last)]
        code += 1
    starts, nodes, bits = [0], [], []
    for p in paths:
        at = 0
        for k, bit in enumerate(p):
            nodes.append(number.setdefault((k, at), len(number)) + first_node)
            bits.append(bit)
            at = at * 2 + bit
        starts.append(len(nodes))
    return np.array(starts, np.int64), np.array(nodes, np.uint32), np.array(bits, np.uint8)


def logit(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def paths(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, path: np.ndarray, *more: np.ndarray) -> Iterator[tuple]:
    """(depth, steps, the symbols' rows of `more`) of all first decisions, then all second, and so on; a step is 2 * node + bit.

    Symbols stand longest path first, so those that still decide at a depth are a leading slice.
    """
    own = lengths[symbols]
    order = np.argsort(-own, kind="stable")
    at, more = starts[symbols[order]], [m[order] for m in more]
    deciding = len(symbols) - np.cumsum(np.bincount(own))
    for depth in range(int(own.max(initial=0))):
        m = int(deciding[depth])
        yield depth, path[at[:m] + depth], [x[:m] for x in more]


class Coder:
    """Words as paths in a code tree, with the class and the word before of each.

    Numbers below `escape` are the tree's words, those above it `rest`, and the last is any other word.
    """

    def __init__(self, words: list[tuple[bytes, int]], rest: list[tuple[bytes, int]], other: int, total: int) -> None:
        self.escape = len(words)
        self.unknown = self.escape + 1 + len(rest)
        self.number = {w: i for i, (w, _) in enumerate([*words, (END + END, 0), *rest])}
        self.counts = np.array([n for _, n in [*words, (END, 0), *rest, (END, 0)]], np.int64)
        counts = [max(1, c) for _, c in words] + [max(1, other)]
        self.starts, nodes, bits = code_tree(counts, 0)
        self.lengths = np.diff(self.starts).astype(np.int16)
        self.path = nodes.astype(np.intp) << 1 | bits
        self.nodes = int(nodes.max()) + 1
        n = np.zeros(self.nodes * 2)
        np.add.at(n, self.path, np.repeat(np.array(counts, float), self.lengths))
        self.p0 = (n[1::2] + 0.4) / (n[::2] + n[1::2] + 0.8)
        share = np.array([c for _, c in words[:CLASSES]], float) / max(1, total)
        self.share = np.pad(np.maximum(share, 1e-9), (0, CLASSES - len(share)), constant_values=1.0)
        size = int(np.clip(np.log2(max(1, total / 8)), LEAST_LOG, MOST_LOG))
        self.ranks, self.width = 1 << (size // 2 - 1), min(1 << (size // 2 + 1), self.nodes)
        self.rows = self.ranks + HASHED + 1
        rank = np.arange(len(counts))
        self.row_of = np.where(rank < self.ranks, rank, self.ranks + (rank * 2_654_435_761 >> 7) % HASHED)
        self.groups = [self._groups(self.nodes), self._groups(self.width)]
        #: Places of the table of classes and of the table of words before.
        self.sizes = [n * (int(g[0].max()) + 1) for n, g in zip((CLASSES + 1, self.rows), self.groups, strict=True)]

    def _groups(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The group of each symbol, of those that part at nodes beyond `width` only, and each step's first group and the one past its last.

        Groups stand in the order of their codes, so a step leads to a run of them.
        """
        order = np.argsort(self.lengths, kind="stable")
        inside = np.add.reduceat(self.path < 2 * width, self.starts[:-1])
        last = self.path[self.starts[:-1] + inside - 1][order]
        number = np.concatenate([[0], np.cumsum(last[1:] != last[:-1])])
        group = np.empty_like(number)
        group[order] = number
        owner = np.repeat(group, self.lengths)
        low, high = np.full(2 * width, number[-1] + 1), np.zeros(2 * width, np.int64)
        near = self.path < 2 * width
        np.minimum.at(low, self.path[near], owner[near])
        np.maximum.at(high, self.path[near], owner[near] + 1)
        return group, np.minimum(low, high), high

    def units(self, texts: list[bytes]) -> tuple:
        """The words; of each: its text, number, symbol, place in the text, row of the tree word before; of each text: its size and class."""
        words = [t.lower().split() + [END] for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        first = np.cumsum(sizes) - sizes
        flat = [x for w in words for x in w]
        owner = np.repeat(np.arange(len(texts)), sizes)
        esc = self.escape
        number = np.fromiter(map(self.number.get, flat, repeat(self.unknown)), np.int64, len(flat))
        sym = np.minimum(number, esc)
        last = np.maximum.accumulate(np.where(sym != esc, np.arange(len(flat)), -1))
        before = np.concatenate([[-1], last[:-1]])
        start = first[owner]
        row = np.where(before >= start, self.row_of[sym[before]], self.rows - 1)
        low = sym < min(CLASSES, esc)
        tf = np.bincount(owner[low] * CLASSES + sym[low], minlength=len(texts) * CLASSES).reshape(-1, CLASSES)
        expected = sizes[:, None] * self.share
        gain = np.where(tf > expected, tf * np.log(np.maximum(tf, 1) / expected), 0.0)
        kind = np.where(gain.max(axis=1) > 0, gain.argmax(axis=1), CLASSES)
        return flat, owner, number, sym, np.arange(len(flat)) - start, row, sizes, kind

    def tree(self, sym: np.ndarray, *more: np.ndarray) -> Iterator[tuple]:
        return paths(sym, self.starts, self.lengths, self.path, *more)


_PADDING = b"    "


class Speller:
    """Words as bytes, each a path in a code tree, in contexts of the bytes before and the text's class."""

    def __init__(self, words: list[bytes], beyond: int) -> None:
        seen = Counter(range(256))  # every byte can be spelled
        for w in words:
            seen.update(w + b" ")
        self.starts, nodes, bits = code_tree([seen[i] for i in range(256)], 0)
        self.lengths = np.diff(self.starts).astype(np.int16)
        self.path = nodes.astype(np.intp) << 1 | bits
        self.log = int(np.clip(np.ceil(np.log2(max(1, beyond))), *SPELL_LOGS))

    def decisions(self, pairs: list[tuple[int, bytes]]) -> Iterator[tuple]:
        """(slots in each table, bits, numbers of the pairs) of the bytes of (class, word) pairs and a closing blank."""
        u = np.uint32
        words = [w for _, w in pairs]
        text = np.frombuffer(_PADDING + _PADDING.join(words) + b" ", np.uint8)
        sizes = np.array([len(w) + 1 for w in words])
        owner = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.repeat(np.cumsum(sizes + 3) - sizes + 1, sizes) + place
        kind = np.array([k for k, _ in pairs], u)[owner] * u(0x51ED2701)
        one, two, three, four = (text[at - j].astype(u) for j in (1, 2, 3, 4))
        c2 = one | two << u(8)
        c3 = c2 | three << u(16)
        contexts = (c2 ^ kind, c3 ^ kind, c3 * u(0x9E3779B1) + np.minimum(place, 6).astype(u), c3 * u(0x9E3779B1) ^ four * u(0x85EBCA77))
        for _, step, (own, *cs) in paths(text[at].astype(np.int64), self.starts, self.lengths, self.path, owner, *contexts):
            node = (step >> 1).astype(u) * u(0x9E3779B1)
            yield [self._slot(c, node, k) for k, c in enumerate(cs)], step & 1, own

    def _slot(self, context: np.ndarray, node: np.ndarray, table: int) -> np.ndarray:
        u = np.uint32
        x = (context + u(table)) * u(0x85EBCA6B) ^ node
        x ^= x >> u(15)
        x *= u(0xC2B2AE35)
        x ^= x >> u(13)
        x *= u(0x27D4EB2F)
        return (x >> u(32 - self.log)).astype(np.intp)

    def costs(self, pairs: list[tuple[int, bytes]], tables: list[np.ndarray], owner: np.ndarray | None = None) -> np.ndarray:
        """Bits of each pair's word, by predictors that are each held back towards the one before, in a logistic mix.

        Pairs of one owner, a text, follow one another. Each text's weights, one set a gate, start
        alike and learn block by block of its words; without owners each pair is on its own.
        """
        out, done = np.zeros(len(pairs)), 0
        owner = np.arange(len(pairs)) if owner is None else owner
        ends = np.append(np.nonzero(np.diff(owner))[0] + 1, len(pairs)) if pairs else []
        while done < len(pairs):  # whole texts, as many as one lot holds, or one
            upto = int(ends[max(np.searchsorted(ends, done + LOT, side="right") - 1, np.searchsorted(ends, done, side="right"))])
            out[done:upto] = self._costs(pairs[done:upto], tables, np.unique(owner[done:upto], return_inverse=True)[1])
            done = upto
        return out

    def _costs(self, pairs: list[tuple[int, bytes]], tables: list[np.ndarray], owner: np.ndarray) -> np.ndarray:
        out, texts = np.zeros(len(pairs)), int(owner[-1]) + 1
        place = np.arange(len(pairs)) - np.searchsorted(owner, owner)
        block = np.where(place < SPELL_FIRST, 0, np.log2(np.maximum(place, 1) / SPELL_FIRST).astype(np.int64) + 1)
        last = np.zeros(texts, np.int64)
        last[owner] = block  # places rise within a text
        w = np.tile(np.array(SPELL_WEIGHTS, np.float32)[:, None], (1, texts * GATES))
        for b in range(int(block.max()) + 1):
            inside = np.nonzero(block == b)[0]
            learns = last[owner[inside]] > b
            gain, seen = np.zeros((SPELL_CONTEXTS, texts * GATES)), np.zeros(texts * GATES)
            for chosen, learn in ((inside[learns], True), (inside[~learns], False)):
                for part in (chosen[i : i + LOT] for i in range(0, len(chosen), LOT)):
                    for depth, (slots, bit, own) in enumerate(self.decisions([pairs[i] for i in part.tolist()])):
                        key = owner[part[own]] * GATES + min(depth, GATES - 1)
                        p, x, stretched = 0.5, np.float32(0), []
                        for k, (slot, counts, hold) in enumerate(zip(slots, tables, (0.8, *[SPELL_HOLD] * (SPELL_CONTEXTS - 1)), strict=True)):
                            n = counts[slot].astype(np.float32)
                            p = np.clip((n[:, 1] + np.float32(hold) * p) / (n[:, 0] + n[:, 1] + np.float32(hold)), 1e-6, 1 - 1e-6)
                            stretched.append(logit(p))
                            x = x + w[k][key] * stretched[-1]
                        x = np.clip(x, -25, 25)
                        bit = bit.astype(np.float32)
                        out += np.bincount(part[own], weights=np.log1p(np.exp(x * (np.float32(1) - np.float32(2) * bit))), minlength=len(pairs))
                        if learn:
                            miss = bit - 1 / (1 + np.exp(-x))
                            for k, s in enumerate(stretched):
                                gain[k] += np.bincount(key, weights=miss * s, minlength=texts * GATES)
                            seen += np.bincount(key, minlength=texts * GATES)
            if learns.any():
                w += (SPELL_RATE * gain / (seen + SPELL_PAST)).astype(np.float32)
        return out / np.log(2)


class Mixer:
    """Logistic mix of three predictors; each text's weights, one set a gate, start alike and learn block by block."""

    def __init__(self, coder: Coder, by_class: np.ndarray, by_word: np.ndarray) -> None:
        self.coder, self.by_class, self.by_word = coder, by_class, by_word
        self.plain = logit(coder.p0).astype(np.float32)

    def bits(self, n: int, owner: np.ndarray, sym: np.ndarray, place: np.ndarray, row: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Bits of each of `n` texts' tree symbols, and those that name its class."""
        block = np.where(place < FIRST, 0, np.log2(np.maximum(place, 1) / FIRST).astype(np.int64) + 1)
        w = np.tile(np.array(START, np.float32)[:, None], (1, n * GATES))
        out, code = np.full(n, np.log2(CLASSES + 1.0)), self.coder
        blocks = int(block.max(initial=-1)) + 1
        last = np.zeros(n, np.int64)
        last[owner] = block  # places rise within a text
        kind, row = kind[owner] * code.nodes, row * code.width
        for b in range(blocks):
            inside = block == b
            for learns in (True, False):
                u = np.nonzero(inside & ((last[owner] > b) == learns))[0]
                if not len(u):
                    continue
                gain, seen = np.zeros((CONTEXTS, n * GATES)), np.zeros(n * GATES)
                for depth, step, (own, of_class, before) in code.tree(sym[u], owner[u], kind[u], row[u]):
                    key = own * GATES + min(depth, GATES - 1)
                    node = step >> 1
                    x0 = self.plain[node]
                    x1 = self.by_class[of_class + node].astype(np.float32)
                    x2 = np.where(node < code.width, self.by_word[before + np.minimum(node, code.width - 1)].astype(np.float32), x0)
                    x = x0 * w[0][key]
                    x += x1 * w[1][key]
                    x += x2 * w[2][key]
                    np.clip(x, -20, 20, out=x)
                    bit = (step & 1).astype(np.float32)
                    cost = np.log1p(np.exp(x * (np.float32(1) - np.float32(2) * bit)))
                    out += np.bincount(own, weights=cost, minlength=n) / np.log(2)
                    if learns:
                        miss = bit - 1 / (1 + np.exp(-x))
                        for k, s in enumerate((x0, x1, x2)):
                            gain[k] += np.bincount(key, weights=miss * s, minlength=n * GATES)
                        seen += np.bincount(key, minlength=n * GATES)
                if learns:
                    w += (RATE * gain / (seen + PAST)).astype(np.float32)
        return out


PACK = 8192


def _packed(counts: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(number, zstandard of 32-bit counts) of the parts of the tables that hold anything."""
    z = zstandard.ZstdCompressor(level=1)
    at = 0
    for c in counts:
        for i in range(0, len(c), PACK):
            if c[i : i + PACK].any():
                yield at + i // PACK, z.compress(np.ascontiguousarray(c[i : i + PACK], dtype="<u4").tobytes())
        at += -(-len(c) // PACK)


def _sum_parts(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """One row for each (part, lot), which stand sorted: the sums of its counts, as 64-bit numbers."""
    z, y = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    last, held = None, None

    def sent() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int32()), pa.array([last[1]], pa.int32()), pa.array([y.compress(held.tobytes())], pa.binary())], ["part", "lot", "data"])

    for batch in batches:
        for part, lot, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x = np.frombuffer(z.decompress(data), kind)
            if (part, lot) != last:
                if held is not None:
                    yield sent()
                last, held = (part, lot), np.zeros(len(x), "<u8")
            held += x
    if held is not None:
        yield sent()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def sent() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.update(text.lower().split())
            held[END] += 1
        if len(held) > CACHE_WORDS:
            yield sent()
            held.clear()
    if held:
        yield sent()


def _least_count(counts: DataFrame) -> int:
    """A count that at most NEAR_WORDS words reach, from a histogram of bounded size."""
    level = F.floor(F.log2("n") * 16).cast("int")
    sizes = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).collect()
    total, least = 0, 1 << 62
    for r in sorted(sizes, key=lambda r: -r["level"]):
        total += r["words"]
        if total > NEAR_WORDS:
            break
        least = r["least"]
    return least


def held_out(doc_id: Column) -> Column:
    """Whether the remainder of crc32 of the id's text by 5 is 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1


def _lots(items: list, n: int = LOT) -> Iterator[list]:
    return (items[i : i + n] for i in range(0, len(items), n))


def _model(code: Coder, sizes: list[int], sums: DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Log odds by class and by word before, held back towards the node's own, and the speller's counts scaled to 16 bits."""
    counts = [np.zeros(n, np.float32) for n in sizes]
    firsts = np.cumsum([0, *(-(-n // PACK) for n in sizes)])
    z = zstandard.ZstdDecompressor()
    for r in sums.select("part", "data").toLocalIterator():
        n = np.frombuffer(z.decompress(bytes(r[1])), "<u8")
        k = int(np.searchsorted(firsts, r[0], side="right")) - 1
        at = (r[0] - int(firsts[k])) * PACK
        counts[k][at : at + len(n)] = n
    odds = []
    for rows, width, (group, low, high) in zip((CLASSES + 1, code.rows), (code.nodes, code.width), code.groups, strict=True):
        own, out = counts.pop(0).reshape(rows, int(group.max()) + 1), np.empty((rows, width), np.float16)
        p = code.p0[:width]
        for i in range(0, rows, 64):
            upto = np.cumsum(np.pad(own[i : i + 64], ((0, 0), (1, 0))), axis=1, dtype=np.float64)
            n = upto[:, high] - upto[:, low]
            out[i : i + 64] = logit((n[:, 1::2] + HOLD * p) / (n[:, ::2] + n[:, 1::2] + HOLD))
        odds.append(out.ravel())
    spelling = [n.reshape(-1, 2) for n in counts]
    return odds[0], odds[1], [(n / np.maximum(1.0, n.max(axis=1, keepdims=True) / 65_535)).astype(np.uint16) for n in spelling]


def score_texts(docs: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score, text_score, bits_per_byte for every row of `docs`.

    Tokens are the words between ASCII white space, A-Z lower-cased, and one end. base_score is
    the smoothed unigram log10 probability over the rows that `train` marks (null counts as no).

    score is the model's log10 probability of the same tokens; as in the base, a word that the
    training rows lack is one event. text_score also spells those words, so it is the log10
    probability of the lower-cased text, and bits_per_byte is its cost over the text's bytes.

    A word of at least LEAST_SHARE of the training tokens is a path in a code tree. Each bit is
    predicted from its node alone, from the text's class (named once, at log2(CLASSES + 1) bits)
    and from the tree word before, whose table has a row for each frequent word and hashed rows
    for others. Logistic mixing adds the three by weights gated by depth; each text starts with
    the same weights and refines them online, block by block. Another word is an escape, then
    either one of the training words beyond the tree, by its count, or a new one (Witten and
    Bell's estimate), spelled byte by byte in four hashed contexts, whose mix each text refines
    from its own new words in their order, in the same way.

    Tables hold whole-number counts over all training rows, so nothing depends on how rows are
    dealt; they grow with the training tokens up to 2**MOST_LOG and 2**SPELL_LOGS[1] slots. The
    counts of all words take part whatever their number: the NEAR_WORDS commonest are broadcast,
    others reach their texts by a join on the word. Null and empty texts are one end token.
    Without training rows the base has c = N = V = 0 and every word is new. Null ids and repeated
    rows come back as they are; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    marked = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text"), F.coalesce(train if train is not None else F.lit(True), F.lit(False)).alias("use"))
    learn = marked.where("use").select("text")
    counts = table(learn.mapInArrow(lean(_count_words), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    near = [(bytes(r[0]), r[1]) for r in counts.where(F.col("n") >= _least_count(counts)).collect()]
    near.sort(key=lambda x: (-x[1], x[0]))
    tree = [x for x in near if x[1] > 1 and x[1] >= LEAST_SHARE * total] or [(END, 0)]
    beyond, types = total - sum(n for _, n in tree), distinct - sum(n > 0 for _, n in tree)
    known_share = beyond / (beyond + types) if beyond else 0.0
    rest = near[len(tree) :] if total else []
    code, spell = Coder(tree, rest, beyond, total), Speller([w for w, _ in rest], beyond)
    sizes = [*code.sizes, *[2 << spell.log] * SPELL_CONTEXTS]
    coders = spark.sparkContext.broadcast((code, spell))

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, spell = coders.value
        tables = [np.zeros(n, np.uint32) for n in sizes]
        one, pairs = np.uint32(1), Counter()
        taught = code.counts <= RARE
        taught[: code.escape + 1] = False

        def spelled() -> None:
            for part in _lots(list(pairs)):
                times = np.array([pairs[p] for p in part], np.uint32)
                for slots, bit, own in spell.decisions(part):
                    for t, slot in zip(tables[CONTEXTS - 1 :], slots, strict=True):
                        np.add.at(t, slot * 2 + bit, times[own])
            pairs.clear()

        for batch in slices(batches, 0, SLICE):
            flat, owner, number, sym, _, row, _, kind = code.units(batch.column(0).to_pylist())
            for t, context, (group, _, _) in zip(tables, (kind[owner], row), code.groups, strict=False):
                np.add.at(t, context * (int(group.max()) + 1) + group[sym], one)
            at = np.nonzero(taught[number])[0]
            pairs.update(zip(kind[owner[at]].tolist(), [flat[i] for i in at.tolist()], strict=True))
            if len(pairs) > CACHE_WORDS:
                spelled()
        spelled()
        for rows in _lots(list(_packed(tables)), 500):
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "data"])

    learned = table(learn.mapInArrow(lean(trained), "part int, data binary").withColumn("lot", F.spark_partition_id() % 16), "learned")
    summed = lambda d, kind, *by: d.select("part", "lot", "data").repartition(*by).sortWithinPartitions("part", "lot").mapInArrow(lean(lambda b: _sum_parts(b, kind)), "part int, lot int, data binary")
    sums = table(summed(summed(learned, "<u4", "part", "lot").withColumn("lot", F.lit(0)), "<u8", "part"), "sums")
    model = spark.sparkContext.broadcast(_model(code, sizes, sums))
    drop(learned, sums)
    base_of = lambda n: np.log10((n + 0.5) / (total + 0.5 * (distinct + 1)))
    new, known = np.log10(1 - known_share), np.log10(known_share / beyond) if beyond else 0.0

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, _ = coders.value
        mixer = Mixer(code, *model.value[:2])
        logs, own = base_of(code.counts), np.where(code.counts > 0, known + np.log10(np.maximum(code.counts, 1)), new)
        own[: code.escape + 1] = 0.0
        met = code.counts > 0
        for batch in slices(batches, 1, SLICE):
            texts = batch.column(1).to_pylist()
            flat, owner, number, sym, place, row, tokens, kind = code.units(texts)
            add = lambda x: np.bincount(owner, weights=x, minlength=len(texts))
            score = add(own[number]) - mixer.bits(len(texts), owner, sym, place, row, kind) * np.log10(2)
            base, n_known = add(logs[number]), add(met[number])
            beyond = np.nonzero(number == code.unknown)[0]
            tf = Counter(zip(owner[beyond].tolist(), [flat[i] for i in beyond.tolist()], strict=True))  # in the order of the texts
            far = pa.StructArray.from_arrays([pa.array([w for _, w in tf], pa.binary()), pa.array(list(tf.values()), pa.int64())], ["word", "tf"])
            ends = np.cumsum(np.bincount([t for t, _ in tf], minlength=len(texts)).astype(np.int32) if tf else np.zeros(len(texts), np.int32))
            far = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), far)
            cols = [pa.array(x, pa.int64()) for x in (tokens, n_known.astype(np.int64))] + [pa.array(x, pa.float64()) for x in (base, score)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array([max(1, len(t)) for t in texts], pa.int64()), pa.array(kind, pa.int32()), far], ["id", "n_tokens", "n_known", "base", "score", "size", "kind", "far"])

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, spell = coders.value
        tables = model.value[2]
        for batch in batches:
            new_words, size, kind = (batch.column(c) for c in ("fresh", "size", "kind"))
            words = new_words.flatten()
            owner = np.repeat(np.arange(len(batch)), pc.list_value_length(new_words).fill_null(0).to_numpy(zero_copy_only=False))
            pairs = list(zip(kind.to_numpy()[owner].tolist(), words.field("word").to_pylist(), strict=True))
            cost = spell.costs(pairs, tables, owner)
            whole = batch.column("score").to_numpy() - np.log10(2) * np.bincount(owner, weights=cost * words.field("tf").to_numpy(), minlength=len(batch))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(whole), pa.array(-whole / np.log10(2) / size.to_numpy())], [*names, "text_score", "bits_per_byte"])

    kinds = "id long, n_tokens long, n_known long, base double, score double, size long, kind int, far array<struct<word: binary, tf: long>>"
    rows = table(marked.select("id", "text").mapInArrow(lean(scored), kinds).withColumn("row", F.monotonically_increasing_id()), "scored")
    far = rows.select("row", F.posexplode("far").alias("at", "f")).select("row", "at", "f.*").join(counts, "word", "left")
    listed = F.log10("n") + F.lit(float(known)) - F.lit(float(new))
    gains = {"more_base": F.log10(F.col("n") + 0.5) - F.log10(F.lit(0.5)), "more_score": listed}
    is_new = F.col("n").isNull()
    sums = [F.sum(F.when(~is_new, F.col("tf"))).alias("more_known"), *(F.sum(F.col("tf") * g).alias(c) for c, g in gains.items())]
    more = far.groupBy("row").agg(*sums, F.array_sort(F.collect_list(F.when(is_new, F.struct("at", "word", "tf")))).alias("fresh"))
    plus = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).alias(c)
    out = rows.drop("far").join(more, "row", "left")
    names = ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    out = out.withColumn("base_score", F.col("base")).select("id", "n_tokens", plus("n_known", "more_known"), F.lit(total).cast("long").alias("train_tokens"), plus("base_score", "more_base"), plus("score", "more_score"), "size", "kind", "fresh")
    return out.mapInArrow(lean(spelled), "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, text_score double, bits_per_byte double").withColumnRenamed("id", id_col)
