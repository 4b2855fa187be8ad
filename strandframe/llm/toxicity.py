"""Toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.text import CACHE_WORDS, lean, picked, small_batches
from strandframe.operators.state import drop, table

#: Bounds of the classifier's fit, and of nothing else: labelled training rows of each class, drawn
#: by a hash of the id, that choose the terms, and that stand in the index. A class with fewer rows
#: gives all. Every row is scored; document frequencies are taken over all rows.
TERM_ROWS, EXAMPLES = 20_000, 2000
#: A term must stand in so many toxic examples, its class counts differ by so much (G squared), and
#: its share of toxic examples be so many times its share of others.
LEAST_SUPPORT, LEAST_G2, LEAST_LIFT = 4, 30.0, 4.0
PREFIXES = (4, 5, 6, 7)
NEIGHBOURS, BLOCK = 9, 32
#: Labels are broadcast up to so many rows; beyond, they are joined by a shuffle.
BROADCAST_LABELS = 2_000_000

_WORD = re.compile(r"[^\W_]+")


class Terms(dict):
    """word -> ids of the known terms in it: the word itself and its beginnings (marked ^)."""

    def __init__(self, known: dict[str, int]) -> None:
        self.known = known

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        get = self.known.get
        found = (get(word), *(get("^" + word[:k]) for k in PREFIXES if len(word) > k))
        self[word] = out = tuple(x for x in found if x is not None)
        return out

    def vector(self, text: str) -> Counter:
        return Counter(t for ids in map(self.__getitem__, _WORD.findall(text.lower())) if ids for t in ids)


def _all_terms(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return words | {"^" + w[:k] for w in words for k in PREFIXES if len(w) > k}


def _count(batches: Iterator[pa.RecordBatch], of, limit: int = 300_000) -> Iterator[pa.RecordBatch]:
    """Rows (term, n) with the number of texts that hold a term; sent on when the table fills."""

    def sent(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["term", "n"])

    held: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.update(of(text))
        if len(held) > limit:
            yield sent(held)
            held = Counter()
    if held:
        yield sent(held)


def g_squared(pos: float, neg: float, all_pos: float, all_neg: float) -> float:
    """Log-likelihood ratio of a term's counts in two classes."""
    n, total = all_pos + all_neg, 0.0
    for o, e in ((pos, (pos + neg) * all_pos / n), (neg, (pos + neg) * all_neg / n), (all_pos - pos, (n - pos - neg) * all_pos / n), (all_neg - neg, (n - pos - neg) * all_neg / n)):
        if o > 0 and e > 0:
            total += o * np.log(o / e)
    return 2 * total


def distinct_terms(ordered: list[str], pos: dict[str, int], neg: dict[str, int]) -> list[str]:
    """The terms without beginnings that stand in the same texts as a longer term: they would count twice."""
    counts = {(t.removeprefix("^"), pos[t], neg.get(t, 0)) for t in ordered}
    by_counts: dict[tuple[int, int], list[str]] = {}
    for w, p, n in counts:
        by_counts.setdefault((p, n), []).append(w)
    return [t for t in ordered if not (t[0] == "^" and any(w != t[1:] and w.startswith(t[1:]) for w in by_counts[pos[t], neg.get(t, 0)]))]


class BlockMaxIndex:
    """Examples in blocks of BLOCK; a block's greatest weight of each term bounds its cosines.

    `search` opens blocks from the largest bound down and stops where no closed block can reach
    the k-th best cosine: the cosines equal those of comparing with every example.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> None:
        self.n, self.blocks = len(vectors), -(-len(vectors) // BLOCK)
        self.top = np.zeros((n_terms, self.blocks), dtype=np.float64)
        if not vectors:
            return
        term = np.concatenate([t for t, _ in vectors])
        doc = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        weight = np.concatenate([w for _, w in vectors])
        np.maximum.at(self.top, (term, doc // BLOCK), weight)
        order = np.lexsort((doc, term))
        self.doc, self.weight = doc[order], weight[order]
        cell = term[order] * self.blocks + self.doc // BLOCK
        self.at = np.searchsorted(cell, np.arange(n_terms * self.blocks + 1))  # where each term's part of each block starts

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest examples with a term in common; ties by number."""
        none = np.zeros(0, dtype=np.int64), np.zeros(0)
        if not self.n:
            return none
        bound = np.minimum(weights @ self.top[terms], 1.0)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        score, opened, worst, step = np.zeros(self.blocks * BLOCK), 0, 0.0, 2
        while opened < len(order) and bound[order[opened]] > worst + 1e-12:
            blocks = order[opened : opened + step]
            for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
                base = t * self.blocks
                for b in blocks[self.top[t, blocks] > 0].tolist():
                    part = slice(self.at[base + b], self.at[base + b + 1])
                    score[self.doc[part]] += w * self.weight[part]
            if skip >= 0:
                score[skip] = 0.0
            opened, step = opened + len(blocks), step * 2
            if np.count_nonzero(score) >= k:
                worst = min(np.partition(score, -k)[-k], 1.0)
        found = np.nonzero(score)[0]
        best = found[np.lexsort((found, -score[found]))[:k]]
        return best, score[best]


class Model:
    """Index, class weights and calibration; small and of bounded size."""

    def __init__(self, examples: list[tuple[int, list[int], list[int], int]], idf: np.ndarray, weight: tuple[float, float], prior: float) -> None:
        self.idf, self.prior = idf, prior
        made = [(i, y, *self.vector(terms, tfs)) for i, terms, tfs, y in examples]
        made.sort(key=lambda e: (e[2][np.argsort(-e[3], kind="stable")].tolist(), e[1], e[0]))  # alike examples share blocks
        self.ids = np.array([e[0] for e in made], dtype=np.int64)
        self.y = np.array([e[1] for e in made], dtype=np.int64)
        self.w = np.array([weight[e[1]] for e in made])
        self.index = BlockMaxIndex([(e[2], e[3]) for e in made], len(idf))
        self.number = {e[0]: n for n, e in enumerate(made)}
        self.beta = np.array([-2.0, 4.0, 0.0])
        if len(made) and 0 < self.y.sum() < len(made):
            x = np.array([self.votes(*self.index.search(e[2], e[3], NEIGHBOURS, skip=n))[:2] for n, e in enumerate(made)])
            self.beta = self.calibrate(np.column_stack([np.ones(len(x)), x]), self.y, self.w)

    def vector(self, terms: list[int], tfs: list[int]) -> tuple[np.ndarray, np.ndarray]:
        t = np.array(terms, dtype=np.int64)
        v = (1 + np.log(np.array(tfs, dtype=np.float64))) * self.idf[t]
        return t, v / np.linalg.norm(v)

    def votes(self, found: np.ndarray, cosine: np.ndarray) -> tuple[float, float]:
        """Share of the distance-weighted votes for toxic, and the nearest cosine."""
        if not len(found):
            return self.prior, 0.0
        w = self.w[found] / (1.05 - np.minimum(cosine, 1.0))
        return float((w * self.y[found]).sum() / w.sum()), float(cosine[0])

    @staticmethod
    def calibrate(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Weighted logistic regression with a small ridge, by Newton's method."""
        beta = np.zeros(x.shape[1])
        ridge = np.diag([1e-3, 1e-2, 1e-2])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            h = x.T @ (x * (w * p * (1 - p) + 1e-9)[:, None]) + ridge
            step = np.linalg.solve(h, x.T @ (w * (y - p)) - ridge @ beta)
            beta += step
            if np.abs(step).max() < 1e-9:
                break
        return beta

    def score(self, terms: list[int], tfs: list[int], own: int = -1) -> tuple[float, list[int], list[float]]:
        """Probability of label 1, the nearest examples' ids and cosines; example `own` is the text itself and has no vote."""
        if not terms:
            return self.prior, [], []
        found, cosine = self.index.search(*self.vector(terms, tfs), NEIGHBOURS, skip=own)
        votes = self.votes(found, cosine)
        p = 1 / (1 + np.exp(-np.clip(self.beta @ np.array([1.0, *votes]), -30, 30)))
        return float(p), self.ids[found].tolist(), cosine.tolist()


def held_out(doc_id: Column) -> Column:
    """Whether the remainder of crc32 of the id's text by 5 is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _drawn(rows: DataFrame, id_col: str, n: dict[int, int], most: int, salt: int) -> DataFrame:
    """About `most` rows of each class, or all of a class with no more, by a hash of the id."""
    parts = 1 << 30
    cut = F.lit(0)
    for y, k in n.items():
        cut = F.when(F.col("y") == y, F.lit(parts if k <= most else int(parts * (most / k)))).otherwise(cut)
    return rows.where(F.pmod(F.xxhash64(id_col, F.lit(salt)), F.lit(parts)) < cut)


def score_toxicity(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """id, score, predicted, evidence_ids, evidence_cosines for every row of `docs`.

    A text's terms are its words and their first 4 to 7 letters. Terms whose counts over the
    labelled training rows (about TERM_ROWS a class) part the classes by G squared make the
    vocabulary, however many they are; weights are (1 + ln tf) * ln(1 + documents / df) with df
    over all rows. An index of about EXAMPLES examples a class answers each text with its exact
    nearest examples; their votes, weighted by closeness and by the classes' true shares, pass a
    logistic calibration fitted on the examples' own left-out votes. A row that is itself an
    example has no vote on itself. score is the probability of label 1; predicted is score >= 0.5.

    Null, empty and term-free texts score the share of label 1 among term-free training rows.
    Rows of `labels` with a null label or id are left out; of an id labelled twice the greater
    label counts. Without a label of each class every score is that class's (0 without any).
    Null ids and repeated rows come back as they are. Neither ids nor other columns of `docs`
    enter a score.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"), (train if train is not None else F.lit(True)).alias("use"))
    marks = marks.where("use and y is not null and id is not null").groupBy("id").agg(F.max("y").alias("y"))
    marks = table(marks, "labels")
    shares = {r[0]: r[1] for r in marks.groupBy("y").agg(F.count(F.lit(1))).collect()}
    few = F.broadcast(table(_drawn(marks, "id", shares, TERM_ROWS, 1), "fit"))  # about 2 * TERM_ROWS rows at most
    labelled = table(source.join(few, "id"), "labelled")
    shares = {r[0]: r[1] for r in labelled.groupBy("y").agg(F.count(F.lit(1))).collect()}
    n_pos, n_neg = shares.get(1, 0), shares.get(0, 0)
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_LABELS else marks

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _count(batches, _all_terms)

    pos = labelled.where("y = 1").select("text").mapInArrow(lean(tried), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    pos = {r[0]: r[1] for r in pos.where(F.col("n") >= LEAST_SUPPORT).collect()}
    names = spark.sparkContext.broadcast({t: i for i, t in enumerate(pos)})

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(names.value)
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update({t for ids in map(terms.__getitem__, _WORD.findall(text.lower())) if ids for t in ids})
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], ["term", "n"])

    ordered = list(pos)
    neg = {ordered[r[0]]: r[1] for r in labelled.where("y = 0").select("text").mapInArrow(lean(known), "term long, n long").groupBy("term").agg(F.sum("n")).collect()} if pos and n_neg else {}
    gains = {t: g_squared(n, neg.get(t, 0), n_pos, n_neg) for t, n in pos.items() if n * n_neg > LEAST_LIFT * neg.get(t, 0) * n_pos} if n_neg else {}
    chosen = distinct_terms(sorted((t for t, g in gains.items() if g >= LEAST_G2), key=lambda t: (-gains[t], t)), pos, neg)
    vocabulary = spark.sparkContext.broadcast({t: i for i, t in enumerate(chosen)})

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(vocabulary.value)
        for batch in batches:
            made = [sorted(terms.vector(t).items()) for t in batch.column(1).to_pylist()]
            cols = [pa.array([[x[k] for x in v] for v in made], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["id", "terms", "tfs"])

    rows = table(source.mapInArrow(lean(vectors), "id long, terms array<int>, tfs array<int>"), "vectors")
    n_docs = rows.count()
    idf = np.full(len(chosen), np.log(1.0 + max(n_docs, 1)))
    for t, df in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1))).collect():
        idf[t] = np.log(1.0 + n_docs / df)
    examples = rows.join(marks, "id")
    bare = {r[0]: r[1] for r in examples.where("size(terms) = 0").groupBy("y").agg(F.count(F.lit(1))).collect()}
    prior = bare.get(1, 0) / sum(bare.values()) if bare else n_pos / max(1, n_pos + n_neg)
    weight = [1.0, 1.0]
    full = examples.where("size(terms) > 0")
    sizes = {r[0]: r[1] for r in full.groupBy("y").agg(F.count(F.lit(1))).collect()}
    drawn = _drawn(full, "id", sizes, EXAMPLES, 2).select("id", "terms", "tfs", "y").collect()
    examples = [(r["id"], list(r["terms"]), list(r["tfs"]), r["y"]) for r in drawn]
    for y, n in sizes.items():
        weight[y] = n / max(1, sum(e[3] == y for e in examples))
    model = spark.sparkContext.broadcast(Model(examples, idf, (weight[0], weight[1]), prior))
    drop(labelled)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = model.value, {}
        for batch in batches:
            out = []
            for i, terms, tfs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = (m.number.get(i, -1), tuple(terms), tuple(tfs))
                if key not in seen:
                    if len(seen) > 10_000:
                        seen.clear()
                    seen[key] = m.score(terms, tfs, key[0])
                out.append(seen[key])
            p = np.array([x[0] for x in out], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pa.list_(pa.float64()))], ["id", "score", "predicted", "evidence_ids", "evidence_cosines"])

    return rows.mapInArrow(lean(scored), "id long, score double, predicted int, evidence_ids array<long>, evidence_cosines array<double>").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of `docs` whose id no toxic score rejects; of rows with one id one rejects all, and rows without an id stay."""
    bad = table(score_toxicity(docs, labels, train, id_col, text_col, label_col).where("predicted = 1").select(id_col).distinct(), "toxic")
    return picked(docs, bad, id_col, "left_anti")
