"""Pairwise alignment with affine gaps in Arrow batches, pair joins and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions import sequences as S
from strandframe.functions.scoring import Scores, blosum62
from strandframe.operators.sequences import bounded
from strandframe.operators.state import table

#: Steps of a path: a gap in the query, a gap in the template, a matched pair.
GAP_IN_QUERY, GAP_IN_TEMPLATE, MATCH = "-", "|", "*"
_LOW = -(1 << 40)


def _fill(score: np.ndarray, first: int, more: int, local: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best scores ending anyhow (h), in a gap of the query (e) and in a gap of the template (f).

    A row is computed at once: as opening costs at least as much as extending, the best gap
    ending at column j starts at the running maximum of (score without that gap - j * more).
    """
    n, m = score.shape
    h, e, f = (np.full((n + 1, m + 1), _LOW, dtype=np.int64) for _ in range(3))
    h[0, 0] = 0
    columns = np.arange(m + 1)
    if local:
        h[0, :] = h[:, 0] = 0
    else:
        e[0, 1:] = h[0, 1:] = first + (columns[1:] - 1) * more
        f[1:, 0] = h[1:, 0] = first + np.arange(n) * more
    for i in range(1, n + 1):
        f[i, 1:] = np.maximum(f[i - 1, 1:] + more, h[i - 1, 1:] + first)
        t = np.maximum(h[i - 1, :-1] + score[i - 1], f[i, 1:])
        if local:
            t = np.maximum(t, 0)
        start = np.concatenate([[h[i, 0]], t])
        best = np.maximum.accumulate(start - columns * more)
        e[i, 1:] = best[:-1] + first + (columns[1:] - 1) * more
        h[i, 1:] = np.maximum(t, e[i, 1:])
    return h, e, f


def _trace(score: np.ndarray, h: np.ndarray, e: np.ndarray, f: np.ndarray, i: int, j: int, first: int, more: int, local: bool) -> tuple[str, int, int]:
    """The path back from (i, j): a match is preferred, then a gap in the query, then in the template."""
    out, state = [], MATCH
    while i > 0 or j > 0:
        if state == MATCH:
            if local and h[i, j] <= 0:
                break
            if i > 0 and j > 0 and h[i, j] == h[i - 1, j - 1] + score[i - 1, j - 1]:
                out.append(MATCH)
                i, j = i - 1, j - 1
                continue
            state = GAP_IN_QUERY if j > 0 and h[i, j] == e[i, j] else GAP_IN_TEMPLATE
        if state == GAP_IN_QUERY:
            out.append(GAP_IN_QUERY)
            if not (j > 1 and e[i, j] == e[i, j - 1] + more):
                state = MATCH
            j -= 1
        else:
            out.append(GAP_IN_TEMPLATE)
            if not (i > 1 and f[i, j] == f[i - 1, j] + more):
                state = MATCH
            i -= 1
    return "".join(reversed(out)), i, j


def global_alignment(query: str, template: str, scores: Scores, gap_open: int, gap_extend: int) -> tuple[int, str]:
    """Score and path; end gaps are charged. Gap costs are negative, the first residue's is gap_open."""
    s = scores.matrix(query.encode("latin-1", "replace"), template.encode("latin-1", "replace"))
    h, e, f = _fill(s, gap_open, gap_extend, False)
    return int(h[-1, -1]), _trace(s, h, e, f, len(query), len(template), gap_open, gap_extend, False)[0]


def local_alignment(query: str, template: str, scores: Scores, gap_open: int, gap_extend: int) -> tuple[int, str, int, int]:
    """Score, path and starts from 0; of equal scores the first cell by rows ends the path."""
    s = scores.matrix(query.encode("latin-1", "replace"), template.encode("latin-1", "replace"))
    h, e, f = _fill(s, gap_open, gap_extend, True)
    i, j = np.unravel_index(int(np.argmax(h)), h.shape)
    path, a, b = _trace(s, h, e, f, int(i), int(j), gap_open, gap_extend, True)
    return int(h[i, j]), path, a, b


def aligned_strings(path: str, query: str, template: str, gap: str = "-") -> tuple[str, str]:
    """The two rows that a path makes of the sequences from their starts."""
    q, t, i, j = [], [], 0, 0
    for step in path:
        q.append(gap if step == GAP_IN_QUERY else query[i])
        t.append(gap if step == GAP_IN_TEMPLATE else template[j])
        i, j = i + (step != GAP_IN_QUERY), j + (step != GAP_IN_TEMPLATE)
    return "".join(q), "".join(t)


_ALIGNED = "score long, path string, aligned_query string, aligned_template string, q_start int, t_start int"


def align(query: Column | str, template: Column | str, gap_open: int = -10, gap_extend: int = -2, scores: Scores | None = None, local: bool = False) -> Column:
    """A struct of score, path, both aligned rows and starts, by an Arrow UDF; null for null input.

    Work and memory of a pair are the product of its lengths: meant for sequences, not genomes.
    """
    table = scores or blosum62()

    @F.pandas_udf(_ALIGNED)
    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for queries, templates in pairs:
            rows = []
            for q, t in zip(queries, templates, strict=True):
                if q is None or t is None:
                    rows.append((None,) * 6)
                    continue
                if local:
                    score, path, a, b = local_alignment(q, t, table, gap_open, gap_extend)
                else:
                    (score, path), a, b = global_alignment(q, t, table, gap_open, gap_extend), 0, 0
                rows.append((score, path, *aligned_strings(path, q[a:], t[b:]), a, b))
            yield pd.DataFrame(rows, columns=["score", "path", "aligned_query", "aligned_template", "q_start", "t_start"])

    return run(query, template)


def statistics(df: DataFrame, query: str = "aligned_query", template: str = "aligned_template") -> DataFrame:
    """`df` with n_identical, query_length, template_length (ungapped) and percent_identity."""
    return df.withColumns({
        "n_identical": S.count_identical(query, template), "query_length": S.len_ungapped(query), "template_length": S.len_ungapped(template), "percent_identity": S.percent_identity(query, template),
    })


def pairs(queries: DataFrame, templates: DataFrame | None, seq: str = "seq", ord_: str = "ord", tiles: int = 16) -> DataFrame:
    """q, t, query, template: every query with every template, or each unordered pair of one table.

    All pairs are what the operator asks for; rows are dealt into tiles of both sides, so each
    task holds a tile and no side is broadcast unless it is small.
    """
    q = queries.select(F.col(ord_).alias("q"), F.col(seq).alias("query"))
    t = (queries if templates is None else templates).select(F.col(ord_).alias("t"), F.col(seq).alias("template"))
    t = t.withColumn("tile", F.pmod(F.xxhash64("t"), F.lit(tiles)))
    q = q.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))
    met = q.join(t, "tile").drop("tile")
    return met.where("q > t") if templates is None else met


def align_all_pairs(queries: DataFrame, templates: DataFrame | None = None, low: float = 0.0, high: float = 100.0, **options) -> DataFrame:
    """Aligned pairs with their statistics and low <= percent_identity <= high."""
    keep = {k: options.pop(k) for k in ("seq", "ord_", "tiles") if k in options}
    met = pairs(queries, templates, **keep)
    done = met.withColumn("a", align("query", "template", **options)).select("q", "t", "a.*")
    return statistics(done).where(F.coalesce(F.col("percent_identity"), F.lit(0.0)).between(low, high))


def identity_matrix(aligned: DataFrame) -> DataFrame:
    """One row for each query, one column for each template; bounded by the number of templates."""
    return aligned.groupBy("q").pivot("t").agg(F.first("n_identical"))


def identity_histogram(aligned: DataFrame, width: float = 2.5) -> DataFrame:
    """q, bin, n: each query's histogram of percent identities."""
    return aligned.groupBy("q", F.floor(F.col("percent_identity") / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def pairwise_text(query: Column | str, template: Column | str, width: int = 60) -> Column:
    """Blocks of both rows with a line of | under equal letters between them."""
    q, t = (F.col(x) if isinstance(x, str) else x for x in (query, template))
    middle = F.array_join(F.zip_with(S.letters(q), S.letters(t), lambda a, b: F.when((a == b) & ~a.isin("-", "_"), "|").otherwise(" ")), "")
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.length(q) - 1) / width), F.lit(0)).cast("int"))
    part = lambda x, k: F.substr(x, k * width + 1, F.lit(width))
    return F.array_join(F.transform(starts, lambda k: F.concat(part(q, k), F.lit("\n"), part(middle, k), F.lit("\n"), part(t, k), F.lit("\n"))), "\n")


def pairwise_blocks(query: Column | str, template: Column | str, query_name: Column | str, template_name: Column | str, name_width: int = 10, width: int = 60) -> Column:
    """Blocks of both rows, each row with its name, the number of its first and last residue there; | under equal letters.

    A block in which a row has only gaps shows the number before its next residue twice.
    """
    q, t, qn, tn = (F.col(x) if isinstance(x, str) else x for x in (query, template, query_name, template_name))
    blank, number = " " * (name_width + 7), F.lit(" ")
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.length(q) - 1) / width), F.lit(0)).cast("int"))
    part = lambda x, k: F.substr(x, k * width + 1, F.lit(width))
    before = lambda x, k: S.len_ungapped(F.substr(x, F.lit(1), k * width))

    def row(x: Column, name: Column, k: Column) -> Column:
        held = S.len_ungapped(part(x, k))
        first = before(x, k) + F.when(held > 0, 1).otherwise(0)
        label = F.rpad(F.substring(name, 1, name_width), name_width, " ")
        return F.concat(label, number, F.lpad(first.cast("string"), 5, " "), number, part(x, k), number, F.lpad((before(x, k) + held).cast("string"), 5, " "))

    middle = F.array_join(F.zip_with(S.letters(q), S.letters(t), lambda a, b: F.when((a == b) & ~a.isin("-", "_"), "|").otherwise(" ")), "")
    block = lambda k: F.concat_ws("\n", row(q, qn, k), F.concat(F.lit(blank), part(middle, k)), row(t, tn, k))
    return F.array_join(F.transform(starts, block), "\n")


def reports(aligned: DataFrame, reporters: dict[str, Callable[[DataFrame], DataFrame]]) -> dict[str, DataFrame]:
    """Each reporter's table by name; the alignments are computed once, as a table that all of them read."""
    held = table(aligned, "aligned")
    return {name: reporter(held) for name, reporter in reporters.items()}


def path_counts(path: Column | str) -> Column:
    """struct<matched, gaps_in_query, gaps_in_template> of a path's text; raises for a step that is none, null for null."""
    p = F.col(path) if isinstance(path, str) else path
    steps = {"matched": MATCH, "gaps_in_query": GAP_IN_QUERY, "gaps_in_template": GAP_IN_TEMPLATE}
    other = F.translate(p, "".join(steps.values()), "")
    wrong = F.raise_error(F.concat(F.lit("no alignment steps: "), other))
    n = lambda step: F.length(p) - F.length(F.replace(p, F.lit(step), F.lit("")))
    counts = F.struct(*(n(s).alias(k) for k, s in steps.items()))
    checked = F.when(other != "", wrong.cast("string")).otherwise(F.lit(""))
    return F.when(p.isNotNull() & (checked == ""), counts)


def retrieve_by_identity(aligned: DataFrame, ids: DataFrame) -> DataFrame:
    """The aligned pairs whose query is listed."""
    return aligned.join(bounded(ids.select("q").distinct()), "q", "left_semi")
