"""Sequence predicates and scalar functions: each takes columns and gives a Column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Symbols that stand for a gap in an alignment.
GAPS = "-_"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- predicates -----------------------------------------------------------------------------


def description_contains(text: str, description: Column | str = "description") -> Column:
    return _col(description).contains(text)


def always_true() -> Column:
    return F.lit(True)


def logical_not(condition: Column) -> Column:
    return ~condition


def any_of(*conditions: Column) -> Column:
    """False without conditions."""
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def all_of(*conditions: Column) -> Column:
    """True without conditions."""
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def length_within(low: int, high: int, seq: Column | str = "seq") -> Column:
    """Both ends count."""
    return F.length(_col(seq)).between(low, high)


def shorter_than(n: int, seq: Column | str = "seq") -> Column:
    """At most n."""
    return F.length(_col(seq)) <= n


def longer_than(n: int, seq: Column | str = "seq") -> Column:
    """At least n."""
    return F.length(_col(seq)) >= n


def count_letter(letter: str, seq: Column | str = "seq") -> Column:
    """Occurrences of one letter, case-sensitive."""
    return F.length(_col(seq)) - F.length(F.replace(_col(seq), F.lit(letter), F.lit("")))


def contains_letter(letter: str, n: int, seq: Column | str = "seq") -> Column:
    return count_letter(letter, seq) >= n


def contains_x(n: int, seq: Column | str = "seq") -> Column:
    return contains_letter("X", n, seq)


def fraction_of_letter(letter: str, fraction: float, seq: Column | str = "seq") -> Column:
    """The letter's count is at least this part of the length."""
    return count_letter(letter, seq) >= F.lit(fraction) * F.length(_col(seq))


def fraction_x(fraction: float, seq: Column | str = "seq") -> Column:
    return fraction_of_letter("X", fraction, seq)


def is_nucleic(seq: Column | str = "seq") -> Column:
    """Only A C T G U X in either case; the empty sequence passes, gaps do not."""
    return _col(seq).rlike(r"\A[ACTGUXactgux]*\z")


def is_protein(seq: Column | str = "seq") -> Column:
    """Only upper-case amino-acid letters, X and *."""
    return _col(seq).rlike(r"\A[ARNDCEQGHILKMFPSTWYVX*]*\z")


def motif_to_regex(pattern: str) -> str:
    """A PROSITE-like motif as a regular expression.

    x is any letter, x(n) and x(n,m) repeat it, [..] are choices, {..} exclusions, < and > the ends.
    """
    out = []
    for part in pattern.replace(" ", "").rstrip(".").split("-"):
        head = "^" if part.startswith("<") else ""
        tail = "$" if part.endswith(">") else ""
        part = part.strip("<>")
        part = re.sub(r"\{([A-Za-z]+)\}", r"[^\1]", part)
        part = re.sub(r"\((\d+)(?:,(\d+))?\)", lambda m: "{" + m[1] + ("," + m[2] if m[2] else "") + "}", part)
        out.append(head + part.replace("x", ".") + tail)
    return "".join(out)


def has_motif(pattern: str, seq: Column | str = "seq") -> Column:
    return _col(seq).rlike(motif_to_regex(pattern))


# --- scalars --------------------------------------------------------------------------------


def description_n(n: int, description: Column | str = "description") -> Column:
    """The first n characters; all of them for n = 0."""
    return _col(description) if n == 0 else F.substring(_col(description), 1, n)


def char_at(position: int | Column, seq: Column | str = "seq") -> Column:
    """The letter at a position counted from 0; empty beyond the end."""
    at = position + 1 if isinstance(position, Column) else F.lit(position + 1)
    return F.substr(_col(seq), at, F.lit(1))


def strip_spaces(seq: Column | str = "seq") -> Column:
    return F.replace(_col(seq), F.lit(" "), F.lit(""))


def wrap(width: int, seq: Column | str = "seq") -> Column:
    """Lines of at most `width` letters; 0 leaves one line."""
    return _col(seq) if width <= 0 else F.regexp_replace(_col(seq), f"(?s)(.{{{width}}})(?=.)", "$1\n")


def ungapped(seq: Column | str = "seq") -> Column:
    return F.translate(_col(seq), GAPS, "")


def len_ungapped(seq: Column | str = "seq") -> Column:
    return F.length(ungapped(seq))


def a3m_to_fasta(seq: Column | str = "seq") -> Column:
    """Drop the insertions of an a3m row: keep upper-case letters and gaps."""
    return F.regexp_replace(_col(seq), "[^A-Z_-]", "")


def letters(seq: Column | str = "seq") -> Column:
    """The letters as an array; empty for an empty sequence."""
    return F.filter(F.split(_col(seq), ""), lambda x: x != "")


def _positions(a: Column | str, b: Column | str, keep) -> Column:
    return F.size(F.filter(F.zip_with(letters(a), letters(b), keep), lambda x: x))


def count_identical(a: Column | str, b: Column | str) -> Column:
    """Positions with the same letter in both rows, gaps left out; null if the lengths differ."""
    same = _positions(a, b, lambda x, y: (x == y) & ~x.isin(*GAPS))
    return F.when(F.length(_col(a)) == F.length(_col(b)), same)


def count_aligned(a: Column | str, b: Column | str) -> Column:
    """Positions without a gap in either row; null if the lengths differ."""
    both = _positions(a, b, lambda x, y: ~x.isin(*GAPS) & ~y.isin(*GAPS))
    return F.when(F.length(_col(a)) == F.length(_col(b)), both)


def percent_identity(a: Column | str, b: Column | str) -> Column:
    """100 * identical positions / the shorter ungapped length; null if that is 0."""
    return F.try_divide(100.0 * count_identical(a, b), F.least(len_ungapped(a), len_ungapped(b)))


def residue_hash(seq: Column | str = "seq") -> Column:
    """Equal for equal residues, whatever the description."""
    return F.xxhash64(_col(seq))


def kmers(k: int, seq: Column | str = "seq") -> Column:
    """Distinct sorted k-mers; empty for sequences shorter than k."""
    s = _col(seq)
    starts = F.sequence(F.lit(1), F.length(s) - k + 1)
    return F.when(F.length(s) >= k, F.array_sort(F.array_distinct(F.transform(starts, lambda i: F.substr(s, i, F.lit(k)))))).otherwise(F.array().cast("array<string>"))


def shared_kmers(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def kmer_identity_bounds(different: Column, k: int, shorter: Column) -> tuple[Column, Column]:
    """(lower, upper) bounds of the identity from the number of k-mers not shared, within 0 and 1."""
    upper = 1 - F.ceil(different / F.lit(float(k))) / shorter
    lower = 1 - (different + k - 1) / shorter
    fit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double")))
    return fit(lower), fit(upper)


def suggest_word_length(identity: float) -> int:
    """Word length for an identity level."""
    for least, k in ((0.95, 6), (0.85, 5), (0.75, 4), (0.6, 3)):
        if identity >= least:
            return k
    return 2


def sanitize_file_name(name: Column | str) -> Column:
    """Characters that file systems forbid become _, control characters go."""
    return F.regexp_replace(F.regexp_replace(_col(name), r'[/\\:*?"<>|]', "_"), r"\p{Cntrl}", "")


def full_extension(name: Column | str) -> Column:
    """Everything after the first dot of a file name; null without one."""
    got = F.regexp_extract(F.regexp_extract(_col(name), r"([^/]*)$", 1), r"^[^.]*\.(.+)$", 1)
    return F.when(got != "", got)


def fasta_text(width: int = 80, description: Column | str = "description", seq: Column | str = "seq") -> Column:
    return F.concat(F.lit("> "), _col(description), F.lit("\n"), wrap(width, seq))


def blank_punctuation(text: Column | str) -> Column:
    """ASCII punctuation as blanks, runs of blanks as one, a blank at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace(_col(text), r"[\p{Punct}]", " "), r"\s+", " ")), F.lit(" "))
