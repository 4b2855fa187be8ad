"""Texts of deposits and definitions as values: entity, polymer and source kinds, flags, residue locators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of entities, of polymers and of sources, by their text.
ENTITY_KINDS = {"polymer": "Polymer", "non-polymer": "Non-polymer", "water": "Water", "branched": "Branched"}
POLYMER_KINDS = {
    "polypeptide(l)": "PolypeptideL", "polypeptide(d)": "PolypeptideD", "polysaccharide(l)": "PolysaccharideL", "polysaccharide(d)": "PolysaccharideD", "polydeoxyribonucleotide": "DNA", "polyribonucleotide": "RNA",
    "peptide nucleic acid": "PeptideNucleicAcid", "dna": "DNA", "rna": "RNA", "other": "Other",
}
SOURCES = {"nat": "Natural", "man": "GeneticallyManipulated", "syn": "Synthesized"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _or_raise(found: Column, text: Column, what: str) -> Column:
    """`found`, null for a null text; raises for a text that says nothing known."""
    wrong = F.raise_error(F.concat(F.lit(f"no {what}: "), text))
    return F.when(text.isNull() | found.isNotNull(), found).otherwise(wrong)


def _looked_up(text: Column, known: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in known.items() for x in pair))[text]


def entity_kind(text: Column | str) -> Column:
    text = _col(text)
    return _or_raise(_looked_up(text, ENTITY_KINDS), text, "entity type")


def polymer_kind(text: Column | str) -> Column:
    """By the whole text in lower case, else by the first known kind, as listed, that the text contains."""
    text = _col(text)
    low = F.trim(F.lower(text), F.lit("'"))
    found = F.coalesce(_looked_up(low, POLYMER_KINDS), *(F.when(low.contains(k), v) for k, v in POLYMER_KINDS.items()))
    return _or_raise(found, text, "polymer type")


def source_kind(text: Column | str) -> Column:
    text = _col(text)
    return _or_raise(_looked_up(text, SOURCES), text, "entity source")


def parse_bool(text: Column | str) -> Column:
    """Y, y, true and N, n, false."""
    text = _col(text)
    found = F.when(text.isin("Y", "y", "true"), F.lit("true")).when(text.isin("N", "n", "false"), F.lit("false"))
    return _or_raise(found, text, "flag").cast("boolean")


def locator(text: Column | str) -> Column:
    """-1, 0 or 1 for prev, this or next, in lower, upper or title case."""
    text = _col(text)
    spelt = lambda w: text.isin(w, w.upper(), w.title())
    found = F.when(spelt("prev"), F.lit("-1")).when(spelt("this"), F.lit("0")).when(spelt("next"), F.lit("1"))
    return _or_raise(found, text, "residue locator").cast("int")
