"""Database identifiers in sequence descriptions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds in the order of their priority.
KINDS = ("CypId", "PDB", "SwissProt", "UniProtKB", "TrEmbl", "UniProtEntry", "UniParc", "UniRef", "RefSeq", "GenBank", "Ensembl", "DDBJ", "NCBIGI", "KEGG", "Default", "TaxId", "Organism")
#: What stands before a value in the text form of its kind.
PREFIX = {"PDB": "pdb|", "SwissProt": "sp|", "TrEmbl": "tr|", "UniProtKB": "UniProt|", "RefSeq": "ref|", "GenBank": "gb|", "DDBJ": "dbj|", "Ensembl": "Ensembl|", "NCBIGI": "gi|", "TaxId": "taxid="}

_ACC = r"[OPQ][0-9][A-Z0-9]{3}[0-9](?:-\d+)?|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2}(?:-\d+)?"
#: Patterns in the order they are tried; what one finds is blanked for those after it.
PATTERNS = [
    ("TaxId", r"\[?\btaxid[=|](\d+)\|?\]?"), ("TaxId", r"\bOX=(\d+)"), ("Organism", r"\[organism=([^\]]+)\]"), ("NCBIGI", r"\bgi\|(\d+)\|?"),
    ("SwissProt", rf"\bsp\|({_ACC})\|?"), ("TrEmbl", rf"\btr\|({_ACC})\|?"), ("UniProtKB", rf"\bUniProt(?:KB)?[|:]({_ACC})\|?"), ("UniRef", r"\b(UniRef\d+_[A-Z0-9-]+)"), ("UniParc", r"\b(UPI[0-9A-F]{10})\b"),
    ("RefSeq", r"\b(?:ref\|)?((?:[ANWXY][CGMPRTWZ])_\d+(?:\.\d+)?)\|?"), ("GenBank", r"\bgb\|([A-Z]{1,6}\d{5,9}(?:\.\d+)?)\|?"), ("DDBJ", r"\bdbj\|([A-Z]{1,6}\d{5,9}(?:\.\d+)?)\|?"), ("Ensembl", r"\b(ENS[A-Z]*[GTPE]\d{11}(?:\.\d+)?)\b"),
    ("PDB", r"\bpdb\|([0-9][A-Za-z0-9]{3}(?::[A-Za-z0-9]{1,4}\b)?)\|?"), ("PDB", r"\b(pdb_0000[0-9][A-Za-z0-9]{3})\b"), ("CypId", r"\b(CYP\d+[A-Z]{1,2}\d+(?:v\d+)?)\b"), ("UniProtEntry", r"\b([A-Z0-9]{1,10}_[A-Z][A-Z0-9]{2,4})\b"),
    ("UniProtKB", rf"\b({_ACC})\b"), ("GenBank", r"\b([A-Z]{2}\d{6}(?:\.\d+)?|[A-Z]{3}\d{5}(?:\.\d+)?)\b"), ("PDB", r"\|([0-9][A-Za-z][A-Za-z0-9]{2})\b"), ("KEGG", r"\b([a-z]{3,4}:[A-Za-z0-9_.-]+)\b"), ("Organism", r"\[([A-Z][a-z]+ [a-z][^\]=]*)\]"),
]
_COMPILED = [(k, re.compile(p)) for k, p in PATTERNS]


def expand_taxids(text: str) -> str:
    """taxid=1,2 as taxid|1| taxid|2|."""
    return re.sub(r"\btaxid[=|](\d+(?:,\d+)*)\|?", lambda m: " ".join(f"taxid|{x}|" for x in m[1].split(",")), text)


def parse_ids(description: str) -> list[tuple[int, int, str, str]]:
    """(priority, place, kind, value) in text order; the first word as Default where nothing is found."""
    text, out = expand_taxids(description), []
    for kind, pattern in _COMPILED:
        spans = [(m.start(), m.end(), m[1]) for m in pattern.finditer(text)]
        for a, b, value in spans:
            out.append((a, kind, value.strip()))
            text = text[:a] + " " * (b - a) + text[b:]
    if not out and description.split():
        out = [(0, "Default", description.split()[0])]
    return [(KINDS.index(k), i, k, v) for i, (_, k, v) in enumerate(sorted(out))]


def id_text(kind: str, value: str) -> str:
    if kind == "Organism":
        return f"[organism={value}]"
    return value if kind == "PDB" and value.startswith("pdb_") else PREFIX.get(kind, "") + value


def _ids(descriptions: pd.Series) -> pd.Series:
    return descriptions.map(lambda d: [dict(zip(("priority", "pos", "kind", "value"), x, strict=True)) for x in parse_ids(d)] if d is not None else None)


def sequence_ids(description: Column | str) -> Column:
    """An array of the ids in a description."""
    return F.pandas_udf(_ids, "array<struct<priority:int,pos:int,kind:string,value:string>>")(description)


def sorted_ids(ids: Column) -> Column:
    """By priority; equal ones stay in text order."""
    return F.array_sort(ids)


def full_id(ids: Column) -> Column:
    """The ids' text forms, parted by bars."""
    prefix = F.create_map(*(F.lit(x) for k in KINDS for x in (k, PREFIX.get(k, ""))))
    form = lambda x: F.when(x["kind"] == "Organism", F.concat(F.lit("[organism="), x["value"], F.lit("]"))).when((x["kind"] == "PDB") & x["value"].startswith("pdb_"), x["value"]).otherwise(F.concat(F.try_element_at(prefix, x["kind"]), x["value"]))
    return F.array_join(F.transform(ids, form), "|")


def first_id(ids: Column) -> Column:
    return F.get(ids, F.lit(0))["value"]


def file_name(ids: Column) -> Column:
    """A safe file name of the ids' text forms."""
    return F.regexp_replace(F.regexp_replace(full_id(ids), r"[^A-Za-z0-9.-]+", "_"), r"^_+|_+$", "")
