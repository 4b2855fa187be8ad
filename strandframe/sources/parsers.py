"""Parsers of scientific text formats: open file or text in, rows out. Pure Python, for use inside data sources."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

# --- FASTA ----------------------------------------------------------------------------------

#: Letters that a cleaning keeps.
KEPT = {"protein": "ARNDCQEGHILKMFPSTWYVX-_", "protein_stop": "ARNDCQEGHILKMFPSTWYVX*-_", "nucleic": "ACGTU-_"}


class Cleaner:
    """Drops text in parentheses, also over lines, and letters outside the alphabet; upper-cases the rest."""

    def __init__(self, alphabet: str) -> None:
        self.keep, self.inside = frozenset(KEPT[alphabet]), False

    def __call__(self, line: str) -> str:
        out = []
        for c in line.upper():
            if c == "(":
                self.inside = True
            elif c == ")":
                self.inside = False
            elif not self.inside and c in self.keep:
                out.append(c)
        return "".join(out)


def fasta(lines: Iterable[str], cleaning: str = "raw") -> Iterator[tuple[str, str]]:
    """(description, sequence); records without residues are left out, a line starting # is an error."""
    name: str | None = None
    parts: list[str] = []
    clean = Cleaner(cleaning) if cleaning != "raw" else None
    for line in lines:
        line = line.strip()
        if line.startswith("#"):
            raise ValueError(f"not FASTA: {line[:40]}")
        if line.startswith(">"):
            if name is not None and any(parts):
                yield name, "".join(parts)
            name, parts = line[1:].strip(), []
            clean = Cleaner(cleaning) if cleaning != "raw" else None
        elif line and name is not None:
            parts.append(clean(line) if clean else line.replace(" ", ""))
    if name is not None and any(parts):
        yield name, "".join(parts)


# --- alignments -----------------------------------------------------------------------------


def stockholm(lines: Iterable[str]) -> Iterator[tuple[int, dict]]:
    """(number, alignment): rows in order of appearance, and gf, gs, gc, gr annotations."""
    number, at, begun = 0, None, False
    for line in lines:
        line = line.rstrip("\n").rstrip("\r")
        if line.startswith("# STOCKHOLM"):
            at, begun = {"rows": {}, "gf": {}, "gs": {}, "gc": {}, "gr": {}}, True
        elif line.strip() == "//":
            if at is not None:
                yield number, at
                number, at = number + 1, None
        elif line.startswith("#=GF ") and at is not None:
            _, feature, text = (line.split(None, 2) + [""])[:3]
            at["gf"].setdefault(feature, []).append(text)
        elif line.startswith("#=GS ") and at is not None:
            _, seq, feature, text = (line.split(None, 3) + ["", ""])[:4]
            at["gs"].setdefault(seq, {}).setdefault(feature, []).append(text)
        elif line.startswith("#=GC ") and at is not None:
            _, feature, text = (line.split(None, 2) + [""])[:3]
            at["gc"][feature] = at["gc"].get(feature, "") + text
        elif line.startswith("#=GR ") and at is not None:
            _, seq, feature, text = (line.split(None, 3) + ["", ""])[:4]
            row = at["gr"].setdefault(seq, {})
            row[feature] = row.get(feature, "") + text
        elif line.strip() and not line.startswith("#") and at is not None:
            seq, text = line.split(None, 1)
            at["rows"][seq] = at["rows"].get(seq, "") + text.replace(" ", "")
    if not begun:
        raise ValueError("no Stockholm header")
    if at is not None and at["rows"]:
        yield number, at


def clustalw(lines: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(id, row) in order of appearance; a header with CLUSTAL must come first."""
    rows: dict[str, str] = {}
    begun = False
    for line in lines:
        if not begun:
            if line.strip():
                if "CLUSTAL" not in line.upper():
                    raise ValueError("no CLUSTAL header")
                begun = True
        elif line.strip() and not line[0].isspace():
            parts = line.split()
            if len(parts) >= 2:
                rows[parts[0]] = rows.get(parts[0], "") + parts[1]
    yield from rows.items()


# --- flat files -----------------------------------------------------------------------------


def uniprot(lines: Iterable[str]) -> Iterator[dict]:
    """Entries by their two-letter line codes."""
    entry: dict = {}
    seq: list[str] = []
    recommended = in_seq = False
    for line in lines:
        code, rest = line[:2], line[5:].rstrip()
        if code == "//":
            if entry:
                yield _entry(entry, "".join(seq))
            entry, seq, in_seq, recommended = {}, [], False, False
        elif in_seq and code == "  ":
            seq.append(rest.replace(" ", ""))
        elif code == "ID":
            parts = rest.split()
            entry["id"], entry["is_reviewed"] = parts[0], len(parts) > 1 and parts[1].startswith("Reviewed")
        elif code == "AC":
            entry.setdefault("accession", rest.split(";")[0].strip())
        elif code == "DE":
            text = rest.strip()
            if re.match(r"(RecName|SubName|AltName|Contains|Includes|Flags)", text):
                recommended = text.startswith("RecName") or (text.startswith("SubName") and "full_name" not in entry)
            if recommended:
                if m := re.search(r"Full=([^;{]+)", text):
                    entry["full_name"] = m[1].strip()
                if m := re.search(r"EC=([^;{ ]+)", text):
                    entry["ec"] = m[1]
        elif code == "OS":
            entry["species_name"] = f"{entry.get('species_name', '')} {rest.strip()}".strip()
        elif code == "OX":
            if m := re.search(r"NCBI_TaxID=(\d+)", rest):
                entry["taxid"] = int(m[1])
        elif code == "SQ":
            in_seq = True


def _entry(e: dict, seq: str) -> dict:
    return {k: e.get(k) for k in ("id", "accession", "full_name", "ec", "taxid", "species_name")} | {"is_reviewed": e.get("is_reviewed", False), "sequence": seq}


def genbank(lines: Iterable[str]) -> Iterator[dict]:
    """Entries of GenBank and GenPept files."""
    entry: dict = {}
    seq: list[str] = []
    in_seq = False
    for line in lines:
        key = line[:12].strip()
        rest = line[12:].strip()
        if line.startswith("//"):
            if entry:
                yield _entry(entry, "".join(seq).upper())
            entry, seq, in_seq = {}, [], False
        elif in_seq:
            seq.append(re.sub(r"[\s\d]", "", line))
        elif key == "LOCUS":
            entry["id"] = rest.split()[0] if rest else ""
        elif key == "DEFINITION":
            entry["full_name"] = rest
        elif key == "ACCESSION":
            entry["accession"] = rest.split()[0] if rest else ""
        elif key == "SOURCE":
            entry["species_name"] = rest
        elif line.startswith("ORIGIN"):
            in_seq = True
        elif m := re.search(r'/db_xref="taxon:(\d+)"', line):
            entry["taxid"] = int(m[1])


# --- CIF ------------------------------------------------------------------------------------

_TOKEN = re.compile(r"'(?:[^']|'(?=\S))*'|\"(?:[^\"]|\"(?=\S))*\"|\S+")


def split_quoted(line: str, strip_quotes: bool = True) -> list[str]:
    """Words between blanks; quotes hold words together and end before a blank only."""
    out = []
    for m in _TOKEN.finditer(line):
        t = m[0]
        out.append(t[1:-1] if strip_quotes and len(t) > 1 and t[0] in "'\"" and t[-1] == t[0] else t)
    return out


def split_keeping_blanks(text: str) -> list[str]:
    return re.findall(r"\s+|\S+", text)


def _cif_tokens(lines: Iterable[str]) -> Iterator[tuple[str, bool]]:
    """(token, whether it is quoted text); semicolon text fields come as one token."""
    text: list[str] | None = None
    for line in lines:
        line = line.rstrip("\n").rstrip("\r")
        if text is not None:
            if line.startswith(";"):
                yield "\n".join(text), True
                text, line = None, line[1:]
            else:
                text.append(line)
                continue
        elif line.startswith(";"):
            text = [line[1:]]
            continue
        for m in _TOKEN.finditer(line):
            t = m[0]
            if t.startswith("#"):
                break
            quoted = len(t) > 1 and t[0] in "'\"" and t[-1] == t[0]
            yield (t[1:-1] if quoted else t), quoted


def cif(lines: Iterable[str]) -> Iterator[tuple[int, str, str, int, int, str, str]]:
    """(block number, block, kind, loop number, row, name, value): kind is item or loop."""
    block, name, loops = -1, "", -1
    key: str | None = None
    columns: list[str] = []
    state, at = "", 0
    for token, quoted in _cif_tokens(lines):
        low = token.lower()
        if not quoted and low.startswith("data_"):
            block, name, loops, state, key = block + 1, token[5:], -1, "", None
        elif not quoted and low == "loop_":
            loops, columns, state, at = loops + 1, [], "names", 0
        elif not quoted and token.startswith("_"):
            if state == "names":
                columns.append(token)
            else:
                key, state = token, ""
        elif state in ("names", "values") and columns:
            state = "values"
            yield block, name, "loop", loops, at // len(columns), columns[at % len(columns)], token
            at += 1
        elif key is not None:
            yield block, name, "item", -1, 0, key, token
            key = None


def cif_value(token: str | None) -> str | None:
    """None for the two marks of a missing value."""
    return None if token in (None, "?", ".") else token


# --- PDB ------------------------------------------------------------------------------------


def hybrid36(text: str) -> int:
    """The number in all of a column's places: decimal, or hybrid-36 if it starts with a letter."""
    if not text[0].isalpha():
        return int(text)
    n = len(text)
    return int(text, 36) + 10**n + (16 if text[0].islower() else -10) * 36 ** (n - 1)


def pdb_atoms(lines: Iterable[str]) -> Iterator[dict]:
    """ATOM and HETATM records by their columns, long numbers in hybrid-36; a TER raises the entity number of its chain."""
    model, order = 1, 0
    entity: dict[str, int] = {}
    for line in lines:
        record = line[:6].strip()
        if record == "MODEL":
            model, order, entity = int(line[10:14] or 1), 0, {}
        elif record == "TER":
            chain = line[21:22] if len(line) > 21 else " "
            entity[chain] = entity.get(chain, 1) + 1
        elif record in ("ATOM", "HETATM"):
            x = line.rstrip("\n").ljust(80)
            number = lambda a, b, d, f=float: f(x[a:b]) if x[a:b].strip() else d
            yield {
                "model": model, "atom_ord": order, "serial": number(6, 11, 0, hybrid36), "name": x[12:16], "alt_loc": x[16], "res_name": x[17:20].strip(), "chain_id": x[21], "entity_id": str(entity.get(x[21], 1)),
                "res_seq": number(22, 26, 0, hybrid36), "i_code": x[26], "x": number(30, 38, 0.0), "y": number(38, 46, 0.0), "z": number(46, 54, 0.0), "occupancy": number(54, 60, 1.0), "temp_factor": number(60, 66, 0.0),
                "element": x[76:78].strip() or None, "charge": x[78:80].strip() or None, "is_hetero": record == "HETATM",
            }
            order += 1


def pdb_records(lines: Iterable[str]) -> dict:
    """Header, title, methods, remarks, resolution, unit cell, helices, strands and SEQRES of a PDB file."""
    out: dict = {"classification": None, "date": None, "id_code": None, "title": "", "methods": [], "remarks": {}, "resolution": None, "cell": None, "helices": [], "strands": [], "seqres": {}}
    for line in lines:
        x = line.rstrip("\n").ljust(80)
        record = x[:6].strip()
        if record == "HEADER":
            out |= {"classification": x[10:50].strip(), "date": x[50:59].strip(), "id_code": x[62:66].strip()}
        elif record == "TITLE":
            out["title"] += x[10:80].rstrip() if not out["title"] else " " + x[10:80].strip()
        elif record == "EXPDTA":
            out["methods"] += [m.strip() for m in x[10:79].split(";") if m.strip()]
        elif record == "REMARK":
            out["remarks"].setdefault(x[7:10].strip(), []).append(x[11:].rstrip())
            if x[7:10].strip() == "2" and (m := re.search(r"([0-9]+\.[0-9]+)\s+ANGSTROM", x)):
                out["resolution"] = float(m[1])
        elif record == "CRYST1":
            out["cell"] = (*(float(x[a:b]) for a, b in ((6, 15), (15, 24), (24, 33), (33, 40), (40, 47), (47, 54))), x[55:66].strip(), int(x[66:70].strip() or 1))
        elif record == "HELIX":
            out["helices"].append((x[19], int(x[21:25]), x[25], x[31], int(x[33:37]), x[37], int(x[38:40].strip() or 1)))
        elif record == "SHEET":
            out["strands"].append((x[21], int(x[22:26]), x[26], x[32], int(x[33:37]), x[37], int(x[38:40].strip() or 0)))
        elif record == "SEQRES":
            out["seqres"].setdefault(x[11], []).extend(x[19:70].split())
    out["title"] = out["title"].strip()
    return out


# --- taxonomy dumps -------------------------------------------------------------------------


def dump_fields(line: str) -> list[str]:
    """Fields of a .dmp line, parted by tab, bar, tab."""
    return re.sub(r"\t\|\s*$", "", line.rstrip("\n")).split("\t|\t")


# --- names ----------------------------------------------------------------------------------


def looks_like_cif(lines: Iterable[str]) -> bool:
    """Whether the first line that is not blank or a comment starts a data block."""
    first = next((x for x in lines if x.strip() and not x.startswith("#")), "")
    return first.lower().startswith("data_")


def looks_like_pdb(lines: Iterable[str]) -> bool:
    first = next((x for x in lines if x.strip()), "")
    return first[:6].strip() in ("HEADER", "ATOM", "HETATM", "REMARK", "MODEL")
