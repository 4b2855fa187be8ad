"""Operators on macromolecular structures: atoms(deposit_id, model, atom_ord, name, res_name, chain_id, ...)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandframe.functions import atoms as A
from strandframe.functions import chemistry as C
from strandframe.functions import geometry as G
from strandframe.functions.entities import polymer_kind
from strandframe.operators.sequences import bounded
from strandframe.operators.spatial import BATCH, BLOCK, close_pairs, rounded, within
from strandframe.operators.state import cut

KEY = ["deposit_id", "model"]
RES = ["chain_id", "res_seq", "i_code"]


def runs(df: DataFrame, keys: list[str], order: list[str], values: list[str], out: str = "run") -> DataFrame:
    """`df` with the number, from 0, of its run of equal adjacent values."""
    w = Window.partitionBy(*keys).orderBy(*order)
    same = None
    for v in values:
        c = F.col(v).eqNullSafe(F.lag(v).over(w))
        same = c if same is None else same & c
    first = F.row_number().over(w) == 1
    return df.withColumn("__new", F.when(first | ~same, 1).otherwise(0)).withColumn(out, F.sum("__new").over(w) - 1).drop("__new")


def residues(atoms: DataFrame) -> DataFrame:
    """One row for each residue in file order: res_ord, ids, name, first and last atom, atoms, sse."""
    numbered = runs(atoms, KEY, ["atom_ord"], RES, "res_ord")
    return numbered.groupBy(*KEY, "res_ord", *RES).agg(
        F.min_by("res_name", "atom_ord").alias("res_name"), F.min_by("entity_id", "atom_ord").alias("entity_id"), F.min("atom_ord").alias("first_atom"), F.max("atom_ord").alias("last_atom"), F.count(F.lit(1)).alias("n_atoms"),
    )


def counts(atoms: DataFrame) -> DataFrame:
    """Atoms, residues and chains of each model; the first model's number of models."""
    res = residues(atoms).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_residues"))
    return atoms.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_atoms"), F.count_distinct("chain_id").alias("n_chains")).join(res, KEY)


def is_sorted(atoms: DataFrame) -> DataFrame:
    """Whether each model's atoms stand by chain, residue, insertion code and serial."""
    w = Window.partitionBy(*KEY).orderBy("atom_ord")
    at = F.struct("chain_id", "res_seq", "i_code", "serial")
    checked = atoms.select(*KEY, F.coalesce(F.lag(at).over(w) <= at, F.lit(True)).alias("ok"))
    return checked.groupBy(*KEY).agg(F.bool_and("ok").alias("is_sorted"))


def sort_atoms(atoms: DataFrame) -> DataFrame:
    return atoms.orderBy(*KEY, *RES, "serial")


def complete_backbones(atoms: DataFrame) -> DataFrame:
    """Residues with N, CA, C and O."""
    got = atoms.where(F.trim("name").isin(*C.COMPLETE_BACKBONE)).groupBy(*KEY, *RES).agg(F.count_distinct(F.trim("name")).alias("n"))
    return got.where(F.col("n") == len(C.COMPLETE_BACKBONE)).drop("n")


def complete_residues(atoms: DataFrame, reference: DataFrame, heavy_only: bool = False) -> DataFrame:
    """Residues with as many atoms as the reference (code3, atom_name, leaving, element) keeps."""
    kept = reference.where(~F.col("leaving"))
    own = atoms
    if heavy_only:
        kept, own = kept.where("element <> 'H'"), atoms.where(~A.is_hydrogen())
    wanted = kept.groupBy(F.col("code3").alias("res_name")).agg(F.count(F.lit(1)).alias("wanted"))
    have = own.groupBy(*KEY, *RES, "res_name").agg(F.count(F.lit(1)).alias("n"))
    return have.join(wanted, "res_name").where("n >= wanted").drop("n", "wanted")


def remove_ligands(atoms: DataFrame) -> DataFrame:
    """Keep of each chain the entity of its first atom."""
    main = atoms.groupBy(*KEY, "chain_id").agg(F.min_by("entity_id", "atom_ord").alias("__main"))
    return atoms.join(main, [*KEY, "chain_id"]).where("entity_id = __main").drop("__main")


def renumber(atoms: DataFrame) -> DataFrame:
    """Serials from 1 in each model, residues from 1 in each chain, blank insertion codes."""
    numbered = runs(atoms, [*KEY, "chain_id"], ["atom_ord"], ["res_seq", "i_code"], "__res")
    serial = F.row_number().over(Window.partitionBy(*KEY).orderBy("atom_ord"))
    return numbered.withColumns({"serial": serial, "res_seq": (F.col("__res") + 1).cast("int"), "i_code": F.lit(" ")}).drop("__res")


#: Chain ids that a PDB file can hold, in order.
PDB_CHAINS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
MAX_ATOMS = 99_999


def pdb_compatible(atoms: DataFrame) -> DataFrame:
    """Chains mapped to one character, serials and residues renumbered; raises in the task beyond the limits."""
    chain = F.dense_rank().over(Window.partitionBy(*KEY).orderBy("chain_id"))
    out = renumber(atoms).withColumn("__c", chain)
    over = (F.col("__c") > len(PDB_CHAINS)) | (F.col("serial") > MAX_ATOMS)
    fail = F.raise_error(F.lit(f"more than {MAX_ATOMS} atoms or {len(PDB_CHAINS)} chains"))
    return out.withColumn("chain_id", F.when(over, fail.cast("string")).otherwise(F.substr(F.lit(PDB_CHAINS), F.col("__c"), F.lit(1)))).drop("__c")


def hybrid36(number: Column | str, width: int) -> Column:
    """A whole number in `width` places: decimal while it fits, then base 36 with a capital, then with a small letter first."""
    n = (F.col(number) if isinstance(number, str) else number).cast("long")
    ten, digits = 10**width, 36 ** (width - 1)
    fits = n.between(-(10 ** (width - 1)) + 1, ten - 1)
    capital, small = F.conv((n - ten + 10 * digits).cast("string"), 10, 36), F.lower(F.conv((n - ten - 16 * digits).cast("string"), 10, 36))
    beyond = F.raise_error(F.concat(n.cast("string"), F.lit(f" does not fit in {width} places"))).cast("string")
    text = F.when(fits, n.cast("string")).when(n.between(ten, ten + 26 * digits - 1), capital).when(n.between(ten, ten + 52 * digits - 1), small)
    return F.lpad(text.when(n.isNotNull(), beyond), width, " ")


def atom_line() -> Column:
    """A row as an ATOM or HETATM record; numbers too long for their columns are in hybrid-36."""
    kind = F.when(F.col("is_hetero"), "HETATM").otherwise("ATOM  ")
    return F.format_string(
        "%s%5s %-4s%1s%3s %1s%4s%1s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s%2s", kind, hybrid36("serial", 5), "name", "alt_loc", "res_name", "chain_id", hybrid36("res_seq", 4), "i_code", "x", "y", "z", "occupancy", "temp_factor",
        F.coalesce("element", F.lit("")), F.coalesce("charge", F.lit("")),
    )


def set_model(atoms: DataFrame, model_coords: DataFrame, model: int) -> DataFrame:
    """Coordinates of another model under the first one's atoms."""
    other = model_coords.where(F.col("model") == model).select("deposit_id", "atom_ord", "x", "y", "z")
    return atoms.drop("x", "y", "z").join(other, ["deposit_id", "atom_ord"]).withColumn("model", F.lit(model))


def annotate_ranges(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, first: str, last: str, order: str, value: str, width: int = 64) -> DataFrame:
    """`points` with the value of the last range, by order, that holds them; null without one.

    Ranges and points meet in blocks of `width` positions, by an equi-join.
    """
    spread = ranges.where(F.col(first) <= F.col(last)).select(*keys, F.col(first).alias("__a"), F.col(last).alias("__b"), F.col(order).alias("__o"), F.col(value).alias("__v")).withColumn("__k", F.explode(F.sequence(F.floor(F.col("__a") / width), F.floor(F.col("__b") / width))))
    met = points.select(*keys, at).distinct().withColumn("__k", F.floor(F.col(at) / width)).join(spread, [*keys, "__k"]).where(F.col(at).between(F.col("__a"), F.col("__b")))
    best = met.groupBy(*keys, at).agg(F.max_by("__v", "__o").alias(value))
    return points.join(best, [*keys, at], "left")


def polymer_residues(atoms: DataFrame) -> DataFrame:
    """The residues, water left out, of each chain's largest entity; ties go to the entity met first."""
    res = residues(atoms).where("res_name <> 'HOH'")
    size = res.groupBy(*KEY, "chain_id", "entity_id").agg(F.count(F.lit(1)).alias("n"), F.min("res_ord").alias("first"))
    main = size.groupBy(*KEY, "chain_id").agg(F.max_by("entity_id", F.struct("n", -F.col("first"))).alias("entity_id"))
    return res.join(main, [*KEY, "chain_id", "entity_id"])


def chain_sequences(atoms: DataFrame, types: DataFrame) -> DataFrame:
    """deposit_id, model, chain_id, sequence: letters of the chain's largest entity without water; unknown is X."""
    own = polymer_residues(atoms).join(bounded(types.select(F.col("code3").alias("res_name"), "code1")), "res_name", "left")
    letters = F.transform(F.array_sort(F.collect_list(F.struct("res_ord", F.coalesce("code1", F.lit("X")).alias("c")))), lambda x: x["c"])
    return own.groupBy(*KEY, "chain_id").agg(F.array_join(letters, "").alias("sequence"))


def entity_ids(atoms: DataFrame) -> DataFrame:
    """deposit_id, model, entity_ids: sorted and distinct; a deposit's own number of entities bounds the row."""
    return atoms.groupBy(*KEY).agg(F.array_sort(F.collect_set("entity_id")).alias("entity_ids"))


def best_entity_chains(sequences: DataFrame, entities: DataFrame) -> DataFrame:
    """deposit_id, model, entity_id, chain_id, sequence: the longest chain of each L-polypeptide; ties go to the chain named first.

    entities: deposit_id, entity_id, polymer_type, chains.
    """
    own = entities.where(polymer_kind("polymer_type") == "PolypeptideL").select("deposit_id", "entity_id", F.posexplode("chains").alias("__at", "chain_id"))
    best = F.max_by(F.struct("chain_id", "sequence"), F.struct(F.length("sequence"), -F.col("__at"))).alias("r")
    return sequences.join(own, ["deposit_id", "chain_id"]).groupBy(*KEY, "entity_id").agg(best).select(*KEY, "entity_id", "r.*")


def d_residues(atoms: DataFrame, types: DataFrame) -> DataFrame:
    """deposit_id, model, counts, percent: residues that may be D-amino acids by name, and their share of all peptide residues.

    types: code3, type (the component's type text). Types that state no configuration count as D too.
    """
    kind = F.col("type")
    own = residues(atoms).join(bounded(types.select(F.col("code3").alias("res_name"), "type")), "res_name").where(C.is_peptide_linking(kind))
    by_name = own.groupBy(*KEY, "res_name").agg(F.count(F.lit(1)).alias("n"), F.bool_or(C.is_d_peptide_linking(kind)).alias("d"))
    some = F.sort_array(F.collect_list(F.when(F.col("d"), F.struct("res_name", "n"))))
    return by_name.groupBy(*KEY).agg(some.alias("counts"), (100.0 * F.coalesce(F.sum(F.when(F.col("d"), F.col("n"))), F.lit(0)) / F.sum("n")).alias("percent"))


def entity_listing(atoms: DataFrame, entities: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """deposit_id, model, entity_id, line: the entities that the atoms hold, with their chains there, a polymer's reference and, if types are given, its letters.

    entities: deposit_id, entity_id, type, description, chains, db_code, monomers.
    """
    there = atoms.groupBy(*KEY, "entity_id").agg(F.collect_set("chain_id").alias("__seen"))
    met = there.join(entities, ["deposit_id", "entity_id"])
    polymer = F.col("type") == "polymer"
    parts = ["entity_id", F.trim("description"), F.array_join(F.filter("chains", lambda c: F.array_contains("__seen", c)), " "), F.when(polymer, F.col("db_code"))]
    if types is not None:
        letter = types.select(F.col("code3").alias("__code"), "code1")
        at = [*KEY, "entity_id"]
        cells = met.where(polymer).select(*at, F.posexplode("monomers").alias("__at", "__code")).join(bounded(letter), "__code", "left")
        spelt = cells.groupBy(*at).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", F.coalesce("code1", F.lit("X")).alias("c")))), lambda x: x["c"]), "").alias("__letters"))
        met = met.join(spelt, at, "left")
        parts.append("__letters")
    words = F.filter(F.array(*(F.col(p) if isinstance(p, str) else p for p in parts)), lambda w: w.isNotNull() & (w != ""))
    return met.select(*KEY, "entity_id", F.array_join(words, " ").alias("line"))


def longest_chains(sequences: DataFrame) -> DataFrame:
    """The longest chain of each model; ties go to the first id."""
    best = F.max_by(F.struct("chain_id", "sequence"), F.struct(F.length("sequence"), F.transform(F.split("chain_id", ""), lambda c: -F.ascii(c)))).alias("r")
    return sequences.groupBy(*KEY).agg(best).select(*KEY, "r.*")


def hec_runs(text: DataFrame, keys: list[str], hec: str = "hec") -> DataFrame:
    """keys, segment, code, first, last: runs of an H/E/C string; segments count H and E runs only."""
    cells = text.select(*keys, F.posexplode(F.filter(F.split(hec, ""), lambda c: c != "")).alias("pos", "code"))
    runs_ = runs(cells, keys, ["pos"], ["code"]).groupBy(*keys, "run", "code").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    w = Window.partitionBy(*keys).orderBy("first")
    return runs_.withColumn("segment", F.when(F.col("code") != "C", F.sum(F.when(F.col("code") != "C", 1).otherwise(0)).over(w))).drop("run")


def backbone(atoms: DataFrame) -> DataFrame:
    """One row for each residue with its n, ca, c and o points (null if absent) and res_ord; the grouping is one pass."""
    own = runs(atoms, KEY, ["atom_ord"], RES, "res_ord").where(A.is_peptide())
    point = G.vec("x", "y", "z")
    pick = lambda n: F.min_by(F.when(F.trim("name") == n, point), F.when(F.trim("name") == n, F.col("atom_ord"))).alias(n.lower())
    return own.groupBy(*KEY, "res_ord", *RES).agg(F.min("res_name").alias("res_name"), *map(pick, C.COMPLETE_BACKBONE))


def phi_psi(atoms: DataFrame) -> DataFrame:
    """Backbone dihedrals in degrees; null at chain ends."""
    w = Window.partitionBy(*KEY, "chain_id").orderBy("res_ord")
    b = backbone(atoms).withColumns({"prev_c": F.lag("c").over(w), "next_n": F.lead("n").over(w)})
    n, ca, c = F.col("n"), F.col("ca"), F.col("c")
    return b.select(*KEY, *RES, "res_ord", F.degrees(G.dihedral_angle4(F.col("prev_c"), n, ca, c)).alias("phi"), F.degrees(G.dihedral_angle4(n, ca, c, F.col("next_n"))).alias("psi"))


def peptide_bonds(atoms: DataFrame, cutoff: float = 1.4) -> DataFrame:
    """Adjacent residues whose C and N are closer than the cutoff."""
    w = Window.partitionBy(*KEY, "chain_id").orderBy("res_ord")
    b = backbone(atoms).withColumn("next_n", F.lead("n").over(w)).withColumn("next_ord", F.lead("res_ord").over(w))
    return b.where(G.distance(F.col("c"), F.col("next_n")) < cutoff).select(*KEY, "chain_id", "res_ord", "next_ord")


def contacts(atoms: DataFrame, cutoff: float, columns: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """Pairs of atoms of different residues within the cutoff, each once, the later residue first; `columns` of each atom, or all."""
    own = runs(atoms, KEY, ["atom_ord"], RES, "res_ord").select(*KEY, "atom_ord", "res_ord", *RES, "name", "x", "y", "z")
    return close_pairs(own, KEY, ["x", "y", "z"], cutoff, "res_ord", columns or own.columns, digits)


#: Most residues of a tile of a distance map.
TILE_RESIDUES = 4096


def distance_map(atoms: DataFrame, tile: int = 64, digits: int | None = None) -> DataFrame:
    """deposit_id, model, a_res_ord, b_res_ord, distance: least distance of the atoms of every pair of residues, the later one first.

    Every pair is what is asked. Residues meet in tiles of `tile`, or of an eighth of the largest
    model, so that no task holds a whole large one; a task makes a tile's pairs as arrays and sends
    them on, so no pair is shuffled.
    """
    own = cut(runs(atoms, KEY, ["atom_ord"], RES, "res_ord").select(*KEY, F.col("res_ord").cast("long").alias("r"), *(F.col(c).cast("double").alias(c) for c in "xyz")))
    largest = own.agg(F.max("r")).first()[0]
    side = max(1, tile, min(TILE_RESIDUES, -(-((largest or 0) + 1) // 8)))
    held = own.where(" and ".join(f"{k} is not null" for k in KEY)).groupBy(*KEY, F.floor(F.col("r") / side).alias("t")).agg(F.array_sort(F.collect_list(F.struct("r", *"xyz"))).alias("rows"))
    most = held.groupBy(*KEY).agg(F.max("t").alias("most"))
    spread = held.join(most, KEY)
    a = spread.select(*KEY, F.col("rows").alias("a"), F.col("t").alias("ta"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("t"))).alias("tb"))
    b = spread.select(*KEY, F.col("rows").alias("b"), F.col("t").alias("tb"), F.explode(F.sequence("t", "most")).alias("ta"))
    met = a.hint("merge").join(b, [*KEY, "ta", "tb"]).select(*KEY, "a", "b")
    kinds = {f.name: f.dataType.simpleString() for f in atoms.schema.fields}
    names = [*KEY, "a_res_ord", "b_res_ord", "distance"]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                (ra, xa), (rb, xb) = (_residues_of(batch.column(c).slice(k, 1).flatten()) for c in "ab")
                head = [batch.column(c) for c in KEY]
                for i, j, d in _least_distances(ra, xa, rb, xb):
                    for n in range(0, len(i), BATCH):
                        part = slice(n, n + BATCH)
                        own = d[part] if digits is None else rounded(d[part], digits)
                        at = pa.array(np.full(len(own), k))
                        yield pa.RecordBatch.from_arrays([*(c.take(at) for c in head), pa.array(i[part]), pa.array(j[part]), pa.array(own, from_pandas=True)], names)

    return met.mapInArrow(measured, f"deposit_id {kinds['deposit_id']}, model {kinds['model']}, a_res_ord long, b_res_ord long, distance double")


def _residues_of(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Residue and coordinates (not a number: null) of each atom, by residue."""
    return rows.field("r").to_numpy(), np.column_stack([rows.field(c).to_numpy(zero_copy_only=False) for c in "xyz"])


def _least_distances(ra: np.ndarray, xa: np.ndarray, rb: np.ndarray, xb: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (a's residue, b's, least distance of their atoms) with a's after b's; atoms stand by residue."""
    firsts = [np.concatenate([[0], np.nonzero(r[1:] != r[:-1])[0] + 1]) for r in (ra, rb)]
    ends, ids_a, ids_b = np.append(firsts[0], len(ra)), ra[firsts[0]], rb[firsts[1]]
    columns = np.ascontiguousarray(xb.T)
    at = 0
    while at < len(ids_a):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK // len(rb), side="right")) - 1)
        d2 = 0.0
        for mine, theirs in zip(xa[ends[at] : ends[to]].T, columns, strict=True):
            apart = mine[:, None] - theirs
            apart *= apart
            d2 = d2 + apart
        if to - at < len(d2):
            d2 = np.fmin.reduceat(d2, ends[at:to] - ends[at], axis=0)
        if len(ids_b) < len(rb):
            d2 = np.fmin.reduceat(d2, firsts[1], axis=1)
        own = np.broadcast_to(ids_a[at:to, None], d2.shape)
        other = np.broadcast_to(ids_b, d2.shape)
        later = own > other
        yield own[later], other[later], np.sqrt(d2[later])
        at = to


# --- hydrogen bonds -------------------------------------------------------------------------

#: Greatest H...O and N...O distances, least angles N-H-O and C-O-H.
HB_AH, HB_DA, HB_ANGLE = 3.0, 4.0, math.radians(100.0)


def hydrogen_bonds(atoms: DataFrame) -> DataFrame:
    """deposit_id, model, d, a, energy, ...: backbone bonds from residue number d's N-H to a's C=O.

    Residues are numbered over the peptide residues of a model. Hydrogens stand 1.0 off N. A grid
    join on N and O within 4.0 comes first, then distances and angles.
    """
    w = Window.partitionBy(*KEY, "chain_id").orderBy("res_ord")
    b = backbone(atoms).withColumn("prev_c", F.lag("c").over(w)).withColumn("res", F.dense_rank().over(Window.partitionBy(*KEY).orderBy("res_ord")) - 1)
    b = b.withColumn("h", F.when(F.col("prev_c").isNotNull() & F.col("n").isNotNull() & F.col("ca").isNotNull() & (F.col("res_name") != "PRO"), G.peptide_hydrogen(F.col("prev_c"), F.col("n"), F.col("ca"))))
    at = lambda p: [F.col(f"{p}.{k}").alias(k) for k in "xyz"]
    donors = b.where("h is not null").select(*KEY, "res", *RES, "n", "h", *at("n"))
    acceptors = b.where("c is not null and o is not null").select(*KEY, "res", *RES, "c", "o", *at("o"))
    met = within(donors, acceptors, ["x", "y", "z"], HB_DA, tuple(KEY)).where("a_res <> b_res")
    n, h, c, o = (F.col(x) for x in ("a_n", "a_h", "b_c", "b_o"))
    met = met.withColumns({"distance_ah": G.distance(h, o), "angle_ahd": G.planar_angle3(o, h, n), "angle_pah": G.planar_angle3(c, o, h), "energy": G.dssp_energy(n, h, c, o)})
    kept = met.where((F.col("distance_ah") <= HB_AH) & (F.col("angle_ahd") >= HB_ANGLE) & (F.col("angle_pah") >= HB_ANGLE))
    return kept.select(F.col("a_deposit_id").alias("deposit_id"), F.col("a_model").alias("model"), F.col("a_res").alias("d"), F.col("b_res").alias("a"), F.col("a_chain_id").alias("d_chain"), F.col("a_res_seq").alias("d_seq"), F.col("b_chain_id").alias("a_chain"), F.col("b_res_seq").alias("a_seq"), "distance", "distance_ah", "angle_ahd", "angle_pah", "energy")


def turns(bonds: DataFrame, n: int) -> DataFrame:
    """deposit_id, model, i: residues that accept from i + n."""
    return bonds.where(F.col("d") == F.col("a") + n).select(*KEY, F.col("a").alias("i")).distinct()


def bridges(bonds: DataFrame) -> DataFrame:
    """deposit_id, model, i, j, kind: residue pairs with the bonds of an antiparallel or parallel bridge."""
    p = bonds.select(*KEY, F.col("d").alias("d1"), F.col("a").alias("a1"))
    q = bonds.select(*KEY, F.col("d").alias("d2"), F.col("a").alias("a2"))
    rules = (
        ("antiparallel", F.col("d2") == F.col("a1"), F.col("a2") == F.col("d1"), F.col("a1"), F.col("d1")),
        ("antiparallel", F.col("d2") == F.col("a1") + 2, F.col("a2") == F.col("d1") - 2, F.col("a1") + 1, F.col("d1") - 1),
        ("parallel", F.col("d2") == F.col("a1") + 2, F.col("a2") == F.col("d1"), F.col("a1") + 1, F.col("d1")),
    )
    out = None
    for kind, left, right, i, j in rules:
        got = p.join(q, [p[k] == q[k] for k in KEY] + [left, right]).select(*(p[k] for k in KEY), i.alias("i"), j.alias("j"), F.lit(kind).alias("kind"))
        both = got.unionByName(got.select(*KEY, F.col("j").alias("i"), F.col("i").alias("j"), "kind"))
        out = both if out is None else out.unionByName(both)
    return out.distinct()


def dssp(atoms: DataFrame) -> DataFrame:
    """deposit_id, model, res, code: G, I and H from pairs of turns (later wins), E from bridges, else C."""
    bonds = hydrogen_bonds(atoms).cache()
    res = backbone(atoms).select(*KEY, F.dense_rank().over(Window.partitionBy(*KEY).orderBy("res_ord")).alias("r")).select(*KEY, (F.col("r") - 1).alias("res"))
    marks = None
    for order, (n, code) in enumerate(((3, "G"), (5, "I"), (4, "H"))):
        t = turns(bonds, n)
        before = t.select(*KEY, (F.col("i") + 1).alias("i"))
        got = t.join(before, [*KEY, "i"]).select(*KEY, F.explode(F.sequence(F.col("i"), F.col("i") + n - 1)).alias("res"), F.lit(order).alias("o"), F.lit(code).alias("code"))
        marks = got if marks is None else marks.unionByName(got)
    helix = marks.groupBy(*KEY, "res").agg(F.max_by("code", "o").alias("helix"))
    at = bridges(bonds).join(helix.select(*KEY, F.col("res").alias("i")), [*KEY, "i"], "left_anti").join(helix.select(*KEY, F.col("res").alias("j")), [*KEY, "j"], "left_anti")
    strand = at.select(*KEY, F.col("i").alias("res")).distinct().withColumn("strand", F.lit("E"))
    return res.join(helix, [*KEY, "res"], "left").join(strand, [*KEY, "res"], "left").select(*KEY, "res", F.coalesce("helix", "strand", F.lit("C")).alias("code"))


def ligands(monomers: DataFrame) -> DataFrame:
    """deposit_id, code: distinct non-polymer components that are not common additives. monomers: deposit_id, code, entity_type."""
    return monomers.where("entity_type = 'non-polymer'").where(~F.col("code").isin(*C.IRRELEVANT_LIGANDS)).select("deposit_id", "code").distinct()


def ca_axes(segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, begin, end points and length of each segment's principal axis, first to last. segments: keys, ord, x, y, z."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in segments.select(*keys).schema)

    def one(pdf):
        import numpy as np
        import pandas as pd

        p = pdf.sort_values("ord")[["x", "y", "z"]].to_numpy(float)
        mid = p.mean(axis=0)
        u = np.linalg.svd(p - mid, full_matrices=False)[2][0]
        u = u if (p[-1] - p[0]) @ u >= 0 else -u
        t = (p - mid) @ u
        a, b = mid + t.min() * u, mid + t.max() * u
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), *a, *b, float(t.max() - t.min())]], columns=[*keys, "bx", "by", "bz", "ex", "ey", "ez", "length"])

    return segments.groupBy(*keys).applyInPandas(one, f"{kinds}, bx double, by double, bz double, ex double, ey double, ez double, length double")
