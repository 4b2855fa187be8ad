"""Polymers from residue definitions: a row for each atom, built on three reference atoms by name.

A definition row says of an atom in which residue its references stand (-1 the one before, 0 its
own, 1 the next), its distance, planar and dihedral angle (radians) and the dihedral's name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandframe.operators.building import build_chains
from strandframe.operators.state import table

#: Columns of a definition; `block` names the residue or patch and `def_ord` the place in it.
DEFINITION = ("res_name", "a_loc", "a", "b_loc", "b", "c_loc", "c", "d_loc", "name", "element", "r", "planar", "dihedral", "dihedral_name")
PLACES = ("a", "b", "c")


def polymer(residues: DataFrame, definitions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, res_ord, def_ord and the definition of each atom, from keys, res_ord (from 0), block; raises for an unknown block."""
    known = definitions.withColumn("__known", F.lit(True))
    atoms = residues.select(*keys, "res_ord", "block").join(known, "block", "left")
    wrong = F.raise_error(F.concat(F.lit("no definition of "), F.coalesce("block", F.lit("null")))).cast("long")
    return atoms.select(*keys, "res_ord", F.when(F.col("__known"), F.col("def_ord")).otherwise(wrong).alias("def_ord"), *DEFINITION)


def patch(atoms: DataFrame, patches: DataFrame, definitions: DataFrame, keys: list[str]) -> DataFrame:
    """`atoms` with residues patched: a patch's row takes the place of the residue's atom of that name, or follows its last.

    patches: keys, res_ord, block, with one patch a residue; raises for a residue that the polymer lacks. The residue keeps its name.
    """
    at = [*keys, "res_ord"]
    own = atoms.groupBy(*at).agg(F.max("def_ord").alias("__last"), F.min_by("res_name", "def_ord").alias("__of"), F.map_from_entries(F.collect_list(F.struct("name", "def_ord"))).alias("__at"))
    new = polymer(patches, definitions, keys).join(own, at, "left")
    wrong = F.raise_error(F.concat(F.lit("no residue "), F.col("res_ord").cast("string"))).cast("long")
    place = F.when(F.col("__last").isNull(), wrong).otherwise(F.coalesce(F.col("__at")[F.col("name")], F.col("__last") + 1 + F.col("def_ord")))
    new = new.withColumns({"def_ord": place, "res_name": F.col("__of")}).select(atoms.columns)
    return atoms.join(new.select(*at, "name"), [*at, "name"], "left_anti").select(atoms.columns).unionByName(new)


def set_dihedral(atoms: DataFrame, name: str, value: Column | float, where: Column | None = None) -> DataFrame:
    """The named dihedral (radians) set in the residues where the condition holds; the others keep theirs."""
    hit = F.col("dihedral_name") == name
    return atoms.withColumn("dihedral", F.when(hit if where is None else hit & where, value).otherwise(F.col("dihedral")))


def named_dihedrals(atoms: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """keys, res_ord, dihedral: the named angle of the residues that define it."""
    return atoms.where(F.col("dihedral_name") == name).groupBy(*keys, "res_ord").agg(F.min_by("dihedral", "def_ord").alias("dihedral"))


def numbered(atoms: DataFrame, keys: list[str]) -> DataFrame:
    """`atoms` with `ord`, the atom's place in its polymer from 0."""
    return atoms.withColumn("ord", (F.row_number().over(Window.partitionBy(*keys).orderBy("res_ord", "def_ord")) - 1).cast("long"))


def atom_ranges(atoms: DataFrame, keys: list[str]) -> DataFrame:
    """keys, res_ord, res_name, first, last, n_atoms: each residue's atoms in its polymer."""
    return numbered(atoms, keys).groupBy(*keys, "res_ord").agg(F.min_by("res_name", "def_ord").alias("res_name"), F.min("ord").alias("first"), F.max("ord").alias("last"), F.count(F.lit(1)).alias("n_atoms"))


def references(atoms: DataFrame, keys: list[str]) -> DataFrame:
    """Numbered atoms with a_ord, b_ord, c_ord: the places of the reference atoms.

    Equi-joins on polymer, residue and name, so nothing is searched for. The first three atoms
    have none. Raises where a later atom's reference does not exist.
    """
    own = numbered(atoms, keys)
    names = own.groupBy(*keys, "res_ord", "name").agg(F.min("ord").alias("found"))

    def with_place(df: DataFrame, p: str) -> DataFrame:
        there = names.select(*keys, F.col("res_ord").alias("__res"), F.col("name").alias("__name"), F.col("found").alias("__found"))
        met = df.withColumns({"__res": F.col("res_ord") + F.col(f"{p}_loc"), "__name": F.col(p)}).join(there, [*keys, "__res", "__name"], "left")
        wrong = F.raise_error(F.concat_ws(" ", F.lit("no atom"), "__name", F.lit("in residue"), F.col("__res").cast("string"))).cast("long")
        place = F.when(F.col("ord") < 3, F.lit(None).cast("long")).when(F.col("__found").isNull(), wrong).otherwise(F.col("__found"))
        return met.withColumn(f"{p}_ord", place).drop("__res", "__name", "__found")

    return reduce(with_place, PLACES, own)


def build(atoms: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ord, res_ord, res_seq (from 1), res_name, name, element, serial (from 1), x, y, z of all polymers, built side by side.

    An atom may stand on later ones; a polymer whose atoms stand on one another in a ring raises.
    """
    placed = table(references(atoms, keys), "polymers")  # read twice
    xyz = build_chains(placed.select(*keys, "ord", "r", "planar", "dihedral", *(F.col(f"{p}_ord").alias(p) for p in PLACES)), keys)
    about = placed.select(*keys, "ord", "res_ord", (F.col("res_ord") + 1).cast("int").alias("res_seq"), "res_name", "name", "element", (F.col("ord") + 1).cast("int").alias("serial"))
    return about.join(xyz, [*keys, "ord"])
