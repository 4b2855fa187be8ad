"""Queries of polymers, entities, components and reports, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions import entities as E
from strandframe.operators import align, polymers, spatial, structure
from strandframe.operators.state import table
from strandframe.plans.queries import query
from strandframe.plans.structure_queries import _ATOMS, _atoms, _path, _written
from strandframe.sources import files, writers

# --- polymers: one a nation, a residue for each supplier -------------------------------------

_COLUMNS = ("_res_name", *(f"_atom_{p}_{x}" for p in "abcd" for x in ("residue_locator", "name")), "_atom_d_element", "_c_d_bond_length", "_b_c_d_planar_angle", "_a_b_c_d_dihedral_angle", "_dihedral_angle_name")
_CHAIN = (
    "'aa ' prev ' N  ' prev ' CA ' prev ' C  ' this ' N  ' N 1.33 115.0 140.0 Psi", "'aa ' prev ' CA ' prev ' C  ' this ' N  ' THIS ' CA ' C 1.45 122.0 180.0 omega",
    "'aa ' Prev ' C  ' this ' N  ' this ' CA ' this ' C  ' C 1.52 111.0 -120.0 Phi", "'aa ' next ' N  ' this ' CA ' this ' C  ' this ' O  ' O 1.23 121.0 180.0 -",
)
_END = ("'end' this ' OXT' this ' CA ' this ' C  ' this ' O  ' O 1.25 120.0 180.0 -", "'end' this ' N  ' this ' CA ' this ' C  ' this ' OXT' O 1.22 117.0 160.0 Psi")
_PART = "row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1"
_ROWS = f"""s AS (SELECT s_nationkey AS chain, {_PART} AS res_ord, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
d(k, name, element, r, planar, dihedral, dihedral_name) AS (VALUES (0, ' N  ', 'N', 1.33, 115.0, 140.0, 'Psi'), (1, ' CA ', 'C', 1.45, 122.0, 180.0, 'omega'), (2, ' C  ', 'C', 1.52, 111.0, -120.0, 'Phi'), (3, ' O  ', 'O', 1.23, 121.0, 180.0, '-'), (4, ' OXT', 'O', 1.22, 117.0, 160.0, 'Psi')),
p AS (SELECT chain, res_ord, n, res_ord * 4 + k AS ord, k, name, element, CASE WHEN k = 3 AND res_ord = n - 1 THEN 1.25 ELSE r END::DOUBLE AS r, radians(CASE WHEN k = 3 AND res_ord = n - 1 THEN 120.0 ELSE planar END) AS planar,
 radians(CASE WHEN dihedral_name = 'Phi' AND res_ord % 2 = 1 THEN -60.0 ELSE dihedral END) AS dihedral, dihedral_name FROM s, d WHERE k < 4 OR res_ord = n - 1)"""


def _definitions(spark) -> DataFrame:
    """Definitions read from a folder with a file for the residue and one for its end."""
    folder = _path(spark, "definitions")
    for block, rows in (("aa_", _CHAIN), ("patch_end", _END)):
        text = "\n".join((f"data_{block}", "loop_", *_COLUMNS, *rows, "#"))
        one = spark.createDataFrame([(text,)], "value string").coalesce(1)
        one.write.text(f"{folder}/{block}")
    return files.definitions(files.read_cif(spark, [f"{folder}/aa_", f"{folder}/patch_end"], glob="*.txt"))


def _polymers(spark, t) -> DataFrame:
    numbered = t("supplier").select(F.col("s_nationkey").alias("chain"), F.expr(_PART).alias("res_ord"), F.lit("aa_").alias("block"))
    ends = numbered.groupBy("chain").agg(F.max("res_ord").alias("res_ord")).withColumn("block", F.lit("patch_end"))
    known = _definitions(spark)
    atoms = polymers.patch(polymers.polymer(numbered, known, ["chain"]), ends, known, ["chain"])
    return polymers.set_dihedral(atoms, "Phi", F.radians(F.lit(-60.0)), F.col("res_ord") % 2 == 1)


@query(f"""WITH {_ROWS} SELECT chain, ord, res_ord, 'aa ' AS res_name, name, element, r, planar, dihedral, dihedral_name,
 CASE WHEN ord < 3 THEN NULL WHEN k = 3 THEN CASE WHEN res_ord = n - 1 THEN ord + 1 ELSE ord + 1 END WHEN k = 4 THEN ord - 4 WHEN k = 0 THEN ord - 4 WHEN k = 1 THEN ord - 4 ELSE ord - 4 END AS a_ord,
 CASE WHEN ord < 3 THEN NULL WHEN k = 0 THEN ord - 3 WHEN k = 1 THEN ord - 3 WHEN k = 2 THEN ord - 2 WHEN k = 3 THEN ord - 2 ELSE ord - 3 END AS b_ord,
 CASE WHEN ord < 3 THEN NULL WHEN k = 0 THEN ord - 2 WHEN k = 4 THEN ord - 2 ELSE ord - 1 END AS c_ord FROM p""")
def polymer_references(spark, t):
    got = polymers.references(_polymers(spark, t), ["chain"])
    return got.select("chain", "ord", "res_ord", "res_name", "name", "element", "r", "planar", "dihedral", "dihedral_name", "a_ord", "b_ord", "c_ord")


@query(f"""WITH {_ROWS} SELECT chain, res_ord, 'aa ' AS res_name, min(ord) AS "first", max(ord) AS "last", count(*) AS n_atoms, min(dihedral) FILTER (dihedral_name = 'Phi') AS phi FROM p GROUP BY chain, res_ord""")
def polymer_ranges(spark, t):
    atoms = _polymers(spark, t)
    phi = polymers.named_dihedrals(atoms, "Phi", ["chain"]).withColumnRenamed("dihedral", "phi")
    return polymers.atom_ranges(atoms, ["chain"]).join(phi, ["chain", "res_ord"])


@query(f"""WITH {_ROWS} SELECT chain, ord, (ord + 1)::INT AS serial, (res_ord + 1)::INT AS res_seq, 'aa ' AS res_name, name, element, round(CASE WHEN ord >= 3 THEN r END, 6) AS bond, round(CASE WHEN ord >= 3 THEN cos(planar) END, 6) AS bend FROM p""")
def polymer_coordinates(spark, t):
    """Built atoms, whose bonds and angles, measured again, are those of their definitions."""
    atoms = table(_polymers(spark, t), "atoms")
    xyz = polymers.build(atoms, ["chain"])
    refs = polymers.references(atoms, ["chain"]).select("chain", "ord", "b_ord", "c_ord")
    at = lambda p: xyz.select("chain", F.col("ord").alias(f"{p}_ord"), F.array("x", "y", "z").alias(p))
    met = xyz.join(refs, ["chain", "ord"]).join(at("b"), ["chain", "b_ord"], "left").join(at("c"), ["chain", "c_ord"], "left").withColumn("d", F.array("x", "y", "z"))
    bond, base, across = F.sqrt(spatial.squared_distance("c", "d")), F.sqrt(spatial.squared_distance("b", "c")), spatial.squared_distance("b", "d")
    bend = (bond * bond + base * base - across) / (2 * bond * base)
    return met.select("chain", "ord", "serial", "res_seq", "res_name", "name", "element", F.round(bond, 6).alias("bond"), F.round(bend, 6).alias("bend"))


# --- entities, components, reports -----------------------------------------------------------


@query("""SELECT n_nationkey, (['Polymer','Non-polymer','Water','Branched'])[n_nationkey % 4 + 1] AS entity, (['PolypeptideL','PolypeptideD','DNA','RNA','DNA','PeptideNucleicAcid','Other'])[n_nationkey % 7 + 1] AS polymer,
 (['Natural','GeneticallyManipulated','Synthesized'])[n_nationkey % 3 + 1] AS source, n_nationkey % 2 = 0 AS flag, (n_nationkey % 3 - 1)::INT AS place FROM nation""")
def entity_kinds(spark, t):
    k = F.col("n_nationkey")
    pick = lambda *values: F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))
    return t("nation").select(
        "n_nationkey", E.entity_kind(pick("polymer", "non-polymer", "water", "branched")).alias("entity"),
        E.polymer_kind(pick("polypeptide(L)", "polypeptide(D)", "polydeoxyribonucleotide", "'polyribonucleotide'", "a dna strand", "peptide nucleic acid", "other")).alias("polymer"),
        E.source_kind(pick("nat", "man", "syn")).alias("source"), E.parse_bool(pick("Y", "N", "true", "false", "y", "n")).alias("flag"), E.locator(pick("prev", "This", "NEXT")).alias("place"),
    )


@query("""SELECT 'C' || p_partkey AS code3, ord::INT AS ord, name AS atom_name, ord = 2 AS leaving, element, CASE WHEN p_partkey % 3 = 0 THEN 'peptide' WHEN p_partkey % 3 = 1 THEN 'nucleic' ELSE 'other' END AS kind, p_size / 2.0 + ord AS x, ' ' || rpad(name, 3, ' ') AS padded,
 CASE WHEN ord = 2 THEN '1' END AS charge, 1 AS res_seq FROM part, (VALUES (1, 'C1', 'C'), (2, 'H2', 'H')) v(ord, name, element)""")
def chemical_components(spark, t):
    key, size = F.col("p_partkey").cast("long"), (F.col("p_size") / 2.0)
    kind = F.when(key % 3 == 0, "L-PEPTIDE LINKING").when(key % 3 == 1, "DNA LINKING").otherwise("NON-POLYMER")
    atom = lambda ord_, name, element, flag, charge: F.format_string(f"C%d {ord_} {name} C%d %f 0.0 1.0 {charge} {element} {flag}", key, key, size + ord_)
    names = "comp_id pdbx_ordinal atom_id pdbx_component_comp_id model_Cartn_x model_Cartn_y model_Cartn_z charge type_symbol pdbx_leaving_atom_flag"
    head = F.format_string("data_C%d\n_chem_comp.id C%d\n_chem_comp.type '%s'\nloop_\n" + "\n".join(f"_chem_comp_atom.{n}" for n in names.split()), key, key, kind)
    text = t("part").select(F.concat_ws("\n", head, atom(1, "C1", "C", "N", 0), atom(2, "H2", "H", "Y", 1)).alias("value"))
    values = files.read_cif(spark, _written(text, "components"))
    atoms = files.component_atoms(values.withColumn("block_idx", F.lit(0))).select(F.col("res_name").alias("code3"), F.col("serial").alias("ord"), "x", F.col("name").alias("padded"), "charge", "res_seq")
    return files.component_reference(values).join(atoms, ["code3", "ord"]).join(files.component_types(values).select("code3", "kind"), "code3")


_RES = f"SELECT deposit_id, model, chain_id, entity_id, res_seq, res_name FROM ({_ATOMS}) GROUP BY ALL"


@query(f"""WITH r AS ({_RES}), w AS (SELECT *, CASE WHEN res_name IN ('ALA', 'TRP') THEN 'd' WHEN res_name = 'GLY' THEN 'd' WHEN res_name = 'HIS' THEN 'l' END AS kind FROM r)
SELECT deposit_id, model, coalesce(string_agg(DISTINCT res_name, ' ' ORDER BY res_name) FILTER (kind = 'd'), '') AS names, count(*) FILTER (kind = 'd') AS n, round(100.0 * count(*) FILTER (kind = 'd') / count(*), 6) AS percent, any_value(ids) AS entities
FROM w JOIN (SELECT deposit_id, string_agg(DISTINCT entity_id, ' ' ORDER BY entity_id) AS ids FROM r GROUP BY 1) USING (deposit_id) WHERE kind IS NOT NULL GROUP BY deposit_id, model""")
def d_residues(spark, t):
    types = spark.createDataFrame([("ALA", "D-PEPTIDE LINKING"), ("TRP", "D-peptide linking"), ("GLY", "PEPTIDE LINKING"), ("HIS", "L-PEPTIDE LINKING"), ("DA", "DNA LINKING")], "code3 string, type string")
    atoms = _atoms(t)
    got = structure.d_residues(atoms, types).join(structure.entity_ids(atoms), ["deposit_id", "model"])
    n = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    return got.select("deposit_id", "model", F.array_join(F.transform("counts", lambda x: x["res_name"]), " ").alias("names"), n.alias("n"), F.round("percent", 6).alias("percent"), F.array_join("entity_ids", " ").alias("entities"))


def _entities(spark) -> DataFrame:
    rows = [("1", "polymer", " a chain ", ["C", "A"], "P00001", ["ALA", "GLY", "XYZ"], "polypeptide(L)"), ("2", "non-polymer", "metal", ["B"], "none", None, "other")]
    return spark.createDataFrame(rows, "entity_id string, type string, description string, chains array<string>, db_code string, monomers array<string>, polymer_type string")


_LETTERS = "CASE res_name WHEN 'ALA' THEN 'A' WHEN 'GLY' THEN 'G' WHEN 'TRP' THEN 'W' WHEN 'DA' THEN 'A' WHEN 'HIS' THEN 'H' ELSE 'X' END"


@query(f"""WITH r AS ({_RES}), c AS (SELECT deposit_id, model, entity_id, max((chain_id = 'C')::INT) AS c, max((chain_id = 'A')::INT) AS a, max((chain_id = 'B')::INT) AS b FROM r GROUP BY ALL)
SELECT deposit_id, model, entity_id, CASE WHEN entity_id = '1' THEN '1 a chain' || CASE WHEN c = 1 THEN ' C' ELSE '' END || CASE WHEN a = 1 THEN ' A' ELSE '' END || ' P00001 AGX' ELSE '2 metal' || CASE WHEN b = 1 THEN ' B' ELSE '' END END AS line FROM c""")
def entity_listing(spark, t):
    from strandframe.functions.chemistry import residue_types

    atoms = _atoms(t)
    listed = atoms.select("deposit_id").distinct().crossJoin(F.broadcast(_entities(spark)))  # two entities a deposit
    return structure.entity_listing(atoms, listed, residue_types(spark))


@query(f"""WITH r AS (SELECT * FROM ({_RES}) WHERE res_name <> 'HOH'), s AS (SELECT deposit_id, model, chain_id, entity_id, count(*) AS n, min(res_seq) AS f FROM r GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY deposit_id, model, chain_id ORDER BY n DESC, f) AS k FROM s),
q AS (SELECT deposit_id, model, chain_id, string_agg({_LETTERS}, '' ORDER BY res_seq) AS sequence FROM r JOIN m USING (deposit_id, model, chain_id, entity_id) WHERE k = 1 GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY deposit_id, model ORDER BY length(sequence) DESC, chain_id DESC) AS k FROM q WHERE chain_id IN ('A', 'C')) SELECT deposit_id, model, '1' AS entity_id, chain_id, sequence FROM b WHERE k = 1""")
def best_entity_chains(spark, t):
    from strandframe.functions.chemistry import residue_types

    atoms = _atoms(t)
    listed = atoms.select("deposit_id").distinct().crossJoin(F.broadcast(_entities(spark)))  # two entities a deposit
    return structure.best_entity_chains(structure.chain_sequences(atoms, residue_types(spark)), listed)


@query(f"""SELECT deposit_id, count(*) AS n, sum(res_seq)::BIGINT AS res_seqs, min(name) AS first_name, max(chain_id) AS last_chain FROM ({_ATOMS}) GROUP BY 1
UNION ALL SELECT 'cif', (count(*))::BIGINT, sum(p_partkey)::BIGINT, ' CA ', 'Z' FROM part""")
def structures_of_any_format(spark, t):
    """PDB files by deposit and a CIF file in one folder, read by one reader."""
    folder = _path(spark, "structures")
    writers.write_pdb(_atoms(t), f"{folder}/pdb")
    head = "data_x\nloop_\n" + "\n".join(f"_atom_site.{n}" for n in "group_PDB id auth_atom_id label_comp_id auth_asym_id label_entity_id auth_seq_id Cartn_x Cartn_y Cartn_z type_symbol".split())
    line = F.format_string("ATOM %d CA GLY Z 1 %d %f 0.0 0.0 C", "p_partkey", "p_partkey", F.col("p_size") / 2.0)
    lines = t("part").select(F.lit(1).alias("k"), line.alias("value")).unionByName(spark.createDataFrame([(0, head)], "k int, value string"))
    lines.coalesce(1).sortWithinPartitions("k").select("value").write.text(f"{folder}/cif")
    pdb = files.read_structure(spark, f"{folder}/pdb/*")
    cif = files.read_structure(spark, f"{folder}/cif").withColumn("deposit_id", F.lit("cif"))
    named = pdb.withColumn("deposit_id", F.concat(F.lit("dep"), (F.col("res_seq") * 0).cast("string")))
    by_residue = _atoms(t).select("deposit_id", "res_seq").distinct()
    named = named.drop("deposit_id").join(by_residue, "res_seq").select(cif.columns)
    return named.unionByName(cif).groupBy("deposit_id").agg(F.count(F.lit(1)).alias("n"), F.sum("res_seq").alias("res_seqs"), F.min("name").alias("first_name"), F.max("chain_id").alias("last_chain"))


@query("""SELECT s_suppkey, rpad(substr(s_name, 1, 6), 6, ' ') || '     1 ACDE-     4' || chr(10) || repeat(' ', 13) || 'A DE ' || chr(10) || 'templ      1 A-DEF     4' || chr(10) || rpad(substr(s_name, 1, 6), 6, ' ') || '     5 GG     6' || chr(10) || repeat(' ', 13) || '| ' || chr(10) || 'templ      5 GC     6' AS value FROM supplier""".replace("'A DE '", "'| || '"))
def pairwise_blocks(spark, t):
    rows = t("supplier").select("s_suppkey", F.col("s_name").alias("n"), F.lit("ACDE-GG").alias("q"), F.lit("A-DEFGC").alias("t"))
    return rows.select("s_suppkey", align.pairwise_blocks("q", "t", "n", F.lit("templ"), 6, 5).alias("value"))
