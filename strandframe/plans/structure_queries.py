"""Queries of structures, geometry and file formats: texts are written to the shared folder, read again and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions import atoms as A
from strandframe.functions import chemistry as C
from strandframe.functions import geometry as G
from strandframe.functions import sequences as S
from strandframe.functions.ids import first_id, full_id, sequence_ids, sorted_ids
from strandframe.operators import structure, taxonomy
from strandframe.operators.state import shared_dir
from strandframe.plans.queries import query
from strandframe.sources import files, writers

# --- atoms made of customers: one residue each, one deposit a nation, three chains -----------

_RESIDUES = ("ALA", "GLY", "TRP", "HOH", "DA", "HIS", "ZN")
_NAMES = ((0, " N  ", "N"), (1, " CA ", "C"), (2, " C  ", "C"), (3, " O  ", "O"))
_ATOMS = """SELECT 'dep' || c_nationkey AS deposit_id, 1 AS model, (c_custkey * 4 + a)::INT AS atom_ord, (c_custkey * 4 + a + 1)::INT AS serial, name, ' ' AS alt_loc,
 (['ALA','GLY','TRP','HOH','DA','HIS','ZN'])[c_custkey % 7 + 1] AS res_name, (['A','B','C'])[c_custkey % 3 + 1] AS chain_id, (c_custkey % 2 + 1)::VARCHAR AS entity_id, c_custkey::INT AS res_seq, ' ' AS i_code,
 10 * cos(0.3 * c_custkey) + 0.7 * a AS x, 10 * sin(0.3 * c_custkey) + 0.4 * a * (c_custkey % 3) AS y, 0.5 * (c_custkey % 50) + 0.2 * a * a AS z, element, c_custkey % 7 = 6 AS is_hetero
 FROM customer, (VALUES (0, ' N  ', 'N'), (1, ' CA ', 'C'), (2, ' C  ', 'C'), (3, ' O  ', 'O')) v(a, name, element)"""


def _atoms(t) -> DataFrame:
    k = F.col("c_custkey")
    parts = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(n).alias("name"), F.lit(e).alias("element")) for a, n, e in _NAMES)))
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    df = t("customer").select("c_custkey", "c_nationkey", parts.alias("p")).select("c_custkey", "c_nationkey", "p.*")
    a = F.col("a")
    return df.select(
        F.concat(F.lit("dep"), "c_nationkey").alias("deposit_id"), F.lit(1).alias("model"), (k * 4 + a).cast("int").alias("atom_ord"), (k * 4 + a + 1).cast("int").alias("serial"), "name", F.lit(" ").alias("alt_loc"),
        pick(_RESIDUES, k % 7).alias("res_name"), pick("ABC", k % 3).alias("chain_id"), (k % 2 + 1).cast("string").alias("entity_id"), k.cast("int").alias("res_seq"), F.lit(" ").alias("i_code"),
        (10 * F.cos(0.3 * k) + 0.7 * a).alias("x"), (10 * F.sin(0.3 * k) + 0.4 * a * (k % 3)).alias("y"), (0.5 * (k % 50) + 0.2 * a * a).alias("z"), F.lit(1.0).alias("occupancy"), F.lit(0.0).alias("temp_factor"), "element",
        F.lit(None).cast("string").alias("charge"), (k % 7 == 6).alias("is_hetero"),
    )


@query(f"""SELECT deposit_id, atom_ord, chain_id = 'B' AS of_chain, entity_id = '2' AS of_entity, chain_id = 'B' AND res_seq = 7 AS of_residue, res_name = 'TRP' AS of_type,
 chain_id = 'B' AND res_seq BETWEEN 10 AND 40 AS of_range, res_name IN ('TRP', 'HIS') AS aromatic, res_name IN ('ALA', 'GLY', 'TRP', 'HIS') AS peptide, res_name = 'DA' AS nucleic, res_name IN ('ALA', 'GLY', 'TRP', 'HIS') AS backbone,
 name = ' CA ' AS ca, false AS cb, false AS hydrogen, res_name <> 'HOH' AS not_water, NOT chain_id = 'A' AS inverted, chain_id = 'A' AND name = ' CA ' AS both FROM ({_ATOMS})""")
def atom_predicates(spark, t):
    return _atoms(t).select(
        "deposit_id", "atom_ord", A.by_chain("B").alias("of_chain"), A.by_entity("2").alias("of_entity"), A.by_residue(*A.parse_residue_id("B:7")).alias("of_residue"), A.by_residue_type("TRP").alias("of_type"),
        A.by_residue_range(A.parse_residue_id("B:10"), A.parse_residue_id("B:40")).alias("of_range"), A.is_aromatic().alias("aromatic"), A.is_peptide().alias("peptide"), A.is_nucleic().alias("nucleic"),
        A.is_backbone().alias("backbone"), A.is_ca().alias("ca"), A.is_cb().alias("cb"), A.is_hydrogen().alias("hydrogen"), A.is_not_water().alias("not_water"), S.logical_not(A.by_chain("A")).alias("inverted"), S.all_of(A.by_chain("A"), A.is_ca()).alias("both"),
    )


@query(f"""SELECT deposit_id, model, dense_rank() OVER (PARTITION BY deposit_id ORDER BY res_seq) - 1 AS res_ord, chain_id, res_seq, i_code, res_name, entity_id, min(atom_ord) AS first_atom, max(atom_ord) AS last_atom, count(*) AS n_atoms
 FROM ({_ATOMS}) GROUP BY deposit_id, model, chain_id, res_seq, i_code, res_name, entity_id""")
def structure_residues(spark, t):
    return structure.residues(_atoms(t))


@query(f"SELECT deposit_id, model, count(*) AS n_atoms, count(DISTINCT chain_id) AS n_chains, count(DISTINCT res_seq) AS n_residues FROM ({_ATOMS}) GROUP BY ALL")
def structure_counts(spark, t):
    return structure.counts(_atoms(t))


@query(f"""WITH l AS (SELECT deposit_id, model, coalesce(lag(chain_id) OVER w < chain_id OR (lag(chain_id) OVER w = chain_id AND lag(atom_ord) OVER w <= atom_ord), true) AS ok FROM ({_ATOMS}) WINDOW w AS (PARTITION BY deposit_id ORDER BY atom_ord))
SELECT deposit_id, model, bool_and(ok) AS is_sorted FROM l GROUP BY ALL""")
def structure_is_sorted(spark, t):
    return structure.is_sorted(_atoms(t))


@query(f"SELECT DISTINCT deposit_id, model, chain_id, res_seq, i_code FROM ({_ATOMS}) WHERE res_seq % 5 <> 0")
def structure_complete_backbones(spark, t):
    return structure.complete_backbones(_atoms(t).where("res_seq % 5 <> 0 or name <> ' O  '"))


@query(f"""WITH a AS ({_ATOMS}), f AS (SELECT deposit_id, chain_id, arg_min(entity_id, atom_ord) AS main FROM a GROUP BY ALL) SELECT deposit_id, atom_ord FROM a JOIN f USING (deposit_id, chain_id) WHERE entity_id = main""")
def structure_without_ligands(spark, t):
    return structure.remove_ligands(_atoms(t)).select("deposit_id", "atom_ord")


@query(f"""SELECT deposit_id, atom_ord, (row_number() OVER (PARTITION BY deposit_id ORDER BY atom_ord))::INT AS serial, (dense_rank() OVER (PARTITION BY deposit_id, chain_id ORDER BY res_seq))::INT AS res_seq, i_code FROM ({_ATOMS})""")
def structure_renumbered(spark, t):
    return structure.renumber(_atoms(t)).select("deposit_id", "atom_ord", "serial", "res_seq", "i_code")


@query(f"""WITH a AS ({_ATOMS}), r AS (SELECT *, dense_rank() OVER (PARTITION BY deposit_id ORDER BY res_seq) - 1 AS res_ord FROM a)
SELECT p.deposit_id, p.atom_ord AS i, q.atom_ord AS j, round(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2), 6) AS distance FROM r p JOIN r q ON p.deposit_id = q.deposit_id AND p.res_ord > q.res_ord AND (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2 <= 16""")
def structure_contacts(spark, t):
    got = structure.contacts(_atoms(t), 4.0, ["deposit_id", "atom_ord"], 6)
    return got.select(F.col("a_deposit_id").alias("deposit_id"), F.col("a_atom_ord").alias("i"), F.col("b_atom_ord").alias("j"), "distance")


@query(f"""WITH a AS ({_ATOMS}), r AS (SELECT *, dense_rank() OVER (PARTITION BY deposit_id ORDER BY res_seq) - 1 AS res_ord FROM a WHERE name = ' CA ')
SELECT p.deposit_id, p.res_ord AS a_res_ord, q.res_ord AS b_res_ord, round(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2), 6) AS distance FROM r p JOIN r q ON p.deposit_id = q.deposit_id AND p.res_ord > q.res_ord""")
def structure_distance_map(spark, t):
    return structure.distance_map(_atoms(t).where(A.is_ca()), 16, 6).select("deposit_id", "a_res_ord", "b_res_ord", "distance")


def _dot(a: str, b: str) -> str:
    return f"({a}x * {b}x + {a}y * {b}y + {a}z * {b}z)"


def _cross(a: str, b: str, out: str) -> str:
    return f"{a}y * {b}z - {a}z * {b}y AS {out}x, {a}z * {b}x - {a}x * {b}z AS {out}y, {a}x * {b}y - {a}y * {b}x AS {out}z"


def _point(name: str, out: str) -> str:
    return ", ".join(f"max(CASE WHEN name = '{name}' THEN {c} END) AS {out}{c}" for c in "xyz")


_MINUS = lambda a, b, out: ", ".join(f"{a}{c} - {b}{c} AS {out}{c}" for c in "xyz")
_LAG = ", ".join(f"lag(c{c}) OVER w AS p{c}, lead(n{c}) OVER w AS f{c}" for c in "xyz")
_BACKBONES = f"""WITH a AS ({_ATOMS}), b AS (SELECT deposit_id, chain_id, res_seq, {_point(" N  ", "n")}, {_point(" CA ", "k")}, {_point(" C  ", "c")}, {_point(" O  ", "o")} FROM a WHERE res_name IN ('ALA', 'GLY', 'TRP', 'HIS') GROUP BY ALL),
l AS (SELECT *, {_LAG} FROM b WINDOW w AS (PARTITION BY deposit_id, chain_id ORDER BY res_seq))"""


def _dihedral(a: str, b: str, c: str, d: str) -> str:
    return f"""(SELECT degrees(atan2({_dot("e", "q")} / sqrt({_dot("q", "q")}), {_dot("m", "h")})) FROM (SELECT *, {_cross("m", "h", "e")} FROM (SELECT *, {_cross("p", "q", "m")}, {_cross("q", "r", "h")} FROM (SELECT {_MINUS("l." + b, "l." + a, "p")}, {_MINUS("l." + c, "l." + b, "q")}, {_MINUS("l." + d, "l." + c, "r")}))))"""


@query(f"""{_BACKBONES} SELECT deposit_id, chain_id, res_seq, round({_dihedral("p", "n", "k", "c")}, 5) AS phi, round({_dihedral("n", "k", "c", "f")}, 5) AS psi FROM l""")
def structure_phi_psi(spark, t):
    return structure.phi_psi(_atoms(t)).select("deposit_id", "chain_id", "res_seq", F.round("phi", 5).alias("phi"), F.round("psi", 5).alias("psi"))


@query(f"""{_BACKBONES} SELECT deposit_id, chain_id, res_seq, round(sqrt({_dot("d", "d")}), 6) AS distance FROM (SELECT deposit_id, chain_id, res_seq, fx - cx AS dx, fy - cy AS dy, fz - cz AS dz FROM l) WHERE {_dot("d", "d")} < 225""")
def structure_peptide_bonds(spark, t):
    atoms = _atoms(t)
    ends = structure.backbone(atoms).select("deposit_id", "res_ord", "res_seq", "c", "n")
    first, second = ends.select("deposit_id", "res_ord", "res_seq", "c"), ends.select("deposit_id", F.col("res_ord").alias("next_ord"), "n")
    bonds = structure.peptide_bonds(atoms, 15.0).join(first, ["deposit_id", "res_ord"]).join(second, ["deposit_id", "next_ord"])
    return bonds.select("deposit_id", "chain_id", "res_seq", F.round(G.distance(F.col("c"), F.col("n")), 6).alias("distance"))


@query(f"""{_BACKBONES}, v AS (SELECT res_seq, {_MINUS("n", "k", "u")}, {_MINUS("c", "k", "w")}, kx, ky, kz FROM l), s AS (SELECT *, {_cross("u", "w", "m")} FROM v)
SELECT res_seq, round({_dot("u", "w")}, 6) + 0.0 AS dot, round(sqrt({_dot("u", "u")}), 6) + 0.0 AS length, round({_dot("w", "w")}, 6) + 0.0 AS squared, round(degrees(acos({_dot("u", "w")} / sqrt({_dot("u", "u")} * {_dot("w", "w")}))), 4) + 0.0 AS angle,
 round(mx, 6) + 0.0 AS cross_x, round(my, 6) + 0.0 AS cross_y, round(mz, 6) + 0.0 AS cross_z, round(ux / sqrt({_dot("u", "u")}), 6) + 0.0 AS unit_x, round(ux + wx, 6) + 0.0 AS sum_x, round(-2.5 * wy, 6) + 0.0 AS scaled_y, round(-uz, 6) + 0.0 AS opposite_z, round(ux * wy, 6) + 0.0 AS outer_xy FROM s""")
def vector_algebra(spark, t):
    b = structure.backbone(_atoms(t)).withColumns({"u": G.sub(F.col("n"), F.col("ca")), "w": G.sub(F.col("c"), F.col("ca"))})
    u, w = F.col("u"), F.col("w")
    r = lambda c, out, places=6: (F.round(c, places) + 0.0).alias(out)
    cross = G.cross(u, w)
    return b.select(
        "res_seq", r(G.dot(u, w), "dot"), r(G.length(u), "length"), r(G.length_squared(w), "squared"), r(F.degrees(G.planar_angle3(F.col("n"), F.col("ca"), F.col("c"))), "angle", 4),
        r(cross["x"], "cross_x"), r(cross["y"], "cross_y"), r(cross["z"], "cross_z"), r(G.normalized(u)["x"], "unit_x"), r(G.add(u, w)["x"], "sum_x"), r(G.scale(w, -2.5)["y"], "scaled_y"), r(G.opposite(u)["z"], "opposite_z"), r(G.outer(u, w)[1], "outer_xy"),
    )


_M = "c_custkey % 5 + 1 AS a, c_custkey % 3 AS b, c_nationkey AS c, 2 AS d, c_custkey % 7 + 2 AS e, 1 AS f, c_nationkey % 4 AS g, 3 AS h, 9 AS i"


@query(f"""WITH m AS (SELECT c_custkey, {_M} FROM customer), d AS (SELECT *, (a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g))::DOUBLE AS det FROM m)
SELECT c_custkey, det, CASE WHEN det <> 0 THEN round((e * i - f * h) / det, 9) END AS inverse_11, CASE WHEN det <> 0 THEN round((c * h - b * i) / det, 9) END AS inverse_12, (a * 1 + b * 2 + c * 3)::DOUBLE AS times_x, (a * a + b * d + c * g)::DOUBLE AS square_11,
 (a + b * 0 + a)::DOUBLE AS twice_11, 0::DOUBLE AS none_12, d::DOUBLE AS transposed_12 FROM d""")
def matrix_algebra(spark, t):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    cells = [k % 5 + 1, k % 3, n, F.lit(2), k % 7 + 2, F.lit(1), n % 4, F.lit(3), F.lit(9)]
    df = t("customer").select("c_custkey", F.array(*(c.cast("double") for c in cells)).alias("m"))
    m = F.col("m")
    inverse = lambda i: F.when(G.det(m) != 0, F.round(G.inverse(m)[i], 9))
    return df.select(
        "c_custkey", G.det(m).alias("det"), inverse(0).alias("inverse_11"), inverse(1).alias("inverse_12"), G.mat_vec(m, G.vec(1.0, 2.0, 3.0))["x"].alias("times_x"), G.mat_mat(m, m)[0].alias("square_11"),
        G.mat_add(m, m)[0].alias("twice_11"), G.mat_sub(m, m)[1].alias("none_12"), G.transpose(m)[1].alias("transposed_12"),
    )


# --- sequence scalars ------------------------------------------------------------------------

_GAPPED = "SELECT p_partkey, p_name, rpad(replace(p_name, ' ', '-'), 24, '-') AS a, rpad(p_brand || upper(p_name), 24, '-') AS b FROM part"


@query(f"""WITH p AS ({_GAPPED}), c AS (SELECT p_partkey, sum((substr(a, k, 1) = substr(b, k, 1) AND substr(a, k, 1) NOT IN ('-', '_'))::INT) AS identical, sum((substr(a, k, 1) NOT IN ('-', '_') AND substr(b, k, 1) NOT IN ('-', '_'))::INT) AS aligned FROM p, range(1, 25) r(k) GROUP BY 1)
SELECT p.p_partkey, replace(p_name, ' ', '') AS stripped, replace(a, '-', '') AS ungapped, length(replace(a, '-', ''))::INT AS len, regexp_replace(b, '[^A-Z_-]', '', 'g') AS upper_only, substr(a, 4, 1) AS fourth, regexp_matches(a, '^[ACTGUXactgux]*$') AS nucleic,
 regexp_matches(b, '^[ARNDCEQGHILKMFPSTWYVX*]*$') AS protein, substr(p_name, 1, 8) || CASE WHEN length(p_name) > 8 THEN chr(10) || substr(p_name, 9, 8) ELSE '' END || CASE WHEN length(p_name) > 16 THEN chr(10) || substr(p_name, 17, 8) ELSE '' END AS wrapped,
 '> ' || p_name || chr(10) || a AS fasta, identical::INT AS identical, aligned::INT AS aligned, round(100.0 * identical / least(length(replace(a, '-', '')), length(replace(b, '-', ''))), 6)::DOUBLE AS percent FROM p JOIN c USING (p_partkey) WHERE length(p_name) <= 24""")
def sequence_scalars(spark, t):
    p = t("part").where(F.length("p_name") <= 24).select("p_partkey", "p_name", F.rpad(F.replace("p_name", F.lit(" "), F.lit("-")), 24, "-").alias("a"), F.rpad(F.concat("p_brand", F.upper("p_name")), 24, "-").alias("b"))
    return p.select(
        "p_partkey", S.strip_spaces("p_name").alias("stripped"), S.ungapped("a").alias("ungapped"), S.len_ungapped("a").alias("len"), S.a3m_to_fasta("b").alias("upper_only"), S.char_at(3, "a").alias("fourth"), S.is_nucleic("a").alias("nucleic"), S.is_protein("b").alias("protein"),
        S.wrap(8, "p_name").alias("wrapped"), S.fasta_text(0, "p_name", "a").alias("fasta"), S.count_identical("a", "b").alias("identical"), S.count_aligned("a", "b").alias("aligned"), F.round(S.percent_identity("a", "b"), 6).alias("percent"),
    )


@query("""SELECT page_id, regexp_replace(url, '[/\\\\:*?"<>|]', '_', 'g') AS file, nullif(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^[^.]*\\.(.+)$', 1), '') AS extension, ' ' || trim(regexp_replace(regexp_replace(url, '[!-/:-@\\[-`{-~]', ' ', 'g'), '\\s+', ' ', 'g')) || ' ' AS blanked FROM pages""")
def file_names(spark, t):
    return t("pages").select("page_id", S.sanitize_file_name("url").alias("file"), S.full_extension("url").alias("extension"), S.blank_punctuation("url").alias("blanked"))


@query("""SELECT p_partkey, contains(k, 'PEPTIDE') AS peptide, contains(k, 'PEPTIDE') AND NOT k LIKE 'D-%' AS l_peptide, contains(k, 'PEPTIDE') AND NOT k LIKE 'L-%' AS d_peptide, k IN ('RNA LINKING', 'L-DNA LINKING') AS nucleic
FROM (SELECT p_partkey, (['L-PEPTIDE LINKING', 'D-PEPTIDE LINKING', 'PEPTIDE LINKING', 'RNA LINKING', 'L-DNA LINKING', 'NON-POLYMER'])[p_partkey % 6 + 1] AS k FROM part)""")
def monomer_classes(spark, t):
    kinds = F.array(*map(F.lit, ("L-peptide linking", "D-peptide linking", "peptide linking", "RNA linking", "L-DNA linking", "non-polymer")))
    kind = F.get(kinds, (F.col("p_partkey") % 6).cast("int"))
    return t("part").select("p_partkey", C.is_peptide_linking(kind).alias("peptide"), C.is_l_peptide_linking(kind).alias("l_peptide"), C.is_d_peptide_linking(kind).alias("d_peptide"), C.is_nucleic_linking(kind).alias("nucleic"))


@query("""SELECT c_custkey, 'sp|P' || lpad(c_custkey::VARCHAR, 5, '0') || '|ref|NP_' || lpad(c_custkey::VARCHAR, 6, '0') || '.1|gi|' || c_custkey || '|taxid=' || (9000 + c_nationkey) || '|[organism=Genus ' || c_nationkey || ']' AS ids,
 'P' || lpad(c_custkey::VARCHAR, 5, '0') AS first, 'word' || c_custkey AS plain FROM customer WHERE c_custkey < 100000""")
def ids_of_descriptions(spark, t):
    text = F.format_string("gi|%d| ref|NP_%06d.1| sp|P%05d| taxid=%d [organism=Genus %d]", "c_custkey", "c_custkey", "c_custkey", F.col("c_nationkey") + 9000, "c_nationkey")
    found = t("customer").where("c_custkey < 100000").select("c_custkey", sorted_ids(sequence_ids(text)).alias("ids"), sequence_ids(F.concat(F.lit("word"), "c_custkey", F.lit(" of text"))).alias("none"))
    return found.select("c_custkey", full_id(F.col("ids")).alias("ids"), first_id(F.col("ids")).alias("first"), first_id(F.col("none")).alias("plain"))


# --- file formats: text made of rows, written, read by its reader -----------------------------


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/strandframe/{name}-{uuid.uuid4().hex}"


#: Rows of a written text file, which a reader holds as a whole.
FILE_ROWS = 20_000


def _written(df: DataFrame, name: str) -> str:
    """The folder of text files that hold the rows' `value`, FILE_ROWS each at most."""
    path = _path(df.sparkSession, name)
    df.select("value").write.option("maxRecordsPerFile", FILE_ROWS).text(path)
    return path


_LETTERS = "regexp_replace(upper(c_name || c_mktsegment), '[^A-Z]', '', 'g')"


def _letters() -> F.Column:
    return F.regexp_replace(F.upper(F.concat("c_name", "c_mktsegment")), "[^A-Z]", "")


@query(f"SELECT c_name AS description, repeat({_LETTERS}, 3) AS seq FROM customer")
def fasta_round_trip(spark, t):
    path = _path(spark, "fasta")
    writers.write_fasta(t("customer").select(F.col("c_name").alias("description"), F.repeat(_letters(), F.lit(3)).alias("seq")), path, 20)
    return files.read_fasta(spark, path).select("description", "seq")


@query(f"SELECT c_nationkey::VARCHAR || '_' || c_custkey AS description, rpad({_LETTERS}, 30, '-') AS seq, 'about ' || c_custkey AS note FROM customer")
def stockholm_round_trip(spark, t):
    name = F.concat_ws("_", "c_nationkey", "c_custkey")
    rows = t("customer").select("c_nationkey", F.col("c_custkey").alias("ord"), name.alias("description"), F.rpad(_letters(), 30, "-").alias("seq"))
    notes = rows.groupBy("c_nationkey").agg(F.array_join(F.collect_list(F.format_string("#=GS %s DE about %d", "description", "ord")), "\n").alias("notes"))
    text = writers.stockholm_text(rows, ["c_nationkey"]).join(notes, "c_nationkey").withColumn("value", F.concat(F.lit("# STOCKHOLM 1.0\n"), "notes", F.lit("\n"), F.substr("value", F.lit(17))))
    got = files.read_stockholm(spark, _written(text, "stockholm"))
    return got.select("description", "seq", F.col("gs")["DE"][0].alias("note"))


@query(f"SELECT 'c' || c_custkey AS description, rpad({_LETTERS}, 30, '-') AS seq FROM customer")
def clustalw_round_trip(spark, t):
    row = lambda a, n: F.concat(F.lit("c"), "c_custkey", F.lit("   "), F.substr(F.rpad(_letters(), 30, "-"), F.lit(a), F.lit(n)))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", row(1, 20).alias("a"), row(21, 10).alias("b")))), lambda x: x)
    text = t("customer").groupBy("c_nationkey").agg(rows.alias("r"))
    block = lambda k: F.array_join(F.transform("r", lambda x: x[k]), "\n")
    text = text.withColumn("value", F.concat(F.lit("CLUSTAL W\n\n"), block("a"), F.lit("\n       * **\n\n"), block("b"), F.lit("\n")))
    path = _path(spark, "clustalw")
    text.select("c_nationkey", "value").write.partitionBy("c_nationkey").text(path)
    return files.read_clustalw(spark, f"{path}/*").select("description", "seq")


@query(f"""SELECT 'C' || c_custkey || '_HUMAN' AS id, c_custkey % 2 = 0 AS is_reviewed, 'P' || lpad(c_custkey::VARCHAR, 5, '0') AS accession, 'Protein ' || c_mktsegment AS full_name, '1.2.3.' || c_nationkey AS ec, 9000 + c_nationkey AS taxid,
 'Species ' || c_nationkey || ' of ' || c_mktsegment AS species_name, {_LETTERS} AS sequence, (CASE WHEN c_custkey % 2 = 0 THEN 'sp' ELSE 'tr' END) || '.P' || lpad(c_custkey::VARCHAR, 5, '0') || '.C' || c_custkey || '_HUMAN Protein ' || c_mktsegment || ' OS=Species ' || c_nationkey || ' of ' || c_mktsegment || ' OX=' || (9000 + c_nationkey) AS description FROM customer""")
def uniprot_round_trip(spark, t):
    value = F.format_string(
        "ID   C%d_HUMAN   %s;   10 AA.\nAC   P%s; Q99999;\nDE   RecName: Full=Protein %s {ECO:0000};\nDE            EC=1.2.3.%d;\nDE   AltName: Full=Other;\nOS   Species %d\nOS   of %s\nOX   NCBI_TaxID=%d;\nSQ   SEQUENCE   10 AA;\n     %s\n//",
        "c_custkey", F.when(F.col("c_custkey") % 2 == 0, "Reviewed").otherwise("Unreviewed"), F.lpad(F.col("c_custkey").cast("string"), 5, "0"), "c_mktsegment", "c_nationkey", "c_nationkey", "c_mktsegment", F.col("c_nationkey") + 9000, _letters(),
    )
    got = files.read_uniprot(spark, _written(t("customer").select(value.alias("value")), "uniprot"))
    return files.record_header(got).select("id", "is_reviewed", "accession", "full_name", "ec", "taxid", "species_name", "sequence", "description")


@query(f"SELECT 'L' || c_custkey AS id, 'A' || lpad(c_custkey::VARCHAR, 6, '0') AS accession, 'segment ' || c_mktsegment AS full_name, 9000 + c_nationkey AS taxid, 'Species ' || c_nationkey AS species_name, {_LETTERS} AS sequence FROM customer")
def genbank_round_trip(spark, t):
    value = F.format_string(
        "LOCUS       L%d 10 aa\nDEFINITION  segment %s\nACCESSION   A%06d\nSOURCE      Species %d\nFEATURES\n                     /db_xref=\"taxon:%d\"\nORIGIN\n        1 %s\n//",
        "c_custkey", "c_mktsegment", "c_custkey", "c_nationkey", F.col("c_nationkey") + 9000, F.lower(_letters()),
    )
    return files.read_genbank(spark, _written(t("customer").select(value.alias("value")), "genbank")).select("id", "accession", "full_name", "taxid", "species_name", "sequence")


@query(f"""SELECT serial, name, res_name, chain_id, res_seq, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y, round(z, 3) + 0.0 AS z, element, is_hetero FROM ({_ATOMS}) WHERE res_seq <= 9999 AND serial <= 99999""")
def pdb_atoms_round_trip(spark, t):
    path = _path(spark, "pdb")
    writers.write_pdb(_atoms(t).where("res_seq <= 9999 and serial <= 99999"), path)
    got = files.read_pdb_atoms(spark, f"{path}/*")
    return got.select("serial", "name", "res_name", "chain_id", "res_seq", *((F.col(c) + 0.0).alias(c) for c in "xyz"), "element", "is_hetero")


@query("""SELECT '1' || lpad(c_custkey::VARCHAR, 3, '0') AS id_code, 'CLASS ' || c_mktsegment AS classification, '01-JAN-20' AS date, 'A TITLE OF ' || c_mktsegment || ' AND ' || c_nationkey AS title, 'X-RAY DIFFRACTION' AS method, 1.5 + c_nationkey AS resolution, 'P 21 21 21' AS space_group, 10.0 + c_nationkey AS cell_a,
 'A' AS helix_chain, 1::INT AS helix_first, (c_nationkey + 9)::INT AS helix_last, 'ALA GLY' AS seqres FROM customer WHERE c_custkey < 1000""")
def pdb_deposits_round_trip(spark, t):
    value = F.format_string(
        "HEADER    %-40s01-JAN-20   1%03d\nTITLE     A TITLE OF %s\nTITLE    2 AND %d\nEXPDTA    X-RAY DIFFRACTION\nREMARK   2 RESOLUTION. %7.2f ANGSTROMS.\nCRYST1%9.3f   20.000   30.000  90.00  90.00  90.00 P 21 21 21    4\nHELIX    1   1 ALA A    1  GLY A %4d  1\nSEQRES   1 A    2  ALA GLY",
        F.concat(F.lit("CLASS "), "c_mktsegment"), "c_custkey", "c_mktsegment", "c_nationkey", F.col("c_nationkey") + 1.5, F.col("c_nationkey") + 10.0, F.col("c_nationkey") + 9,
    )
    path = _path(spark, "deposits")
    t("customer").where("c_custkey < 1000").select("c_custkey", value.alias("value")).repartition(4).write.partitionBy("c_custkey").text(path)
    d = files.read_pdb_deposits(spark, f"{path}/*")
    return d.select(
        "id_code", "classification", "date", "title", F.col("methods")[0].alias("method"), "resolution", "space_group", F.col("cell")[0].alias("cell_a"), F.col("helices")[0]["chain_id"].alias("helix_chain"),
        F.col("helices")[0]["first"].alias("helix_first"), F.col("helices")[0]["last"].alias("helix_last"), F.array_join(F.col("seqres")["A"], " ").alias("seqres"),
    )


_BLOCKS = "FROM nation n JOIN (SELECT s_nationkey, count(*) AS n, list(s_suppkey ORDER BY s_suppkey) AS keys FROM supplier GROUP BY 1) s ON n_nationkey = s_nationkey"


def _cif(spark, t) -> DataFrame:
    """Values of one block a nation: items of the nation, a loop of its suppliers, an entity with a reference and its observed residues."""
    row = F.format_string("%d '%s' ?", "s_suppkey", "s_name")
    own = t("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("r")))), lambda x: x["r"]).alias("rows"))
    head = F.format_string("data_n%d\n_nation.name '%s'\n_nation.region %d\n", "n_nationkey", "n_name", "n_regionkey")
    tail = F.format_string(
        "loop_\n_entity.id\n_entity.type\n_entity.pdbx_description\n_entity.formula_weight\n_entity.src_method\n1 polymer 'a chain' %d.5 man\n2 non-polymer . 65.4 syn\n_struct_ref.id 1\n_struct_ref.db_name UNP\n_struct_ref.db_code P%05d\n_entity_poly.entity_id 1\n_entity_poly.type polypeptide(L)\n_entity_poly.pdbx_strand_id A,B\n"
        "loop_\n_entity_poly_seq.entity_id\n_entity_poly_seq.num\n_entity_poly_seq.mon_id\n1 1 ALA\n1 2 GLY\nloop_\n_pdbx_poly_seq_scheme.entity_id\n_pdbx_poly_seq_scheme.asym_id\n_pdbx_poly_seq_scheme.seq_id\n_pdbx_poly_seq_scheme.auth_mon_id\n_pdbx_poly_seq_scheme.pdb_strand_id\n1 A 1 ALA A\n1 A 2 ? A\n",
        "n_nationkey", "n_nationkey",
    )
    body = F.concat(F.lit("loop_\n_supplier.key\n_supplier.name\n_supplier.note\n"), F.array_join("rows", "\n"), F.lit("\n"))
    text = t("nation").join(own, "n_nationkey").select(F.concat(head, body, tail).alias("value"))
    return files.read_cif(spark, _written(text, "cif"))


@query(f"SELECT 'n' || n_nationkey AS block, n_name AS name, n_regionkey::INT AS region, 4::BIGINT AS loops, 8::BIGINT AS items {_BLOCKS}")
def cif_items_and_counts(spark, t):
    values = _cif(spark, t)
    items, counts = files.cif_items(values), files.cif_counts(values)
    named = items.select("block", F.col("items")["_nation.name"].alias("name"), F.col("items")["_nation.region"].cast("int").alias("region"))
    return named.join(counts.select("block", "loops", "items"), "block")


@query("SELECT 'n' || s_nationkey AS block, s_suppkey::BIGINT AS key, s_name AS name, NULL::VARCHAR AS note FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation)")
def cif_loop_table(spark, t):
    return files.cif_table(_cif(spark, t), "_supplier", ["key", "name", "note"]).select("block", F.col("key").cast("long").alias("key"), "name", "note")


@query(f"""SELECT 'P' || lpad(n_nationkey::VARCHAR, 5, '0') AS db_code, e.id AS entity_id, CASE WHEN e.id = '1' THEN 'UNP' END AS db_name, CASE WHEN e.id = '1' THEN 'polymer' ELSE 'non-polymer' END AS type, CASE WHEN e.id = '1' THEN 'a chain' END AS description, CASE WHEN e.id = '1' THEN n_nationkey + 0.5 ELSE 65.4 END::DOUBLE AS weight,
 CASE WHEN e.id = '1' THEN 'polypeptide(L)' END AS polymer_type, CASE WHEN e.id = '1' THEN 'A B' END AS chains, CASE WHEN e.id = '1' THEN 'ALA GLY' END AS monomers, CASE WHEN e.id = '1' THEN 'ALA GAP' END AS observed {_BLOCKS}, (VALUES ('1'), ('2')) e(id)""")
def cif_entities_and_references(spark, t):
    values = _cif(spark, t)
    values = values.withColumn("path", F.concat_ws("#", "path", "block"))  # one deposit a block
    code = values.where("name = '_struct_ref.db_code'").select("path", F.col("value").alias("code"))
    e = files.cif_entities(values).join(files.entity_references(values), ["path", "entity_id"]).join(code, "path")
    seen = files.chain_monomers(values).select("path", "entity_id", F.array_join("monomers", " ").alias("observed"))
    join = lambda c: F.when(F.col(c).isNotNull(), F.array_join(c, " ")).alias(c)
    return e.join(seen, ["path", "entity_id"], "left").select(F.col("code").alias("db_code"), "entity_id", "db_name", "type", "description", "weight", "polymer_type", join("chains"), join("monomers"), "observed")


@query("""SELECT 'n' || s_nationkey AS block, 'loop_' || chr(10) || '_supplier.key' || chr(10) || '_supplier.name' || chr(10) || '_supplier.note' || chr(10) || string_agg(s_suppkey || ' ' || s_name || ' ?', chr(10) ORDER BY s_suppkey) AS value FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation) GROUP BY 1""")
def cif_loop_writer(spark, t):
    return writers.cif_loop_text(_cif(spark, t)).where("loop_idx = 0").select("block", "value")


@query("""SELECT 'n' || n_nationkey AS code, lower(n_name) AS name, n_regionkey + 1 AS parent FROM nation""")
def taxdump_round_trip(spark, t):
    own, rooted = F.col("n_nationkey") + 100, F.col("n_regionkey") + 1
    nodes = t("nation").select(F.format_string("%d\t|\t%d\t|\tspecies\t|", own, rooted).alias("value"))
    names = t("nation").select(F.explode(F.array(F.format_string("%d\t|\t%s\t|\t\t|\tscientific name\t|", own, F.lower("n_name")), F.format_string("%d\t|\tn%d\t|\t\t|\tsynonym\t|", own, "n_nationkey"), F.format_string("%d\t|\tx\t|\t\t|\tauthority\t|", own))).alias("value"))
    path = _path(spark, "taxdump")
    nodes.write.text(f"{path}/nodes.dmp")
    names.write.text(f"{path}/names.dmp")
    tree, called = files.read_taxdump(spark, path)
    ids = taxonomy.taxids_of(called, t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("name"))).withColumnRenamed("name", "code")
    every = taxonomy.names_of(called, ids.select("tax_id"))
    return ids.join(tree, F.col("tax_id") == F.col("id")).join(every, "tax_id").where(F.array_contains("names", F.col("code"))).select("code", "name", "parent")


@query("SELECT s_suppkey::INT AS key, s_name AS name, round(s_acctbal, 2) AS balance FROM supplier")
def delimited_round_trip(spark, t):
    text = t("supplier").select(F.concat_ws(",", "s_suppkey", "s_name", F.round("s_acctbal", 2).cast("string")).alias("value"))
    noise = spark.createDataFrame([("# a comment",), ("too,few",)], "value string")
    return files.read_delimited(spark, _written(text.unionByName(noise), "csv"), "key int, name string, balance double")


@query("SELECT s_suppkey::VARCHAR AS i, s_nationkey::VARCHAR AS j, s_suppkey / 4.0 AS d, s_suppkey / 4.0 + s_nationkey AS total FROM supplier")
def distances_round_trip(spark, t):
    path = _written(t("supplier").select(F.concat_ws("\t ", "s_suppkey", "s_nationkey", F.col("s_suppkey") / 4.0).alias("value")), "distances")
    words = files.read_whitespace(spark, path).select(F.col("values")[0].cast("long").cast("string").alias("i"), (F.col("values")[1] + F.col("values")[2]).alias("total"))
    return files.read_distances(spark, path).join(words, "i").select("i", "j", "d", "total")
