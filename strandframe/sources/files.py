"""DataFrames from scientific files: each file or entry is parsed in one task, files side by side."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions import chemistry as C
from strandframe.functions.entities import locator, parse_bool
from strandframe.sources import parsers as P

#: Columns of an atoms table.
ATOMS = (
    "deposit_id string, model int, atom_ord int, serial int, name string, alt_loc string, res_name string, chain_id string, entity_id string, res_seq int, i_code string, "
    "x double, y double, z double, occupancy double, temp_factor double, element string, charge string, is_hetero boolean"
)


def _files(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    """path, content of whole files, read by Spark: any file system, decompressed below if gzipped."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(path).select("path", "content")


def _parsed(files: DataFrame, schema: str, parse: Callable[[str, list[str]], Iterator[tuple]]) -> DataFrame:
    """Rows (path, ...) of parse(path, lines) for each file."""
    names = [c.strip().split()[0].strip("`") for c in _fields(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip

        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                text = gzip.decompress(data) if bytes(data[:2]) == b"\x1f\x8b" else bytes(data)
                rows: list[tuple] = []
                for row in parse(path, text.decode("utf-8", "replace").splitlines()):
                    rows.append((path, *row))
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=["path", *names])
                        rows = []
                yield pd.DataFrame(rows, columns=["path", *names])

    return files.mapInPandas(run, f"path string, {schema}")


def _fields(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(schema[start:i])
            start = i + 1
    return [*out, schema[start:]]


def read_fasta(spark: SparkSession, path: str | list[str], cleaning: str = "raw") -> DataFrame:
    """path, ord, description, seq. cleaning: raw, protein, protein_stop or nucleic."""

    def parse(_: str, lines: list[str]) -> Iterator[tuple]:
        for i, (d, s) in enumerate(P.fasta(lines, cleaning)):
            yield i, d, s

    return _parsed(_files(spark, path), "ord long, description string, seq string", parse)


def read_fasta_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """ord, description, seq of plain, large FASTA files: split by record, so one file feeds many tasks."""
    rows = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    head = F.trim(F.regexp_extract("value", r"(?s)^([^\n]*)", 1))
    seq = F.regexp_replace(F.regexp_extract("value", r"(?s)^[^\n]*\n(.*)$", 1), r"\s", "")
    return rows.select(F.monotonically_increasing_id().alias("ord"), head.alias("description"), seq.alias("seq")).where("seq <> ''")


def read_stockholm(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, msa_id, ord, description, seq, gs, gr (of the row), gf, gc (of the alignment, on each row)."""

    def parse(_: str, lines: list[str]) -> Iterator[tuple]:
        for k, m in P.stockholm(lines):
            for i, (d, s) in enumerate(m["rows"].items()):
                yield k, i, d, s, m["gs"].get(d, {}), m["gr"].get(d, {}), m["gf"], m["gc"]

    kinds = "msa_id long, ord long, description string, seq string, gs map<string,array<string>>, gr map<string,string>, gf map<string,array<string>>, gc map<string,string>"
    return _parsed(_files(spark, path), kinds, parse)


def read_clustalw(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, ord, description, seq."""

    def parse(_: str, lines: list[str]) -> Iterator[tuple]:
        for i, (d, s) in enumerate(P.clustalw(lines)):
            yield i, d, s

    return _parsed(_files(spark, path), "ord long, description string, seq string", parse)


_RECORD = ("id", "is_reviewed", "accession", "full_name", "ec", "taxid", "species_name", "sequence")
_RECORD_KINDS = "ord long, id string, is_reviewed boolean, accession string, full_name string, ec string, taxid long, species_name string, sequence string"


def _records(spark: SparkSession, path, glob: str | None, parser) -> DataFrame:
    def parse(_: str, lines: list[str]) -> Iterator[tuple]:
        for i, e in enumerate(parser(lines)):
            yield (i, *(e[k] for k in _RECORD))

    return _parsed(_files(spark, path, glob), _RECORD_KINDS, parse)


def read_uniprot(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """Entries of UniProt flat files."""
    return _records(spark, path, glob, P.uniprot)


def read_genbank(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """Entries of GenBank and GenPept files."""
    return _records(spark, path, glob, P.genbank)


def record_header(df: DataFrame) -> DataFrame:
    """`df` with `description`: sp or tr, accession and id parted by dots, name, OS= and OX=."""
    base = F.concat_ws(".", F.when(F.col("is_reviewed"), "sp").otherwise("tr"), "accession", "id")
    return df.withColumn("description", F.concat_ws(" ", base, "full_name", F.concat(F.lit("OS="), "species_name"), F.concat(F.lit("OX="), F.col("taxid").cast("string"))))


def read_cif(spark: SparkSession, path: str | list[str], glob: str | None = None, only: Callable[[list[str]], bool] | None = None) -> DataFrame:
    """path, block_idx, block, kind, loop_idx, row_idx, name, value: every value of every file, or of those whose lines pass `only`."""

    def parse(_: str, lines: list[str]) -> Iterator[tuple]:
        if only is None or only(lines):
            yield from P.cif(lines)

    return _parsed(_files(spark, path, glob), "block_idx long, block string, kind string, loop_idx long, row_idx long, name string, value string", parse)


def cif_table(values: DataFrame, category: str, columns: list[str]) -> DataFrame:
    """path, block, row_idx and the named columns of a category, whether it is a loop or items; missing marks are null."""
    full = {f"{category}.{c}": c for c in columns}
    own = values.where(F.col("name").isin(*full))
    wide = own.groupBy("path", "block_idx", "block", "row_idx").pivot("name", list(full)).agg(F.first("value"))
    clean = lambda n: F.when(~F.col(f"`{n}`").isin("?", "."), F.col(f"`{n}`"))
    return wide.select("path", "block", "row_idx", *(clean(n).alias(c) for n, c in full.items()))


def cif_items(values: DataFrame) -> DataFrame:
    """path, block, items: single items as a map."""
    return values.where("kind = 'item'").groupBy("path", "block").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("items"))


def cif_counts(values: DataFrame) -> DataFrame:
    """path, block, loops, items."""
    return values.groupBy("path", "block").agg(F.count_distinct(F.when(F.col("kind") == "loop", F.col("loop_idx"))).alias("loops"), F.count_if(F.col("kind") == "item").alias("items"))


def deposit_id(path) -> object:
    """The file's name up to its first dot."""
    return F.regexp_extract(path, r"([^/.]*)[^/]*$", 1)


def cif_atoms(values: DataFrame) -> DataFrame:
    """An atoms table from _atom_site; author's numbering and chains come first, label's where missing."""
    names = ["group_PDB", "id", "label_atom_id", "auth_atom_id", "label_alt_id", "label_comp_id", "auth_asym_id", "label_asym_id", "label_entity_id", "auth_seq_id", "label_seq_id", "pdbx_PDB_ins_code", "Cartn_x", "Cartn_y", "Cartn_z", "occupancy", "B_iso_or_equiv", "type_symbol", "pdbx_formal_charge", "pdbx_PDB_model_num"]
    t = cif_table(values, "_atom_site", names)
    from strandframe.functions.atoms import padded_name

    model = F.coalesce(F.col("pdbx_PDB_model_num").cast("int"), F.lit(1))
    from pyspark.sql.window import Window

    place = (F.row_number().over(Window.partitionBy("path", model).orderBy("row_idx")) - 1).alias("atom_ord")
    d = lambda c, v: F.coalesce(F.col(c).cast("double"), F.lit(v))
    return t.select(
        deposit_id("path").alias("deposit_id"), model.alias("model"), place, F.col("id").cast("int").alias("serial"), padded_name(F.coalesce("auth_atom_id", "label_atom_id"), F.col("type_symbol")).alias("name"),
        F.coalesce("label_alt_id", F.lit(" ")).alias("alt_loc"), F.col("label_comp_id").alias("res_name"), F.coalesce("auth_asym_id", "label_asym_id").alias("chain_id"), F.col("label_entity_id").alias("entity_id"),
        F.coalesce("auth_seq_id", "label_seq_id").cast("int").alias("res_seq"), F.coalesce("pdbx_PDB_ins_code", F.lit(" ")).alias("i_code"), d("Cartn_x", 0.0).alias("x"), d("Cartn_y", 0.0).alias("y"), d("Cartn_z", 0.0).alias("z"),
        d("occupancy", 1.0).alias("occupancy"), d("B_iso_or_equiv", 0.0).alias("temp_factor"), F.col("type_symbol").alias("element"), F.col("pdbx_formal_charge").alias("charge"), (F.col("group_PDB") == "HETATM").alias("is_hetero"),
    )


def cif_entities(values: DataFrame) -> DataFrame:
    """path, entity_id, type, description, weight, polymer_type, chains, monomers of each entity."""
    e = cif_table(values, "_entity", ["id", "type", "pdbx_description", "formula_weight", "src_method"])
    poly = cif_table(values, "_entity_poly", ["entity_id", "type", "pdbx_strand_id"]).select("path", "entity_id", F.col("type").alias("polymer_type"), F.split("pdbx_strand_id", r"\s*,\s*").alias("chains"))
    seq = cif_table(values, "_entity_poly_seq", ["entity_id", "num", "mon_id"]).groupBy("path", "entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("num").cast("int").alias("n"), "mon_id"))), lambda x: x["mon_id"]).alias("monomers"))
    e = e.select("path", F.col("id").alias("entity_id"), "type", F.col("pdbx_description").alias("description"), F.col("formula_weight").cast("double").alias("weight"), F.col("src_method").alias("source"))
    return e.join(poly, ["path", "entity_id"], "left").join(seq, ["path", "entity_id"], "left")


def entity_references(values: DataFrame) -> DataFrame:
    """path, entity_id, db_name, db_code of each entity; null where the deposit names no reference."""
    e = cif_table(values, "_entity", ["id"]).select("path", F.col("id").alias("entity_id"))
    ref = cif_table(values, "_struct_ref", ["id", "db_name", "db_code"]).select("path", F.col("id").alias("entity_id"), "db_name", "db_code")
    return e.join(ref, ["path", "entity_id"], "left")


def chain_monomers(values: DataFrame) -> DataFrame:
    """path, entity_id, chain_id, monomers: an entity's residues as they were observed in each chain; GAP where not."""
    t = cif_table(values, "_pdbx_poly_seq_scheme", ["entity_id", "asym_id", "seq_id", "auth_mon_id", "pdb_strand_id"])
    one = F.struct(F.col("seq_id").cast("int").alias("at"), F.coalesce("auth_mon_id", F.lit("GAP")).alias("code"))
    got = t.groupBy("path", "entity_id", F.coalesce("pdb_strand_id", "asym_id").alias("chain_id"))
    return got.agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["code"]).alias("monomers"))


def cif_ranges(values: DataFrame) -> DataFrame:
    """path, ord, kind, chain and first and last residue of helices, then strands."""
    h = cif_table(values, "_struct_conf", ["conf_type_id", "beg_auth_asym_id", "beg_auth_seq_id", "end_auth_seq_id"]).where("conf_type_id like 'HELX%'")
    s = cif_table(values, "_struct_sheet_range", ["beg_auth_asym_id", "beg_auth_seq_id", "end_auth_seq_id"])
    pick = lambda df, kind, base: df.select("path", (F.col("row_idx") + base).alias("ord"), F.lit(kind).alias("kind"), F.col("beg_auth_asym_id").alias("chain_id"), F.col("beg_auth_seq_id").cast("int").alias("first"), F.col("end_auth_seq_id").cast("int").alias("last"))
    return pick(h, "RightAlphaHelix", 0).unionByName(pick(s, "Strand", 1_000_000))


def read_pdb_atoms(spark: SparkSession, path: str | list[str], glob: str | None = None, only: Callable[[list[str]], bool] | None = None) -> DataFrame:
    """An atoms table from PDB files, or from those whose lines pass `only`."""
    names = [f.split()[0] for f in _fields(ATOMS)][1:]

    def parse(_: str, lines: list[str]) -> Iterator[tuple]:
        for a in P.pdb_atoms(lines) if only is None or only(lines) else ():
            yield tuple(a[n] for n in names)

    kinds = ", ".join(x.strip() for x in _fields(ATOMS)[1:])
    return _parsed(_files(spark, path, glob), kinds, parse).withColumn("deposit_id", deposit_id("path")).select("deposit_id", *names)


def read_pdb_deposits(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """path, id_code, classification, date, title, methods, resolution, space_group, cell, remarks, helices, strands, seqres."""

    def parse(_: str, lines: list[str]) -> Iterator[tuple]:
        r = P.pdb_records(lines)
        cell = r["cell"]
        rng = lambda rows: [{"chain_id": a, "first": b, "last": e, "kind": c} for a, b, _i, _c, e, _j, c in rows]
        yield r["id_code"], r["classification"], r["date"], r["title"], r["methods"], r["resolution"], cell[6] if cell else None, list(cell[:6]) if cell else None, r["remarks"], rng(r["helices"]), rng(r["strands"]), r["seqres"]

    span = "array<struct<chain_id:string,first:int,last:int,kind:int>>"
    kinds = f"id_code string, classification string, date string, title string, methods array<string>, resolution double, space_group string, cell array<double>, remarks map<string,array<string>>, helices {span}, strands {span}, seqres map<string,array<string>>"
    return _parsed(_files(spark, path, glob), kinds, parse)


def sniff(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, format: cif, pdb or null, from each file's first line."""

    def parse(_: str, lines: list[str]) -> Iterator[tuple]:
        yield ("cif" if P.looks_like_cif(lines) else "pdb" if P.looks_like_pdb(lines) else None,)

    return _parsed(_files(spark, path), "format string", parse)


def component_atoms(values: DataFrame) -> DataFrame:
    """An atoms table from _chem_comp_atom: chain and entity A, a residue for each block of a file, model coordinates."""
    from strandframe.functions.atoms import padded_name

    t = cif_table(values, "_chem_comp_atom", ["pdbx_ordinal", "atom_id", "pdbx_component_comp_id", "model_Cartn_x", "model_Cartn_y", "model_Cartn_z", "charge", "type_symbol"])
    place = values.select("path", "block", (F.col("block_idx") + 1).cast("int").alias("res_seq")).distinct()
    return t.join(place, ["path", "block"]).select(
        deposit_id("path").alias("deposit_id"), F.lit(1).alias("model"), "res_seq", F.lit("A").alias("chain_id"), F.lit("A").alias("entity_id"), F.lit(" ").alias("i_code"), F.col("pdbx_ordinal").cast("int").alias("serial"),
        padded_name(F.col("atom_id"), F.col("type_symbol")).alias("name"), F.col("pdbx_component_comp_id").alias("res_name"), *(F.col(f"model_Cartn_{c}").cast("double").alias(c) for c in "xyz"),
        F.when(F.col("charge") != "0", F.col("charge")).alias("charge"), F.col("type_symbol").alias("element"),
    )


def component_reference(values: DataFrame) -> DataFrame:
    """code3, ord, atom_name, leaving, element: the reference atoms of each component, as `complete_residues` takes them."""
    t = cif_table(values, "_chem_comp_atom", ["pdbx_ordinal", "atom_id", "pdbx_leaving_atom_flag", "type_symbol"])
    return t.select(F.col("block").alias("code3"), F.col("pdbx_ordinal").cast("int").alias("ord"), F.col("atom_id").alias("atom_name"), parse_bool("pdbx_leaving_atom_flag").alias("leaving"), F.col("type_symbol").alias("element"))


def component_types(values: DataFrame) -> DataFrame:
    """code3, code1, kind, type: components as `residue_types` takes them (drop `type` first), one row a code; the letter is X."""
    t = cif_table(values, "_chem_comp", ["id", "type"]).where(F.col("id").isNotNull()).groupBy(F.col("id").alias("code3")).agg(F.min("type").alias("type"))
    kind = F.when(C.is_peptide_linking(F.col("type")), C.PEPTIDE).when(C.is_nucleic_linking(F.col("type")), C.NUCLEIC).otherwise(C.OTHER)
    return t.select("code3", F.lit("X").alias("code1"), kind.alias("kind"), "type")


def definitions(values: DataFrame) -> DataFrame:
    """Atom definitions of `operators.polymers` by block, from tables of internal coordinates; angles become radians."""
    names = ["_res_name", *(f"_atom_{p}_{x}" for p in "abcd" for x in ("residue_locator", "name")), "_atom_d_element", "_c_d_bond_length", "_b_c_d_planar_angle", "_a_b_c_d_dihedral_angle", "_dihedral_angle_name"]
    wide = values.where(F.col("name").isin(*names)).groupBy("path", "block_idx", "block", "row_idx").pivot("name", names).agg(F.first("value"))
    place = lambda p: (locator(f"_atom_{p}_residue_locator").alias(f"{p}_loc"), F.col(f"_atom_{p}_name").alias("name" if p == "d" else p))
    angle = lambda n: F.radians(F.col(n).cast("double"))
    return wide.select(
        "block", F.col("row_idx").alias("def_ord"), F.col("_res_name").alias("res_name"), *(c for p in "abcd" for c in place(p)), F.col("_atom_d_element").alias("element"), F.col("_c_d_bond_length").cast("double").alias("r"),
        angle("_b_c_d_planar_angle").alias("planar"), angle("_a_b_c_d_dihedral_angle").alias("dihedral"), F.col("_dihedral_angle_name").alias("dihedral_name"),
    )


def read_definitions(spark: SparkSession, folder: str) -> DataFrame:
    """The definitions of all .cif and .CIF files of a folder."""
    return definitions(read_cif(spark, folder, glob="*.{cif,CIF}"))


#: What may stand before and after a deposit's code in the names of CIF and of PDB files, in the order tried.
CIF_NAMES = (("", "pdb"), (".cif", ".cif.gz", ".gz", ".CIF", ".CIF.gz", ""))
PDB_NAMES = (("pdb", "PDB", ""), (".ent", ".ent.gz", ".gz", ".pdb", ".PDB", ".pdb.gz", ""))


def find_deposit(spark: SparkSession, code: str, folder: str, kind: str = "cif") -> str:
    """The path of a deposit's file: `code` itself if it is one, in the folder, or under a usual name there or in the folder of its middle letters."""
    prefixes, suffixes = CIF_NAMES if kind == "cif" else PDB_NAMES
    base, low = folder.rstrip("/"), code.lower()
    usual = (f"{base}/{sub}{p}{c}{s}" for p in prefixes for s in suffixes for sub in ("", f"{low[1:3]}/") for c in (low, code.upper()))
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for name in (code, f"{base}/{code}", *usual):
        path = jvm.org.apache.hadoop.fs.Path(name)
        fs = path.getFileSystem(conf)
        if fs.exists(path) and fs.getFileStatus(path).isFile():
            return name
    raise FileNotFoundError(f"no {kind} file of {code} in {folder}")


def read_structure(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The atoms of CIF and PDB files alike, as each file's first line tells; other files are left out."""
    atoms = read_pdb_atoms(spark, path, only=P.looks_like_pdb)
    return atoms.unionByName(cif_atoms(read_cif(spark, path, only=P.looks_like_cif)))


def _tar_lines(spark: SparkSession, path: str, member: str) -> DataFrame:
    """`value`: the lines of a member of a tar archive, compressed or not; one task streams it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import tarfile
        from itertools import islice

        for batch in batches:
            for data in batch["content"]:
                with tarfile.open(fileobj=io.BytesIO(bytes(data))) as tar:
                    for m in tar:
                        if m.name.rsplit("/", 1)[-1] == member:
                            lines = io.TextIOWrapper(tar.extractfile(m), "utf-8", "replace", newline="\n")
                            while part := [x.rstrip("\n") for x in islice(lines, 10_000)]:
                                yield pd.DataFrame({"value": part})

    return _files(spark, path).mapInPandas(run, "value string")


def read_taxdump(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, parent, rank, name; names: name, tax_id, name_class) from nodes.dmp and names.dmp in a folder or a tar archive."""
    packed = folder.endswith((".tar", ".tar.gz", ".tgz"))
    fields = lambda f: (_tar_lines(spark, folder, f) if packed else spark.read.text(f"{folder}/{f}")).select(F.split(F.regexp_replace("value", r"\t\|\s*$", ""), r"\t\|\t").alias("f"))
    get = lambda i: F.get("f", F.lit(i))
    nodes = fields("nodes.dmp").select(get(0).cast("long").alias("id"), get(1).cast("long").alias("parent"), get(2).alias("rank"))
    names = fields("names.dmp").select(get(1).alias("name"), get(0).cast("long").alias("tax_id"), get(3).alias("name_class"))
    proper = names.where("name_class = 'scientific name'").select(F.col("tax_id").alias("id"), "name")
    wanted = names.where(F.col("name_class").isin("scientific name", "synonym", "common name", "genbank common name"))
    return nodes.join(proper, "id", "left"), wanted


def read_delimited(spark: SparkSession, path: str | list[str], schema: str, delimiter: str = ",") -> DataFrame:
    """Rows of one delimiter; # starts a comment, rows that do not fit the schema are left out."""
    return spark.read.csv(path, sep=delimiter, comment="#", schema=schema, mode="DROPMALFORMED", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).dropna(how="any")


def read_whitespace(spark: SparkSession, path: str | list[str], kind: str = "double") -> DataFrame:
    """`values`: an array of each line's words between blanks and tabs; # starts a comment."""
    rows = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    return rows.select(F.transform(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+"), lambda x: x.cast(kind)).alias("values"))


def read_distances(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """i, j, d from lines of two labels and a distance."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("f"))
    return rows.select(F.get("f", F.lit(0)).alias("i"), F.get("f", F.lit(1)).alias("j"), F.get("f", F.lit(2)).cast("double").alias("d"))


def count_rows(spark: SparkSession, path: str | list[str]) -> int:
    return spark.read.text(path).count()


def list_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path of files, in sub-folders too, whose name matches a regular expression; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return files.where(F.regexp_extract("path", r"([^/]*)$", 1).rlike(pattern))
