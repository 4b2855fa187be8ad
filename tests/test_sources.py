import pytest

from strandframe.functions.chemistry import residue_types
from strandframe.operators import structure, taxonomy
from strandframe.sources import files, parsers

ATOM = "ATOM   2831  OE1BGLN A 294C    -27.117  12.343  28.479  1.00  9.58           O  "


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one two\n ACD \n\nEF\n>empty\n>two\nGH(1)IK&L*\n>")
    got = files.read_fasta(spark, str(tmp_path / "a.fasta"), "protein").orderBy("ord").collect()
    assert [(r.ord, r.description, r.seq) for r in got] == [(0, "one two", "ACDEF"), (1, "two", "GHIKL")]
    assert files.read_fasta_text(spark, str(tmp_path / "a.fasta")).count() == 2
    with pytest.raises(ValueError):
        list(parsers.fasta(["# no"]))


def test_alignments(spark, tmp_path):
    (tmp_path / "a.sto").write_text("# STOCKHOLM 1.0\n#=GF ID fam\n#=GS s1 AC X1\ns1 AC-\ns2 ACD\n#=GC SS HHH\n\ns1 EF\ns2 EF\n//\n")
    got = files.read_stockholm(spark, str(tmp_path / "a.sto")).orderBy("ord").collect()
    assert [(r.description, r.seq) for r in got] == [("s1", "AC-EF"), ("s2", "ACDEF")] and got[0].gf["ID"] == ["fam"] and got[0].gc == {"SS": "HHH"}
    (tmp_path / "a.aln").write_text("CLUSTAL W\n\na  ACD\nb  A-D\n   * *\n\na  EF\nb  EG\n")
    assert [(r.description, r.seq) for r in files.read_clustalw(spark, str(tmp_path / "a.aln")).orderBy("ord").collect()] == [("a", "ACDEF"), ("b", "A-DEG")]


def test_flat_files(spark, tmp_path):
    (tmp_path / "a.spt").write_text("ID   R4K4X3_CLOPA            Unreviewed;        5 AA.\nAC   R4K4X3;\nDE   SubName: Full=Ferredoxin {ECO:1};\nOS   Clostridium pasteurianum\nOS   BC1.\nOX   NCBI_TaxID=86416;\nSQ   SEQUENCE   5 AA;\n     AC DEF\n//\n")
    r = files.record_header(files.read_uniprot(spark, str(tmp_path / "a.spt"))).first()
    assert (r.id, r.taxid, r.sequence) == ("R4K4X3_CLOPA", 86416, "ACDEF")
    assert r.description == "tr.R4K4X3.R4K4X3_CLOPA Ferredoxin OS=Clostridium pasteurianum BC1. OX=86416"
    (tmp_path / "a.gp").write_text('LOCUS       WP_1   5 aa\nACCESSION   WP_1\nFEATURES\n                     /db_xref="taxon:1501"\nORIGIN\n        1 acd ef\n//\n')
    g = files.read_genbank(spark, str(tmp_path / "a.gp")).first()
    assert (g.id, g.accession, g.taxid, g.sequence) == ("WP_1", "WP_1", 1501, "ACDEF")


def test_cif(spark, tmp_path):
    text = "data_X\n_cell.a 1.5\n_entry.title 'two words'\n_note.t\n;line one\nline two\n;\nloop_\n_atom_site.group_PDB\n_atom_site.id\n_atom_site.type_symbol\n_atom_site.label_atom_id\n_atom_site.label_comp_id\n_atom_site.label_asym_id\n_atom_site.label_seq_id\n_atom_site.Cartn_x\n_atom_site.Cartn_y\n_atom_site.Cartn_z\nATOM 1 N N ALA A 1 0.0 1.0 2.0\nHETATM 2 C CA GLY A 2 1.0 ? 2.0\n"
    (tmp_path / "x.cif").write_text(text)
    v = files.read_cif(spark, str(tmp_path / "x.cif"))
    items = files.cif_items(v).first()["items"]
    assert items["_entry.title"] == "two words" and items["_note.t"] == "line one\nline two"
    a = files.cif_atoms(v).orderBy("atom_ord").collect()
    assert [(r.name, r.res_name, r.res_seq, r.y, r.is_hetero, r.deposit_id) for r in a] == [(" N  ", "ALA", 1, 1.0, False, "x"), (" CA ", "GLY", 2, 0.0, True, "x")]
    assert files.sniff(spark, str(tmp_path / "x.cif")).first().format == "cif"


def test_pdb_round_trip(spark, tmp_path):
    (tmp_path / "p.pdb").write_text("HEADER    LIGASE                                  01-JAN-00   1ABC\n" + ATOM + "\n")
    atoms = files.read_pdb_atoms(spark, str(tmp_path / "p.pdb"))
    r = atoms.first()
    assert (r.serial, r.name, r.alt_loc, r.res_name, r.chain_id, r.res_seq, r.i_code, r.element) == (2831, " OE1", "B", "GLN", "A", 294, "C", "O")
    assert atoms.select(structure.atom_line()).first()[0] == ATOM
    assert files.read_pdb_deposits(spark, str(tmp_path / "p.pdb")).first().id_code == "1ABC"


def _helix(spark, n=14):
    from strandframe.operators.building import backbone_definition, restore
    import numpy as np

    rows = backbone_definition(n, -57.0, -47.0)
    xyz = restore(*(np.array([r[k] for r in rows]) for k in (2, 3, 4)))
    out = []
    for i in range(n):
        a = {name: xyz[3 * i + k] for k, name in enumerate(("N", "CA", "C"))}
        nxt = xyz[3 * i + 3] if 3 * i + 3 < len(xyz) else a["C"] + (a["C"] - a["CA"]) * [1, -1, 1]
        u = (a["CA"] - a["C"]) / np.linalg.norm(a["CA"] - a["C"]) + (nxt - a["C"]) / np.linalg.norm(nxt - a["C"])
        a["O"] = a["C"] - 1.23 * u / np.linalg.norm(u)
        for k, (name, p) in enumerate(a.items()):
            out.append(("h", 1, 4 * i + k, 4 * i + k + 1, f" {name:<3}", " ", "ALA", "A", "1", i + 1, " ", *map(float, p), 1.0, 0.0, name[0], None, False))
    return spark.createDataFrame(out, files.ATOMS)


def test_structure(spark):
    atoms = _helix(spark)
    c = structure.counts(atoms).first()
    assert (c.n_atoms, c.n_residues, c.n_chains) == (56, 14, 1)
    angles = structure.phi_psi(atoms).orderBy("res_ord").collect()
    assert angles[0].phi is None and angles[5].phi == pytest.approx(-57.0, abs=0.01) and angles[5].psi == pytest.approx(-47.0, abs=0.01)
    assert structure.peptide_bonds(atoms).count() == 13
    bonds = {(r.d, r.a) for r in structure.hydrogen_bonds(atoms).collect()}
    assert {(i + 4, i) for i in range(1, 9)} <= bonds
    codes = "".join(r.code for r in structure.dssp(atoms).orderBy("res").collect())
    assert len(codes) == 14 and "HHHHHH" in codes
    assert structure.chain_sequences(atoms, residue_types(spark)).first().sequence == "A" * 14
    assert structure.complete_backbones(atoms).count() == 14
    assert structure.is_sorted(atoms).first().is_sorted
    near = structure.contacts(atoms, 4.0)
    assert near.where("a_res_ord <= b_res_ord").count() == 0 and near.count() > 0
    assert structure.renumber(atoms).agg({"serial": "max"}).first()[0] == 56
    runs = structure.hec_runs(spark.createDataFrame([(1, "CHHHCEE")], "k int, hec string"), ["k"]).orderBy("first").collect()
    assert [(r.code, r.first, r.last, r.segment) for r in runs] == [("C", 0, 0, None), ("H", 1, 3, 1), ("C", 4, 4, None), ("E", 5, 6, 2)]


def test_taxonomy(spark, tmp_path):
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tgenus\t|\n3\t|\t2\t|\tspecies\t|\n")
    (tmp_path / "names.dmp").write_text("1\t|\troot\t|\t\t|\tscientific name\t|\n2\t|\tHomo\t|\t\t|\tscientific name\t|\n3\t|\tHomo sapiens\t|\t\t|\tscientific name\t|\n3\t|\thuman\t|\t\t|\tcommon name\t|\n")
    nodes, names = files.read_taxdump(spark, str(tmp_path))
    paths = taxonomy.closure(nodes)
    line = taxonomy.lineage(paths, spark.createDataFrame([(3,)], "id long")).orderBy("depth").collect()
    assert [r.ancestor for r in line] == [1, 2, 3]
    assert taxonomy.nearest_rank(paths, nodes, "genus").where("id = 3").first().ancestor == 2
    ranked = names.join(nodes.selectExpr("id as tax_id", "rank"), "tax_id").withColumn("rank_order", taxonomy.rank_order("rank"))
    text = spark.createDataFrame([(0, "kinase (Homo sapiens), partial"), (1, "none")], "ord long, description string")
    assert [(r.ord, r.tax_id) for r in taxonomy.match_names(text, ranked).collect()] == [(0, 3)]


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# c\n1.0,2.0,3.0\n4,5,6\n")
    assert files.read_delimited(spark, str(tmp_path / "a.csv"), "a double, b double, c double").count() == 2
    (tmp_path / "n.txt").write_text("1 2\t3\n # no\n4   5 6\n")
    assert [r["values"] for r in files.read_whitespace(spark, str(tmp_path / "n.txt")).collect()] == [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]


def test_taxonomy_archive_and_names(spark, tmp_path):
    import io
    import tarfile

    from strandframe.operators import taxonomy
    from strandframe.sources import files

    nodes = "1\t|\t1\t|\tno rank\t|\n9606\t|\t1\t|\tspecies\t|\n"
    names = "1\t|\troot\t|\t\t|\tscientific name\t|\n9606\t|\tHomo sapiens\t|\t\t|\tscientific name\t|\n9606\t|\thuman\t|\t\t|\tcommon name\t|\n9606\t|\tx\t|\t\t|\tauthority\t|\n"
    with tarfile.open(tmp_path / "taxdump.tar.gz", "w:gz") as tar:
        for name, text in (("nodes.dmp", nodes), ("names.dmp", names)):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text.encode()))
    tree, called = files.read_taxdump(spark, str(tmp_path / "taxdump.tar.gz"))
    assert sorted(map(tuple, tree.collect())) == [(1, 1, "no rank", "root"), (9606, 1, "species", "Homo sapiens")]
    wanted = spark.createDataFrame([("human",), ("nobody",)], "name string")
    ids = taxonomy.taxids_of(called, wanted)
    assert list(map(tuple, ids.collect())) == [("human", 9606)]
    assert taxonomy.names_of(called, ids).first().names == ["Homo sapiens", "human"]


def test_ligands_leave_out_additives(spark):
    from strandframe.operators import structure

    rows = [("d", c, "non-polymer") for c in ("HOH", "ZN", "MES", "ATP", "EDO", "ATP")] + [("d", "ALA", "polymer")]
    got = structure.ligands(spark.createDataFrame(rows, "deposit_id string, code string, entity_type string")).collect()
    assert sorted(r.code for r in got) == ["ATP", "EDO"]


def test_matrix_read_by_spark(spark, tmp_path):
    from strandframe.functions.scoring import read_ncbi_matrix

    path = tmp_path / "m.txt"
    path.write_text("# a matrix\n   A  R\nA  4 -1\nR -1  5\n")
    one, other = read_ncbi_matrix(str(path)), read_ncbi_matrix(str(path), spark)
    assert one.letters == other.letters and (one.rows == other.rows).all() and other.rows.tolist() == [[4, -1], [-1, 5]]


def test_structure_of_components_and_deposit_files(spark, tmp_path):
    from strandframe.operators import structure
    from strandframe.sources import files

    (tmp_path / "gb").mkdir()
    text = "data_ALA\n_chem_comp.id ALA\n_chem_comp.type 'L-PEPTIDE LINKING'\nloop_\n_chem_comp_atom.pdbx_ordinal\n_chem_comp_atom.atom_id\n_chem_comp_atom.pdbx_leaving_atom_flag\n_chem_comp_atom.type_symbol\n1 N N N\n2 CA N C\n3 OXT Y O\n"
    (tmp_path / "gb" / "2gb1.cif").write_text(text)
    (tmp_path / "pdb1abc.ent").write_text("HEADER\nATOM      1  CA  ALA A   1       1.000   2.000   3.000  1.00  0.00           C\nATOM      2  N   ALA A   1       1.000   2.000   3.000  1.00  0.00           N\n")
    assert files.find_deposit(spark, "2GB1", str(tmp_path)).endswith("/gb/2gb1.cif")
    assert files.find_deposit(spark, "1abc", str(tmp_path), "pdb").endswith("/pdb1abc.ent")
    with pytest.raises(FileNotFoundError):
        files.find_deposit(spark, "9xyz", str(tmp_path))
    values = files.read_cif(spark, str(tmp_path / "gb"))
    reference = files.component_reference(values)
    assert sorted((r.atom_name, r.leaving) for r in reference.collect()) == [("CA", False), ("N", False), ("OXT", True)]
    atoms = files.read_structure(spark, str(tmp_path / "pdb1abc.ent"))
    assert atoms.count() == 2 and structure.complete_residues(atoms, reference).count() == 1
    types = files.component_types(values)
    assert [(r.code3, r.kind) for r in types.collect()] == [("ALA", "peptide")]


def test_pdb_numbers_beyond_their_columns(spark, tmp_path):
    numbers = {5: (-9999, 0, 99999, 100_000, 43_770_015, 43_770_016, 87_440_031), 4: (-999, 9999, 10_000, 1_223_055, 1_223_056, 2_436_111)}
    for width, values in numbers.items():
        got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, n int").orderBy("k").select(structure.hybrid36("n", width)).collect()]
        assert [parsers.hybrid36(x) for x in got] == list(values) and {len(x) for x in got} == {width}
    assert parsers.hybrid36("A0000") == 100_000 and parsers.hybrid36("a000") == 1_223_056
    (tmp_path / "p.pdb").write_text(ATOM)
    far = files.read_pdb_atoms(spark, str(tmp_path / "p.pdb")).selectExpr("* except (serial, res_seq)", "3600000 as serial", "899999 as res_seq")
    (tmp_path / "q.pdb").write_text(far.select(structure.atom_line()).first()[0])
    assert files.read_pdb_atoms(spark, str(tmp_path / "q.pdb")).select("serial", "res_seq", "i_code", "x").first() == (3_600_000, 899_999, "C", -27.117)
