"""Fixed chemical values and the small dimension tables made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Three-letter and one-letter codes of the standard amino acids.
AMINO_ACIDS = "ALA A ARG R ASN N ASP D CYS C GLN Q GLU E GLY G HIS H ILE I LEU L LYS K MET M PHE F PRO P SER S THR T TRP W TYR Y VAL V"
#: Nucleotides of DNA and RNA.
NUCLEOTIDES = "DA A DC C DG G DT T A A C C G G U U"
#: Backbone atoms of a residue, and the four that a complete one has.
BACKBONE = ("N", "CA", "C", "O", "H", "OXT", "HA", "HA2", "HA3")
COMPLETE_BACKBONE = ("N", "CA", "C", "O")
AROMATIC = ("TRP", "TYR", "PHE", "HIS")
#: Codes that are common additives, not ligands.
IRRELEVANT_LIGANDS = ("HOH", "GOL", "CA", "NA", "MG", "SO4", "PO4", "MES", "CL", "K", "ZN")
#: Experimental methods of a deposit.
METHODS = (
    "X-RAY DIFFRACTION", "FIBER DIFFRACTION", "NEUTRON DIFFRACTION", "ELECTRON CRYSTALLOGRAPHY", "ELECTRON MICROSCOPY", "SOLID-STATE NMR", "SOLUTION NMR", "SOLUTION SCATTERING", "POWDER DIFFRACTION", "INFRARED SPECTROSCOPY", "EPR", "FLUORESCENCE TRANSFER", "THEORETICAL MODEL",
)
#: Helix classes of PDB records.
HELIX_CLASSES = {1: "RightAlphaHelix", 2: "RightOmegaHelix", 3: "RightPiHelix", 4: "RightGammaHelix", 5: "Right310Helix", 6: "LeftAlphaHelix", 7: "LeftOmegaHelix", 8: "LeftGammaHelix", 9: "Helix27", 10: "PolyprolineHelix"}
#: Taxonomic ranks in the order of preference for a match.
RANKS = ("unclassified", "species", "genus", "family", "order", "class", "phylum", "kingdom", "superkingdom")

PEPTIDE, NUCLEIC, OTHER = "peptide", "nucleic", "other"


def residue_types(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    """code3, code1, kind: standard residues, and those of `extra` that the standard ones lack."""
    rows = []
    for text, kind in ((AMINO_ACIDS, PEPTIDE), (NUCLEOTIDES, NUCLEIC)):
        parts = text.split()
        rows += [(a, b, kind) for a, b in zip(parts[::2], parts[1::2], strict=True)]
    rows += [("MSE", "M", PEPTIDE), ("UNK", "X", PEPTIDE), ("HOH", "O", OTHER)]
    table = spark.createDataFrame(rows, "code3 string, code1 string, kind string")
    return table if extra is None else table.unionByName(extra.join(table, "code3", "left_anti").dropDuplicates(["code3"]))


def is_peptide_linking(kind: Column) -> Column:
    """Whether a component's type text is of a peptide, whatever its configuration."""
    return F.upper(kind).contains("PEPTIDE")


def is_l_peptide_linking(kind: Column) -> Column:
    """Peptides of L configuration, or of none stated."""
    return is_peptide_linking(kind) & ~F.upper(kind).startswith("D-")


def is_d_peptide_linking(kind: Column) -> Column:
    """Peptides of D configuration, or of none stated."""
    return is_peptide_linking(kind) & ~F.upper(kind).startswith("L-")


def is_nucleic_linking(kind: Column) -> Column:
    return F.upper(kind).rlike("^(L-)?[DR]NA ")


def monomer_kind(text: str) -> str:
    """Class of a chemical component's type text."""
    low = text.lower()
    return PEPTIDE if "peptide" in low else NUCLEIC if "dna" in low or "rna" in low else OTHER
