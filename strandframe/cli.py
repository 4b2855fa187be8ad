"""Command line: python -m strandframe.cli COMMAND ... Each command is a chain of DataFrame operators."""

from __future__ import annotations

import argparse
import functools
import operator
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions import atoms as A
from strandframe.functions import sequences as S
from strandframe.functions.chemistry import residue_types
from strandframe.functions.ids import sequence_ids
from strandframe.operators import align, clustering, sequences, stats, structure, taxonomy
from strandframe.sources import files
from strandframe.sources.writers import write_fasta, write_pdb


def _read_sequences(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return files.read_fasta(spark, args.input, args.cleaning)


def filter_fasta(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Filters, then the id list, then sub-sequence hits or unique and sorted records."""
    df, conditions = _read_sequences(spark, args), []
    if args.longer_than is not None:
        conditions.append(S.longer_than(args.longer_than))
    if args.shorter_than is not None:
        conditions.append(S.shorter_than(args.shorter_than))
    if args.max_x is not None:
        conditions.append(~S.contains_x(args.max_x))
    if args.motif:
        conditions.append(S.has_motif(args.motif))
    if args.description:
        conditions.append(S.description_contains(args.description))
    if args.only:
        conditions.append({"nucleic": S.is_nucleic(), "protein": S.is_protein()}[args.only])
    df = sequences.filter_sequences(df, *conditions)
    if args.ids:
        listed = spark.read.text(args.ids).select(F.trim("value").alias("id")).where("id <> ''")
        named = df.withColumn("id", F.explode(F.array_distinct(F.transform(sequence_ids("description"), lambda x: x["value"]))))
        df = sequences.retrieve(named, listed, "id").drop("id").distinct()
    if args.subsequences:
        return sequences.find_subsequences(df, files.read_fasta(spark, args.subsequences).select(F.col("description").alias("query_id"), F.col("seq").alias("query")))
    if args.unique:
        df = sequences.unique_sequences(df)
    return sequences.sort_by_length(df) if args.sort else df


def cluster_sequences(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Greedy clusters by identity, or a dendrogram's clusters over all aligned pairs."""
    df = _read_sequences(spark, args)
    if args.linkage is None:
        return clustering.bucket_clustering(df, args.identity, args.lots)
    pairs = align.align_all_pairs(df, gap_open=-11, gap_extend=-1)
    d = pairs.select(F.lit(0).alias("k"), F.col("q").alias("i"), F.col("t").alias("j"), (100 - F.coalesce("percent_identity", F.lit(0.0))).alias("d"))
    return clustering.hierarchical(d, ["k"], args.linkage, 100 * (1 - args.identity), default=100.0).drop("k")


def align_pairs(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    queries = _read_sequences(spark, args)
    templates = files.read_fasta(spark, args.templates, args.cleaning) if args.templates else None
    return align.align_all_pairs(queries, templates, args.low, args.high, gap_open=args.gap_open, gap_extend=args.gap_extend, local=args.local)


def msa_tool(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    reader = {"sto": files.read_stockholm, "aln": files.read_clustalw}.get(args.input.rsplit(".", 1)[-1], files.read_fasta)
    msa = reader(spark, args.input)
    keys = ["path", "msa_id"] if "msa_id" in msa.columns else ["path"]
    call = {"info": sequences.msa_info, "check": sequences.check_msa, "consensus": sequences.consensus, "profile": sequences.profile, "medoid": sequences.medoid_sequence, "longest": sequences.longest_sequence, "pairs": sequences.identity_pairs, "trim": sequences.remove_gapped_columns}
    return call[args.what](msa, keys)


def pdb_tool(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    atoms = files.cif_atoms(files.read_cif(spark, args.input)) if args.input.endswith((".cif", ".cif.gz")) else files.read_pdb_atoms(spark, args.input)
    tests: list[Column] = []
    if args.chain:
        tests.append(A.by_chain(args.chain))
    if args.range:
        first, last = map(A.parse_residue_id, args.range.split(","))
        tests.append(A.by_residue_range(first, last))
    tests += [f() for n, f in (("ca", A.is_ca), ("backbone", A.is_backbone), ("protein", A.is_peptide), ("nucleic", A.is_nucleic), ("no_water", A.is_not_water)) if getattr(args, n)]
    atoms = atoms.where(functools.reduce(operator.and_, tests, F.lit(True)))
    if args.what == "atoms":
        return atoms
    if args.what == "contacts":
        return structure.contacts(atoms, args.cutoff)
    if args.what == "sequence":
        return structure.chain_sequences(atoms, residue_types(spark))
    return {"counts": structure.counts, "dssp": structure.dssp, "hbonds": structure.hydrogen_bonds, "phi_psi": structure.phi_psi, "residues": structure.residues}[args.what](atoms)


def taxonomy_tool(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    nodes, names = files.read_taxdump(spark, args.input)
    paths = taxonomy.closure(nodes)
    if args.detect:
        ranked = names.join(nodes.select(F.col("id").alias("tax_id"), "rank"), "tax_id").withColumn("rank_order", taxonomy.rank_order(F.col("rank")))
        return taxonomy.match_names(files.read_fasta(spark, args.detect), ranked)
    ids = spark.createDataFrame([(x,) for x in args.ids], "id long") if args.ids else nodes.select("id")
    if args.ranks:
        return taxonomy.rank_table(paths.join(ids, "id", "left_semi"), nodes, args.ranks)
    return taxonomy.lineage(paths, ids)


def hist2d(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    rows = files.read_whitespace(spark, args.input).select(*(F.get("values", F.lit(c - 1)).alias(n) for c, n in zip(args.columns, "xy", strict=True)))
    return stats.histogram_nd(rows, ["x", "y"], args.widths)


def autocorrelation(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    rows = files.read_whitespace(spark, args.input).withColumn("i", F.monotonically_increasing_id())
    rows = rows.select("i", *(F.get("values", F.lit(c - 1)).alias(f"c{c}") for c in args.columns))
    return stats.autocorrelation(rows, "i", [f"c{c}" for c in args.columns], args.lags)


def clusters_of_distances(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    d = files.read_distances(spark, args.input)
    if args.linkage == "single":
        ids = d.select(F.col("i").alias("id")).union(d.select("j")).distinct()
        return clustering.single_link(d, ids, args.cutoff)
    return clustering.hierarchical(d.withColumn("k", F.lit(0)), ["k"], args.linkage, args.cutoff).drop("k")


def _points(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, list[str]]:
    """The asked columns of a file of numbers, as x1, x2 and on, with a row's `id`."""
    names = [f"x{c}" for c in args.columns]
    rows = files.read_whitespace(spark, args.input).withColumn("id", F.monotonically_increasing_id())
    return rows.select("id", *(F.get("values", F.lit(c - 1)).alias(n) for c, n in zip(args.columns, names, strict=True))), names


def kmeans(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Points with their cluster and cost."""
    points, names = _points(spark, args)
    return clustering.kmeans(points.withColumn("features", F.array(*names)), args.clusters, repeats=args.repeats)[0].drop("features")


def optics(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Points of the clusters that have the least size, in order of reach."""
    points, names = _points(spark, args)
    got = clustering.optics(points, "id", names, args.radius, args.min_points)
    large = got.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= args.min_size)
    return got.join(large.select("cluster"), "cluster").join(points, "id")


def fit_normal(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Means and covariances of the columns."""
    points, names = _points(spark, args)
    return stats.covariance(points, names)


def stockholm_to_fasta(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Aligned rows, or with --ungapped their sequences."""
    rows = files.read_stockholm(spark, args.input)
    return rows.withColumn("seq", S.ungapped("seq")) if args.ungapped else rows


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="strandframe", description=__doc__)
    sub = out.add_subparsers(dest="command", required=True)

    def command(name: str, f, *options: tuple[str, dict]) -> None:
        p = sub.add_parser(name, help=f.__doc__)
        p.set_defaults(run=f)
        p.add_argument("input")
        p.add_argument("--out", help="folder for the result; without it the first rows are shown")
        p.add_argument("--format", choices=("parquet", "json", "csv", "fasta", "pdb"), default="parquet")
        for flag, how in options:
            p.add_argument(flag, **how)

    flag, number, real = {"action": "store_true"}, {"type": int}, {"type": float}
    cleaning = ("--cleaning", {"choices": ("raw", "protein", "protein_stop", "nucleic"), "default": "raw"})
    command("filter-fasta", filter_fasta, cleaning, ("--longer-than", number), ("--shorter-than", number), ("--max-x", number), ("--motif", {}), ("--description", {}), ("--only", {"choices": ("nucleic", "protein")}), ("--ids", {}), ("--subsequences", {}), ("--unique", flag), ("--sort", flag))
    command("cluster-sequences", cluster_sequences, cleaning, ("--identity", {"type": float, "default": 0.9}), ("--lots", {"type": int, "default": 16}), ("--linkage", {"choices": sorted(clustering.LINKAGES)}))
    command("align", align_pairs, cleaning, ("--templates", {}), ("--low", {"type": float, "default": 0.0}), ("--high", {"type": float, "default": 100.0}), ("--gap-open", {"type": int, "default": -10}), ("--gap-extend", {"type": int, "default": -2}), ("--local", flag))
    command("msa", msa_tool, ("--what", {"choices": ("info", "check", "consensus", "profile", "medoid", "longest", "pairs", "trim"), "default": "info"}))
    command("pdb", pdb_tool, ("--what", {"choices": ("atoms", "counts", "contacts", "sequence", "dssp", "hbonds", "phi_psi", "residues"), "default": "counts"}), ("--chain", {}), ("--range", {}), ("--cutoff", {"type": float, "default": 4.0}), ("--ca", flag), ("--backbone", flag), ("--protein", flag), ("--nucleic", flag), ("--no-water", flag))
    command("taxonomy", taxonomy_tool, ("--ids", {"type": int, "nargs": "*"}), ("--ranks", {"nargs": "*"}), ("--detect", {}))
    command("hist2d", hist2d, ("--columns", {"type": int, "nargs": 2, "default": [1, 2]}), ("--widths", {"type": float, "nargs": 2, "default": [1.0, 1.0]}))
    command("autocorrelation", autocorrelation, ("--columns", {"type": int, "nargs": "+", "default": [1, 2, 3]}), ("--lags", {"type": int, "default": 100}))
    command("clust", clusters_of_distances, ("--linkage", {"choices": sorted(clustering.LINKAGES), "default": "single"}), ("--cutoff", {**real, "default": 0.0}))
    columns = ("--columns", {"type": int, "nargs": "+", "default": [1, 2]})
    command("kmeans", kmeans, columns, ("--clusters", {"type": int, "default": 2}), ("--repeats", {"type": int, "default": 1}))
    command("optics", optics, columns, ("--radius", {**real, "default": 1.0}), ("--min-points", {"type": int, "default": 5}), ("--min-size", {"type": int, "default": 1}))
    command("normal", fit_normal, columns)
    command("stockholm-to-fasta", stockholm_to_fasta, ("--ungapped", flag))
    return out


def main(argv: list[str], spark: SparkSession | None = None) -> DataFrame:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("strandframe").getOrCreate()
    df = args.run(spark, args)
    if not args.out:
        df.show(20, truncate=False)
    elif args.format == "fasta":
        write_fasta(df, args.out)
    elif args.format == "pdb":
        write_pdb(df, args.out)
    else:
        df.write.format(args.format).save(args.out)
    return df


if __name__ == "__main__":
    main(sys.argv[1:])
