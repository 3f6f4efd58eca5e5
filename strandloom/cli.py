"""Command line: python -m strandloom COMMAND ... (each command says its options with --help).

Tables of k-mer counts and graphs are Parquet folders; histograms, coverage tables and frequencies are text, as the
readers of strandloom.sources.files take them. Every command is a thin call of a plan or an operator.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.kmers import minimizer_length, trimmed
from strandloom.operators import counts, gmm, graph, search, sites
from strandloom.plans import ploidy
from strandloom.session import cut, session
from strandloom.sources import files

#: File name parts of the coverage tables by number of alleles.
TABLES = {2: "bicov", 3: "tricov", 4: "tetracov", 5: "pentacov"}


def _sequences(spark: SparkSession, paths: list[str] | None, trim: bool = False) -> DataFrame | None:
    if not paths:
        return None
    s = files.read_sequences(spark, files.expanded(spark, paths))
    return trimmed(s) if trim else s


def _cutoffs(spark, a) -> None:
    h = files.read_histogram(spark, a.histogram)
    row = counts.cutoffs(h, quantile=a.quantile).first()
    if row is None or row["up"] is None:
        raise SystemExit("the histogram needs two rows or more")
    print(row[{"cutoff-low": "low", "cutoff-up": "up"}[a.command]])


def _count(spark, a) -> None:
    c = cut(counts.count_kmers(_sequences(spark, a.input, a.trim), a.k, least=a.least), "counts")
    c.write.parquet(a.output)
    if a.histogram:
        counts.histogram(c).orderBy("cov").select(F.concat_ws("\t", F.col("cov").cast("string"), F.col("freq").cast("string"))).write.text(a.histogram)


def _save_graph(g: dict, a) -> None:
    files.write_gfa(g["unitigs"], g["edges"], g["k"], g["g"], f"{a.output}.gfa")
    if a.fasta:
        files.write_fasta(g["unitigs"], f"{a.output}.fasta")
    if a.info:
        graph.info(g["unitigs"], g["k"]).show()


def _build(spark, a) -> None:
    g = ploidy.build(_sequences(spark, a.reads, a.trim), _sequences(spark, a.refs), a.k, a.clip_tips, a.delete_isolated, a.mercy)
    _save_graph(g, a)
    if a.colors:
        every = _sequences(spark, [*(a.reads or []), *(a.refs or [])])
        counts.colors(every, a.k).join(g["kmers"], "kmer", "left_semi").write.parquet(f"{a.output}.colors")
        if a.info:
            graph.color_info(g["unitigs"], spark.read.parquet(f"{a.output}.colors"), g["k"], g["g"]).show(truncate=False)


def _load_graph(spark, path: str, k: int | None = None) -> dict:
    """The graph of a GFA file, whose header holds k, or of a FASTA file and k; links are made again from the segments."""
    if files.sniff(spark, path) == "fasta":
        if k is None:
            raise SystemExit(f"{path}: a FASTA graph needs --k")
        return ploidy.build(refs=files.read_fasta(spark, path).select("seq"), k=k)
    f = files.read_gfa(spark, path)
    head = f["header"].where("k is not null").first()
    if head is None:
        raise SystemExit(f"{path}: no k in the header")
    if k not in (None, head["k"]):
        raise SystemExit(f"{path}: its k is {head['k']}, not {k}")
    return ploidy.build(refs=f["segments"], k=head["k"])


def _update(spark, a) -> None:
    g = _load_graph(spark, a.graph, a.k)
    k = g["k"]
    added = ploidy.build(_sequences(spark, a.reads), _sequences(spark, a.refs), k)
    u = cut(graph.updated(g["unitigs"], k, added["kmers"]), "unitigs")
    _save_graph({"unitigs": u, "edges": cut(graph.edges(u, k), "edges"), "k": k, "g": minimizer_length(k)}, a)


def _query(spark, a) -> None:
    g = _load_graph(spark, a.graph, a.k)
    q = _sequences(spark, a.input)
    edits = dict(sub=True, ins=True, dele=True) if a.inexact else {}
    if a.colors:
        kc = spark.read.parquet(a.colors)
        names = sorted(r[0] for r in kc.select("color").distinct().collect())  # as many as sequence files
        out = search.presence_by_color(q, kc, g["k"], a.ratio, "read_id", names, **edits)
    else:
        out = search.presence(q, g["kmers"], g["k"], a.ratio, "read_id", **edits).select(F.col("read_id").alias("query_name"), F.col("present").alias("presence_query"))
    files.write_presence(out, a.output)


def _sites(spark, a) -> None:
    g = _load_graph(spark, a.graph, a.k)
    scores = dict(match=a.match, mismatch=a.mismatch, gap=a.gap)
    if len(a.counts) == 1:
        low, up = a.low, a.up
        if a.histogram:
            row = counts.cutoffs(files.read_histogram(spark, a.histogram)).first()
            low, up = row["low"], row["up"]
        s = cut(ploidy.site_tables(g, spark.read.parquet(a.counts[0]), low, up, a.most_unitigs, scores), "sites")
        if a.info:
            ploidy.core_coverage(g, spark.read.parquet(a.counts[0]), low, up, a.most_unitigs).show()
    else:
        if not a.cutoffs:
            raise SystemExit("several count tables need --cutoffs, a line for each")
        limits = files.read_cutoffs(spark, a.cutoffs).withColumnRenamed("sample_id", "color")
        if limits.count() != len(a.counts):
            raise SystemExit("there must be a line of cut-offs for each count table")
        every = None
        for i, path in enumerate(a.counts):
            c = spark.read.parquet(path).select(F.lit(i).alias("color"), "kmer", "cnt")
            every = c if every is None else every.unionByName(c)
        s = cut(ploidy.multi_site_tables(g, every, limits, len(a.counts), a.most_unitigs, scores), "sites")
    _save_sites(s, a.output, len(a.counts) > 1, a.q)
    if a.alignments:
        files.write_alignments(ploidy.alignments(g, a.most_unitigs, scores), f"{a.output}_alignments.fasta")


def _save_sites(s: DataFrame, prefix: str, multi: bool, q: float, strict: bool = False) -> None:
    for n, name in TABLES.items():
        files.write_coverage(s, f"{prefix}_{name}.txt", n, multi)
    files.write_frequencies(sites.within_quantile(sites.frequencies(s), q, strict), f"{prefix}_allele_frequency.txt")


def _filter(spark, a) -> None:
    parts = [files.read_coverage(spark, f"{a.input}_{name}.txt", n, a.multi) for n, name in TABLES.items()]
    s = parts[0]
    for p in parts[1:]:
        s = s.unionByName(p)
    s = s.withColumn("site_idx", F.lit(0))
    s = sites.filter_sites(s, a.low, a.up, a.simple, a.drop_indel, a.drop_snp, a.most_var_num, a.least_var_dis, a.most_indel, not a.multi, a.cramer if a.multi else None, a.color)
    _save_sites(s, a.output, a.multi, a.q, strict=True)


def _model(spark, a) -> None:
    f = cut(files.read_frequencies(spark, a.frequencies, a.q).groupBy("freq").agg(F.count("*").alias("n")), "freq")
    fits = gmm.fit_ploidies(f, range(a.lower, a.upper + 1), most_steps=a.steps, least_gain=a.gain, low_ratio=a.low_ratio, high_ratio=a.high_ratio)
    r = gmm.report(spark, fits)
    r.write.csv(f"{a.output}_model_result", sep="\t", header=True)
    print(gmm.best(r).first()["ploidy"])


def _density(spark, a) -> None:
    gmm.density(files.read_frequencies(spark, a.frequencies)).orderBy("x").write.csv(a.output, sep="\t", header=True)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandloom")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name, run, help_, *required):
        p = sub.add_parser(name, help=help_)
        p.set_defaults(run=run)
        for r in required:
            p.add_argument(f"--{r}", required=True)
        return p

    for name in ("cutoff-low", "cutoff-up"):
        p = command(name, _cutoffs, "coverage cut-off of a k-mer histogram")
        p.add_argument("histogram")
        p.add_argument("quantile", nargs="?", type=float, default=0.998)
    p = command("count", _count, "count the canonical k-mers of sequence files", "output")
    p.add_argument("input", nargs="+")
    p.add_argument("--k", type=int, default=25)
    p.add_argument("--least", type=int, default=1)
    p.add_argument("--trim", action="store_true", help="cut reads of low quality first")
    p.add_argument("--histogram")
    for name, run in (("build", _build), ("update", _update)):
        p = command(name, run, "make a graph of reads (k-mers seen twice) and references (all k-mers)" if name == "build" else "add sequences to a graph", "output")
        p.add_argument("--reads", nargs="+")
        p.add_argument("--refs", nargs="+")
        p.add_argument("--fasta", action="store_true", help="write the unitigs as FASTA as well")
        p.add_argument("--info", action="store_true")
        if name == "update":
            p.add_argument("--graph", required=True)
            p.add_argument("--k", type=int, help="of a FASTA graph")
            p.set_defaults(trim=False)
            continue
        p.add_argument("--k", type=int, default=31)
        for flag in ("--clip-tips", "--delete-isolated", "--mercy", "--colors", "--trim"):
            p.add_argument(flag, action="store_true")
    p = command("query", _query, "presence of sequences in a graph", "graph", "output")
    p.add_argument("input", nargs="+")
    p.add_argument("--colors")
    p.add_argument("--k", type=int, help="of a FASTA graph")
    p.add_argument("--ratio", type=float, default=0.8)
    p.add_argument("--inexact", action="store_true")
    p = command("sites", _sites, "bubbles, variant sites and allele frequencies", "graph", "output")
    p.add_argument("--counts", nargs="+", required=True, help="count tables, one a sample")
    p.add_argument("--k", type=int, help="of a FASTA graph")
    p.add_argument("--info", action="store_true", help="of one sample: the mean coverage of the bubbles' entrances")
    p.add_argument("--alignments", action="store_true", help="write the aligned paths of the bubbles as well")
    p.add_argument("--histogram")
    p.add_argument("--cutoffs")
    p.add_argument("--low", type=int, default=10)
    p.add_argument("--up", type=int, default=1000)
    p.add_argument("--most-unitigs", type=int, default=8)
    p.add_argument("--match", type=int, default=2)
    p.add_argument("--mismatch", type=int, default=-1)
    p.add_argument("--gap", type=int, default=-3)
    p.add_argument("--q", type=float, default=0.0)
    p = command("filter", _filter, "filter coverage tables", "input", "output")
    p.add_argument("--multi", action="store_true", help="tables of several samples")
    for flag in ("--simple", "--drop-indel", "--drop-snp"):
        p.add_argument(flag, action="store_true")
    p.add_argument("--low", type=float, default=0)
    p.add_argument("--up", type=float, default=1e9)
    for flag in ("--most-var-num", "--least-var-dis", "--most-indel", "--color"):
        p.add_argument(flag, type=int)
    p.add_argument("--cramer", type=float, default=0.0)
    p.add_argument("--q", type=float, default=0.0)
    p = command("model", _model, "fit every ploidy to allele frequencies; prints the best", "frequencies", "output")
    p.add_argument("--lower", type=int, default=2)
    p.add_argument("--upper", type=int, default=10)
    p.add_argument("--q", type=float, default=0.0)
    p.add_argument("--low-ratio", type=float, default=gmm.LOW_RATIO, help="guard of the weights, 0 for none")
    p.add_argument("--high-ratio", type=float, default=gmm.HIGH_RATIO)
    p.add_argument("--steps", type=int, default=1000)
    p.add_argument("--gain", type=float, default=0.01)
    command("density", _density, "kernel density of allele frequencies", "frequencies", "output")
    return top


def _check(a: argparse.Namespace) -> None:
    """Options that no data can make right."""
    has = lambda name: getattr(a, name, None) is not None
    wrong = [
        (has("k") and not (1 if a.command == "count" else 3) <= a.k <= 31, "k goes up to 31"),
        (has("k") and a.command != "count" and a.k % 2 == 0, "k must be odd"),
        (has("least") and a.least < 1, "the least count must be 1 or more"),
        (has("quantile") and not 0 <= a.quantile < 1, "the quantile must be 0 or more and under 1"),
        (has("ratio") and not 0 <= a.ratio <= 1, "the ratio must be from 0 to 1"),
        (has("q") and not 0 <= a.q <= 0.5, "q must be from 0 to 0.5"),
        (has("low") and has("up") and a.low > a.up, "the lower cut-off must not be over the upper one"),
        (has("most_unitigs") and a.most_unitigs < 4, "a bubble has four unitigs or more"),
        (has("match") and (a.mismatch > a.match or a.gap > a.match), "a mismatch and a gap must not score more than a match"),
        (has("lower") and not 2 <= a.lower <= a.upper, "ploidies go from 2 up, the lower one first"),
        (has("steps") and a.steps < 1, "one step or more is needed"),
        (has("gain") and a.gain < 0, "the gain must not be negative"),
        (has("low_ratio") and min(a.low_ratio, a.high_ratio) < 0, "ratios must not be negative"),
        (a.command in ("build", "update") and not (a.reads or a.refs), "reads or references are needed"),
    ]
    for bad, why in wrong:
        if bad:
            raise SystemExit(why)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    _check(a)
    a.run(spark or session(), a)
