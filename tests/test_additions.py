"""Choice among equal alignments, trimming, list files, FASTA graphs, data and colours of unitigs, streamed counts."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandloom import cli
from strandloom.functions import kmers as km
from strandloom.operators import align, bubbles, counts, graph
from strandloom.plans import ploidy
from strandloom.sources import files
from strandloom.streaming import updates

B = "GCTAAAGACAATTACATAACATACACGTCAGCACGAAACTTGTTGGCCCAGTGTGAATCGCTTAAGGGTTAA"
ALT = B[:35] + "C" + B[36:]


def _every(a, b):
    """All alignments of a and b: score, number of variants, runs of gaps."""

    def go(i, j, last, score, variants, runs):
        if i == len(a) and j == len(b):
            yield score, variants, runs
        for move, di, dj in (("L", 0, 1), ("U", 1, 0), ("D", 1, 1)):
            if i + di <= len(a) and j + dj <= len(b):
                same = move == last
                if move == "D":
                    differ = a[i] != b[j]
                    yield from go(i + 1, j + 1, move, score + (-1 if differ else 2) + same, variants + differ, runs)
                else:
                    yield from go(i + di, j + dj, move, score - 3 + same, variants + (not same), runs + (not same))

    return go(0, 0, None, 0, 0, 0)


def test_of_equal_alignments_one_of_the_fewest_variants():
    rng, gained = random.Random(5), 0
    for _ in range(150):
        a, b = ("".join(rng.choice("AC") for _ in range(rng.randint(0, 6))) for _ in range(2))
        best = max(((s, -v, -r) for s, v, r in _every(a, b)))
        x, y, score = align.align(a, b, fewest=True)
        v = align.variants(x, y)
        assert (x.replace("-", ""), y.replace("-", "")) == (a, b)
        assert (score, -(v["n_snp"] + v["n_indel"]), -v["n_indel"]) == best, (a, b, x, y)
        plain = align.variants(*align.align(a, b)[:2])
        gained += plain["n_snp"] + plain["n_indel"] > -best[1]
    assert gained


def test_reads_are_trimmed(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ACGT") for _ in range(n)), "".join(chr(33 + rng.choice([2, 12, 25, 40, 40])) for _ in range(n))) for i, n in enumerate([0, 1, 5, 30, 80, 80])] + [(9, "ACGT", None)]
    got = {r["id"]: (r["seq"], r["qual"]) for r in km.trimmed(spark.createDataFrame(rows, "id int, seq string, qual string"), least=1).collect()}
    want = {}
    for i, seq, qual in rows:
        if qual is None:
            want[i] = (seq, None)
            continue
        q = [ord(c) - 33 for c in qual]
        good = [p for p, x in enumerate(q) if x >= 10]
        if not good:
            continue
        start, end = good[0], good[-1] + 1
        low = [p for p in range(start, end - 2) if sum(q[p : p + 3]) < 60]
        end = min([end, *low])
        if end > start:
            want[i] = (seq[start:end], qual[start:end])
    assert got == want


def test_common_prefixes_and_gaps(spark):
    rows = [("", ""), ("A", ""), ("ACG", "ACT"), ("ACG", "ACGT"), ("T", "A"), (None, "A")]
    d = spark.createDataFrame(rows, "a string, b string").select(km.lcp(F.col("a"), F.col("b")).alias("n"))
    assert [r[0] for r in d.collect()] == [0, 0, 2, 3, 0, None]
    d = spark.createDataFrame([("A-C--G",), ("ACGT\n",)], "a string").select(km.strip_gaps(F.col("a")).alias("s"), km.is_dna(F.col("a")).alias("dna"))
    assert [tuple(r) for r in d.collect()] == [("ACG", False), ("ACGT\n", False)]


def test_list_files_and_fasta_graphs(spark, tmp_path, capsys):
    (tmp_path / "a.fa").write_text("".join(f">r{i}\n{t}\n" for i, t in enumerate([B] * 3 + [ALT] * 3)))
    (tmp_path / "list").write_text(f"{tmp_path}/a.fa\n\n")
    p = lambda x: str(tmp_path / x)
    assert files.expanded(spark, ["x", "@" + p("list")]) == ["x", p("a.fa")]
    cli.main(["build", "--reads", "@" + p("list"), "--k", "11", "--output", p("g"), "--fasta", "--colors", "--info"], spark)
    assert "n_colors" in capsys.readouterr().out
    cli.main(["count", p("a.fa"), "--k", "11", "--output", p("counts")], spark)
    with pytest.raises(SystemExit):
        cli.main(["query", p("a.fa"), "--graph", p("g.fasta"), "--output", p("q")], spark)
    with pytest.raises(SystemExit):
        cli.main(["query", p("a.fa"), "--graph", p("g.gfa"), "--k", "13", "--output", p("q")], spark)
    cli.main(["query", p("a.fa"), "--graph", p("g.fasta"), "--k", "11", "--output", p("q")], spark)
    assert sum(r[0].endswith("\t1") for r in spark.read.text(p("q")).collect()) == 6
    cli.main(["sites", "--graph", p("g.gfa"), "--counts", p("counts"), "--low", "1", "--alignments", "--output", p("s")], spark)
    seqs = {r["seq"] for r in files.read_fasta(spark, p("s_alignments.fasta")).collect()}
    assert len(seqs) == 2 and len({len(x) for x in seqs}) == 1 and all(x in B + "|" + ALT + "|" + "".join(reversed(B.translate(str.maketrans("ACGT", "TGCA")))) + "|" + "".join(reversed(ALT.translate(str.maketrans("ACGT", "TGCA")))) for x in seqs)


def test_data_and_colors_follow_their_unitigs(spark):
    one, two = (spark.createDataFrame([(x,) for x in xs], "seq string") for xs in ([B], [B, ALT]))
    g, h = ploidy.build(refs=one, k=11), ploidy.build(refs=two, k=11)
    old = g["unitigs"].select(F.col("unitig_id").alias("old_id")).withColumn("note", F.lit("whole"))
    rows = graph.carried(h["unitigs"], g["unitigs"], old, 11).collect()
    # the line is split around the bubble: three of the four unitigs are parts of it
    assert h["unitigs"].count() == 4 and len(rows) == 3 and {r["note"] for r in rows} == {"whole"}
    assert sum(r["n"] for r in rows) == len(B) - 10 and all(r["last"] - r["first"] + 1 == r["n"] for r in rows)
    back = graph.carried(g["unitigs"], h["unitigs"], h["unitigs"].select(F.col("unitig_id").alias("old_id"), "seq"), 11).orderBy("first").collect()
    assert [r["first"] for r in back] == [1, *itertools.accumulate((r["n"] for r in back[:-1]), initial=1)][1:]

    kc = counts.colors(two.withColumn("color", F.col("seq").contains("AAACTTG").cast("int")), 11)
    u = g["unitigs"]
    ranges = u.select("unitig_id", F.lit(1).alias("first"), F.lit(5).alias("last"))
    assert [(r["color"], r["n"], r["whole"]) for r in graph.colors_between(u, kc, 11, ranges).orderBy("color").collect()] == [(c, 5, True) for c in sorted({r[0] for r in kc.select("color").distinct().collect()})]
    info = graph.color_info(u, kc, 11, 7).first()
    assert (info["k"], info["g"], info["n_unitigs"], info["colors"]) == (11, 7, 1, sorted(info["colors"]))
    assert graph.equal(kc, kc, colored=True) and not graph.equal(kc, kc.withColumn("color", F.lit(7)), colored=True)


def test_streamed_counts_are_those_of_all_reads(spark, tmp_path):
    src = str(tmp_path / "in")
    for text in (B, ALT):
        spark.createDataFrame([(text,), (text,)], "seq string").coalesce(1).write.mode("append").parquet(src)
    reads = spark.readStream.schema("seq string").option("maxFilesPerTrigger", 1).parquet(src)
    q = updates.append_counts(reads, 11, str(tmp_path / "t"), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in updates.counts_so_far(spark, str(tmp_path / "t")).select("kmer", "cnt").collect()}
    assert got == {tuple(r) for r in counts.count_kmers(spark.read.parquet(src), 11).select("kmer", "cnt").collect()}


def test_bubble_table_and_call(spark, tmp_path):
    h = ploidy.build(refs=spark.createDataFrame([(B,), (ALT,)], "seq string"), k=11)
    b = bubbles.superbubbles(h["edges"], graph.components(h["edges"]))
    files.write_bubbles(b, str(tmp_path / "b"))
    rows = spark.read.csv(str(tmp_path / "b"), sep="\t", header=True).collect()
    assert len(rows) == 2 and len({r["BubbleId"] for r in rows}) == 1 and {r["isSimple"] for r in rows} == {"1"}
    rng = random.Random(1)
    sites = spark.createDataFrame([(i, 0, 2, [float(round(rng.gauss(50, 3))), 50.0]) for i in range(200)], "bubble_id long, site_idx int, n_alleles int, cov array<double>")
    from strandloom.operators import gmm

    assert gmm.best(ploidy.call_ploidy(sites, ploidies=range(2, 5))).first()["ploidy"] == 2
