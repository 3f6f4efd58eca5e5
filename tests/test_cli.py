"""The commands on a backbone with one variant base, from sequence files to the ploidy."""

import pytest

from strandloom import cli
from strandloom.operators import graph
from strandloom.plans import ploidy

B = "GCTAAAGACAATTACATAACATACACGTCAGCACGAAACTTGTTGGCCCAGTGTGAATCGCTTAAGGGTTAA"
ALT = B[:35] + "C" + B[36:]


def reads(path, *texts):
    path.write_text("".join(f">r{i}\n{t}\n" for i, t in enumerate(texts)))
    return str(path)


def lines(spark, path):
    return sorted(r[0] for r in spark.read.text(path).collect())


def test_cutoffs(spark, tmp_path, capsys):
    h = tmp_path / "hist"
    h.write_text("".join(f"{i}\t{f}\n" for i, f in enumerate([100, 40, 20, 10, 15, 30], 1)))
    cli.main(["cutoff-low", str(h)], spark)
    cli.main(["cutoff-up", str(h), "0.5"], spark)
    assert capsys.readouterr().out.split() == ["10", "3"]


def test_from_reads_to_ploidy(spark, tmp_path, capsys):
    fa, p = reads(tmp_path / "a.fa", *[B] * 12, *[ALT] * 12), lambda x: str(tmp_path / x)
    cli.main(["count", fa, "--k", "11", "--output", p("counts"), "--histogram", p("hist")], spark)
    assert lines(spark, p("hist"))[:1] == ["1\t0"] and spark.read.parquet(p("counts")).count() == 73
    cli.main(["build", "--reads", fa, "--k", "11", "--output", p("g"), "--fasta", "--colors"], spark)
    assert len([x for x in lines(spark, p("g.gfa")) if x.startswith("S")]) == 4
    cli.main(["sites", "--graph", p("g.gfa"), "--counts", p("counts"), "--low", "1", "--output", p("s")], spark)
    assert lines(spark, p("s_allele_frequency.txt")) == ["0.5", "0.5"]
    cli.main(["filter", "--input", p("s"), "--output", p("f"), "--low", "5", "--up", "500", "--simple"], spark)
    assert lines(spark, p("f_bicov.txt")) == lines(spark, p("s_bicov.txt")) != []
    cli.main(["filter", "--input", p("s"), "--output", p("none"), "--drop-snp"], spark)
    assert lines(spark, p("none_bicov.txt")) == []
    capsys.readouterr()
    cli.main(["model", "--frequencies", p("f_allele_frequency.txt"), "--upper", "4", "--output", p("m")], spark)
    assert capsys.readouterr().out.split() == ["2"]
    cli.main(["query", reads(tmp_path / "q.fa", ALT[5:60], "ACGT" * 10), "--graph", p("g.gfa"), "--output", p("q")], spark)
    assert {*lines(spark, p("q"))} == {"query_name\tpresence_query", "r0\t1", "r1\t0"}
    cli.main(["update", "--graph", p("g.gfa"), "--refs", reads(tmp_path / "t.fa", B[:35] + "G" + B[36:]), "--output", p("g2")], spark)
    assert len([x for x in lines(spark, p("g2.gfa")) if x.startswith("S")]) == 5


def test_bad_options(spark, tmp_path):
    with pytest.raises(SystemExit):
        cli.main(["model", "--frequencies", "x", "--output", "y", "--lower", "1"], spark)
    with pytest.raises(SystemExit):
        cli.main(["sites", "--graph"], spark)


def test_a_removed_branch_leaves_a_line(spark, tmp_path):
    d = spark.createDataFrame([(B,), (ALT,)], "seq string")
    g = ploidy.build(refs=d, k=11)
    gone = g["unitigs"].where("n_kmers = 11").orderBy("seq").limit(1)
    u = graph.unitigs(graph.remove(g["unitigs"], gone, 11), 11)
    assert [len(r.seq) for r in u.collect()] == [72]
