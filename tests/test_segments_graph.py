"""Counts, colours, mercy k-mers and unitigs are made in the bins of ends from runs of bases: equal to plain ones, and no k-mer is shuffled by itself."""

import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandloom import registry
from strandloom.functions import kmers as km
from strandloom.operators import counts, graph, segments
from strandloom.session import cut, drop

COMP = str.maketrans("ACGT", "TGCA")
K, D = 9, "/root/testdata/sf0.001"
SEQS = [("a", "ACGTTGCATGCCGATTACGATCCAGT" * 2), ("b", "ACGTTGCATGCCGATNACGTTGCATG"), (None, "GCATGCCGATTACGATC"), ("b", "AC"), ("a", None), ("c", "A" * 40), (None, "TTTTTTTTTTTT")]


def canon(s):
    return min(s, s.translate(COMP)[::-1])


def kmers(s):
    return [canon(x) for i in range(len(s or "") - K + 1) if set(x := s[i : i + K]) <= set("ACGT")]


def reads(spark):
    return spark.createDataFrame(SEQS, "lang string, seq string")


def named(df):
    return df.withColumn("kmer", km.decode(F.col("code"), K)).collect()


def test_counted_and_colored(spark):
    want, colors = Counter(x for _, s in SEQS for x in kmers(s)), defaultdict(set)
    for c, s in SEQS:
        for x in kmers(s):
            colors[x].add(c)
    for least in (1, 2):
        rows = named(segments.counted(reads(spark), K, least, 20))
        assert sorted((r.kmer, r.cnt) for r in rows) == sorted((x, min(n, 20)) for x, n in want.items() if n >= least)
        rows = named(segments.colored(reads(spark), K, "lang", least))
        assert sorted((r.kmer, str(r.color)) for r in rows) == sorted((x, str(c)) for x, n in want.items() if n >= least for c in colors[x])
        assert sorted(r.kmer for r in rows if r.first) == sorted(x for x, n in want.items() if n >= least)


def test_graphs_of_reads(spark):
    whole, part = "ACGTTGCATGCCGATTACGATCCAGTTTGACCA", "CCGGATATTGGCAGAGTC"
    r = spark.createDataFrame([(whole[:15],)] * 2 + [(whole[14:],)] * 2 + [(whole,), (part,)], "seq string")  # seen once: what bridges the gap
    c = counts.packed_counts(r, K)
    for least in (1, 2):
        got, want = graph.unitigs_of_reads(r, K, least), graph.unitigs(c.where(F.col("cnt") >= least).select("code"), K)
        assert sorted(got.collect()) == sorted(want.collect())
    gap = spark.createDataFrame([("ACGTTGCATGCCG",)] * 2 + [("TTGCATGCCGATTACG",), ("CATGCCGATTACGTT",)] + [("GCCGATTACGTT",)], "seq string")
    for x in (r, gap):
        c = counts.packed_counts(x, K).select("code", (F.col("cnt") >= 2).cast("int").alias("solid"))
        assert sorted(graph.mercy_of_reads(x, K).collect()) == sorted(graph.mercy_marked(c, K).collect())


def test_cut_frees_what_is_done(spark, tmp_path):
    t = cut(spark.range(100).selectExpr("id", "id < 3 as open").repartition(4), "t", ("open",))
    assert t.where("open").count() == 3
    drop(t, "open=true")
    assert not os.path.exists(f"{t._cut_path.removeprefix('file://')}/open=true") and t.where("not open").count() == 97
    drop(t)
    assert not os.path.exists(t._cut_path.removeprefix("file://"))


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", ["unitig_colors", "covered_runs", "mercy_kmers"])
def test_no_kmer_is_shuffled_by_itself(spark, monkeypatch, name):
    def none(*_, **__):
        raise AssertionError("k-mers are counted one by one")

    monkeypatch.setattr(counts, "packed_counts", none)
    assert registry.queries()[name](spark, D) is not None
