"""k-mers that are asked for are looked up in the tasks: counts and presence equal plain ones, and no other k-mer leaves a task."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandloom.functions import kmers as km
from strandloom.operators import counts, search

COMP = str.maketrans("ACGT", "TGCA")
SEQS = ["ACGTTGCATGCCGATNACGTTGCATG", "ACGTTGCATGCCGATTACGAACGTTGCATGCC", "AC", None, "A" * 30, "NNNNNNNN"]
K = 7


def canon(s):
    return min(s, s.translate(COMP)[::-1])


def kmers(s):
    return [canon(x) for i in range(len(s or "") - K + 1) if set(x := s[i : i + K]) <= set("ACGT")]


def reads(spark):
    return spark.createDataFrame([(i % 2, s) for i, s in enumerate(SEQS)], "lang bigint, seq string")


@pytest.mark.parametrize("most", [1 << 23, 2])
def test_asked_counts(spark, monkeypatch, most):
    monkeypatch.setattr(counts, "ASKED", most)
    asked = spark.createDataFrame([(x,) for x in (*sorted(set(kmers(SEQS[1]))), "CCCCCCC", "AAAAAAA")], "kmer string").select(km.encode(F.col("kmer")).alias("code"))
    want = Counter((i % 2, x) for i, s in enumerate(SEQS) for x in kmers(s) if x in {*kmers(SEQS[1]), "AAAAAAA"})
    got = counts.asked_counts(reads(spark), K, asked.union(asked), ("lang",)).select("lang", km.decode(F.col("code"), K).alias("kmer"), "cnt").collect()
    assert {(r.lang, r.kmer): r.cnt for r in got} == want and len(got) == len(want)
    assert counts.asked_counts(reads(spark), K, asked.limit(0)).count() == 0


def test_queries_ask(spark):
    q = spark.createDataFrame([(1, SEQS[1]), (2, "ACGTTGCAAAA"), (3, "ACG")], "id bigint, seq string")
    of = lambda *by: lambda asked: counts.asked_counts(reads(spark), K, asked, by)
    every = Counter(x for s in SEQS for x in kmers(s))
    got = counts.read_counters(q, of(), K, "id").collect()
    assert sorted((r.id, r.pos, r.cnt) for r in got) == sorted((i, p + 1, every[x]) for i, s in ((1, SEQS[1]), (2, "ACGTTGCAAAA")) for p, x in enumerate(kmers(s)))
    plain = counts.packed_counts(reads(spark), K, ("lang",))
    for edits in ({}, {"sub": True, "ins": True, "dele": True}):
        assert sorted(search.presence(q, of(), K, 0.8, "id", **edits).collect()) == sorted(search.presence(q, plain, K, 0.8, "id", **edits).collect())
    assert sorted(search.presence_by_color(q, of("lang"), K, 0.8, "id", [0, 1], "lang").collect()) == sorted(search.presence_by_color(q, plain, K, 0.8, "id", [0, 1], "lang").collect())
