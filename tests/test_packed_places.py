"""Counts of a sequence's own k-mers, and minimizers, equal plain counting over parted blocks; strings are not exploded."""

from collections import Counter

import pytest

from strandloom.functions import kmers as km
from strandloom.operators import counts

COMP = str.maketrans("ACGT", "TGCA")
SEQS = ["ACGTTGCATGCCGATNACGTTGCATG", "ACGTTGCATGCCGATTACGAACGTTGCATGCC", "AC", None, "A" * 30, "NNNNNNNN"]


def canon(s):
    return min(s, s.translate(COMP)[::-1])


def kmers(s, k):
    return [(i + 1, canon(x)) for i in range(len(s or "") - k + 1) if set(x := s[i : i + k]) <= set("ACGT")]


@pytest.mark.parametrize("small", [False, True])
def test_own_coverage(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(counts, "BLOCK", 9)
    k = 7
    every = Counter(x for s in SEQS for _, x in kmers(s, k))
    want = {}
    for i, s in enumerate(SEQS):
        c = [(p, min(every[x], 5)) for p, x in kmers(s, k)]
        if c:
            n = [x for _, x in c]
            solid = [p for p, x in c if x >= 2]
            want[i] = (len(n), sum(n), min(n), max(n), len(solid), min(solid, default=None))
    got = counts.own_coverage(spark.createDataFrame(list(enumerate(SEQS)), "id bigint, seq string"), k, "id", 2, 5).collect()
    assert {r.id: tuple(r)[1:] for r in got} == want


def test_minimizer_counts(spark):
    k, g = 9, 4
    df = spark.createDataFrame(list(enumerate(SEQS)), "id bigint, seq string")
    want = Counter(min(canon(s[i + j : i + j + g]) for j in range(k - g + 1)) for s in SEQS for i in range(len(s or "") - k + 1) if set(s[i : i + k]) <= set("ACGT"))
    assert {r.minimizer: r.n for r in counts.minimizer_counts(df, k, g).collect()} == want
    x = km.with_kmers(df, k)
    rows = x.select(km.minimizer_place(x.kmer, g).alias("a"), km.minimizer_place(x.kmer, g, borders=False).alias("b")).collect()
    places = Counter((r.a.minimizer, r.a.place, r.b.place) for r in rows)
    assert {tuple(r)[:3]: r.n for r in counts.minimizer_counts(df, k, g, places=True).collect()} == places
