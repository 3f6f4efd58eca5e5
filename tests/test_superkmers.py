"""Super-k-mers: the same counts as the string way, hot minimizers, one shuffle, and what it moves."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import counts, superkmers
from tests.test_packed_and_sites import plain


def named(rows, k):
    return {"".join("ACGT"[r.code >> 2 * i & 3] for i in range(k - 1, -1, -1)): r.cnt for r in rows}


@pytest.mark.parametrize("k", [1, 2, 5, 11, 16, 25, 31])
@pytest.mark.parametrize("small", [False, True])
def test_counts_equal_strings(spark, monkeypatch, k, small):
    if small:
        monkeypatch.setattr(counts, "BLOCK", 40)
        monkeypatch.setattr(counts, "GATHERED", 10)
    rng = random.Random(k)
    seqs = ["".join(rng.choice("ACGTacgtNé"[: rng.choice((4, 8, 9))]) for _ in range(rng.randint(0, 150))) for _ in range(40)]
    seqs += [None, "", "A" * 300, "ACGT" * 60, "C" * k, seqs[0], seqs[0]]
    df = spark.createDataFrame([(s, i % 3 or None, i) for i, s in enumerate(seqs)], "seq string, part int, bin int").repartition(3)
    assert named(superkmers.super_kmer_counts(df, k, parts=3).collect(), k) == plain(seqs, k)
    rows = superkmers.super_kmer_counts(df, k, ("part",), g=1, parts=5).collect()
    assert len(rows) == len({(r.part, r.code) for r in rows})
    for part in (None, 1, 2):
        assert named([r for r in rows if r.part == part], k) == plain([s for i, s in enumerate(seqs) if (i % 3 or None) == part], k)


def test_pieces_hold_runs_of_one_minimizer():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 4, 5000).astype(np.uint8)
    codes[[100, 2000, 2001]] = 4
    k, g = 21, 9
    bins, _, _, n = superkmers.pieces(codes, k, g)
    good = sum((codes[i : i + k] < 4).all() for i in range(len(codes) - k + 1))
    assert n.sum() == good and n.max() <= 63 - k
    assert len(n) < good / 5  # about (k - g + 2) / 2 k-mers each
    mirrored = np.where(codes < 4, 3 - codes, 4)[::-1]
    assert set(bins) == set(superkmers.pieces(mirrored.astype(np.uint8), k, g)[0])


def test_hot_bins_are_few_and_dealt_one_by_one(spark):
    rng = random.Random(8)
    seqs = ["A" * 900] * 20 + ["".join(rng.choice("ACGT") for _ in range(300)) for _ in range(30)]
    df = spark.createDataFrame([(s,) for s in seqs], "seq string").repartition(3)
    hot, parts = superkmers.hot_bins(df, 21, 9, 4)
    assert parts == 4
    assert 0 < len(hot) < 4
    p = superkmers.super_kmers(df, 21, g=9, hot=hot)
    assert p.where(F.col("bin").isin(*hot) & (F.col("n") > 1)).count() == 0
    for parts in (2, 4, 200):  # none, some, nearly all bins are hot
        assert named(superkmers.super_kmer_counts(df, 21, g=9, parts=parts).collect(), 21) == plain(seqs, 21)


def test_empty_and_wrong(spark):
    none = spark.createDataFrame([], "seq string")
    assert superkmers.super_kmer_counts(none, 21).collect() == []
    for k, g in ((32, 9), (9, 10)):
        with pytest.raises(ValueError):
            superkmers.super_kmers(none, k, g=g)
    with pytest.raises(ValueError):
        superkmers.super_kmers(spark.createDataFrame([], "seq string, bin int"), 21, ("bin",))


def test_one_shuffle_of_pieces_and_a_third_of_the_bytes(spark):
    rng = np.random.default_rng(5)
    seqs = ["".join(np.array(list("ACGT"))[rng.integers(0, 4, 2000)]) for _ in range(100)]
    df = spark.createDataFrame([(s,) for s in seqs], "seq string").repartition(4)
    p = superkmers.super_kmers(df, 25)
    n_pieces, n_kmers = p.count(), counts.packed_counts(df, 25).count()
    assert n_pieces * 48 * 3 <= n_kmers * 24  # widths of rows: six numbers and three, with the bits of nulls
    even = superkmers.unpacked(p.repartition(8, "bin"), 25, ("bin",)).groupBy("bin", "code").agg(F.sum("cnt"))
    assert even._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") + even._jdf.queryExecution().executedPlan().toString().count("Exchange (") == 1
