"""A graph updated in place equals the one built anew."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import graph
from strandloom.session import cut

K = 9


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def kmers(reads):
    return {min(r[i : i + K], rc(r[i : i + K])) for r in reads for i in range(len(r) - K + 1)}


def table(spark, ks):
    return spark.createDataFrame([(x,) for x in sorted(ks)], "kmer string")


def build(spark, ks):
    return cut(graph.with_ids(graph.unitigs(table(spark, ks), K)))


def rows(u):
    """Sequences, cycles as their k-mers since they may be cut elsewhere."""
    return sorted(((" ".join(sorted(kmers([r.seq]))) if r.circular else min(r.seq, rc(r.seq))), r.n_kmers) for r in u.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_added_and_removed(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ACGT") for _ in range(rng.randint(20, 160))) for _ in range(30)]
    base += [base[0][:40] + base[1][20:60], "ACGGTCATTGCAGGATC" * 2, "ACACACACACACACAC"]
    more = [base[2][5:40] + "G" + base[2][41:80], base[3][-12:] + base[4][:12], base[5][10:40], "GGTCATTGCTTTT", "".join(rng.choice("ACGT") for _ in range(50))]
    old, new = kmers(base), kmers(more)
    u = build(spark, old)
    got = cut(graph.updated(u, K, table(spark, new)))
    assert rows(got) == rows(build(spark, old | new))
    before = {r.unitig_id: r.seq for r in u.collect()}
    kept = {r.unitig_id: r.seq for r in got.where("old").collect()}
    assert kept.items() <= before.items() and 0 < len(kept) < len(before)  # touched rows only are made anew
    ids = [r.unitig_id for r in got.collect()]
    assert len(set(ids)) == len(ids) and all(i > max(before) for i in set(ids) - set(kept))

    gone = [r.unitig_id for r in u.orderBy(F.xxhash64("seq")).limit(6).collect()]
    lost = kmers([before[i] for i in gone])
    gone = spark.createDataFrame([(i,) for i in gone], "unitig_id long")
    assert rows(graph.updated(u, K, gone=gone)) == rows(build(spark, old - lost))
    assert rows(graph.updated(u, K, table(spark, new), gone)) == rows(build(spark, (old - lost) | new))


def test_nothing_new_and_nothing_there(spark):
    u = build(spark, kmers(["ACGGTCATTGCAGGATCTTA"]))
    assert [r.old for r in graph.updated(u, K, table(spark, kmers(["GGTCATTGCAGG"]))).collect()] == [True]
    assert rows(graph.updated(u.limit(0), K, table(spark, kmers(["GGTCATTGCAGG"])))) == [("CCTGCAATGACC", 4)]
    with pytest.raises(ValueError):
        graph.updated(u, K)
