"""Reads dealt to bins of junctions as runs of bases: degrees and steps equal those of counted k-mers, and little is dealt."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions.kmers import decode
from strandloom.operators import counts, graph, segments


def reads(spark):
    rnd = random.Random(3)
    some = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    a = some(3000)
    seqs = [a, a[500:1500] + some(300), a[:700][::-1].translate(str.maketrans("ACGT", "TGCA")), "A" * 2000, "ACG" * 300, a[900:1000] + "N" + a[950:1400], "ACGT", None, "N" * 40]
    return spark.createDataFrame([(s,) for s in seqs], "seq string")


@pytest.mark.parametrize("k", [5, 11, 25, 31])
@pytest.mark.parametrize("small", [False, True])
def test_degrees_and_steps_of_reads(spark, monkeypatch, k, small):
    monkeypatch.setattr(segments, "LEAST_BITS", 3)
    if small:
        for name, value in (("GATHERED", 500), ("HOT", 1), ("HOT_LEAST", 20)):
            monkeypatch.setattr(segments, name, value)
    r = reads(spark)
    solid = counts.packed_counts(r, k, least=2).select(decode(F.col("code"), k).alias("kmer"))
    want = sorted(graph.degrees(solid, k).collect())
    assert sorted(graph.degrees_of_reads(r, k).collect()) == want and want
    tips = graph.degrees_of_reads(r, k, keep=lambda out, into: (out == 0) != (into == 0)).collect()
    assert sorted(tips) == [x for x in want if (x.out_deg == 0) != (x.in_deg == 0)]
    assert sorted(graph.steps_of_reads(r, k).collect()) == sorted(graph.steps(solid, k).collect())


def test_runs_are_small():
    codes = np.random.default_rng(1).integers(0, 4, 1_000_000).astype(np.uint8)
    bins, at, size = segments.runs(codes, 25, 9)
    x = segments.spelled(codes, at, size)
    assert np.array_equal(segments.opened(segments.shut(x), len(x)), x)
    assert len(segments.shut(x)) + len(size) < 1.5 * len(codes)  # bytes a k-mer; as sorted numbers about four
