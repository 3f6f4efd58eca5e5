"""Bridges found in bins equal those of the joins of strings."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions.kmers import decode, encode
from strandloom.operators import graph

COMP = str.maketrans("ACGT", "TGCA")


@pytest.mark.parametrize("seed", [1, 2])
def test_packed_mercy_equals_strings(spark, seed):
    k, rnd = 9, random.Random(seed)
    canon = lambda x: min(x, x.translate(COMP)[::-1])
    s = "".join(rnd.choice("ACGT") for _ in range(1500))
    every = [canon(s[i : i + k]) for i in range(len(s) - k + 1)]
    weak = {every[i] for i in range(20, len(every), 30)} | {every[i] for i in range(40, 400, 7)}
    weak |= {canon(x[:-1] + b) for x in list(weak)[:30] for b in "ACGT"}
    solid = set(every) - weak
    df = lambda x: spark.createDataFrame([(v,) for v in sorted(x)], "kmer string")
    want = {r.kmer for r in graph.mercy(df(solid), df(weak), k).collect()}
    packed = lambda x: df(x).select(encode(F.col("kmer")).alias("code"))
    got = graph.mercy(packed(solid), packed(weak), k).select(decode(F.col("code"), k).alias("kmer")).collect()
    assert {r.kmer for r in got} == want and len(got) == len(want) and want
