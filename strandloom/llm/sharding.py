"""Two-pass external shuffle into shards.

Pass 1 scatters records by seeded hashes into memory-sized buckets of a shard; pass 2 shuffles each bucket by
Fisher-Yates and writes it. The law is `key`: the shard of a record is the one with the largest seeded hash of
(doc_id, shard), so that one more shard takes records only into itself.

Records stay in the JVM: they are numbered in their bucket, in the order of their hashes, by a sort that spills.
Python permutes only those numbers, at most PIECE of them at a time, and the permuted slots are dealt to the same
bucket as rows of their own, so the records move once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, load, written

SHARDS, SEED = 24, 7
#: Bytes of text that a bucket is meant to hold.
BUCKET_BYTES = 8_000_000
#: Most numbers of a bucket that are permuted at once; only very short or equal records reach it.
PIECE = 1_000_000


def shard_of(key: Column, n: int) -> Column:
    """Rendezvous hashing of key over n shards."""
    best = F.array_max(F.array(*[F.struct(F.xxhash64(F.lit(SEED), F.lit(s), key).alias("h"), F.lit(s).alias("s")) for s in range(n)]))
    return best["s"]


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A permutation of 0..n-1: place i swaps with one of the places up to i."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.arange(n)
    picks = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64)
    for i in range(n - 1, 0, -1):
        j = picks[i]
        out[i], out[j] = out[j], out[i]
    return out


def permuted(counts: DataFrame, seed: int, piece: int = PIECE) -> DataFrame:
    """bucket, place, slot: the places 1 to n of each bucket (bucket, base, n) and their slots, from base on, permuted by
    Fisher-Yates. A bucket of more than `piece` places is cut into pieces of them, each permuted by itself."""
    pieces = counts.select("bucket", "base", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(piece).cast("long"))).alias("first"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for bucket, base, n, first in zip(pdf["bucket"], pdf["base"], pdf["n"], pdf["first"], strict=True):
                size = min(piece, n - first)
                rng_seed = (seed << 64) + (int(bucket) << 32) + int(first // piece)
                slots = base + first + fisher_yates(size, rng_seed)
                for at in range(0, size, 100_000):
                    part = slots[at : at + 100_000]
                    yield pd.DataFrame({"bucket": np.full(len(part), bucket), "place": first + at + 1 + np.arange(len(part)), "slot": part})

    return pieces.mapInPandas(run, "bucket long, place long, slot long")


def shuffled(docs: DataFrame, n_shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED, piece: int = PIECE) -> DataFrame:
    """docs with size (UTF-8 bytes of the text plus 8), shard and slot: a random, repeatable order, slots gapless from 0 in every shard.

    Null texts have no bytes, null ids have one shard. Repeated rows are records of their own; rows that are
    equal in id and text are interchangeable. Columns named size, shard or slot (in any case) are replaced, others stay.
    All rows of one id share a shard by law; within it they are dealt to buckets by text as well. Rows that are equal in
    both share a bucket, whose sort spills. An empty table gives an empty result.
    """
    keep = [c for c in docs.columns if c.lower() not in ("size", "shard", "slot")]
    deal, bucket, place, kind = free_names(docs, "_deal", "_bucket", "_place", "_kind")
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(*keep).withColumn("size", (F.octet_length(text) + 8).cast("long")).withColumn("shard", shard_of(F.col("doc_id"), n_shards))
    d = d.withColumn(deal, F.xxhash64(F.lit(seed + 1), "doc_id", text))
    slim = written(d.select("shard", F.col(deal).alias("deal"), "size"), "shard-deal")
    total = slim.agg(F.sum("size")).first()[0] or 0
    subs = max(1, -(-total // (n_shards * bucket_bytes)))
    in_bucket = lambda h: F.col("shard") * F.lit(subs).cast("long") + F.pmod(h, F.lit(subs))
    counts = slim.groupBy(in_bucket(F.col("deal")).alias("bucket"), "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("bucket", "n", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base"))
    slots = permuted(counts, seed, piece).select(F.col("bucket").alias(bucket), F.col("place").alias(deal), "slot", F.lit(0).alias(kind))
    d = d.withColumn(bucket, in_bucket(F.col(deal))).withColumn(kind, F.lit(1)).unionByName(slots, allowMissingColumns=True)
    # records are numbered by hash, slots by place; then each record takes the slot of its number
    numbers = Window.partitionBy(bucket, kind).orderBy(deal)
    pairs = Window.partitionBy(bucket).orderBy(place, kind)
    d = d.repartition(bucket).withColumn(place, F.row_number().over(numbers)).withColumn("slot", F.lag("slot").over(pairs))
    return d.where(F.col(kind) == 1).select(*keep, "size", "shard", "slot")


def op10_sharding(spark, sf_dir):
    d = shuffled(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).cast("long").alias("text_crc32"), F.lit("key").alias("law"),
        "shard", "slot", shard_of(F.col("doc_id"), SHARDS + 1).alias("grown_shard"),
    )
