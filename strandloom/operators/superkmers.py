"""Counting by super-k-mers: runs of k-mers of one minimizer are shuffled as one packed piece and counted where they arrive.

Where tasks meet few k-mers twice, as in large and varied data, combining in the task saves nothing and every k-mer would be shuffled as a row of its
own. A piece holds up to 63 - k k-mers in two numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions import kmers as km
from strandloom.operators import counts
from strandloom.session import cut, small

#: Bases in each of the two numbers of a piece.
HALF = 31
#: Bases in a minimizer at most, unless told: shorter ones make longer pieces, 4 ** 11 of them still spread.
MOST_G = 11
#: k-mers for which a partition is made, so that it counts them in memory, and partitions at most; beyond that they spill.
PART, MOST_PARTS = 1 << 21, 20_000


def _mixed(code: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of packed g-mers, so that minimizers are spread and not the alphabet's first ones."""
    h = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ h >> np.uint64(32)).astype(np.int64)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` values in a row, from windows of powers of two."""
    size = 1
    while 2 * size <= width:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return np.minimum(x[: len(x) - (width - size)], x[width - size :])


def runs(codes: np.ndarray, k: int, g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin (32 bits of the mixed minimizer), first place and number of k-mers of each piece of a row of bases (0 to 3; 4 breaks the row)."""
    if len(codes) < k:
        return (np.empty(0, np.int64),) * 3
    bad = np.concatenate([[0], np.cumsum(codes > 3, dtype=np.int32)])
    places = np.flatnonzero(bad[k:] == bad[:-k])
    least = _least(_mixed(np.minimum(*counts.windows(codes, g))), k - g + 1)[places]
    new = np.ones(len(places), bool)
    new[1:] = (places[1:] - places[:-1] != 1) | (least[1:] != least[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(places)))
    most = 2 * HALF - k + 1
    if (size > most).any():  # longer runs are parted
        within = np.arange(len(places)) - np.repeat(first, size)
        first = np.flatnonzero(within % most == 0)
        size = np.diff(np.append(first, len(places)))
    return least[first] >> 32 & 0xFFFFFFFF, places[first], size


def pieces(codes: np.ndarray, k: int, g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bin, first and second half and number of k-mers of each piece of a row of bases."""
    bins, at, n = runs(codes, k, g)
    if not len(n):
        return bins, at, at, n
    size = n + k - 1
    half, _ = counts.windows(np.concatenate([codes, np.zeros(2 * HALF, codes.dtype)]), HALF)
    # what stands behind the piece is no part of it
    first, second = 2 * np.maximum(HALF - size, 0), 2 * np.minimum(2 * HALF - size, HALF)
    return bins, half[at] >> first << first, half[at + HALF] >> second << second, n


def _canonical(code: np.ndarray, k: int) -> np.ndarray:
    """The smaller of packed k-mers and their reverse complements: pairs of bits are swapped by halves and complemented."""
    x = ~code.astype(np.uint64)
    for step, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        m = np.uint64(mask)
        x = x >> np.uint64(step) & m | (x & m) << np.uint64(step)
    return np.minimum(code, (x >> np.uint64(64 - 2 * k)).astype(np.int64))


def _dealt(codes: np.ndarray, k: int, g: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of a row of bases, those of hot bins as one canonical k-mer each, with a bin of the k-mer's own."""
    bins, hi, lo, n = pieces(codes, k, g)
    many = np.isin(bins, hot)
    if not many.any():
        return bins, hi, lo, n
    at = np.repeat(np.arange(len(n)), n * many)
    i = np.arange(len(at)) - np.repeat(np.cumsum(n * many) - n * many, n * many)
    x, y = hi[at], lo[at]
    here = np.where(i < HALF, x << 2 * np.minimum(i, HALF) & (1 << 2 * HALF) - 1 | y >> 2 * np.maximum(HALF - i, 0), y << 2 * np.maximum(i - HALF, 0) & (1 << 2 * HALF) - 1)
    code = _canonical(here >> 2 * (HALF - k), k)
    one = np.ones(len(code), np.int64)
    alone = (_mixed(code) >> 32 & 0xFFFFFFFF, code << 2 * (HALF - k), 0 * one, one)
    return tuple(np.concatenate([old[~many], new]) for old, new in zip((bins, hi, lo, n), alone, strict=True))


def _free(by: tuple[str, ...]) -> None:
    if clash := {"bin", "hi", "lo", "n", "cnt", "code"} & set(by):
        raise ValueError(f"columns of this operator's own names: {sorted(clash)}")


def _gathered(reads: DataFrame, k: int, by: tuple[str, ...], seq: str, names: tuple[str, ...], work) -> DataFrame:
    """by, names, cnt: the rows that work makes of blocks of bases, equal ones of what a task gathers counted."""
    _free(by)
    schema = T.StructType([*(reads.schema[c] for c in by), *(T.StructField(c, T.LongType()) for c in (*names, "cnt"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple]] = {}
        kinds, size = [], 0

        def part() -> Iterator[pa.RecordBatch]:
            for key, found in held.items():
                cols = [np.concatenate(c) for c in zip(*found, strict=True)]
                mark = cols[0].copy()  # equal rows stand together, rows of other values between them only mean that less is combined
                for c in cols[1:]:
                    mark = mark * -0x61C8864680B583EB + c
                order = np.argsort(cols[0] << 32 | mark >> 32 & 0xFFFFFFFF)
                cols = [c[order] for c in cols]
                new = np.ones(len(order), bool)
                new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
                first = np.flatnonzero(new)
                cnt = np.diff(np.append(first, len(order)))
                yield pa.RecordBatch.from_arrays([*(pa.array([v] * len(first), t) for v, t in zip(key, kinds, strict=True)), *(pa.array(c[first]) for c in cols), pa.array(cnt)], names=[*by, *names, "cnt"])

        for b in batches:
            kinds = [b.column(c).type for c in by]
            texts: dict[tuple, list[bytes]] = {}
            for *key, s in zip(*(b.column(c).to_pylist() for c in (*by, seq)), strict=True):
                if s is not None and len(s) >= k:
                    texts.setdefault(tuple(key), []).append(s.encode("ascii", "replace"))
            for key, found in texts.items():
                codes = counts.codes(b"-".join(found))
                for at in range(0, len(codes), counts.BLOCK):
                    got = work(codes[at : at + counts.BLOCK + k - 1])
                    held.setdefault(key, []).append(got)
                    size += len(got[0])
                    if size > counts.GATHERED:
                        yield from part()
                        held, size = {}, 0
        yield from part()

    return reads.select(*by, seq).mapInArrow(run, schema)


def _bases(k: int, g: int | None) -> int:
    g = g or max(1, min(km.minimizer_length(k), MOST_G))
    if not 0 < g <= k <= HALF:
        raise ValueError(f"minimizers of {g} bases in k-mers of {k}: 1 to k, and k is {HALF} at most")
    return g


def super_kmers(reads: DataFrame, k: int, by: tuple[str, ...] = (), g: int | None = None, seq: str = "seq", hot: tuple[int, ...] = ()) -> DataFrame:
    """by, bin, hi, lo, n, cnt: the pieces of the sequences. bin is 32 bits of the mixed minimizer of g bases (`minimizer_length`, MOST_G at most), n the
    number of k-mers in a piece, cnt how often a task met it in what it gathered. The k-mers of hot bins are pieces of their own. k is 31 at most. Null
    and short sequences have none, other letters break them."""
    g, hot = _bases(k, g), np.array(hot, np.int64)
    return _gathered(reads, k, by, seq, ("bin", "hi", "lo", "n"), lambda codes: _dealt(codes, k, g, hot))


def hot_bins(reads: DataFrame, k: int, g: int | None = None, parts: int = 200, seq: str = "seq") -> tuple[tuple[int, ...], int]:
    """How many partitions the k-mers are worth (`parts` or more, one for PART k-mers, MOST_PARTS at most), and the bins that have more than one's share of
    all pieces: fewer than there are partitions, whatever the input."""
    g = _bases(k, g)
    size = cut(_gathered(reads, k, (), seq, ("bin", "n"), lambda codes: runs(codes, k, g)[::2]).groupBy("bin").agg(F.sum("cnt").alias("size"), F.sum(F.col("cnt") * F.col("n")).alias("n")), "bins")
    total = size.agg(F.sum("size").alias("size"), F.sum("n").alias("n")).first()
    parts = max(parts, min(MOST_PARTS, (total.n or 0) // PART))
    return tuple(sorted(r.bin for r in size.where(F.col("size") * parts > (total.size or 0)).select("bin").collect())), parts


def unpacked(p: DataFrame, k: int, keep: tuple[str, ...]) -> DataFrame:
    """keep, code, cnt: a row for each k-mer of each piece, on its smaller strand; all in the JVM."""
    at = F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1))
    x = p.select(*keep, "hi", "lo", "cnt", at.alias("_at"))
    mask = F.lit((1 << 2 * HALF) - 1).cast("long")
    shift = lambda name, c, by: F.call_function(name, F.col(c), by)
    both = shift("shiftleft", "hi", 2 * F.col("_at")).bitwiseAND(mask).bitwiseOR(shift("shiftrightunsigned", "lo", 2 * (HALF - F.col("_at"))))
    # the 31 bases from _at on, of which the first k are the k-mer
    here = F.when(F.col("_at") < HALF, both).otherwise(shift("shiftleft", "lo", 2 * (F.col("_at") - HALF)).bitwiseAND(mask))
    x = x.select(*keep, "cnt", F.shiftrightunsigned(here, 2 * (HALF - k)).alias("_f"))
    return x.select(*keep, F.least("_f", km.packed_revcomp(F.col("_f"), k)).alias("code"), "cnt")


def super_kmer_counts(reads: DataFrame, k: int, by: tuple[str, ...] = (), g: int | None = None, parts: int | None = None) -> DataFrame:
    """by, code, cnt: what `counts.packed_counts` gives, by shuffling pieces by their minimizers.

    All k-mers of a bin arrive in one partition and are counted there, spilling, without a second shuffle. A first pass counts the pieces of every
    bin; the k-mers of bins that would fill a partition are dealt one by one, combined in tasks.
    """
    parts = parts or int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot, parts = hot_bins(reads, k, g, parts)
    count = lambda r, c: unpacked(super_kmers(r, k, c, g, hot=hot).repartition(parts, "bin"), k, ("bin", *c)).groupBy("bin", *c, "code").agg(F.sum("cnt").alias("cnt"))
    if not by:
        return count(reads, ()).select("code", "cnt")
    _free(by)
    # samples are counted under numbers, as keys of three numbers take half the time of keys with texts
    named = cut(reads.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by))).distinct().select("*", F.monotonically_increasing_id().alias("_sample")), "samples")
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)))
    x = count(reads.select(*by, "seq").join(small(named), same).select("_sample", "seq"), ("_sample",))
    return x.join(small(named), "_sample").select(*(F.col(f"_by{i}").alias(c) for i, c in enumerate(by)), "code", "cnt")
