"""Reads dealt to the bins of junctions: runs of bases whose (k-1)-mers have one bin are shuffled as two bits a base, and k-mers are counted in the bin.

All occurrences of a k-mer come to the bin of each of its ends, so a bin knows how often it occurs, and all k-mers that meet at its own ends. That is one
shuffle of about a byte a k-mer, where counting first and dealing the counted ones to their ends takes two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from strandloom.operators import counts, packed
from strandloom.operators.superkmers import _least

#: Bases that a task gathers before it deals them; bits of a bin's number at least.
GATHERED, LEAST_BITS = 1 << 21, 9
#: A bin with so many times its share of what was gathered, and so many k-mers at least, gets them counted.
HOT, HOT_LEAST = 8, 4096


def runs(codes: np.ndarray, k: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, first place and number of bases of each run of a row of bases (0 to 3; 4 breaks the row): all k-mers with an end among the run's (k-1)-mers."""
    if len(codes) < k:
        return (np.empty(0, np.int64),) * 3
    g = min(packed.MOST_G, (k - 1) // 2)
    every = np.arange(1 << 2 * g, dtype=np.int64)
    rank = packed.mixed(np.minimum(every, packed.revcomp(every, g)), g)
    bad = np.concatenate([[0], np.cumsum(codes > 3)])
    places = np.flatnonzero(bad[k - 1 :] == bad[: -(k - 1)])
    if not len(places):
        return (np.empty(0, np.int64),) * 3
    bins = packed.bin_of(_least(rank[counts.windows(codes, g)[0]], k - g)[places], bits)
    new = np.ones(len(places), bool)
    new[1:] = (np.diff(places) != 1) | (bins[1:] != bins[:-1])
    first = np.flatnonzero(new)
    a, z = places[first], places[np.append(first[1:], len(places)) - 1] + k - 1
    good = np.append(codes < 4, False)  # the last stands before the first base and behind the last
    a, z = a - good[a - 1], z + good[z]
    keep = z - a >= k
    return bins[first][keep].astype(np.int64), a[keep], (z - a)[keep]


def spelled(codes: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bases of runs, one after another."""
    return codes[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def kmers_of(codes: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """The packed canonical k-mers of runs that stand one after another."""
    n = size - k + 1
    at = np.repeat(np.cumsum(size) - size - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.minimum(*(x[at] for x in counts.windows(codes, k)))


def shut(codes: np.ndarray) -> bytes:
    """Four bases a byte."""
    x = np.append(codes, np.zeros(-len(codes) % 4, np.uint8)).reshape(-1, 4)
    return (x[:, 0] << 6 | x[:, 1] << 4 | x[:, 2] << 2 | x[:, 3]).astype(np.uint8).tobytes()


def opened(data: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(data, np.uint8)
    return np.stack([x >> s & 3 for s in (6, 4, 2, 0)], 1).ravel()[:n]


def at_junctions(reads: DataFrame, k: int, least: int, work, schema: str | T.StructType, seq: str = "seq", by: str | None = None) -> DataFrame:
    """What work(bin, bits, codes, counts) gives, a list of arrays, as `packed.at_junctions` of the k-mers that occur `least` times or more in the sequences. by: a
    column of the reads; work also gets its values in the bin and, for each, the places in codes of the k-mers that occur with it."""
    bits = max(LEAST_BITS, packed.bin_bits(reads.sparkSession, 15) + 1)
    names, kinds = ["_bin", "_n", "_size", "_bases", "_cnt"], (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    keys = (by,) if by else ()
    dealt = T.StructType([*(T.StructField("_by", reads.schema[c].dataType) for c in keys), *(T.StructField(c, t) for c, t in zip(names, (T.IntegerType(), T.IntegerType(), T.BinaryType(), T.BinaryType(), T.BinaryType()), strict=True))])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        size, types = 0, []

        def part(key: tuple, found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            codes = np.concatenate(found)
            bins, at, size = runs(codes, k, bits)
            order = np.argsort(bins, kind="stable")
            bins, size, codes = bins[order], size[order], spelled(codes, at[order], size[order])
            edge = np.searchsorted(bins, np.arange((1 << bits) + 1))
            base = np.append(0, np.cumsum(size))
            n = base[edge[1:]] - base[edge[:-1]] - (k - 1) * np.diff(edge)
            hot = max(HOT_LEAST, HOT * n.sum() >> bits)
            rows = []
            for b in np.flatnonzero(n).tolist():
                i, j = edge[b], edge[b + 1]
                s, c = size[i:j], codes[base[i] : base[j]]
                if n[b] > hot:  # a repeat comes once
                    code, cnt = packed.tally(kmers_of(c, s, k))
                    rows.append((b, len(code), None, packed.rising(code), packed.squeezed(cnt)))
                else:
                    rows.append((b, int(j - i), packed.squeezed(s), shut(c), None))
            if rows:
                yield pa.RecordBatch.from_arrays([*(pa.array([v] * len(rows), t) for v, t in zip(key, types, strict=True)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=dealt.names)

        for key, types, codes in counts._blocks(batches, k, keys, seq):
            held.setdefault(key, []).extend([codes, np.full(1, 4, np.uint8)])
            size += len(codes)
            if size > GATHERED:
                for x in held.items():
                    yield from part(*x)
                held, size = {}, 0
        for x in held.items():
            yield from part(*x)

    def gathered(rows: Iterator[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """The k-mers of rows and how often they occur."""
        code, cnt, some, sizes = [], [], [], []

        def part() -> None:
            if some:
                code.append(kmers_of(np.concatenate(some), np.concatenate(sizes), k))
                cnt.append(np.ones(len(code[-1]), np.int64))
                some.clear()
                sizes.clear()

        for n, size, bases, count in rows:
            if count is not None:
                code.append(packed.risen(bases, n))
                cnt.append(packed.opened(count, n))
                continue
            sizes.append(packed.opened(size, n))
            some.append(opened(bases, int(sizes[-1].sum())))
            if sum(map(len, some)) > counts.BLOCK:
                part()
        part()
        return packed.tally(np.concatenate(code), np.concatenate(cnt))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        c = packed.columns(got, (*dealt.names[:-5], *names[1:]))
        rows = list(zip(*(c[x] for x in names[1:]), strict=True))
        if by:
            values = sorted(set(c["_by"]), key=lambda v: (v is not None, v))
            each = [gathered(r for r, v in zip(rows, c["_by"], strict=True) if v == value) for value in values]
            x, n = packed.tally(*(np.concatenate(y) for y in zip(*each, strict=True)))
        else:
            x, n = gathered(iter(rows))
        x, n = x[n >= least], n[n >= least]
        if len(x):
            more = (values, [np.flatnonzero(np.isin(x, y, assume_unique=True)) for y, _ in each]) if by else ()
            yield from packed.sliced(work(got[0].column("_bin")[0].as_py(), bits, x, n, *more), out.names)

    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return reads.select(*keys, seq).mapInArrow(deal, dealt).groupBy("_bin").applyInArrow(run, out)


def owned(b: int, bits: int, code: np.ndarray, k: int) -> np.ndarray:
    """Which of a bin's k-mers are its own: each k-mer is of one bin, that of its first k-1 bases."""
    return packed.junction_bins(code, k, bits)[0] == b


def counted(reads: DataFrame, k: int, least: int = 1, most: int = counts.MOST_COUNT) -> DataFrame:
    """code, cnt: what `counts.packed_counts` gives of k-mers that occur `least` times or more, saturated at `most`, after a shuffle of about a byte a k-mer."""

    def work(b: int, bits: int, code: np.ndarray, n: np.ndarray) -> list[pa.Array]:
        mine = owned(b, bits, code, k)
        return [pa.array(code[mine]), pa.array(np.minimum(n[mine], most))]

    return at_junctions(reads, k, least, work, "code bigint, cnt bigint")


def colored(reads: DataFrame, k: int, color: str, least: int = 1) -> DataFrame:
    """code, color, first: the different colours of the k-mers that occur `least` times or more over all colours. first: once true for each k-mer."""

    def work(b: int, bits: int, code: np.ndarray, _: np.ndarray, values: list, places: list[np.ndarray]) -> list[pa.Array]:
        mine, new = owned(b, bits, code, k), np.ones(len(code), bool)
        parts = []
        for v, at in zip(values, places, strict=True):
            at = at[mine[at]]
            parts.append((code[at], v, new[at].copy()))
            new[at] = False
        codes, first = (np.concatenate([p[i] for p in parts]) for i in (0, 2))
        which = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        return [pa.array(codes), pa.array(values, kind).take(pa.array(which)), pa.array(first)]

    field = T.StructField("color", reads.schema[color].dataType)
    kind = to_arrow_type(field.dataType)
    return at_junctions(reads, k, least, work, T.StructType([T.StructField("code", T.LongType()), field, T.StructField("first", T.BooleanType())]), by=color)
