"""k-mer counts, histograms, cut-offs, lookups and colours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions.kmers import canonical, decode, encode, with_kmers
from strandloom.operators import packed
from strandloom.session import cut, small

MOST_COUNT = 10_000


#: Bases that are packed at once, and k-mers that a task gathers before it counts and hands them on.
BLOCK, GATHERED = 1 << 20, 1 << 21
_CODES = np.full(256, 4, np.uint8)
_CODES[np.frombuffer(b"ACGTacgt", np.uint8)] = [0, 1, 2, 3] * 2


def codes(text: bytes) -> np.ndarray:
    """Bases as 0 to 3, other letters as 4."""
    return _CODES[np.frombuffer(text, np.uint8)]


def windows(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Every k bases in a row (letters count as 0 to 3) and their reverse complements, as numbers of two bits a base; k is 31 at most.

    Windows of k bases are put together from windows of powers of two, so a k-mer takes about 2 log k steps over whole arrays.
    """
    n = len(codes) - k + 1
    f = (codes & 3).astype(np.int64)
    r, size, parts = 3 - f, 1, []
    for bit in range(k.bit_length()):
        if k >> bit & 1:
            parts.append((size, f, r))
        if 2 * size <= k:
            f, r = f[:-size] << 2 * size | f[size:], r[size:] << 2 * size | r[:-size]
            size *= 2
    fwd, rev, at = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    for size, f, r in parts:
        fwd, rev, at = fwd << 2 * size | f[at : at + n], rev | r[at : at + n] << 2 * at, at + size
    return fwd, rev


def pack(codes: np.ndarray, k: int) -> np.ndarray:
    """Canonical k-mers of a row of bases (0 to 3; 4 breaks the row) as numbers of two bits a base, in order; k is 31 at most."""
    if len(codes) < k:
        return np.empty(0, np.int64)
    bad = np.concatenate([[0], np.cumsum(codes > 3)])
    return np.minimum(*windows(codes, k))[bad[k:] == bad[:-k]]


def _blocks(batches: Iterator[pa.RecordBatch], k: int, by: tuple[str, ...], seq: str) -> Iterator[tuple[tuple, list, np.ndarray]]:
    """key, types of the key's columns and bases of each block of the sequences of one key; sequences are parted by a letter that is no base."""
    for b in batches:
        kinds = [b.column(c).type for c in by]
        texts: dict[tuple, list[bytes]] = {}
        for *key, s in zip(*(b.column(c).to_pylist() for c in (*by, seq)), strict=True):
            if s is not None and len(s) >= k:
                texts.setdefault(tuple(key), []).append(s.encode("ascii", "replace"))
        for key, found in texts.items():
            codes = _CODES[np.frombuffer(b"-".join(found), np.uint8)]
            for at in range(0, len(codes), BLOCK):
                yield key, kinds, codes[at : at + BLOCK + k - 1]


def packed_counts(reads: DataFrame, k: int, by: tuple[str, ...] = (), seq: str = "seq", least: int = 1) -> DataFrame:
    """by, code, cnt: the canonical k-mers of seq as `kmers.encode` numbers them, and how often they occur, `least` times or more.

    Tasks pack bases and count what they gathered with numpy, and hand it on in bins (`packed`), which are counted where they arrive: one shuffle of 2 to
    4 bytes a different k-mer of what was gathered. Sequences are packed in blocks, so a long one takes no more memory. Null sequences have no k-mers,
    other letters than A, C, G, T break them.
    """
    if clash := {"_bin", "_n", "_code", "_cnt"} & set(by):
        raise ValueError(f"columns of this operator's own names: {sorted(clash)}")
    keys = [reads.schema[c] for c in by]
    bits = packed.bin_bits(reads.sparkSession, k)
    dealt = T.StructType([*keys, *(T.StructField(c, t) for c, t in (("_bin", T.IntegerType()), ("_n", T.IntegerType()), ("_code", T.BinaryType()), ("_cnt", T.BinaryType())))])
    schema = T.StructType([*keys, T.StructField("code", T.LongType()), T.StructField("cnt", T.LongType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        kinds, size = [], 0

        def part() -> Iterator[pa.RecordBatch]:
            for key, found in held.items():
                rows = list(packed.dealt(*packed.tally(packed.mixed(np.concatenate(found), k)), k, bits))
                if rows:
                    b, n, code, cnt = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([*(pa.array([v] * len(b), t) for v, t in zip(key, kinds, strict=True)), pa.array(b, pa.int32()), pa.array(n, pa.int32()), pa.array(code, pa.binary()), pa.array(cnt, pa.binary())], names=dealt.names)

        for key, kinds, codes in _blocks(batches, k, by, seq):
            x = pack(codes, k)
            held.setdefault(key, []).append(x)
            size += len(x)
            if size > GATHERED:
                yield from part()
                held, size = {}, 0
        yield from part()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        c = packed.columns(got, ("_n", "_code", "_cnt"))
        code, cnt = packed.tally(*packed.read_bin(got[0].column("_bin")[0].as_py(), c["_n"], c["_code"], c["_cnt"], k, bits))
        if least > 1:
            code, cnt = code[cnt >= least], cnt[cnt >= least]
        code = packed.unmixed(code, k)
        key = [pa.repeat(got[0].column(f)[0], len(code)) for f in by]
        yield from packed.sliced([*key, pa.array(code), pa.array(cnt)], schema.names)

    return reads.select(*by, seq).mapInArrow(deal, dealt).groupBy(*by, "_bin").applyInArrow(count, schema)


def count_kmers(reads: DataFrame, k: int, by: tuple[str, ...] = (), least: int = 1, most: int = MOST_COUNT) -> DataFrame:
    """Canonical k-mers with their counts, saturated at `most`; those under `least` are left out. One shuffle, combined map-side. They are counted as numbers
    and named after that, which is left out where the names are not asked for; over 31 bases they are counted as strings."""
    if k <= 31:
        c = packed_counts(reads, k, by, least=least).select(*by, decode(F.col("code"), k).alias("kmer"), "cnt")
    else:
        c = with_kmers(reads, k).select(*by, canonical(F.col("kmer")).alias("kmer")).groupBy(*by, "kmer").agg(F.count("*").alias("cnt"))
    return c.where(F.col("cnt") >= least).withColumn("cnt", F.least("cnt", F.lit(most).cast("bigint")))


def within(counts: DataFrame, low: int, up: int) -> DataFrame:
    """Counts from low to up, both included, as bounds of a count table are."""
    return counts.where(F.col("cnt").between(low, up))


def info(counts: DataFrame, low: int = 1, up: int = MOST_COUNT) -> DataFrame:
    """One row: k, number of k-mers within the bounds, their total, the bounds."""
    return within(counts, low, up).agg(F.max(F.char_length("kmer")).cast("int").alias("k"), F.count("*").alias("n_kmers"), F.sum("cnt").alias("total"), F.min("cnt").alias("min_cnt"), F.max("cnt").alias("max_cnt"))


def cardinality(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """f0 distinct, f1 seen once, total."""
    return counts.groupBy(*by).agg(F.count("*").alias("f0"), F.sum(F.when(F.col("cnt") == 1, 1).otherwise(0)).cast("bigint").alias("f1"), F.sum("cnt").alias("total"))


def approximate_cardinality(reads: DataFrame, k: int, error: float = 0.01) -> DataFrame:
    km = with_kmers(reads, k).select(canonical(F.col("kmer")).alias("kmer"))
    return km.agg(F.approx_count_distinct("kmer", error).alias("f0"))


def sketch_union(reads: DataFrame, k: int, by: str) -> DataFrame:
    """Distinct k-mers of all samples from the union of one sketch a sample."""
    km = with_kmers(reads, k).select(by, F.xxhash64(canonical(F.col("kmer"))).alias("h"))
    return km.groupBy(by).agg(F.hll_sketch_agg("h", F.lit(14)).alias("s")).agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("f0"))


#: Different k-mers that a levelled sample holds, in a task and in all: the error of what it estimates is about 1 / sqrt(SAMPLED / 2).
SAMPLED = 1 << 16


def _level_of(h: np.ndarray) -> np.ndarray:
    """Trailing zero bits of mixed k-mer codes: half of all k-mers have none, a quarter one, and so on."""
    h = (h.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(33)
    return np.bitwise_count((h & (~h + np.uint64(1))) - np.uint64(1)).astype(np.int32)


def levelled_sample(reads: DataFrame, k: int, by: tuple[str, ...] = (), most: int = SAMPLED) -> DataFrame:
    """by, code, cnt, level, at: a sample of the different k-mers, with how often each occurs. It holds the k-mers of level `at` or more (each task the lowest
    at which it has `most` or fewer), with all their occurrences. Samples are merged by their union; `estimate` brings them to one level."""
    schema = T.StructType([*(reads.schema[c] for c in by), *(T.StructField(c, t) for c, t in (("code", T.LongType()), ("cnt", T.LongType()), ("level", T.IntegerType()), ("at", T.IntegerType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[int, np.ndarray, np.ndarray]] = {}
        kinds = []
        for b in batches:
            kinds = [b.column(c).type for c in by]
            for *key, s in zip(*(b.column(c).to_pylist() for c in (*by, "seq")), strict=True):
                codes = _CODES[np.frombuffer((s or "").encode("ascii", "replace"), np.uint8)]
                for first in range(0, len(codes), BLOCK):
                    at, old, cnt = held.get(tuple(key), (0, np.empty(0, np.int64), np.empty(0, np.int64)))
                    x = pack(codes[first : first + BLOCK + k - 1], k)
                    x = x[_level_of(x) >= at]
                    code, place = np.unique(np.concatenate([old, x]), return_inverse=True)
                    cnt = np.bincount(place, np.concatenate([cnt, np.ones(len(x), np.int64)]), len(code)).astype(np.int64)
                    while len(code) > most:
                        at += 1
                        keep = _level_of(code) >= at
                        code, cnt = code[keep], cnt[keep]
                    held[tuple(key)] = at, code, cnt
        for key, (at, code, cnt) in held.items():
            same = lambda v, t: pa.array([v] * len(code), t)  # noqa: B023,E731
            yield pa.RecordBatch.from_arrays([*(same(v, t) for v, t in zip(key, kinds, strict=True)), pa.array(code), pa.array(cnt), pa.array(_level_of(code)), same(at, pa.int32())], names=[*by, "code", "cnt", "level", "at"])

    return reads.select(*by, "seq").mapInArrow(run, schema)


def estimate(sample: DataFrame, by: tuple[str, ...] = (), most: int = SAMPLED) -> DataFrame:
    """by, f0, f1, level: the numbers of different k-mers and of those seen once, from a levelled sample or a union of them, exact at level 0.

    The level is the highest of the parts, or higher until `most` k-mers or fewer are left; every one of them stands for 2 ** level.
    Without `by` there is one row, of zeros for an empty sample.
    """
    top = sample.groupBy(*by).agg(F.max("at").alias("_top"))
    x = (sample.join(F.broadcast(top), list(by)) if by else sample.crossJoin(F.broadcast(top))).where(F.col("level") >= F.col("_top"))  # a row for each sample
    c = x.groupBy(*by, "code").agg(F.sum("cnt").alias("cnt"), F.max("level").alias("level"), F.max("_top").alias("_top"))
    n = c.groupBy(*by, "level").agg(F.count("*").alias("n"), F.count_if(F.col("cnt") == 1).alias("once"), F.max("_top").alias("_top"))  # 64 rows at most
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("level"))
    n = n.select("*", F.sum("n").over(w).alias("all"), F.sum("once").over(w).alias("all_once"))
    # the lowest level at which few enough are left; levels without k-mers of their own are the next one's
    fits = n.where(F.col("all") <= most).groupBy(*by).agg(F.min("level").alias("_fit"), F.max("all").alias("_n"), F.max("all_once").alias("_once"), F.max("_top").alias("_top"))
    over = n.where(F.col("all") > most).groupBy(*by).agg(F.max("level").alias("_over"))
    f = (fits.join(over, list(by), "left") if by else fits.crossJoin(over)).withColumn("level", F.greatest("_top", F.coalesce(F.col("_over") + 1, F.lit(0))))
    scale = F.pow(F.lit(2.0), F.col("level"))
    known = lambda c: F.coalesce(c, F.lit(0))
    return f.select(*by, known(F.round(F.col("_n") * scale).cast("long")).alias("f0"), known(F.round(F.col("_once") * scale).cast("long")).alias("f1"), known(F.col("level")).alias("level"))


def histogram(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Dense: a row for every coverage from 1 to the largest, cov and freq."""
    h = counts.groupBy(*by, F.col("cnt").cast("int").alias("cov")).agg(F.count("*").alias("freq"))
    every = h.groupBy(*by).agg(F.explode(F.sequence(F.lit(1), F.max("cov"))).alias("cov")) if by else h.agg(F.max("cov").alias("m")).where("m is not null").select(F.explode(F.sequence(F.lit(1), F.col("m"))).alias("cov"))
    return every.join(h, [*by, "cov"], "left").select(*by, "cov", F.coalesce("freq", F.lit(0)).cast("bigint").alias("freq"))


def cutoffs(hist: DataFrame, by: tuple[str, ...] = (), quantile: float = 0.998, floor: int = 10) -> DataFrame:
    """low and up of each histogram (at most MOST_COUNT rows each).

    low: the first rise of the frequencies at coverage c gives round(1.25 (c - 2)), a histogram without a rise
    round(1.25 (rows - 1)), and `floor` at least. up: the first coverage from 2 whose cumulative frequency is over the
    quantile of all but the mass at coverage 1, which is added again; none gives rows + 1. Fewer than two rows give null.
    """
    w = Window.partitionBy(*by).orderBy("cov") if by else Window.partitionBy(F.lit(0)).orderBy("cov")
    x = hist.withColumn("prev", F.lag("freq").over(w)).withColumn("cum", F.sum("freq").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rise = F.min(F.when(F.col("prev") < F.col("freq"), F.col("cov")))
    t = x.groupBy(*by).agg(rise.alias("rise"), F.count("*").alias("n"), F.sum("freq").alias("total"), F.max(F.when(F.col("cov") == 1, F.col("freq"))).alias("once"))
    low = F.greatest(F.lit(floor), F.round(1.25 * F.coalesce(F.col("rise") - 2, F.col("n") - 1)).cast("int"))
    t = t.withColumn("low", low).withColumn("goal", F.floor(quantile * (F.col("total") - F.col("once")) + F.col("once")))
    x = x.join(t, list(by)) if by else x.crossJoin(F.broadcast(t))  # one row
    up = F.coalesce(F.min(F.when((F.col("cov") >= 2) & (F.col("cum") > F.col("goal")), F.col("cov"))), F.max("n") + 1)
    return x.groupBy(*by).agg(F.max("low").alias("low"), F.when(F.max("n") >= 2, up).cast("int").alias("up"))


def read_counters(reads: DataFrame, counts: DataFrame, k: int, key: str) -> DataFrame:
    """Every k-mer of every sequence with its count, 0 where it is absent: key, pos, cnt. counts: kmer, cnt; or code, cnt (packed), of which, while
    the k-mers asked for are few, the others are dropped before anything is shuffled; or a function that gives code, cnt of a table of codes, as `asked_counts` does."""
    km = with_kmers(reads, k).select(key, "pos", canonical(F.col("kmer")).alias("kmer"))
    if callable(counts):
        km = cut(km.select(key, "pos", encode(F.col("kmer")).alias("code")), "asked")
        got = counts(km.select("code")).select("code", F.least("cnt", F.lit(MOST_COUNT).cast("bigint")).alias("cnt"))
        return km.join(got, "code", "left").select(key, "pos", F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt"))
    if "code" in counts.columns:
        km = cut(km.select(key, "pos", encode(F.col("kmer")).alias("code")), "asked")
        got = counts.select("code", "cnt").join(small(km.select("code").distinct()), "code", "left_semi").withColumn("cnt", F.least("cnt", F.lit(MOST_COUNT).cast("bigint")))
        return km.join(got, "code", "left").select(key, "pos", F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt"))
    return km.join(counts.select("kmer", "cnt"), "kmer", "left").select(key, "pos", F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt"))


def string_coverage(reads: DataFrame, counts: DataFrame, k: int, key: str, low: int, up: int) -> DataFrame:
    """Mean and smallest count of each sequence's k-mers. ok: all are strictly between low and up, and none is missing."""
    c = read_counters(reads, counts, k, key)
    return c.groupBy(key).agg(F.avg("cnt").alias("mean_cnt"), F.min("cnt").alias("min_cnt"), F.bool_and((F.col("cnt") > low) & (F.col("cnt") < up)).alias("ok"))


def mask(reads: DataFrame, counts: DataFrame, k: int, key: str, least: int) -> DataFrame:
    """k-mers of the reads that occur `least` times or more: key, pos, kmer."""
    solid = counts.where(F.col("cnt") >= least).select(F.col("kmer").alias("_c"))
    km = with_kmers(reads, k).withColumn("_c", canonical(F.col("kmer")))
    return km.join(solid, "_c", "left_semi").select(key, "pos", "kmer")


#: k-mers that are looked up in tasks at most (8 bytes each go to every task), and cells of the table that most others fail.
ASKED, CELL_BITS = 1 << 23, 24


def _cells(code: np.ndarray) -> np.ndarray:
    return (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def asked_counts(reads: DataFrame, k: int, asked: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, code, cnt: what `packed_counts` gives of the k-mers in asked (code). While these are few, tasks look them up in what they pack and hand on counts of
    them alone, so that no other k-mer leaves a task; else all are counted and joined."""
    asked = cut(asked.select("code").distinct(), "asked")
    if asked.limit(ASKED + 1).count() > ASKED:
        return packed_counts(reads, k, by).join(asked, "code", "left_semi").select(*by, "code", "cnt")
    known = reads.sparkSession.sparkContext.broadcast(np.sort(asked.toArrow().column("code").to_numpy()))
    schema = T.StructType([*(reads.schema[c] for c in by), T.StructField("code", T.LongType()), T.StructField("cnt", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, likely = known.value, np.zeros(1 << CELL_BITS, bool)
        likely[_cells(every)] = True
        held: dict[tuple, list[np.ndarray]] = {}
        kinds, size = [], 0

        def part() -> Iterator[pa.RecordBatch]:
            for key, found in held.items():
                at, n = packed.tally(np.concatenate(found))
                yield from packed.sliced([*(pa.array([v] * len(at), t) for v, t in zip(key, kinds, strict=True)), pa.array(every[at]), pa.array(n)], schema.names)

        for key, kinds, codes in _blocks(batches, k, by, "seq"):
            x = pack(codes, k)
            x = x[likely[_cells(x)]]
            at = np.searchsorted(every, x)
            at = at[every[np.minimum(at, len(every) - 1)] == x] if len(every) else np.empty(0, np.int64)
            held.setdefault(key, []).append(at)
            size += len(at)
            if size > GATHERED:
                yield from part()
                held, size = {}, 0
        yield from part()

    return reads.select(*by, "seq").mapInArrow(run, schema).groupBy(*by, "code").agg(F.sum("cnt").alias("cnt"))


def found_kmers(reads: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """by, code: the canonical k-mers of what tasks gathered, each once a gathered part; nothing is shuffled."""
    schema = T.StructType([*(reads.schema[c] for c in by), T.StructField("code", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, kinds, codes in _blocks(batches, k, by, "seq"):
            x = np.unique(pack(codes, k))
            yield from packed.sliced([*(pa.array([v] * len(x), t) for v, t in zip(key, kinds, strict=True)), pa.array(x)], schema.names)

    return reads.select(*by, "seq").mapInArrow(run, schema)


def placed_kmers(seqs: DataFrame, k: int, key: str) -> DataFrame:
    """key, code, pos (from 1), fwd (the k-mer stands canonical in the sequence): the k-mers of each sequence, packed."""
    schema = T.StructType([seqs.schema[key], T.StructField("code", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("fwd", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def part() -> Iterator[pa.RecordBatch]:
            c = codes(b"-".join(h[2] for h in held))
            if len(c) < k:
                return
            bad = np.concatenate([[0], np.cumsum(c > 3)])
            at = np.flatnonzero(bad[k:] == bad[:-k])
            fwd, rev = (x[at] for x in windows(c, k))
            starts = np.cumsum([0, *(len(h[2]) + 1 for h in held[:-1])])
            of = np.searchsorted(starts, at, "right") - 1
            keys = pa.array([h[0] for h in held], kind).take(pa.array(of))
            pos = at - starts[of] + np.array([h[1] for h in held])[of] + 1
            yield from packed.sliced([keys, pa.array(np.minimum(fwd, rev)), pa.array(pos.astype(np.int32)), pa.array(fwd < rev)], schema.names)

        size = 0
        for b in batches:
            kind = b.column(key).type
            for v, s in zip(b.column(key).to_pylist(), b.column("seq").to_pylist(), strict=True):
                s = (s or "").encode("ascii", "replace")
                for at in range(0, len(s) - k + 1, BLOCK):
                    held.append((v, at, s[at : at + BLOCK + k - 1]))
                    size += len(held[-1][2])
                    if size > BLOCK:
                        yield from part()
                        held, size = [], 0
        if held:
            yield from part()

    return seqs.select(key, "seq").mapInArrow(run, schema)


#: Bits of a key up to which a task counts its keys in an array of all of them.
DENSE_BITS = 22


def minimizer_counts(reads: DataFrame, k: int, g: int, places: bool = False) -> DataFrame:
    """minimizer, n: how many k-mers have it as their smallest canonical g-mer. places: also by its place in the k-mer (from 1, of equal ones the first), and by
    the place of the smallest g-mer that is neither the first nor the last (inner_place). Minimizers are counted over
    the whole task, each once where their keys are short, else over what it gathered; only they are shuffled."""
    names = ["minimizer", "place", "inner_place"] if places else ["minimizer"]
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in names), T.StructField("n", T.LongType())])
    w = k - g + 1
    if g > 26 or w > 63:
        raise ValueError("minimizers of up to 26 bases in up to 63 places are packed with their places")
    low = w.bit_length()
    bits = 2 * g + 2 * low * places
    dense = bits <= DENSE_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits if dense else 0, np.int64)
        held: list[np.ndarray] = []
        size = 0

        def rows(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            mask = (1 << low) - 1
            cols = [key >> 2 * low, key >> low & mask, key & mask] if places else [key]
            yield from packed.sliced([*(pa.array(c) for c in cols), pa.array(n)], schema.names)

        def part() -> Iterator[pa.RecordBatch]:
            key = np.concatenate(held) if held else np.empty(0, np.int64)
            if dense:
                np.add(total, np.bincount(key, minlength=len(total)), out=total)
            else:
                yield from rows(*packed.tally(key))

        for _, _, codes in _blocks(batches, k, (), "seq"):
            if len(codes) < k:
                continue
            bad = np.concatenate([[0], np.cumsum(codes > 3)])
            m = len(codes) - k + 1
            x = np.minimum(*windows(codes, g)) << low
            at = lambda p: x[p - 1 : p - 1 + m] | p  # noqa: B023,E731
            ok = bad[k:] == bad[:-k]
            inner = at(min(2, w))
            for p in range(3, w):
                inner = np.minimum(inner, at(p))
            best = np.minimum(np.minimum(inner, at(1)), at(w))[ok]
            held.append(best << low | inner[ok] & (1 << low) - 1 if places else best >> low)
            size += len(held[-1])
            if size > GATHERED:
                yield from part()
                held, size = [], 0
        yield from part()
        if dense:
            key = np.flatnonzero(total)
            yield from rows(key, total[key])

    c = reads.select("seq").mapInArrow(run, schema).groupBy(*names).agg(F.sum("n").alias("n"))
    return c.select(decode(F.col("minimizer"), g).alias("minimizer"), *(F.col(c).cast("int").alias(c) for c in names[1:]), "n")


def own_coverage(reads: DataFrame, k: int, key: str, least: int = 1, most: int = MOST_COUNT) -> DataFrame:
    """key, n_kmers, total, min_cnt, max_cnt, n_solid, first_solid: of each sequence's k-mers the counts that they have in all the reads (saturated at `most`), and
    the number and first place (from 1) of those with `least` or more. Sequences without k-mers have no row.

    Sequences are written in blocks. The different k-mers of a block go to bins as in `packed_counts`, and their counts come back to the block in the same
    order, 1 to 2 bytes a k-mer; where they belong is worked out in the block, so no place is shuffled.
    """
    bits = packed.bin_bits(reads.sparkSession, k)
    kind = reads.schema[key].dataType
    block = T.StructType([T.StructField("_block", T.StringType()), T.StructField("_keys", T.ArrayType(kind)), T.StructField("_from", T.ArrayType(T.LongType())), T.StructField("_size", T.ArrayType(T.LongType())), T.StructField("_bases", T.BinaryType())])
    dealt = "_bin int, _block string, _n int, _code binary, _cnt binary"
    answer = "_block string, _bin int, _n int, _cnt binary"
    out = T.StructType([T.StructField(key, kind), *(T.StructField(c, T.LongType()) for c in ("n_kmers", "total", "min_cnt", "max_cnt", "n_solid", "first_solid"))])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        held, size = [], 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *(pa.array([list(c)], t) for c, t in zip(list(zip(*held, strict=True))[:3], (pa.list_(at_type), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)), pa.array([b"-".join(h[3] for h in held)], pa.binary())], names=block.names)  # noqa: B023,E731
        for b in batches:
            at_type = b.column(key).type
            for v, s in zip(b.column(key).to_pylist(), b.column("seq").to_pylist(), strict=True):
                if s is None or len(s) < k:
                    continue
                s = s.encode("ascii", "replace")
                for at in range(0, len(s) - k + 1, BLOCK):
                    held.append((v, at, min(len(s) - at, BLOCK + k - 1), s[at : at + BLOCK + k - 1]))
                    size += held[-1][2]
                    if size > BLOCK:
                        yield row()
                        held, size = [], 0
        if held:
            yield row()

    def here(bases: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places and mixed codes of a block's k-mers."""
        c = codes(bases)
        if len(c) < k:
            return (np.empty(0, np.int64),) * 2
        bad = np.concatenate([[0], np.cumsum(c > 3)])
        at = np.flatnonzero(bad[k:] == bad[:-k])
        return at, packed.mixed(np.minimum(*windows(c, k))[at], k)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, bases in zip(b.column("_block").to_pylist(), b.column("_bases").to_pylist(), strict=True):
                rows = [(x[0], name, *x[1:]) for x in packed.dealt(*packed.tally(here(bases)[1]), k, bits)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["_bin", "_block", "_n", "_code", "_cnt"])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        c = packed.columns(got, ("_block", "_n", "_code", "_cnt"))
        b = got[0].column("_bin")[0].as_py()
        code, cnt = packed.read_bin(b, c["_n"], c["_code"], c["_cnt"], k, bits)
        every, n = packed.tally(code, cnt)
        n = np.minimum(n, most)[np.searchsorted(every, code)]
        parts = np.split(n, np.cumsum(c["_n"])[:-1])
        yield from packed.sliced([pa.array(c["_block"]), pa.array([b] * len(parts), pa.int32()), pa.array(c["_n"], pa.int32()), pa.array([packed.squeezed(x) for x in parts], pa.binary())], ["_block", "_bin", "_n", "_cnt"])

    def sum_up(asked: pa.Table, told: pa.Table) -> pa.Table:
        rows = []
        if told.num_rows:
            t = sorted(zip(*(told.column(c).to_pylist() for c in ("_bin", "_n", "_cnt")), strict=True))
            cnt = np.concatenate([packed.opened(d, n) for _, n, d in t])
            keys, first, size, bases = (asked.column(c)[0].as_py() for c in ("_keys", "_from", "_size", "_bases"))
            at, code = here(bases)
            cnt = cnt[np.searchsorted(packed.tally(code)[0], code)]
            starts = np.cumsum([0, *(np.array(size[:-1]) + 1)])
            edge = np.searchsorted(at, np.append(starts, len(bases) + 1))
            for i, v in enumerate(keys):
                x = cnt[edge[i] : edge[i + 1]]
                if len(x):
                    solid = np.flatnonzero(x >= least)
                    rows.append((v, len(x), int(x.sum()), int(x.min()), int(x.max()), len(solid), int(at[edge[i] + solid[0]] - starts[i] + first[i] + 1) if len(solid) else None))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, [asked.schema.field("_keys").type.value_type, *[pa.int64()] * 6], strict=True)], names=out.names)

    b = cut(reads.select(key, "seq").mapInArrow(blocks, block), "blocks")
    told = b.select("_block", "_bases").mapInArrow(ask, dealt).groupBy("_bin").applyInArrow(tell, answer)
    parts = b.groupBy("_block").cogroup(told.groupBy("_block")).applyInArrow(sum_up, out)
    return parts.groupBy(key).agg(*(f(c).alias(c) for f, c in ((F.sum, "n_kmers"), (F.sum, "total"), (F.min, "min_cnt"), (F.max, "max_cnt"), (F.sum, "n_solid"), (F.min, "first_solid"))))


def colors(reads: DataFrame, k: int, color: str = "color") -> DataFrame:
    """Distinct (kmer, color)."""
    if k <= 31:
        return packed_counts(reads, k, (color,)).select(decode(F.col("code"), k).alias("kmer"), color)
    return with_kmers(reads, k).select(canonical(F.col("kmer")).alias("kmer"), color).distinct()


def color_sets(kmer_colors: DataFrame, color: str = "color") -> DataFrame:
    """kmer, colors (sorted array), n_colors."""
    c = kmer_colors.groupBy("kmer").agg(F.sort_array(F.collect_set(color)).alias("colors"))
    return c.withColumn("n_colors", F.size("colors"))


def shared_kmers(kmer_colors: DataFrame, color: str = "color") -> DataFrame:
    """Of each two colours the number of k-mers that both have. Colours are few, so pairs are made within a k-mer's set."""
    s = color_sets(kmer_colors, color).where("n_colors > 1").select("colors", F.posexplode("colors").alias("i", "a"))
    p = s.select("a", F.explode(F.slice("colors", F.col("i") + 2, F.size("colors"))).alias("b"))
    return p.groupBy("a", "b").agg(F.count("*").alias("n"))


def contained(reads: DataFrame, kmer_colors: DataFrame, k: int, key: str, color: str = "color") -> DataFrame:
    """key, color, n: of each sequence and colour the number of its k-mer places that have the colour, and whether all have it."""
    km = with_kmers(reads, k).select(key, "pos", canonical(F.col("kmer")).alias("kmer"))
    total = km.groupBy(key).agg(F.count("*").alias("n_kmers"))
    got = km.join(kmer_colors, "kmer").groupBy(key, color).agg(F.countDistinct("pos").alias("n"))
    return got.join(total, key).select(key, color, "n", (F.col("n") == F.col("n_kmers")).alias("whole"))
