"""Removal of long repeated byte strings, found by column-wise construction over many documents.

A string of LENGTH bytes that starts in two places has the same anchors in both: of its 160-byte windows, those of
the smallest hash (winnowing). So only places that share an anchor are compared, each as a segment of the bytes that
any LENGTH-string around the anchor can touch, all aligned on it. The segments of an anchor form the collection.
Its positional Burrows-Wheeler order is built column by column: each round inserts one symbol of every segment, a stable
sort by (group, symbol) updates the order of the reversed prefixes, and the start of each segment's longest common
match with its neighbour in that order is carried along. Wherever a match reaches LENGTH, both strings repeat.
Columns lie one after another and are read once, in order; a round touches nothing but its column, the order and
the match starts. Equal segments are one row of the collection, which keeps groups of copies small, and an
anchor with very many different segments is parted into narrower ranges of starts, down to single strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free_names, load, small, written

LENGTH, ANCHOR = 400, 160
#: Starts of LENGTH-strings before an anchor that still hold it whole.
REACH = LENGTH - ANCHOR
#: Different segments that one group may bring to a task; beyond, its starts are parted. Results do not depend on it.
HOT = 30_000
#: Widths of the ranges that starts are parted into, level by level; the last are single strings.
PARTS = (REACH + 1, 16, 1)
_PAD = 255  # no byte of UTF-8
#: Seeds and odd bases of the hash that places strings, and of the second one that tells single strings apart.
_FIRST, _SECOND = (0xA11CE, 0x9E3779B97F4A7C15), (0xB0B, 0xC2B2AE3D27D4EB4F)


def _tables(n: int, seed: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random 64-bit words of the bytes, powers of an odd base, and of its inverse."""
    rng = np.random.Generator(np.random.PCG64(seed))
    words = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    for out, b in ((up, base), (down, pow(base, -1, 1 << 64))):
        out[0] = 1
        done = 1
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = out[:more] * np.uint64(pow(b, done, 1 << 64))
            done += more
    return words, up, down


class Hasher:
    """Hashes of all windows of a text, from one prefix sum."""

    def __init__(self, key: tuple[int, int] = _FIRST) -> None:
        self.key = key
        self.words, self.up, self.down = _tables(1 << 16, *key)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(data) > len(self.up):
            self.words, self.up, self.down = _tables(2 * len(data), *self.key)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.words[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray | slice, length: int | np.ndarray) -> np.ndarray:
        if isinstance(start, slice):
            h = (prefix[length:] - prefix[:-length]) * self.down[: len(prefix) - length]
        else:
            h = (prefix[start + length] - prefix[start]) * self.down[start]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def _slide(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over every `width` neighbours, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = f(out[:-step], out[step:])
        have += step
    return out


def anchors(data: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a text, and its prefix sums. Shorter texts than LENGTH have none."""
    prefix = hasher.prefix(data)
    if len(data) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64), prefix
    h = hasher.of(prefix, slice(None), ANCHOR)
    low = _slide(h, REACH + 1, np.minimum)  # of each LENGTH-string
    # an anchor is the smallest of some LENGTH-string: the largest of the minima over it is its own hash
    padded = np.concatenate((np.zeros(REACH, np.uint64), low, np.zeros(REACH, np.uint64)))
    at = np.flatnonzero(_slide(padded, REACH + 1, np.maximum) == h)
    return at, h[at], prefix


def _ranges(width: int) -> list[tuple[int, int]]:
    """Ranges (first, last) of distances from a string's start to the anchor, all of one width; the last may overlap."""
    firsts = [min(a, REACH + 1 - width) for a in range(0, REACH + 1, width)]
    return [(a, a + width - 1) for a in firsts]


def _row(data: np.ndarray, prefix: np.ndarray, hasher: Hasher, at: np.ndarray, h: np.ndarray, near: int, far: int, second: tuple[Hasher, np.ndarray] | None) -> tuple[np.ndarray, ...]:
    """second: the second hasher and its prefix sums, where single strings are settled by their hashes. Of the anchors with a string in the range: group key, segment hash, segment start, columns before and after that the text lacks, anchor, far."""
    lo, hi = at - far, at - near + LENGTH  # the bytes that strings of this range touch
    first, last = np.maximum(lo, 0), np.minimum(hi, len(data))
    fits = last - first >= LENGTH
    lo, hi, first, last, a, core = lo[fits], hi[fits], first[fits], last[fits], at[fits], h[fits]
    if far - near < REACH and len(a):  # all strings of the range share these bytes, and a string that fits holds them
        core = hasher.of(prefix, a - near, LENGTH - (far - near))
    core = core + np.uint64((0x9E3779B97F4A7C15 * (far * 1000 + near)) % (1 << 64))
    seg_hasher, seg_prefix = second or (hasher, prefix)
    seg = seg_hasher.of(seg_prefix, first, last - first) ^ ((first - lo) * 1000 + hi - last).astype(np.uint64) if len(a) else core
    return core, seg, first, first - lo, hi - last, a, np.full(len(a), far)


def positional_order(columns: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """columns: (width, rows) symbols, row i of group[i]. True at (start, row) where the row's string of `length`
    symbols from column start equals that of another row of its group. _PAD matches nothing that counts."""
    width, m = columns.shape
    order = np.argsort(group, kind="stable")
    g = np.unique(group, return_inverse=True)[1].astype(np.int64)
    start = np.zeros(m, np.int32)
    out = np.zeros((width - length + 1, m), bool)
    key_of = g * 256
    for c in range(width):
        key = key_of[order] + columns[c][order]
        moved = np.argsort(key, kind="stable")
        if len(moved) > 1 and (np.diff(moved) != 1).any():
            key = key[moved]
            # from the neighbour that is now before it, a row's match starts where the latest of the matches between them does
            before, after = moved[:-1], moved[1:]
            same = key[1:] == key[:-1]
            new = np.full(m, c + 1, np.int32)
            close = same & (after - before == 1)
            new[1:][close] = start[after[close]]
            far = np.flatnonzero(same & (after - before > 1))
            if len(far):
                ends = np.stack((before[far] + 1, after[far] + 1), axis=1).ravel()
                padded = np.append(start, 0)
                new[1:][far] = np.maximum.reduceat(padded, ends)[::2]
            order, start = order[moved], new
        else:
            key = key[moved]
            start = np.where(np.concatenate(([False], key[1:] == key[:-1])), start, c + 1).astype(np.int32)
        if c + 1 >= length:
            hit = start <= c + 1 - length
            hit[0] = False
            row = out[c + 1 - length]
            row[order[hit]] = True
            row[order[np.flatnonzero(hit) - 1]] = True
    return out


def _runs(flags: np.ndarray) -> list[int]:
    """Starts and ends of the runs of True."""
    d = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return d.tolist()


_ROW = "g long, s long, text_hash binary, at int, before int, after int, anchor int, far int"


def _emit(docs: DataFrame, width: int, hot: DataFrame | None) -> DataFrame:
    """A row for each anchor and range of starts; with hot, docs has `only`: the anchors that are parted further."""
    ranges, above = _ranges(width), PARTS[max(0, PARTS.index(width) - 1)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, other = Hasher(), Hasher(_SECOND)
        with np.errstate(over="ignore"):
            for pdf in batches:
                parts: list[tuple] = []
                chosen = pdf["only"] if "only" in pdf else [None] * len(pdf)
                for text, key, only in zip(pdf["text"], pdf["text_hash"], chosen, strict=True):
                    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                    at, h, prefix = anchors(data, hasher)
                    second = (other, other.prefix(data)) if width == 1 and len(at) else None
                    wanted = None if only is None else np.array([(x["anchor"], x["far"]) for x in only], np.int64)
                    for near, far in ranges if len(at) else ():
                        a, g = at, h
                        if wanted is not None:  # the ranges inside those that are parted
                            take = np.isin(at, wanted[(wanted[:, 1] >= far) & (wanted[:, 1] - above < near), 0])
                            a, g = at[take], h[take]
                        row = _row(data, prefix, hasher, a, g, near, far, second) if len(a) else ((),)
                        if len(row[0]):
                            parts.append((*row, key))
                if parts:
                    n = [len(p[0]) for p in parts]
                    yield pd.DataFrame({
                        "g": np.concatenate([p[0] for p in parts]).view(np.int64), "s": np.concatenate([p[1] for p in parts]).view(np.int64),
                        "text_hash": np.repeat(np.array([p[7] for p in parts], object), n), "at": np.concatenate([p[2] for p in parts]).astype(np.int32),
                        "before": np.concatenate([p[3] for p in parts]).astype(np.int32), "after": np.concatenate([p[4] for p in parts]).astype(np.int32),
                        "anchor": np.concatenate([p[5] for p in parts]).astype(np.int32), "far": np.concatenate([p[6] for p in parts]).astype(np.int32)})

    cols = ["text_hash", "text", *(["only"] if hot is not None else [])]
    return bounded_batches(docs).select(*cols).mapInPandas(run, _ROW)


def _compare(segments: DataFrame, width: int) -> DataFrame:
    """g, s, runs: the ranges of columns where strings start that repeat within the group."""
    span = width - 1 + LENGTH

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def flush(pdf: pd.DataFrame) -> pd.DataFrame:
            cols = np.full((len(pdf), span), _PAD, np.uint8)
            for i, (seg, before) in enumerate(zip(pdf["segment"], pdf["before"], strict=True)):
                b = np.frombuffer(seg, np.uint8)
                cols[i, before : before + len(b)] = b
            hit = positional_order(np.ascontiguousarray(cols.T), pdf["g"].to_numpy())
            starts = np.arange(span - LENGTH + 1)[:, None]
            hit &= (starts >= pdf["before"].to_numpy()[None, :]) & (starts + LENGTH <= span - pdf["after"].to_numpy()[None, :])
            return pd.DataFrame({"g": pdf["g"], "s": pdf["s"], "runs": [_runs(x) for x in hit.T]})

        rows = 0
        for pdf in batches:  # sorted by g; groups stay together
            held.append(pdf)
            rows += len(pdf)
            if rows >= 20_000:
                every = pd.concat(held, ignore_index=True)
                last = every["g"].iloc[-1]
                cut = int(np.searchsorted((every["g"] == last).to_numpy(), True))
                if cut:
                    yield flush(every.iloc[:cut])
                held = [every.iloc[cut:]]
                rows = len(held[0])
        if held:
            every = pd.concat(held, ignore_index=True)
            if len(every):
                yield flush(every)

    return segments.select("g", "s", "segment", "before", "after").mapInPandas(run, "g long, s long, runs array<int>")


def _bytes_of(rows: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """rows with their segment's bytes, cut from the text they stand in."""
    span = width - 1 + LENGTH
    lists = rows.groupBy(F.col("text_hash").alias("r_hash")).agg(F.collect_list(F.struct("g", "s", "at", "before", "after")).alias("rows"))
    both = docs.join(lists, docs["text_hash"] == F.col("r_hash")).select("text", "rows")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, own in zip(pdf["text"], pdf["rows"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                out += [(r["g"], r["s"], r["before"], r["after"], data[r["at"] : r["at"] + span - r["before"] - r["after"]]) for r in own]
            yield pd.DataFrame(out, columns=["g", "s", "before", "after", "segment"])

    return both.mapInPandas(run, "g long, s long, before int, after int, segment binary")


def repeated(docs: DataFrame) -> DataFrame:
    """text_hash, spans: the bytes (start, end; sorted, apart) covered by LENGTH-strings that start in two places.

    docs: text_hash, text, n (rows of the text); one row a text. A text of two rows or more repeats as a whole and
    is left to the caller; here it is a partner for others only.
    """
    spark, found, level = docs.sparkSession, [], docs
    hot = None
    for depth, width in enumerate(PARTS):
        rows = written(_emit(level, width, hot), f"repeats-{depth}")
        segs = rows.groupBy("g", "s").agg(F.count("*").alias("n"), F.min(F.struct("text_hash", "at", "before", "after")).alias("x"))
        segs = written(segs.select("g", "s", "n", "x.*"), f"repeats-segments-{depth}")
        groups = segs.groupBy("g").agg(F.count("*").alias("k"), F.sum("n").alias("total")).where("total > 1")
        groups = written(groups, f"repeats-groups-{depth}")
        # a segment that stands in two places repeats with every string in it
        whole = segs.where("n > 1").select("g", "s", F.array(F.lit(0), F.lit(width)).alias("runs"))
        results = [whole]
        if width > 1:
            several = groups.where((F.col("k") > 1) & (F.col("k") <= HOT)).select("g")
            wanted = _bytes_of(segs.join(several, "g"), docs, width)
            n = max(8, spark.sparkContext.defaultParallelism)
            ordered = wanted.repartition(max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), "g").sortWithinPartitions("g")
            results.append(_compare(ordered, width))
        hits = results[0] if len(results) == 1 else results[0].unionByName(results[1])
        hits = written(hits.where(F.size("runs") > 0).groupBy("g", "s").agg(F.flatten(F.collect_list("runs")).alias("runs")), f"repeats-hits-{depth}")
        here = rows.join(hits, ["g", "s"]).select("text_hash", F.struct((F.col("at") - F.col("before")).alias("lo"), "at", "runs", (F.lit(width - 1 + LENGTH) - F.col("before") - F.col("after") + F.col("at")).alias("end")).alias("hit"))
        found.append(here)
        if width == 1:
            break
        many = groups.where(F.col("k") > HOT).select("g")
        if many.isEmpty():
            break
        hot = rows.join(many, "g").groupBy("text_hash").agg(F.collect_set(F.struct("anchor", "far")).alias("only"))
        level = docs.join(hot, "text_hash")
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    # a hit's runs of starts, as bytes of the text, cut to what its text has
    starts = F.flatten(F.transform("hit", lambda x: F.transform(F.sequence(F.lit(0), (F.size(x["runs"]) / 2).cast("int") - 1), lambda i: F.struct(
        F.greatest(F.get(x["runs"], i * 2) + x["lo"], x["at"]).alias("start"),
        F.least(F.get(x["runs"], i * 2 + 1) - 1 + x["lo"] + LENGTH, x["end"]).alias("end")))))
    spans = every.groupBy("text_hash").agg(F.collect_list("hit").alias("hit")).select("text_hash", F.array_sort(starts).alias("spans"))
    return spans


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with kept (binary: the remaining bytes), n_bytes, n_removed and n_spans.

    Each byte covered by a LENGTH-byte string that also starts anywhere else goes; strings never cross documents.
    Null and empty texts have no bytes and lose none. Rows that are equal in text are copies, whether their ids are
    equal or not, and lose all if they have LENGTH bytes. Columns of these names (in any case) are replaced, others stay; an empty table gives an
    empty result.
    """
    names = ("kept", "n_bytes", "n_removed", "n_spans")
    keep = [c for c in docs.columns if c.lower() not in names]
    own, spans_hash, spans_, cut_ = free_names(docs, "_hash", "_span_hash", "_spans", "_cut")
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(*keep, F.unhex(F.md5(text)).alias(own))
    long_ones = d.where(F.octet_length(text) >= LENGTH).select(F.col(own).alias("text_hash"), "text")
    counts = written(long_ones.groupBy("text_hash").agg(F.count("*").alias("n")), "repeats-texts")
    copied = counts.where("n > 1").select(F.col("text_hash").alias("c_hash"))
    spans = repeated(long_ones)
    spans = spans.join(small(copied), F.col("text_hash") == F.col("c_hash"), "left_anti")
    spans = spans.select(F.col("text_hash").alias(spans_hash), F.col("spans").alias(spans_)).unionByName(copied.select(F.col("c_hash").alias(spans_hash), F.array(F.struct(F.lit(0).alias("start"), F.lit(2**31 - 1).alias("end"))).alias(spans_)))
    spans = written(spans, "repeats-spans")
    out = d.join(spans, F.col(own) == F.col(spans_hash), "left")

    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, lists in batches:
            rows = []
            for t, own in zip(texts, lists, strict=True):
                data = (t or "").encode("utf-8", "surrogatepass")
                kept, at, n = [], 0, 0
                end = -1
                for x in sorted((x["start"], min(x["end"], len(data))) for x in own) if own is not None else ():
                    if x[0] > end:
                        n += 1
                        kept.append(data[max(at, 0) : x[0]])
                    end = max(end, x[1])
                    at = end
                kept.append(data[at:])
                b = b"".join(kept)
                rows.append((b, len(data), len(data) - len(b), n))
            yield pd.DataFrame(rows, columns=list(names))

    parts = F.pandas_udf(cut, "kept binary, n_bytes long, n_removed long, n_spans long")
    return bounded_batches(out).withColumn(cut_, parts(F.col("text"), F.col(spans_))).select(*keep, *[F.col(f"{cut_}.{x}").alias(x) for x in names])


def op6_repeats(spark, sf_dir):
    d = without_repeats(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("repeated"))


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans, kept_sha256 of each text, by counting every string: for tests."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    seen: dict[bytes, int] = {}
    for b in data:
        for i in range(len(b) - length + 1):
            h = xxhash.xxh3_128_digest(b[i : i + length])
            seen[h] = seen.get(h, 0) + 1
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - length + 1):
            if seen[xxhash.xxh3_128_digest(b[i : i + length])] > 1:
                gone[i] += 1
                if i + length <= len(b):
                    gone[i + length] -= 1
        mask = np.cumsum(gone)[: len(b)] > 0
        kept = np.frombuffer(b, np.uint8)[~mask].tobytes()
        out.append((len(b), int(mask.sum()), len(_runs(mask)) // 2, hashlib.sha256(kept).hexdigest()))
    return out
