"""Packed k-mers in bins: tasks sort what they gathered, hand each bin one binary row of it, and bins are worked on with numpy where they arrive.

A row of Spark's shuffle takes some 28 bytes whatever it holds. Here it holds thousands of k-mers as the differences of sorted numbers, of which only
the byte planes in use are kept: about 4 bytes a k-mer of 25 bases, 2 of 15. Bins are parts of the range of a one-to-one mixing, so they are even, and
a k-mer that is met often comes once from each gathered part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_MUL = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Bases in a minimizer of a junction at most, k-mers that a task gathers before it deals them.
MOST_G, GATHERED = 9, 1 << 21
#: Rows of a batch that goes back to Spark.
BATCH = 1 << 19


def mixed(code: np.ndarray, k: int) -> np.ndarray:
    """A one-to-one mixing of numbers of 2 k bits."""
    mask, h = np.uint64((1 << 2 * k) - 1), code.astype(np.uint64)
    for m in _MUL:
        h ^= h >> np.uint64(k)
        h *= np.uint64(m)
        h &= mask
    return h.astype(np.int64)


def unmixed(code: np.ndarray, k: int) -> np.ndarray:
    mask, h = np.uint64((1 << 2 * k) - 1), code.astype(np.uint64)
    for m in reversed(_MUL):
        h *= np.uint64(pow(m, -1, 1 << 64))
        h &= mask
        h ^= h >> np.uint64(k)
    return h.astype(np.int64)


def squeezed(x: np.ndarray) -> bytes:
    """Numbers from 0 as byte planes, without those that are 0 in all."""
    if not len(x):
        return b""
    planes = max(1, (int(x.max()).bit_length() + 7) // 8)
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()


def opened(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.int64)
    planes = np.frombuffer(data, np.uint8).reshape(-1, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<i8").ravel()


def rising(x: np.ndarray) -> bytes:
    """Sorted numbers from 0 by their differences."""
    return squeezed(np.diff(x, prepend=0))


def risen(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(opened(data, n))


def bin_bits(spark: SparkSession, k: int) -> int:
    """The number of bins as a power of two: twice spark.sql.shuffle.partitions, which is raised with the data, 64 at least."""
    return min(2 * k, max(6, (2 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))


def tally(code: np.ndarray, cnt: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different numbers in order, and how often they occur or the sums of cnt (1 at least each)."""
    x = np.sort(code)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
    n, x = np.diff(np.append(first, len(x))).astype(np.int64), x[first]
    if cnt is not None and len(more := np.flatnonzero(cnt > 1)):
        np.add.at(n, np.searchsorted(x, code[more]), cnt[more] - 1)
    return x, n


def dealt(code: np.ndarray, cnt: np.ndarray, k: int, bits: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """bin, n, codes and counts (none if all are 1) of each bin that sorted mixed codes fall into."""
    shift = 2 * k - bits
    edge = np.searchsorted(code, np.arange((1 << bits) + 1, dtype=np.int64) << shift)
    for b in np.flatnonzero(np.diff(edge)).tolist():
        x, c = code[edge[b] : edge[b + 1]], cnt[edge[b] : edge[b + 1]]
        yield b, len(x), rising(x - (b << shift)), b"" if (c == 1).all() else squeezed(c - 1)


def read_bin(b: int, ns: list, codes: list, cnts: list, k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The mixed codes and counts of a bin's rows, one after another."""
    base = b << 2 * k - bits
    code = [risen(d, n) + base for d, n in zip(codes, ns, strict=True)]
    cnt = [opened(d, n) + 1 if d else np.ones(n, np.int64) for d, n in zip(cnts, ns, strict=True)]
    return np.concatenate(code), np.concatenate(cnt)


def columns(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> dict[str, list]:
    """The columns of a group's batches as lists."""
    out: dict[str, list] = {c: [] for c in names}
    for b in batches:
        for c in names:
            out[c] += b.column(c).to_pylist()
    return out


def sliced(arrays: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of at most BATCH rows."""
    for at in range(0, len(arrays[0]), BATCH):
        yield pa.RecordBatch.from_arrays([a[at : at + BATCH] for a in arrays], names=names)


def revcomp(code: np.ndarray, k: int) -> np.ndarray:
    """Reverse complements of packed k-mers: pairs of bits are swapped by halves and complemented."""
    x = ~code.astype(np.uint64)
    for step, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        m = np.uint64(mask)
        x = x >> np.uint64(step) & m | (x & m) << np.uint64(step)
    return (x >> np.uint64(64 - 2 * k)).astype(np.int64)


def bin_of(rank: np.ndarray, bits: int) -> np.ndarray:
    return (rank.astype(np.uint64) * np.uint64(_MUL[0]) >> np.uint64(64 - bits)).astype(np.int32)


def junction_bins(code: np.ndarray, k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bins of both ends, the first and the last k-1 bases, of packed k-mers: of the least mixed g-mer of either strand, so that most k-mers
    have both ends in one bin, and all k-mers that meet at an end come to its bin."""
    g = min(MOST_G, (k - 1) // 2)
    every = np.arange(1 << 2 * g, dtype=np.int64)
    rank = mixed(np.minimum(every, revcomp(every, g)), g).astype(np.int32)
    h = [rank[code >> 2 * p & (1 << 2 * g) - 1] for p in range(k - g + 1)]  # from the last g bases to the first
    mid = h[1]
    for x in h[2:-1]:
        mid = np.minimum(mid, x)
    return bin_of(np.minimum(mid, h[-1]), bits), bin_of(np.minimum(mid, h[0]), bits)


def at_junctions(kmers: DataFrame, k: int, work, schema: T.StructType | str, mark: str | None = None) -> DataFrame:
    """What work(bin, bits, codes, marks) gives, a list of arrays, for all k-mers that have an end in a bin. kmers: code (canonical) and the small whole number `mark`."""
    bits = bin_bits(kmers.sparkSession, 15) + 1
    names = ["_bin", "_mark", "_n", "_code"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def part() -> Iterator[pa.RecordBatch]:
            code, marks = (np.concatenate(x) for x in zip(*held, strict=True))
            for m in np.unique(marks).tolist():
                x = np.sort(code[marks == m])
                left, right = junction_bins(x, k, bits)
                two = left != right
                b, x = np.concatenate([left, right[two]]), np.concatenate([x, x[two]])
                order = np.lexsort((x, b))
                b, x = b[order], x[order]
                edge = np.append(np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])), len(b))
                rows = [(int(b[i]), m, int(j - i), rising(x[i:j])) for i, j in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            held.append((b.column("code").to_numpy(zero_copy_only=False), b.column(mark).to_numpy(zero_copy_only=False) if mark else np.zeros(b.num_rows, np.int64)))
            size += b.num_rows
            if size > GATHERED:
                yield from part()
                held, size = [], 0
        if held:
            yield from part()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        c = columns(got, ("_n", "_mark", "_code"))
        code = np.concatenate([risen(d, n) for d, n in zip(c["_code"], c["_n"], strict=True)])
        marks = np.repeat(np.array(c["_mark"]), c["_n"])
        code, first = np.unique(code, return_index=True)
        yield from sliced(work(got[0].column("_bin")[0].as_py(), bits, code, marks[first]), names_out)

    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names_out = out.names
    cols = ["code", mark] if mark else ["code"]
    return kmers.select(*cols).mapInArrow(deal, "_bin int, _mark int, _n int, _code binary").groupBy("_bin").applyInArrow(run, out)


class Junctions:
    """The oriented k-mers of a bin and what follows them. Row i + n is the reverse complement of row i (modulo 2 n)."""

    def __init__(self, b: int, bits: int, code: np.ndarray, k: int):
        self.code, self.n, self.k = code, len(code), k
        self.o = np.concatenate([code, revcomp(code, k)])
        left, right = junction_bins(code, k, bits)
        #: whether what comes behind a k-mer is known here
        self.owned = np.concatenate([right == b, left == b])
        pre = self.o >> 2
        self.order = np.argsort(pre, kind="stable")
        x = pre[self.order]
        self.first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        self.size = np.diff(np.append(self.first, len(x)))
        self.starts = x[self.first]
        suf = self.o & (1 << 2 * (k - 1)) - 1
        self.group = np.minimum(np.searchsorted(self.starts, suf), len(self.starts) - 1)
        #: k-mers that follow, and those that end like this one
        self.after = np.where(self.starts[self.group] == suf, self.size[self.group], 0)
        own = np.empty(len(x), np.int64)
        own[self.order] = np.repeat(self.size, self.size)
        self.beside = self.twin(own)

    def twin(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x[self.n :], x[: self.n]])

    def links(self) -> np.ndarray:
        """The row that alone follows a row that alone comes before it, -1 if there is none."""
        d = self.order[self.first[self.group]]
        ok = self.owned & (self.after == 1) & (self.beside == 1) & (d % self.n != np.arange(2 * self.n) % self.n)
        return np.where(ok, d, -1)


_LETTERS = np.frombuffer(b"ACGT", np.uint8)
_TWIN = bytes.maketrans(b"ACGT", b"TGCA")


def turned(s: bytes) -> bytes:
    return s.translate(_TWIN)[::-1]


def opened_cycle(s: bytes, k: int) -> bytes:
    """The bases of a cycle, of the strand with the smaller oriented k-mer, cut before that k-mer, with k-1 bases again at the end."""
    best = []
    for t in (s, turned(s)):
        ext = (t * (2 + k // len(t)))[: len(t) + k - 1]
        x = np.frombuffer(ext, np.uint8)
        num = np.zeros(len(t), np.int64)
        code = np.searchsorted(_LETTERS, x)
        for i in range(k):
            num = num << 2 | code[i : i + len(t)]
        at = int(num.argmin())
        best.append((int(num[at]), ((t[at:] + t[:at]) * (2 + k // len(t)))[: len(t) + k - 1]))
    return min(best)[1]


def fragments(b: int, bits: int, code: np.ndarray, k: int) -> list[pa.Array]:
    """seq, left, right, circular: the paths that a bin's own junctions make, of either strand one. left and right are the (canonical) k-mers at which another bin may go on."""
    j = Junctions(b, bits, code, k)
    nxt, n = j.links(), j.n
    has = np.zeros(2 * n, bool)
    has[nxt[nxt >= 0]] = True
    heads = np.flatnonzero(~has)
    seen = np.zeros(2 * n, bool)
    seen[heads] = True
    last, at, cur = heads.copy(), np.arange(len(heads)), heads
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    size = np.ones(len(heads), np.int64)
    while len(at):
        cur = nxt[cur]
        go = cur >= 0
        at, cur = at[go], cur[go]
        last[at] = cur
        size[at] += 1
        seen[cur] = True
        steps.append((at, (j.o[cur] & 3).astype(np.uint8)))
    keep = j.o[heads] < j.twin(j.o)[last]
    offset = np.concatenate([[0], np.cumsum((size + k - 1) * keep)])
    text = np.empty(offset[-1], np.uint8)
    start, base = j.o[heads[keep]], offset[:-1][keep]
    for i in range(k):
        text[base + i] = start >> 2 * (k - 1 - i) & 3
    for i, (at, letter) in enumerate(steps):
        mine = keep[at]
        text[offset[at[mine]] + k + i] = letter[mine]
    ends = np.append(base, offset[-1]).astype(np.int64)
    joint = lambda open_, row: pa.array(code[row % n], mask=~open_)
    h, e = heads[keep], last[keep]
    seq = pa.LargeStringArray.from_buffers(len(h), pa.py_buffer(ends), pa.py_buffer(_LETTERS[text])).cast(pa.string())
    out = [seq, joint(~j.twin(j.owned)[h], h), joint(~j.owned[e], e), pa.array(np.zeros(len(h), bool))]
    rings = set()
    for row in np.flatnonzero(~seen).tolist():  # whole cycles in one bin
        if not seen[row]:
            ring = []
            while not seen[row]:
                seen[row] = True
                ring.append(row)
                row = int(nxt[row])
            rings.add(opened_cycle(_LETTERS[j.o[ring] >> 2 * (k - 1)].tobytes(), k).decode())
    if rings:
        none = pa.nulls(len(rings), pa.int64())
        out = [pa.concat_arrays([x, y]) for x, y in zip(out, [pa.array(sorted(rings)), none, none, pa.array([True] * len(rings))], strict=True)]
    return out


def glued(seqs: list[bytes], joints: np.ndarray, k: int) -> list[tuple[bytes, int, int, bool]]:
    """seq, left, right, circular: fragments joined where two have the same k-mer at an end. joints: two a fragment, left and right, -1 where it is closed."""
    mate = np.full(len(joints), -1)
    order = np.argsort(joints, kind="stable")
    x = joints[order]
    same = np.flatnonzero((x[1:] == x[:-1]) & (x[1:] >= 0))
    mate[order[same]], mate[order[same + 1]] = order[same + 1], order[same]
    free, mate = np.flatnonzero(mate < 0).tolist(), mate.tolist()
    done, out = [False] * len(seqs), []
    for end in [*free, *range(0, len(joints), 2)]:  # what no free end leads to are cycles
        if done[end >> 1]:
            continue
        parts, s = [], end
        while s >= 0 and not done[s >> 1]:
            done[s >> 1] = True
            t = turned(seqs[s >> 1]) if s & 1 else seqs[s >> 1]
            parts.append(t[k:] if parts else t)
            far = s ^ 1
            s = mate[far]
        whole = b"".join(parts)
        if s >= 0:
            out.append((opened_cycle(whole[:-k], k), -1, -1, True))
        else:
            out.append((whole, int(joints[end]), int(joints[far]), False))
    return out
