"""Fragments of unitigs in blocks: thousands of them a row, at two bits a base, glued with numpy where they have the same k-mer at an end.

A fragment's joints, the canonical k-mers at its open ends, are read from its bases, so a block holds only sizes, bases and which ends are open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import counts, packed, segments

#: Fragments and bases that a task gathers before it deals them; bases that are copied at once.
GATHERED, BASES, COPIED = 1 << 18, 1 << 23, 1 << 22
#: A row is a whole unitig (seq, circular), or a block of n fragments of `size` bases in all.
ROW = "seq string, circular boolean, n int, size bigint, sizes binary, bases binary, ends binary"
_NAMES, _KINDS = ["seq", "circular", "n", "size", "sizes", "bases", "ends"], (pa.string(), pa.bool_(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())

#: Sizes, bases (0 to 3, one after another), and open ends (1 left, 2 right) of fragments.
Pieces = tuple[np.ndarray, np.ndarray, np.ndarray]


def copied(bases: np.ndarray, start: np.ndarray, size: np.ndarray, back: np.ndarray | None = None) -> np.ndarray:
    """size bases from each start on, one after another; where back is true, from start to the left and complemented."""
    out, total = [], np.append(0, np.cumsum(size))
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(total, total[at] + COPIED, "right")) - 1)
        n, first = size[at:to], start[at:to]
        place = np.arange(n.sum()) - np.repeat(total[at:to] - total[at], n)
        if back is None:
            out.append(bases[np.repeat(first, n) + place])
        else:
            turn = np.repeat(back[at:to], n)
            x = bases[np.repeat(first, n) + np.where(turn, -place, place)]
            out.append(np.where(turn, 3 - x, x).astype(np.uint8))
        at = to
    return np.concatenate(out) if out else np.empty(0, np.uint8)


def joints(p: Pieces, k: int) -> np.ndarray:
    """The joints of fragments, two each, left and right, -1 where an end is closed."""
    size, bases, ends = p
    first = np.cumsum(size) - size
    out = np.full(2 * len(size), -1)
    for side, at in ((0, first), (1, first + size - k)):
        at = at[open_ := np.flatnonzero(ends >> side & 1)]
        code = np.zeros(len(at), np.int64)
        for i in range(k):
            code = code << 2 | bases[at + i]
        out[2 * open_ + side] = np.minimum(code, packed.revcomp(code, k))
    return out


def block(p: Pieces) -> tuple[int, int, bytes, bytes, bytes]:
    return len(p[0]), len(p[1]), packed.squeezed(p[0]), segments.shut(p[1]), segments.shut(p[2])


def unblocked(rows: Iterator[tuple]) -> Pieces:
    """The fragments of blocks (n, size, sizes, bases, ends)."""
    parts = [(packed.opened(sizes, n), segments.opened(bases, size), segments.opened(ends, n)) for n, size, sizes, bases, ends in rows]
    size, bases, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    return size, bases, ends


def taken(p: Pieces, rows: np.ndarray) -> Pieces:
    size, bases, ends = p
    return size[rows], copied(bases, (np.cumsum(size) - size)[rows], size[rows]), ends[rows]


def rows_of(p: Pieces, circular: list[bytes] = ()) -> list[pa.Array]:
    """Rows of fragments: whole ones as text, the others as a block."""
    whole, rest = np.flatnonzero(p[2] == 0), np.flatnonzero(p[2])
    size, bases, _ = taken(p, whole)
    text = pa.LargeStringArray.from_buffers(len(whole), pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int64)), pa.py_buffer(packed._LETTERS[bases])).cast(pa.string())
    seq = pa.concat_arrays([text, pa.array([x.decode() for x in circular], pa.string())])
    cols = [seq, pa.array(np.arange(len(seq)) >= len(whole)), *(pa.nulls(len(seq), t) for t in _KINDS[2:])]
    if len(rest):
        cols = [pa.concat_arrays([c, x]) for c, x in zip(cols, [pa.array([v], t) for v, t in zip((None, False, *block(taken(p, rest))), _KINDS, strict=True)], strict=True)]
    return cols


def fragments(b: int, bits: int, code: np.ndarray, k: int) -> list[pa.Array]:
    """`packed.fragments` of a bin as rows."""
    seq, left, right, circular = packed.fragments(b, bits, code, k)
    ring = circular.to_numpy(zero_copy_only=False)
    rings, seq = [x.encode() for x in seq.filter(circular).to_pylist()], seq.filter(pa.array(~ring))
    _, offsets, data = seq.buffers()
    edge = np.frombuffer(offsets, np.int32)[seq.offset : seq.offset + len(seq) + 1].astype(np.int64) if len(seq) else np.zeros(1, np.int64)
    bases = counts._CODES[np.frombuffer(data, np.uint8)[edge[0] : edge[-1]]] if data is not None else np.empty(0, np.uint8)
    of = lambda x: x.is_valid().to_numpy(zero_copy_only=False)[~ring].astype(np.uint8)
    return rows_of((np.diff(edge), bases, of(left) | of(right) << 1), rings)


def glued(p: Pieces, k: int) -> tuple[Pieces, list[bytes]]:
    """Fragments joined where two have the same joint, and the cycles that are closed by that."""
    size, bases, ends = p
    joint, first = joints(p, k), np.cumsum(size) - size
    mate = np.full(len(joint), -1)
    order = np.argsort(joint, kind="stable")
    x = joint[order]
    same = np.flatnonzero((x[1:] == x[:-1]) & (x[1:] >= 0))
    mate[order[same]], mate[order[same + 1]] = order[same + 1], order[same]
    # a fragment is entered by an end and left by the other one; every path is walked from both of its ends
    nxt = mate[np.arange(len(joint)) ^ 1]
    heads = np.flatnonzero(mate < 0)
    cur, at, far, steps = heads, np.arange(len(heads)), heads ^ 1, []
    while len(at):
        steps.append((at, cur))
        cur = nxt[cur]
        go = cur >= 0
        at, cur = at[go], cur[go]
        far[at] = cur ^ 1
    chain, s = (np.concatenate(c) for c in zip(*steps, strict=True)) if steps else (np.empty(0, np.int64),) * 2
    seen = np.zeros(len(size), bool)
    seen[s >> 1] = True
    keep = heads < far
    mine = keep[chain]
    chain, s = chain[mine], s[mine]
    order = np.argsort(chain, kind="stable")
    chain, s = chain[order], s[order]
    skip = np.where(np.concatenate([[True], chain[1:] != chain[:-1]]), 0, k)[: len(chain)]
    frag, back = s >> 1, (s & 1).astype(bool)
    n = size[frag] - skip
    start = np.where(back, first[frag] + size[frag] - 1 - skip, first[frag] + skip)
    heads, far = heads[keep], far[keep]
    open_ = lambda e: ends[e >> 1] >> (e & 1).astype(np.uint8) & 1
    sizes = np.bincount(np.searchsorted(np.flatnonzero(keep), chain), n, len(heads)).astype(np.int64)
    rings = []
    if len(rest := np.flatnonzero(~seen)):  # what no free end leads to are cycles
        q = taken(p, rest)
        text = packed._LETTERS[q[1]].tobytes()
        edge = np.append(0, np.cumsum(q[0])).tolist()
        rings = [x[0] for x in packed.glued([text[i:j] for i, j in zip(edge[:-1], edge[1:], strict=True)], joints(q, k), k)]
    return (sizes, copied(bases, start, n, back), (open_(heads) | open_(far) << 1).astype(np.uint8)), rings


def round_of(blocks: DataFrame, k: int, buckets: int, turn: int) -> DataFrame:
    """Rows of the fragments of blocks after a round of gluing. Each fragment goes to the smaller bucket of its joints, so a third of the joints or more close."""
    names, kinds = ["_bucket", *_NAMES[2:]], (pa.int32(), *_KINDS[2:])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            p = unblocked(iter(rows))
            h = joints(p, k).astype(np.uint64) + np.uint64((turn * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
            h = (h ^ h >> np.uint64(29)) * np.uint64(packed._MUL[0])
            h = (h ^ h >> np.uint64(32)) * np.uint64(packed._MUL[1]) >> np.uint64(33)
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            closed = np.stack([p[2] & 1 == 0, p[2] >> 1 == 0], 1).ravel()
            bucket = np.where(closed, buckets, bucket).reshape(-1, 2).min(1)
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            edge = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket))
            out = [(int(bucket[i]), *block(taken(p, order[i:j]))) for i, j in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        held, n, size = [], 0, 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in _NAMES[2:]), strict=True):
                held.append(row)
                n, size = n + row[0], size + row[1]
                if n > GATHERED or size > BASES:
                    yield from part(held)
                    held, n, size = [], 0, 0
        if held:
            yield from part(held)

    def glue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = packed.columns(batches, tuple(_NAMES[2:]))
        yield from packed.sliced(rows_of(*glued(unblocked(zip(*c.values(), strict=True)), k)), _NAMES)

    cols = [F.col(c) for c in _NAMES[2:]]
    return blocks.select(*cols).mapInArrow(deal, f"_bucket int, {ROW.split(', ', 2)[2]}").groupBy("_bucket").applyInArrow(glue, ROW)
