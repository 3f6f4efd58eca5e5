"""Bins of packed k-mers: what is handed on is small and whole, and unitigs are glued over bins as plain walks give them."""

import random

import numpy as np
import pytest

from strandloom.operators import graph, packed

COMP = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(COMP)[::-1]


@pytest.mark.parametrize("k", [5, 15, 25, 31])
def test_dealt_rows_are_small_and_whole(k):
    code = np.unique(np.random.default_rng(k).integers(0, 1 << 2 * k, 200_000))
    assert np.array_equal(packed.unmixed(packed.mixed(code, k), k), code)
    x = np.sort(packed.mixed(code, k))
    cnt = np.where(np.arange(len(x)) % 50 == 0, 70_000, 1)
    rows = list(packed.dealt(x, cnt, k, 6))
    got = [packed.read_bin(b, [n], [c], [m], k, 6) for b, n, c, m in rows]
    assert np.array_equal(np.concatenate([g[0] for g in got]), x) and np.array_equal(np.concatenate([g[1] for g in got]), cnt)
    assert sum(len(c) for _, _, c, _ in rows) <= len(x) * (2 * k / 8 + 1)


def plain_unitigs(kmers, k):
    """By walking: the set of (seq, circular)."""
    o = set(kmers) | {rc(x) for x in kmers}
    after = lambda x: [y for b in "ACGT" if (y := x[1:] + b) in o]
    before = lambda x: [y for b in "ACGT" if (y := b + x[:-1]) in o]

    def link(x):
        n = after(x)
        return n[0] if len(n) == 1 and len(before(n[0])) == 1 and n[0] not in (x, rc(x)) else None

    out, left = set(), set(o)
    back = {link(x) for x in o}
    for x in o - back:
        seq, left = x, left - {x}
        while (y := link(x)) is not None:
            seq, x, left = seq + y[-1], y, left - {y}
        out.add((min(seq, rc(seq)), False))
    while left:
        ring, x = [], left.pop()
        while x not in ring:
            ring.append(x)
            x = link(x)
        left -= set(ring)
        i = ring.index(min(ring))
        ring = ring[i:] + ring[:i]
        if min(ring) <= min(rc(y) for y in ring):
            out.add((ring[0] + "".join(y[-1] for y in ring[1:]), True))
    return out


@pytest.mark.parametrize("k", [5, 9, 25])
@pytest.mark.parametrize("glued", [3, 200_000])
def test_unitigs_over_bins_equal_walks(spark, monkeypatch, k, glued):
    monkeypatch.setattr(graph, "GLUED", glued)
    rnd = random.Random(k)
    some = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    seqs = [some(n) for n in (30, 60, 400)]
    seqs += [seqs[2][50:120] + some(40), "A" * 40, "ACACAC" * 12]
    if k == 25:
        ring = some(150)
        seqs += [ring + ring[: k - 1], "ACG" * 20]
    kmers = {min(s[i : i + k], rc(s[i : i + k])) for s in seqs for i in range(len(s) - k + 1)}
    u = graph.unitigs(spark.createDataFrame([(x,) for x in sorted(kmers)], "kmer string"), k).collect()
    assert {(r.seq, r.circular) for r in u} == plain_unitigs(kmers, k) and len(u) == len({r.seq for r in u})
    assert sum(r.n_kmers for r in u) == len(kmers)
