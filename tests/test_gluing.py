"""Fragments in blocks: glued as strings are, at two bits a base, with no joint beside them."""

import random

import numpy as np
import pyarrow as pa
import pytest

from strandloom.operators import counts, gluing, graph, packed

COMP = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(COMP)[::-1]


def pieces(seqs, ends):
    return np.array([len(s) for s in seqs]), counts.codes("".join(seqs).encode()), np.array(ends, np.uint8)


def texts(p):
    t, at = packed._LETTERS[p[1]].tobytes().decode(), np.append(0, np.cumsum(p[0]))
    return [t[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


@pytest.mark.parametrize("copied", [3, 1 << 22])
def test_glued_as_strings(monkeypatch, copied):
    monkeypatch.setattr(gluing, "COPIED", copied)
    rnd, k = random.Random(3), 5
    seqs, ends = [], []
    for _ in range(40):  # paths, cut with k bases shared and some parts missing
        s = "".join(rnd.choice("ACGT") for _ in range(rnd.randint(6, 60)))
        at = sorted({0, len(s) - k, *rnd.sample(range(len(s) - k), min(4, len(s) - k))})
        for i, j in zip(at[:-1], at[1:], strict=True):
            if rnd.random() < 0.9:
                x, e = s[i : j + k], (i > 0) | (j < len(s) - k) << 1
                seqs.append(rc(x) if (turn := rnd.random() < 0.5) else x)
                ends.append((e & 1) << 1 | e >> 1 if turn else e)
    p = pieces(seqs, ends)
    joint = gluing.joints(p, k)
    once = {x for x in joint[joint >= 0].tolist() if (joint == x).sum() > 2}  # a joint stands at two ends at most
    p = (p[0], p[1], np.array([e & ~sum(1 << s for s in (0, 1) if joint[2 * i + s] in once) for i, e in enumerate(p[2].tolist())], np.uint8))
    joint = gluing.joints(p, k)
    got, rings = gluing.glued(p, k)
    want = packed.glued([s.encode() for s in seqs], joint, k)
    assert sorted(min(s, rc(s)) for s in texts(got)) == sorted(min(x := s.decode(), rc(x)) for s, _, _, ring in want if not ring)
    assert sorted(rings) == sorted(s for s, _, _, ring in want if ring) and len(got[0]) < len(seqs)
    assert int(np.bitwise_count(got[2]).sum()) == sum((a >= 0) + (b >= 0) for _, a, b, ring in want if not ring)


def test_cycle_is_closed():
    ring, k = "ACGTTGCATCCGATTAGA", 5
    s = ring + ring[:k]
    got, rings = gluing.glued(pieces([s[:12], rc(s[7:])], [3, 3]), k)
    assert not len(got[0]) and rings == [packed.opened_cycle(ring.encode(), k)]


def test_rows_are_small_and_whole():
    rnd = random.Random(1)
    seqs = ["".join(rnd.choice("ACGT") for _ in range(34)) for _ in range(5000)]
    rows = pa.RecordBatch.from_arrays(gluing.rows_of(pieces(seqs, [i % 4 for i in range(5000)]), [b"ACGTACGTA"]), names=gluing._NAMES).to_pylist()
    whole = [r for r in rows if r["n"] is None]
    assert sorted((r["seq"], r["circular"]) for r in whole) == sorted([*((s, False) for s in seqs[::4]), ("ACGTACGTA", True)])
    (b,) = [r for r in rows if r["n"] is not None]
    assert texts(gluing.unblocked(iter([tuple(b[c] for c in gluing._NAMES[2:])]))) == [s for i, s in enumerate(seqs) if i % 4]
    assert sum(len(b[c]) for c in ("sizes", "bases", "ends")) < 10 * b["n"]  # 34 letters and two numbers took 50 bytes
    assert graph.GLUED_BASES <= 1 << 24
