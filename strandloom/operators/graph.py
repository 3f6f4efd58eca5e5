"""The de Bruijn graph as tables: adjacency, compaction into unitigs, edges, clean-up, set operations.

k is odd, so that no k-mer is its own reverse complement. Oriented k-mers are rows; a graph is its set of canonical
k-mers (column kmer), from which everything else is derived.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.kmers import canonical, decode, encode, packed_revcomp, revcomp, with_kmers
from strandloom.operators import counts, gluing, packed, segments
from strandloom.session import cut, drop, small

#: Lengths of k-mers that are packed, fragments and bases of a bucket in which they are glued.
PACKED, GLUED, GLUED_BASES = range(5, 32), 1 << 18, 1 << 24


def oriented(kmers: DataFrame) -> DataFrame:
    return kmers.select(F.explode(F.array("kmer", revcomp(F.col("kmer")))).alias("o"))


def _ends(k: int):
    return F.substring(F.col("o"), F.lit(1), F.lit(k - 1)), F.right(F.col("o"), F.lit(k - 1))


def degrees(kmers: DataFrame, k: int) -> DataFrame:
    """kmer, out_deg, in_deg of the canonical orientation. kmers: kmer, or code. k-mers are numbers of two bits a base and go to the bins of both their ends
    (`packed.at_junctions`), where what follows them is counted; only the degrees are put together by k-mer."""

    def work(b: int, bits: int, code: np.ndarray, _: np.ndarray) -> list[pa.Array]:
        j = packed.Junctions(b, bits, code, k)
        side = lambda s: pa.array(j.after[s].astype(np.int64), mask=~j.owned[s])
        return [pa.array(code), side(slice(0, j.n)), side(slice(j.n, None))]

    if k in PACKED:
        d = packed.at_junctions(packed_kmers(kmers), k, work, "code bigint, out_deg bigint, in_deg bigint")
        return d.groupBy("code").agg(F.max("out_deg").alias("out_deg"), F.max("in_deg").alias("in_deg")).select(decode(F.col("code"), k).alias("kmer"), "out_deg", "in_deg")
    code = packed_kmers(kmers).withColumn("other", packed_revcomp(F.col("code"), k))
    starts = code.select(F.explode(F.array("code", "other")).alias("o")).groupBy(F.shiftright("o", 2).alias("x")).agg(F.count("*").alias("n"))
    end = lambda c: F.col(c).bitwiseAND((1 << 2 * (k - 1)) - 1)
    out = starts.select(F.col("x").alias("x_out"), F.col("n").alias("n_out"))
    into = starts.select(F.col("x").alias("x_in"), F.col("n").alias("n_in"))
    d = code.join(out, end("code") == F.col("x_out"), "left").join(into, end("other") == F.col("x_in"), "left")
    of = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return d.select(decode(F.col("code"), k).alias("kmer"), of("n_out").alias("out_deg"), of("n_in").alias("in_deg"))


#: Bits of a degree, the one that stands for an unknown degree.
_DEG, _UNKNOWN = 3, 7


def degrees_of_reads(reads: DataFrame, k: int, least: int = 2, keep=None) -> DataFrame:
    """`degrees` of the k-mers that occur `least` times or more in reads (seq), of which keep(out_deg, in_deg), on arrays, says which rows are wanted (all if it is
    not given). Reads are dealt to the bins of ends as runs of bases (`segments`). A k-mer with both ends in a bin is done there; the degrees of the others
    and of what is wanted are put together in bins, 4 to 5 bytes a k-mer."""
    bits = packed.bin_bits(reads.sparkSession, 15)
    schema, done = "_bin int, _n int, _code binary, _cnt binary", "code bigint, out_deg bigint, in_deg bigint"

    def work(b: int, jbits: int, code: np.ndarray, _: np.ndarray) -> list[pa.Array]:
        j = packed.Junctions(b, jbits, code, k)
        deg = np.where(j.owned, j.after, _UNKNOWN)
        out, into = deg[: j.n], deg[j.n :]
        deg = out << _DEG | into
        if keep is not None:
            ok = (out == _UNKNOWN) | (into == _UNKNOWN) | keep(out, into)
            code, deg = code[ok], deg[ok]
        x = packed.mixed(code, k)
        order = np.argsort(x)
        rows = list(packed.dealt(x[order], deg[order] + 1, k, bits))
        return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        c = packed.columns(got, ("_n", "_code", "_cnt"))
        x, deg = packed.read_bin(got[0].column("_bin")[0].as_py(), c["_n"], c["_code"], c["_cnt"], k, bits)
        order = np.argsort(x)
        x, deg = x[order], deg[order] - 1
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        out, into = np.minimum.reduceat(deg >> _DEG, first), np.minimum.reduceat(deg & _UNKNOWN, first)
        code = packed.unmixed(x[first], k)
        if keep is not None:
            ok = keep(out, into)
            code, out, into = code[ok], out[ok], into[ok]
        yield from packed.sliced([pa.array(code), pa.array(out), pa.array(into)], ["code", "out_deg", "in_deg"])

    d = segments.at_junctions(reads, k, least, work, schema).groupBy("_bin").applyInArrow(join, done)
    return d.select(decode(F.col("code"), k).alias("kmer"), "out_deg", "in_deg")


def steps(kmers: DataFrame, k: int) -> DataFrame:
    """lost, gained, n: of all edges between oriented k-mers the first base of the one and the last base of the other. k is one of PACKED; kmers: kmer, or code."""

    s = packed.at_junctions(packed_kmers(kmers), k, lambda *x: _steps(*x[:3], k), _STEPS)
    return s.groupBy("lost", "gained").agg(F.sum("n").alias("n")).where("n > 0")


def steps_of_reads(reads: DataFrame, k: int, least: int = 2) -> DataFrame:
    """`steps` of the k-mers that occur `least` times or more in reads (seq), which are dealt to the bins as runs of bases (`segments`)."""
    s = segments.at_junctions(reads, k, least, lambda *x: _steps(*x[:3], k), _STEPS)
    return s.groupBy("lost", "gained").agg(F.sum("n").alias("n")).where("n > 0")


_STEPS = "lost string, gained string, n bigint"


def _steps(b: int, bits: int, code: np.ndarray, k: int) -> list[pa.Array]:
    j = packed.Junctions(b, bits, code, k)
    src = np.flatnonzero(j.owned & (j.after > 0))
    n = j.after[src]
    at = np.repeat(j.first[j.group[src]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    kind = np.bincount(np.repeat(j.o[src] >> 2 * (k - 1), n) * 4 + (j.o[j.order[at]] & 3), minlength=16)
    letter = lambda x: pa.array(["ACGT"[i] for i in x])
    return [letter(np.arange(16) // 4), letter(np.arange(16) % 4), pa.array(kind.astype(np.int64))]


def branching(deg: DataFrame) -> DataFrame:
    return deg.where((F.col("out_deg") > 1) | (F.col("in_deg") > 1))


def tips(deg: DataFrame) -> DataFrame:
    """Dead ends on exactly one side."""
    return deg.where((F.col("out_deg") == 0) != (F.col("in_deg") == 0))


def isolated(deg: DataFrame) -> DataFrame:
    return deg.where((F.col("out_deg") == 0) & (F.col("in_deg") == 0))


def successors(kmers: DataFrame, k: int) -> DataFrame:
    """src, dst: all edges between oriented k-mers."""
    pre, suf = _ends(k)
    o = oriented(kmers)
    return o.select(F.col("o").alias("src"), suf.alias("x")).join(o.select(F.col("o").alias("dst"), pre.alias("x")), "x").select("src", "dst")


def mercy(kmers: DataFrame, weak: DataFrame, k: int) -> DataFrame:
    """Weak k-mers (seen once) that bridge a dead end of the graph to another one; of several at one end, the smallest. kmer, or code where the k-mers are packed."""
    if "code" in kmers.columns:
        both = kmers.select("code", F.lit(1).alias("solid")).union(weak.select("code", F.lit(0).alias("solid")))
        return mercy_marked(both, k)
    pre, suf = _ends(k)
    starts = oriented(kmers).select(pre.alias("x")).distinct()
    ends = oriented(kmers).select("o", suf.alias("x")).join(starts, "x", "left_anti").select(F.col("o").alias("left_end"), "x")
    w = weak.join(kmers, "kmer", "left_anti")
    wo = oriented(w).select("o", pre.alias("x"), suf.alias("y"))
    got = wo.join(ends, "x")
    back = ends.select(F.col("x").alias("e"), F.col("left_end").alias("_l")).select(revcomp(F.col("e")).alias("y"), revcomp(F.col("_l")).alias("right_end"))
    got = got.join(back, "y").select(canonical(F.col("o")).alias("kmer"), "left_end", "right_end")
    first = got.groupBy("left_end").agg(F.min("kmer").alias("kmer")).select("kmer").distinct()
    other = got.groupBy("right_end").agg(F.min("kmer").alias("kmer")).select("kmer").distinct()
    return first.join(other, "kmer", "left_semi")


def mercy_marked(marked: DataFrame, k: int) -> DataFrame:
    """code: `mercy` of packed k-mers, where solid is 1 for those of the graph and 0 for weak ones. Bins of ends (`packed.at_junctions`) find the dead ends and the weak
    k-mers behind them; only weak k-mers with a dead end on both sides are joined."""
    return _bridges(packed.at_junctions(marked, k, lambda b, bits, code, solid: _behind_dead_ends(b, bits, code, solid == 1, k), _BEHIND, "solid"), k)


def mercy_of_reads(reads: DataFrame, k: int, least: int = 2) -> DataFrame:
    """code: `mercy` of the graph of the k-mers that occur `least` times or more in reads (seq), and of those seen once. Reads are dealt to the bins of ends as runs of
    bases (`segments`), where k-mers are counted, so that no k-mer is shuffled by itself."""

    def work(b: int, bits: int, code: np.ndarray, cnt: np.ndarray) -> list[pa.Array]:
        known = (cnt == 1) | (cnt >= least)
        return _behind_dead_ends(b, bits, code[known], cnt[known] >= least, k)

    return _bridges(segments.at_junctions(reads, k, 1, work, _BEHIND), k)


_BEHIND = "code bigint, fwd boolean, dead bigint"


def _behind_dead_ends(b: int, bits: int, code: np.ndarray, solid: np.ndarray, k: int) -> list[pa.Array]:
    """Weak k-mers of a bin behind a dead end of its solid ones: code, whether the weak one stands canonical, and the dead end."""
    if solid.all() or not solid.any():
        return [pa.array([], pa.int64()), pa.array([], pa.bool_()), pa.array([], pa.int64())]
    g = packed.Junctions(b, bits, code[solid], k)
    low = (1 << 2 * (k - 1)) - 1
    dead = g.o[g.owned & (g.after == 0)]  # with nothing behind them
    dead = dead[np.argsort(dead & low, kind="stable")]
    code = code[~solid]
    n, both = len(code), np.concatenate([code, packed.revcomp(code, k)])
    left, right = packed.junction_bins(code, k, bits)
    rows = np.flatnonzero(np.concatenate([left == b, right == b]))  # weak ones whose first k-1 bases belong here
    x = both[rows] >> 2
    first, found = np.searchsorted(dead & low, x), np.searchsorted(dead & low, x, "right")
    found = found - first
    at = np.repeat(first, found) + np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found)
    rows = np.repeat(rows, found)
    return [pa.array(code[rows % n]), pa.array(rows < n), pa.array(dead[at])]


def _bridges(behind: DataFrame, k: int) -> DataFrame:
    """code: of the weak k-mers behind dead ends those with one on both sides, of several at one end the smallest."""
    met = cut(behind, "mercy")
    near, far = met.where("fwd").select("code", F.col("dead").alias("l")), met.where("not fwd").select("code", F.col("dead").alias("r"))
    got = cut(near.join(far, "code"), "mercy")  # l: dead end before the k-mer, r: before its reverse complement
    twin = lambda c: packed_revcomp(F.col(c), k)
    # both orientations of a weak k-mer count, as each end is one of an orientation
    both = got.select("code", F.col("l").alias("left_end"), twin("r").alias("right_end")).union(got.select("code", F.col("r").alias("left_end"), twin("l").alias("right_end")))
    least = lambda c: both.groupBy(c).agg(F.min("code").alias("code")).select("code").distinct()
    return least("left_end").join(least("right_end"), "code", "left_semi")


def _doubled(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes: o, prev (null at a start). (o, start, dist) of the nodes on paths, and (o, prev) of those on cycles.

    Each round doubles the distance that every pointer spans: about log2 of the longest path rounds. Nodes that have
    reached their start leave the working set; a round in which none leaves has only cycles left.
    """
    done = nodes.where("prev is null").select("o", F.col("o").alias("start"), F.lit(0).cast("bigint").alias("dist"))
    live = nodes.where("prev is not null").select("o", F.col("prev").alias("ptr"), F.lit(1).cast("bigint").alias("dist"))
    while True:
        d = done.select(F.col("o").alias("ptr"), F.col("start").alias("_s"), F.col("dist").alias("_d"))
        jump = live.select(F.col("o").alias("ptr"), F.col("ptr").alias("_p"), F.col("dist").alias("_pd"))
        x = cut(live.join(d, "ptr", "left").join(jump, "ptr", "left"), "doubling")
        ended = x.where("_s is not null").select("o", F.col("_s").alias("start"), (F.col("dist") + F.col("_d")).alias("dist"))
        rest = x.where("_s is null").select("o", F.coalesce("_p", "ptr").alias("ptr"), (F.col("dist") + F.coalesce("_pd", F.lit(0))).alias("dist"))
        if ended.isEmpty():
            return done, nodes.join(rest.select("o"), "o", "left_semi")
        done, live = cut(done.union(ended), "doubled"), rest


def _cycle_labels(cycles: DataFrame) -> DataFrame:
    """o, label: the smallest node of its cycle."""
    x = cut(cycles.select("o", F.col("prev").alias("ptr"), F.least("o", "prev").alias("label")), "cycle")
    while True:
        y = x.select(F.col("o").alias("ptr"), F.col("ptr").alias("p2"), F.col("label").alias("l2"))
        z = cut(x.join(y, "ptr").select("o", F.col("p2").alias("ptr"), F.least("label", "l2").alias("new"), "label"), "cycle")
        if z.where("new <> label").isEmpty():
            return z.select("o", F.col("new").alias("label"))
        x = z.select("o", "ptr", F.col("new").alias("label"))


def packed_kmers(kmers: DataFrame) -> DataFrame:
    """code: the packed k-mers of a table that holds them as such or as kmer."""
    return kmers.select("code") if "code" in kmers.columns else kmers.select(encode(F.col("kmer")).alias("code"))


def unitigs(kmers: DataFrame, k: int) -> DataFrame:
    """seq, n_kmers, circular: every maximal non-branching path once, in the smaller of its orientations. Cycles are cut
    before their smallest oriented k-mer. A link is kept where the left k-mer has one successor and the right one one
    predecessor, and the two are not each other's reverse complement. kmers: kmer, or code (packed, canonical).

    k-mers go to the bins of both of their ends (`packed.at_junctions`), where all k-mers that meet at an end are seen: a bin joins what meets at its own
    ends to fragments. A k-mer whose ends have two bins stands at an end of a fragment of each, which are glued there: each round deals the open fragments to
    buckets by the smaller bucket of their ends, so a third of the joints or more close, and the work of all rounds is in proportion to the fragments.
    """
    if k % 2 == 0:
        raise ValueError("k must be odd")
    if k not in PACKED:
        return _unitigs_by_doubling(kmers, k)
    return _glued(packed.at_junctions(packed_kmers(kmers), k, lambda b, bits, code, _: gluing.fragments(b, bits, code, k), gluing.ROW), k)


def unitigs_of_reads(reads: DataFrame, k: int, least: int = 2) -> DataFrame:
    """`unitigs` of the k-mers that occur `least` times or more in reads (seq), which are dealt to the bins of ends as runs of bases (`segments`) and counted there."""
    if k % 2 == 0 or k not in PACKED:
        return unitigs(counts.count_kmers(reads, k, least=least).select("kmer"), k)
    return _glued(segments.at_junctions(reads, k, least, lambda b, bits, code, _: gluing.fragments(b, bits, code, k), gluing.ROW), k)


def _glued(found: DataFrame, k: int) -> DataFrame:
    """The unitigs that fragments of bins (`gluing`) are part of. Open fragments are deleted as soon as they have been dealt with."""
    rest = F.col("n").isNotNull()
    live = cut(found.withColumn("open", rest), "fragments", ("open",))
    parts, turn = [], 0
    while True:
        every = live
        parts.append(every.where("not open").select("seq", "circular"))
        live = every.where("open").drop("open")
        n, bases = live.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
        if not n:
            break
        buckets = max(-(-n // GLUED), -(-bases // GLUED_BASES))
        live = cut(gluing.round_of(live, k, buckets, turn).withColumn("open", rest), "glued", ("open",))
        drop(every, "open=true")
        turn += 1
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    seq = F.when(F.col("circular"), F.col("seq")).otherwise(canonical(F.col("seq")))
    return rows.select(seq.alias("seq"), (F.char_length("seq") - (k - 1)).cast("bigint").alias("n_kmers"), "circular")


def _unitigs_by_doubling(kmers: DataFrame, k: int) -> DataFrame:
    """unitigs of k-mers that are too long to be packed, or very short ones."""
    pre, suf = _ends(k)
    o = cut(oriented(kmers), "oriented")
    once = o.groupBy(pre.alias("x")).agg(F.count("*").alias("n"), F.max("o").alias("dst")).where("n = 1").select("x", "dst")
    sole = o.groupBy(suf.alias("x")).agg(F.count("*").alias("n"), F.max("o").alias("src")).where("n = 1").select("x", "src")
    links = once.join(sole, "x").where(canonical(F.col("src")) != canonical(F.col("dst"))).select(F.col("dst").alias("o"), F.col("src").alias("prev"))
    nodes = cut(o.join(links, "o", "left"), "links")
    done, cycles = _doubled(nodes)
    rows = done.withColumn("circular", F.lit(False))
    if not cycles.isEmpty():
        labels = _cycle_labels(cycles)
        # of a cycle and its reverse complement, the one with the smaller label stays
        twin = labels.select(revcomp(F.col("o")).alias("o"), F.col("label").alias("twin"))
        mine = labels.join(twin, "o", "left").where("twin is null or label <= twin")
        opened = cycles.join(mine, "o").select("o", F.when(F.col("o") == F.col("label"), None).otherwise(F.col("prev")).alias("prev"))
        rows = rows.union(_doubled(cut(opened, "opened"))[0].withColumn("circular", F.lit(True)))
    parts = rows.groupBy("start", "circular").agg(F.array_sort(F.collect_list(F.struct("dist", F.right("o", F.lit(1)).alias("b")))).alias("p"))
    seq = F.concat(F.substring(F.col("start"), F.lit(1), F.lit(k - 1)), F.array_join(F.transform("p", lambda x: x["b"]), ""))
    u = parts.select(seq.alias("seq"), F.size("p").cast("bigint").alias("n_kmers"), "circular")
    u = u.where(F.col("circular") | (F.col("seq") <= revcomp(F.col("seq"))))
    return u.distinct()


def with_ids(u: DataFrame) -> DataFrame:
    """unitig_id from 1 in the order of seq, without one task for all: ranges are numbered and shifted by their predecessors' sizes."""
    s = cut(u.repartitionByRange("seq").sortWithinPartitions("seq").withColumn("_at", F.monotonically_increasing_id()), "ids")
    s = s.withColumn("_p", F.shiftright("_at", 33))
    sizes = s.groupBy("_p").agg(F.count("*").alias("n"))  # one row a partition
    w = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_p", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_shift"))
    own = F.col("_at").bitwiseAND((1 << 33) - 1) + 1  # its place in its range
    return s.join(F.broadcast(shift), "_p").select((own + F.col("_shift")).cast("bigint").alias("unitig_id"), *[c for c in u.columns])


def info(u: DataFrame, k: int) -> DataFrame:
    return u.agg(F.lit(k).alias("k"), F.coalesce(F.sum("n_kmers"), F.lit(0)).alias("n_kmers"), F.count("*").alias("n_unitigs"), F.coalesce(F.sum(F.char_length("seq")), F.lit(0)).cast("bigint").alias("length"))


def kmers_of(u: DataFrame, k: int) -> DataFrame:
    """kmer of every unitig, canonical."""
    return with_kmers(u.select("seq"), k).select(canonical(F.col("kmer")).alias("kmer"))


def unitig_kmers(u: DataFrame, k: int) -> DataFrame:
    """kmer (canonical), unitig_id, upos, fwd: the index from k-mers to unitigs."""
    return with_kmers(u.select("unitig_id", "seq"), k).select(canonical(F.col("kmer")).alias("kmer"), "unitig_id", F.col("pos").alias("upos"), (F.col("kmer") == canonical(F.col("kmer"))).alias("fwd"))


def _met(u: DataFrame, k: int, data: DataFrame, how: str = "inner") -> DataFrame:
    """The k-mers of unitigs (unitig_id, upos, fwd) with the rows of data, whose k-mers are kmer, or code (packed). Packed ones are joined as numbers."""
    if "code" in data.columns:
        return counts.placed_kmers(u, k, "unitig_id").withColumnRenamed("pos", "upos").join(data, "code", how)
    return unitig_kmers(u, k).join(data, "kmer", how)


def edges(u: DataFrame, k: int) -> DataFrame:
    """src, src_fwd, dst, dst_fwd: (k-1)-overlaps of oriented unitigs, each with its reverse twin."""
    both = u.select("unitig_id", F.explode(F.array(F.struct(F.lit(True).alias("fwd"), F.col("seq").alias("s")), F.struct(F.lit(False).alias("fwd"), revcomp(F.col("seq")).alias("s")))).alias("x")).select("unitig_id", "x.fwd", "x.s")
    a = both.select(F.col("unitig_id").alias("src"), F.col("fwd").alias("src_fwd"), F.right("s", F.lit(k - 1)).alias("x"))
    b = both.select(F.col("unitig_id").alias("dst"), F.col("fwd").alias("dst_fwd"), F.substring(F.col("s"), F.lit(1), F.lit(k - 1)).alias("x"))
    return a.join(b, "x").select("src", "src_fwd", "dst", "dst_fwd")


def simplify(u: DataFrame, e: DataFrame, k: int, isolated: bool = True, clip_tips: bool = True) -> DataFrame:
    """k-mers of the graph without its short unitigs (fewer than k k-mers) that have no neighbour, or one, in a single pass."""
    out = e.groupBy(F.col("src").alias("unitig_id")).agg(F.count("*").alias("deg"))
    deg = u.join(out, "unitig_id", "left").withColumn("deg", F.coalesce("deg", F.lit(0)))
    low = F.lit(False)
    if isolated:
        low = low | (F.col("deg") == 0)
    if clip_tips:
        low = low | (F.col("deg") == 1)
    return kmers_of(deg.where(~((F.col("n_kmers") < k) & low)), k)


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """kmer, or code where the k-mers are packed."""
    c = "code" if "code" in a.columns else "kmer"
    return a.select(c).union(b.select(c)).distinct()


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """kmer, or code where the k-mers are packed."""
    c = "code" if "code" in a.columns else "kmer"
    return a.select(c).join(b.select(c), c, "left_anti")


def remove(u: DataFrame, gone: DataFrame, k: int) -> DataFrame:
    """k-mers of the graph without the unitigs whose unitig_id is in gone; `unitigs` joins what is left of their neighbours."""
    return kmers_of(u.join(gone.select("unitig_id"), "unitig_id", "left_anti"), k)


def updated(u: DataFrame, k: int, added: DataFrame | None = None, gone: DataFrame | None = None) -> DataFrame:
    """unitig_id, seq, n_kmers, circular, old: the graph u with the k-mers of added (kmer) and without the unitigs of gone (unitig_id).

    Only what is touched is compacted anew: unitigs that hold a (k-1)-mer at which a k-mer comes or goes. They are split and joined together with
    the new k-mers; the end k-mers of their neighbours go along, so that every branch is seen, and come out as they were. All other rows keep their
    ids (old is true), new ones get ids after the largest. Data of unitigs stay with the ids; `carried` gives those of the new ones. u: unitig_id, seq,
    n_kmers, circular. The graph itself is scanned, not shuffled, while what comes and goes is few.
    """
    ends = lambda c: F.array(canonical(F.substring(c, F.lit(1), F.lit(k - 1))), canonical(F.right(c, F.lit(k - 1))))
    rest, parts = u, []
    if gone is not None:
        lost = u.join(small(gone.select("unitig_id").distinct()), "unitig_id", "left_semi")
        rest = u.join(small(gone.select("unitig_id").distinct()), "unitig_id", "left_anti")
        parts.append(lost.select(F.explode(ends(F.col("seq"))).alias("x")))
    new = None
    if added is not None:
        new = cut(added.select(canonical(F.col("kmer")).alias("kmer")).distinct(), "added")
        known = kmers_of(rest, k).join(small(new), "kmer", "left_semi").distinct()
        new = cut(new.join(known, "kmer", "left_anti"), "new-kmers")
        parts.append(new.select(F.explode(ends(F.col("kmer"))).alias("x")))
    if not parts:
        raise ValueError("added or gone is needed")
    at = cut((parts[0] if len(parts) == 1 else parts[0].union(parts[1])).distinct(), "changed-ends")
    hit = with_kmers(rest.select("unitig_id", "seq"), k - 1).select("unitig_id", canonical(F.col("kmer")).alias("x")).join(small(at), "x", "left_semi").select("unitig_id").distinct()
    rest = cut(rest.join(hit.withColumn("_hit", F.lit(True)), "unitig_id", "left").withColumn("_hit", F.col("_hit").isNotNull()), "touched")
    mine, kept = rest.where("_hit"), rest.where("not _hit")
    borders = mine.select(F.explode(ends(F.col("seq"))).alias("x")).distinct()
    near = kept.select(F.explode(F.array(*(F.struct(canonical(e).alias("x"), canonical(x).alias("kmer")) for e, x in ((F.substring("seq", 1, k - 1), F.substring("seq", 1, k)), (F.right("seq", F.lit(k - 1)), F.right("seq", F.lit(k))))))).alias("e")).select("e.x", "e.kmer")
    near = cut(near.join(small(borders), "x", "left_semi").select("kmer").distinct(), "neighbours")
    work = kmers_of(mine, k)
    work = work if new is None else work.union(new)
    made = unitigs(cut(work.union(near).distinct(), "work"), k)
    # what begins with a neighbour's end k-mer is a neighbour's and is there already
    made = made.withColumn("_first", canonical(F.substring("seq", 1, k))).join(near, F.col("_first") == near["kmer"], "left_anti").select("seq", "n_kmers", "circular")
    top = u.agg(F.max("unitig_id")).first()[0] or 0
    made = with_ids(made).withColumn("unitig_id", F.col("unitig_id") + F.lit(top))
    cols = ["unitig_id", "seq", "n_kmers", "circular"]
    return kept.select(*cols, F.lit(True).alias("old")).unionByName(made.select(*cols, F.lit(False).alias("old")))


def merge_colors(a: DataFrame, b: DataFrame, n_colors_a: int) -> DataFrame:
    """Colours of b follow those of a."""
    return a.select("kmer", "color").union(b.select("kmer", (F.col("color") + n_colors_a).alias("color"))).distinct()


def equal(a: DataFrame, b: DataFrame, colored: bool = False) -> bool:
    """The same k-mers, of the same length as they are compared whole; colored: with the same colours (kmer, color)."""
    cols = ["kmer", "color"] if colored else ["kmer"]
    x, y = a.select(*cols).distinct(), b.select(*cols).distinct()
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def unitig_colors(u: DataFrame, kmer_colors: DataFrame, k: int) -> DataFrame:
    """unitig_id, color, n (k-mers of the colour), whole (all of them have it)."""
    km = _met(u, k, kmer_colors).groupBy("unitig_id", "color").agg(F.count("*").alias("n"))
    return km.join(u.select("unitig_id", "n_kmers"), "unitig_id").select("unitig_id", "color", "n", (F.col("n") == F.col("n_kmers")).alias("whole"))


def unitig_color_counts(u: DataFrame, sample_counts: DataFrame, k: int) -> DataFrame:
    """unitig_id, color, n (k-mers of the colour), whole (all of them have it), mean_cnt, min_cnt, max_cnt. sample_counts: color, kmer, cnt."""
    km = unitig_kmers(u, k).join(sample_counts.where("cnt > 0").select("color", "kmer", "cnt"), "kmer")
    c = km.groupBy("unitig_id", "color").agg(F.count("*").alias("n"), F.avg("cnt").alias("mean_cnt"), F.min("cnt").alias("min_cnt"), F.max("cnt").alias("max_cnt"))
    return c.join(u.select("unitig_id", "n_kmers"), "unitig_id").select("unitig_id", "color", "n", (F.col("n") == F.col("n_kmers")).alias("whole"), "mean_cnt", "min_cnt", "max_cnt")


def color_info(u: DataFrame, kmer_colors: DataFrame, k: int, g: int) -> DataFrame:
    """info with g, the number of colours and their sorted names."""
    names = kmer_colors.agg(F.sort_array(F.collect_set("color")).alias("colors"))  # as many as sequence files
    return info(u, k).withColumn("g", F.lit(g)).join(names.select(F.lit(k).alias("k"), F.size("colors").alias("n_colors"), "colors"), "k")


def colors_between(u: DataFrame, kmer_colors: DataFrame, k: int, ranges: DataFrame) -> DataFrame:
    """unitig_id, first, last, color, n, whole: the colours on the k-mers first to last (from 1) of a unitig. ranges: unitig_id, first, last."""
    km = unitig_kmers(u, k).join(ranges, "unitig_id").where(F.col("upos").between(F.col("first"), F.col("last")))
    c = km.join(kmer_colors, "kmer").groupBy("unitig_id", "first", "last", "color").agg(F.count("*").alias("n"))
    return c.withColumn("whole", F.col("n") == F.col("last") - F.col("first") + 1)


def carried(u: DataFrame, old: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """unitig_id, old_id, first, last, n, same_strand and the columns of data: what the unitigs of a former graph bring into u.

    A row for each unitig of u and each of old that share k-mers: their places in the unitig of u (from 1), their number, and
    whether most of them lie on the same strand in both. data: old_id and any columns. A unitig that was joined of several has a row of each, one that
    was split gives a row to each of its parts, new ones without a forerunner have none: aggregate by unitig_id to combine
    the data, as by first to concatenate it in order.
    """
    was = unitig_kmers(old, k).select("kmer", F.col("unitig_id").alias("old_id"), F.col("fwd").alias("old_fwd"))
    rows = unitig_kmers(u, k).join(was, "kmer").groupBy("unitig_id", "old_id").agg(
        F.min("upos").alias("first"), F.max("upos").alias("last"), F.count("*").alias("n"), (2 * F.count_if(F.col("fwd") == F.col("old_fwd")) >= F.count("*")).alias("same_strand"))
    return rows.join(data, "old_id")


def unitig_coverage(u: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """unitig_id, mean_cnt, min_cnt, max_cnt over the counts of its k-mers, 0 where missing. counts: kmer or code, cnt."""
    c = _met(u, k, counts.select("code" if "code" in counts.columns else "kmer", "cnt"), "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    return c.groupBy("unitig_id").agg(F.avg("cnt").alias("mean_cnt"), F.min("cnt").alias("min_cnt"), F.max("cnt").alias("max_cnt"))


def covered_runs(u: DataFrame, counts: DataFrame, k: int, least: int) -> DataFrame:
    """unitig_id, first, last: runs of consecutive k-mers with `least` or more (gaps and islands)."""
    c = _met(u, k, counts.where(F.col("cnt") >= least).select("code" if "code" in counts.columns else "kmer"), "left_semi")
    c = c.withColumn("island", F.col("upos") - F.row_number().over(Window.partitionBy("unitig_id").orderBy("upos")))
    return c.groupBy("unitig_id", "island").agg(F.min("upos").alias("first"), F.max("upos").alias("last")).drop("island")


def components(e: DataFrame) -> DataFrame:
    """unitig_id, component (its smallest unitig_id), by alternating large and small stars over the edges."""
    pairs = cut(e.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct(), "stars")
    key = lambda x: x.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h")).first()
    was = key(pairs)
    while was["n"]:
        near = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = cut(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "stars")
        now = key(pairs)
        if now == was:
            break
        was = now
    c = pairs.select(F.col("u").alias("unitig_id"), F.col("v").alias("component"))
    return c.union(pairs.select(F.col("v").alias("unitig_id"), F.col("v").alias("component"))).distinct()
