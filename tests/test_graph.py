"""Golden reads: linear, SNP, three and four alleles, indel, reverse strand, nested, tip, cycle."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import kmers as km
from strandloom.operators import align, bubbles, counts, graph, search
from strandloom.plans import ploidy
from strandloom.session import cut

B = "GCTAAAGACAATTACATAACATACACGTCAGCACGAAACTTGTTGGCCCAGTGTGAATCGCTTAAGGGTTAA"
K = 11


def at(s, i, b):
    return s[:i] + b + s[i + 1 :]


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


SNP = at(B, 35, "C")


def build(spark, reads):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(reads)], "read_id int, seq string")
    c = cut(counts.count_kmers(df, K))
    u = cut(graph.with_ids(graph.unitigs(c.select("kmer"), K)))
    return c, u, cut(graph.edges(u, K))


@pytest.mark.parametrize(
    ("reads", "distinct", "total", "lengths"),
    [
        ([B], 62, 62, [72]),
        ([B, SNP], 73, 124, [21, 21, 35, 36]),
        ([B, SNP, at(B, 35, "G")], 84, 186, [21, 21, 21, 35, 36]),
        ([B, B[:34] + B[37:]], 72, 121, [20, 23, 34, 35]),
        ([B, rc(SNP)], 73, 124, [21, 21, 35, 36]),
        ([B, at(at(B, 30, "A"), 36, "C")], 79, 124, [27, 27, 30, 35]),
        ([B, SNP, at(SNP, 41, "A")], 84, 186, [15, 16, 16, 21, 21, 30, 35]),
        ([B, B[:40] + "AA"], 64, 94, [12, 40, 42]),
    ],
)
def test_golden_unitigs(spark, reads, distinct, total, lengths):
    c, u, _ = build(spark, reads)
    assert c.agg(F.count("*"), F.sum("cnt")).first()[:] == (distinct, total)
    assert sorted(len(r.seq) for r in u.collect()) == lengths
    # the unitigs' k-mers are the graph's, each once
    assert sorted(r.kmer for r in graph.kmers_of(u, K).collect()) == sorted(r.kmer for r in c.collect())


def test_snp_bubble_to_frequencies(spark):
    c, u, e = build(spark, [B] * 12 + [SNP] * 24)
    b = bubbles.simple_bubbles(u, e).collect()
    assert len(b) == 1 and b[0].n_branches == 2
    sup = bubbles.superbubbles(e, graph.components(e)).collect()
    assert len(sup) == 2 and all(x.is_simple and not x.is_complex for x in sup)
    rows = ploidy.site_tables({"k": K, "unitigs": u, "edges": e}, c, 0, 10_000).collect()
    assert len(rows) == 1 and sorted(rows[0].cov) == [12.0, 24.0] and rows[0].indel_size == 0 and rows[0].var_num == 1


def test_indel_and_nested_bubbles(spark):
    c, u, e = build(spark, [B, B[:34] + B[37:]])
    r = ploidy.site_tables({"k": K, "unitigs": u, "edges": e}, c, 0, 100).collect()
    assert [x.indel_size for x in r] == [3]
    _, u, e = build(spark, [B, SNP, at(SNP, 41, "A")])
    sup = [x for x in bubbles.superbubbles(e, graph.components(e)).collect() if len(x.members) > 4]
    assert len(sup) == 2 and not any(x.is_simple for x in sup)


def test_cycle_is_cut_once(spark):
    s = "ACGGTCATTGCAGGATC"  # a circular sequence: read round twice
    _, u, _ = build(spark, [s + s[: K - 1]])
    rows = u.collect()
    assert [(r.n_kmers, r.circular) for r in rows] == [(len(s), True)]


def test_tip_is_clipped_and_even_k_refused(spark):
    _, u, e = build(spark, [B, B[:40] + "AA"])
    left = graph.unitigs(cut(graph.simplify(u, e, K)), K).collect()
    assert sorted(len(r.seq) for r in left) == [72]
    with pytest.raises(ValueError):
        graph.unitigs(u, 10)


def test_merge_is_union(spark):
    a, ua, _ = build(spark, [B])
    b, _, _ = build(spark, [SNP])
    both, _, _ = build(spark, [B, SNP])
    assert graph.equal(graph.merge(a, b), both) and not graph.equal(a, b)


def test_cutoffs_by_hand(spark):
    h = spark.createDataFrame([(i + 1, f) for i, f in enumerate([100, 40, 20, 10, 15, 30])], "cov int, freq bigint")
    assert counts.cutoffs(h, quantile=0.5).first()[:] == (10, 3)


def test_presence_with_one_edit(spark):
    g = build(spark, [B])[0].select("kmer")
    q = [(1, B[5:40]), (2, at(B[5:40], 17, "A" if B[22] != "A" else "C")), (3, B[5:20] + B[21:40]), (4, "ACG"), (5, "T" * 20)]
    df = spark.createDataFrame(q, "id int, seq string")
    exact = {r.id: r.present for r in search.presence(df, g, K, 0.9, "id").collect()}
    loose = {r.id: r.present for r in search.presence(df, g, K, 0.9, "id", sub=True, ins=True, dele=True).collect()}
    assert exact == {1: 1, 2: 0, 3: 0, 4: 0, 5: 0} and loose == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0}
    with pytest.raises(ValueError):
        search.presence(df, g, K, 1.5, "id")


def test_alignment():
    assert align.align("ACGT", "ACGT")[:2] == ("ACGT", "ACGT")
    a, b, _ = align.align("ACGTACGTAA", "ACGTGTAA")
    assert a.replace("-", "") == "ACGTACGTAA" and b.replace("-", "") == "ACGTGTAA" and align.variants(a, b)["n_indel"] == 1
    rows = align.align_all(["ACGTACGTAA", "ACGTCCGTAA", "ACGTGTAA"])
    assert len({len(r) for r in rows}) == 1


def _plain(a, b, low=-(10**9)):
    """The score and the alignment of a and b, cell by cell."""
    best = {(0, 0, "D"): (0, None)}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            for move, pi, pj in (("L", i, j - 1), ("U", i - 1, j), ("D", i - 1, j - 1)):
                step = -3 if move != "D" else 2 if i and j and a[i - 1] == b[j - 1] else -1
                came = [(best[pi, pj, x][0] + (x == move and (pi, pj) != (0, 0)), -n, x) for n, x in enumerate("LUD") if (pi, pj, x) in best]
                if came:
                    top = max(came)
                    best[i, j, move] = (top[0] + step, top[2])
    i, j = len(a), len(b)
    move = max((x for x in "DUL" if (i, j, x) in best), key=lambda x: (best[i, j, x][0], "DUL".index(x)))
    total, x, y = best[i, j, move][0], "", ""
    while i or j:
        before = best[i, j, move][1]
        x, y = (a[i - 1] if move != "L" else "-") + x, (b[j - 1] if move != "U" else "-") + y
        i, j, move = i - (move != "L"), j - (move != "U"), before
    return x, y, total


def test_alignment_against_brute_force():
    rng = random.Random(8)
    for n in range(120):
        a = "".join(rng.choice("ACGT"[: 2 + n % 3]) for _ in range(rng.randint(0, 25)))
        b = "".join(rng.choice([c, c, c, "", "AC", "T"]) for c in a) if n % 2 else "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 25)))
        assert align.align(a, b) == _plain(a, b)


def test_items_are_aligned_whole(spark, tmp_path):
    from strandloom.plans import queries

    rng = random.Random(2)
    texts = {i: "".join(rng.choice("acgt") for _ in range(n)) for i, n in ((1, 200), (2, 95), (3, 29), (4, 60))}
    spark.createDataFrame(list(texts.items()), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {i: {} for i in texts}
    for r in queries.aligned_sites(spark, str(tmp_path)).collect():
        got[r.bubble_id].setdefault(r.site_idx, {})[r.path_no] = (r.context, r.indel_size, r.var_num)
    seqs = dict(queries.items(spark, str(tmp_path)).collect())
    for i, a in seqs.items():
        b = "".join("TGCA"["ACGT".index(c)] if p % 30 == 29 else c for p, c in enumerate(a))
        x, y = sorted((a, b), reverse=True)
        want = [{0: (x[p - 10 : p + 1], 0, len(a) // 30), 1: (y[p - 10 : p + 1], 0, len(a) // 30)} for p in range(29, len(a), 30)]
        assert [got[i][n] for n in sorted(got[i])] == want


def test_kmers_skip_other_letters_and_round_trip(spark):
    df = spark.createDataFrame([(1, "ACGTNACGTA"), (2, None), (3, "AC"), (4, "acgt" * 300)], "id int, seq string")
    got = km.with_kmers(df, 4).groupBy("id").count().collect()
    assert {r.id: r["count"] for r in got} == {1: 3, 4: 1197}
    x = km.with_kmers(df, 4).where("id = 1").withColumn("d", km.decode(km.encode(F.col("kmer")), 4))
    assert all(r.d == r.kmer for r in x.collect())


def plain_counts(reads):
    out = {}
    for r in reads:
        for i in range(len(r) - K + 1):
            x = min(r[i : i + K], rc(r[i : i + K]))
            out[x] = out.get(x, 0) + 1
    return out


def means(reads):
    """Mean counts of the k-mers that only B and only SNP have."""
    c, own = plain_counts(reads), [set(plain_counts([x])) for x in (B, SNP)]
    return [sum(c.get(x, 0) for x in a - b) / len(a - b) for a, b in (own, own[::-1])]


def test_simple_bubbles_take_branch_means(spark):
    part = SNP[29:60]
    reads = [B] * 12 + [SNP] * 24 + [part] * 7
    c, u, e = build(spark, reads)
    g = {"k": K, "unitigs": u, "edges": e}
    want = sorted(means(reads), reverse=True)
    assert want[0] not in (24, 31)  # neither the count of a context k-mer
    r = ploidy.site_tables(g, c, 0, 10_000).collect()
    assert len(r) == 1 and [round(x, 9) for x in r[0].cov] == [round(x, 9) for x in want] and r[0].is_simple == 1
    lens = sorted(len(x.seq) for x in u.collect() if len(x.seq) != 2 * K - 1)
    assert r[0].var_dis == lens[0]  # the only site: the shorter of entrance and exit
    assert ploidy.site_tables(g, c, 12, 10_000).collect() == []  # the least count of a branch is 12


def test_two_samples_from_graph_to_association(spark):
    samples = [[B] * 10 + [SNP] * 20, [B] * 30 + [SNP] * 5]
    _, u, e = build(spark, sum(samples, []))
    rows = [(color, kmer, n) for color, reads in enumerate(samples) for kmer, n in plain_counts(reads).items()]
    every = spark.createDataFrame(rows, "color int, kmer string, cnt long")
    limits = spark.createDataFrame([(0, 0, 100), (1, 0, 100)], "color int, low int, up int")
    g = {"k": K, "unitigs": u, "edges": e}
    got = {r.color: r for r in ploidy.multi_site_tables(g, every, limits, 2).collect()}
    assert sorted(got) == [0, 1] and {tuple(sorted(r.cov)) for r in got.values()} == {(10, 20), (5, 30)}
    x, y = got[0].cov, got[1].cov
    n = sum(x) + sum(y)
    chi = sum((v - (a + b) * s / n) ** 2 / ((a + b) * s / n) for a, b in zip(x, y, strict=True) for v, s in ((a, sum(x)), (b, sum(y))))
    assert all(abs(r.cramer_v - (chi / n) ** 0.5) < 1e-9 and r.n_alleles == 2 and r.is_simple == 1 for r in got.values())
    # a colour that the entrance lacks, and bounds that a branch's count is outside of
    assert ploidy.multi_site_tables(g, every.where(~((F.col("color") == 1) & (F.col("kmer") == min(B[:K], rc(B[:K]))))), limits, 2).count() == 0
    tight = spark.createDataFrame([(0, 0, 100), (1, 5, 100)], "color int, low int, up int")
    assert ploidy.multi_site_tables(g, every, tight, 2).count() == 0


def test_distances_end_at_entrance_and_exit():
    assert align.distances([], 9, 9) == []
    assert align.distances([4], 9, 7) == [7]
    assert align.distances([4, 6, 30], 9, 7) == [1, 1, 7]
