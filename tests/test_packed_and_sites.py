"""Packed k-mers, levelled samples, FASTQ in splits, sites of several samples, and ploidies from noisy frequencies."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import kmers as km
from strandloom.operators import counts, gmm, graph, sites
from strandloom.sources import files


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def plain(seqs, k):
    out = {}
    for s in seqs:
        s = (s or "").upper()
        for i in range(len(s) - k + 1):
            x = s[i : i + k]
            if set(x) <= set("ACGT"):
                x = min(x, rc(x))
                out[x] = out.get(x, 0) + 1
    return out


@pytest.mark.parametrize("k", [1, 2, 11, 15, 16, 25, 31])
@pytest.mark.parametrize("small", [False, True])
def test_packed_counts_equal_strings(spark, monkeypatch, k, small):
    if small:
        monkeypatch.setattr(counts, "BLOCK", 7)
        monkeypatch.setattr(counts, "GATHERED", 20)
    rng = random.Random(k)
    seqs = ["".join(rng.choice("ACGTacgtNé"[: rng.choice((4, 8, 10))]) for _ in range(rng.randint(0, 90))) for _ in range(30)] + [None, "", "ACGT" * 30]
    df = spark.createDataFrame([(i, s, i % 3 or None) for i, s in enumerate(seqs)], "id int, seq string, part int").repartition(3)
    assert {r.kmer: r.cnt for r in counts.count_kmers(df, k).collect()} == plain(seqs, k)
    got = {(r.part, r.kmer): r.cnt for r in counts.count_kmers(df, k, ("part",)).collect()}
    assert got == {(p, x): n for p in (None, 1, 2) for x, n in plain([s for i, s in enumerate(seqs) if (i % 3 or None) == p], k).items()}


@pytest.mark.parametrize("k", [5, 25, 31])
def test_packed_reverse_complement_and_degrees(spark, k):
    rng = random.Random(2)
    kmers = {min(x, rc(x)) for x in ("".join(rng.choice("ACGT"[: 2 if k > 5 else 4]) for _ in range(k)) for _ in range(300))}
    kmers |= {min(x, rc(x)) for y in list(kmers)[:100] for x in (y[1:] + "A", "C" + y[:-1])}
    df = spark.createDataFrame([(x,) for x in kmers], "kmer string")
    for r in df.select("kmer", km.decode(km.packed_revcomp(km.encode(F.col("kmer")), k), k).alias("rc")).collect():
        assert r.rc == rc(r.kmer)
    every = kmers | {rc(x) for x in kmers}
    want = {x: (sum(x[1:] + b in every for b in "ACGT"), sum(b + x[:-1] in every for b in "ACGT")) for x in kmers}
    assert {r.kmer: (r.out_deg, r.in_deg) for r in graph.degrees(df, k).collect()} == want


def test_levelled_samples_merge_and_estimate(spark):
    rng = random.Random(1)
    base = "".join(rng.choices("ACGT", k=120_000))
    seqs = [base[i : i + 1500] for i in range(0, 118_000, 1000)] + [base[:40_000]]
    c = plain(seqs, 21)
    f0, f1 = len(c), sum(n == 1 for n in c.values())
    df = spark.createDataFrame([(i % 2, s) for i, s in enumerate(seqs)], "part int, seq string").repartition(4)
    e = counts.estimate(counts.levelled_sample(df, 21)).first()
    assert f0 > 1 << 16 and e.level > 0 and abs(e.f0 / f0 - 1) < 0.01 and abs(e.f1 / f1 - 1) < 0.01
    whole = counts.estimate(counts.levelled_sample(df, 21, most=1 << 20), most=1 << 20).first()
    assert (whole.f0, whole.f1, whole.level) == (f0, f1, 0)
    most = 1 << 13
    parts = counts.levelled_sample(df, 21, ("part",), most)
    merged, direct = counts.estimate(parts, most=most).first(), counts.estimate(counts.levelled_sample(df, 21, most=most), most=most).first()
    assert merged == direct and merged.level >= 4
    assert abs(merged.f0 / f0 - 1) < 0.05 and abs(merged.f1 / f1 - 1) < 0.07
    assert counts.estimate(parts, ("part",), most).count() == 2
    assert [tuple(r) for r in counts.estimate(counts.levelled_sample(df.limit(0), 21)).collect()] == [(0, 0, 0)]


@pytest.mark.parametrize("split", ["64", "200", "100000"])
def test_fastq_in_splits(spark, tmp_path, split):
    rng = random.Random(int(split))
    want, text = [], ""
    for i in range(60):
        s = "".join(rng.choice("ACGTN") for _ in range(rng.choice((1, 8, 30, 150))))
        q = "".join(rng.choice("@+I5#") for _ in s)
        want.append((f"r{i}", s, q))
        text += f"@r{i} more\n{s.lower()}\n+{rng.choice(('', 'r'))}\n{q}\n"
    (tmp_path / "a.fastq").write_text(text)
    (tmp_path / "b.fastq").write_text("@z\nAC\n+\n@@\n\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = [tuple(r) for r in files.read_fastq(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(got) == sorted([*want, ("z", "AC", "@@")])


def test_vectors_of_colours_are_dense_and_sites_rejected(spark):
    a, b, c = "AAAAC", "AAACC", "AACCC"
    rows = [(1, 0, a, 2), (1, 1, b, 2), (2, 0, a, 2), (2, 1, c, 2), (3, 0, b, 2), (3, 1, c, 2)]
    s = spark.createDataFrame([(i, 0, n, x, 0, k, 1, 5) for i, n, x, k in rows], "bubble_id long, site_idx int, allele int, context string, indel_size int, n_alleles int, var_num int, var_dis int")
    n = spark.createDataFrame([(0, a, 10), (0, b, 10), (1, b, 10), (0, c, 3), (1, c, 50)], "color int, kmer string, cnt long")
    limits = spark.createDataFrame([(0, 0, 20), (1, 0, 20)], "color int, low int, up int")
    got = [r.asDict() for r in sites.color_site_coverage(s, n, limits, 2).collect()]
    # colour 1 lacks allele 0 of bubble 1; a count of 50 rejects bubbles 2 and 3
    assert got == [{"bubble_id": 1, "site_idx": 0, "color": 0, "n_alleles": 2, "cov": [10.0, 10.0], "indel_size": 0, "var_num": 1, "var_dis": 5, "cramer_v": 0.5}]
    wide = spark.createDataFrame([(0, 0, 20), (1, 0, 60)], "color int, low int, up int")
    assert sorted((r.bubble_id, r.color, r.cov) for r in sites.color_site_coverage(s, n, wide, 2).collect()) == [(1, 0, [10.0, 10.0]), (2, 0, [10.0, 3.0]), (3, 0, [10.0, 3.0]), (3, 1, [10.0, 50.0])]
    assert sites.color_site_coverage(s, n, limits, 3).count() == 0  # a third colour is nowhere


@pytest.mark.parametrize(("ploidy", "sd", "least"), [(4, 0.05, 8), (3, 0.07, 5), (2, 0.05, 8)])
def test_noisy_frequencies_are_called_right(ploidy, sd, least):
    right, free = 0, 0
    for seed in range(8):
        rng = np.random.default_rng(seed)
        peaks = np.arange(1, ploidy) / ploidy
        x = np.concatenate([rng.normal(rng.choice(peaks, 900), sd), rng.uniform(0.02, 0.98, 60)]).clip(0.01, 0.99)
        call = lambda **kw: min((gmm._fit_values(x, np.ones(len(x)), p, 1000, 0.01, **kw) for p in range(2, 11)), key=lambda m: m.aic).ploidy  # noqa: B023,E731
        right += call() == ploidy
        free += call(low_ratio=0, high_ratio=0) == ploidy
    assert right >= least and (ploidy == 2 or free < least)
