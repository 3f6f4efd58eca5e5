import random

import pytest

from strandloom.operators import gmm, sites
from strandloom.sources import files


@pytest.mark.parametrize(("peaks", "p"), [([1 / 2], 2), ([1 / 3, 2 / 3], 3), ([1 / 4, 1 / 2, 3 / 4], 4)])
def test_ploidy_of_drawn_frequencies(spark, peaks, p):
    rng = random.Random(5)
    f = spark.createDataFrame([(round(rng.gauss(m, 0.02), 4),) for m in peaks for _ in range(300)], "freq double")
    fits = gmm.report(spark, gmm.fit_ploidies(f, range(2, 5)))
    assert gmm.best(fits).first().ploidy == p


def test_queries_fit_and_call_every_ploidy(spark, monkeypatch):
    from strandloom.plans import queries

    rng = random.Random(6)
    f = spark.createDataFrame([(round(rng.gauss(i / 8, 0.012), 4),) for i in range(1, 8) for _ in range(300)], "freq double")
    monkeypatch.setattr(queries, "_grouped", lambda *_: f.groupBy("freq").count().withColumnRenamed("count", "n"))
    assert {r.ploidy for r in queries.gmm_fit(spark, "").collect()} == set(range(2, 11))
    assert queries.ploidy_call(spark, "").first().ploidy == 8


def test_driver_and_distributed_fits_agree(spark, monkeypatch):
    rng = random.Random(1)
    f = spark.createDataFrame([(round(rng.gauss(0.5, 0.05), 2),) for _ in range(200)], "freq double")
    a = gmm.fit(f, 3, most_steps=5)
    monkeypatch.setattr(gmm, "MOST_VALUES", 0)
    b = gmm.fit(f, 3, most_steps=5)
    assert b.weights == pytest.approx(a.weights, abs=1e-6) and b.log_likelihood == pytest.approx(a.log_likelihood, abs=1e-5)


def test_cramers_v_by_hand(spark):
    s = spark.createDataFrame([(1, 0, 0, [12.0, 12.0]), (1, 0, 1, [12.0, 24.0]), (2, 0, 0, [0.0, 0.0]), (2, 0, 1, [1.0, 2.0])], "bubble_id int, site_idx int, color int, cov array<double>")
    got = {r.bubble_id: r.cramer_v for r in sites.site_association(s).collect()}
    # expected counts 9.6, 14.4 and 14.4, 21.6
    chi = 2.4**2 * (1 / 9.6 + 1 / 14.4 + 1 / 14.4 + 1 / 21.6)
    assert got[1] == pytest.approx((chi / 60) ** 0.5) and got[2] == 0


def test_sequence_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x\nACGT\nACG\n>two\nGGGT\n")
    (tmp_path / "b.fq").write_text("@r1\nACGT\n+\n@III\n@r2 y\nTTTT\n+r2\nIIII\n")
    (tmp_path / "c.gfa").write_text("H\tVN:Z:1.0\tKL:Z:11\tML:Z:7\nS\t1\tACGTACGTACGT\nL\t1\t+\t1\t-\t10M\n")
    d = files.read_sequences(spark, [str(tmp_path / x) for x in ("a.fa", "b.fq", "c.gfa")])
    assert [(r.color, r.read_id, r.seq, r.qual) for r in d.orderBy("color", "read_id").collect()] == [(0, "one", "ACGTACG", None), (0, "two", "GGGT", None), (1, "r1", "ACGT", "@III"), (1, "r2", "TTTT", "IIII"), (2, "1", "ACGTACGTACGT", None)]
    g = files.read_gfa(spark, str(tmp_path / "c.gfa"))
    assert g["header"].first()[:] == (11, 7) and g["links"].first()[:] == ("1", True, "1", False, "10M")


def test_coverage_round_trip(spark, tmp_path):
    s = spark.createDataFrame([(7, 0, 2, [3.0, 4.5], 1, 0, 2, 0.0, 9)], "bubble_id long, color int, n_alleles int, cov array<double>, is_simple int, indel_size int, var_num int, cramer_v double, var_dis int")
    files.write_coverage(s, str(tmp_path / "bicov"), 2)
    assert files.read_coverage(spark, str(tmp_path / "bicov"), 2).first() == s.first()
