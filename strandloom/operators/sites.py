"""The table of variant sites: frequencies, distances, association between samples, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.kmers import allele_frequencies, canonical, nonzero_alleles
from strandloom.session import small

#: Branches whose mean coverage makes an allele, at most.
MOST_ALLELES = 5


def simple_coverage(branches: DataFrame, low: int, up: int) -> DataFrame:
    """bubble_id, cov: mean counts of a simple bubble's branches, largest first; the smallest count of each has to be strictly
    within the cut-offs. branches: bubble_id, branch, mean_cnt, min_cnt."""
    g = branches.groupBy("bubble_id").agg(F.bool_and((F.col("min_cnt") > low) & (F.col("min_cnt") < up)).alias("ok"), F.sort_array(F.collect_list(F.col("mean_cnt").cast("double")), asc=False).alias("cov"))
    return g.where("ok").select("bubble_id", "cov")


def frequencies(site_cov: DataFrame, least: int = 2, most: int = MOST_ALLELES) -> DataFrame:
    """bubble_id, site_idx, allele_no, freq of sites with `least` to `most` alleles that have coverage."""
    s = site_cov.where(nonzero_alleles(F.col("cov")).between(least, most))
    return s.select("bubble_id", "site_idx", F.posexplode(allele_frequencies(F.col("cov"))).alias("allele_no", "freq"))


def within_quantile(freq: DataFrame, q: float, strict: bool = False) -> DataFrame:
    """q <= freq <= 1-q, or strictly between."""
    if not 0 <= q <= 0.5:
        raise ValueError("q must be between 0 and 0.5")
    f = F.col("freq")
    return freq.where((f > q) & (f < 1 - q) if strict else f.between(q, 1 - q))


def by_alleles(site_cov: DataFrame) -> DataFrame:
    """n_alleles, n_sites."""
    return site_cov.groupBy("n_alleles").agg(F.count("*").alias("n_sites"))


def variant_distance(sites: DataFrame) -> DataFrame:
    """sites (bubble_id, pos, entrance_len, exit_len) with var_num and var_dis: the gap to the nearest other site; before the first
    and after the last one the lengths of the entrance and the exit count instead."""
    w = Window.partitionBy("bubble_id").orderBy("pos")
    before = F.coalesce(F.col("pos") - F.lag("pos").over(w) - 1, F.col("entrance_len"))
    after = F.coalesce(F.lead("pos").over(w) - F.col("pos") - 1, F.col("exit_len"))
    n = F.count("*").over(Window.partitionBy("bubble_id"))
    return sites.select("bubble_id", "pos", n.alias("var_num"), F.least(before, after).alias("var_dis"))


def cramers_v(x: Column, y: Column) -> Column:
    """Association of two coverage vectors of equal length, sqrt(chi2 / n); 0 where one of them is empty of coverage."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    both = F.zip_with(x, y, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    sx, sy = total(x), total(y)
    n = sx + sy

    def term(s, p):
        col = p["a"] + p["b"]
        ex, ey = col * sx / n, col * sy / n
        return s + F.when(col > 0, (p["a"] - ex) * (p["a"] - ex) / ex + (p["b"] - ey) * (p["b"] - ey) / ey).otherwise(0.0)

    chi = F.aggregate(both, F.lit(0.0), term)
    return F.when((sx > 0) & (sy > 0), F.sqrt(chi / n)).otherwise(0.0)


def association(x: Column) -> Column:
    """The largest Cramer's V of two of an array's elements (color, cov)."""
    every = F.flatten(F.transform(x, lambda a, i: F.transform(F.slice(x, i + 2, F.size(x)), lambda b: cramers_v(a["cov"], b["cov"]))))
    return F.coalesce(F.array_max(every), F.lit(0.0))


def site_association(site_cov: DataFrame, key: tuple[str, ...] = ("bubble_id", "site_idx")) -> DataFrame:
    """key, cramer_v: the largest association of two samples at the site. Colours of a site are few; pairs are made inside its array. Vectors are
    over the same alleles in the same order, 0 where a colour lacks one."""
    g = site_cov.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("color", "cov"))).alias("x"))
    return g.select(*key, association(F.col("x")).alias("cramer_v"))


def every_color(site_cov: DataFrame, n_colors: int, key: tuple[str, ...] = ("bubble_id", "site_idx")) -> DataFrame:
    """The sites at which every colour appears."""
    ok = site_cov.groupBy(*key).agg(F.count_distinct("color").alias("n")).where(F.col("n") == n_colors).select(*key)
    return site_cov.join(ok, list(key), "left_semi")


def color_site_coverage(sites_df: DataFrame, sample_counts: DataFrame, cutoffs: DataFrame, n_colors: int, key: str = "bubble_id") -> DataFrame:
    """key, site_idx, color, n_alleles, cov, indel_size, var_num, var_dis, cramer_v of sites in several samples.

    An allele's coverage in a colour is the sum over its distinct context k-mers. A site counts if every colour has one of its k-mers, and
    is rejected as a whole if any count of any colour is not strictly within that colour's bounds. Colours are compared by vectors over
    all alleles of the site, 0 where a colour lacks one; then alleles without coverage are left out of a colour's row, and a
    colour with fewer than two has none. sites_df: key, site_idx, allele (from 0), context, indel_size, n_alleles, var_num, var_dis. sample_counts: color
    (from 0), kmer, cnt. cutoffs: color, low, up.
    """
    site = [key, "site_idx", "indel_size", "n_alleles", "var_num", "var_dis"]
    c = sites_df.select(*site, "allele", canonical(F.col("context")).alias("kmer")).distinct()
    # the counts that the sites ask for, then the bounds of their colours: one shuffle on the k-mer, one on the site
    j = c.join(sample_counts.where("cnt > 0").select("color", "kmer", "cnt"), "kmer").join(small(cutoffs), "color")
    inside = (F.col("cnt") > F.col("low")) & (F.col("cnt") < F.col("up"))
    a = j.groupBy(*site, "color", "allele").agg(F.sum("cnt").cast("double").alias("c"), F.bool_and(inside).alias("ok"))
    colors = a.groupBy(*site, "color").agg(F.map_from_entries(F.collect_list(F.struct("allele", "c"))).alias("m"), F.bool_and("ok").alias("ok"))
    dense = F.transform(F.sequence(F.lit(0), F.col("n_alleles") - 1), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    s = colors.select(*site, "color", dense.alias("cov"), "ok").groupBy(*site).agg(F.array_sort(F.collect_list(F.struct("color", "cov"))).alias("x"), F.bool_and("ok").alias("ok"))
    s = s.where(F.col("ok") & (F.size("x") == n_colors)).select(*site, "x", association(F.col("x")).alias("cramer_v"))
    rows = s.select(*[x for x in site if x != "n_alleles"], "cramer_v", F.explode("x").alias("y")).withColumn("cov", F.filter("y.cov", lambda v: v > 0))
    return rows.where(F.size("cov") > 1).select(key, "site_idx", F.col("y.color").alias("color"), F.size("cov").alias("n_alleles"), "cov", "indel_size", "var_num", "var_dis", "cramer_v")


def filter_sites(site_cov: DataFrame, low: float = 0, up: float = 1e9, simple_only: bool = False, drop_indel: bool = False, drop_snp: bool = False, most_var_num: int | None = None, least_var_dis: int | None = None, most_indel: int | None = None, sum_cap: bool = False, cramer: float | None = None, color: int | None = None) -> DataFrame:
    """Row filters; bounds are strict. drop_indel keeps indel_size 0, drop_snp keeps the others, both keep nothing. sum_cap: of four
    alleles and more, the first four together have to be under `up` too, as single samples are filtered. cramer: cramer_v over it."""
    ok = F.forall("cov", lambda c: (c > low) & (c < up))
    if sum_cap:
        ok = ok & ((F.size("cov") < 4) | (F.aggregate(F.slice("cov", 1, 4), F.lit(0.0), lambda s, v: s + v) < up))
    s = site_cov.where(ok)
    for wanted, test in ((simple_only, F.col("is_simple") == 1), (drop_indel, F.col("indel_size") == 0), (drop_snp, F.col("indel_size") > 0)):
        if wanted:
            s = s.where(test)
    if most_var_num is not None:
        s = s.where(F.col("var_num") < most_var_num)
    if least_var_dis is not None:
        s = s.where(F.col("var_dis") > least_var_dis)
    if most_indel is not None:
        s = s.where(F.col("indel_size") < most_indel)
    if cramer is not None:
        s = s.where(F.col("cramer_v") > cramer)
    if color is not None:
        s = s.where(F.col("color") == color)
    return s
