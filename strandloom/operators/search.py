"""Presence queries: exact and with one substitution, insertion or deletion, overall and per colour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.kmers import BASES, canonical, encode, with_kmers
from strandloom.session import cut, small


def candidates(queries: DataFrame, k: int, key: str, exact: bool = True, sub: bool = False, ins: bool = False, dele: bool = False) -> DataFrame:
    """key, pos, kmer: canonical k-mers that an occurrence at pos may have, with at most one edit.

    A substitution changes one base of the window. An insertion adds one base inside a window of k-1, a deletion
    drops one base inside a window of k+1.
    """
    parts = []
    if exact:
        parts.append(with_kmers(queries, k).select(key, "pos", "kmer"))
    at = lambda w: F.explode(F.sequence(F.lit(1), F.lit(w)))
    base = F.explode(F.array(*[F.lit(b) for b in BASES]))
    left = lambda i: F.substring(F.col("kmer"), F.lit(1), i)
    rest = lambda i: F.substring(F.col("kmer"), i, F.char_length("kmer"))
    if sub:
        w = with_kmers(queries, k).select(key, "pos", "kmer", at(k).alias("i")).select("*", base.alias("b")).where(F.substring(F.col("kmer"), F.col("i"), F.lit(1)) != F.col("b"))
        parts.append(w.select(key, "pos", F.concat(left(F.col("i") - 1), "b", rest(F.col("i") + 1)).alias("kmer")))
    if ins:
        w = with_kmers(queries, k - 1).select(key, "pos", "kmer", at(k - 2).alias("i")).select("*", base.alias("b"))
        parts.append(w.select(key, "pos", F.concat(left(F.col("i")), "b", rest(F.col("i") + 1)).alias("kmer")))
    if dele:
        w = with_kmers(queries, k + 1).select(key, "pos", "kmer", F.explode(F.sequence(F.lit(2), F.lit(k))).alias("i"))
        parts.append(w.select(key, "pos", F.concat(left(F.col("i") - 1), rest(F.col("i") + 1)).alias("kmer")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(key, "pos", canonical(F.col("kmer")).alias("kmer")).distinct()


def check_ratio(ratio: float) -> None:
    if not 0 <= ratio <= 1:
        raise ValueError("ratio must be between 0 and 1")


def known(cand: DataFrame, kmers: DataFrame) -> DataFrame:
    """The distinct rows of kmers (kmer and others) that cand asks for. kmers need be neither counted nor distinct: while the
    distinct candidates are few, they are broadcast and the k-mers are dropped where they are made, before any shuffle. Or a function that gives the
    distinct rows (code and others) of a table of codes, so that tasks look up what they pack."""
    if callable(kmers):  # packed
        cand = cut(cand.select("kmer").distinct().withColumn("code", encode(F.col("kmer"))), "candidates")
        return cand.join(kmers(cand.select("code")), "code").drop("code")
    asked = cut(cand.select("kmer").distinct(), "candidates")
    if "code" in kmers.columns:  # packed
        got = kmers.join(small(asked.select(encode(F.col("kmer")).alias("code"))), "code", "left_semi").distinct()
        return asked.withColumn("code", encode(F.col("kmer"))).join(got, "code").drop("code")
    return kmers.join(small(asked), "kmer", "left_semi").distinct()


def _columns(kmers, *more: str):
    if callable(kmers):
        return lambda asked: kmers(asked).select("code", *more)
    return kmers.select("code" if "code" in kmers.columns else "kmer", *more)


def presence(queries: DataFrame, kmers: DataFrame, k: int, ratio: float, key: str, **edits) -> DataFrame:
    """key, matched (distinct places), needed, present: matched >= floor((length - k + 1) ratio). Shorter queries than k are absent.
    kmers: kmer (canonical), or code (packed), in any number; or a function that gives the codes of a table that are there (see `known`)."""
    check_ratio(ratio)
    need = queries.select(key, F.floor((F.char_length("seq") - k + 1) * F.lit(ratio)).cast("bigint").alias("needed"), (F.char_length("seq") >= k).alias("_long"))
    cand = cut(candidates(queries, k, key, **edits), "places") if callable(kmers) else candidates(queries, k, key, **edits)
    hit = cand.join(known(cand, _columns(kmers)), "kmer").groupBy(key).agg(F.countDistinct("pos").alias("matched"))
    out = need.join(hit, key, "left").withColumn("matched", F.coalesce("matched", F.lit(0)).cast("bigint"))
    return out.select(key, "matched", "needed", F.coalesce(F.col("_long") & (F.col("matched") >= F.col("needed")), F.lit(False)).cast("int").alias("present"))


def presence_by_color(queries: DataFrame, kmer_colors: DataFrame, k: int, ratio: float, key: str, colors: list, color: str = "color", **edits) -> DataFrame:
    """key and a 0/1 column for each of `colors`."""
    check_ratio(ratio)
    need = queries.select(key, F.floor((F.char_length("seq") - k + 1) * F.lit(ratio)).cast("bigint").alias("needed"), (F.char_length("seq") >= k).alias("_long"))
    cand = cut(candidates(queries, k, key, **edits), "places") if callable(kmer_colors) else candidates(queries, k, key, **edits)
    hit = cand.join(known(cand, _columns(kmer_colors, color)), "kmer").groupBy(key, color).agg(F.countDistinct("pos").alias("m"))
    wide = hit.groupBy(key).pivot(color, colors).agg(F.max("m"))
    out = need.join(wide, key, "left")
    one = lambda c: F.coalesce(F.col("_long") & (F.coalesce(F.col(f"`{c}`"), F.lit(0)) >= F.col("needed")), F.lit(False)).cast("int").alias(str(c))
    return out.select(key, *[one(c) for c in colors])


def place_on_unitigs(queries: DataFrame, unitig_kmers: DataFrame, k: int, key: str) -> DataFrame:
    """key, unitig_id, strand, qpos, upos, n_kmers: maximal runs of consecutive k-mers of a query on one unitig (gaps and islands).
    unitig_kmers: kmer (canonical), unitig_id, upos, fwd (the k-mer stands canonical in the unitig)."""
    from pyspark.sql import Window

    q = with_kmers(queries, k).withColumn("c", canonical(F.col("kmer")))
    m = q.join(unitig_kmers.withColumnRenamed("kmer", "c"), "c").withColumn("strand", (F.col("kmer") == F.col("c")) == F.col("fwd"))
    line = F.when(F.col("strand"), F.col("pos") - F.col("upos")).otherwise(F.col("pos") + F.col("upos"))
    m = m.withColumn("line", line)
    w = Window.partitionBy(key, "unitig_id", "strand", "line").orderBy("pos")
    m = m.withColumn("island", F.col("pos") - F.row_number().over(w))
    g = m.groupBy(key, "unitig_id", "strand", "line", "island").agg(F.min("pos").alias("qpos"), F.min("upos").alias("upos"), F.count("*").alias("n_kmers"))
    return g.select(key, "unitig_id", "strand", "qpos", "upos", "n_kmers")
