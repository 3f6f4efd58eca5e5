"""How the sources of a language differ in their words: exact counts of frequent terms, behind a sketch.

Each task adds the document frequencies of its texts to the cells of a count-min sketch, and Spark adds up the tasks'
cells; a sketch never underestimates. A term with a cell under the limit cannot be frequent, and tasks drop it before its
counts are shuffled. What passes is counted exactly. Sources are then compared over the terms that they have: what one of two
sources lacks has a constant share there, so only the terms that both have are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, load, written

#: Documents of its language that a kept term is in; ranks of terms.
LEAST_DOCUMENTS, MOST_RANK = 30, 50
#: Rows of the sketch and cells of a row (a power of two). Its bits go to the driver and back to the tasks: ROWS * CELLS / 8 bytes, 1.5 MB.
ROWS, CELLS = 3, 1 << 22
#: Different terms that a task holds before it hands on their counts.
MOST_TERMS = 400_000
_SHARES, _PRIOR = 1_000_000_000, 5
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of a to z and of everything beyond ASCII, A-Z lower-cased, as UTF-8; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def sketch_cells(lang: str, words: list[bytes], cells: int) -> np.ndarray:
    """The cells of each term, a row of them for every row of the sketch, from two halves of one hash."""
    prefix = lang.encode("utf-8", "surrogatepass") + b" "
    h = np.fromiter((xxhash.xxh3_64_intdigest(prefix + w) for w in words), np.uint64, len(words))
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)
    return np.stack([((low + np.uint64(r) * high) & np.uint64(cells - 1)).astype(np.int64) + r * cells for r in range(ROWS)])


def sketched(docs: DataFrame, cells: int) -> DataFrame:
    """cell, n: the sketch of the document frequencies. docs: lang, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def part() -> Iterator[pa.RecordBatch]:
            for lang, counts in seen.items():
                n = np.fromiter(counts.values(), np.int64, len(counts))
                for row in sketch_cells(lang, list(counts), cells):
                    yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(n)], names=["cell", "n"])

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(set(terms(text)))
            if sum(map(len, seen.values())) > MOST_TERMS:
                yield from part()
                seen = {}
        yield from part()

    return bounded_batches(docs.select("lang", "text")).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def frequent_bits(docs: DataFrame, least: int, cells: int) -> np.ndarray:
    """A bit for each cell of the sketch: whether it has `least` documents or more."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("cell").bitwiseAND(31).cast("int"))
    words = sketched(docs, cells).where(F.col("n") >= least).groupBy(F.shiftright("cell", 5).alias("word")).agg(F.bit_or(bit).alias("bits"))
    out = np.zeros(-(-ROWS * cells // 32), np.uint32)
    rows = words.collect()  # a row for 32 cells, so bounded by the sketch's size
    out[[r["word"] for r in rows]] = [r["bits"] for r in rows]
    return out


def possible(lang: str, words: list[bytes], frequent: np.ndarray, cells: int) -> np.ndarray:
    """Whether all cells of each term are frequent."""
    at = sketch_cells(lang, words, cells)
    return (frequent[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1)).all(axis=0)


def counted(docs: DataFrame, frequent: np.ndarray, cells: int) -> DataFrame:
    """lang, source, term, n, df: occurrences of the terms that may be frequent, and the documents that they are in. docs: lang, source, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: dict[tuple[str, str], Counter] = {}
        once: dict[tuple[str, str], Counter] = {}

        def part() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in every.items():
                words = list(counts)
                left = [w for w, ok in zip(words, possible(lang, words, frequent, cells).tolist(), strict=True) if ok]
                df = once[lang, source]
                columns = [pa.array([lang] * len(left), pa.string()), pa.array([source] * len(left), pa.string()), pa.array(left, pa.binary()).cast(pa.string()), pa.array([counts[w] for w in left], pa.int64()), pa.array([df[w] for w in left], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "df"])

        for b in batches:
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                words = terms(text)
                every.setdefault((lang, source), Counter()).update(words)
                once.setdefault((lang, source), Counter()).update(set(words))
            if sum(map(len, every.values())) > MOST_TERMS:
                yield from part()
                every, once = {}, {}
        yield from part()

    rows = bounded_batches(docs.select("lang", "source", "text")).mapInArrow(run, "lang string, source string, term string, n long, df long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (N + 5 V)), exactly."""
    return F.lit(1).cast("long") + F.call_function("div", (count + _PRIOR).cast("decimal(20,0)") * F.lit(_SHARES).cast("decimal(10,0)"), (n + _PRIOR * v).cast("decimal(20,0)"))


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, most_rank: int = MOST_RANK, cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank: of each source of a language its distance to each other one (part pair), and the terms that it has
    more of than the language (part term, to most_rank).

    Null text, lang and source are empty strings; other columns, doc_id among them, are not used, and repeated rows are documents of their
    own. A language without kept terms has pairs of value 0; a source that is its language's only one has none. Equal values are ranked
    by the items' bytes. An empty table gives an empty result.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    d = docs.select(text("lang").alias("lang"), text("source").alias("source"), "text")
    groups = d.select("lang", "source").distinct()
    exact = written(counted(d, frequent_bits(d, least, cells), cells), "term-counts")
    kept = exact.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("df")).where(F.col("df") >= least).select("lang", "term", "lang_n")
    own = written(exact.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "kept-terms")
    langs = own.groupBy("lang").agg(F.count_distinct("term").alias("v"), F.sum("n").alias("lang_total"))
    total = own.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("size"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    g = groups.join(total, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", none("total"), none("size"), none("v"), none("lang_total"))
    g = written(g.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("v"))).otherwise(0)), "groups")
    p = own.join(g, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    best = p.withColumn("value", F.col("p") - q).where("value > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    return ranked(best).where(F.col("rank") <= most_rank).unionByName(ranked(_pairs(g, written(p.select("lang", "source", "term", "p"), "shares"))))


def ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def _pairs(g: DataFrame, p: DataFrame) -> DataFrame:
    """Sums of |p - q| of each two sources of a language, both ways. Had no term both sources, the sum would be that of each one's terms against the
    other's constant share, and the constants' distance for the rest; terms of both are joined and make up the difference."""
    one, two = g.select("lang", *(F.col(c).alias(f"{c}_a") for c in ("source", "size", "p0")), "v"), g.select("lang", *(F.col(c).alias(f"{c}_b") for c in ("source", "size", "p0")))
    pairs = one.join(two, "lang").where("source_a < source_b")
    # distances of each source's terms from the shares that the others give to terms they lack; shares repeat, so they are counted first
    shares = p.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    far = shares.join(g.select("lang", F.col("source").alias("other"), "p0"), "lang").where("source <> other").groupBy("lang", "source", "other").agg(F.sum(F.abs(F.col("p") - F.col("p0")) * F.col("n")).alias("far"))
    a = far.select("lang", F.col("source").alias("source_a"), F.col("other").alias("source_b"), F.col("far").alias("far_a"))
    b = far.select("lang", F.col("other").alias("source_a"), F.col("source").alias("source_b"), F.col("far").alias("far_b"))
    of = g.select("lang", "source", "p0")
    x = p.join(of, ["lang", "source"])
    side = lambda s: x.select("lang", "term", *(F.col(c).alias(f"{c}_{s}") for c in ("source", "p", "p0")))
    distance = F.abs(F.col("p_a") - F.col("p_b")) - F.abs(F.col("p_a") - F.col("p0_b")) - F.abs(F.col("p0_a") - F.col("p_b"))
    both = side("a").join(side("b"), ["lang", "term"]).where("source_a < source_b").groupBy("lang", "source_a", "source_b").agg(F.sum(distance).alias("mend"), F.count("*").alias("both"))
    key = ["lang", "source_a", "source_b"]
    s = pairs.join(a, key, "left").join(b, key, "left").join(both, key, "left").na.fill(0, ["far_a", "far_b", "mend", "both"])
    lacking = F.col("v") - F.col("size_a") - F.col("size_b") + F.col("both")
    s = s.withColumn("value", F.col("far_a") + F.col("far_b") + F.col("mend") + lacking * F.abs(F.col("p0_a") - F.col("p0_b")))
    ways = F.explode(F.array(*(F.struct(F.col(f"source_{x}").alias("source"), F.col(f"source_{y}").alias("item")) for x, y in ("ab", "ba")))).alias("way")
    return s.select("lang", ways, "value").select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
groups AS (SELECT DISTINCT lang, source FROM d),
tf AS (SELECT id, lang, source, term, count(*) AS n FROM (SELECT id, lang, source, unnest(ts) AS term FROM d) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM tf GROUP BY lang, term HAVING count(*) >= 30),
own AS MATERIALIZED (SELECT lang, source, term, CAST(sum(tf.n) AS HUGEINT) AS n FROM tf SEMI JOIN kept USING (lang, term) GROUP BY ALL),
lt AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
gt AS (SELECT lang, source, sum(n) AS total FROM own GROUP BY ALL),
full_p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, CAST(1 + (1000000000 * (coalesce(o.n, 0) + 5)) // (coalesce(gt.total, 0) + 5 * lt.v) AS BIGINT) AS p, CAST(1 + (1000000000 * (k.n + 5)) // (lt.total + 5 * lt.v) AS BIGINT) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN lt ON lt.lang = g.lang LEFT JOIN gt ON gt.lang = g.lang AND gt.source = g.source LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM full_p x JOIN full_p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM full_p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM every) WHERE part = 'pair' OR rank <= 50
"""


def op13_source_divergence(spark, sf_dir):
    return divergence(load(spark, sf_dir, "documents"))
