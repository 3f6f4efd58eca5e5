"""How filters interact: packed bitmaps of what fails, counted for every set of filters that may come before.

Each task packs its rows' failures, labels and parts into bits; what is left after a set of filters is an AND-NOT, counts
are popcounts, and the tasks' counts are summed. Any order of the filters is a chain of such sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, id_type, load, written

#: The filters in the order of their bits.
FILTERS = "ABCDE"
_UPPER, _SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
_GOOD, _TOXIC = len(FILTERS), len(FILTERS) + 1


def failures(text: str) -> int:
    """Bits of the filters A to D that a text fails: under 100 words, under 80 % distinct words, over 10 % capitals, a symbol."""
    b = text.encode("utf-8", "surrogatepass")
    words = b.split()  # at blanks and the ASCII controls 9 to 13
    capitals = len(b) - len(b.translate(None, _UPPER))
    return (len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1 | (100 * capitals > 10 * len(text)) << 2 | (len(b.translate(None, _SYMBOLS)) < len(b)) << 3


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, bits: of each document its lang (null: empty) and the bits of the filters A to E that it fails, of quality 1 and of toxic 1.

    E fails where a smaller doc_id has the same text (SHA-256), null being the empty text; rows of one id do not fail by each
    other, rows without an id neither fail nor make others fail. A document with several labels has what one of them says.
    Texts are read once; only digests are grouped, with partial minima, and no join key repeats within a group of copies.
    """
    kind = id_type(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            digest = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array([failures(t) for t in texts], pa.int32()), pa.array(digest, pa.binary())], names=["doc_id", "part", "bits", "digest"])

    slim = docs.select(F.col("doc_id").cast(kind).alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text")
    slim = written(bounded_batches(slim).mapInArrow(run, f"doc_id {kind}, part string, bits int, digest binary"), "filter-flags")
    first = slim.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    one = lambda c: F.max((F.col(c) == 1).cast("int"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast(kind).alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    d = slim.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    copy = (F.col("doc_id").isNotNull() & F.col("first").isNull()).cast("int")
    bit = lambda x, n: F.shiftleft(F.coalesce(x, F.lit(0)), n)
    return d.select("part", F.col("bits").bitwiseOR(bit(copy, 4)).bitwiseOR(bit(F.col("good"), _GOOD)).bitwiseOR(bit(F.col("toxic"), _TOXIC)).alias("bits"))


def bitmap_counts(parts: list[str], bits: np.ndarray) -> dict[tuple[str, int, int], np.ndarray]:
    """(part, filters before as bits, filter): removed, kept, good and toxic removed."""
    column = [np.packbits((bits >> i & 1).astype(bool)) for i in range(_TOXIC + 1)]
    names, of = np.unique(np.array(parts, object), return_inverse=True)
    out = {}
    pop = lambda x: int(np.bitwise_count(x).sum())
    for n, part in enumerate(names):
        alive = {0: np.packbits(of == n)}
        for before in range(1 << len(FILTERS)):
            if before:
                last = before.bit_length() - 1
                alive[before] = alive[before ^ 1 << last] & ~column[last]
            for f in range(len(FILTERS)):
                if not before >> f & 1:
                    gone = alive[before] & column[f]
                    removed = pop(gone)
                    out[part, before, f] = np.array([removed, pop(alive[before]) - removed, pop(gone & column[_GOOD]), pop(gone & column[_TOXIC])])
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for each part and order of the filters.

    Rows as in `flagged`; other columns are ignored. An empty table has no parts and gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for b in batches:
            for key, n in bitmap_counts(b.column("part").to_pylist(), b.column("bits").to_numpy()).items():
                total[key] = total.get(key, 0) + n
        if total:
            keys = [list(x) for x in zip(*total, strict=True)]
            sums = np.array(list(total.values()), np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int32()), pa.array(keys[2], pa.int32()), *(pa.array(s) for s in sums)], names=["part", "before", "filter", "removed", "kept", "good_lost", "toxic_lost"])

    schema = "part string, before int, filter int, removed long, kept long, good_lost long, toxic_lost long"
    counts = flagged(docs, labels).mapInArrow(run, schema).groupBy("part", "before", "filter").agg(*(F.sum(c).alias(c) for c in ("removed", "kept", "good_lost", "toxic_lost")))
    counts = written(counts, "filter-counts")  # 80 rows a part
    every = (1 << len(FILTERS)) - 1
    orders = [("".join(FILTERS[f] for f in p), step + 1, sum(1 << f for f in p[:step]), f) for p in permutations(range(len(FILTERS))) for step, f in enumerate(p)]
    steps = F.broadcast(docs.sparkSession.createDataFrame(orders, "filter_order string, step int, before int, filter int"))  # 600 rows
    alone = lambda before, name: counts.where(F.col("before") == before).select("part", "filter", F.col("removed").alias(name))
    fails = alone(F.lit(0), "fails").join(alone(F.lit(every) - F.call_function("shiftleft", F.lit(1), F.col("filter")), "unique_fails"), ["part", "filter"])
    rows = counts.join(steps, ["before", "filter"])
    fails = fails.join(rows.groupBy("part", "filter").agg(F.sum("removed").alias("shapley")), ["part", "filter"])
    return rows.join(fails, ["part", "filter"]).select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


OP12_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
first AS (SELECT t, min(doc_id) AS least FROM w GROUP BY t),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, CAST(len(words) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 80 * len(words) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INT)
  + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > least, false) AS INT) AS bits, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w JOIN first USING (t) LEFT JOIN marks USING (doc_id)),
g AS (SELECT part, bits, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY ALL),
f AS (SELECT i AS f, chr(CAST(65 + i AS INT)) AS name, CAST(1 << i AS INT) AS bit FROM range(5) r(i)),
orders AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps AS (SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before FROM orders, range(1, 6) r(step)),
x AS (SELECT part, filter_order, step, bit, CAST(sum(CASE WHEN bits & (before | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN bits & before = 0 AND bits & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN bits & before <> 0 AND bits & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN bits = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN bits & before = 0 AND bits & bit <> 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN bits & before = 0 AND bits & bit <> 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM g, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM x
"""


def op12_filter_audit(spark, sf_dir):
    return audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
