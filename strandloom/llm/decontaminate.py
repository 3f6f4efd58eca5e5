"""Benchmark decontamination: a broadcast hash set of test n-grams, probed by every window of every text.

Only DataFrame functions run. The windows of the benchmark are broadcast while there are at most
`BROADCAST_WINDOWS` of them; beyond, the same join is shuffled on the hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bench_words, free_names, small, written

WINDOW = 10
#: Most windows that are broadcast, each with its ten words: about 100 MB.
BROADCAST_WINDOWS = 500_000
#: Hash values set aside for the one row by which each document passes the join; real hits are verified word by word.
PASSES = 1024


def test_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: h, gram, len, classes (ids of distinct item word lists)."""
    items = benchmark.select(bench_words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    n = F.least(F.size("w"), F.lit(window))
    return (
        items.select("w", F.xxhash64("w").alias("class"), n.alias("len"))
        .select("class", "w", "len", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("at"))
        .select("class", "len", F.slice("w", F.col("at"), F.col("len")).alias("g"))
        .groupBy(F.xxhash64("g").alias("h"), F.array_join("g", " ").alias("gram"), "len")
        .agg(F.collect_set("class").alias("classes"))
    )


def document_hits(docs: DataFrame, benchmark: DataFrame, window: int, most: int) -> DataFrame:
    """Per id and text of docs: doc_id, text_hash, n_words, copies (rows), hits (position, length), classes hit."""
    spark = docs.sparkSession
    grams = test_windows(benchmark, window)
    lens = sorted(r[0] for r in grams.select("len").distinct().collect()) or [window]  # at most `window` numbers
    n_grams = grams.limit(most + 1).count()
    passes = spark.range(PASSES).select(F.col("id").alias("h"), F.lit(None).cast("string").alias("gram"), F.lit(0).alias("len"), F.lit(None).cast("array<bigint>").alias("classes"))
    table = grams.union(passes).select(F.col("h").alias("b_h"), F.col("gram").alias("b_gram"), F.col("len").alias("b_len"), "classes")

    words = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), bench_words(F.col("text")).alias("w"))
    words = words.withColumn("n_words", F.size("w").cast("long"))
    probes = words.withColumn("len", F.explode(F.array(*[F.lit(x) for x in lens]))) if len(lens) > 1 else words.withColumn("len", F.lit(lens[0]))
    first = F.when(F.col("len") == lens[0], 0).otherwise(1)
    probes = probes.withColumn("at", F.explode(F.sequence(first, F.greatest(first, F.size("w") - F.col("len") + 1))))
    probes = probes.where((F.col("at") == 0) | (F.col("at") + F.col("len") - 1 <= F.size("w")))
    one_row = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(PASSES))
    probes = probes.withColumn("h", F.when(F.col("at") == 0, one_row).otherwise(F.xxhash64(F.slice("w", F.greatest("at", F.lit(1)), F.col("len")))))
    gram = F.when(F.col("at") > 0, F.array_join(F.slice("w", F.greatest("at", F.lit(1)), F.col("len")), " "))
    if n_grams <= most:
        found = probes.join(F.broadcast(table), F.col("h") == F.col("b_h")).withColumn("gram", gram)
    else:
        found = probes.withColumn("gram", gram).drop("w").join(table, F.col("h") == F.col("b_h"))
    found = found.where(((F.col("at") == 0) & F.col("b_gram").isNull()) | ((F.col("at") > 0) & (F.col("len") == F.col("b_len")) & (F.col("gram") == F.col("b_gram"))))
    return found.groupBy("doc_id", "text_hash", "n_words").agg(
        F.sum(F.when(F.col("at") == 0, 1).otherwise(0)).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("at") > 0, F.struct("at", "len")))).alias("hits"),
        F.array_distinct(F.flatten(F.collect_set("classes"))).alias("classes"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per row of docs: doc_id, text_hash, n_words, n_hit, hits (position, length), item_ids, contaminated.

    A word inside any occurrence of a test window is hit. An item of fewer words than `window`, but
    not none, is one window. Null and wordless texts have no words and no hits; repeated rows are
    returned as often as they come; null ids are kept; other columns are ignored; an empty benchmark
    hits nothing, an empty docs table gives an empty result. Windows that overlap count each word once; items of equal
    words are all listed.
    """
    # written, as it is read for the items as well
    per_doc = written(document_hits(docs, benchmark, window, most), "decontamination")
    # spans that overlap count once
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, x: F.struct(
        F.greatest(acc["end"], x["at"] + x["len"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), x["at"] + x["len"] - F.greatest(acc["end"], x["at"]))).alias("n"),
    )
    per_doc = per_doc.withColumn("n_hit", F.aggregate("hits", zero, step, lambda acc: acc["n"]))
    classes = benchmark.select(bench_words(F.col("text")).alias("bw"), "item_id").where(F.size("bw") > 0).select(F.xxhash64("bw").alias("class"), "item_id").distinct()
    by_doc = (
        per_doc.where(F.size("classes") > 0)
        .select("doc_id", "text_hash", F.explode("classes").alias("class"))
        .join(classes, "class")
        .groupBy("doc_id", "text_hash")
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
        .select(F.col("doc_id").alias("i_doc"), F.col("text_hash").alias("i_hash"), "item_ids")
    )
    out = per_doc.join(by_doc, F.col("doc_id").eqNullSafe(F.col("i_doc")) & (F.col("text_hash") == F.col("i_hash")), "left")
    out = out.withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>")))
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("doc_id", "text_hash", "n_words", "n_hit", "hits", "item_ids", (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the documents that hold a test window; all columns stay.

    Null, empty and wordless texts are clean and stay, as do rows with a null id and a clean text. Rows that share an id are
    judged by their own texts; repeated rows go or stay together. An empty benchmark drops nothing.
    """
    bad_id, bad_hash = free_names(docs, "_bad_id", "_bad_hash")
    bad = document_hits(docs, benchmark, window, BROADCAST_WINDOWS).where(F.size("hits") > 0).select(F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_hash))
    bad = small(written(bad, "decontamination"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col(bad_id)) & (F.xxhash64(docs["text"]) == F.col(bad_hash)), "left_anti")


def op1_decontamination(spark, sf_dir):
    from .common import load

    r = contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return r.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


#: The words of DuckDB are taken by the same character class; windows are joined as strings.
OP1_SQL = r"""
WITH bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM bw WHERE len(w) > 0)),
dw AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w FROM documents),
p AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
      FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM g))),
h AS (SELECT DISTINCT p.doc_id, p.i, p.n, g.item_id FROM p JOIN g USING (n, gram)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
