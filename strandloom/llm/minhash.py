"""Near duplicates by min-max hashing.

Each random permutation gives two signature values, its minimum and its maximum over a document's shingles,
so 64 hash evaluations a shingle give 128 values, banded 32 x 4: a pair of Jaccard similarity 0.8 misses every
band with probability (1 - 0.8^4)^32 = 5e-8. Documents of equal shingle sets are one class before banding.
Every bucket compares its smallest member, its pivot, with the rest. Buckets that are then one component are done.
The others are joined into families by pivot, and the members outside a family's largest component, as queries,
are compared with all its members in blocks, so that no pair of candidates is ever a row of its own.
Candidate links are confirmed on whole shingle sets of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free_names, id_type, load, small, written

PERMUTATIONS, BANDS, ROWS = 64, 32, 4
SHINGLE, SIMILARITY = 5, 0.8
#: About how many members, and shingles of theirs, a block of a family holds: a tile of queries and members fits a task.
BLOCK, BLOCK_SHINGLES = 2000, 1_000_000
#: Pairs of whole texts that go to Python at once.
PAIR_ROWS = 200
_SEED = 0x5EED


def _params() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(_SEED))
    return rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingles(text: str | None, size: int, seen: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words; fewer words are one run; no words, none.

    Words part at blanks and the control characters 9 to 13; A-Z count as a-z. seen: hashes of words met before.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(seen) > 100_000:
        seen.clear()
    get = seen.get
    ids = np.fromiter((get(w) or seen.setdefault(w, xxhash.xxh3_64_intdigest(w) or 1) for w in words), np.uint64, len(words))
    n = max(1, len(ids) - size + 1)
    h = np.full(n, len(ids) if len(ids) < size else size, np.uint64)
    for k in range(min(size, len(ids))):
        h = (h ^ ids[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h = np.sort(h)
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def signature(h: np.ndarray, params: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Minima and maxima of each permutation, paired by permutation."""
    low = np.full(PERMUTATIONS, np.uint64(0xFFFFFFFFFFFFFFFF))
    high = np.zeros(PERMUTATIONS, np.uint64)
    a, b = params
    for at in range(0, len(h), 2048):  # blocks that stay in the cache
        block = h[at : at + 2048][None, :] * a[:, None]
        block += b[:, None]
        block ^= block >> np.uint64(32)
        np.minimum(low, block.min(axis=1), out=low)
        np.maximum(high, block.max(axis=1), out=high)
    # a permutation's minimum and maximum go to different bands: minima fill the first half
    return np.concatenate((low, high))


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(ROWS):
        h = (h ^ rows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, class (hash of the whole set; null without words), bands."""
    kind = id_type(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        params, seen = _params(), {}
        with np.errstate(over="ignore"):
            for pdf in batches:
                n, cls, bands = [], [], []
                for text in pdf["text"]:
                    h = shingles(text, size, seen)
                    n.append(len(h))
                    cls.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                    bands.append(band_keys(signature(h, params)) if len(h) else None)
                ids = pdf["doc_id"].astype("Int64") if kind == "long" else pdf["doc_id"]
                yield pd.DataFrame({"doc_id": ids, "n_shingles": np.array(n, np.int64), "class": cls, "bands": bands})

    return bounded_batches(docs).select(F.col("doc_id").cast(kind).alias("doc_id"), "text").mapInPandas(run, f"doc_id {kind}, n_shingles long, class binary, bands array<long>")


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """Those pairs (a, b) whose whole shingle sets have a Jaccard similarity of `similarity` or more."""
    percent = round(similarity * 100)
    ids = small(pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct())
    texts = docs.select(F.col("doc_id").cast(id_type(docs)).alias("_doc"), "text").join(ids, F.col("_doc") == F.col("_id"), "left_semi")
    texts = written(texts, "minhash-texts")
    both = pairs.join(texts.select(F.col("_doc").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("_doc").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[bytes, int] = {}
        sets: dict[str, np.ndarray] = {}  # of the last few texts: a pivot comes again and again
        with np.errstate(over="ignore"):
            for pdf in batches:
                keep = []
                for text_a, text_b in zip(pdf["text_a"], pdf["text_b"], strict=True):
                    if text_a not in sets:
                        if len(sets) >= 8:
                            sets.clear()
                        sets[text_a] = shingles(text_a, size, seen)
                    x, y = sets[text_a], sets[text_b] if text_b in sets else shingles(text_b, size, seen)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pdf.loc[keep, ["a", "b"]]

    return both.select("a", "b", "text_a", "text_b").mapInPandas(run, f"a {id_type(docs)}, b {id_type(docs)}").distinct()


def across(open_: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links (a, b) between the components of each family. open_: family, id, c, weight (number of shingles).

    The members outside a family's largest component are its queries; they are compared with all members on whole
    shingle sets, a block of queries with a block of members at a time, so no task holds a family. Only links leave a task.
    """
    percent = round(similarity * 100)
    parts = open_.groupBy("family", "c").agg(F.count("*").alias("m"), F.sum("weight").alias("s"))
    whole = parts.groupBy("family").agg(F.sum("m").alias("k"), F.sum("s").alias("s"), F.max(F.struct("m", "c", "s")).alias("top"))
    blocks = lambda k, s: F.greatest(F.ceil(k / BLOCK), F.ceil(s / BLOCK_SHINGLES), F.lit(1)).cast("int")
    whole = whole.select("family", F.col("top.c").alias("top"), blocks(F.col("k"), F.col("s")).alias("n_m"), blocks(F.col("k") - F.col("top.m"), F.col("s") - F.col("top.s")).alias("n_q"))
    sized = open_.join(whole, "family").withColumn("is_query", F.col("c") != F.col("top"))
    sized = sized.withColumn("own_m", F.pmod(F.xxhash64("id"), F.col("n_m")).cast("int")).withColumn("own_q", F.pmod(F.xxhash64("id", F.lit(1)), F.col("n_q")).cast("int"))
    # a member stands in all tiles of its block of members, a query also in all of its block of queries
    tile = lambda m, q, member, query: F.struct(m.alias("block"), q.alias("q_block"), member.alias("member"), query.alias("query"))
    as_member = F.transform(F.sequence(F.lit(0), F.col("n_q") - 1), lambda q: tile(F.col("own_m"), q, F.lit(True), F.col("is_query") & (q == F.col("own_q"))))
    others = F.filter(F.sequence(F.lit(0), F.col("n_m") - 1), lambda m: F.col("is_query") & (m != F.col("own_m")))
    as_query = F.transform(others, lambda m: tile(m, F.col("own_q"), F.lit(False), F.lit(True)))
    rows = sized.select("family", "id", "c", F.inline(F.concat(as_member, as_query)))
    ids = small(open_.select(F.col("id").alias("_id")).distinct())
    texts = docs.select(F.col("doc_id").cast(id_type(docs)).alias("_doc"), "text").join(ids, F.col("_doc") == F.col("_id"), "left_semi")
    both = rows.join(texts, F.col("id") == F.col("_doc")).select("family", "block", "q_block", "id", "c", "query", "member", "text")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seen: dict[bytes, int] = {}
        with np.errstate(over="ignore"):
            sets = [shingles(t, size, seen) for t in pdf["text"]]
        ids, comp = pdf["id"].to_numpy(), pdf["c"].to_numpy()
        members, queries = np.flatnonzero(pdf["member"]), np.flatnonzero(pdf["query"])
        none = pd.DataFrame({"a": ids[:0], "b": ids[:0]})
        if not len(members) or not len(queries):
            return none
        n = np.array([len(x) for x in sets])
        words, place = np.unique(np.concatenate([sets[i] for i in members]), return_inverse=True)
        starts = np.concatenate(([0], np.cumsum(n[members])[:-1]))
        out = [none]
        step = max(1, 5_000_000 // max(1, len(place)))
        for at in range(0, len(queries), step):
            q = queries[at : at + step]
            has = np.zeros((len(q), len(words)), np.uint8)
            for row, i in enumerate(q):
                has[row, np.searchsorted(words, np.intersect1d(sets[i], words, assume_unique=True))] = 1
            shared = np.add.reduceat(has[:, place], starts, axis=1, dtype=np.int32)
            linked = (100 * shared >= percent * (n[q][:, None] + n[members][None, :] - shared)) & (comp[q][:, None] != comp[members][None, :])
            x, y = np.nonzero(linked)
            out.append(pd.DataFrame({"a": ids[q[x]], "b": ids[members[y]]}))
        return pd.concat(out, ignore_index=True)

    found = both.groupBy("family", "block", "q_block").applyInPandas(run, f"a {id_type(docs)}, b {id_type(docs)}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every id in links (a, b), by alternating large and small stars."""
    state = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h")).first()
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    was = state(edges)
    while was["n"]:
        # large star: each vertex links its larger neighbours to its smallest neighbour
        near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each vertex links its smaller neighbours and itself to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = written(hung.where("u <> v").distinct(), "cc")
        now = state(edges)
        if now == was:
            break
        was = now
    ids = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept (the smallest id of its component).

    Null texts and texts without words have no shingles and are linked with nothing. Rows of one doc_id are
    one node of the graph, so repeated rows share a component; rows without an id are alone, with a null
    component, and kept. Ids are carried as long if they are whole numbers, else as strings. Other columns are
    ignored; an empty table gives an empty result.
    """
    sigs = written(signatures(docs, size), "minhash-signatures")
    classes = sigs.where("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("rep"))
    member = written(sigs.where("class is not null and doc_id is not null").select("doc_id", "class").join(classes, "class").select("doc_id", "rep").distinct(), "minhash-members")
    reps = member.where("doc_id = rep").select("rep").distinct()
    # an id may have rows of several texts: a row of bands for each
    banded = sigs.where("class is not null").select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("weight"), "bands").join(reps, "rep", "left_semi").select("rep", "weight", F.explode("bands").alias("band"))
    banded = banded.groupBy("rep", "band").agg(F.max("weight").alias("weight"))
    # written, so that the join below reads rows dealt by band alone, which Spark parts where a band is hot
    shared = written(banded.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("a")).where("n > 1"), "minhash-bands")
    buckets = written(banded.join(shared, "band").select("band", "n", "a", F.col("rep").alias("id"), "weight"), "minhash-buckets")

    links = member.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    pairs = buckets.where("id <> a").select("a", F.col("id").alias("b")).distinct()
    tried = written(pairs, "minhash-pairs")
    good = written(confirmed(tried, docs, size, similarity), "minhash-links", PAIR_ROWS)
    comp = written(components(good.union(links)), "minhash-components")
    # buckets of two are done; larger ones that are not one component go on, joined by their pivot
    placed = buckets.where("n > 2").join(comp, "id", "left").select("band", F.col("a").alias("family"), "id", "weight", F.coalesce("component", "id").alias("c"))
    split = small(written(placed.where("id <> family").groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("band"), "minhash-split"))
    open_ = written(placed.where("id <> family").join(split, "band").groupBy("family", "id", "c").agg(F.max("weight").alias("weight")), "minhash-open")
    more = written(across(open_, docs, size, similarity), "minhash-links", PAIR_ROWS)
    comp = components(good.union(more).union(links))
    out = sigs.select("doc_id", "n_shingles").join(comp, F.col("doc_id") == F.col("id"), "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each group of near duplicates, that of the smallest id; all columns stay.

    Of rows that share an id, those whose own text is a near copy of a smaller id's go first; of the rest one stays, that of
    the smallest hash of its text. Rows without an id all stay.
    """
    id_, text, node, left_over = free_names(docs, "_id", "_text", "_node", "_left")
    again = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias(id_)).agg(F.count("*").alias("n")).where("n > 1").select(id_)
    if again.isEmpty():
        gone = near_duplicates(docs, size, similarity).where(~F.col("kept")).select(F.col("doc_id").alias(id_)).distinct()
        return docs.join(small(gone), docs["doc_id"].cast(id_type(docs)) == F.col(id_), "left_anti")
    # ids repeat: each (id, text) is a node, numbered in order of ids (partitions of a sorted table are in order too)
    pairs = docs.where("doc_id is not null").select(F.col("doc_id").alias(id_), F.xxhash64("text").alias(text)).distinct()
    nodes = written(pairs.orderBy(id_, text).withColumn(node, F.monotonically_increasing_id()), "minhash-nodes")
    same = (docs["doc_id"] == F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(text))
    own = docs.join(small(nodes), same).select(F.col(node).alias("doc_id"), docs["text"])
    kept = written(near_duplicates(own, size, similarity).where("kept").select(F.col("doc_id").alias(left_over)).distinct(), "minhash-kept")
    first = nodes.join(kept, F.col(node) == F.col(left_over), "left_semi").groupBy(id_).agg(F.min(text).alias(text))
    left = docs.join(small(first), same, "left_semi")
    again = small(written(again, "minhash-again"))
    shared = left["doc_id"] == F.col(id_)
    return left.join(again, shared, "left_anti").union(left.join(again, shared, "left_semi").dropDuplicates(["doc_id"])).union(docs.where("doc_id is null"))


def op7_near_duplicates(spark, sf_dir):
    return near_duplicates(load(spark, sf_dir, "documents"), size=2)


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT b AS id, c FROM r JOIN both_ways ON a = id WHERE c < b),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, m.component_id = d.doc_id AS kept
FROM documents d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
