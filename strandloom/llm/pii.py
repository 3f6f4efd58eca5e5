"""Personal data, and information-theoretic sanitisation of the terms that disclose it.

Base spans come from patterns. The words of three code points or more anywhere in a text with entities are
terms that may disclose them. Over the whole corpus, a term's disclosure of an entity is its pointwise mutual
information with the entity as a share of the entity's own information, log2(N co / (n_e n_t)) /
log2(N / n_e). Counts are of distinct texts, so copies of a document add nothing. Terms that disclose at
least THRESHOLD of an entity are spans of kind `term`: to be generalised or removed with the entity. An
entity of one text has them too: there the terms are the words of about N ** (1 - THRESHOLD) texts or fewer.
Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bench_words, free_names, let, load, running, small, written
from .spans import SPAN, clear_of, listing, matches, of_kind, replaced

THRESHOLD = 0.8
KINDS = ("email", "ip", "card", "phone")

# Each begins where the last match ended (\G) or where its first run begins, and is possessive: the same
# matches as the plain greedy pattern, in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
IP_VALID = rf"^{_PART}(?:\.{_PART}){{3}}$"
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]{3,}+"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, r"[^0-9]", "")


def luhn(v: Column) -> Column:
    d = F.split(F.reverse(_digits(v)), "")
    worth = F.transform(d, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    length = lambda v: F.char_length(_digits(v))
    return F.concat(
        matches(text, EMAIL, "email", 0, hint=F.contains(text, F.lit("@"))),
        matches(text, IP, "ip", 1, keep=lambda v: F.regexp_like(v, F.lit(IP_VALID)), hint=F.contains(text, F.lit("."))),
        matches(text, CARD, "card", 2, keep=lambda v: F.when(length(v).between(14, 19), luhn(v)).otherwise(False)),
        matches(text, PHONE, "phone", 3, keep=lambda v: length(v).between(10, 15), hint=F.contains(text, F.lit("+"))),
    )


def text_key(text: Column) -> Column:
    """128 bits of a text; null is the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def found(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base, and of texts with base spans entities (their distinct values, lower-cased) and text."""
    t = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", text_key(F.col("text")).alias("text_hash"), t.alias("text"), base_spans(t).alias("base"))
    some = F.size("base") > 0
    return d.select("doc_id", "text_hash", "base", F.when(some, F.array_distinct(F.transform("base", lambda x: F.lower(x["value"])))).alias("entities"), F.when(some, F.col("text")).alias("text"))


def disclosing(docs: DataFrame, inside: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """text_hash, term: of each text of inside (text_hash, text, entities; distinct texts) the terms that disclose an
    entity of it. All counts are of distinct whole texts of docs. Entities of the same texts (by two 64-bit sums over them) are disclosed
    by the same terms and are one class, so a text with a list of entities that are nowhere else has one class."""
    rows = docs.select(text_key(F.col("text")).alias("text_hash"), "text")
    copies = written(rows.groupBy("text_hash").agg(F.count("*").alias("copies")), "pii-texts")
    n_texts = copies.count()
    n = F.lit(float(max(n_texts, 1)))
    e = inside.select("text_hash", F.explode("entities").alias("entity"))
    seeded = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "text_hash"))
    n_e = e.groupBy("entity").agg(F.count("*").alias("n_e"), F.struct(seeded(1).alias("a"), seeded(2).alias("b"), F.count("*").alias("n")).alias("class")).where(F.col("n_e") < n_texts)
    e = written(e.join(small(n_e, 500_000), "entity").select("text_hash", F.col("class").alias("entity"), "n_e").distinct(), "pii-entities")
    top = e.agg(F.max("n_e")).first()[0] or 1
    # co is n_e at most, so a term of too many texts can not disclose the entity, however they meet
    could = lambda n_t, n_e: F.log2(n / n_t) >= threshold * F.log2(n / n_e) - 1e-9
    words = F.filter(F.array_distinct(bench_words(F.col("text"))), lambda w: F.char_length(w) >= 3)
    near = written(inside.select("text_hash", F.explode(words).alias("term")), "pii-near")
    wanted = small(near.groupBy("term").agg(F.count("*").alias("n_near")).where(could(F.col("n_near"), F.lit(top))).select(F.col("term").alias("t")), 500_000)
    # each of a text's copies counts as its share of the text, so that no text has to move
    again = small(copies.where("copies > 1").withColumnRenamed("text_hash", "again"))
    share = F.lit(1.0) / F.coalesce("copies", F.lit(1))
    all_words = rows.join(again, F.col("text_hash") == F.col("again"), "left").select(F.explode(F.array_distinct(bench_words(F.col("text")))).alias("term"), share.alias("share"))
    df = written(all_words.join(wanted, F.col("term") == F.col("t")).groupBy("term").agg(F.round(F.sum("share")).alias("n_t")), "pii-words")
    rare = near.join(small(df.where(could(F.col("n_t"), F.lit(top))), 500_000), "term")
    pairs = written(rare.join(e, "text_hash").where(could(F.col("n_t"), F.col("n_e"))).select("text_hash", "entity", "term", "n_e", "n_t"), "pii-pairs")
    co = pairs.groupBy("entity", "term", "n_e", "n_t").agg(F.count("*").alias("co"))
    good = co.where(F.log2(n * F.col("co") / (F.col("n_e") * F.col("n_t"))) >= threshold * F.log2(n / F.col("n_e"))).select("entity", "term")
    return pairs.select("text_hash", "entity", "term").join(small(good, 500_000), ["entity", "term"]).select("text_hash", "term").distinct()


def word_places(text: Column) -> Column:
    """Array of (v, start): the words of text with their places, in linear time."""
    low = ascii_lower(text)
    words = F.regexp_extract_all(low, F.lit(WORD), F.lit(0))
    gaps = F.transform(F.split(low, WORD, -1), lambda x: F.char_length(x))
    rows = F.zip_with(words, F.slice(gaps, 1, F.size(words)), lambda v, gap: F.struct(v.alias("v"), gap.alias("gap")))

    def places(z: Column) -> Column:
        before = running(F.transform(z, lambda x: x["gap"] + F.char_length(x["v"])), lambda a, x: a + x, F.lit(0))
        return F.zip_with(z, before, lambda x, at: F.struct(x["v"].alias("v"), (at + x["gap"]).alias("start")))

    return let(rows, places)


def term_spans(inside: DataFrame, terms: DataFrame) -> DataFrame:
    """t_hash, terms: the spans of the words of each text that are among its terms. inside: text_hash, text; terms: text_hash, term. Words
    and terms meet in a join, so a text costs its words, however many terms it has."""
    w = inside.join(terms.select("text_hash").distinct(), "text_hash", "left_semi").select("text_hash", F.explode(word_places(F.col("text"))).alias("w")).select("text_hash", F.col("w.v").alias("term"), "w.start")
    span = F.struct("start", F.lit(4).alias("rank"), F.lit("term").alias("kind"), (F.col("start") + F.char_length("term")).alias("end"), F.col("term").alias("value"))
    return w.join(terms, ["text_hash", "term"]).groupBy(F.col("text_hash").alias("t_hash")).agg(F.array_sort(F.collect_list(span)).alias("terms"))


def pii_spans(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, text_hash, base, spans (base and disclosing terms).

    Null and empty texts have no spans; repeated rows are returned as often as they come, null ids are
    kept, other columns are ignored. Terms that overlap a base span are part of it and are dropped.
    """
    docs = docs.select("doc_id", "text")
    spans = written(found(docs), "pii-spans")
    some = F.size("base") > 0
    inside = written(spans.where(some).select("text_hash", "text", "entities").dropDuplicates(["text_hash"]), "pii-inside")
    hit = term_spans(inside, written(disclosing(docs, inside, threshold), "pii-disclosing"))
    hit = written(hit, "pii-terms")
    out = spans.where(some).join(hit, F.col("text_hash") == F.col("t_hash"), "left")
    terms = F.when(F.size("terms") > 0, clear_of(F.col("terms"), F.col("base"), 4)).otherwise(F.array()).cast(SPAN)
    out = out.select("doc_id", "text_hash", "base", F.concat("base", terms).alias("spans"))
    return out.union(spans.where(~some).select("doc_id", "text_hash", "base", F.col("base").alias("spans")))


def sanitise(docs: DataFrame, **kw) -> DataFrame:
    """docs with every span of the text replaced by its kind in angle brackets; spans that overlap are one. All rows, in any
    number, and all other columns stay; null and empty texts stay as they are; rows that share id and text change alike."""
    id_, text_hash, spans = free_names(docs, "_id", "_hash", "_spans")
    s = pii_spans(docs, **kw).where(F.size("spans") > 0).groupBy(F.col("doc_id").alias(id_), F.col("text_hash").alias(text_hash)).agg(F.first("spans").alias(spans))
    d = docs.join(s, docs["doc_id"].eqNullSafe(F.col(id_)) & (text_key(docs["text"]) == F.col(text_hash)), "left")
    clean = F.when(F.col(spans).isNotNull(), replaced(F.col("text"), F.array_sort(spans))).otherwise(F.col("text"))
    return d.select(*[clean.alias("text") if c == "text" else F.col(c) for c in docs.columns])


def op3_pii(spark, sf_dir):
    d = pii_spans(load(spark, sf_dir, "documents"))
    return d.select("doc_id", *[of_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS], F.sha2(listing(F.col("base")), 256).alias("base_sha256"), listing(F.col("spans")).alias("spans"), (F.size("spans") > 0).alias("private"))
