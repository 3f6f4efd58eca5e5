"""Clashing columns, ids of other types, long texts, and plain-Python versions of linking, terms and the pipeline's stages."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import chat, common, decontaminate, flac, langid, minhash, mixing, pii, repeats, secrets, sharding

CLASH = ("_bad_id", "_bad_hash", "s_id", "s_hash", "_spans", "_hash", "_gone", "_id", "_text", "_bucket", "_deal", "_place", "_kind", "_mix", "_guess", "_cut", "_weak", "_base", "base", "t_hash", "slot", "Size")
LONG = " ".join(f"word{i}" for i in range(300))
ROWS = [(1, "plain text with a few words of its own", "en"), (2, None, None), (3, "", "en"), (4, "mail bob@example.com pwd: hunter22 login: bob99", "en"), (5, LONG, "de"), (6, LONG, "de"), (6, LONG, "de"), (None, "a text without an id", "fr"), (8, "alpha beta gamma delta", None)]


def table(spark, kind="long", rows=ROWS):
    rows = [(None if i is None else i if kind == "long" else f"d{i}", t, lang) for i, t, lang in rows]
    d = spark.createDataFrame(rows, f"doc_id {kind}, text string, lang string")
    return d.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)])


def operators(spark):
    bench = spark.createDataFrame([("b", "alpha beta gamma delta")], "item_id string, text string")
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")
    # each with the columns it may replace, and those rows of ROWS that stay
    return {
        "decontaminate": (lambda d: decontaminate.decontaminate(d, bench), (), 8),
        "secrets": (secrets.secret_spans, ("base", "spans"), 9),
        "sanitise": (pii.sanitise, (), 9),
        "mix": (lambda d: mixing.mix(d, labels.withColumn("doc_id", F.col("doc_id").cast(d.schema["doc_id"].dataType)), {"good": 1, "poor": 1, "toxic": 1}), (), None),
        "repeats": (repeats.without_repeats, ("kept", "n_bytes", "n_removed", "n_spans"), 9),
        "near": (minhash.drop_near_duplicates, (), 7),
        "language": (langid.keep_identified, (), None),
        "identify": (lambda d: langid.identify(d, {}), ("lang_pred", "score"), 9),
        "sharding": (sharding.shuffled, ("size", "shard", "slot"), 9),
    }


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("name", ["decontaminate", "secrets", "sanitise", "mix", "repeats", "near", "language", "identify", "sharding"])
def test_clashing_columns_ids_nulls_and_repeats(spark, name, kind):
    run, new, left = operators(spark)[name]
    d = table(spark, kind)
    out = run(d)
    others = [c for c in d.columns if c.lower() not in new]
    assert [c for c in out.columns if c.lower() not in new] == others
    rows = out.collect()
    assert left is None or len(rows) == left
    for k, c in enumerate(CLASH):
        if c.lower() not in new:
            assert {r[c] for r in rows} <= {k}
    assert run(d.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_ids_of_tables_of_digests(spark, kind):
    d = table(spark, kind)
    near = minhash.near_duplicates(d).collect()
    assert len(near) == 9 and sum(not r.kept for r in near) == 2
    assert Counter(r.doc_id for r in flac.digests(d).collect()) == Counter(r.doc_id for r in d.collect())
    assert pii.pii_spans(d).count() == 9


def test_100_000_matches_in_one_text(spark):
    d = spark.createDataFrame([(1, "secret: abcdef12 ü " * 100_000)], "doc_id long, text string")
    r = secrets.secret_spans(d).select(F.size("base").alias("n"), F.element_at("base", -1).alias("x")).first()
    assert r.n == 100_000 and (r.x.start, r.x.end) == (19 * 99_999, 19 * 99_999 + 16)


def test_100_000_turns(spark):
    c = spark.range(100_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("ab").alias("text"))
    r = chat.formatted(c).select("formatted", F.size("loss").alias("n"), F.element_at("loss", -1).alias("x")).first()
    assert r.n == 50_000 and r.formatted[r.x.start : r.x.start + r.x.length] == "ab" and r.formatted[r.x.start + 2 :] == "<|im_end|>\n"


@pytest.mark.parametrize("role", ["tool\nx", "&#10;", "a&amp;#10;\n", "&amp;\n<|im_end|>", "\n\n", ""])
def test_roles_come_back(spark, role):
    c = spark.createDataFrame([(1, 0, role, "x\nhello"), (1, 1, role + "b", "&#10;")], "conv_id int, turn int, role string, text string")
    assert [(t.role, t.text) for t in chat.read_back(chat.formatted(c)).first().turns] == [(role, "x\nhello"), (role + "b", "&#10;")]


def test_running(spark):
    for n in (0, 1, 2, 3, 10, 101):
        x = [random.Random(n).randrange(9) for _ in range(n)]
        d = spark.createDataFrame([(x,)], "x array<int>")
        assert d.select(common.running(F.col("x"), lambda a, b: a + b, F.lit(0)).alias("r")).first().r == [sum(x[:i]) for i in range(n)]


ROLE = {"assign": "keyed", "hex": "bare", "access": "identifier", 3: "identifier", 4: "keyed", 5: "bare", 6: "endpoint"}
NEEDS = {3: ("keyed", "bare"), 4: ("identifier", "endpoint"), 5: ("identifier",), 6: ("keyed",)}


def test_linking_against_all_pairs(spark):
    rng = random.Random(5)
    bits = ["pwd: hunter22", "client_id: bob1", "https://a.b/c", "password=abcdef1", "AKIA" + "A" * 16, "0123456789abcdef01234567", "Z" * 40, "credential: x1x1x1", "user: AKIA" + "B" * 16]
    texts = [" ".join(rng.choice(bits) + " " + "y " * rng.choice([0, 5, 120, 130, 140, 200]) for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = d.select("doc_id", secrets.base_spans(F.col("text")).alias("b"), secrets.weak_spans(F.col("text")).alias("w")).collect()
    got = {r.doc_id: sorted((x.start, x.end, x["rank"]) for x in r.spans) for r in secrets.secret_spans(d).collect()}
    some = 0
    for r in rows:
        parts = [(x.start, x.end, ROLE[x.kind]) for x in r.b] + [(x.start, x.end, ROLE[x["rank"]]) for x in r.w]
        want = [(x.start, x.end, x["rank"]) for x in r.b]
        for x in r.w:
            inside = any(b.start < x.end and x.start < b.end for b in r.b)
            near = any(role in NEEDS[x["rank"]] and (s, e) != (x.start, x.end) and max(s - x.end, x.start - e) <= secrets.SCOPE for s, e, role in parts)
            if near and not inside:
                want.append((x.start, x.end, x["rank"]))
                some += 1
        assert got[r.doc_id] == sorted(want), texts[r.doc_id]
    assert some > 50


def test_gap_of_linked_parts(spark):
    texts = ["o" * at + " client_id: bob1" + " " * gap + "pwd: hunter22" for gap in (256, 257) for at in range(0, 600, 37)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n = {r.doc_id: len(r.spans) for r in secrets.secret_spans(d).collect()}
    assert [n[i] for i in range(len(texts))] == [2] * (len(texts) // 2) + [0] * (len(texts) // 2)


def test_terms_against_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{i}x" for i in range(60)]
    texts = [" ".join(rng.choice(words[: rng.choice([5, 60])]) for _ in range(rng.randrange(3, 30))) for _ in range(300)]
    for i in range(0, 300, 10):
        who = i // 10 % 7
        texts[i] = f"Name{who} {texts[i]} person{who}@site.org secret{who}"
    texts += texts[:20]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {x.value for x in r.spans if x.kind == "term"} for r in pii.pii_spans(d).collect()}
    distinct = set(texts)
    mails = {t: set(re.findall(r"[a-z0-9]+@[a-z.]+", t)) for t in distinct}
    bag = {t: {w for w in re.findall(r"[0-9a-z]+", t.lower()) if len(w) > 2} for t in distinct}
    n, n_e, n_t, co = len(distinct), Counter(), Counter(), Counter()
    for t in distinct:
        n_e.update(mails[t])
        n_t.update(bag[t])
        co.update((m, w) for m in mails[t] for w in bag[t])
    tells = {(m, w) for (m, w), c in co.items() if np.log2(n * c / (n_e[m] * n_t[w])) >= 0.8 * np.log2(n / n_e[m])}
    for i, t in enumerate(texts):
        inside = {w for m in mails[t] for w in re.findall(r"[a-z0-9]+", m)}  # terms inside an address are part of it
        assert got[i] == {w for w in bag[t] if any((m, w) in tells for m in mails[t])} - inside, t
    assert sum(map(bool, got.values())) > 20


def test_sanitise_against_plain_python(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["bob@example.com", "10.2.3.4", " ", "ü", "😀", "word ", "x" * 700, "+49 30 1234567 "]) for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: sorted((x.start, x["rank"], x.kind, x.end) for x in r.spans) for r in pii.pii_spans(d).collect()}
    for r in pii.sanitise(d).collect():
        at, out = 0, ""
        for start, _, kind, end in spans[r.doc_id]:
            if end > at:
                out += texts[r.doc_id][at : max(start, at)] + f"<{kind}>"
                at = end
        assert r.text == out + texts[r.doc_id][at:]


def test_false_sync_codes_and_seeks():
    rng = np.random.default_rng(1)
    raw = bytearray(rng.integers(0, 256, 192 * 5, dtype=np.uint8).tobytes())
    for frame, number in ((0, 1), (1, 2), (2, 2), (3, 4), (4, 5)):  # in frames that are stored as they are
        head = flac._headers(9)[number]
        raw[192 * frame + 60 : 192 * frame + 60 + len(head)] = bytes(x ^ 0x80 for x in head)
    data = [bytes(raw), *(rng.integers(97, 110, 192 * n, dtype=np.uint8).tobytes() for n in (1, 63, 64, 65, 200))]
    files = flac.encode(data, lpc=True)
    for first in (0, 5, 191):
        assert flac.samples_from(files, [first] * 6) == [x[first:] for x in data]
    assert flac.samples_from(files, [len(x) - 16 for x in data]) == [x[-16:] for x in data]


def test_targets_out_of_reach_are_reported(spark):
    d = table(spark).select("doc_id", "text")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    with pytest.warns(UserWarning, match="missed"):
        rows = mixing.mixing_rates(d, none).collect()
    assert {r.off_target for r in rows} == {0.416667}


def test_rates_against_plain_projected_gradient(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.4, 0.4, 0.4], 200)
    n = rng.integers(1, 500, 200)
    slim = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n_tokens long, p array<double>")
    steps, gap = mixing.fit_rates(slim, {"good": 0.6, "poor": 0.3, "toxic": 0.1})
    rate, wanted = np.ones(200), n.sum() * np.array([0.6, 0.3, 0.1])
    inverse = np.linalg.pinv((p * n[:, None]).T @ p)
    for _ in steps:
        rate = np.maximum(0, rate - p @ (inverse @ ((rate * n) @ p - wanted)))
    got = [r.r for r in slim.select(mixing.rate_of(F.col("p"), steps).alias("r")).collect()]
    assert np.allclose(got, rate, atol=1e-6) and gap <= mixing.TOLERANCE
    assert np.abs((rate * n) @ p - wanted).max() <= 2e-4 * n.sum()


@pytest.mark.parametrize("piece", [3, 1000])
def test_slots_whatever_the_buckets(spark, piece):
    d = spark.range(500).select((F.col("id") % 90).alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("text"), F.col("id").alias("_bucket"))
    rows = sharding.shuffled(d, 5, 200, piece=piece).collect()
    assert sorted(r._bucket for r in rows) == list(range(500))
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_pipeline_stage_by_stage_against_plain_python(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    # language ID: every trigram's vector by itself
    a, b, c = (x.astype(np.int64) for x in langid.letter_vectors())

    def vector(text):
        codes = Counter(langid.trigrams(text, langid.symbol_table()).tolist())
        return sum((k * a[x // 128**2] * b[x // 128 % 128] * c[x % 128] for x, k in codes.items()), np.zeros(langid.DIM))

    vectors = {i: vector(r.text) for i, r in rows.items()}
    proto = defaultdict(lambda: np.zeros(langid.DIM))
    for i, r in rows.items():
        if zlib.crc32(str(i).encode()) % 4 != 2:
            proto[r.lang] += vectors[i]
    cos = {i: max(v @ q / max(np.linalg.norm(v) * np.linalg.norm(q), 1e-9) for q in proto.values()) for i, v in vectors.items()}
    kept = stages["language_id"](spark, docs, d)
    assert {r.doc_id for r in kept.collect()} == {i for i, x in cos.items() if x > langid.LEAST}

    # near duplicates: all pairs of sets of five words
    left = {r.doc_id: r.text for r in kept.collect()}
    sets = {}
    for i, t in left.items():
        w = t.lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    root = {i: i for i in left}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in left:
        for j in left:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    kept = stages["near_dedup"](spark, kept, d)
    left = {r.doc_id: r.text for r in kept.collect()}
    assert set(left) == {i for i in root if find(i) == i}

    # decontamination: all windows
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    grams = set()
    for r in spark.read.parquet(f"{d}/benchmark.parquet").collect():
        w = words(r.text or "")
        grams |= {tuple(w[j : j + 10]) for j in range(max(1, len(w) - 9))} if w else set()
    lens = {len(g) for g in grams}
    clean = {i for i, t in left.items() if not any(tuple(w[j : j + k]) in grams for w in [words(t)] for k in lens for j in range(len(w) - k + 1))}
    kept = stages["decontamination"](spark, kept, d)
    assert {r.doc_id for r in kept.collect()} == clean

    # mixing: whole rows, as often as their rates say
    labels = spark.read.parquet(f"{d}/labels.parquet")
    copies = {r.doc_id: r.copies for r in mixing.mixing_rates(kept, labels).collect()}
    mixed = stages["mixing"](spark, kept, d)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})
    assert all(tuple(r) == tuple(rows[r.doc_id]) for r in mixed.collect())

    # sharding: the shard of an id by law, slots without gaps, all rows
    out = stages["sharding"](spark, mixed, d).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in mixed.collect())
    law = {r.doc_id: r.s for r in kept.select("doc_id", sharding.shard_of(F.col("doc_id"), sharding.SHARDS).alias("s")).collect()}
    slots = defaultdict(list)
    for r in out:
        assert r.shard == law[r.doc_id]
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_documents_with_findings_are_marked(spark, tmp_path):
    from strandloom.llm import pii, secrets

    rows = [(1, "mail bob@example.com"), (2, "password = hunter2hunter2"), (3, "nothing here"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["private"] for r in pii.op3_pii(spark, str(tmp_path)).collect()} == {1: True, 2: False, 3: False, 4: False}
    assert {r["doc_id"]: r["leaks"] for r in secrets.op2_secrets(spark, str(tmp_path)).collect()} == {1: False, 2: True, 3: False, 4: False}
