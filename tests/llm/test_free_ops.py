"""Near duplicates, repeats, language ID, mixing, media, sharding and the pipeline against brute force."""

import hashlib
import os
import random
from collections import Counter

import pytest

from strandloom.llm import flac, langid, minhash, mixing, repeats, sharding

D = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2.0) for i, t in rows], "doc_id long, text string, size int, score double")


def near_copies(seed=0, n=60):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(80)) for _ in range(5)]
    rows = []
    for i in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    return [*rows, (100, None), (101, ""), (102, "  "), (103, "one"), (104, "One"), (105, "a b"), (None, "a b"), (107, rows[0][1].upper()), (107, rows[0][1].upper())]


@pytest.mark.parametrize(("block", "of_shingles"), [(2000, 1_000_000), (3, 1_000_000), (2000, 300)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, block, of_shingles):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", of_shingles)
    rows = near_copies()

    def sets(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set()

    s = [(i, sets(t)) for i, t in rows]
    root = {i: i for i, _ in s if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in s:
        for j, y in s:
            if i is not None and j is not None and i < j and x and y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = Counter((i, len(x), None if i is None else find(i)) for i, x in s)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, rows), size=2).collect())
    assert got == want
    assert minhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_clean_text_of_a_repeated_id_stays(spark):
    copy = " ".join(f"copied{i}" for i in range(60))
    rows = [(1, copy), (2, copy + " end"), (2, "a text like no other one here"), (3, copy), (4, None), (None, copy)]
    for r in (rows, rows[::-1]):
        got = minhash.drop_near_duplicates(frame(spark, r)).collect()
        assert Counter((x.doc_id, x.text) for x in got) == Counter([rows[0], rows[2], rows[4], rows[5]])


def test_classifier_is_fitted_on_all_words_of_long_texts(spark):
    filler = " ".join(f"filler{i}" for i in range(2600))
    marks = [w for w in (f"mark{i}" for i in range(2000)) if mixing._word_ids(w, {})[1][0] > 0.98 * mixing.FEATURES][:2]  # beyond the first 2,000 ids
    docs = frame(spark, [(i, f"{filler} {marks[i % 2]}") for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    w = mixing.fit_classifier(docs, labels)
    for i, mark in enumerate(marks):  # good is domain 0, poor 1
        x = w[mixing._word_ids(mark, {})[1][0]]
        assert (x[0] > x[1]) == bool(i) and abs(x[0] - x[1]) > 0.1


def test_one_document_of_each_group_stays(spark):
    rows = near_copies()
    comp = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows), size=5).collect()}
    got = [r.doc_id for r in minhash.drop_near_duplicates(frame(spark, [*rows, rows[0], (0, "another text"), (None, None)])).collect()]
    assert Counter(got) == Counter([*{c for i, c in comp.items() if i is not None}, None, None])


@pytest.mark.parametrize("hot", [30_000, 1])
def test_repeats_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(3)
    shared = "".join(rng.choice("abcde ") for _ in range(700))
    noise = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(0, 300)))
    rows = [(i, noise() + shared[rng.randint(0, 200) : rng.randint(350, 700)] + noise()) for i in range(30)]
    rows += [(100, "x" * 3000), (101, None), (102, ""), (103, "y" * 400), (104, "é" * 300 + "z"), (105, "ab" * 500), (106, shared), (107, shared), (107, shared), (None, "short")]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in repeats.without_repeats(frame(spark, rows)).collect())
    assert got == Counter((i, *x) for (i, _), x in zip(rows, repeats.brute_force([t for _, t in rows]), strict=True))
    assert repeats.without_repeats(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_language_on_held_out_documents(spark):
    got = langid.op8_language(spark, D).join(spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


def test_language_edges(spark):
    labelled = spark.createDataFrame([(1, "the cat and the dog", "en"), (3, "der hund und die katze", "de"), (4, None, "en"), (5, "x", None)], "doc_id long, text string, lang string")
    protos = langid.prototypes(labelled)
    rows = [(1, None), (2, ""), (3, "123 !?"), (6, "😀 🎉"), (7, "𝐝𝐨𝐠"), (4, "the dog"), (5, "die katze und der hund " * 20_000), (None, "das")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(frame(spark, rows), protos).collect()}
    assert got[1] == got[2] == got[3] == got[6] == ("und", 0.0) and got[7][0] != "und" and got[4][0] == "en" and got[5][0] == "de" and all(0 <= s <= 1 for _, s in got.values())
    assert langid.identify(frame(spark, rows), {}).where("lang_pred <> 'und'").count() == 0


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_scripts_not_learned_go(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text", "lang")
    other = ["Ωραία μέρα σήμερα και ο ήλιος λάμπει πάνω από τη θάλασσα", "Сегодня хорошая погода и мы идем гулять в парк с детьми", "今日はとても良い天気ですので公園へ散歩に行きましょう"]
    other += ["مرحبا بكم في هذا المكان الجميل والهادئ", "שלום לכולם היום יום יפה מאוד", "ขอบคุณมากครับ วันนี้อากาศดี", "오늘 날씨가 아주 좋아서 공원에 갑니다"]
    short = [(-100, "The weather is nice today", None), (-101, "Das Wetter ist heute schön", None)]
    more = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(other)] + short, docs.schema)
    kept = {r.doc_id for r in langid.keep_identified(docs.unionByName(more)).collect()}
    assert kept == {r.doc_id for r in docs.collect()} | {-100, -101}


def test_stages_leave_clashing_columns_alone(spark):
    docs = spark.createDataFrame([(i, "the cat and the dog", "en", "a", 7.0, "m", "g") for i in range(8)], "doc_id long, text string, lang string, lang_pred string, score double, _mix string, _GUESS string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int")
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and Counter(kept.collect()) == Counter(docs.collect())
    assert {r[1:] for r in mixing.mix(docs, labels).collect()} == {tuple(r)[1:] for r in docs.collect()}


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_mixing_meets_targets(spark):
    a = mixing.op4_mixing(spark, D).toPandas()
    total = a.n_tokens.sum()
    for d, w in mixing.TARGETS.items():
        assert (a.n_tokens * a[f"p_{d}"] * a.rate).sum() / total == pytest.approx(w, abs=1e-3)
    assert (a.rate >= 0).all() and (abs(a.copies - a.rate) <= 1).all()


def test_mixing_edges(spark):
    docs = frame(spark, [(1, None), (2, ""), (None, "word"), (4, "w " * 50_000)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = mixing.mixing_rates(docs, none).collect()
    assert len(got) == 4 and all(r.rate >= 0 for r in got)
    assert mixing.mixing_rates(docs.limit(0), none).count() == 0 and mixing.mix(docs, none).columns == docs.columns


@pytest.mark.parametrize("lpc", [False, True])
def test_flac_round_trip(lpc):
    rng = random.Random(1)
    data = [flac.payload(x) for x in (None, "a", "x" * 192, "é" * 500, "ab" * 40_000)] + [rng.randbytes(192 * 7), bytes(192 * 3), bytes([0, 255]) * 19_200, bytes(191) + b"\xff"]
    files = flac.encode(data, lpc)
    assert [b"".join(b for _, b in x) for x in flac.decode(files)] == data
    assert [o for o, _ in flac.decode(files)[4]] == list(range(0, len(data[4]), flac.PCM_BLOCK))
    broken = bytearray(files[3])
    broken[-30] ^= 1
    with pytest.raises(ValueError):
        flac.decode([bytes(broken)])


def test_media_tables(spark):
    rows = [(1, None), (2, "text"), (2, "text"), (None, "é")]
    d = flac.digests(frame(spark, rows)).collect()
    assert Counter(r.payload_sha256 for r in d) == Counter(hashlib.sha256(flac.payload(t)).hexdigest() for _, t in rows)
    blocks = flac.pcm_blocks(flac.stored(frame(spark, rows))).collect()
    assert Counter(bytes(r.blocks[0].pcm) for r in blocks) == Counter(flac.payload(t) for _, t in rows)


def test_shards(spark):
    rows = [(i, "t" * (i % 50)) for i in range(500)] + [(7, "again"), (7, "again"), (None, None), (9999, None)]
    out = sharding.shuffled(frame(spark, rows), 5, bucket_bytes=500).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(rows) and all(r.size == len(r.text or "") + 8 for r in out)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    again = sharding.shuffled(frame(spark, rows[::-1]).repartition(3), 5, bucket_bytes=500).collect()
    assert Counter((r.doc_id, r.text, r.shard, r.slot) for r in again) == Counter((r.doc_id, r.text, r.shard, r.slot) for r in out)
    assert sharding.shuffled(frame(spark, rows).limit(0)).count() == 0
    assert sorted(sharding.fisher_yates(50, 1)) == list(range(50))


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{D}/documents.parquet")
    out = corpus_pipeline.run(spark, D).collect()
    ids = {r.doc_id for r in docs.collect()}
    assert out and {r.doc_id for r in out} <= ids and corpus_pipeline.ORACLE_SQL is None
