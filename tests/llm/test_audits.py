"""BPE against the tokenizer's own library, filter and source audits against plain Python."""

import base64
import random
import re
from collections import Counter
from itertools import permutations

import pytest

from strandloom.llm import bpe, divergence, filters


def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def library():
    import tiktoken

    path, pattern = vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    some = [chr(c) for c in range(0x20, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = [None, "", " ", "  \n\n \t x", "Hello world's can't I'LL <|endoftext|> 123,456.7", "\x1c\x1d\x85 a　b", "ab" * 500, "a" * 4001, "".join(rng.choice(letters) for _ in range(3000))]
    texts += ["՘՘ a՘b", "\U000323b0 x\U000323b0", "\U00011de0 1\U00011de0", "1١Ⅰ ½"]  # letters and digits of newer Unicode versions
    texts += ["".join(rng.choice(some) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    return texts + [" ".join("".join(rng.choice("abcé日 ") for _ in range(rng.randint(1, 12))) for _ in range(300))] * 2


def test_bpe_equals_the_library(spark):
    path, pattern = vocabulary()
    enc = library()
    rows = [(i, t, "x", 1.5) for i, t in enumerate(odd_texts())]
    docs = spark.createDataFrame([*rows, (None, "no id", None, None)], "doc_id long, text string, IDS string, token double")
    got = bpe.decoded(bpe.encoded(docs, path, pattern), path, pattern)
    assert got.columns == ["doc_id", "text", "token", "ids", "decoded"]
    got = got.collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert r.ids == enc.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encoded(docs.limit(0), path, pattern).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decoded(nothing, path, pattern).collect()} == {1: None, 2: b""}


def test_bpe_in_parts_and_with_a_short_memory(monkeypatch):
    path, pattern = vocabulary()
    enc, c = library(), bpe.Codec(open(path, "rb").read(), pattern)
    monkeypatch.setattr(bpe, "MOST_BYTES", 50)
    monkeypatch.setattr(bpe, "MOST_IDS", 7)
    texts = odd_texts()[:40]
    want = [enc.encode_ordinary(t or "") for t in texts]
    for most in (3, 100_000, 900, 900):
        monkeypatch.setattr(bpe, "MOST_WORDS", most)
        n, ids = c.encode(texts)
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])
    for _ in range(30):  # words met twice stay
        c.encode(["a rather long sentence with words"] * 2 + [f"once{i}" for i in range(40)])
        assert c.encode([texts[4]])[1].tolist() == want[4]
    assert 0 < len(c.known) <= 900 + 60
    assert c.decode(n, ids) == [(t or "").encode() for t in texts]
    with pytest.raises(ValueError):
        c.decode(bpe.np.array([1]), bpe.np.array([70_000]))


@pytest.mark.parametrize("short", [0, 64])
def test_bpe_where_a_new_pair_ranks_lower(monkeypatch, short):
    monkeypatch.setattr(bpe, "SHORT", short)
    # contracting every pair of the least rank at once would be wrong: "xyx" is made before the second "xy"
    tokens = [bytes([i]) for i in range(256)] + [b"xyx", b"xy", b"xyz", b"yy", b"yyy", b"yyyy"]
    ranks = {t: i for i, t in enumerate(tokens)}
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    c = bpe.Codec(b"\n".join(base64.b64encode(t) + b" %d" % i for t, i in ranks.items()), r"\S+|\s+")
    rng = random.Random(1)
    words = ["xyxy", "xyxyxy", "yyyyy", "xyzxyx"] + ["".join(rng.choice("xyz") for _ in range(rng.randint(1, 30))) for _ in range(300)]
    assert c.encode(words)[1].tolist() == sum((enc.encode_ordinary(w) for w in words), [])


def filter_rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(90):
        n = rng.choice((0, 50, 99, 100, 101, 150))
        t = " ".join(rng.sample(words, n) if rng.random() < 0.6 else [rng.choice(words[:90]) for _ in range(n)])
        t += rng.choice(("", "", " #", " AB CD" * 20, "\x0bÄÖ"))
        rows.append((i, t, rng.choice(("en", "de", None, ""))))
    rows += [(100 + i, rows[i % 7][1], rng.choice(("en", "fr"))) for i in range(40)]
    rows += [(200, None, "en"), (201, "", "en"), (202, None, None), (5, rows[5][1], "en"), (5, rows[6][1], "en"), (None, rows[5][1], "en"), (None, "only here", "xx")]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1))) for i in range(0, 140, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    return rows, labels


def test_filters_against_plain_python(spark):
    rows, labels = filter_rows()
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))

    def fails(i, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}

    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    d = [(p or "", fails(i, t or ""), i is not None and i in good, i is not None and i in toxic) for i, t, p in rows]
    want = {}
    for part in {x[0] for x in d}:
        own = [x for x in d if x[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                all_fail = sum(x[1][f] for x in own)
                want[part, "".join(order), step + 1] = [len(left), len(gone), all_fail - len(gone), sum(x[1][f] and sum(x[1].values()) == 1 for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
    total = Counter()
    for (part, order, step), x in want.items():
        total[part, order[step - 1]] += x[1]
    docs = spark.createDataFrame([(*r, 7, True) for r in rows], "doc_id long, text string, lang string, bits int, first boolean").repartition(5)
    lab = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = filters.audit(docs, lab)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {(r.part, r.filter_order, r.step): (list(r)[3:9], r.shapley) for r in got.collect()}
    assert got == {k: (v, total[k[0], k[1][k[2] - 1]]) for k, v in want.items()}
    assert filters.audit(docs.limit(0), lab).count() == 0
    strings = filters.audit(docs.selectExpr("cast(doc_id as string) doc_id", "text", "lang"), lab)
    assert strings.where("step = 1").selectExpr("sum(kept + removed)").first()[0] == 120 * len(rows)


def source_rows():
    rng = random.Random(9)
    words = [f"{a}{b}" for a in "abcdeé" for b in "xyzß日"]
    rows = []
    for i in range(260):
        lang, source = rng.choice(("en", "en", "de", None)), f"s{min(rng.randrange(9), rng.randrange(9))}"
        n = rng.choice((0, 1, 5, 20))
        rows.append((i, rng.choice((" ", ", ", "1", "\u007f")).join(rng.choice(words[rng.randrange(3) :]).upper() if rng.random() < 0.3 else rng.choice(words) for _ in range(n)), lang, source))
    return [*rows, (400, None, "en", None), (401, "lonely words", "fr", "s1"), (402, "", "xx", "s1"), (403, None, "xx", "s2"), (404, "Äx äx É", "en", "s1"), *rows[:5]]


@pytest.mark.parametrize("cells", [64, 1 << 16])
def test_divergence_against_plain_python(spark, cells):
    least = 12
    rows = source_rows()
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    d = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(low))) for _, t, lang, source in rows]
    want = []
    for lang in {x[0] for x in d}:
        own = [x for x in d if x[0] == lang]
        df = Counter(t for x in own for t in set(x[2]))
        kept = {t for t, n in df.items() if n >= least}
        count = {s: Counter(t for x in own if x[1] == s for t in x[2] if t in kept) for s in {x[1] for x in own}}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}  # noqa: B023,E731
        p, q = {s: share(c) for s, c in count.items()}, share(sum(count.values(), Counter()))
        for s in count:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in count if o != s]
            items = [(p[s][t] - q[t], t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", items)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                want += [(lang, s, part, item, v, r + 1) for r, (v, item) in enumerate(found) if part == "pair" or r < 6]
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, lang string, source string, term string, n int").repartition(3)
    got = divergence.divergence(docs, least=least, most_rank=6, cells=cells)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(x[2] == "term" for x in want)
    assert divergence.divergence(docs.limit(0)).count() == 0


@pytest.mark.parametrize("held", [3, 10_000])
def test_impossible_terms_are_dropped_and_frequent_ones_never(spark, monkeypatch, held):
    monkeypatch.setattr(divergence, "MOST_TERMS", held)
    docs = spark.createDataFrame(source_rows(), "doc_id long, text string, lang string, source string").selectExpr("coalesce(lang, '') lang", "coalesce(source, '') source", "text").repartition(3)
    df, n = Counter(), Counter()
    for r in docs.collect():
        words = [w.decode() for w in divergence.terms(r.text)]
        n.update((r.lang, r.source, w) for w in words)
        df.update((r.lang, w) for w in set(words))
    for cells in (64, 1 << 14):
        bits = divergence.frequent_bits(docs, 12, cells)
        rows = divergence.counted(docs, bits, cells).collect()
        left, seen = Counter(), Counter()
        for r in rows:
            left[r.lang, r.term] += r.df
            seen[r.lang, r.source, r.term] += r.n
        assert all(df[k] == v for k, v in left.items()) and all(n[k] == v for k, v in seen.items())
        assert {k for k, v in df.items() if v >= 12} <= set(left)
    assert set(left) < set(df)


def test_terms_of_long_texts_and_lists_of_entities(spark):
    import time

    from strandloom.llm import pii

    words = [f"w{i}q" for i in range(120_000)]
    texts = ["some text of no interest"] * 5 + [f"other words {i} here" for i in range(60)]
    texts += [" ".join(words) + " bob@example.com", " ".join(f"p{i}@list.org v{i}q" for i in range(3000))]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    n = {r.doc_id: sum(x.kind == "term" for x in r.spans) for r in pii.pii_spans(d).collect()}
    assert n[65] == 120_000 and n[66] == 3000 and sum(n.values()) == 123_000
    assert time.time() - began < 120


@pytest.mark.parametrize("rows", [4, 8, 18])
def test_few_labels_separate(spark, rows):
    from strandloom.llm import mixing

    texts = [(i, f"{'fine prose of good taste' if i % 2 else 'spam click now cheap'} number{i}") for i in range(rows)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(rows)], "doc_id long, quality int, toxic int")
    p = {r.doc_id: r.m.p for r in mixing.with_posteriors(docs, mixing.fit_classifier(docs, labels), "m").collect()}
    assert all(p[i][0 if i % 2 else 1] > 0.9 for i in range(rows))
