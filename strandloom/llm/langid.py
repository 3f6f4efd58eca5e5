"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds those of its letters, the first as it
is, the others rotated by one and two places, by elementwise products. A text's vector is the bundle (sum) of its
trigrams' vectors, a language's prototype the bundle over the texts learned from. The language whose prototype has
the largest cosine with the text is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, load

DIM, SYMBOLS, SEED = 1024, 128, 20_24
#: Most languages that may be learned; a prototype is DIM doubles.
MOST_LANGUAGES = 1000
#: A text has a language if its cosine is over this. Held-out texts of learned languages have 0.085 at least (sf0.001, sf0.01, sf0.1, check_h);
#: sentences in seven scripts not learned had 0.047 at most. About 2 / sqrt(DIM).
LEAST = 0.06
#: Texts that are counted at once: the counts have a column for each trigram met, so rows times characters are bounded too.
_BATCH, _CELLS = 256, 20_000_000


def letter_vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = np.random.Generator(np.random.PCG64(SEED)).integers(0, 2, (SYMBOLS, DIM), dtype=np.int8) * 2 - 1
    return v, np.roll(v, 1, axis=1), np.roll(v, 2, axis=1)


def symbol(cp: int) -> int:
    """Symbol of a code point: 0 for what is no letter, 1 to 26 for a to z, others by a hash of the lower-case letter."""
    c = chr(cp)
    if not c.isalpha():
        return 0
    low = ord(c.lower()[0])
    return low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % 2**32 * (SYMBOLS - 27) // 2**32


def symbol_table() -> np.ndarray:
    """Symbol of each code point below 65536."""
    return np.array([symbol(cp) for cp in range(0x10000)], np.uint8)


def trigrams(text: str, table: np.ndarray) -> np.ndarray:
    """Codes of all trigrams over letters and single blanks; empty if the text has no letter."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    high = cps >= 0x10000
    s = table[np.where(high, 0, cps)]
    if high.any():  # rare: emoji are no letters, mathematical letters and rare ideographs are
        kinds, place = np.unique(cps[high], return_inverse=True)
        s[high] = np.array([symbol(int(cp)) for cp in kinds], np.uint8)[place]
    if not s.any():
        return np.empty(0, np.int64)
    s = np.concatenate(([0], s, [0])).astype(np.int64)
    s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


def batches_of(texts: pd.Series) -> Iterator[slice]:
    """Runs of at most _BATCH texts of which rows times characters are at most _CELLS, if more than one."""
    at = chars = 0
    for i, t in enumerate(texts):
        n = len(t or "") + 2
        if i > at and (i - at == _BATCH or (i - at + 1) * (chars + n) > _CELLS):
            yield slice(at, i)
            at, chars = i, 0
        chars += n
    if at < len(texts):
        yield slice(at, len(texts))


class Encoder:
    """Vectors of batches of trigram lists."""

    def __init__(self) -> None:
        self.a, self.b, self.c = letter_vectors()
        self.index = np.zeros(SYMBOLS**3, np.int32)

    def vectors(self, vocabulary: np.ndarray) -> np.ndarray:
        return (self.a[vocabulary // SYMBOLS**2] * self.b[vocabulary // SYMBOLS % SYMBOLS] * self.c[vocabulary % SYMBOLS]).astype(np.float32)

    def bundle(self, counts: np.ndarray, vocabulary: np.ndarray, part: int = 4096) -> np.ndarray:
        """The rows' vectors, from one part of the vocabulary after another."""
        out = np.zeros((len(counts), DIM), np.float32)
        for i in range(0, len(vocabulary), part):
            out += counts[:, i : i + part] @ self.vectors(vocabulary[i : i + part])
        return out

    def counts(self, lists: list[np.ndarray], rows: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Trigram counts, summed into rows[i] of n, and the vocabulary of the columns."""
        every = np.concatenate(lists) if lists else np.empty(0, np.int64)
        self.index[every] = 1
        vocabulary = np.flatnonzero(self.index)
        self.index[vocabulary] = np.arange(len(vocabulary), dtype=np.int32)
        out = np.zeros((n, len(vocabulary)), np.float32)
        for row, codes in zip(rows, lists, strict=True):
            out[row] += np.bincount(self.index[codes], minlength=len(vocabulary))
        self.index[vocabulary] = 0
        return out, vocabulary


def prototypes(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Bundles per lang over every row of labelled (text, lang). Each task sends one row a language. More than MOST_LANGUAGES
    languages are a ValueError."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, enc, sums = symbol_table(), Encoder(), {}
        for pdf in batches:
            for run_of in batches_of(pdf["text"]):
                part = pdf.iloc[run_of]
                langs = sorted(set(part["lang"]))
                c, vocabulary = enc.counts([trigrams(t, table) for t in part["text"]], [langs.index(x) for x in part["lang"]], len(langs))
                v = enc.bundle(c, vocabulary)
                for lang, x in zip(langs, v, strict=True):
                    sums[lang] = sums.get(lang, 0) + x.astype(np.float64)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": [x.tolist() for x in sums.values()]})

    sums = bounded_batches(labelled).where("text is not null and lang is not null").select("lang", "text").mapInPandas(run, "lang string, v array<double>")
    total = sums.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = total.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    out = {r["lang"]: np.array([p["x"] for p in r["v"]]) for r in rows}
    return {k: v / np.linalg.norm(v) for k, v in out.items() if v.any()}


def guessed(docs: DataFrame, learned: dict[str, np.ndarray], name: str) -> DataFrame:
    """docs with the struct `name` of lang_pred and score."""
    names = sorted(learned)
    protos = np.array([learned[k] for k in names], np.float32)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table, enc = symbol_table(), Encoder()
        for texts in batches:
            pred, score = [], []
            for run_of in batches_of(texts):
                lists = [trigrams(t, table) if t and names else np.empty(0, np.int64) for t in texts.iloc[run_of]]
                c, vocabulary = enc.counts(lists, list(range(len(lists))), len(lists))
                v = enc.bundle(c, vocabulary)
                norm = np.linalg.norm(v, axis=1)
                cos = (v @ protos.T) / np.maximum(norm, 1e-9)[:, None] if names else np.zeros((len(lists), 1))
                best = cos.argmax(axis=1)
                for i, codes in enumerate(lists):
                    pred.append(names[best[i]] if len(codes) else "und")
                    score.append(min(1.0, max(0.0, round(float(cos[i, best[i]]), 6))) if len(codes) else 0.0)
            yield pd.DataFrame({"lang_pred": pred, "score": score})

    guess = F.pandas_udf(run, "lang_pred string, score double")
    return bounded_batches(docs).select("*", guess(F.col("text")).alias(name))


def identify(docs: DataFrame, learned: dict[str, np.ndarray]) -> DataFrame:
    """docs with lang_pred and score (the cosine, 0 at least). Null texts, texts without a letter, and all texts if
    nothing was learned, are `und` with score 0. Equal cosines go to the first language by name. All columns and
    rows stay as they are; columns named lang_pred or score are replaced."""
    keep = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    name = free_name(docs, "_guess")
    return guessed(docs.select(*keep), learned, name).select(*keep, F.col(f"{name}.lang_pred").alias("lang_pred"), F.col(f"{name}.score").alias("score"))


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes from the documents that are not held out."""
    return prototypes(docs.where(~held_out(F.col("doc_id"))))


def keep_identified(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs without those that have no language: no text, no letter, or a cosine not over `least`. All columns stay as they are.

    Equal texts fare alike, whatever their ids; where nothing can be learned (an empty table, or no lang at all) no text has a
    language.
    """
    name = free_name(docs, "_guess")
    g = guessed(docs, learn(docs), name)
    return g.where((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") > least)).select(*docs.columns)


def op8_language(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", "text"), learn(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
