"""Byte-level BPE encoding and decoding by DuckDB queries inside each partition.

A text is cut into words by the tokenizer's pattern. The words that a task has not met yet become rows (word, place,
token), one a byte, of a recursive DuckDB query. A round joins neighbouring tokens with the merge table and contracts
each word's pairs of the least rank from the left, until no pair has a rank. Decoding joins ids with their bytes and
aggregates them in order. Spark deals the texts; a task holds its dictionary of words and one batch of texts.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re
import sys
from collections.abc import Iterator
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, load

#: Bytes of words that one query encodes, and ids that one query decodes (or a single word or text).
MOST_BYTES, MOST_IDS = 1_000_000, 1_000_000
#: Words that a task keeps with their ids; beyond, those met once go, or all if too few would go.
MOST_WORDS = 500_000
#: Bytes of a word up to which every round makes all of its rows.
SHORT = 64

# A round contracts each word's leftmost pair of the least rank. Rows of a word are made anew in every round that it takes part in, so this
# is for words of up to SHORT bytes.
_ENCODE = """
WITH RECURSIVE live(word, place, token, round) AS (
  SELECT word, place, token, 0 FROM start_bytes
 UNION ALL
  (WITH pairs AS (SELECT *, lead(token) OVER w AS next_token, lag(place) OVER w AS last_place FROM live WINDOW w AS (PARTITION BY word ORDER BY place)),
  best AS (SELECT word, min((ab::BIGINT << 16) | place) AS best FROM pairs JOIN merges ON a = token AND b = next_token GROUP BY word)
  SELECT word, place, CASE WHEN place = best & 65535 THEN (best >> 16)::INT ELSE token END, round + 1
  FROM pairs JOIN best USING (word) WHERE last_place IS DISTINCT FROM best & 65535))
SELECT word, list(token ORDER BY place) AS ids FROM live JOIN (SELECT word, max(round) AS round FROM live GROUP BY word) USING (word, round) GROUP BY word ORDER BY word
"""
# The same for long words, of which only changed rows are made. A round contracts all pairs of the least rank from the left, of overlapping
# ones every second. That equals contracting the leftmost one again and again, unless a new neighbour pair has a lower rank: then
# the round ends with it.
_ENCODE_LONG = """
WITH RECURSIVE live(word, place, token, changed) USING KEY (word, place) AS (
  SELECT word, place, token, true FROM start_bytes
 UNION
  (WITH pairs AS (
    SELECT word, place, token, lead(place) OVER w AS next_place, lead(token) OVER w AS next_token,
      lag(token) OVER w AS left_token, lead(token, 2) OVER w AS right_token, row_number() OVER w AS i
    FROM recurring.live SEMI JOIN (SELECT DISTINCT word FROM live WHERE changed) x USING (word)
    WHERE token >= 0 WINDOW w AS (PARTITION BY word ORDER BY place)),
  ranked AS (SELECT pairs.*, ab, min(ab) OVER (PARTITION BY word) AS least FROM pairs JOIN merges ON a = token AND b = next_token),
  lowest AS (SELECT *, i - row_number() OVER (PARTITION BY word ORDER BY i) AS run FROM ranked WHERE ab = least),
  apart AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word, run ORDER BY i) AS nth FROM lowest) WHERE nth % 2 = 1),
  around AS (
    SELECT word, i, place, next_place, x.ab, (l.ab < x.ab OR r.ab < x.ab) IS TRUE AS lower
    FROM (SELECT *, CASE WHEN nth > 1 THEN ab ELSE left_token END AS before FROM apart) x
    LEFT JOIN merges l ON l.a = before AND l.b = x.ab LEFT JOIN merges r ON r.a = x.ab AND r.b = right_token),
  chosen AS (SELECT * FROM (SELECT *, min(CASE WHEN lower THEN i END) OVER (PARTITION BY word) AS stop FROM around) WHERE stop IS NULL OR i <= stop)
  SELECT word, place, ab, true FROM chosen UNION ALL SELECT word, next_place, -1, false FROM chosen))
SELECT word, list(token ORDER BY place) AS ids FROM live WHERE token >= 0 GROUP BY word ORDER BY word
"""
_DECODE = "SELECT row, from_hex(string_agg(digits, '' ORDER BY place)) AS decoded, count(*) AS n FROM tokens JOIN pieces USING (id) GROUP BY row"


def read_ranks(vocabulary: bytes) -> dict[bytes, int]:
    """Token bytes and their ranks, which are their ids, of a file with a line of base64 bytes and rank for each."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line.strip())}


@functools.cache
def members(escape: str) -> frozenset[str]:
    """The characters of a class such as \\p{L}, by the Unicode version of tiktoken's engine."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    e = tiktoken.Encoding("class", pat_str=escape, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return frozenset(bytes(e.encode_ordinary(every)).decode())


def _ranges(chars: frozenset[str]) -> str:
    cps = np.array(sorted(map(ord, chars)))
    parts = np.split(cps, np.flatnonzero(np.diff(cps) > 1) + 1)
    return "".join(f"\\U{p[0]:08x}-\\U{p[-1]:08x}" for p in parts)


class Splitter:
    """Cuts texts into words. Where the `regex` library's classes differ from tiktoken's, as by Unicode versions, its exact form is used."""

    def __init__(self, pattern: str):
        escapes = sorted(set(re.findall(r"\\p\{\w+\}|\\s", pattern)) | ({r"\s"} if r"\S" in pattern else set()))
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
        self.disputed = frozenset().union(*(members(e) ^ frozenset(regex.findall(e, every)) for e in escapes))
        self.fast, self._pattern, self._exact = regex.compile(pattern).findall, pattern, None

    def exact(self, text: str) -> list[str]:
        if self._exact is None:
            inside, out = False, []
            for x in re.findall(r"\\p\{\w+\}|\\.|.", self._pattern, re.S):
                if x.startswith(r"\p") or x == r"\s":
                    out.append(_ranges(members(x)) if inside else f"[{_ranges(members(x))}]")
                elif x == r"\S":
                    out.append(f"[^{_ranges(members(chr(92) + 's'))}]")
                else:
                    inside = x == "[" or (inside and x != "]")
                    out.append(x)
            self._exact = re.compile("".join(out)).findall
        return self._exact(text)


class Codec:
    """A DuckDB connection with the merge table and the bytes of a vocabulary, and the words met so far."""

    def __init__(self, vocabulary: bytes, pattern: str):
        self.ranks, self.splitter = read_ranks(vocabulary), Splitter(pattern)
        self.forget()
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        a, b, ab = np.array(pairs, np.int32).reshape(-1, 3).T
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1})
        self._table("merges", {"a": a, "b": b, "ab": ab})
        self._table("pieces", {"id": np.array(list(self.ranks.values()), np.int32), "digits": [t.hex() for t in self.ranks]})

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("rows_", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM rows_")
        self.db.unregister("rows_")

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids, and the ids in a row, of words that are not empty, shorter ones first."""
        size = np.array([len(w) for w in words], np.int64)
        lengths, ids = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        for first, last in _parts(size, MOST_BYTES):
            n = size[first:last]
            self._table("start_bytes", {
                "word": np.repeat(np.arange(len(n), dtype=np.int32), n), "place": (np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)).astype(np.int32),
                "token": self.bytes[np.frombuffer(b"".join(words[first:last]), np.uint8)]})
            got = self.db.sql(_ENCODE if n.max() <= SHORT else _ENCODE_LONG).to_arrow_table()["ids"].combine_chunks()
            lengths.append(got.value_lengths().to_numpy())
            ids.append(got.flatten().to_numpy())
        return np.concatenate(lengths), np.concatenate(ids)

    def learn(self, words: set[str]) -> None:
        """Number words and keep their ids; a word that is a token as a whole is not merged."""
        whole = [w for w in words if w.encode() in self.ranks]
        rest = sorted((w.encode() for w in words.difference(whole)), key=len)
        lengths, ids = self.merge(rest)
        self.known |= zip([*whole, *(w.decode() for w in rest)], range(len(self.lengths), len(self.lengths) + len(words)), strict=True)
        self.lengths = np.concatenate([self.lengths, np.ones(len(whole), np.int64), lengths])
        self.ids = np.concatenate([self.ids, np.array([self.ranks[w.encode()] for w in whole], np.int32), ids])
        self.ends, self.uses = self.lengths.cumsum(), np.concatenate([self.uses, np.zeros(len(words), np.int64)])

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.lengths, self.ids, self.ends, self.uses = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def forget_rare(self) -> None:
        words = [(w, i) for w, i in self.known.items() if self.uses[i] > 1]
        if len(words) > MOST_WORDS // 2:
            return self.forget()
        number = np.array([i for _, i in words], np.int64)
        n = self.lengths[number]
        self.ids = self.ids[np.arange(n.sum()) + np.repeat(self.ends[number] - n.cumsum(), n)]
        self.known, self.lengths, self.ends, self.uses = {w: i for i, (w, _) in enumerate(words)}, n, n.cumsum(), np.zeros(len(n), np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of the texts, and the ids in a row."""
        if len(self.lengths) > MOST_WORDS:
            self.forget_rare()
        words = [self.splitter.fast(t) if t else [] for t in texts]
        new = set().union(*words).difference(self.known)
        odd = {w for w in new if not self.splitter.disputed.isdisjoint(w)}
        if odd:  # such words are never kept, so that all texts with them are found and cut anew
            words = [self.splitter.exact(t) if not odd.isdisjoint(ws) else ws for t, ws in zip(texts, words, strict=True)]
            new = set().union(*words).difference(self.known)
            odd = {w for w in new if not self.splitter.disputed.isdisjoint(w)}
        self.learn(new)
        count = np.array([len(ws) for ws in words], np.int64)
        of = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(words)), np.int64, count.sum())
        self.uses += np.bincount(of, minlength=len(self.uses))
        n = self.lengths[of]
        ids = self.ids[np.arange(n.sum()) + np.repeat(self.ends[of] - n.cumsum(), n)]
        for w in odd:
            del self.known[w]
        total = np.concatenate([[0], n.cumsum()])
        ends = count.cumsum()
        return total[ends] - total[ends - count], ids

    def decode(self, size: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """The bytes of rows of ids."""
        out: list[bytes] = []
        at = 0
        for first, last in _parts(size, MOST_IDS):
            n = size[first:last]
            part = ids[at : at + n.sum()].astype(np.int32)
            at += len(part)
            self._table("tokens", {"row": np.repeat(np.arange(len(n), dtype=np.int32), n), "place": np.arange(len(part), dtype=np.int32), "id": part})
            got = {row: (decoded, found) for row, decoded, found in self.db.sql(_DECODE).fetchall()}
            for i, want in enumerate(n):
                decoded, found = got.get(i, (b"", 0))
                if found != want:
                    raise ValueError("an id is not in the vocabulary")
                out.append(decoded)
        return out


def _parts(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive runs whose sizes add up to `most` at most, or of one row."""
    first, total = 0, 0
    for i, n in enumerate(size):
        if i > first and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if len(size):
        yield first, len(size)


@functools.lru_cache(2)
def codec(vocabulary: bytes, pattern: str) -> Codec:
    """One for each Python worker."""
    return Codec(vocabulary, pattern)


def _with(df: DataFrame, column: str, kind: T.DataType, run) -> DataFrame:
    """df with a column that run makes of record batches; columns of that name (in any case) are replaced."""
    keep = [c for c in df.columns if c.lower() != column]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(column, kind)])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), run(b)], names=[*keep, column])

    return bounded_batches(df).mapInArrow(batches, schema)


def encoded(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """docs with ids: the token ids of text, as the tokenizer of this vocabulary and pattern gives them, special tokens being plain text.

    vocabulary: path of the ranks; the driver reads it and sends it (under 1 MB) along with the function. Null and empty texts have no ids.
    Rows, nulls, repeats and other columns stay as they are; a column named ids is replaced. An empty table gives an empty result.
    """
    ranks = Path(vocabulary).read_bytes()

    def run(b: pa.RecordBatch) -> pa.Array:
        n, ids = codec(ranks, pattern).encode(b.column("text").to_pylist())
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], n.cumsum()]), pa.int32()), pa.array(ids, pa.int32()))

    return _with(docs, "ids", T.ArrayType(T.IntegerType(), False), run)


def decoded(tokens: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """tokens with decoded: the bytes of ids, in order (binary). Null ids give null, no ids no bytes; an id outside the vocabulary is a ValueError."""
    ranks = Path(vocabulary).read_bytes()

    def run(b: pa.RecordBatch) -> pa.Array:
        ids = b.column("ids")
        size = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        got = codec(ranks, pattern).decode(size, ids.flatten().to_numpy(zero_copy_only=False))
        return pa.array([x if ok else None for x, ok in zip(got, ids.is_valid().to_pylist(), strict=True)], pa.binary())

    return _with(tokens, "decoded", T.BinaryType(), run)


def op11_bpe(spark, sf_dir):
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    d = decoded(encoded(load(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern).drop("text"), path, pattern)
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
