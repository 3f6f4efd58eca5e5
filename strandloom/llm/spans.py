"""Positions of regular-expression matches by built-in functions only.

The pieces between the matches (split) and the matches (regexp_extract_all) give every start as a
running sum of lengths in code points. Patterns are possessive where that changes nothing, so that
long runs of one class cost linear time and no stack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let, running

SPAN = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def matches(text: Column, pattern: str, kind: str, rank: int, keep: Callable[[Column], Column] | None = None, group: tuple[int, Callable[[Column], Column]] | None = None, hint: Column | None = None) -> Column:
    """Array of the kept matches of pattern, leftmost and non-overlapping. group: a group's number and a test of its text.
    hint: a cheap condition that any text with a match fulfils."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    # the i-th start is all gaps up to i and all matches before i
    lengths = F.zip_with(found, F.slice(pieces, 1, F.size(found)), lambda v, gap: F.struct(v.alias("v"), gap.alias("gap")))
    before = lambda z: running(F.transform(z, lambda x: x["gap"] + F.char_length(x["v"])), lambda a, x: a + x, F.lit(0))
    spans = let(lengths, lambda z: F.zip_with(z, before(z), lambda x, at: F.struct((at + x["gap"]).alias("s"), x["v"].alias("v"))))
    if group is not None:
        spans = F.zip_with(spans, F.regexp_extract_all(text, F.lit(pattern), F.lit(group[0])), lambda x, g: F.struct(x["s"].alias("s"), x["v"].alias("v"), g.alias("g")))
    if keep is not None:
        spans = F.filter(spans, lambda x: keep(x["v"]))
    if group is not None:
        spans = F.filter(spans, lambda x: group[1](x["g"]))
    spans = F.transform(spans, lambda x: F.struct(x["s"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (x["s"] + F.char_length(x["v"])).alias("end"), x["v"].alias("value")))
    here = F.regexp_like(text, F.lit(pattern)) if hint is None else hint & F.regexp_like(text, F.lit(pattern))
    return F.when(here, spans).otherwise(F.array()).cast(SPAN)


def clear_of(spans: Column, base: Column, rank: int) -> Column:
    """The spans, all of rank `rank`, that overlap none of base, whose ranks are lower: no base span before one ends in it, none
    after one starts in it."""
    far = F.lit(1 << 30)
    most = lambda a, x: F.greatest(a, x)
    of = lambda value: lambda x: F.when(x["rank"] < rank, value(x)).otherwise(-far)

    def pick(parts: Column) -> Column:
        before = running(F.transform(parts, of(lambda x: x["end"])), most, -far)
        after = F.reverse(running(F.transform(F.reverse(parts), of(lambda x: -x["start"])), most, -far))
        rows = F.zip_with(parts, F.arrays_zip(before.alias("b"), after.alias("a")), lambda x, n: F.when((x["rank"] == rank) & (n["b"] <= x["start"]) & (-n["a"] >= x["end"]), x))
        return F.array_compact(rows)

    return let(F.array_sort(F.concat(base, spans)), pick)


#: Code points of the pieces that a text is cut into, so that a cut does not walk from its start.
CHUNK = 512


def replaced(text: Column, spans: Column) -> Column:
    """text with each of the sorted spans as its kind in angle brackets; spans that overlap are one, of the first's kind if one ends inside another."""
    div = lambda x: F.floor(x / CHUNK).cast("int")

    def cut(chunks: Column, a: Column, b: Column) -> Column:
        return F.when(b <= a, F.lit("")).otherwise(F.substring(F.array_join(F.slice(chunks, div(a) + 1, div(b - 1) - div(a) + 1), ""), a % CHUNK + 1, b - a))

    def pieces(chunks: Column, rows: Column) -> Column:
        with_ends = F.zip_with(rows, running(F.transform(rows, lambda x: x["end"]), lambda a, x: F.greatest(a, x), F.lit(0)), lambda x, at: F.when(x["end"] > at, F.concat(cut(chunks, at, x["start"]), F.lit("<"), x["kind"], F.lit(">"))).otherwise(F.lit("")))
        return F.concat(F.array_join(with_ends, ""), cut(chunks, F.array_max(F.transform(rows, lambda x: x["end"])), F.char_length(text)))

    whole = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CHUNK), F.lit(0))
    return F.when(F.size(spans) > 0, let(F.struct(whole.alias("c"), spans.alias("s")), lambda x: pieces(x["c"], x["s"]))).otherwise(text)


def listing(spans: Column) -> Column:
    """kind:start:end, by start and then by rank, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
