"""Secret scans with multipart credential linking, by DataFrame functions only.

Strong matches (assignments, access keys, long hex) always count. Weak parts count only where complementary parts
stand in the same scope, that is at most SCOPE code points of other text apart:

* an identifier such as `client_id: x` where a secret of any kind does;
* a secret with a key of its own, such as `pwd: x`, where an identifier or an endpoint does;
* a bare 40-character token where an identifier does;
* an endpoint where a secret with a key of its own does.

The interval join runs inside each text: the parts are sorted by start, and for every part running maxima give the
latest end of each role before it and the earliest start after it. No pairs are made, and no cells cut a scope.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, let, load, running
from .spans import SPAN, listing, matches, of_kind

SCOPE = 256
_ASSIGNED = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)" + _ASSIGNED + r"([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
WEAK_ID = r"(?i:client_?id|access_?key(?:_?id)?|user(?:name)?|login|account)" + _ASSIGNED + r"([A-Za-z0-9@._-]+)"
WEAK_KEY = r"(?i:pwd|passphrase|private_?key|auth|bearer|credential)" + _ASSIGNED + r"([A-Za-z0-9+/_.=-]+)"
WEAK_BARE = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"""https?://[^\x00-\x20"'<>]++"""
BASE = ("assign", "access", "hex")


def base_spans(text: Column) -> Column:
    pair = F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))
    return F.concat(
        # a failing value still uses up its text, so the length is tested after the match
        matches(text, ASSIGN, "assign", 0, group=(1, lambda g: F.char_length(g) >= 6), hint=pair),
        matches(text, ACCESS, "access", 1, hint=F.contains(text, F.lit("AKIA"))),
        matches(text, HEX, "hex", 2),
    )


def weak_spans(text: Column) -> Column:
    pair = F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))
    return F.concat(
        matches(text, WEAK_ID, "weak_id", 3, group=(1, lambda g: F.char_length(g) >= 3), hint=pair),
        matches(text, WEAK_KEY, "weak_secret", 4, group=(1, lambda g: F.char_length(g) >= 6), hint=pair),
        matches(text, WEAK_BARE, "weak_secret", 5),
        matches(text, ENDPOINT, "endpoint", 6, hint=F.contains(text, F.lit("://"))),
    )


#: Roles of a part, by rank: what it may complete. Base spans are parts too.
ROLES = {"base": (0, 1, 2), "identifier": (1, 3), "keyed": (0, 4), "bare": (2, 5), "endpoint": (6,)}
_FAR = 1 << 30


def _beside(parts: Column) -> Column:
    """Per part (sorted by start) a struct of two structs over ROLES: the latest end before it, and the earliest start after it,
    negative, so that both are running maxima."""
    most = lambda a, x: F.struct(*[F.greatest(a[r], x[r]).alias(r) for r in ROLES])
    value = lambda of: lambda x: F.struct(*[F.when(x["rank"].isin(*ranks), of(x)).otherwise(F.lit(-_FAR)).alias(r) for r, ranks in ROLES.items()])
    none = F.struct(*[F.lit(-_FAR).alias(r) for r in ROLES])
    before = running(F.transform(parts, value(lambda x: x["end"])), most, none)
    after = F.reverse(running(F.transform(F.reverse(parts), value(lambda x: -x["start"])), most, none))
    return F.zip_with(before, after, lambda b, a: F.struct(b.alias("before"), a.alias("after")))


def linked(base: Column, weak: Column, scope: int = SCOPE) -> Column:
    """The weak parts that overlap no base span and have a complementary part at most `scope` code points away."""

    def near(x: Column, n: Column, *roles: str) -> Column:
        one = [(x["start"] - n["before"][r] <= scope) | (-n["after"][r] - x["end"] <= scope) for r in roles]
        return one[0] if len(one) == 1 else one[0] | one[1]

    clear = lambda x, n: (n["before"]["base"] <= x["start"]) & (-n["after"]["base"] >= x["end"])
    complete = lambda x, n: (
        F.when(x["rank"] == 3, near(x, n, "keyed", "bare")).when(x["rank"] == 4, near(x, n, "identifier", "endpoint"))
        .when(x["rank"] == 5, near(x, n, "identifier")).otherwise((x["rank"] == 6) & near(x, n, "keyed"))
    )
    rows = lambda parts: F.zip_with(parts, _beside(parts), lambda x, n: F.when(clear(x, n) & complete(x, n), x))
    found = F.array_compact(let(F.array_sort(F.concat(base, weak)), rows))
    return F.when(F.size(weak) > 0, F.filter(found, lambda x: x["rank"] > 2)).otherwise(F.array()).cast(SPAN)


def secret_spans(docs: DataFrame, scope_of: str = "text") -> DataFrame:
    """docs with the columns base and spans (arrays of start, rank, kind, end, value; code points, end exclusive).

    Null and empty texts have no spans; rows, ids and other columns stay as they are, repeated rows too; columns named
    base or spans (in any case) are replaced. A weak part that overlaps a base span is the same finding and is dropped,
    but may complete another.
    Parts that start at one place are taken in the order of their kinds.
    """
    keep = [c for c in docs.columns if c.lower() not in ("base", "spans")]
    t = F.coalesce(F.col(scope_of), F.lit(""))
    base, weak = free_names(docs, "_base", "_weak")
    d = docs.withColumn(base, base_spans(t)).withColumn(weak, weak_spans(t)).withColumn("spans", F.concat(base, linked(F.col(base), F.col(weak))))
    return d.select(*keep, F.col(base).alias("base"), "spans")


def op2_secrets(spark, sf_dir):
    d = secret_spans(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", *[of_kind(F.col("base"), k).alias(f"n_{k}") for k in BASE], F.sha2(listing(F.col("base")), 256).alias("base_sha256"), listing(F.col("spans")).alias("spans"), (F.size("spans") > 0).alias("leaks"))
