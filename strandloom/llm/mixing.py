"""Mixing sources to target weights with soft membership.

A softmax classifier, fitted on a bounded sample of the labelled rows, gives every document posteriors over the
domains. Document rates r >= 0 are then fitted so that the expected domain token totals sum_i r_i n_i p_ik equal
the targets: projected gradient on least squares, distributed. A gradient step needs only the K totals of the
current rates, so each iteration is one aggregation over slim rows, and a document's rate is a short expression
of its posteriors and the K numbers of each past iteration; no rate table moves.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, load, written

DOMAINS = ("good", "poor", "toxic")
TARGETS = {"good": 0.75, "poor": 0.2, "toxic": 0.05}
#: Most labelled documents that the classifier is fitted on (those of the smallest seeded hashes), and its hashed features.
MOST_LABELLED, FEATURES = 4000, 1 << 18
#: Share of the sampled documents that a feature must occur in, so 10 of 4,000 and any one of 400 or fewer; rarer ones keep weight 0.
LEAST_SHARE = 1 / 400
STEPS, SCALE, RIDGE = 150, 1.0, 3e-3
#: Steps of projected gradient at most; they end once every domain's share is met to TOLERANCE, or no longer moves.
MOST_STEPS, TOLERANCE, SEED = 200, 1e-4, 11


def _word_ids(text: str | None, seen: dict[str, int]) -> tuple[int, list[int]]:
    """Number of words, and the hashed ids of the distinct ones."""
    words = (text or "").lower().split()
    if len(seen) > 100_000:
        seen.clear()
    return len(words), list({seen.get(w) or seen.setdefault(w, 1 + xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) % (FEATURES - 1)) for w in {x.strip(".,;:!?") for x in set(words)}})


def fit_classifier(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> np.ndarray:
    """Weights (FEATURES x domains; row 0 the bias) of a softmax regression on the presence of words.

    Labels: toxic 1 is toxic, else quality 1 good, else poor; rows with nulls are not used. Without labelled rows
    every weight is 0 and the posteriors are equal. At most `most` labels are used, and, as ids may repeat, at most twice as
    many documents.
    """
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1)
    chosen = labels.where("doc_id is not null and quality is not null and toxic is not null").select(F.col("doc_id").alias("_id"), domain.alias("domain")).distinct()
    chosen = F.broadcast(chosen.orderBy(F.xxhash64(F.lit(SEED), "_id"), "domain").limit(most))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        for pdf in batches:
            # every distinct word, in four bytes; the bytes sort as the numbers do
            yield pd.DataFrame({"h": pdf["h"], "t": pdf["t"], "domain": pdf["domain"], "ids": [np.array(sorted(_word_ids(t, seen)[1]), ">i4").tobytes() for t in pdf["text"]]})

    labelled = bounded_batches(docs).select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id")).select(F.xxhash64(F.lit(SEED), "_id").alias("h"), F.xxhash64("text").alias("t"), "domain", "text")
    # ids may repeat: the rows of the smallest hashes, the same ones whichever way they came
    rows = labelled.mapInPandas(run, "h long, t long, domain int, ids binary").orderBy("h", "domain", "t").limit(2 * most).collect()
    w = np.zeros((FEATURES, len(DOMAINS)))
    if not rows:
        return w
    rows.sort(key=lambda r: (r["domain"], bytes(r["ids"])))  # one order of sums, whichever way the rows came
    y = np.eye(len(DOMAINS))[[r["domain"] for r in rows]]
    size = np.array([len(r["ids"]) // 4 for r in rows])
    row = np.repeat(np.arange(len(rows), dtype=np.int32), size)
    col = np.frombuffer(b"".join(bytes(r["ids"]) for r in rows), ">i4").astype(np.int32)
    often = np.bincount(col, minlength=FEATURES) >= max(1, LEAST_SHARE * len(rows))
    known = np.flatnonzero(often)
    row, col = row[often[col]], col[often[col]]
    place = np.searchsorted(known, col)
    u, b = np.zeros((len(known), len(DOMAINS))), np.zeros(len(DOMAINS))
    squares, b_squares = np.full_like(u, 1e-6), np.full_like(b, 1e-6)
    for _ in range(STEPS):  # Adagrad over the whole sample
        z = np.stack([np.bincount(row, u[place, k], len(rows)) for k in range(u.shape[1])], axis=1) * SCALE + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        d = (p / p.sum(axis=1, keepdims=True) - y) / len(rows)
        g = np.stack([np.bincount(place, d[row, k], len(known)) for k in range(u.shape[1])], axis=1) * SCALE + RIDGE * u
        squares += g * g
        b_squares += d.sum(axis=0) ** 2
        u -= 0.3 * g / np.sqrt(squares)
        b -= 0.3 * d.sum(axis=0) / np.sqrt(b_squares)
    w[known], w[0] = u * SCALE, b
    return w


def with_posteriors(docs: DataFrame, weights: np.ndarray, name: str = "_mix") -> DataFrame:
    """docs with the struct `name`: n_tokens (words of the whole text) and p, the posteriors over DOMAINS."""
    model = weights.astype(np.float32)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        for texts in batches:
            n, p = [], []
            for text in texts:
                count, ids = _word_ids(text, seen)
                z = model[0] + model[ids].sum(axis=0)
                e = np.exp(z - z.max())
                n.append(count)
                p.append(np.round(e.astype(np.float64) / float(e.sum()), 6))
            yield pd.DataFrame({"n_tokens": n, "p": p})

    return bounded_batches(docs).withColumn(name, F.pandas_udf(run, "n_tokens long, p array<double>")(F.col("text")))


def rate_of(p: Column, steps: list[np.ndarray]) -> Column:
    """The rate after the given steps: from 1, each step subtracts p.z and projects to 0 or more."""
    if not steps:
        return F.lit(1.0)
    past = F.array(*[F.array(*[F.lit(float(x)) for x in z]) for z in steps])
    return F.aggregate(past, F.lit(1.0), lambda r, z: F.greatest(F.lit(0.0), r - sum((F.get(p, F.lit(k)) * F.get(z, F.lit(k)) for k in range(len(DOMAINS))), F.lit(0.0))))


def fit_rates(slim: DataFrame, targets: dict[str, float] = TARGETS) -> tuple[list[np.ndarray], float]:
    """The steps of projected gradient, and the largest difference that is left between a domain's share of the expected
    tokens and its target. slim: n_tokens, p. Rates are measured in the metric of tokens, and the gradient is scaled by the
    inverse Gram matrix of the domains, for which a step of 1 always descends. Targets that no rates meet, such as any but
    equal ones where all posteriors are equal, end in the nearest totals that were reached, with a warning.
    """
    k = len(DOMAINS)
    p = [F.get("p", F.lit(i)) for i in range(k)]
    n = F.col("n_tokens")
    first = slim.agg(F.sum(n).alias("n"), *[F.sum(n * p[i] * p[j]).alias(f"g{i}{j}") for i in range(k) for j in range(k)]).first()
    total = float(first["n"] or 0)
    if not total:
        return [], 0.0
    gram = np.array([[first[f"g{i}{j}"] for j in range(k)] for i in range(k)])
    inverse = np.linalg.pinv(gram, rcond=1e-9)
    share = np.array([targets.get(d, 0.0) for d in DOMAINS])
    wanted = total * share / share.sum()
    steps: list[np.ndarray] = []
    was = None
    while True:
        r = rate_of(F.col("p"), steps)
        row = slim.agg(*[F.sum(n * p[i] * r).alias(f"t{i}") for i in range(k)]).first()
        off = np.array([row[f"t{i}"] for i in range(k)]) - wanted
        gap = float(np.abs(off).max() / total)
        if gap <= TOLERANCE:
            return steps, gap
        if len(steps) == MOST_STEPS or was is not None and np.abs(off - was).max() <= 1e-3 * TOLERANCE * total:
            warnings.warn(f"the targets were missed by {gap:.4f} of all tokens after {len(steps)} steps", stacklevel=2)
            return steps, gap
        was = off
        steps.append(np.array([float(f"{x:.12g}") for x in inverse @ off]))


def copies_of(rate: Column, *key: Column) -> Column:
    """The rate as a whole number, rounded up with the probability of its fraction by a seeded hash of key."""
    u = F.pmod(F.xxhash64(F.lit(SEED), *key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + u).cast("long")


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, one posterior column a domain, rate, copies, and off_target, the same in all rows:
    the largest difference left between a domain's share of the expected tokens and its target.

    Null and wordless texts have no tokens, weigh nothing and get rates from the prior alone. Rows that share id
    and text get equal copies; null ids are kept, other columns ignored; an empty table gives an empty result.
    """
    slim = with_posteriors(docs.select("doc_id", "text"), fit_classifier(docs, labels))
    slim = written(slim.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("_mix.n_tokens").alias("n_tokens"), F.col("_mix.p").alias("p")), "mixing")
    steps, gap = fit_rates(slim, targets)
    out = slim.withColumn("rate", F.round(rate_of(F.col("p"), steps), 6))
    copies = copies_of(F.col("rate"), F.col("doc_id"), F.col("text_hash"))
    return out.select("doc_id", "n_tokens", *[F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate", copies.alias("copies"), F.lit(round(gap, 6)).alias("off_target"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """docs, each row as often as its copies say (0 drops it); all columns stay.

    Null texts and null ids are handled as in mixing_rates; rows that share id and text fare alike. Without labels all
    posteriors are equal: rows stay as they are where the targets are equal too, else fit_rates warns that they were missed.
    An empty table gives an empty result.
    """
    # written whole: else the classifier runs again for the totals, for the filter on copies and for the rows kept
    name = free_name(docs, "_mix")
    d = written(with_posteriors(docs, fit_classifier(docs, labels), name), "mixing")
    steps, _ = fit_rates(d.select(F.col(f"{name}.n_tokens").alias("n_tokens"), F.col(f"{name}.p").alias("p")), targets)
    copies = copies_of(F.round(rate_of(F.col(f"{name}.p"), steps), 6), F.col("doc_id"), F.xxhash64("text"))
    d = d.withColumn(name, copies).where(F.col(name) > 0).withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), F.col(name))))
    return d.select(*docs.columns)


def op4_mixing(spark, sf_dir):
    return mixing_rates(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
