"""Gaussian mixtures with fixed means i/p over allele frequencies, and the ploidy that they favour.

Frequencies are grouped first, so that an iteration is one small aggregation: its state is g weights and variances.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = 2.2250738585072014e-308
#: Distinct frequencies that are fitted on the driver; beyond, every step is an aggregation.
MOST_VALUES = 500_000
#: Guard of the weights: a step is rejected if an inner component is the heaviest and the smallest weight is under 1/g/LOW or under the
#: largest over g and HIGH. Without it, noise between the peaks favours higher ploidies. 0 turns it off.
LOW_RATIO, HIGH_RATIO = 5.0, 2.0


@dataclass
class Mixture:
    ploidy: int
    weights: list[float]
    variances: list[float]
    log_likelihood: float = 0.0
    aic: float = 0.0
    steps: int = 0

    @property
    def means(self) -> list[float]:
        return [i / self.ploidy for i in range(1, self.ploidy)]


def start(ploidy: int) -> Mixture:
    if ploidy < 2:
        raise ValueError("ploidy must be 2 or more")
    g = ploidy - 1
    return Mixture(ploidy, [1 / g] * g, [0.01] * g)


def pdf(x: Column, mean: float, var: float) -> Column:
    return F.exp(-((x - mean) * (x - mean)) / (2 * var)) / math.sqrt(2 * math.pi * var)


def parts(x: Column, m: Mixture) -> list[Column]:
    return [F.lit(w) * pdf(x, mu, v) for w, mu, v in zip(m.weights, m.means, m.variances, strict=True)]


def log_likelihood(grouped: DataFrame, m: Mixture) -> Column:
    """Aggregate over freq, n."""
    total = sum(parts(F.col("freq"), m), F.lit(0.0))
    return F.sum(F.col("n") * F.log(F.when(total == 0, LEAST).otherwise(total)))


def step(grouped: DataFrame, m: Mixture, low_ratio: float = LOW_RATIO, high_ratio: float = HIGH_RATIO) -> Mixture:
    """One EM step: weights and variances move, means stay, unless the guard of the weights rejects it. Variances are 1e-8 at least,
    so that a component cannot shrink onto one value."""
    ps = parts(F.col("freq"), m)
    total = sum(ps, F.lit(0.0))
    total = F.when(total == 0, LEAST).otherwise(total)
    n, x = F.col("n"), F.col("freq")
    row = grouped.agg(F.sum("n").alias("n"), log_likelihood(grouped, m).alias("ll"), *[F.sum(n * p / total).alias(f"r{i}") for i, p in enumerate(ps)], *[F.sum(n * p / total * (x - mu) * (x - mu)).alias(f"v{i}") for i, (p, mu) in enumerate(zip(ps, m.means, strict=True))]).first()
    size, g = float(row["n"] or 0), len(m.weights)
    if not size:
        return m
    weights = [row[f"r{i}"] / size for i in range(g)]
    variances = [max(row[f"v{i}"] / row[f"r{i}"], 1e-8) if row[f"r{i}"] > 0 else m.variances[i] for i in range(g)]
    top = weights.index(max(weights))
    if low_ratio and high_ratio and 0 < top < g - 1 and (min(weights) < 1 / g / low_ratio or min(weights) < max(weights) / g / high_ratio):
        weights, variances = m.weights, m.variances
    return Mixture(m.ploidy, weights, variances, row["ll"], 0.0, m.steps + 1)


def _fit_values(x: np.ndarray, n: np.ndarray, ploidy: int, most_steps: int, least_gain: float, low_ratio: float = LOW_RATIO, high_ratio: float = HIGH_RATIO) -> Mixture:
    m, last = start(ploidy), None
    if not n.sum():
        return m
    mu, g = np.array(m.means)[:, None], len(m.weights)
    w, v = np.array(m.weights)[:, None], np.array(m.variances)[:, None]

    def dens():
        p = w * np.exp(-((x - mu) ** 2) / (2 * v)) / np.sqrt(2 * np.pi * v)
        total = p.sum(axis=0)
        total[total == 0] = LEAST
        return p, total

    for _ in range(most_steps):
        p, total = dens()
        ll = float((n * np.log(total)).sum())
        r = n * p / total
        mass = r.sum(axis=1, keepdims=True)
        w2 = mass / n.sum()
        v2 = np.where(mass > 0, np.maximum((r * (x - mu) ** 2).sum(axis=1, keepdims=True) / np.maximum(mass, LEAST), 1e-8), v)
        top = int(w2.argmax())
        if not (low_ratio and high_ratio and 0 < top < g - 1 and (w2.min() < 1 / g / low_ratio or w2.min() < w2.max() / g / high_ratio)):
            w, v = w2, v2
        m.steps += 1
        if last is not None and abs(ll - last) <= least_gain:
            break
        last = ll
    m.weights, m.variances = w[:, 0].tolist(), v[:, 0].tolist()
    m.log_likelihood = float((n * np.log(dens()[1])).sum())
    m.aic = (2 * (2 * g - 1) - 2 * m.log_likelihood) / float(n.sum())
    return m


def _grouped(freq: DataFrame) -> DataFrame:
    return freq if "n" in freq.columns else freq.groupBy("freq").agg(F.count("*").alias("n"))


def _values(grouped: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Frequencies and their numbers, or None if there are more than MOST_VALUES."""
    rows = grouped.select("freq", "n").limit(MOST_VALUES + 1).collect()
    return None if len(rows) > MOST_VALUES else (np.array([r["freq"] for r in rows]), np.array([float(r["n"]) for r in rows]))


def _fit(grouped: DataFrame, values: tuple[np.ndarray, np.ndarray] | None, ploidy: int, most_steps: int = 1000, least_gain: float = 0.01, **ratios) -> Mixture:
    if values is not None:  # few distinct values: the same steps on the driver
        return _fit_values(*values, ploidy, most_steps, least_gain, **ratios)
    m, last = start(ploidy), None
    for _ in range(most_steps):
        m = step(grouped, m, **ratios)
        if last is not None and abs(m.log_likelihood - last) <= least_gain:
            break
        last = m.log_likelihood
    row = grouped.agg(F.sum("n").alias("n"), log_likelihood(grouped, m).alias("ll")).first()
    n = float(row["n"] or 0)
    m.log_likelihood = row["ll"] or 0.0
    m.aic = (2 * (2 * len(m.weights) - 1) - 2 * m.log_likelihood) / n if n else 0.0
    return m


def fit(freq: DataFrame, ploidy: int, **kw) -> Mixture:
    """freq: a column freq, grouped here unless it has n. kw: most_steps (1,000), least_gain (0.01, of the log-likelihood, either way), low_ratio, high_ratio."""
    g = _grouped(freq)
    return _fit(g, _values(g), ploidy, **kw)


def fit_ploidies(freq: DataFrame, ploidies=range(2, 11), **kw) -> list[Mixture]:
    """A fit of each ploidy; few distinct values come to the driver once for all of them."""
    g = _grouped(freq)
    values = _values(g)
    return [_fit(g, values, p, **kw) for p in ploidies]


def report(spark: SparkSession, fits: list[Mixture], n: int = 1) -> DataFrame:
    """ploidy, component, mean, weight, var, log_likelihood, aic."""
    rows = [(m.ploidy, i + 1, mu, w, v, m.log_likelihood, m.aic) for m in fits for i, (mu, w, v) in enumerate(zip(m.means, m.weights, m.variances, strict=True))]
    return spark.createDataFrame(rows, "ploidy int, component int, mean double, weight double, var double, log_likelihood double, aic double")


def best(fits: DataFrame) -> DataFrame:
    """One row: the ploidy of the smallest AIC, and of the largest likelihood."""
    return fits.agg(F.min_by("ploidy", "aic").alias("ploidy"), F.max_by("ploidy", "log_likelihood").alias("ploidy_by_likelihood"))


def density(freq: DataFrame, points: int = 64, bandwidth: float = 0.02) -> DataFrame:
    """x, density: a Gaussian kernel estimate over [0, 1]. The grid is fixed, so its product with the grouped frequencies is an explode."""
    g = freq.groupBy("freq").agg(F.count("*").alias("n"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(points)), lambda i: i / F.lit(float(points)))
    x = g.select("freq", "n", F.explode(grid).alias("x"))
    k = F.exp(-((F.col("x") - F.col("freq")) * (F.col("x") - F.col("freq"))) / (2 * bandwidth * bandwidth)) / (bandwidth * math.sqrt(2 * math.pi))
    return x.groupBy("x").agg((F.sum(F.col("n") * k) / F.sum("n")).alias("density"))
