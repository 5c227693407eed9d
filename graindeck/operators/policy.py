"""Statistics of token probabilities and of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def policy_terms(log_ratio: Column, advantage: Column, epsilon: float, epsilon_high: float, beta: float) -> dict[str, Column]:
    """Per token: ratio, clipped flags, divergence and loss."""
    ratio = F.exp(log_ratio)
    low, high = 1 - epsilon, 1 + epsilon_high
    kl = F.exp(-log_ratio) + log_ratio - 1
    cut = F.greatest(F.lit(low), F.least(F.lit(high), ratio))
    return {"ratio": ratio, "clipped_low": (ratio < low) & (advantage < 0), "clipped_high": (ratio > high) & (advantage > 0), "kl": kl, "loss": -F.least(ratio * advantage, cut * advantage) + beta * kl}


def policy_stats(df: DataFrame, by: str, log_ratio: Column, advantage: Column, epsilon: float = 0.2, epsilon_high: float = 0.2, beta: float = 0.1) -> DataFrame:
    t = policy_terms(log_ratio, advantage, epsilon, epsilon_high, beta)
    mean = lambda c: F.avg(t[c].cast("double")).alias(c)
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("tokens"), *map(mean, t))


def weighted_mean(df: DataFrame, by: list[str], value: str, weight: str, name: str) -> DataFrame:
    return df.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(name))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def alignment(a: Column, b: Column) -> dict[str, Column]:
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return {"norm_a": na, "norm_b": nb, "cosine": F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(0.0)}


def interpolated(a: Column, b: Column, alpha: float) -> Column:
    return F.zip_with(a, b, lambda x, y: x * alpha + y * (1 - alpha))
