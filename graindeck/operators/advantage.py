"""Weighted rewards, scaffold penalties and group-relative advantages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

EPSILON = 1e-4


def weighted(scores: dict[str, float]) -> Column:
    """The weighted mean of score columns; a missing score counts 0 with its full weight."""
    total = sum(scores.values())
    return sum((F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0)) * w for c, w in scores.items()), F.lit(0.0)) / total


def penalized(reward: Column, scaffold: Column, weight: float, mode: str = "multiplicative") -> Column:
    return reward * (1.0 - scaffold * weight) if mode == "multiplicative" else reward - scaffold * weight


def advantages(df: DataFrame, group: str, reward: str = "reward") -> DataFrame:
    """df with advantage: the distance from the group's mean in its population deviations; 0 for groups of one.

    The group's moments come from a partial aggregate and a join, not from a window, so a group that holds a large
    share of all rows isn't gathered in a task, and a skewed join is split."""
    stats = df.groupBy(F.col(group).alias("_g")).agg(F.avg(reward).alias("_mean"), F.stddev_pop(reward).alias("_std"), F.count(F.lit(1)).alias("_n"))
    z = F.when(F.col("_n") > 1, (F.col(reward) - F.col("_mean")) / (F.col("_std") + EPSILON)).otherwise(0.0)
    return df.join(stats, F.col(group).eqNullSafe(F.col("_g"))).withColumn("advantage", z).drop("_g", "_mean", "_std", "_n")


def function_stats(df: DataFrame, scores: list[str]) -> DataFrame:
    """For each score: mean, population deviation and the share of rows that have it, in one pass over unmultiplied rows."""
    value = lambda s: F.nanvl(F.col(s).cast("double"), F.lit(None).cast("double"))
    made = [F.struct(F.lit(s).alias("scorer"), F.avg(value(s)).alias("mean"), F.coalesce(F.stddev_pop(value(s)), F.lit(0.0)).alias("std"), (F.count(value(s)) / F.count(F.lit(1))).alias("coverage")) for s in scores]
    return df.agg(F.array(*made).alias("all")).select(F.explode("all").alias("r")).select("r.*").where("coverage is not null")


def group_stats(df: DataFrame, group: str, reward: str = "reward") -> DataFrame:
    return df.groupBy(group).agg(F.avg(reward).alias("mean"), F.stddev_pop(reward).alias("std"), F.count(F.lit(1)).alias("n"))


def ranked(df: DataFrame, group: str, key: str, reward: str = "reward") -> DataFrame:
    return df.withColumn("ranking", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(reward), key)))
