"""Thresholds, runs of criticals, running bests, trends and schedules over ordered metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def status(value: Column, good: float, warning: float, higher: bool = True) -> Column:
    """Strict on good, inclusive on warning; null is UNKNOWN."""
    best, fair = (value > good, value >= warning) if higher else (value < good, value <= warning)
    return F.when(value.isNull(), "UNKNOWN").when(best, "GOOD").when(fair, "WARNING").otherwise("CRITICAL")


def consecutive(df: DataFrame, by: str, order: list[str], state: str = "status", hit: str = "CRITICAL") -> DataFrame:
    """df with run: how many rows in a row, up to this one, have the state hit."""
    w = Window.partitionBy(by).orderBy(*order)
    island = F.sum((F.col(state) != hit).cast("int")).over(w)
    within = Window.partitionBy(by, "_island").orderBy(*order)
    run = F.sum((F.col(state) == hit).cast("int")).over(within)
    return df.withColumn("_island", island).withColumn("run", run).drop("_island")


def best_so_far(df: DataFrame, by: str, order: list[str], value: str, higher: bool = True) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("best", (F.max if higher else F.min)(value).over(w))


def trend(df: DataFrame, by: str, order: list[str], value: str, window: int = 5, limit: float = 0.01) -> DataFrame:
    """df with trend: the later half of the last values against the earlier one; flat within the limit."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(1 - window, 0)
    last = F.collect_list(value).over(w)
    half = F.floor(F.size("_last") / 2).cast("int")
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    change = mean(F.slice("_last", half + 1, F.size("_last"))) - mean(F.slice("_last", F.lit(1), half))
    out = F.when(F.size("_last") < 2, "flat").when(change > limit, "up").when(change < -limit, "down").otherwise("flat")
    return df.withColumn("_last", last).withColumn("trend", out).drop("_last")


def curriculum_ratio(i: Column, start: float = 0.85, end: float = 0.25, warmup: int = 100, taper: int = 500) -> Column:
    past = i - warmup
    return F.when(i < warmup, start).when(past >= taper, end).otherwise(start + past / max(taper, 1) * (end - start))


def curriculum_progress(df: DataFrame, iteration: str, level: str, reward: str) -> DataFrame:
    """For each iteration and level: mean, sample deviation (0 for one row) and count."""
    return df.groupBy(iteration, level).agg(F.avg(reward).alias("mean"), F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("std"), F.count(F.lit(1)).alias("n"))
