"""Reports of a run: sparklines, summaries of metrics and curricula, batches, ranking signal, formats of answers, layers and steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import let

GLYPHS = "▁▂▃▄▅▆▇█"
STRETCH = 7


def sparkline(values: Column, width: int = 10) -> Column:
    """The last values as glyphs between their least and most, filled up in front with the first of them; blanks for none."""
    last = F.slice(values, F.greatest(F.lit(1), F.size(values) - width + 1), F.lit(width))

    def of(v: Column) -> Column:
        low, high = F.array_min(v), F.array_max(v)
        full = F.concat(F.array_repeat(v[0], width - F.size(v)), v)
        place = lambda x: F.greatest(F.lit(0), F.least(F.lit(STRETCH), ((x - low) / (high - low) * STRETCH).cast("int")))
        glyph = lambda i: F.substring(F.lit(GLYPHS), i + 1, F.lit(1))
        return F.when(high == low, F.lit(GLYPHS[4] * width)).otherwise(F.array_join(F.transform(full, lambda x: glyph(place(x))), ""))

    return F.when(F.size(values) == 0, F.lit(" " * width)).otherwise(let(last, of))


def sparklines(df: DataFrame, by: str, order: list[str], value: str, width: int = 10) -> DataFrame:
    """by and line: a sparkline of the last values of each metric. Only those are gathered, a bounded heap a task."""
    key = F.struct(*order)
    top = Window.partitionBy(by).orderBy(*(F.desc(c) for c in order))
    kept = df.withColumn("_rn", F.row_number().over(top)).where(F.col("_rn") <= width)
    last = kept.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct(key.alias("k"), F.col(value).alias("v")))), lambda x: x["v"]).alias("v"))
    return last.select(by, sparkline(F.col("v"), width).alias("line"))


def metric_summary(df: DataFrame, by: str, order: list[str], value: str, status: str = "status", higher: bool = True) -> DataFrame:
    """For each metric its best and final values, and how many warnings and criticals there were."""
    best = F.max(value) if higher else F.min(value)
    return df.groupBy(by).agg(best.alias("best"), F.max_by(value, F.struct(*order)).alias("final"), F.count_if(F.col(status) == "WARNING").alias("warnings"), F.count_if(F.col(status) == "CRITICAL").alias("criticals"))


def curriculum_summary(df: DataFrame, level: str, iteration: str, reward: str) -> DataFrame:
    """For each level with two points or more: first and last reward, the means of both halves (of the first and the last point
    under four), improvement, trend, points and range of iterations."""
    points = F.sort_array(F.collect_list(F.struct(F.col(iteration).alias("i"), F.col(reward).alias("r"))))
    x = df.groupBy(level).agg(points.alias("p"), F.count(F.lit(1)).alias("n")).where("n > 1")  # a point for each iteration
    rewards = F.transform("p", lambda q: q["r"])
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    cut = F.floor(F.col("n") / 2).cast("int")
    first = F.when(F.col("n") >= 4, mean(F.slice("v", F.lit(1), cut))).otherwise(F.col("v")[0])
    second = F.when(F.col("n") >= 4, mean(F.slice("v", cut + 1, F.col("n").cast("int")))).otherwise(F.element_at("v", -1))
    x = x.withColumn("v", rewards).withColumns({"first_half": first, "second_half": second})
    gain = F.col("second_half") - F.col("first_half")
    return x.select(level, F.col("v")[0].alias("first"), F.element_at("v", -1).alias("last"), "first_half", "second_half", gain.alias("improvement"), F.when(gain > 0, "improving").otherwise("stable_or_declining").alias("trend"), "n", F.col("p")[0]["i"].alias("from"), F.element_at("p", -1)["i"].alias("to"))


def batch_summary(df: DataFrame, by: list[str], score: str, correct: Column) -> DataFrame:
    """For each batch: count, right ones, mean, population deviation, least, most, median, and five bins, the last closed."""
    x = F.col(score)
    bins = [F.count_if((x >= i / 5) & ((x < (i + 1) / 5) if i < 4 else (x <= 1.0))).alias(f"bin{i}") for i in range(5)]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(correct).alias("correct"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("least"), F.max(x).alias("most"), F.percentile(x, 0.5).alias("median"), *bins)


def group_spreads(df: DataFrame, group: str, score: str) -> DataFrame:
    """One row: the mean, least and most of the groups' spreads, over groups with two scores or more."""
    spreads = df.groupBy(group).agg((F.max(score) - F.min(score)).alias("s"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return spreads.agg(F.count(F.lit(1)).alias("groups"), F.avg("s").alias("mean_spread"), F.min("s").alias("least_spread"), F.max("s").alias("most_spread"))


def ranking_signal(df: DataFrame, group: str, key: str, score: str, least: float = 0.05) -> DataFrame:
    """df with adjusted: in a group of two or more whose scores spread less than the least, a share of it is added by rank, and
    the scores are put back into the group's own spread. Only groups with so little spread are ranked."""
    stats = df.groupBy(F.col(group).alias("_g")).agg(F.min(score).alias("_low"), F.max(score).alias("_high"), F.count(F.lit(1)).alias("_n"))
    x = df.join(stats, F.col(group).eqNullSafe(F.col("_g")))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(score, key)) - 1
    close = (F.col("_n") > 1) & (F.col("_high") - F.col("_low") < least)
    moved = x.where(close).withColumn("_m", F.col(score) + rank * (F.lit(least) / F.col("_n")))
    ends = moved.groupBy(F.col(group).alias("_h")).agg(F.min("_m").alias("_a"), F.max("_m").alias("_b"))
    spread = F.col("_high") - F.col("_low")
    put = F.when(F.col("_b") > F.col("_a"), F.col("_low") + (F.col("_m") - F.col("_a")) * spread / (F.col("_b") - F.col("_a") + 1e-8)).otherwise(F.col("_m"))
    adjusted = moved.join(ends, F.col(group).eqNullSafe(F.col("_h"))).withColumn("adjusted", put).select(*df.columns, "adjusted")
    return adjusted.unionByName(x.where(~close).withColumn("adjusted", F.col(score).cast("double")).select(*df.columns, "adjusted"))


def answer_format(answer: Column) -> Column:
    """hermes, python_call, thinking or other."""
    call = answer.rlike(r"(?sU)^\s*\w+\(.*\)\s*$")
    return F.when(answer.contains("<tool_call>") & answer.contains("</tool_call>"), "hermes").when(call, "python_call").when(answer.contains("<think>") | answer.contains("</think>"), "thinking").otherwise("other")


def audited(df: DataFrame, kind: str = "type", answer: str = "answer") -> DataFrame:
    """For each type and format: rows, and of tool types those with thinking tags and those in another format."""
    shape = answer_format(F.col(answer))
    tool = F.coalesce(F.col(kind).isin("tool_call", "tool", "function_calling", "func"), F.lit(False))
    thinks = F.col(answer).contains("<think>") | F.col(answer).contains("</think>")
    return df.groupBy(F.coalesce(kind, F.lit("unknown")).alias("type"), shape.alias("format")).agg(F.count(F.lit(1)).alias("n"), F.count_if(tool & thinks).alias("thinking_calls"), F.count_if(tool & (shape == "python_call")).alias("plain_calls"))


def layers(spec: Column, count: int) -> Column:
    """The sorted layers that "0-8,20" names, below a count; all for a null or "all"."""
    one = lambda p: let(F.split(F.trim(p), r"\s*-\s*"), lambda b: F.sequence(b[0].cast("int"), F.element_at(b, -1).cast("int")))
    named = F.flatten(F.transform(F.split(spec, ","), one))
    every = F.sequence(F.lit(0), F.lit(count - 1))
    return F.when(spec.isNull() | (F.lower(spec) == "all"), every).otherwise(F.array_sort(F.array_distinct(F.filter(named, lambda i: (i >= 0) & (i < count)))))


def iterations(rows: Column, batch: int, epochs: int) -> Column:
    return epochs * F.ceil(rows / batch)


def projected(gradient: Column, direction: Column, strength: float = 0.1) -> Column:
    """A vector with a share of another added: its unit direction times its own length."""
    norm = F.sqrt(F.aggregate(direction, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))) + 1e-8
    return let(norm, lambda n: F.zip_with(gradient, direction, lambda g, d: g + strength * (d / n) * n))


def nearest_by_length(df: DataFrame, key: str, length: str, target: DataFrame, width: int = 64, reach: int = 9, most: int = 10) -> DataFrame:
    """For each row (want) of target, the rows whose length bucket is nearest, at most reach buckets away; ties by key. Buckets
    first say how many rows each is to give, so no more than the wanted rows of a bucket meet a target."""
    x = df.select(F.col(key).alias("_key"), F.floor(F.col(length) / width).alias("_b"))
    rn = F.row_number().over(Window.partitionBy("_b").orderBy("_key"))
    heads = x.withColumn("_rn", rn).where(F.col("_rn") <= most)  # no target takes more of one bucket
    near = target.withColumn("_t", F.floor(F.col("want") / width)).withColumn("_b", F.explode(F.sequence(F.col("_t") - reach, F.col("_t") + reach)))
    away = F.abs(F.col("_b") - F.col("_t"))
    met = near.join(heads, "_b").withColumn("away", away)
    place = F.row_number().over(Window.partitionBy("want").orderBy("away", F.desc("_b"), "_key"))
    return met.withColumn("place", place).where(F.col("place") <= most).select("want", "place", F.col("_key").alias(key), "away")
