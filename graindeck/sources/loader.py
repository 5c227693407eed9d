"""Loading by split and slice, hooks around a load, a cache with fingerprints, and logs of rollouts."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.sampling import numbered
from .corpus import SAMPLE, fingerprints, read_jsonl

SLICE = re.compile(r"(\w+)(?:\[(-?\d+%?)?:(-?\d+%?)?\])?")
SPLITS = ("train", "valid", "test")


def slice_bounds(spec: str, n: int) -> tuple[str, int, int]:
    """The split, first row (from 0) and end of a slice like train[:80%] or train[-10%:] of n rows; shares round half to even."""
    m = SLICE.fullmatch(spec)
    if not m:
        raise ValueError(f"no slice: {spec}")

    def at(text: str | None, default: int) -> int:
        if text is None:
            return default
        v = round(n * int(text[:-1]) / 100) if text.endswith("%") else int(text)
        return min(n, max(0, v + n if v < 0 or text.startswith("-") else v))

    return m.group(1), at(m.group(2), 0), at(m.group(3), n)


def sliced(df: DataFrame, spec: str, order: list[Column]) -> DataFrame:
    """The rows of a slice, by a total order."""
    _, start, end = slice_bounds(spec, df.count())
    return numbered(df, order, "_rn").where(F.col("_rn").between(start + 1, end)).drop("_rn")


def read_splits(spark: SparkSession, folder: str, schema: str = SAMPLE) -> dict[str, DataFrame]:
    """train, valid and test of a folder's JSON lines; a missing file is an empty split."""
    out = {}
    for name in SPLITS:
        try:
            out[name] = read_jsonl(spark, f"{folder}/{name}.jsonl", schema)[0]
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            out[name] = spark.createDataFrame([], schema).drop("_corrupt")
    return out


@dataclass
class Hooks:
    """What a load passes its rows through, each from DataFrame to DataFrame, in order."""

    before: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    after: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)


def loaded(df: DataFrame, reason: Column, prepared: dict[str, Column], hooks: Hooks | None = None, seed: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, rejected with their reason, counts by reason): hooks before, validation, preparation, hooks after. With a seed,
    accepted rows are in a repeatable random order."""
    for h in (hooks or Hooks()).before:
        df = h(df)
    marked = df.withColumn("_reason", reason)
    good = marked.where(F.col("_reason").isNull()).drop("_reason").withColumns(prepared)
    for h in (hooks or Hooks()).after:
        good = h(good)
    if seed is not None:
        good = good.orderBy(F.xxhash64(F.lit(seed), *(F.col(c).cast("string") for c in df.columns)))
    counts = marked.groupBy(F.coalesce("_reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return good, marked.where(F.col("_reason").isNotNull()).withColumnRenamed("_reason", "reason"), counts


def tool_samples(df: DataFrame) -> DataFrame:
    """Tool-call samples with the defaults of what they lack; a blank ground truth is the answer."""
    has = set(df.columns)
    made = {"type": F.coalesce("type", F.lit("tool_call")) if "type" in has else F.lit("tool_call"), "ground_truth": F.coalesce(F.nullif("ground_truth", F.lit("")), "answer") if "ground_truth" in has else F.col("answer"), "confidence": F.coalesce("confidence", F.lit(1.0)) if "confidence" in has else F.lit(1.0)}
    return df.withColumns(made)


def config_hash(config: dict, keys: tuple[str, ...] | None = None) -> str:
    """16 digits of the SHA-256 of a configuration, of some of its keys if given."""
    chosen = {k: v for k, v in config.items() if keys is None or k in keys}
    return hashlib.sha256(json.dumps(chosen, sort_keys=True, default=str).encode()).hexdigest()[:16]


class Cache:
    """Rows as Parquet with the fingerprints of the files they came from and of the configuration; what differs isn't used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _marks(self, source: str, config: dict) -> DataFrame:
        return fingerprints(self.spark, source).select("path", "length", F.col("modificationTime").cast("double").cast("long").alias("time"), "head").withColumn("config", F.lit(config_hash(config)))

    def save(self, df: DataFrame, source: str, config: dict) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/rows")
        self._marks(source, config).write.mode("overwrite").parquet(f"{self.folder}/marks")

    def load(self, source: str, config: dict) -> DataFrame | None:
        """The rows, or None unless sizes, times within a second, heads and configuration agree."""
        try:
            was = self.spark.read.parquet(f"{self.folder}/marks")
        except AnalysisException:
            return None
        now = self._marks(source, config)
        a, b = was.alias("a"), now.alias("b")
        same = (F.col("a.length") == F.col("b.length")) & (F.abs(F.col("a.time") - F.col("b.time")) <= 1) & (F.col("a.head") == F.col("b.head")) & (F.col("a.config") == F.col("b.config"))
        odd = a.join(b, F.col("a.path") == F.col("b.path"), "full").where(~F.coalesce(same, F.lit(False)))
        return self.spark.read.parquet(f"{self.folder}/rows") if odd.isEmpty() else None

    def invalidate(self) -> None:
        for part in ("rows", "marks"):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def log_rollouts(df: DataFrame, path: str, every: int = 1, iteration: str = "iteration") -> None:
    """Appends the rows of every so-manieth iteration as JSON lines, whole structs included."""
    df.where(F.col(iteration) % every == 0).write.mode("append").json(path)


def log_iterations(df: DataFrame, path: str, keys: list[str], name: str, value: str) -> None:
    """Appends a CSV row for each key with a column for each named value, the columns in order of their names."""
    names = [r[0] for r in df.select(name).distinct().orderBy(name).collect()]  # a column each
    df.groupBy(*keys).pivot(name, names).agg(F.first(value)).write.mode("append").option("header", True).csv(path)


def explained(df: DataFrame, columns: list[str], name: str = "explanation") -> DataFrame:
    """df with one JSON text of some of its columns, for a structured log."""
    return df.withColumn(name, F.to_json(F.struct(*columns)))
