"""Helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space that separates words, as a Java regular expression class body.
SPACE = r"\x20\x09-\x0D"


#: Spark's setting to delete the shuffle files of a query as it ends. Each plan that written() runs is run once, so none is read again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Runs of characters other than white space; no text has none. Splitting at one character needs no regular expression."""
    return F.array_remove(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " "), " "), "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def fold_of(key: Column, folds: int = 5) -> Column:
    """crc32 of the key as text, modulo the number of folds; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Only where driver and executors are one process, as in
    tests, may it be unset: then it is a temporary folder of this process."""
    if not (root := spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)):
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not (root := getattr(spark.sparkContext, "_graindeck_scratch", None)):
            root = tempfile.mkdtemp(prefix="graindeck-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
            spark.sparkContext._graindeck_scratch = root
    return root.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written as a table in the shared folder and read again: computed once, and its lineage ends there."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, was) if was is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes tables that written() made, once nothing reads them any more."""
    for df in frames:
        spark = df.sparkSession
        root = scratch_root(spark)
        for part in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if root.split(":", 1)[-1].lstrip("/") in part:
                path = spark._jvm.org.apache.hadoop.fs.Path(part)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files under a plan by the optimizer's statistics; at least 1."""
    return max(1, int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
