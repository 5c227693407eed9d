"""A corpus from documents: quality, line dedup, near duplicates, mixing, tokens. Each stage is written before the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from graindeck.llm import bpe, linededup, mixing, quality, sigtree
from graindeck.llm.common import scratch_root, table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    judged = quality.classify(docs, table(spark, sf_dir, "labels"))
    return judged.where(F.col("predicted") == 1).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier ones; one that keeps no word of those it had goes. n_chars follows."""
    cleaned = linededup.dedup_lines(docs)
    emptied = (F.size("lines_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    kept = cleaned.where(~F.coalesce(emptied, F.lit(False)))
    chars = F.when(F.size("lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", chars).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of rows that are linked by near-equal shingle sets: of the smallest id (none comes last), then text hash.

    Rows are linked one by one, whatever their ids; those without a word are in no group and stay."""
    keyed = written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    linked = sigtree.link(keyed.select("_row", "text"), key="_row").select("_row", "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text").alias("hash"), "_row")
    ranked = keyed.select("_row", order.alias("o")).join(linked, "_row")
    stay = ranked.groupBy("component_id").agg(F.min("o").alias("o")).select(F.col("o._row").alias("_row"))
    return keyed.join(stay, "_row", "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents without a word have no copies to take and stay out."""
    mixed = mixing.mix(docs)
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, packed, with their number and hashes; decoding them gives the text back."""
    return bpe.round_trip(docs, bpe.vocabulary(), packed="token_ids").drop("text")


STAGES = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", one_of_each),
    ("source_mixing", mix_sources),
    ("bpe", tokenize),
]

#: Training, rounding by hashes and tokenizers can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{scratch_root(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
