"""Rollouts made from documents by a fixed rule, so that every branch of the scorers is reached."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rollout_id, prompt_idx, prompt, completion, answer, type, scaffold of each document."""
    text = F.coalesce("text", F.lit(""))
    line = F.split_part(text, F.lit("\n"), F.lit(1))
    rest = F.substring(text, F.length(line) + 2, F.length(text))
    k = F.col("doc_id") % 5
    completion = (
        F.when(k == 0, F.concat(F.lit("<think>\n"), line, F.lit("\n</think>\n"), rest))
        .when(k == 1, F.concat(F.lit("<think>"), text))
        .when(k == 2, text)
        .when(k == 3, F.concat(F.lit("</think>"), line, F.lit("<think>"), rest))
        .otherwise(F.concat(F.lit("<think>"), line, F.lit("</think>\\boxed{"), (F.col("doc_id") % 10).cast("string"), F.lit("}")))
    )
    kind = F.element_at(F.array(*map(F.lit, ("math", "code", "essay", "mcq", "reasoning", "other"))), (F.col("doc_id") % 6).cast("int") + 1)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rollout_id"), F.col("source").alias("prompt_idx"), F.col("lang").alias("prompt"), completion.alias("completion"), (F.col("doc_id") % 10).cast("string").alias("answer"), kind.alias("type"), (F.col("doc_id") % 4 / 4.0).alias("scaffold"))


SQL = r"""
r0 as (select *, coalesce(text, '') t from documents),
r1 as (select *, split_part(t, chr(10), 1) line from r0),
r as (select doc_id rollout_id, source prompt_idx, lang prompt, doc_id % 4 / 4.0 scaffold, (doc_id % 10)::varchar answer,
  (['math','code','essay','mcq','reasoning','other'])[doc_id % 6 + 1] as type,
  case doc_id % 5 when 0 then '<think>' || chr(10) || line || chr(10) || '</think>' || chr(10) || substr(t, length(line) + 2)
    when 1 then '<think>' || t when 2 then t when 3 then '</think>' || line || '<think>' || substr(t, length(line) + 2)
    else '<think>' || line || '</think>\boxed{' || (doc_id % 10) || '}' end c from r1)
"""
