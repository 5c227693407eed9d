"""Reading and writing corpora: JSON lines with a reject table, plain documents, splits, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SAMPLE = "prompt string, answer string, system string, type string, ground_truth string, possible_boxed_answers array<string>, _corrupt string"


def read_jsonl(spark: SparkSession, path: str, schema: str = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rows that parse and have a prompt and an answer, and the others with a reason. Blank lines
    are in neither."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    reason = F.when(F.col("r").isNull() | F.col("r._corrupt").isNotNull(), "malformed").when(F.col("r.prompt").isNull(), "no prompt").when(F.col("r.answer").isNull(), "no answer")
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").select("r.*").drop("_corrupt"), marked.where("reason is not null").select("value", "reason")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path and text of each text or markdown file below a folder; blank ones are left out."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md}").text(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).where(F.trim("text") != "")


def write_split(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A split as JSON lines and as Parquet."""
    df.write.mode(mode).json(f"{path}/jsonl")
    df.write.mode(mode).parquet(f"{path}/parquet")


def fingerprints(spark: SparkSession, path: str, head: int = 65536) -> DataFrame:
    """path, size, modification time and the first 16 digits of the SHA-256 of each file's head."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", "modificationTime", F.substring(F.sha2(F.substring("content", 1, head), 256), 1, 16).alias("head"))


def math_answer(answer: Column) -> Column:
    """What follows the last #### of a worked answer, without thousands' commas; else the answer."""
    tail = F.regexp_extract(answer, r"(?m)####\s*(.+)$", 1)
    return F.when(tail != "", F.replace(F.trim(tail), F.lit(","), F.lit(""))).otherwise(answer)
