"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each class k has a mean and a covariance (1-a)S_k + aS shrunk towards the pooled S, and that towards a multiple of the
identity. The score is the logistic of the difference of the log densities, each -|L_k^-1 (x - m_k)|^2 / 2 - log|L_k|,
plus the log prior odds, with the Cholesky factors L_k computed once and sent to the executors. Means and covariances come
from sums that Spark adds up over every labelled training row, so what reaches the driver is one row for each class.

Nulls: a null text counts as the empty one; rows without a label or with another label than 0 and 1 don't train. Empty
texts get a score like any other. With no training row of one class every score is the other's share (0.5 with neither).
Repeated rows are scored alike. Other columns pass through; columns with the names of the results are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .common import dropped, fold_of, table, written

FEATURES = ("words", "word_length", "symbols", "exclamations", "shouted", "digits", "punctuation", "distinct", "top", "adjacent", "line_repeats", "line_words")
TO_POOLED, TO_IDENTITY = 0.1, 0.01
THRESHOLD = 0.3
#: Words that every share is taken over besides a text's own, so that those of very short texts say little.
DAMP = 10
DIGIT = np.arange(48, 58)
SYMBOL = np.frombuffer(b"#*$%&|<>{}[]=~^\\_@", np.uint8)
POINT = np.frombuffer(b".,;:?\"'()-", np.uint8)


def statistics(text: str) -> np.ndarray:
    """The transformed statistics of a whole text."""
    words = text.split()
    n, raw = len(words), text.encode("utf-8", "replace")
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = max(1, len(text) - int(byte[32]) - int(byte[10]))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    per = 100.0 / (n + DAMP)
    return np.array([
        np.log1p(n),
        np.log((letters + 5 * DAMP) / (n + DAMP)),
        np.log1p(per * byte[SYMBOL].sum()),
        np.log1p(per * byte[33]),
        np.log1p(per * sum(map(str.isupper, words))),
        np.log1p(per * byte[DIGIT].sum()),
        np.log1p(per * byte[POINT].sum()),
        np.log((len(counts) + DAMP) / (n + DAMP)),
        np.log1p(per * (max(counts.values(), default=1) - 1)),
        np.log1p(per * sum(map(eq, words, words[1:]))),
        np.log1p(per * (len(lines) - len(set(lines)))),
        np.log1p(n / max(1, len(lines))),
    ])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([statistics(x or "") for x in s], dtype=object)


def fit(rows: DataFrame, label: str = "label", x: str = "x", to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> dict:
    """The discriminant from rows of statistics and labels: for each class its mean, inverse Cholesky factor and log weight."""
    p = len(FEATURES)
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    sums = rows.where(F.col(label).isin(0, 1)).groupBy(label).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(x)[i]).alias(f"s{i}") for i in range(p)), *(F.sum(F.col(x)[i] * F.col(x)[j]).alias(f"q{i}_{j}") for i, j in pairs)).collect()
    moments = {}
    for r in sums:
        mean, cross = np.array([r[f"s{i}"] for i in range(p)]) / r["n"], np.zeros((p, p))
        for i, j in pairs:
            cross[i, j] = cross[j, i] = r[f"q{i}_{j}"]
        moments[r[label]] = (r["n"], mean, cross / r["n"] - np.outer(mean, mean))
    total = sum(n for n, _, _ in moments.values())
    if len(moments) < 2:
        return {"share": float(next(iter(moments)) if moments else 0.5)}
    pooled = sum(n * s for n, _, s in moments.values()) / total
    model = {}
    for k, (n, mean, s) in moments.items():
        s = (1 - to_pooled) * s + to_pooled * pooled
        s = (1 - to_identity) * s + to_identity * max(np.trace(s) / p, 1e-6) * np.eye(p)
        chol = np.linalg.cholesky(s)
        model[k] = (mean, np.linalg.inv(chol), np.log(n / total) - np.log(np.diag(chol)).sum())
    return model


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    """The probability of class 1 for each row of x."""
    if "share" in model:
        return np.full(len(x), model["share"])
    log = {k: w - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(1) for k, (mean, inverse, w) in model.items()}
    return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -700, 700)))


def classify(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", threshold: float = THRESHOLD, held: int = 0) -> DataFrame:
    """df with held_out, score and predicted; labels train it, but for keys whose fold is held."""
    spark = df.sparkSession
    seen = written(df.select(key, features(text).alias("x")), "statistics")
    given = labels.select(F.col(key).alias("_key"), F.col(label).alias("label")).where(fold_of(F.col(key)) != held)
    model = fit(seen.join(given, seen[key] == given["_key"]).select("label", "x"))
    dropped(seen)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(scores(sent.value, np.array([statistics(t or "") for t in s]).reshape(-1, len(FEATURES))))

    kept = [c for c in df.columns if c not in ("held_out", "score", "predicted")]
    return df.select(*kept, (fold_of(F.col(key)) == held).alias("held_out"), score(text).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels")).drop("text")
