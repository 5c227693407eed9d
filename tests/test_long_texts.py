"""Scorers on texts far longer than those of the small tables."""

import time

from pyspark.sql import functions as F


def test_exam_answers_of_long_texts(spark):
    """Words that go on after an answer, a long last line and a long box need no stack by their length."""
    from graindeck.operators import exam

    long = "word and other words " * 20000
    cases = [(0, f"The answer is {long}", None), (1, f"see\n{long}7", None), (2, "\\boxed{" + "{x} y " * 20000 + "}", "{x} y " * 19999 + "{x} y"), (3, "\\boxed{" + "x" * 99999, None), (4, f"**{long}", None), (5, f"A{', B' * 30000}!", None)]
    df = spark.createDataFrame(cases, "i int, c string, want string")
    got = {r["i"]: r["got"] for r in df.select("i", exam.extracted(F.col("c"), F.lit(False)).alias("got")).collect()}
    assert got[0] == long.strip() and got[2] == cases[2][2]
    assert got[1] == got[3] == got[4] == got[5] == None  # noqa: E711


def test_exam_scores_of_long_texts(spark):
    """The whole score: thinking, boxes and answers by the hundred thousand characters."""
    from graindeck.functions import registry
    from graindeck.operators import exam  # noqa: F401

    long = "word and other words " * 20000
    texts = [f"<think>{long}</think>The answer is {long}", "<think>a</think>\\boxed{" + "x" * 99999 + "}", f"The answer is {long}", f"<think>{long}</think>\\boxed{{B}}"]
    df = spark.createDataFrame([(i, "p", c, "B", "exam") for i, c in enumerate(texts)], "i int, prompt string, completion string, answer string, type string")
    got = {r["i"]: r["exam"] for r in registry.score(df, ["exam"]).collect()}
    assert all(0 < v < 1 for v in got.values()) and got[3] == max(got.values())


def test_ngrams_of_long_texts(spark):
    """Words are split once, not for each n-gram:."""
    from graindeck.functions import registry, text as tx
    from graindeck.operators import r1  # noqa: F401

    text = " ".join(f"w{i % 5000}" for i in range(40000))
    df = spark.createDataFrame([("p", f"<think>a</think>{text}", "a", "math")], "prompt string, completion string, answer string, type string")
    began = time.time()
    got = registry.score(df, ["repetition_penalty"]).select("repetition_penalty", tx.ngram_repetition(tx.tok(F.col("completion")), 3).alias("three")).first()
    assert time.time() - began < 60 and got["repetition_penalty"] == 0.6 and got["three"] == 1.0


def test_character_entropy_counts_few_and_sorts_many(spark):
    """Counting and sorting give the same, for few characters, many, none and those of several bytes."""
    from graindeck.functions import structure as st
    from graindeck.functions.text import let

    texts = ["", "a", "abca " * 5000, "é\U0001f600\n" * 7 + "x", "".join(map(chr, range(200, 400))) * 3]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for few in (0, 128, 1000):
        got = df.select(st.char_entropy(F.col("t"), few).alias("a"), let(st.characters(F.col("t")), st.entropy_of).alias("b")).collect()
        assert all(abs(r["a"] - r["b"]) < 1e-12 for r in got), got
