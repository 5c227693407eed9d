import json

import duckdb
import pytest
from pyspark.sql import functions as F

from graindeck.functions import registry, text as tx
from graindeck.operators import advantage as adv, monitor as mon, sampling as smp, scoring
from graindeck.plans import catalogue
from graindeck.sources import corpus
from graindeck.streaming import rollouts as st

SF = "/root/testdata/sf0.001"
TABLES = "orders lineitem events documents embeddings benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("None" if v is None or v != v else str(v)[:10] if hasattr(v, "year") else str(round(v, 5) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in df.astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(catalogue.queries()[name](spark, SF).toPandas()) == rows(con.sql(catalogue.oracle_sql()[name]).df())


def test_scorers_are_bounded_and_take_empty_texts(spark):
    texts = ["", "x", "<think></think>ok answer", "<think>\na\n</think>\nthe answer", "</think>a<think>b", "<think>open", "\\boxed{x^{2}}", None]
    df = spark.createDataFrame([("p", c, "x^{2}", "math") for c in texts], "prompt string, completion string, answer string, type string")
    for r in registry.score(df, registry.names()).collect():
        assert all(0 <= r[n] <= 1 for n in registry.names())
    assert registry.score(df, ["accuracy"]).where("completion like '%boxed%'").first()["accuracy"] == 1.0


def test_thinking_counts_phrases_tokens_and_lists(spark):
    plain = " ".join(f"w{i}" for i in range(25))  # a length that leaves the score as it is
    cases = [(plain, 1.0, 1.0), (plain + " Maybe", 0.9, 0.9), (plain + " maybe I think I believe stuck confused", 0.66, 0.66), (plain + " <|im_end|>", 0.7, 0.7), (plain + " maybe\n- a", 1.0, 1.0), (plain + " maybe\n\u2022 a", 1.0, 0.9), (plain + " frustrated", 0.9, 1.0), ("maybe", 0.27, 0.27), (plain + " <|im_start|> <|im_end|> <|endoftext|> maybe", 0.0, 0.0), ("", 0.0, 0.0)]
    df = spark.createDataFrame([(i, f"<think>{t}</think> yes it is") for i, (t, _, _) in enumerate(cases)], "i int, completion string").withColumns({"prompt": F.lit("p"), "answer": F.lit("no"), "type": F.lit("math")})
    args = [F.col(x) for x in ("prompt", "completion", "answer", "type")]
    got = df.select(scoring.thinking_quality(*args).alias("r1"), scoring.qna_thinking(*args).alias("qna"), (scoring.general_qna(*args) - 0.4 * scoring.qna_correctness(*args) - 0.3 * scoring.qna_format(*args)).alias("part"), "i").orderBy("i").collect()
    for r, (_, r1, qna) in zip(got, cases):
        assert abs(r["r1"] - r1) < 1e-9 and abs(r["qna"] - qna) < 1e-9 and abs(r["part"] - 0.3 * qna) < 1e-9, (r, r1, qna)


def test_registry_names_what_it_has():
    assert set(registry.defaults()) <= set(registry.names())
    with pytest.raises(KeyError, match="accuracy"):
        registry.get("none such")


def test_advantages_add_up_and_singletons_are_zero(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), (None, 1.0), (None, 1.0)], "g string, reward double")
    got = adv.advantages(df, "g").collect()
    assert len(got) == 5 and abs(sum(r["advantage"] for r in got)) < 1e-9
    assert [r["advantage"] for r in got if r["g"] == "b"] == [0.0]


def test_status_limits(spark):
    df = spark.createDataFrame([(0.5,), (0.4,), (0.51,), (0.39,), (None,)], "v double")
    assert [r[0] for r in df.select(mon.status(F.col("v"), 0.5, 0.4)).collect()] == ["WARNING", "WARNING", "GOOD", "CRITICAL", "UNKNOWN"]


def test_corruption(spark):
    df = spark.createDataFrame([("a" * 30,), ("A sound completion of words.",), ("",)], "c string")
    got = [r[0] for r in df.select(scoring.corruption_reasons(F.col("c"))).collect()]
    assert "repeated character" in got[0] and got[1] == [] and got[2] == ["short"]


def test_numbered_is_global(spark):
    df = spark.range(1000).repartition(7)
    assert smp.numbered(df, [F.desc("id")]).where("rn + id <> 1000").count() == 0


def test_jsonl_rejects(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps({"prompt": "p", "answer": "a"}), "", "{bad", json.dumps({"prompt": "p"})]))
    good, bad = corpus.read_jsonl(spark, str(tmp_path / "a.jsonl"))
    assert good.count() == 1 and {r["reason"] for r in bad.collect()} == {"malformed", "no answer"}


def test_stateful_stops_equal_the_batch_form(spark, tmp_path):
    values = [1, 1, 1, 9, 1, 1, 1, 1]
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(values)], "k string, i int, v double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = st.stops(stream, "k", "i", "v", 5, 3).writeStream.format("memory").queryName("stops").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["at"] for r in spark.sql("select at from stops").collect()) == ["2", "6"]


def test_run_lengths(spark):
    got = spark.range(1).select(tx.run_lengths(F.array(*map(F.lit, "abaac"))).alias("n")).first()["n"]
    assert sorted(got) == [1, 1, 3]


def test_slices_and_caches(spark, tmp_path):
    from graindeck.sources import loader

    assert loader.slice_bounds("train[:80%]", 10) == ("train", 0, 8) and loader.slice_bounds("train[-10%:]", 10) == ("train", 9, 10) and loader.slice_bounds("valid", 7) == ("valid", 0, 7)
    df = spark.range(10)
    assert [r["id"] for r in loader.sliced(df, "train[2:5]", [F.col("id")]).orderBy("id").collect()] == [2, 3, 4]
    src = tmp_path / "src"
    src.mkdir()
    (src / "train.jsonl").write_text('{"prompt": "p", "answer": "a"}\nbroken\n\n{"prompt": "q"}\n')
    splits = loader.read_splits(spark, str(src))
    assert {k: v.count() for k, v in splits.items()} == {"train": 1, "valid": 0, "test": 0}
    cache = loader.Cache(spark, str(tmp_path / "cache"))
    assert cache.load(str(src), {"a": 1}) is None
    cache.save(splits["train"], str(src), {"a": 1})
    assert cache.load(str(src), {"a": 1}).count() == 1 and cache.load(str(src), {"a": 2}) is None
    (src / "train.jsonl").write_text('{"prompt": "p", "answer": "other"}\n')
    assert cache.load(str(src), {"a": 1}) is None
    cache.invalidate()
    assert cache.load(str(src), {"a": 1}) is None


def test_loading_with_hooks_and_logs(spark, tmp_path):
    from graindeck.operators import routing
    from graindeck.sources import loader

    df = spark.createDataFrame([("what is x = 2", "2", None), ("hi", "y", "math"), (None, "3", None)], "prompt string, answer string, type string")
    reason = routing.invalid_reasons(F.col("prompt"), F.col("answer"), F.col("type"))["math"]
    hooks = loader.Hooks(before=[lambda d: d.withColumn("seen", F.lit(True))], after=[lambda d: d.withColumn("late", F.lit(1))])
    good, bad, counts = loader.loaded(df, reason, {"answer": routing.worked_answer(F.col("answer"))}, hooks, seed=3)
    assert good.count() == 2 and set(good.columns) == {"prompt", "answer", "type", "seen", "late"} and {r["reason"]: r["n"] for r in counts.collect()} == {"accepted": 2, "no prompt": 1} and bad.count() == 1
    assert {r["ground_truth"] for r in loader.tool_samples(spark.createDataFrame([("a", ""), ("b", "c")], "answer string, ground_truth string").withColumn("type", F.lit(None).cast("string"))).collect()} == {"a", "c"}
    rows = spark.createDataFrame([(1, "kl", 0.5), (1, "loss", 1.5), (2, "kl", 0.25)], "iteration int, name string, value double")
    loader.log_rollouts(rows, str(tmp_path / "log"), every=2)
    assert spark.read.json(str(tmp_path / "log")).count() == 1
    loader.log_iterations(rows, str(tmp_path / "csv"), ["iteration"], "name", "value")
    got = spark.read.option("header", True).csv(str(tmp_path / "csv")).orderBy("iteration").collect()
    assert [(r["iteration"], r["kl"], r["loss"]) for r in got] == [("1", "0.5", "1.5"), ("2", "0.25", None)]
    assert loader.config_hash({"a": 1, "b": 2}, ("a",)) == loader.config_hash({"a": 1}) != loader.config_hash({"a": 2})


def test_calls_schemas_and_conversion():
    from graindeck.functions import pyfuncs as pf

    assert pf.parameters('n=5, name="Test", l=[1, 2], d={"k": 1}, f=1.0') == {"n": "n5.0", "name": "stest", "l": "l['n1.0', 'n2.0']", "d": "d[('k', 'n1.0')]", "f": "n1.0"}
    assert pf.call_score(pf.called("f(a=1, b=2)"), pf.called("f(a=1, b=3)")) == (0.0, 1.0, 0.5, 0.6000000000000001)
    assert pf.call_score([], []) == (1.0,) * 4 and pf.call_score(pf.called("g(1)"), []) == (0.0,) * 4
    assert pf.call_score(pf.called("f(1)\ng(2)"), pf.called("f(1)")) == (0.0, 0.5, 0.0, 0.25)
    assert pf.hermes("f(a=1, b=\"x\")\nnot a call") == '<tool_call>\n{"name": "f", "arguments": {"a": 1, "b": "x"}}\n</tool_call>\nnot a call'
    assert pf.hermes('{"name": "f", "arguments": "{\\"a\\": 1}"}') == '<tool_call>\n{"name": "f", "arguments": {"a": 1}}\n</tool_call>'
    made = json.loads(pf.tool_schema('{"name": "f", "parameters": {"a": {"type": "int, optional", "default": 3}, "b": {"type": "list"}, "c": "bool"}}'))
    assert made["function"]["parameters"]["required"] == ["b", "c"] and made["function"]["parameters"]["properties"]["a"]["type"] == "integer"
    assert pf.tool_schema("no json") is None and pf.likeness("50%", "0.5") == 1.0 and pf.likeness("abc", "") == 0.0


def test_boxes_nest_and_exam_answers_are_found(spark):
    from graindeck.operators import exam

    cases = [("\\boxed{a^{b^{c}}}", "a^{b^{c}}"), ("\\BOXED{ }", None), ("none", None), ("x \\boxed{open", None), ("\\boxed{B} \\boxed{C}", "B")]
    df = spark.createDataFrame(cases, "c string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", exam.boxed(F.col("c")).alias("got")).collect())
    scored = [("<think>b</think>The answer is B", "B", 1.0), ("answer: A and C", "AC", 1.0), ("answer: A and C", "AB", 0.5), ("**D**", "D", 1.0), ("<think>open", "A", 0.0), ("answer: 42", "42", 1.0), ("options A, B", "AB", 1.0)]
    got = spark.createDataFrame(scored, "c string, a string, want double").select("want", exam.accuracy(F.col("c"), F.col("a")).alias("got")).collect()
    assert all(abs(r["got"] - r["want"]) < 1e-9 for r in got), got
    any_of = spark.createDataFrame([("\\boxed{0.5}", ["1/2", "x"], 1.0), ("\\boxed{3}", [], 0.5), ("\\boxed{3}", ["4"], 0.0)], "c string, p array<string>, want double")
    assert all(r["got"] == r["want"] for r in any_of.select("want", exam.accuracy_of_any(F.col("c"), F.col("p")).alias("got")).collect())


def test_hierarchical_scores_rank_as_they_should(spark):
    from graindeck.operators import hierarchical as hi

    think = "First, let me analyze this. Because we know the train covers 120 km in 2 hours, its speed is the distance over the time. Therefore the speed is 60 km per hour, since 120 divided by 2 is 60."
    rows = [(0, f"<think>{think}</think>\nThe answer is 60.", "60"), (1, f"<think>{think}</think>\nThe answer is 75.", "60"), (2, "spam " * 200, "60"), (3, "", "60"), (4, None, None)]
    got = {r["i"]: r for r in hi.hierarchical(spark.createDataFrame(rows, "i int, completion string, answer string")).collect()}
    assert all(0.02 <= r["hierarchical"] <= 0.95 and 0 <= r["penalty"] <= 0.5 for r in got.values())
    assert got[0]["hierarchical"] > got[1]["hierarchical"] > got[2]["hierarchical"] >= got[3]["hierarchical"] and got[2]["penalty"] > 0.3
