"""Samples made from documents by a fixed rule: every shape of prompt, answer, completion and raw type that routing and the typed scorers tell apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .rollouts import table

RAW_TYPES = ("GSM8K", " exam ", "code", "func", "reasoning", "unknown", None, "python", "tool_call")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, prompt, completion, answer, type of each document."""
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    line = F.substring(F.split_part(text, F.lit("\n"), F.lit(1)), 1, 80)
    n = lambda k: (i % k).cast("string")
    cat = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    answers = [
        n(50),
        F.element_at(F.array(*map(F.lit, "ABCD")), (i % 4).cast("int") + 1),
        cat(n(7), "/", (i % 5 + 1).cast("string")),
        cat("\\boxed{", n(20), "}"),
        cat("work\n#### 1,", F.lpad(n(1000), 3, "0")),
        cat('<tool_call>\n{"name": "get_item", "arguments": {"id": ', n(9), ', "unit": "kg"}}\n</tool_call>'),
        cat("get_item(id=", n(9), ', unit="kg")'),
        cat("def f(x):\n    y = x + ", n(9), "\n    return y"),
        line,
        cat(n(90), "%"),
        F.lit("x"),
        cat("\\frac{", n(5), "}{", (i % 3 + 1).cast("string"), "}"),
    ]
    answer = pick(answers, i % len(answers))
    completions = [
        cat("<think>\n", line, "\n</think>\n", answer),
        cat("<think>Step 1: x = 3, therefore 3 > 2, so we get y = 2. ", line, "</think>\\boxed{", answer, "}"),
        cat(answer, " or so"),
        cat("<think>", line, "</think>The answer: B or C"),
        cat("<think>", text),
        cat("<think>the loop returns the input\n- approach\n- output</think>```python\n", answer, "\n```"),
        F.regexp_replace(answer, "[0-9]", "7"),
        text,
    ]
    prompts = [line, cat("Solve x = 3 for ", line), cat("Write a function for ", line), F.lit("hi"), F.lit("")]
    kind = F.element_at(F.array(*map(F.lit, RAW_TYPES)), (i % len(RAW_TYPES)).cast("int") + 1)
    docs = table(spark, sf_dir, "documents")
    return docs.select(i.alias("sample_id"), pick(prompts, i % len(prompts)).alias("prompt"), pick(completions, F.floor(i / 12) % len(completions)).alias("completion"), answer.alias("answer"), kind.alias("type"))


def pick(columns: list[Column], k: Column) -> Column:
    out = columns[-1]
    for at, c in reversed(list(enumerate(columns[:-1]))):
        out = F.when(k == at, c).otherwise(out)
    return out


SQL = r"""
s0 as (select doc_id i, coalesce(text, '') t, substr(split_part(coalesce(text, ''), chr(10), 1), 1, 80) line from documents),
s1 as (select *, case i % 12 when 0 then (i % 50)::varchar when 1 then substr('ABCD', (i % 4 + 1)::int, 1) when 2 then (i % 7) || '/' || (i % 5 + 1)
  when 3 then '\boxed{' || (i % 20) || '}' when 4 then 'work' || chr(10) || '#### 1,' || lpad((i % 1000)::varchar, 3, '0')
  when 5 then '<tool_call>' || chr(10) || '{"name": "get_item", "arguments": {"id": ' || (i % 9) || ', "unit": "kg"}}' || chr(10) || '</tool_call>'
  when 6 then 'get_item(id=' || (i % 9) || ', unit="kg")' when 7 then 'def f(x):' || chr(10) || '    y = x + ' || (i % 9) || chr(10) || '    return y'
  when 8 then line when 9 then (i % 90) || '%' when 10 then 'x' else '\frac{' || (i % 5) || '}{' || (i % 3 + 1) || '}' end a from s0),
s as (select i sample_id, a, case i % 5 when 0 then line when 1 then 'Solve x = 3 for ' || line when 2 then 'Write a function for ' || line when 3 then 'hi' else '' end p,
  (['GSM8K', ' exam ', 'code', 'func', 'reasoning', 'unknown', null, 'python', 'tool_call'])[i % 9 + 1] raw,
  case (i // 12) % 8 when 0 then '<think>' || chr(10) || line || chr(10) || '</think>' || chr(10) || a
    when 1 then '<think>Step 1: x = 3, therefore 3 > 2, so we get y = 2. ' || line || '</think>\boxed{' || a || '}' when 2 then a || ' or so'
    when 3 then '<think>' || line || '</think>The answer: B or C' when 4 then '<think>' || t
    when 5 then '<think>the loop returns the input' || chr(10) || '- approach' || chr(10) || '- output</think>```python' || chr(10) || a || chr(10) || '```'
    when 6 then regexp_replace(a, '[0-9]', '7', 'g') else t end c from s1)
"""
