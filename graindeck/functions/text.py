"""Column builders for texts: sections, tokens, similarity and information measures. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

THINK, UNTHINK = "<think>", "</think>"


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def tok(x: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(x), r"\s+"), lambda t: t != "")


def word_set(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"(?U)(\w+)"), F.lit(1)))


def thinking(x: Column) -> Column:
    """What the first closed thinking section holds; null without one."""
    return F.when(x.rlike(r"(?s)<think>.*?</think>"), strip(F.regexp_extract(x, r"(?s)<think>(.*?)</think>", 1)))


def answer_part(x: Column) -> Column:
    """The tagged answer, else what follows the closing tag, else nothing for an open section, else all."""
    after = F.substring(x, F.locate(UNTHINK, x) + len(UNTHINK), F.length(x))
    return (
        F.when(x.rlike(r"(?s)<answer>.*?</answer>"), strip(F.regexp_extract(x, r"(?s)<answer>(.*?)</answer>", 1)))
        .when(x.contains(UNTHINK), strip(F.regexp_replace(after, "</?answer>", "")))
        .when(x.contains(THINK), F.lit(""))
        .otherwise(strip(x))
    )


def boxed(x: Column) -> Column:
    """The first boxed content up to one nested pair of braces; null without one."""
    return F.nullif(strip(F.regexp_extract(x, r"\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}", 1)), F.lit(""))


def jaccard(a: Column, b: Column) -> Column:
    """Of word sets; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def ngrams(t: Column, n: int) -> Column:
    """Bound first: a lambda computes an expression that it holds, such as the words of a text, for each of its items."""
    joined = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    return let(t, lambda w: F.when(F.size(w) >= n, joined(w)).otherwise(F.array().cast("array<string>")))


def ngram_repetition(t: Column, n: int) -> Column:
    """n for each occurrence of an n-gram after its first, over the tokens; at most 1."""
    extra = let(ngrams(t, n), lambda g: F.size(g) - F.size(F.array_distinct(g)))
    return F.when(F.size(t) < n + 1, F.lit(0.0)).otherwise(F.least(F.lit(1.0), n * extra / F.size(t)))


def distinct_ngram_loss(t: Column, n: int) -> Column:
    """One less the share of distinct n-grams."""
    return let(ngrams(t, n), lambda g: F.when(F.size(g) == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_distinct(g)) / F.size(g)))


def unique_ratio(t: Column) -> Column:
    return F.when(F.size(t) == 0, F.lit(1.0)).otherwise(F.size(F.array_distinct(t)) / F.size(t))


def token_estimate(x: Column) -> Column:
    return ((F.length(x) / 4.0 + F.size(tok(x)) * 1.3) / 2).cast("int")


def over_runs(items: Column, value) -> Column:
    """The sum of value(n), n being how often an item occurs, over an array's distinct items: sorted, then folded run by run."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("n"), F.lit(0.0).alias("s"))
    closed = lambda a: a.s + F.when(a.n > 0, value(a.n)).otherwise(0.0)

    def step(a, x):
        same = a.last.eqNullSafe(x)
        return F.struct(x.alias("last"), F.when(same, a.n + 1).otherwise(1).alias("n"), F.when(same, a.s).otherwise(closed(a)).alias("s"))

    return F.aggregate(F.sort_array(items), start, step, closed)  # array_sort compares by an interpreted lambda


def run_lengths(items: Column) -> Column:
    """How often each distinct item of an array occurs, in the items' order: the distances of where runs start when sorted."""

    def of(v: Column) -> Column:
        place = F.transform(v, lambda x, i: F.when((i > 0) & x.eqNullSafe(F.get(v, i - 1)), F.lit(None).cast("int")).otherwise(i))
        starts = F.filter(place, lambda i: i.isNotNull())
        return let(starts, lambda s: F.transform(s, lambda at, k: F.coalesce(F.get(s, k + 1), F.size(v)) - at))

    return let(F.sort_array(items), of)


def vowel_share(x: Column) -> Column:
    return F.regexp_count(F.lower(x), F.lit("[aeiou]")) / F.length(x)


def truncated_lines(x: Column, ratio: Column) -> Column:
    """The first share of the lines, at least one."""
    lines = F.split(x, "\n")
    return F.array_join(F.slice(lines, F.lit(1), F.greatest(F.lit(1), (F.size(lines) * ratio).cast("int"))), "\n")
