"""Scorers of plain function calls, f(a=1, b="x"): whole text, names, parameters, both, and whether there is a call at all."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.pyfuncs import call_scores
from ..functions.registry import register
from ..functions.text import let, strip
from .scoring import yes

#: A name and what is between its parentheses, which ends at the first closing one.
CALL = r"(?s)([a-zA-Z_][a-zA-Z0-9_]*)\s*\(([^)]*)\)"


def contaminated(x: Column) -> Column:
    """Whether a text holds thinking tags or a box, in any case."""
    low = F.lower(x)
    return low.contains("<think>") | low.contains("</think>") | low.contains("\\boxed{")


def call_names(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(CALL), F.lit(1))


def clean(c: Column, score: Column) -> Column:
    return F.when(contaminated(c), 0.0).otherwise(score)


@register("tool_call_exact", default=True, tags=("tool_call",))
def exact(p, c, a, t):
    """Equal but for white space and case."""
    plain = lambda x: F.regexp_replace(F.lower(strip(x)), r"(?U)\s+", " ")
    return clean(c, yes(plain(c) == plain(a)))


@register("tool_call_function", default=True, tags=("tool_call",))
def names(p, c, a, t):
    """The share of the wanted names that are called."""

    def of(x) -> Column:
        return F.when(F.size(x.w) == 0, yes(F.size(x.g) == 0)).otherwise(F.size(F.array_intersect(x.g, x.w)) / F.size(x.w))

    return clean(c, let(F.struct(F.array_distinct(call_names(c)).alias("g"), F.array_distinct(call_names(a)).alias("w")), of))


@register("tool_call_params", tags=("tool_call",))
def parameters(p, c, a, t):
    return clean(c, call_scores(c, a)["parameters"])


@register("tool_call_overall", tags=("tool_call",))
def overall(p, c, a, t):
    return clean(c, call_scores(c, a)["overall"])


@register("tool_call_parseable", tags=("tool_call",))
def parseable(p, c, a, t):
    return clean(c, yes(F.size(call_names(c)) > 0))


def unknown_functions(x: Column, available: Column) -> Column:
    """The names called that aren't available."""
    return F.array_except(F.array_distinct(call_names(x)), available)
