"""Scorers of completions, as expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ..functions.registry import register
from ..functions.text import THINK, UNTHINK, answer_part, boxed, jaccard, let, ngrams, strip, thinking, tok, vowel_share, word_set

# Word count bands by type, (least, best from, best to, most).
BANDS = {"math": (20, 50, 200, 300), "code": (50, 100, 400, 600), "essay": (100, 200, 600, 1000), "mcq": (10, 20, 100, 150), "reasoning": (40, 80, 300, 500)}
OTHER_BAND = (20, 50, 300, 500)


def after_close(x: Column) -> Column:
    return F.substring(x, F.locate(UNTHINK, x) + len(UNTHINK), F.length(x))


def in_order(x: Column) -> Column:
    return x.contains(THINK) & x.contains(UNTHINK) & (F.locate(THINK, x) < F.locate(UNTHINK, x))


def yes(x: Column) -> Column:
    return F.when(x, 1.0).otherwise(0.0)


@register("format", default=True, tags=("format",))
def format_score(p, c, a, t):
    """Tags in order and at least 5 characters after them."""
    return yes(in_order(c) & (F.length(strip(after_close(c))) >= 5))


@register("tag_structure", default=True, tags=("format",))
def tag_structure(p, c, a, t):
    return yes((F.regexp_count(c, F.lit(THINK)) == 1) & (F.regexp_count(c, F.lit(UNTHINK)) == 1) & in_order(c))


@register("count_tags", tags=("format",))
def count_tags(p, c, a, t):
    tail = F.length(strip(F.substring_index(c, UNTHINK, -1))) > 0
    return 0.25 * yes(c.contains(THINK)) + 0.25 * yes(c.contains(UNTHINK)) + 0.5 * yes(c.contains(UNTHINK) & tail)


@register("soft_format", tags=("format",))
def soft_format(p, c, a, t):
    return yes(c.contains(THINK) & c.contains(UNTHINK))


@register("strict_format", tags=("format",))
def strict_format(p, c, a, t):
    return yes(strip(c).rlike(r"(?s)^<think>\n.*?\n</think>\n"))


@register("integer_answer", tags=("accuracy",))
def integer_answer(p, c, a, t):
    return 0.5 * yes(answer_part(c).rlike(r"^\p{Nd}+$"))


@register("accuracy", default=True, tags=("accuracy",))
def accuracy(p, c, a, t):
    """Equal answers, boxed ones by what the box holds, without regard to case."""
    got, want = answer_part(c), strip(a)
    return yes(F.lower(F.coalesce(boxed(got), got)) == F.lower(F.coalesce(boxed(want), want)))


@register("conciseness", default=True, tags=("length",))
def conciseness(p, c, a, t):
    """Word count against the type's band; between the least and the best counts the score passes 1 and is cut."""

    def of(n: Column, band) -> Column:
        least, low, high, most = band
        return (
            F.when(n < least, F.greatest(F.lit(0.2), n / least))
            .when(n.between(low, high), 1.0)
            .when(n <= most, 1.0 - 0.3 * (n - high) / (most - high))
            .otherwise(F.greatest(F.lit(0.1), 0.7 - 0.4 * F.least((n - most) / most, F.lit(3.0))))
        )

    def by_type(n: Column) -> Column:
        return reduce(lambda e, k: F.when(F.lower(t) == k, of(n, BANDS[k])).otherwise(e), BANDS, of(n, OTHER_BAND))

    return F.when(F.length(strip(c)) < 10, 0.0).otherwise(let(F.size(tok(c)), by_type))


@register("anti_gaming", tags=("gaming",))
def anti_gaming(p, c, a, t):
    return F.when(F.length(c) < 10, 0.0).when(vowel_share(c) < 0.15, 0.0).when(c.contains(THINK + UNTHINK), 0.0).otherwise(1.0)


def length_factor(n: Column) -> Column:
    """The factor for a thinking section of n words."""
    return F.when(n < 20, F.greatest(F.lit(0.3), n / 20)).when(n > 80, F.greatest(F.lit(0.5), 1.0 - 0.2 * (n - 80) / 80)).when(n.between(30, 60), 1.1).otherwise(1.0)


@register("thinking_length", tags=("thinking",))
def thinking_length(p, c, a, t):
    """The length part of the thinking score."""
    th = thinking(c)
    return F.when(F.coalesce(th, F.lit("")) == "", 0.0).otherwise(F.least(F.lit(1.0), let(F.size(tok(th)), length_factor)))


# What takes from the thinking score or adds to it. The Q&A type has a shorter list of phrases and no round bullet.
PHRASES = ("i think", "i believe", "maybe", "i'm not sure", "confused", "stuck", "i will now", "i'll start by", "let's see")
R1_PHRASES = (*PHRASES, "frustrated", "wait, wait", "hmm, perhaps", "or wait", "to be completely honest", "basically what happens", "long story short", "at the end of the day")
SPECIAL = ("<|endoftext|>", "<|im_start|>", "<think><think>", "<|im_end|>")


def thinking_score(c: Column, phrases: tuple[str, ...], bullets: str) -> Column:
    """1, less 0.1 for each bad phrase (0.4 at most) and 0.3 for each special token, 0.1 more for a list, times the length factor."""

    def of(th: Column) -> Column:
        bad = reduce(lambda e, p: e + yes(th.rlike(rf"(?iU)\b{p}\b")), phrases, F.lit(0.0))
        special = reduce(lambda e, s: e + yes(th.contains(s)), SPECIAL, F.lit(0.0))
        listed = yes(th.rlike(rf"(?U)\n\s*[{bullets}]|\n\s*\d+\.\s+"))
        score = (1.0 - F.least(F.lit(0.4), 0.1 * bad) - 0.3 * special + 0.1 * listed) * let(F.size(tok(th)), length_factor)
        return F.when(th == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))

    return let(F.coalesce(thinking(c), F.lit("")), of)


@register("thinking_quality", tags=("thinking",))
def thinking_quality(p, c, a, t):
    return thinking_score(c, R1_PHRASES, "-*\u2022")


@register("qna_thinking", tags=("thinking",))
def qna_thinking(p, c, a, t):
    """The thinking part of general_qna."""
    return thinking_score(c, PHRASES, "-*")


@register("qna_correctness", tags=("accuracy",))
def qna_correctness(p, c, a, t):
    """Equal 1, equal boxes 1, containing 0.8, contained 0.6 of the ratio, word overlap above a half 0.7 of it."""
    got, want = F.lower(answer_part(c)), F.lower(strip(a))
    box = F.lower(boxed(answer_part(c)))
    j = jaccard(word_set(got), word_set(want))
    return (
        F.when((got == "") | (want == ""), 0.0)
        .when(got == want, 1.0)
        .when(F.coalesce(box == F.lower(F.coalesce(boxed(a), want)), F.lit(False)), 1.0)
        .when(F.contains(got, want), 0.8)
        .when(F.contains(want, got), 0.6 * F.length(got) / F.length(want))
        .when(j > 0.5, 0.7 * j)
        .otherwise(0.0)
    )


@register("qna_format", tags=("format",))
def qna_format(p, c, a, t):
    between = F.substring(c, F.locate(THINK, c) + len(THINK), F.locate(UNTHINK, c) - F.locate(THINK, c) - len(THINK))
    quarters = 0.25 * yes(c.contains(THINK)) + 0.25 * yes(c.contains(UNTHINK)) + 0.25 * yes(in_order(c) & (F.length(strip(between)) >= 5)) + 0.25 * yes(c.contains(UNTHINK) & (F.length(strip(after_close(c))) >= 2))
    return F.when(strict_format(p, c, a, t) == 1, 1.0).otherwise(quarters)


@register("general_qna", tags=("composite",))
def general_qna(p, c, a, t):
    """Correctness 0.4, format 0.3, thinking 0.3; nothing for under 5 characters."""
    total = 0.4 * qna_correctness(p, c, a, t) + 0.3 * qna_format(p, c, a, t) + 0.3 * qna_thinking(p, c, a, t)
    return F.when(F.length(strip(c)) < 5, 0.0).otherwise(total)


@register("repetition", tags=("length",))
def repetition(p, c, a, t):
    """The share of distinct word 4-grams; 1 for texts without one."""
    return let(ngrams(tok(c), 4), lambda g: F.when(F.size(g) == 0, 1.0).otherwise(F.size(F.array_distinct(g)) / F.size(g)))


def corruption_reasons(c: Column, least: int = 10, most_repeated: float = 0.95) -> Column:
    """Why a completion looks corrupt, in order; an empty array for a sound one."""
    s = strip(c)
    tests = [
        ("short", F.length(s) < least),
        ("control characters", c.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]{3,}")),
        ("repeated character", c.rlike(r"(.)\1{20,}")),
        ("repeated token", c.rlike(r"(\S{2,})\s*\1{10,}")),
        ("low diversity", (F.length(s) > 10) & (F.size(F.array_distinct(F.split(s, ""))) / F.length(s) < 1 - most_repeated)),
        ("only special", s.rlike(r"^[\s<>/\[\]{}|\\]+$")),
        ("encoding", F.regexp_count(c, F.lit("\ufffd")) > 5),
    ]
    return F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in tests)), lambda x: x.isNotNull())
