"""Exam scoring: answers in boxes and phrases, normalised letters and numbers, format and reasoning, penalties, and the gated composite."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ..functions.registry import register
from ..functions.text import let, ngrams, over_runs, strip, tok
from .scoring import yes
from .typed import HEDGES, number

# Fixed values.
WEIGHTS = {"accuracy": 0.75, "boxed": 0.02, "format": 0.03, "reasoning": 0.20}
GATE, GATED = 0.5, 0.3
ANALYSIS = ("because", "since", "therefore", "thus", "means", "implies", "incorrect", "correct")
OPTIONS = r"(?U)option [a-z]|choice [a-z]|\b[a-z]\)|\b[a-z]\."
BAD_WORDS = ("obviously", "clearly", "simply", "basically", "essentially")
HEDGE_WORDS = ("maybe", "possibly", "perhaps", "might", "probably", "likely", "unlikely", "seems", "appears", "somewhat", "fairly", "arguably")
GARBAGE = r"[^\x20-\x7E\n\r\t\u00A0-\u00FF\u2018-\u201F\u2013-\u2014\u2026]"
LETTERS = r"(?U)^[A-Za-z\s,&]+$"
REPEATABLE = (
    "the a an and or but is are was were be been being have has had do does did will would could should may might must can this that these "
    "those it its of to in for on with as at by from not no if then else when where which who what how all each every both few more most "
    "other some such than too very just also only option answer question choice correct incorrect true false yes no data service"
).split()
FILLERS = (
    "let me think", "let me analyze", "let me consider", "i need to think", "i need to analyze", "i need to consider",
    "this is a great question", "this is an interesting question", "this is a good question", "great question", "good question",
    "step by step", "one by one", "carefully consider", "i will analyze", "i will consider", "i will think", "let's break this down",
    "let's analyze", "let's think", "thinking about this", "considering this", "analyzing this", "hmm", "hmmm", "well let me", "okay so",
    "ok so", "alright", "interesting", "i see", "now let me", "first let me",
)
CONCLUDED = (
    r"(?iU)(?:the\s+answer\s+is|correct\s+answer\s+is|therefore|thus|hence|so\s+the\s+answer)\s+[\"']?[A-D][\"']?",
    r"(?iU)[A-D]\s+(?:is\s+correct|is\s+the\s+(?:right|correct)\s+(?:answer|choice))",
)
PLAIN_NUMBER = r"^[-+]?\d*\.?\d+([eE][-+]?\d+)?$"
THINK_TAGS = ("think", "thinking")


def boxed(x: Column, deepest: int = 4) -> Column:
    """What the first box holds, with braces nested to a depth; null if it is empty, never closed or absent.

    Possessive: what stops a repetition here never lets an earlier stop match, and other repeated groups take stack by their length."""
    inner = r"[^{}]*+"
    for _ in range(deepest):
        inner = rf"(?:[^{{}}]++|\{{{inner}\}})*+"
    first = F.when(F.locate("\\boxed{", F.lower(x)) > 0, F.substring(x, F.locate("\\boxed{", F.lower(x)), F.length(x)))
    return F.nullif(strip(F.regexp_extract(first, rf"(?is)^\\boxed\{{({inner})\}}", 1)), F.lit(""))


def all_letters(x: Column) -> Column:
    """Whether a text holds letters, commas and ampersands only."""
    return F.replace(x, F.lit("and"), F.lit("")).rlike(LETTERS)


def normalized_answer(x: Column) -> Column:
    """Numbers and fractions as they are; else the options A to F that stand alone, once each, sorted; else the trimmed text."""
    s = strip(x)
    plain = F.regexp_replace(F.regexp_replace(x, r"(?iU)\b(and|or)\b", " "), r"(?iU)\b(options?|answer|choice|choices|the|is|are)\s*", " ")
    found = F.regexp_extract_all(plain, F.lit(r"(?<![A-Za-z])([A-Za-z])(?![A-Za-z])"), F.lit(1))
    options = F.array_sort(F.array_distinct(F.filter(F.transform(found, F.upper), lambda v: v.rlike("^[A-F]$"))))
    return F.when(s.rlike(PLAIN_NUMBER) | s.rlike(r"^[-+]?\d+/\d+$"), s).otherwise(let(options, lambda o: F.when(F.size(o) > 0, F.array_join(o, "")).otherwise(s)))


def parsed_number(x: Column) -> Column:
    """A percentage, a number or a fraction of integers; null for other texts."""
    s = strip(x)
    halves = [F.regexp_extract(s, r"^([-+]?\d+)/(\d+)$", k).try_cast("double") for k in (1, 2)]
    percent = F.when(s.endswith("%"), number(F.substring(s, F.lit(1), F.length(s) - 1)) / 100)
    return F.coalesce(percent, number(s), F.when(halves[1] != 0, halves[0] / halves[1]))


def extracted(c: Column, letters: Column) -> Column:
    """The answer of a completion, by the first of: a box, an answer tag, "answer is" a number, "answer is" letters, bold letters
    at the end, a last line of letters or options. letters: whether letters are wanted, which are then normalised. Null without one.

    Letters repeat possessively, as text after them is never one of theirs: a long text takes neither stack nor tries."""
    low = F.lower(strip(c))
    last = strip(F.element_at(F.split(strip(c), "\n"), -1))
    shaped = lambda v: F.when(letters & all_letters(v), normalized_answer(v)).otherwise(v)
    wanted = lambda v: F.when(letters, normalized_answer(v)).otherwise(v)
    take = lambda x, p: F.nullif(F.regexp_extract(x, p, 1), F.lit(""))
    tagged = F.when(c.rlike(r"(?is)<answer>.*?</answer>"), strip(F.regexp_extract(c, r"(?is)<answer>\s*(.*?)\s*</answer>", 1)))
    said = take(c, r"(?iU)(?:answer|the answer is)[:\s]+([A-Za-z](?:\s*+[,&]?+\s*+(?:and\s+)?[A-Za-z])*+)")
    steps = [
        shaped(boxed(c)),
        shaped(tagged),
        take(c, r"(?iU)(?:answer|the answer is)[:\s]+([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)"),
        F.when(~F.lower(said).isin("is", "a", "an", "the"), wanted(said)),
        wanted(take(c, r"(?iU)\*\*([A-Za-z](?:\s*+[,&]?+\s*+[A-Za-z])*+)\*\*\s*\.?\s*$")),
        wanted(take(last, r"(?iU)^([A-Za-z](?:\s*+[,&]?+\s*+(?:and\s+)?[A-Za-z])*+)\.?$")),
        wanted(take(last, r"(?iU)^(?:options?\s+)?([A-Za-z](?:\s*+(?:,|and|&)\s*+(?:options?\s+)?[A-Za-z])*+)\.?$")),
    ]
    return F.when(~(low.startswith("<think>") & ~low.contains("</think>")), F.coalesce(*steps))


def f1(a: Column, b: Column) -> Column:
    """Of two texts' sets of characters."""
    x, y = (F.array_distinct(F.filter(F.split(v, ""), lambda ch: ch != "")) for v in (a, b))

    def of(p) -> Column:
        both = F.size(F.array_intersect(p.x, p.y))
        return F.when((both > 0) & (F.size(p.y) > 1), 2.0 * both / (F.size(p.x) + F.size(p.y))).otherwise(0.0)

    return let(F.struct(x.alias("x"), y.alias("y")), of)


def matches(got: Column, answer: Column) -> Column:
    """Equal but for case, equal when normalised, or equal numbers."""
    a, b = parsed_number(got), parsed_number(answer)
    near = F.when(b == 0, F.abs(a) < 1e-6).otherwise(F.abs(a - b) / F.abs(b) < 1e-6)
    return (F.lower(strip(got)) == F.lower(strip(answer))) | ((normalized_answer(got) != "") & (normalized_answer(got) == normalized_answer(answer))) | F.coalesce(near, F.lit(False))


def accuracy(c: Column, truth: Column) -> Column:
    """1 for the right answer; for several letters the F1 of the letters. A long answer is first searched for its own answer."""
    found = F.coalesce(extracted(truth, F.lit(True)), boxed(truth))

    def of(w) -> Column:
        exam = all_letters(w.w)
        got = F.coalesce(extracted(c, exam), boxed(c))

        def scored(g) -> Column:
            mine = F.when(g.e, normalized_answer(g.g)).otherwise(strip(g.g))
            right = F.when(g.e, normalized_answer(g.w)).otherwise(strip(g.w))
            same = (mine == right) | (F.lower(strip(g.g)) == F.lower(strip(g.w)))
            return F.when(g.g.isNull(), 0.0).when(same, 1.0).when(g.e, f1(mine, right)).otherwise(0.0)

        return let(F.struct(got.alias("g"), w.w.alias("w"), exam.alias("e")), scored)

    want = F.when(all_letters(truth), truth).otherwise(F.coalesce(found, truth))
    return F.when(truth.isNull(), 0.5).otherwise(let(F.struct(want.alias("w")), of))


def accuracy_of_any(c: Column, possible: Column) -> Column:
    """1 if the answer matches one of an array's; 0.5 for an empty array, which asks for nothing."""
    exam = F.exists(possible, all_letters)
    got = F.coalesce(extracted(c, exam), boxed(c))
    return F.when(F.size(possible) == 0, 0.5).otherwise(let(got, lambda g: F.when(g.isNull(), 0.0).otherwise(yes(F.exists(possible, lambda a: matches(g, a))))))


def box_format(c: Column) -> Column:
    """1 for a box, 0.5 for an empty one."""
    return F.when(~c.rlike(r"(?i)\\boxed\{[^}]*\}"), 0.0).when(strip(F.regexp_extract(c, r"(?i)\\boxed\{([^}]*)\}", 1)) != "", 1.0).otherwise(0.5)


def last_at(x: Column, part: str) -> Column:
    """Where a text holds a part last, from 1; 0 without it."""
    back = F.locate(part[::-1], F.reverse(x))
    return F.when(back > 0, F.length(x) - back - len(part) + 2).otherwise(0)


def format_compliance(c: Column) -> Column:
    """Thinking tags 0.7, and 0.3 if the last closing one comes before the first box."""
    low = F.lower(c)
    box = F.locate("\\boxed{", low)
    out = F.lit(0.0)
    for tag in reversed(THINK_TAGS):
        there = low.contains(f"<{tag}>") & low.contains(f"</{tag}>")
        ordered = (box == 0) | (last_at(low, f"</{tag}>") <= box)
        out = F.when(there, F.when(ordered, 1.0).otherwise(0.7)).otherwise(out)
    return out


def thoughts(c: Column) -> Column:
    """The closed thinking sections of either tag, in order of the tags."""
    return F.concat(*(F.regexp_extract_all(c, F.lit(rf"(?is)<{t}>(.*?)</{t}>"), F.lit(1)) for t in THINK_TAGS))


def longest_thought(c: Column) -> Column:
    """The longest thinking section, the first of equals, trimmed; null without one."""
    by = F.transform(thoughts(c), lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("i"), t.alias("t")))
    return strip(F.array_max(by)["t"])


def reasoning(c: Column) -> Column:
    """By the words of the longest section, words of analysis and options named; 0.3 without thinking."""

    def of(t: Column) -> Column:
        n, low = F.size(tok(t)), F.lower(t)
        words = F.when(n >= 50, 0.4).when(n >= 30, 0.3).when(n >= 15, 0.2).when(n >= 5, 0.1).otherwise(0.0)
        analysis = reduce(lambda e, w: e | low.contains(w), ANALYSIS, F.lit(False))
        return F.when(F.coalesce(t, F.lit("")) == "", 0.3).otherwise(words + 0.3 * yes(analysis) + 0.3 * yes(low.rlike(OPTIONS)))

    return let(longest_thought(c), of)


def words_after_box(c: Column) -> Column:
    tail = F.regexp_extract(c, r"(?is)\\boxed\{[^}]*\}(.*)$", 1)
    return F.size(tok(tail))


def length_penalty(thinking_words: Column, answer_words: Column, least: int = 20, most: int = 250, most_answer: int = 80, weight: float = 0.1) -> Column:
    """The weight times the mean of what applies: too little thinking, too much, too long an answer."""
    parts = [
        F.when(thinking_words < least, 1.0 - thinking_words / least),
        F.when(thinking_words > most, F.least(F.lit(1.0), (thinking_words - most) / most)),
        F.when(answer_words > most_answer, F.least(F.lit(1.0), (answer_words - most_answer) / most_answer)),
    ]
    n = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    return F.when(n > 0, weight * sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)) / n).otherwise(0.0)


def bad_words_penalty(c: Column, rate: float = 0.025, most: float = 0.15) -> Column:
    n = F.regexp_count(c, F.lit(r"(?iU)\b(?:" + "|".join(BAD_WORDS) + r")\b"))
    return F.least(F.lit(most), n * rate)


def repeat_words_penalty(c: Column, threshold: int = 4, rate: float = 0.02, most: float = 0.20) -> Column:
    """For each occurrence of a word of 4 letters or more beyond the threshold, but for words that repeat by nature."""
    words = F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"(?U)\b([a-zA-Z]+)\b"), F.lit(1)), F.lower), lambda w: (F.length(w) >= 4) & ~w.isin(*REPEATABLE))
    return F.least(F.lit(most), rate * over_runs(words, lambda n: F.greatest(F.lit(0), n - threshold).cast("double")))


def occurrences(x: Column, part: str) -> Column:
    return ((F.length(x) - F.length(F.replace(x, F.lit(part), F.lit("")))) / len(part)).cast("int")


def gaming_penalties(c: Column) -> dict[str, Column]:
    """What is taken for several boxes, hedging words, repeated phrases, odd characters, filler phrases, a hedging box, thinking
    with few distinct words, and thinking that concludes on another option than the box's."""
    th = F.lower(F.coalesce(F.try_element_at(thoughts(c), F.lit(1)), F.lit("")))
    hedges = F.size(F.filter(tok(c), lambda w: F.regexp_replace(w, r"^[.,!?;:()\[\]]+|[.,!?;:()\[\]]+$", "").isin(*HEDGE_WORDS)))
    odd = F.regexp_count(c, F.lit(GARBAGE))
    box = boxed(c)
    fillers = sum((occurrences(th, f) for f in FILLERS), F.lit(0))
    long_grams = lambda w: F.filter(F.concat(F.when(F.size(w) > 4, ngrams(w, 4)).otherwise(F.array().cast("array<string>")), F.when(F.size(w) > 5, ngrams(w, 5)).otherwise(F.array().cast("array<string>"))), lambda g: F.length(g) > 10)
    letter = F.upper(box)
    against = F.lit(False)
    for p in CONCLUDED:
        said = F.upper(F.regexp_extract(th, p, 0))
        against = against | F.coalesce(letter.rlike("^[A-D]$") & said.rlike("[A-D]") & (F.regexp_replace(F.regexp_replace(said, "[^A-D]", ""), letter, F.lit("")) != ""), F.lit(False))
    return {
        "phrases": F.least(F.lit(0.15), 0.05 * let(tok(th), lambda w: over_runs(long_grams(w), lambda n: yes(n >= 4)))),
        "fillers": F.when(fillers > 4, F.least(F.lit(0.12), (fillers - 4) * 0.04)).otherwise(0.0),
        "inconsistent": F.when(against, 0.20).otherwise(0.0),
        "several_boxes": F.when(F.regexp_count(c, F.lit(r"\\boxed\{[^}]*\}")) > 1, 0.25).otherwise(0.0),
        "hedge_words": F.when(hedges > 5, F.least(F.lit(0.12), (hedges - 5) * 0.02)).otherwise(0.0),
        "odd_characters": F.when(odd > 5, F.least(F.lit(0.20), (odd - 5) * 0.04)).otherwise(0.0),
        "hedging_box": F.when(reduce(lambda e, p: e | F.coalesce(box.rlike(p), F.lit(False)), HEDGES, F.lit(False)), 0.40).otherwise(0.0),
        "few_words": let(tok(th), lambda w: F.when((F.size(w) >= 10) & (F.size(F.array_distinct(w)) / F.size(w) < 0.20), 0.15).otherwise(0.0)),
    }


def smoothed(x: Column, how: str = "sigmoid", temperature: float = 4.0, center: float = 0.5) -> Column:
    if how == "sigmoid":
        return 1 / (1 + F.exp(-(x - center) * temperature))
    if how == "tanh":
        return 0.5 * (F.tanh((x - center) * temperature) + 1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) if how == "clip" else x


def parts(c: Column, truth: Column) -> dict[str, Column]:
    return {"accuracy": accuracy(c, truth), "boxed": box_format(c), "format": format_compliance(c), "reasoning": reasoning(c)}


def composite(p: dict[str, Column], penalty: Column) -> Column:
    """The weighted parts, the accuracy gated by the mean of the three formats, less the penalties, smoothed."""
    mean = (p["boxed"] + p["format"] + p["reasoning"]) / 3.0
    gated = F.when(mean < GATE, p["accuracy"] * GATED).otherwise(p["accuracy"])
    total = (WEIGHTS["accuracy"] * gated + sum((WEIGHTS[k] * p[k] for k in ("boxed", "format", "reasoning")), F.lit(0.0))) / sum(WEIGHTS.values())
    return smoothed(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total * F.greatest(F.lit(0.0), 1.0 - penalty))))


def penalty(c: Column) -> Column:
    words = F.size(tok(F.coalesce(longest_thought(c), F.lit(""))))
    gaming = F.least(F.lit(1.0), sum(gaming_penalties(c).values(), F.lit(0.0)))
    return length_penalty(words, words_after_box(c)) + bad_words_penalty(c) + repeat_words_penalty(c) + gaming


@register("exam_accuracy", tags=("exam",))
def exam_accuracy(p, c, a, t):
    return accuracy(c, a)


@register("exam_format", tags=("exam",))
def exam_format(p, c, a, t):
    return (box_format(c) + format_compliance(c) + reasoning(c)) / 3.0


@register("exam_reasoning", tags=("exam",))
def exam_reasoning(p, c, a, t):
    return reasoning(c)


@register("exam_strict_format", tags=("exam",))
def exam_strict_format(p, c, a, t):
    """A box and thinking tags."""
    return yes((box_format(c) > 0) & (format_compliance(c) > 0))


@register("exam", tags=("exam", "composite"))
def exam(p, c, a, t):
    return composite(parts(c, a), penalty(c))
