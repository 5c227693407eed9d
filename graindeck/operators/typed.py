"""Scorers by task type: math, multiple choice, code and tool calls, each a weighted mean of its components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ..functions.registry import register
from ..functions.text import THINK, UNTHINK, let, strip, thinking, tok
from .scoring import SPECIAL, general_qna, in_order, strict_format, yes

# The patterns that the scores are defined by.
BOX = r"\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}"
FLAT_BOX = r"\\boxed\{([^}]*)\}"
STEPS = r"(?iU)step\s*\d|therefore|thus|hence|so\s+we|this\s+gives|which\s+means"
OPTION = r"(?iU)(?:^|\s|'|\"|\()([A-D])(?:$|\s|\.|'|\"|\)|:)"
OPTION_NAMED = r"(?iU)answer:\s*([A-D])"
OPTION_WANTED = r"(?iU)(?:^|\s)([A-D])(?=$|\s|\.|:|\))"
HEDGES = (r"(?iU)\b[A-D]\s+(or|and)\s+[A-D]\b", r"(?iU)\b[A-D]\s*/\s*[A-D]\b", r"(?iU)\b[A-D]\s*,\s*[A-D]\b", r"(?iU)\b(either|both)\b")
DOUBTS = ("i think", "i believe", "maybe", "i'm not sure", "confused", "stuck")
CODE_BLOCK = r"(?s)```(?:python|py)?\s*\n(.*?)```"
CODE_TALK = ("approach", "algorithm", "iterate", "loop", "recursive", "edge case", "complexity", "return", "input", "output")
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
LATEX = (("\\,", ""), ("\\;", ""), ("\\cdot", "*"), ("\\times", "*"), ("\\div", "/"), ("\\pi", "pi"), ("$", ""), ("\\{", ""), ("\\}", ""))
WEIGHTS = {"math": (0.5, 0.25, 0.25), "mcq": (0.5, 0.25, 0.25), "python": (0.4, 0.3, 0.3)}


def answer_after(c: Column) -> Column:
    """What follows the first closed thinking section, else the whole text; trimmed."""
    return F.when(c.rlike(r"(?s)<think>.*?</think>"), strip(F.regexp_extract(c, r"(?s)<think>.*?</think>\s*(.*)", 1))).otherwise(strip(c))


def unboxed(x: Column, box: str = BOX) -> Column:
    return strip(F.when(x.rlike(box), F.regexp_extract(x, box, 1)).otherwise(x))


def folded(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def plain_latex(x: Column) -> Column:
    out = F.regexp_replace(strip(x), r"\\frac\{([^}]*)\}\{([^}]*)\}", r"($1)/($2)")
    out = F.regexp_replace(out, r"\\sqrt\{([^}]*)\}", r"sqrt($1)")
    out = F.regexp_replace(out, r"(?U)\\(?:text|mathrm|mathbf|mathit|left|right|displaystyle)\b\s*", "")
    for old, new in LATEX:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.lower(folded(out))


def number(x: Column) -> Column:
    return F.when(x.rlike(NUMBER), x.try_cast("double"))


def numeric(x: Column) -> Column:
    """A fraction, a number or a percentage; null for other texts."""
    s = F.replace(F.replace(strip(x), F.lit(","), F.lit("")), F.lit(" "), F.lit(""))
    halves = [number(F.regexp_replace(F.split_part(s, F.lit("/"), F.lit(k)), r"^[()]+|[()]+$", "")) for k in (1, 2)]
    ratio = F.when((F.length(s) - F.length(F.replace(s, F.lit("/"), F.lit(""))) == 1) & (halves[1] != 0), halves[0] / halves[1])
    return F.coalesce(ratio, number(s), F.when(s.endswith("%"), number(F.substring(s, F.lit(1), F.length(s) - 1)) / 100))


def math_correctness(answer: Column, want: Column, tolerance: float = 1e-6) -> Column:
    """Equal 1, equal numbers 1, numbers within a hundredth 0.8, one within the other 0.7."""

    def of(p) -> Column:
        near = F.abs(p.x - p.y)
        return (
            F.when((answer == "") | (want == ""), 0.0)
            .when(p.a == p.b, 1.0)
            .when(F.coalesce(near <= tolerance, F.lit(False)), 1.0)
            .when(F.coalesce((p.y != 0) & (near / F.abs(p.y) < 0.01), F.lit(False)), 0.8)
            .when(F.contains(p.a, p.b) | F.contains(p.b, p.a), 0.7)
            .otherwise(0.0)
        )

    texts = F.struct(plain_latex(unboxed(answer)).alias("a"), plain_latex(unboxed(want)).alias("b"))
    return let(texts, lambda t: let(F.struct(t.a.alias("a"), t.b.alias("b"), numeric(t.a).alias("x"), numeric(t.b).alias("y")), of))


def math_format(c: Column) -> Column:
    between = F.substring(c, F.locate(THINK, c) + len(THINK), F.locate(UNTHINK, c) - F.locate(THINK, c) - len(THINK))
    after = F.substring(c, F.locate(UNTHINK, c) + len(UNTHINK), F.length(c))
    parts = [c.contains(THINK), c.contains(UNTHINK), in_order(c) & (F.length(strip(between)) >= 10), c.contains(UNTHINK) & (F.length(strip(after)) >= 2), c.contains("\\boxed{")]
    return F.when(strict_format(None, c, None, None) == 1, 1.0).otherwise(sum((0.2 * yes(p) for p in parts), F.lit(0.0)))


def by_length(score: Column, n: Column, short: int, long: int) -> Column:
    """A score, less for a text of under short words or of over long."""
    factor = F.when(n < short, F.greatest(F.lit(0.3), n / short)).when(n > long, F.greatest(F.lit(0.5), 1.0 - 0.2 * (n - long) / long)).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score * factor))


def math_thinking(th: Column) -> Column:
    steps, equations = F.regexp_count(th, F.lit(STEPS)), F.regexp_count(th, F.lit("[=<>≤≥]"))
    score = 0.8 + F.when(steps >= 2, 0.15).when(steps >= 1, 0.05).otherwise(0.0) + F.when(equations >= 3, 0.1).when(equations >= 1, 0.05).otherwise(0.0)
    return F.when(F.coalesce(th, F.lit("")) == "", 0.0).otherwise(by_length(score, F.size(tok(th)), 15, 200))


def mcq_letter(answer: Column) -> Column:
    """The last option named, of those after "answer:" if any, in capitals; null without one."""
    found = F.concat(F.regexp_extract_all(answer, F.lit(OPTION), F.lit(1)), F.regexp_extract_all(answer, F.lit(OPTION_NAMED), F.lit(1)))
    return F.upper(F.try_element_at(found, F.lit(-1)))


def mcq_match(answer: Column, want: Column, possible: Column | None = None) -> Column:
    got = F.when(answer.rlike(FLAT_BOX), strip(F.regexp_extract(answer, FLAT_BOX, 1))).otherwise(F.coalesce(mcq_letter(answer), strip(answer)))
    w = strip(want)
    letter = F.upper(F.regexp_extract(w, OPTION_WANTED, 1))

    def of(g: Column) -> Column:
        out = F.when((answer == "") | (want == ""), 0.0).when(F.lower(g) == F.lower(w), 1.0).when((letter != "") & (F.upper(g) == letter), 1.0)
        if possible is not None:
            out = out.when(F.exists(possible, lambda p: F.lower(strip(p)) == F.lower(g)), 1.0)
        return out.otherwise(0.0)

    return let(got, of)


def mcq_hedging(answer: Column) -> Column:
    return F.least(F.lit(1.0), sum((0.3 * yes(answer.rlike(h)) for h in HEDGES), F.lit(0.0)))


def mcq_format(c: Column) -> Column:
    after = F.substring(c, F.locate(UNTHINK, c) + len(UNTHINK), F.length(c))
    parts = [c.contains(THINK), c.contains(UNTHINK), in_order(c), c.contains(UNTHINK) & (F.length(strip(after)) >= 2)]
    return sum((0.25 * yes(p) for p in parts), F.lit(0.0))


def mcq_reasoning(th: Column) -> Column:
    bad = reduce(lambda e, p: e + yes(th.rlike(rf"(?iU)\b{p}\b")), DOUBTS, F.lit(0.0))
    special = reduce(lambda e, s: e + yes(th.contains(s)), SPECIAL, F.lit(0.0))
    score = 1.0 - F.least(F.lit(0.4), 0.1 * bad) - 0.3 * special + 0.1 * yes(th.rlike(r"(?U)\n\s*[-*]|\n\s*\d+\.\s+"))
    return F.when(F.coalesce(th, F.lit("")) == "", 0.0).otherwise(by_length(score, F.size(tok(th)), 10, 150))


def code_of(answer: Column) -> Column:
    """The code blocks of an answer, joined; without one the answer."""
    return let(F.regexp_extract_all(answer, F.lit(CODE_BLOCK), F.lit(1)), lambda b: F.when(F.size(b) > 0, F.array_join(b, "\n")).otherwise(answer))


def lines_of(x: Column) -> Column:
    return F.array_distinct(F.split(strip(x), "\r\n|\n|\r"))


def python_correctness(answer: Column, want: Column) -> Column:
    """Equal 1, but for white space 1, containing 0.8, by the share of the wanted lines 0.7 or 0.4."""

    def of(code: Column) -> Column:
        share = F.size(F.array_intersect(lines_of(code), lines_of(want))) / F.size(lines_of(want))
        same = (strip(code) == strip(want)) | (folded(code) == folded(want))
        return F.when((answer == "") | (want == ""), 0.0).when(same, 1.0).when(F.contains(folded(code), folded(want)), 0.8).when(share >= 0.8, 0.7).when(share >= 0.5, 0.4).otherwise(0.0)

    return let(code_of(answer), of)


def python_thinking(th: Column) -> Column:
    hits = reduce(lambda e, w: e + F.lower(th).contains(w).cast("int"), CODE_TALK, F.lit(0))
    score = 0.8 + F.when(hits >= 3, 0.15).when(hits >= 1, 0.05).otherwise(0.0)
    return F.when(F.coalesce(th, F.lit("")) == "", 0.0).otherwise(by_length(score, F.size(tok(th)), 10, 200))


def python_quality(answer: Column) -> Column:
    """A code block 0.3, parsing 0.4 (0.2 if only one block does), a definition 0.2, 3 to 100 lines 0.1."""
    from ..functions.pyfuncs import parses

    blocks = F.regexp_extract_all(answer, F.lit(CODE_BLOCK), F.lit(1))
    code = code_of(answer)
    syntax = F.when(parses(F.array(code)), 0.4).when((F.size(blocks) > 0) & parses(blocks), 0.2).otherwise(0.0)
    n = F.size(F.split(strip(code), "\r\n|\n|\r"))
    score = 0.3 * yes(F.size(blocks) > 0) + syntax + 0.2 * yes(code.rlike(r"(?U)(?:def |class )\w+")) + 0.1 * yes(n.between(3, 100))
    return F.when(answer == "", 0.0).otherwise(F.least(F.lit(1.0), score))


def combined(kind: str, *parts: Column) -> Column:
    w = WEIGHTS[kind]
    return sum((x * y for x, y in zip(parts, w)), F.lit(0.0)) / sum(w)


def sound(c: Column, least: int = 2) -> Column:
    """Whether a completion is long enough to be scored."""
    return F.length(strip(c)) >= least


@register("math", tags=("composite", "typed"))
def math_score(p, c, a, t):
    """Correctness 0.5, format 0.25, thinking 0.25; nothing for under 2 characters."""
    return F.when(sound(c), combined("math", math_correctness(answer_after(c), a), math_format(c), math_thinking(thinking(c)))).otherwise(0.0)


@register("mcq", tags=("composite", "typed"))
def mcq_score(p, c, a, t):
    """The answer less hedging 0.5, format 0.25, reasoning 0.25; nothing for under 2 characters."""
    match = F.greatest(F.lit(0.0), mcq_match(answer_after(c), a) - mcq_hedging(answer_after(c)))
    return F.when(sound(c), combined("mcq", match, mcq_format(c), mcq_reasoning(thinking(c)))).otherwise(0.0)


@register("python", tags=("composite", "typed"))
def python_score(p, c, a, t):
    """Correctness 0.4, code quality 0.3, thinking 0.3; nothing for under 2 characters."""
    return F.when(sound(c), combined("python", python_correctness(answer_after(c), a), python_quality(answer_after(c)), python_thinking(thinking(c)))).otherwise(0.0)


def without_thinking(c: Column) -> Column:
    """A text without closed thinking sections, then without an open one."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?s)<think>.*?</think>\s*", ""), r"(?s)<think>.*$", ""))


def hermes_calls(x: Column) -> Column:
    """The tagged calls that are JSON objects: name, and arguments as texts by name (null if they are no object)."""
    found = F.regexp_extract_all(x, F.lit(r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"), F.lit(1))
    parsed = F.transform(found, lambda j: F.from_json(j, "name string, arguments string"))
    named = F.filter(parsed, lambda r: r.isNotNull() & (r["name"].isNotNull() | r["arguments"].isNotNull()))
    return F.transform(named, lambda r: F.struct(F.coalesce(r["name"], F.lit("")).alias("name"), F.from_json(F.coalesce(r["arguments"], F.lit("{}")), "map<string,string>").alias("arguments")))


def expected_calls(x: Column) -> Column:
    """Tagged calls; without one, the names of calls that are lines of their own, whose arguments don't count."""
    lines = F.filter(F.transform(F.split(strip(x), "\n"), lambda s: F.regexp_extract(strip(s), r"(?sU)^(\w+)\(.*\)$", 1)), lambda s: s != "")
    legacy = F.transform(lines, lambda s: F.struct(s.alias("name"), F.from_json(F.lit("{}"), "map<string,string>").alias("arguments")))
    return let(hermes_calls(x), lambda h: F.when(F.size(h) > 0, h).otherwise(legacy))


def equal_values(a: Column, b: Column) -> Column:
    """Equal texts, or numbers within a millionth."""
    return F.coalesce(a == b, F.lit(False)) | F.coalesce(F.abs(number(a) - number(b)) < 1e-6, F.lit(False))


def argument_score(got: Column, want: Column) -> Column:
    names = F.map_keys(want)
    hits = F.size(F.filter(names, lambda k: equal_values(got[k], want[k])))
    return F.when(F.size(names) == 0, 1.0).when(got.isNull(), 0.0).otherwise(hits / F.size(names))


@register("tool_call", tags=("composite", "typed"))
def tool_call_score(p, c, a, t):
    """Half for the expected calls' names, half for their arguments; nothing without a tagged call, a right name, or with a box."""

    def of(x) -> Column:
        first = lambda w: F.try_element_at(F.filter(x.got, lambda g: g["name"] == w["name"]), F.lit(1))
        mean = lambda f: F.aggregate(F.transform(x.want, f), F.lit(0.0), lambda s, v: s + v) / F.size(x.want)
        names = mean(lambda w: yes(first(w).isNotNull()))
        arguments = mean(lambda w: let(first(w), lambda g: F.when(g.isNull(), 0.0).otherwise(argument_score(g["arguments"], w["arguments"]))))
        return F.when((F.size(x.got) == 0) | (F.size(x.want) == 0), 0.0).otherwise(let(names, lambda n: F.when(n == 0, 0.0).otherwise(0.5 * n + 0.5 * arguments)))

    def scored(tool: Column) -> Column:
        fine = tool.contains("<tool_call>") & ~tool.contains("\\boxed{")
        return F.when(fine, let(F.struct(hermes_calls(tool).alias("got"), expected_calls(a).alias("want")), of)).otherwise(0.0)

    return let(without_thinking(c), scored)


def only_calls(c: Column) -> Column:
    """Whether nothing but tagged calls is left of a completion without its thinking."""
    rest = F.regexp_replace(without_thinking(c), r"(?s)<tool_call>.*?</tool_call>", "")
    return without_thinking(c).contains("<tool_call>") & (strip(rest) == "")


@register("by_type", tags=("composite", "typed"))
def by_type(p, c, a, t):
    """Each row by its type's scorer, without a shuffle; types without one by general_qna's."""
    from .routing import normalized_type

    kind = normalized_type(t)
    out = F.when(kind == "tool_call", tool_call_score(p, c, a, t)).when(kind == "mcq", mcq_score(p, c, a, t)).when(kind == "math", math_score(p, c, a, t))
    return out.when(kind == "python", python_score(p, c, a, t)).otherwise(general_qna(p, c, a, t))
