"""Column builders for a completion's sections, its answer, its numbers, and whether it is whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .text import THINK, UNTHINK, let, strip

# What a whole text ends with, and what a broken one does, with the confidence of either; in order.
GOOD_ENDINGS = ((".", 0.95), ("!", 0.95), ("?", 0.95), (")", 0.85), ("]", 0.85), ("}", 0.90), ('"', 0.80), ("'", 0.80), ("`", 0.75), (">", 0.70))
BROKEN = (
    (r"\s+(?:and|or|but|so|then)\s*$", "trailing_conjunction", 0.2),
    (r"\s+(?:the|a|an|this|that)\s*$", "trailing_article", 0.2),
    (r"\s+(?:is|are|was|were|be)\s*$", "trailing_verb", 0.3),
    (r"\s+(?:to|of|in|for|with)\s*$", "trailing_preposition", 0.2),
    (r"[,;:]\s*$", "trailing_punctuation", 0.4),
    (r"[\(\[\{]\s*$", "unclosed_bracket", 0.2),
    (r"[=\+\-\*/]\s*$", "trailing_operator", 0.3),
)
ANSWER_MARKS = (
    r"(?:the\s+)?(?:final\s+)?answer\s+is[:\s]+([^\n.]+)",
    r"(?:therefore|thus|hence|so)[,:\s]+(?:the\s+answer\s+is\s+)?([^\n.]+)",
    r"(?:answer|result|solution)[:\s]+([^\n.]+)",
    r"=\s*([^\n,=]+)$",
)
SKIPPED = r"^[#*\->|`]|^[Ss]tep\s+\d|^[Ff]irst|^[Ss]econd|^[Tt]hird|^[Ll]et\s+me"
LAST_BOX = r"\\boxed\{([^{}]+(?:\{[^{}]*\}[^{}]*)*)\}"


def closed_thoughts(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?s)<think>(.*?)</think>"), F.lit(1)), strip)


def thinking_section(c: Column) -> Column:
    """All closed thinking sections; if no tag closes, what follows the open one; else nothing."""
    opened = strip(F.substring(c, F.locate(THINK, c) + len(THINK), F.length(c)))
    return F.when(c.contains(UNTHINK), F.array_join(closed_thoughts(c), "\n\n")).when(c.contains(THINK), opened).otherwise("")


def answer_section(c: Column) -> Column:
    """What follows the last closing tag; nothing if a section stays open; else all."""
    return F.when(c.contains(UNTHINK), strip(F.substring_index(c, UNTHINK, -1))).when(c.contains(THINK), "").otherwise(strip(c))


def completeness(x: Column) -> Column:
    """A struct of complete, reason and confidence by how a text ends."""
    s = strip(x)
    said = lambda ok, why, sure: F.struct(F.lit(ok).alias("complete"), F.lit(why).alias("reason"), F.lit(sure).alias("confidence"))
    count = lambda ch: F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))
    out = F.when(x == "", said(False, "empty", 0.0)).when(F.length(s) < 3, said(False, "too_short", 0.0))
    for end, sure in GOOD_ENDINGS:
        out = out.when(s.endswith(end), said(True, f"good_ending:{end}", sure))
    boxed = s.contains("\\boxed{")
    out = out.when(boxed & (count("{") == count("}")), said(True, "complete_boxed", 0.90)).when(boxed, said(False, "unbalanced_braces", 0.3))
    for p, why, sure in BROKEN:
        out = out.when(s.rlike("(?iU)" + p), said(False, why, sure))
    for a, b in ("()", "[]", "{}"):
        out = out.when(count(a) > count(b), said(False, f"unbalanced:{a}{b}", 0.4))
    last = F.substring(s, -1, 1).rlike(r"[\p{L}\p{N}]")
    return out.when(last & (F.length(s) < 50), said(True, "short_alnum_ok", 0.7)).when(last, said(False, "no_terminal_punct", 0.5)).otherwise(said(True, "acceptable", 0.75))


def unmatched_tags(x: Column) -> Column:
    """How many tags are left when each closing one takes the last open one, if it has its name; self-closing ones don't count."""
    pattern = r"(?U)<(/?)(\w+)(?:\s[^>]*)?(/)?\s*>"
    groups = [F.regexp_extract_all(x, F.lit(pattern), F.lit(k)) for k in (1, 2, 3)]
    tags = F.filter(F.arrays_zip(*(g.alias(n) for g, n in zip(groups, ("close", "name", "self")))), lambda t: F.coalesce(t["self"], F.lit("")) != "/")

    def step(stack, t):
        name = F.lower(t["name"])
        top = F.try_element_at(stack, F.lit(-1))
        return F.when(t["close"] != "/", F.concat(stack, F.array(name))).when(F.coalesce(top == name, F.lit(False)), F.slice(stack, F.lit(1), F.size(stack) - 1)).otherwise(F.concat(stack, F.array(F.concat(F.lit("/"), name))))

    return F.size(F.aggregate(tags, F.array().cast("array<string>"), step))


def answer_content(x: Column) -> Column:
    """The last box, else what a marker of the answer announces, else a short code block, else the last line of content."""
    t = strip(x)
    boxes = F.regexp_extract_all(t, F.lit(LAST_BOX), F.lit(1))
    steps = [F.when(F.size(boxes) > 0, strip(F.element_at(boxes, -1)))]
    for p in ANSWER_MARKS:
        got = F.regexp_replace(F.regexp_replace(strip(F.regexp_extract(t, "(?imU)" + p, 1)), r"(?U)^[:\s]+", ""), r"(?U)[.\s]+$", "")
        steps.append(F.nullif(got, F.lit("")))
    for p in (r"(?sU)```(?:\w+)?\s*(.*?)```", r"(?sU)`([^`]+)`"):
        got = strip(F.regexp_extract(t, p, 1))
        steps.append(F.when((got != "") & (F.length(got) < 200), got))
    lines = F.filter(F.transform(F.split(t, "\n"), strip), lambda v: v != "")
    content = F.filter(lines, lambda v: ~v.rlike(SKIPPED) & (F.length(v) > 1))
    steps += [F.substring(F.try_element_at(content, F.lit(-1)), 1, 500), F.substring(F.try_element_at(lines, F.lit(-1)), 1, 500)]
    return F.when(t == "", "").otherwise(F.coalesce(*steps, F.substring(t, 1, 500)))


def final_answer(c: Column) -> Column:
    """The answer section's content; the whole completion's if it has no answer section."""
    return let(answer_section(c), lambda a: F.when(a != "", answer_content(a)).otherwise(answer_content(c)))


def normalized(x: Column, punctuation: bool = True) -> Column:
    """Lower-cased, with single spaces, and without punctuation if so asked."""
    out = F.lower(x) if punctuation else F.regexp_replace(F.lower(x), r"(?U)[^\w\s]", "")
    return strip(F.regexp_replace(out, r"(?U)\s+", " "))


def extracted_numbers(x: Column) -> Column:
    """The distinct numbers of a text in order; a comma before three digits parts thousands, another one decimals."""
    found = F.regexp_extract_all(x, F.lit(r"-?\d+(?:[,.]\d+)?(?:[eE][+-]?\d+)?"), F.lit(0))
    value = lambda m: F.when(m.rlike(r",\d{3}$"), F.replace(m, F.lit(","), F.lit(""))).otherwise(F.replace(m, F.lit(","), F.lit("."))).try_cast("double")
    return F.array_distinct(F.transform(found, value))


# ---- curriculum
INTUITION = (r"(?i)\[ANSWER INTUITION:[^\]]*\]", r"(?i)\[ANSWER INTUITION:[^\n]*")


def parted(c: Column) -> Column:
    """A struct of before, thinking and after, by the first opening and the first closing tag; all is after if they aren't in order."""
    o, e = F.locate(THINK, c), F.locate(UNTHINK, c)
    fine = (o > 0) & (e > o)
    return F.struct(
        F.when(fine, F.substring(c, F.lit(1), o - 1)).otherwise("").alias("before"),
        F.when(fine, F.substring(c, o + len(THINK), e - o - len(THINK))).otherwise("").alias("thinking"),
        F.when(fine, F.substring(c, e + len(UNTHINK), F.length(c))).otherwise(c).alias("after"),
    )


def intuition_end(x: Column) -> Column:
    """How many characters an answer intuition and all before it take, with the line end after it; 0 without one."""
    ends = []
    for p in INTUITION:
        m = F.regexp_extract(x, p, 0)
        end = F.instr(x, m) + F.length(m) - 1
        ends.append(F.when(m != "", F.when(F.substring(x, end + 1, F.lit(1)) == "\n", end + 1).otherwise(end)).otherwise(0))
    return F.greatest(*ends)


def truncated(x: Column, ratio: Column, by_lines: bool = True, middle: bool = False, keep_intuition: bool = True) -> Column:
    """The share of a thinking text that a curriculum keeps: its start, or its start and end around an ellipsis. An answer
    intuition and what precedes it always stay."""
    mark = "\n...\n"

    def cut(body: Column) -> Column:
        if by_lines:
            lines = F.split(body, "\n")
            n = F.size(lines)
            if not middle:
                return F.array_join(F.slice(lines, F.lit(1), F.greatest(F.lit(1), (n * ratio).cast("int"))), "\n")
            keep = F.greatest(F.lit(2), (n * ratio).cast("int"))
            head = F.floor(keep / 2).cast("int")
            joined = F.array_join(F.concat(F.slice(lines, F.lit(1), head), F.array(F.lit(mark)), F.slice(lines, n - (keep - head) + 1, keep - head)), "\n")
            return F.when((n <= 2) | (keep >= n), body).otherwise(joined)
        n = F.length(body)
        if not middle:
            return F.substring(body, F.lit(1), F.greatest(F.lit(1), (n * ratio).cast("int")))
        keep = F.greatest(F.lit(10), (n * ratio).cast("int"))
        head = F.floor(keep / 2).cast("int")
        return F.when((n <= 20) | (keep >= n), body).otherwise(F.concat(F.substring(body, F.lit(1), head), F.lit(mark), F.substring(body, n - (keep - head) + 1, keep - head)))

    at = intuition_end(x) if keep_intuition else F.lit(0)

    def of(p) -> Column:
        rest = F.substring(x, p.at + 1, F.length(x))
        return F.when((p.at > 0) & (strip(rest) == ""), x).otherwise(F.concat(F.substring(x, F.lit(1), p.at), cut(rest)))

    return F.when(ratio >= 1, x).when(ratio <= 0, "").otherwise(let(F.struct(at.alias("at")), of))


def curriculum_prefix(c: Column, ratio: Column, **how) -> Column:
    """What a generation goes on from: all before the thinking, its tag and the kept share; never the closing tag."""
    return let(parted(c), lambda p: F.when((p["thinking"] == "") | (ratio <= 0), "").otherwise(F.concat(p["before"], F.lit(THINK), truncated(p["thinking"], ratio, **how))))


def word_prefix(c: Column, ratio: Column) -> Column:
    """The first share of the thinking's words after the tag; the whole text for a ratio of 1."""
    words = F.filter(F.split(F.regexp_extract(c, r"(?s)<think>(.*?)</think>", 1), r"(?U)\s+"), lambda w: w != "")
    kept = F.array_join(F.slice(words, F.lit(1), F.greatest((F.size(words) * ratio).cast("int"), F.lit(0))), " ")
    return F.when(ratio >= 1, c).when((ratio <= 0) | (F.size(words) == 0), "").otherwise(F.concat(F.lit(THINK + "\n"), kept))


def thinking_words(c: Column) -> Column:
    """Words of the thinking, closed or open."""
    th = F.when(c.contains(THINK), F.regexp_extract(c, r"(?s)<think>(.*?)(?:</think>|$)", 1)).otherwise("")
    return F.size(F.filter(F.split(th, r"(?U)\s+"), lambda w: w != ""))
