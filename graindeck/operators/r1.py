"""More scorers of single completions: information density, thinking efficiency, answer quality, similarity, options, repetition, convergence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from ..functions.registry import register
from ..functions.text import THINK, UNTHINK, distinct_ngram_loss, jaccard, let, strip, thinking, tok, word_set
from .scoring import yes
from .typed import BOX, OPTION, OPTION_NAMED, OPTION_WANTED

# Fixed values.
FILLERS = ("basically", "actually", "literally", "really", "very", "quite", "somewhat", "rather", "fairly", "pretty", "kind of", "sort of")
NUMBERS = r"(?U)\b\d+(?:\.\d+)?(?:%|kg|m|km|GB|MB)?\b"
TECHNICAL = r"(?U)\b[A-Z]{2,}|\w+_\w+|[a-z]+\(\)|<[^>]+>"
CITED = "according to|research shows|study found|data indicates"
BEST_THINKING = {"math": (20, 100), "code": (30, 150), "essay": (50, 200), "mcq": (10, 50), "reasoning": (30, 120)}
UNWANTED = (
    "as an ai", "i cannot", "cannot fulfill", "against my programming", "language model", "apologize", "unable to assist", "regenerate response",
    "ethical guidelines", "safety guidelines", "cannot provide", "not appropriate", "cannot generate", "i am not a doctor", "i am not a lawyer",
    "my purpose", "limitations", "virtual assistant", "knowledge cutoff", "openai", "anthropic", "let me think", "let me start", "first thought", "okay, the user",
    "the user wants", "analyzing this", "breaking this down", "here is the answer", "hope this helps", "thanks for asking", "you got it",
    "i recall that", "hate speech", "supremacy", "genocide", "bioweapon", "chemical weapon", "drug trafficking", "money laundering",
    "cyberbullying", "flat earth", "chemtrails", "illuminati", "deep state", "qanon", "anti-vax",
)
EMOJI = r"[\x{1f600}-\x{1f64f}\x{1f300}-\x{1f5ff}\x{1f680}-\x{1f6ff}\x{1f700}-\x{1f77f}\x{1f780}-\x{1f7ff}\x{1f800}-\x{1f82f}\x{1f8a0}-\x{1f8ff}\x{1f900}-\x{1f9ff}\x{2600}-\x{26ff}\x{2700}-\x{27bf}\x{fe0f}]"
PHRASES = ("i think", "let me", "okay", "wait", "hmm", "so basically")
CONVERGED, CONSISTENCY = 0.6, 0.25
# Weights of eight scores by question type.
SCORES = ("accuracy", "semantic", "thinking", "answer_quality", "format", "conciseness", "repetition", "efficiency")
DEFAULT_WEIGHTS = (0.25, 0.20, 0.10, 0.10, 0.05, 0.15, 0.10, 0.05)
TYPE_WEIGHTS = {
    "math": (0.40, 0.10, 0.15, 0.03, 0.01, 0.20, 0.01, 0.10),
    "code": (0.35, 0.05, 0.15, 0.03, 0.10, 0.15, 0.02, 0.15),
    "essay": (0.10, 0.30, 0.20, 0.15, 0.02, 0.15, 0.05, 0.03),
    "mcq": (0.50, 0.01, 0.03, 0.01, 0.15, 0.20, 0.00, 0.10),
    "reasoning": (0.25, 0.15, 0.25, 0.03, 0.02, 0.15, 0.05, 0.10),
}


def said(c: Column) -> Column:
    """The answer: tagged if nothing was thought, what follows closed thinking without answer tags, nothing for open thinking."""
    tagged = F.when(c.rlike(r"(?s)<answer>.*?</answer>"), strip(F.regexp_extract(c, r"(?s)<answer>(.*?)</answer>", 1))).otherwise(strip(c))
    after = strip(F.regexp_replace(F.regexp_extract(c, r"(?s)<think>.*?</think>\s*(.*)", 1), "</?answer>", ""))
    return F.when(~c.contains(THINK), tagged).when(c.rlike(r"(?s)<think>.*?</think>"), after).when(~c.contains(UNTHINK), "").otherwise(strip(c))


def thought(c: Column) -> Column:
    return F.coalesce(thinking(c), F.lit(""))


def equal(a: Column, b: Column) -> Column:
    return F.lower(strip(a)) == F.lower(strip(b))


@register("information_density", tags=("length",))
def information_density(p, c, a, t):
    """0.6, more for numbers, technical terms and citations, less for filler words; 0.5 for short texts and answers."""

    def of(x: Column) -> Column:
        w = F.split(F.lower(x), r"(?U)\s+")
        n = F.size(F.filter(w, lambda v: v != ""))
        filler = F.size(F.filter(w, lambda v: v.isin(*FILLERS))) / n
        score = 0.6 + 0.1 * yes(x.rlike(NUMBERS)) + 0.1 * yes(x.rlike(TECHNICAL)) + 0.1 * yes(x.rlike(CITED)) - 0.3 * yes(filler > 0.2)
        return F.when(n < 10, 0.5).otherwise(score)

    return F.when(F.length(strip(c)) < 20, 0.5).otherwise(let(said(c), of))


@register("thinking_efficiency", tags=("thinking",))
def thinking_efficiency(p, c, a, t):
    """By a right answer, and how near the thinking's length is to the type's band; half without thinking."""
    base = F.when(equal(said(c), a), 0.5).otherwise(0.2)

    def extra(n: Column, band) -> Column:
        low, high = band
        return F.when(n.between(low, high), 0.3).when(n < low, 0.15 * (n / low)).otherwise(F.greatest(F.lit(0.05), 0.3 - 0.2 * F.least((n - high) / high, F.lit(2.0))))

    def by_type(n: Column) -> Column:
        out = F.when(F.lit(False), 0.0)
        for k, band in BEST_THINKING.items():
            out = out.when(F.lower(t) == k, extra(n, band))
        return out.otherwise(extra(n, (20, 100)))

    return F.when(thought(c) == "", base * 0.5).otherwise(base + let(F.size(tok(thought(c))), by_type))


@register("answer_quality", tags=("gaming",))
def answer_quality(p, c, a, t):
    """0 for answers of under 5 characters or with an unwanted phrase (single words as words), 0.1 less for emoji."""

    def of(x: Column) -> Column:
        low = F.lower(x)
        bad = F.size(F.array_intersect(F.split(low, r"(?U)\s+"), F.array(*map(F.lit, [u for u in UNWANTED if " " not in u])))) > 0
        for u in UNWANTED:
            if " " in u:
                bad = bad | low.contains(u)
        return F.when((F.length(x) < 5) | bad, 0.0).otherwise(1.0 - 0.1 * yes(x.rlike(EMOJI)))

    return let(said(c), of)


@register("semantic_similarity", tags=("accuracy",))
def semantic_similarity(p, c, a, t):
    """Equal answers 1, else the word overlap, less for an answer over twice as long. Boxes count by what they hold."""
    inside = lambda x: F.when(x.rlike(BOX), strip(F.regexp_extract(x, BOX, 1))).otherwise(x)

    def of(s) -> Column:
        ratio = F.length(s.g) / F.greatest(F.length(s.w), F.lit(1))
        score = jaccard(word_set(s.g), word_set(s.w)) * F.when(ratio > 2, F.greatest(F.lit(0.5), 1.0 - 0.1 * (ratio - 2))).otherwise(1.0)
        return F.when(equal(s.g, s.w), 1.0).otherwise(score)

    return F.when((said(c) == "") | (said(a) == ""), 0.0).otherwise(let(F.struct(inside(said(c)).alias("g"), inside(said(a)).alias("w")), of))


@register("mcq_accuracy", tags=("accuracy",))
def mcq_accuracy(p, c, a, t):
    """Whether the last option named is the wanted one."""
    x = said(c)
    found = F.concat(F.regexp_extract_all(x, F.lit(OPTION), F.lit(1)), F.regexp_extract_all(x, F.lit(OPTION_NAMED), F.lit(1)))
    want = F.regexp_extract(a, OPTION_WANTED, 1)
    return F.coalesce(yes(F.upper(F.try_element_at(found, F.lit(-1))) == F.upper(F.when(want != "", want).otherwise(F.substring(strip(a), 1, 1)))), F.lit(0.0))


@register("repetition_penalty", tags=("length",))
def repetition_penalty(p, c, a, t):
    """1 less repeated 4-grams beyond 0.3 and common phrases beyond three times. Likeness of sentences is left to
    sentence_likeness, which needs sequence matching."""

    def of(x: Column) -> Column:
        # the lower-cased text, the loss and each count are bound, as inside a lambda every use of an expression computes it
        out = 1.0 - let(distinct_ngram_loss(tok(x), 4), lambda v: F.when(v > 0.3, F.least(F.lit(0.4), v)).otherwise(0.0))
        for ph in PHRASES:
            n = (F.length(x) - F.length(F.replace(x, F.lit(ph), F.lit("")))) / len(ph)
            out = out - let(n, lambda v: F.when(v > 3, F.least(F.lit(0.2), 0.05 * (v - 3))).otherwise(0.0))
        return out

    return F.when(F.length(strip(c)) < 20, 1.0).otherwise(let(F.lower(F.concat(thought(c), F.lit(" "), said(c))), of))


@register("parsed_code", tags=("code",))
def parsed_code(p, c, a, t):
    """0.5 without a code block, 0 for one that doesn't parse, 0.3 for one that does. Untrusted code is never run."""
    from ..functions.pyfuncs import parses

    named = F.regexp_extract_all(c, F.lit(r"(?s)```python\n(.*?)\n```"), F.lit(1))
    plain = F.regexp_extract_all(c, F.lit(r"(?s)```\n(.*?)\n```"), F.lit(1))
    blocks = F.when(F.size(named) > 0, named).otherwise(plain)
    return F.when(F.size(blocks) == 0, 0.5).when(parses(F.array(F.array_join(blocks, "\n"))), 0.3).otherwise(0.0)


@register("convergence", tags=("thinking",))
def convergence(p, c, a, t):
    """How early a line of the thinking is like the answer, with a bonus for a right one. The consistency term, which needs
    sequence matching, is 0 here."""
    lines = F.filter(F.transform(F.split(thought(c), "\n"), strip), lambda v: v != "")

    def of(s) -> Column:
        first = F.array_position(F.transform(s, lambda v: v > CONVERGED), True)
        right = yes(equal(said(c), a))
        total = 1.0 / first - F.when(first < 3, 0.3).otherwise(0.0) + (F.try_element_at(s, first.cast("int")) - s[0]) * 0.3 + right
        return F.when((F.size(s) < 2) | (first == 0), 0.3 * right).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / 2.75)))

    return let(F.transform(lines, lambda v: jaccard(word_set(v), word_set(a))), of)


def phase_aware(scorer: Callable, thinking_weight: float = 0.3, answer_weight: float = 0.7) -> Callable:
    """A scorer of the thinking and the answer apart; of the answer alone where nothing was thought."""

    def scored(p, c, a, t):
        alone = scorer(p, said(c), a, t)
        both = thinking_weight * scorer(p, F.concat(F.lit(THINK), thought(c), F.lit(UNTHINK)), a, t) + answer_weight * alone
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(thought(c) != "", both).otherwise(alone)))

    return scored


def weights_of(kind: Column) -> dict[str, Column]:
    """The weight of each score for a question type, adding up to 1."""
    out = {}
    for i, s in enumerate(SCORES):
        w = F.when(F.lit(False), 0.0)
        for k, v in TYPE_WEIGHTS.items():
            w = w.when(F.lower(kind) == k, v[i] / sum(v))
        out[s] = w.otherwise(DEFAULT_WEIGHTS[i] / sum(DEFAULT_WEIGHTS))
    return out
