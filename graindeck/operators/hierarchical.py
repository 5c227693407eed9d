"""Hierarchical scoring: foundation, correctness, quality and polish, each through a soft gate of the one before, less what looks
like gaming. Compression and sequence matching run in Arrow batches; all else is expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import sections as sec, structure as st, text as tx
from ..functions.text import let, strip, tok


@dataclass(frozen=True)
class Gate:
    threshold: float
    steepness: float
    floor: float
    weight: float


# Fixed values.
GATES = {"foundation": Gate(0.4, 8.0, 0.15, 0.10), "correctness": Gate(0.10, 6.0, 0.10, 0.45), "quality": Gate(0.08, 5.0, 0.08, 0.30), "polish": Gate(0.05, 4.0, 0.05, 0.15)}
UPSTREAM = {"foundation": None, "correctness": "foundation", "quality": "correctness", "polish": "quality"}
LEAST_SCORE, MOST_SCORE = 0.02, 0.95
FACTUAL, SEMANTIC, MATCH, KEYWORD = 0.35, 0.25, 0.20, 0.10
STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might must shall can need dare ought used "
    "to of in for on with at by from as into through this that these those it and but or if then else when where why how all each every both "
    "few more most other some such no not only own same so than too very just"
).split()
FLOW = (
    "therefore", "however", "furthermore", "moreover", "thus", "consequently", "additionally", "meanwhile", "nevertheless", "first", "second",
    "third", "finally", "next", "then", "because", "since", "although", "while", "whereas", "in conclusion", "for example", "in other words",
    "as a result",
)
PAST = ("was", "were", "had", "did", "went", "said", "made", "got")
PRESENT = ("is", "are", "has", "does", "goes", "says", "makes", "gets")
CONTRACTED = ("n't", "'re", "'ve", "'ll", "'m", "'d", "won't", "can't", "don't")
FORMAL = ("therefore", "consequently", "furthermore", "moreover", "hence", "thus")
ARTIFACTS = ("...", "???", "!!!", "(((", ")))", "[[[[", "]]]]")


def clipped(x: Column, low=0.0, high=1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def words(x: Column) -> Column:
    return F.size(tok(x))


def held(x: Column, parts) -> Column:
    """How many of the parts a text holds."""
    return sum((x.contains(p).cast("int") for p in parts), F.lit(0))


# ---- foundation
def structure_score(c: Column, least_thinking: int = 20, least_answer: int = 5) -> Column:
    """The mean of: tags, enough thinking, an answer, balanced tags."""
    tags = (c.contains("<think>").cast("int") + c.contains("</think>").cast("int")) / 2.0

    def of(p) -> Column:
        thinking = F.when(p.t >= least_thinking, 1.0).otherwise(p.t / least_thinking)
        answer = F.when(p.a >= least_answer, 1.0).when(p.a > 0, p.a / least_answer).when(p.t > 0, 0.3).otherwise(0.0)
        balance = F.when(p.u == 0, 1.0).otherwise(F.greatest(F.lit(0.3), 1.0 - p.u * 0.2))
        return (tags + thinking + answer + balance) / 4

    counts = F.struct(words(sec.thinking_section(c)).alias("t"), words(sec.answer_section(c)).alias("a"), sec.unmatched_tags(c).alias("u"))
    return F.when(c == "", 0.0).otherwise(let(counts, of))


def format_score(c: Column) -> Column:
    """Length, the share of spaces, and encoding, which a string always has."""
    spaces = (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))) / F.length(c)
    length = let(words(c), lambda n: F.when(n < 10, n / 10).when(n <= 500, 1.0).otherwise(F.greatest(F.lit(0.5), 1.0 - (n - 500) / 500 * 0.3)))
    return F.when(c == "", 0.0).otherwise((length + F.when(spaces > 0.5, 0.5).otherwise(1.0) + 1.0) / 3)


def completeness_score(c: Column) -> Column:
    sure = lambda x: sec.completeness(x)["confidence"]

    def of(p) -> Column:
        return F.when(p.a != "", 0.3 * F.when(p.t != "", sure(p.t)).otherwise(0.5) + 0.7 * sure(p.a)).otherwise(0.5 * sure(c))

    return F.when(c == "", 0.0).otherwise(let(F.struct(sec.thinking_section(c).alias("t"), sec.answer_section(c).alias("a")), of))


def foundation(c: Column) -> Column:
    total = 0.50 * structure_score(c) + 0.15 * format_score(c) + 0.35 * completeness_score(c)
    return F.when(F.length(strip(c)) > 20, F.greatest(F.lit(0.1), total)).otherwise(total)


# ---- correctness
def numerical_match(answer: Column, want: Column, tolerance: float = 0.02) -> Column:
    """The best band of the relative errors of all pairs of numbers."""

    def band(e: Column) -> Column:
        return F.when(e == 0, 1.0).when(e <= tolerance, 0.95).when(e <= tolerance * 2, 0.80).when(e <= tolerance * 5, 0.50).otherwise(F.greatest(F.lit(0.0), 1 - e))

    def of(p) -> Column:
        error = lambda g, w: F.when(w == 0, F.when(g == 0, 0.0).otherwise(1.0)).otherwise(F.abs(g - w) / F.abs(w))
        best = F.array_max(F.transform(p.w, lambda w: F.array_max(F.transform(p.g, lambda g: let(error(g, w), band)))))
        return F.coalesce(best, F.lit(0.0))

    return let(F.struct(sec.extracted_numbers(answer).alias("g"), sec.extracted_numbers(want).alias("w")), of)


def exact_match(answer: Column, want: Column) -> Column:
    """Equal 1, containing 0.9, contained 0.7 of the ratio, without punctuation and case."""

    def of(p) -> Column:
        return F.when(p.g == p.w, 1.0).when(F.contains(p.g, p.w), 0.9).when(F.contains(p.w, p.g), 0.7 * F.length(p.g) / F.greatest(F.lit(1), F.length(p.w))).otherwise(0.0)

    return let(F.struct(sec.normalized(answer, False).alias("g"), sec.normalized(want, False).alias("w")), of)


def word_jaccard(a: Column, b: Column) -> Column:
    x, y = sec.normalized(a), sec.normalized(b)
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(tx.jaccard(F.array_distinct(F.split(x, " ")), F.array_distinct(F.split(y, " "))))


def keyword_coverage(c: Column, want: Column) -> Column:
    """The share of the wanted words of over 3 letters, but for stop words, that a completion holds as parts; 0.5 without one."""

    def of(p) -> Column:
        return F.when(F.size(p.k) == 0, 0.5).otherwise(F.size(F.filter(p.k, lambda w: F.contains(p.c, w))) / F.size(p.k))

    keys = F.filter(F.split(sec.normalized(want), " "), lambda w: (F.length(w) > 3) & ~w.isin(*STOPWORDS))
    return F.when((c == "") | (want == ""), 0.0).otherwise(let(F.struct(sec.normalized(c).alias("c"), keys.alias("k")), of))


# ---- quality
def thinking_or_all(c: Column) -> Column:
    th = sec.thinking_section(c)
    return F.when(th != "", th).otherwise(c)


def cognitive(steps: Column, depth: Column, linear: Column, cyclomatic: Column, difficulty: Column) -> Column:
    one = lambda x: F.least(F.lit(1.0), x)
    return 0.3 * one(steps / 10) + 0.2 * one(depth / 5) + 0.2 * one(cyclomatic / 10) + 0.15 * one(difficulty / 100) + 0.15 * (1 - linear)


def reasoning_quality(c: Column) -> Column:
    def measured(x: Column) -> Column:
        m = st.structure(x)
        return F.struct(m["steps"].alias("s"), m["depth"].alias("d"), m["branches"].alias("b"), m["conclusion"].alias("c"), m["premises"].alias("p"), st.cyclomatic(x).alias("y"), st.halstead(x)["difficulty"].alias("h"))

    def of(m) -> Column:
        linear = F.when(m.s + m.b > 0, m.s / (m.s + m.b)).otherwise(1.0)  # as in structure, from steps and branches that are there
        steps = F.when(m.s == 0, 0.0).when(m.s < 2, 0.3 * m.s).when(m.s <= 7, 0.5 + 0.5 * F.least(F.lit(1.0), m.s / 5)).otherwise(F.greatest(F.lit(0.5), 1.0 - (m.s - 7) * 0.05))
        depth = F.when(m.d == 0, 0.0).when(m.d <= 3, 0.4 + 0.2 * m.d).otherwise(F.greatest(F.lit(0.7), 1.0 - (m.d - 3) * 0.1))
        forks = F.when(m.b == 0, 0.5).when(m.b <= 3, 0.6 + 0.15 * m.b).otherwise(F.greatest(F.lit(0.7), 1.0 - (m.b - 3) * 0.05))
        return 0.25 * steps + 0.20 * depth + 0.15 * forks + 0.15 * F.when(m.c, 1.0).otherwise(0.4) + 0.10 * F.when(m.p, 1.0).otherwise(0.5) + 0.15 * cognitive(m.s, m.d, linear, m.y, m.h)

    return F.when(c == "", 0.0).otherwise(let(let(thinking_or_all(c), measured), of))


def efficiency(c: Column, want: Column) -> Column:
    """Thinking words against a target by the wanted answer's length, information density and redundancy."""
    info = lambda x: let(tok(x), lambda w: let(st.entropy_of(w), lambda h: F.struct(F.when(F.size(F.array_distinct(w)) <= 1, 0.0).otherwise(h / F.log2(F.size(F.array_distinct(w)).cast("double"))).alias("d"), F.when(F.size(w) <= 1, 1.0).otherwise(h / F.log2(F.size(w).cast("double"))).alias("n"))))

    def of(p) -> Column:
        target = F.least(F.lit(200), F.greatest(F.lit(50), p.e * 10))
        length = (
            F.when(p.t == 0, 0.2)
            .when(p.t < target * 0.5, 0.3 + 0.4 * (p.t / target))
            .when(p.t <= target * 1.5, 0.8 + 0.2 * (1 - F.abs(p.t - target) / target))
            .otherwise(F.greatest(F.lit(0.3), 0.8 - (p.t - target * 1.5) / target * 0.2))
        )
        density = F.when(p.i.d < 0.3, p.i.d / 0.3 * 0.5).when(p.i.d <= 0.8, 0.5 + 0.5 * (p.i.d - 0.3) / 0.5).otherwise(F.greatest(F.lit(0.7), 1.0 - (p.i.d - 0.8) * 0.5))
        return 0.35 * length + 0.35 * density + 0.30 * F.greatest(F.lit(0.0), p.i.n)

    expected = F.when(want != "", words(want)).otherwise(10)
    return F.when(c == "", 0.0).otherwise(let(F.struct(words(sec.thinking_section(c)).alias("t"), expected.alias("e"), info(thinking_or_all(c)).alias("i")), of))


def depth_score(c: Column) -> Column:
    def of(p) -> Column:
        cyc = F.when(p.y < 2, p.y / 2).when(p.y <= 6, 0.7 + 0.3 * F.least(F.lit(1.0), (p.y - 2) / 4)).otherwise(F.greatest(F.lit(0.5), 1.0 - (p.y - 6) * 0.1))
        deep = F.when(p.d < 2, p.d / 2 * 0.5).when(p.d <= 4, 0.5 + 0.5 * (p.d - 1) / 3).otherwise(F.greatest(F.lit(0.6), 1.0 - (p.d - 4) * 0.1))
        return 0.35 * cyc + 0.35 * deep + 0.30 * p.k

    return F.when(c == "", 0.0).otherwise(let(let(thinking_or_all(c), lambda x: F.struct(st.cyclomatic(x).alias("y"), st.depth(x).alias("d"), st.detail(x).alias("k"))), of))


# ---- polish
def untagged(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"(?U)\s+", " "))


def tidy_score(c: Column) -> Column:
    """The mean of: tags that open as often as they close, closing after opening, even indents, no trailing white space."""
    opened, closed = (F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in (r"(?U)<(\w+)>", r"(?U)</(\w+)>"))
    names = F.array_union(opened, closed)
    of = lambda tags, n: F.size(F.filter(tags, lambda t: t == n))
    even = F.size(F.filter(names, lambda n: of(opened, n) == of(closed, n)))
    early = F.size(F.filter(F.array_intersect(opened, closed), lambda n: F.instr(c, F.concat(F.lit("</"), n, F.lit(">"))) < F.instr(c, F.concat(F.lit("<"), n, F.lit(">")))))
    balance = F.when(F.size(names) > 0, even / F.size(names)).otherwise(1.0)
    lines = F.split(c, "\n")
    full = F.filter(lines, lambda v: strip(v) != "")
    indented = F.size(F.filter(full, lambda v: (F.length(v) - F.length(F.regexp_replace(v, r"^\s+", ""))) % 2 == 0))
    trailing = F.size(F.filter(lines, lambda v: v.rlike(r"(?U)\s$")))
    return (balance + F.greatest(F.lit(0.0), 1.0 - 0.2 * early) + F.when(F.size(full) > 0, indented / F.size(full)).otherwise(0.5) + (1.0 - trailing / F.size(lines))) / 4


def readability(c: Column) -> Column:
    def of(p) -> Column:
        n = F.size(p.l)
        mean = F.aggregate(p.l, F.lit(0.0), lambda s, v: s + v) / n
        return F.when(F.length(p.x) < 20, 0.5).otherwise(let(F.struct(p.x.alias("x"), p.l.alias("l"), mean.alias("m")), spread_of))

    def spread_of(p) -> Column:
        d = F.sqrt(F.aggregate(p.l, F.lit(0.0), lambda s, v: s + (v - p.m) * (v - p.m)) / F.size(p.l))
        return let(F.struct(p.x.alias("x"), p.l.alias("l"), p.m.alias("m"), d.alias("d")), scored)

    def scored(p) -> Column:
        length = F.when(p.m.between(10, 20), 1.0).when(p.m < 10, p.m / 10).otherwise(F.greatest(F.lit(0.3), 1.0 - (p.m - 20) / 30))
        spread = F.when(F.size(p.l) < 2, 0.7).when(p.d.between(5, 10), 1.0).when(p.d < 5, p.d / 5).otherwise(F.greatest(F.lit(0.3), 1.0 - (p.d - 10) / 15))
        n = F.size(F.split(p.x, " "))
        letters = F.length(F.replace(p.x, F.lit(" "), F.lit(""))) / n
        size = F.when(letters.between(4, 7), 1.0).when(letters < 4, letters / 4).otherwise(F.greatest(F.lit(0.4), 1.0 - (letters - 7) / 5))
        flow = 0.5 + 0.5 * F.least(F.lit(1.0), held(F.lower(p.x), FLOW) / (n / 50))
        none = F.size(p.l) == 0
        return 0.35 * F.when(none, 0.5).otherwise(length) + 0.25 * F.when(none, 0.5).otherwise(spread) + 0.20 * size + 0.20 * flow

    return let(untagged(c), lambda x: let(F.struct(x.alias("x"), F.transform(st.full_sentences(x), words).alias("l")), of))


def length_efficiency(c: Column, budget: int = 450) -> Column:
    def of(p) -> Column:
        use = F.when(p.u.between(0.5, 0.9), 1.0).when(p.u < 0.5, p.u / 0.5).otherwise(F.greatest(F.lit(0.7), 1.0 - (p.u - 0.9) * 2))
        ratio = p.t / p.a
        balance = F.when((p.t > 0) & (p.a > 0), F.when(ratio.between(2, 6), 1.0).when(ratio < 2, ratio / 2).otherwise(F.greatest(F.lit(0.6), 1.0 - (ratio - 6) / 10))).when(p.a > 0, 0.5).otherwise(0.3)
        dense = F.when(F.length(c) <= 50, 0.5).when(p.h.between(3.5, 5.5), 1.0).when(p.h < 3.5, p.h / 3.5).otherwise(0.9)
        return 0.40 * use + 0.35 * balance + 0.25 * dense

    tokens = tx.token_estimate
    return let(F.struct((tokens(c) / budget).alias("u"), tokens(sec.thinking_section(c)).alias("t"), tokens(sec.answer_section(c)).alias("a"), st.char_entropy(c).alias("h")), of)


def consistency(c: Column) -> Column:
    def of(x: Column) -> Column:
        low = F.lower(x)
        w = F.split(low, " ")
        among = lambda names: F.size(F.filter(w, lambda v: v.isin(*names)))
        past, now = among(PAST), among(PRESENT)
        tense = F.when(past + now > 0, F.greatest(past, now) / (past + now)).otherwise(0.7)
        times = lambda part: (F.length(low) - F.length(F.replace(low, F.lit(part), F.lit("")))) / len(part)
        informal = held(low, CONTRACTED) + times(" i ") + times("i ") + times(" my ")
        formal = held(low, FORMAL)
        manner = F.when(informal + formal > 0, 0.5 + 0.5 * F.greatest(informal, formal) / (informal + formal + 1)).otherwise(0.7)
        mixed = c.rlike(r"\$[^$]+\$") & c.rlike(r"[0-9]+\s*[+\-*/=]\s*[0-9]+")
        enough = F.size(F.filter(st.full_sentences(x), lambda s: words(s) > 2)) >= 2
        return F.when((F.length(x) < 50) | ~enough, 0.7).otherwise(0.35 * tense + 0.35 * manner + 0.30 * F.when(mixed, 0.6).otherwise(1.0))

    return let(untagged(c), of)


def presentation(c: Column) -> Column:
    """The mean of: lines of at most 200 characters, spacing, no artifacts, an answer that ends."""
    lines = F.split(c, "\n")
    short = 1.0 - F.size(F.filter(lines, lambda v: F.length(v) > 200)) / F.size(lines)
    share = (F.size(lines) - 1) / F.length(c)
    spacing = F.when(c == "", 0.5).when(share.between(0.01, 0.05), 1.0).when(share < 0.01, 0.7).otherwise(F.greatest(F.lit(0.5), 1.0 - (share - 0.05) * 5))
    clean = F.greatest(F.lit(0.5), 1.0 - held(c, ARTIFACTS) * 0.15)
    ends = let(sec.answer_section(c), lambda a: F.when(a == "", 0.4).when(a.rlike(r"[.!?)0-9]$"), 1.0).otherwise(0.7))
    return (short + spacing + clean + ends) / 4


def polish(c: Column) -> Column:
    return 0.20 * tidy_score(c) + 0.20 * readability(c) + 0.25 * length_efficiency(c) + 0.15 * consistency(c) + 0.20 * presentation(c)


# ---- gates and the whole
def gate_value(score: Column, gate: Gate) -> Column:
    return gate.floor + (1.0 - gate.floor) / (1.0 + F.exp(-gate.steepness * (score - gate.threshold)))


def gated(levels: dict[str, Column]) -> tuple[dict[str, Column], Column]:
    """Each level's gated score (its own gate times that of the level before it), and their weighted mean."""
    gates = {k: gate_value(levels[k], g) for k, g in GATES.items()}
    out = {k: levels[k] * gates[k] * (gates[UPSTREAM[k]] if UPSTREAM[k] else 1.0) for k in GATES}
    return out, sum((GATES[k].weight * v for k, v in out.items()), F.lit(0.0)) / sum(g.weight for g in GATES.values())


def final_score(before: Column, penalty: Column) -> Column:
    """Less the penalty, at least the least score, then put into the range from least to most."""
    return LEAST_SCORE + (MOST_SCORE - LEAST_SCORE) * F.greatest(F.lit(LEAST_SCORE), before * (1.0 - penalty))


def grade(score: Column) -> Column:
    return F.when(score >= 0.9, "A").when(score >= 0.8, "B").when(score >= 0.7, "C").when(score >= 0.6, "D").otherwise("F")


def hierarchical(df: DataFrame, completion: str = "completion", answer: str = "answer") -> DataFrame:
    """df with foundation, correctness, quality, polish, penalty, hierarchical and grade."""
    from ..functions.pyfuncs import compression_ratio, fuzzy_match, similarity_by_compression

    c, a = F.coalesce(F.col(completion), F.lit("")), F.coalesce(F.col(answer), F.lit(""))
    keep = df.columns
    x = df.withColumns({"_c": c, "_a": a})
    x = x.withColumns({"_final": sec.final_answer(F.col("_c")), "_section": sec.answer_section(F.col("_c")), "_text": thinking_or_all(F.col("_c"))})
    x = x.withColumn("_said", F.when(F.col("_section") != "", sec.answer_content(F.col("_section"))).otherwise(""))
    # each Arrow function's result is a column before any expression uses it
    x = x.withColumns({"_fuzzy": fuzzy_match("_final", "_a"), "_near": fuzzy_match("_said", "_a"), "_packed": similarity_by_compression("_final", "_a"), "_ratio": compression_ratio("_c"), "_text_ratio": compression_ratio("_text")})
    c, a, f = F.col("_c"), F.col("_a"), F.col("_final")
    semantic = F.when((f == "") | (a == ""), 0.0).otherwise(0.30 * F.col("_fuzzy") + 0.25 * word_jaccard(f, a) + 0.45 * F.col("_packed"))
    x = x.withColumns({"_number": numerical_match(f, a), "_exact": exact_match(f, a), "_semantic": semantic, "_keyword": keyword_coverage(c, a)})
    number, exact, semantic = F.col("_number"), F.col("_exact"), F.col("_semantic")
    blend = (FACTUAL * number + MATCH * exact + SEMANTIC * semantic) / (FACTUAL + MATCH + SEMANTIC)
    factual = 0.6 * F.greatest(number, exact, semantic) + 0.4 * blend
    near = F.col("_near")
    said = F.when(F.col("_said") == "", 0.0).when(F.contains(sec.normalized(F.col("_said")), sec.normalized(a)), 1.0).when(near > 0.9, 0.95).when(near > 0.7, near).otherwise(near * 0.8)
    correctness = (FACTUAL * factual + SEMANTIC * semantic + MATCH * said + KEYWORD * F.col("_keyword")) / (FACTUAL + SEMANTIC + MATCH + KEYWORD)
    text = F.col("_text")
    info = st.information(text)
    complexity = F.when(F.length(text) < 10, 0.5).otherwise(F.least(F.lit(1.0), F.col("_text_ratio") / 0.8))
    content = 0.30 * F.least(F.lit(1.0), info["density"]) + 0.25 * complexity + 0.20 * info["normalized"] + 0.15 * F.least(F.lit(1.0), F.col("_text_ratio")) + 0.10 * F.least(F.lit(1.0), st.gain_per_token(text) / 5.0)
    coherence = F.when(c == "", 0.0).otherwise(0.35 * st.references(text)["coherence"] + 0.35 * content + 0.30 * st.transitions(text))
    quality = (0.25 * reasoning_quality(c) + 0.15 * efficiency(c, a) + 0.20 * coherence + 0.15 * depth_score(c)) / 0.75
    x = x.withColumns({"_l_foundation": foundation(c), "_l_correctness": correctness, "_l_quality": quality, "_l_polish": polish(c)})
    levels = {k: F.col(f"_l_{k}") for k in GATES}
    repeated, entropy, unique = let(tok(c), lambda w: tx.ngram_repetition(w, 3)), st.char_entropy(c), let(tok(c), tx.unique_ratio)
    clones = F.least(F.lit(10), F.size(st.clones(c, 30)))
    penalty = (
        F.when(repeated > 0.3, F.least(F.lit(0.3), (repeated - 0.3) * 0.5)).otherwise(0.0)
        + F.least(F.lit(0.25), clones * 0.05)
        + F.when(entropy < 3.0, F.least(F.lit(0.2), (3.0 - entropy) * 0.1)).otherwise(0.0)
        + F.when(F.col("_ratio") < 0.3, F.least(F.lit(0.2), (0.3 - F.col("_ratio")) * 0.5)).otherwise(0.0)
        + F.when(unique < 0.3, F.least(F.lit(0.15), (0.3 - unique) * 0.3)).otherwise(0.0)
        + F.when((levels["quality"] > 0.8) & (levels["foundation"] < 0.4), 0.1).otherwise(0.0)
    )
    x = x.withColumn("penalty", F.when(c == "", 0.0).otherwise(F.least(F.lit(0.5), penalty)))
    _, before = gated(levels)
    x = x.withColumn("hierarchical", final_score(before, F.col("penalty")))
    return x.select(*(k for k in keep if k not in (*GATES, "penalty", "hierarchical", "grade")), *(levels[k].alias(k) for k in GATES), "penalty", "hierarchical", grade(F.col("hierarchical")).alias("grade"))
