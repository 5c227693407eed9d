"""Column builders for the structure of reasoning and for information measures. All stay in the JVM, and read each text once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .text import let, ngrams, over_runs, strip, tok

# The patterns and word lists that the measures are defined by.
STEP_MARKS = (r"\b(?:step\s+)?(\d+)[.):]\s", r"\b(first|second|third|fourth|fifth|finally|lastly)\b")
BULLET = r"^([-*•]\s)"
CONNECTORS = (
    r"\b(therefore|thus|hence|so|consequently)\b",
    r"\b(because|since|as|given that)\b",
    r"\b(if|when|assuming)\b.*\bthen\b",
    r"\b(first|next|then|finally|in conclusion)\b",
    r"\b(however|but|although|despite)\b",
    r"\b(this means|this implies|it follows)\b",
)
CONCLUSIONS = (r"\b(therefore|thus|hence|in conclusion|finally)\b", r"\b(the answer is|the result is|we get)\b", r"\\boxed\{")
PREMISES = (r"\b(given|assuming|let|suppose|we know)\b", r"\b(the problem states|according to)\b")
DECISIONS = ((r"\b(if|when|assuming|suppose)\b", 1.0), (r"\b(else|otherwise|alternatively)\b", 1.0), (r"\b(case\s+\d|scenario\s+\d)\b", 1.0), (r"\b(either|or)\b", 1.0), (r"\b(however|but|although)\b", 0.5), (r"\b(first|second|third)\b.*\b(first|second|third)\b", 0.5))
DEEPER = (r"\b(for this|to do this|to find this)\b", r"\b(first we need to|let's start by)\b", r"\b(breaking this down|let me analyze)\b", r"\b(within this|inside this)\b")
BACK_UP = (r"\b(returning to|going back to)\b", r"\b(so overall|putting it together)\b", r"\b(in summary|to summarize)\b")
BRANCHES = (r"\b(if.*then|when.*then)\b", r"\b(case\s+\d+|scenario\s+\d+)\b", r"\b(alternatively|on the other hand)\b", r"\b(option\s+[a-z\d])\b", r"\b(either.*or)\b")
BACKWARD = (r"\b(this|that|these|those|it)\b", r"\b(above|previous|earlier|before)\b", r"\b(as mentioned|as stated|as shown)\b")
FORWARD = (r"\b(below|following|next|later)\b", r"\b(we will|let's|let us)\b")
TRANSITIONS = (
    r"\b(therefore|thus|hence|so|consequently)\b",
    r"\b(first|second|third|next|then|finally)\b",
    r"\b(because|since|as|given)\b",
    r"\b(however|but|although|despite)\b",
    r"\b(additionally|furthermore|moreover|also)\b",
    r"\b(this|that|these|those)\s+(means?|implies?|shows?|suggests?)\b",
    r"\b(in other words|that is|namely)\b",
)
DETAILS = ((r"\b(because|since|as)\b.*\b(this|that|it)\b", 1.0), (r"\b(for example|e\.g\.|such as)\b", 0.8), (r"\b(means that|implies that|indicates)\b", 0.8), (r"\b(let me|I will|we can|we need to)\b", 0.6), (r"\b(specifically|in particular|notably)\b", 0.7), (r"\b\d+[.,:]\d+\b", 0.5))
FUNCTION_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might must shall can need dare ought used "
    "to of in for on with at by from as into through during before after above below between under again further then once here there when "
    "where why how all each every both few more most other some such no nor not only own same so than too very just and but if or because "
    "until while although this that these those it its he she they we you i me him her them us my your his their our which who whom what whose"
).split()
U, UM = "(?iU)", "(?imU)"


def hits(x: Column, patterns, flags: str = U) -> Column:
    """How often the patterns match, in all."""
    return sum((F.regexp_count(x, F.lit(flags + p)) for p in patterns), F.lit(0))


def any_of(x: Column, patterns, flags: str = U) -> Column:
    return reduce(lambda e, p: e | x.rlike(flags + p), patterns, F.lit(False))


def sentences(x: Column) -> Column:
    return F.split(x, "[.!?]+")


def full_sentences(x: Column) -> Column:
    return F.filter(F.transform(sentences(x), strip), lambda s: s != "")


def step_count(x: Column) -> Column:
    """Distinct step marks and connectors as they stand, or paragraphs if there are more; 20 at most."""
    marks = [F.regexp_extract_all(x, F.lit(UM + p), F.lit(1)) for p in (*STEP_MARKS, BULLET)] + [F.regexp_extract_all(x, F.lit(U + p), F.lit(1)) for p in CONNECTORS]
    paragraphs = F.size(F.filter(F.split(x, "\n\n"), lambda p: strip(p) != ""))
    return F.when(x == "", 0).otherwise(F.least(F.lit(20), F.greatest(F.size(F.array_distinct(F.concat(*marks))), paragraphs, F.lit(1))))


def depth(x: Column) -> Column:
    """The deepest level: a sentence that opens a sub-problem goes down one, one that closes it up, never above the first."""
    start = F.struct(F.lit(1).alias("now"), F.lit(1).alias("most"))

    def step(a, s):
        down = F.when(any_of(s, DEEPER), a.now + 1).otherwise(a.now)
        return let(down, lambda d: F.struct(F.when(any_of(s, BACK_UP), F.greatest(F.lit(1), d - 1)).otherwise(d).alias("now"), F.greatest(a.most, d).alias("most")))

    return F.when(x == "", 0).otherwise(F.aggregate(sentences(x), start, step, lambda a: a.most))


def branches(x: Column) -> Column:
    return hits(x, BRANCHES)


def cyclomatic(x: Column) -> Column:
    """One and the weighted decision points, cut to an integer."""
    return F.greatest(F.lit(1), (1 + sum((w * F.regexp_count(x, F.lit(U + p)) for p, w in DECISIONS), F.lit(0.0))).cast("int"))


def structure(x: Column) -> dict[str, Column]:
    steps, forks = step_count(x), branches(x)
    return {
        "steps": steps,
        "depth": depth(x),
        "branches": forks,
        "linear_ratio": F.when(steps + forks > 0, steps / (steps + forks)).otherwise(1.0),
        "conclusion": any_of(x, CONCLUSIONS[:2], U) | x.rlike(CONCLUSIONS[2]),
        "premises": any_of(x, PREMISES),
    }


def references(x: Column) -> dict[str, Column]:
    """Sentences that refer back and forward, and the share of those that refer back, doubled; 1 for a single sentence."""
    s = full_sentences(x)

    def of(s: Column) -> Column:
        back = F.size(F.filter(s, lambda v: any_of(v, BACKWARD)))
        forward = F.size(F.filter(s, lambda v: any_of(v, FORWARD)))
        alone = F.size(s) < 2
        return F.struct(F.when(alone, 0).otherwise(back).alias("back"), F.when(alone, 0).otherwise(forward).alias("forward"), F.when(alone, 1.0).otherwise(F.least(F.lit(1.0), 2 * back / F.size(s))).alias("coherence"))

    out = let(s, of)
    return {"back": out["back"], "forward": out["forward"], "coherence": F.when(x == "", 0.0).otherwise(out["coherence"])}


def transitions(x: Column) -> Column:
    """By the share of sentences after the first that have a transition."""

    def of(s: Column) -> Column:
        share = F.size(F.filter(F.slice(s, F.lit(2), F.greatest(F.size(s), F.lit(1))), lambda v: any_of(v, TRANSITIONS))) / (F.size(s) - 1)
        return F.when(F.size(s) < 2, 0.5).otherwise(let(share, lambda d: F.when(d < 0.2, 0.3 + d * 1.5).when(d <= 0.8, 0.6 + 0.4 * (d - 0.2) / 0.6).otherwise(F.greatest(F.lit(0.7), 1.0 - (d - 0.8)))))

    return F.when(x == "", 0.0).otherwise(let(full_sentences(x), of))


def detail(x: Column) -> Column:
    score = sum((w * F.least(F.lit(3), F.regexp_count(x, F.lit(U + p))) / 3 for p, w in DETAILS), F.lit(0.0))
    return F.when(x == "", 0.0).otherwise(score / sum(w for _, w in DETAILS))


def halstead(x: Column) -> dict[str, Column]:
    """Function words as operators, the others as operands."""
    words = tok(x)

    def of(w: Column) -> Column:
        return let(F.struct(F.filter(w, lambda v: v.isin(*FUNCTION_WORDS)).alias("a"), F.filter(w, lambda v: ~v.isin(*FUNCTION_WORDS)).alias("b")), measures)

    def measures(s) -> Column:
        n1, n2 = F.size(F.array_distinct(s.a)), F.size(F.array_distinct(s.b))
        total = F.size(s.a) + F.size(s.b)
        volume = F.when(n1 + n2 > 1, total * F.log2(n1 + n2)).otherwise(0.0)
        difficulty = F.when((n1 + n2 > 1) & (n2 > 0), n1 / 2 * F.size(s.b) / n2).otherwise(0.0)
        return F.struct((n1 + n2).alias("vocabulary"), total.alias("length"), volume.alias("volume"), difficulty.alias("difficulty"))

    out = let(words, of)
    return {k: out[k] for k in ("vocabulary", "length", "volume", "difficulty")} | {"effort": out["volume"] * out["difficulty"]}


def clones(x: Column, least: int = 20) -> Column:
    """Repeated segments between sentence ends and line ends, lower-cased with single spaces, of so many characters as they
    stood: an array of (segment, n), those that waste most first. Segments are sorted and folded, so only clones are kept."""
    segments = F.filter(F.transform(F.split(x, "[.!?\n]+"), strip), lambda s: F.length(s) >= least)
    plain = F.sort_array(F.transform(segments, lambda s: F.regexp_replace(F.lower(s), r"(?U)\s+", " ")))
    none = F.expr("cast(array() as array<struct<w:int,segment:string,n:int>>)")
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("n"), none.alias("out"))

    def closed(a) -> Column:
        return F.when(a.n > 1, F.concat(a.out, F.array(F.struct((-F.length(a.last) * (a.n - 1)).alias("w"), a.last.alias("segment"), a.n.alias("n"))))).otherwise(a.out)

    def step(a, s):
        same = a.last.eqNullSafe(s)
        return F.struct(s.alias("last"), F.when(same, a.n + 1).otherwise(1).alias("n"), F.when(same, a.out).otherwise(closed(a)).alias("out"))

    found = F.transform(F.array_sort(F.aggregate(plain, start, step, closed)), lambda c: F.struct(c["segment"], c["n"]))
    return F.when(F.length(x) < 2 * least, F.expr("cast(array() as array<struct<segment:string,n:int>>)")).otherwise(found)


def clone_ratio(x: Column, most: int = 10) -> Column:
    """The characters of the ten largest clones after their first occurrence, over all; at most 1."""
    wasted = F.aggregate(F.slice(clones(x), F.lit(1), F.lit(most)), F.lit(0), lambda s, c: s + F.length(c["segment"]) * (c["n"] - 1))
    return F.when(x == "", 0.0).otherwise(F.least(F.lit(1.0), wasted / F.length(x)))


def phrase_repetition(x: Column, least: int = 4, most: int = 10) -> Column:
    """Words of repeated phrases of 4 to 10 words (shorter than half the text) after their first occurrence, over all words."""

    def of(w: Column) -> Column:
        n = F.size(w)
        total = F.lit(0)
        for k in range(least, most + 1):
            total = total + F.when(F.lit(k) < F.floor(n / 2), k * let(ngrams(w, k), lambda g: F.size(g) - F.size(F.array_distinct(g)))).otherwise(0)
        return F.when(n < 2 * least, 0.0).otherwise(F.least(F.lit(1.0), total / n))

    return let(tok(x), of)


# ---- information
def entropy_of(items: Column) -> Column:
    """Shannon entropy in bits of an array's items: sorted, then folded run by run."""
    n = F.size(items)
    return F.when(n == 0, 0.0).otherwise(F.log2(n.cast("double")) - over_runs(items, lambda k: k * F.log2(k.cast("double"))) / n)


def characters(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda v: v != "")


def char_entropy(x: Column, few: int = 128) -> Column:
    """entropy_of the characters. Few distinct ones are counted one by one, by what a text loses without them; more are sorted."""

    def of(p) -> Column:
        count = lambda v: (F.length(p.x) - F.length(F.replace(p.x, v, F.lit("")))).cast("double")
        total = F.aggregate(p.d, F.lit(0.0), lambda s, v: s + let(count(v), lambda k: k * F.log2(k)))
        counted = F.log2(F.length(p.x).cast("double")) - total / F.length(p.x)
        return F.when(p.x == "", 0.0).when(F.size(p.d) <= few, counted).otherwise(entropy_of(characters(p.x)))

    return let(F.struct(x.alias("x"), F.sort_array(F.array_distinct(F.split(x, ""))).alias("d")), of)


def information(x: Column) -> dict[str, Column]:
    """Entropies by characters and words, normalised by the number of words, by the vocabulary, and redundancy."""

    def of(w: Column) -> Column:
        n, vocabulary = F.size(w), F.size(F.array_distinct(w))

        def measures(h: Column) -> Column:
            normal = F.when(n <= 1, 1.0).otherwise(h / F.log2(n.cast("double")))
            dense = F.when(vocabulary <= 1, 0.0).otherwise(h / F.log2(vocabulary.cast("double")))
            return F.struct(h.alias("word_entropy"), normal.alias("normalized"), dense.alias("density"), F.when(x == "", 0.0).otherwise(1.0 - normal).alias("redundancy"), F.when(n <= 1, 0.0).otherwise(F.log2(n.cast("double"))).alias("max_entropy"))

        return let(entropy_of(w), measures)

    out = let(tok(x), of)
    return {"char_entropy": char_entropy(x)} | {k: out[k] for k in ("word_entropy", "max_entropy", "normalized", "density", "redundancy")}


def gain_per_token(x: Column) -> Column:
    """The mean surprise of each word after the first, given the words before it."""

    def of(w: Column) -> Column:
        # of a word's occurrences at positions i, the k-th has been seen k times before
        placed = F.sort_array(F.transform(w, lambda v, i: F.struct(v.alias("w"), i.alias("i"))))
        start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("seen"), F.lit(0.0).alias("total"))

        def step(a, p):
            seen = F.when(a.last.eqNullSafe(p["w"]), a.seen).otherwise(0)
            i = p["i"].cast("double")
            bits = F.when(i == 0, 0.0).when(seen == 0, F.log2(i + 1)).otherwise(F.log2(i / seen))
            return F.struct(p["w"].alias("last"), (seen + 1).alias("seen"), (a.total + bits).alias("total"))

        return F.when(F.size(w) < 2, 0.0).otherwise(F.aggregate(placed, start, step, lambda a: a.total) / (F.size(w) - 1))

    return let(tok(x), of)


def paired(a: Column, b: Column, value, shared_only: bool) -> Column:
    """The sum of value(count in a, count in b) over the distinct words of either array, and their number; with shared_only
    over words of both. The words are sorted and folded run by run."""
    tagged = F.array_sort(F.concat(F.transform(a, lambda w: F.struct(w.alias("w"), F.lit(0).alias("t"))), F.transform(b, lambda w: F.struct(w.alias("w"), F.lit(1).alias("t")))))
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("na"), F.lit(0).alias("nb"), F.lit(0.0).alias("s"), F.lit(0).alias("k"))
    counts = lambda p: (F.greatest(p.na, F.lit(0)), F.greatest(p.nb, F.lit(0)))

    def closed(p) -> Column:
        na, nb = counts(p)
        counted = ((na > 0) & (nb > 0)) if shared_only else (na + nb > 0)
        return F.struct((p.s + F.when(counted, value(na, nb)).otherwise(0.0)).alias("s"), (p.k + counted.cast("int")).alias("k"))

    def step(p, x):
        def moved(c) -> Column:
            same = p.last.eqNullSafe(x["w"])
            up = lambda n, t: F.when(same, n).otherwise(0) + (x["t"] == t).cast("int")
            return F.struct(x["w"].alias("last"), up(p.na, 0).alias("na"), up(p.nb, 1).alias("nb"), F.when(same, p.s).otherwise(c.s).alias("s"), F.when(same, p.k).otherwise(c.k).alias("k"))

        return let(closed(p), moved)

    return F.aggregate(tagged, start, step, closed)


def cross_entropy(x: Column, reference: Column, alpha: float = 0.1) -> Column:
    """Bits a word of x under the smoothed word counts of the reference; infinite if either has none."""

    def of(p) -> Column:
        size = F.size(F.array_union(p.w, p.r))
        total = paired(p.w, p.r, lambda n, m: -n * F.log2((m + alpha) / (F.size(p.r) + alpha * size)), False)
        return F.when((F.size(p.w) == 0) | (F.size(p.r) == 0), float("inf")).otherwise(total["s"] / F.size(p.w))

    return let(F.struct(tok(x).alias("w"), tok(reference).alias("r")), of)


def mean_pmi(a: Column, b: Column) -> Column:
    """The mean over shared words of log2(1 / vocabularies / (p q)), p and q their shares of either text; 0 without one."""

    def of(p) -> Column:
        total = F.size(F.array_distinct(p.a)) + F.size(F.array_distinct(p.b))
        out = paired(p.a, p.b, lambda n, m: F.log2(1 / total / (n / F.size(p.a) * m / F.size(p.b) + 1e-10)), True)
        return let(out, lambda o: F.when(o["k"] == 0, 0.0).otherwise(o["s"] / o["k"]))

    return let(F.struct(tok(a).alias("a"), tok(b).alias("b")), of)
