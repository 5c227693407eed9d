"""Personal data: high-recall candidates, judged by gradient-boosted trees, with DataFrame functions only.

Base spans are the leftmost non-overlapping matches of each kind's pattern that pass its test; they always stay. Looser
generators propose further spans (written-out or bracketed addresses, defanged IPs, cards of 13 to 19 digits with other
separators, phones without a plus, and values that stand where a token, key or password is given, as the kind secret). Trees boosted on the logistic loss score each by its format and the words and
characters around it; a kind's threshold is the least whose precision on held-out examples is PRECISION. Candidates that
touch a base span are left out, and of candidates that touch each other the likeliest stays. The trees learn from EXAMPLES
texts made here from a seed, read by the same expressions, and become one expression over the features.

Nulls: a null text counts as the empty one; both have no spans. Positions count code points, ends exclusive. Repeated rows
are treated alike. An empty table gives an empty result. Other columns pass through unless they have a result's name.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import let, table

#: Kinds in the order of results; the last has no base pattern.
KINDS = ("email", "ip", "card", "phone", "secret")
# The base patterns. A start inside a run that an earlier start would have taken whole is left out, and runs are taken
# whole at once; both leave the matches as they are and the time linear.
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NAMED, VALUE = "token|key|secret|passw(?:or)?d|bearer|credential", "[A-Za-z0-9_+/=.~-]"
LOOSE = {
    "email": rf"{LOCAL}{{1,64}} ?(?:@|[(\[]at[)\]]|(?<= )at(?= )) ?[A-Za-z0-9-]{{1,63}}(?:(?:\.| ?[(\[](?:dot|\.)[)\]] ?| dot )[A-Za-z0-9-]{{1,63}}){{1,4}}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?: ?[(\[](?:dot|\.)[)\]] ?| dot )[0-9]{1,3}){3}+",
    "card": r"(?<![0-9])[0-9](?:[ ._-]?[0-9]){12,18}+",
    "phone": r"(?<![0-9])\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "secret": rf"(?<=(?i:{NAMED})[\"' ]{{0,2}}[:= ]{{1,3}}[\"']{{0,1}})(?<!{VALUE}){VALUE}{{12,256}}+",
}
#: What a text must hold for a pattern to be tried: each is implied by its pattern.
BASE_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]"}
LOOSE_NEEDS = {"email": r"@|[(\[]at[)\]]| at ", "ip": r"[0-9](?: ?[(\[]| dot )", "card": r"[0-9][ ._-]?[0-9][ ._-]?[0-9][ ._-]?[0-9]", "phone": r"[0-9][ .-][0-9]{4}", "secret": rf"(?i:{NAMED})[\"': =]"}
AROUND = 24
EXAMPLES, TREES, DEPTH, RATE, PRECISION = 3000, 24, 3, 0.3, 0.99
SPAN = "array<struct<kind:int,start:int,end:int,m:string>>"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def passes(kind: str, m: Column) -> Column:
    """The test of a base match."""
    if kind == "ip":
        return m.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind == "card":
        return let(digits(m), lambda d: F.length(d).between(16, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return F.length(digits(m)).between(8, 15)
    return F.lit(True)


def tested(kind: str):
    return lambda s: passes(kind, s.m)


def of_kind(i: int):
    return lambda s: s.kind == i


def matches(text: Column, pattern: str, kind: int, needs: str) -> Column:
    """The leftmost non-overlapping matches with their code point positions: what lies between matches is measured."""
    none = F.expr(f"cast(array() as {SPAN})")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc, z) -> Column:
        s = acc.at + F.length(z.gap)
        e = s + F.length(z.m)
        return F.struct(e.alias("at"), F.concat(acc.out, F.array(F.struct(F.lit(kind).alias("kind"), s.alias("start"), e.alias("end"), z.m.alias("m")))).alias("out"))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = let(found, lambda ms: F.slice(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), ms.alias("m")), F.lit(1), F.size(ms)))
    return F.when(text.rlike(needs), F.aggregate(zipped, start, step)["out"]).otherwise(none)


def worth(text: Column) -> Column:
    """Whether a text can hold a match of any pattern; most can't, and then none is tried."""
    return text.rlike(rf"[0-9]|{LOOSE_NEEDS['email']}|{LOOSE_NEEDS['secret']}")


def base_spans(text: Column) -> Column:
    return F.concat(*(F.filter(matches(text, BASE[k], i, BASE_NEEDS[k]), tested(k)) for i, k in enumerate(BASE)))


def touching(a: Column, b: Column) -> Column:
    return (a.start < b.end) & (b.start < a.end)


def candidates(text: Column, base: Column) -> Column:
    """Spans of the loose generators that touch no base span, with the text around them."""
    found = F.concat(*(matches(text, LOOSE[k], i, LOOSE_NEEDS[k]) for i, k in enumerate(KINDS)))
    free = F.filter(found, lambda c: ~F.exists(base, lambda b: touching(b, c)))
    around = lambda c: F.struct(c.kind.alias("kind"), c.start.alias("start"), c.end.alias("end"), c.m.alias("m"), F.substring(text, F.greatest(c.start - AROUND, F.lit(0)) + 1, F.least(c.start, F.lit(AROUND))).alias("before"), F.substring(text, c.end + 1, F.lit(AROUND)).alias("after"))
    return F.transform(free, around)


def features(c: Column) -> dict[str, Column]:
    """Numbers for a candidate's format and surroundings."""
    one = lambda x: x.cast("int")
    d = digits(c.m)
    return {
        "digits": F.length(d),
        "length": F.length(c.m),
        "luhn": one(F.coalesce(F.call_function("luhn_check", d), F.lit(False))),
        "separators": F.length(F.regexp_replace(c.m, r"[^ ._()\[\]-]", "")),
        "kinds_of_separators": F.size(F.array_distinct(F.split(F.regexp_replace(c.m, r"[^ ._-]", ""), ""))),
        "bracketed": one(c.m.rlike(r"[(\[](?:at|dot|\.)[)\]]")),
        "spelled": one(c.m.rlike(r" (?:at|dot) ")),
        "at_sign": one(c.m.contains("@")),
        "domain": one(c.m.rlike(r"(?i)(?<![A-Za-z0-9-])(?:com|org|net|edu|gov|info|io|de|fr|es|uk|example)$")),
        "small_parts": one(~c.m.rlike(r"[3-9][0-9]{2}|2[6-9][0-9]|25[6-9]")),
        "issuer": one(d.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6)")),
        "grouped": one(c.m.rlike(r"^[0-9]{4}(?:[ ._-][0-9]{4,6}){2,4}|^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$")),
        "parenthesis": one(c.m.startswith("(")),
        "says_mail": one(c.before.rlike(r"(?i)(?:e-?mail|write|contact|reach)")),
        "says_phone": one(c.before.rlike(r"(?i)(?:call|tel|phone|fax|mobile|dial|cell)")),
        "says_card": one(c.before.rlike(r"(?i)(?:card|visa|master|amex|credit|debit)")),
        "says_ip": one(c.before.rlike(r"(?i)(?:\bip\b|host|server|address|ping)")),
        "says_other": one(c.before.rlike(r"(?i)(?:order|isbn|serial|version|no\.|id|ref|account|tracking|token|key|\$|#)")),
        "says_secret": one(c.before.rlike(rf"(?i)(?:{NAMED})[\"' ]{{0,2}}[:=]")),
        "quoted": one(c.before.rlike(r"[\"']$")),
        "digit_share": F.length(d) / F.length(c.m),
        "only_hex": one(c.m.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "case_changes": F.regexp_count(c.m, F.lit("[a-z][A-Z0-9]|[0-9][A-Za-z]")),
        "joined_before": one(c.before.rlike(r"[A-Za-z0-9_/=.\"-]$")),
        "joined_after": one(c.after.rlike(r"^[A-Za-z0-9_/=\"-]")),
    }


def made_examples(n: int, seed: int = 5) -> list[dict]:
    """Texts with one planted candidate each: t, its kind, and y, 1 if it is personal data."""
    r, out = random.Random(seed), []
    word = lambda: "".join(r.choice("aeioubcdfglmnprst") for _ in range(r.randint(3, 8)))
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def luhn(d: str) -> str:
        return next(d + c for c in "0123456789" if sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d + c))) % 10 == 0)

    def cut(d: str, sep: str, sizes) -> str:
        parts, at = [], 0
        for s in sizes:
            parts.append(d[at : at + s])
            at += s
        return sep.join([*parts, d[at:]] if at < len(d) else parts)

    def example(kind: int, good: bool) -> tuple[str, str]:
        if kind == 0:
            at, dot = r.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), (" [at] ", " [dot] ")])
            if good:
                return r.choice(["mail ", "write to ", "contact ", "email: ", ""]), word() + at + word() + dot + r.choice(["com", "org", "net", "de"])
            return r.choice(["we met ", "look ", "sold ", "arrived "]), r.choice([word() + " at " + word() + "." + number(1), word() + " at " + word() + " dot " + word(), word() + "@" + word() + "." ])
        if kind == 1:
            sep = r.choice(["[.]", "(.)", " dot ", "[dot]"])
            parts = [r.randint(0, 255) if good else r.choice([r.randint(256, 999), r.randint(0, 999)]) for _ in range(4)]
            if not good:
                parts[r.randrange(4)] = r.randint(256, 999)
            return r.choice(["server ", "ip ", "host ", ""]) if good else r.choice(["section ", "no. ", "", "ref "]), sep.join(map(str, parts))
        if kind == 2:
            k = r.choice([13, 15, 15, 16])
            d = luhn(r.choice("3456") + number(k - 2)) if good else number(k - 1)
            if not good:
                d += r.choice([c for c in "0123456789" if d + c != luhn(d)])
            if good and k == 15:
                d = luhn(r.choice(["34", "37"]) + number(12))
            sep = r.choice([".", "_", "."]) if k == 16 else r.choice(["", " ", "-"])
            before = r.choice(["card ", "visa ", "credit card: ", "amex "]) if good else r.choice(["order ", "tracking ", "isbn ", "serial ", "", "token = "])
            return before, cut(d, sep, (4, 4, 4) if k == 16 else (4, 6) if k == 15 else ())
        if kind == 4:
            name, size = r.choice(["token", "api_key", "key", "secret", "password", "client_secret", "Bearer"]), r.choice([16, 20, 24, 32, 36, 40, 64])
            before = name + (" " if name == "Bearer" else r.choice([" = \"", "=", ": ", ": \"", "='", "\": \""]))
            if good:
                letters = r.choice(["0123456789abcdef", "0123456789ABCDEF", "0123456789" + "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" * 2 + "-_"])
                return before, r.choice(["", "", "sk-", "ghp_"]) + "".join(r.choice(letters) for _ in range(size))
            return r.choice([before, name + " "]), r.choice(["-".join(word() for _ in range(3)) + word(), "_".join(word() for _ in range(4)), word() + word() + word() + ".", "".join(word() for _ in range(4)), "=" * size, "-" * size, "/".join(word() for _ in range(4))])
        d = number(10)
        if good:
            return r.choice(["call ", "tel ", "phone: ", "mobile ", "fax "]), r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}"]).format(d[:3], d[3:6], d[6:])
        return r.choice(["order ", "id ", "ref ", "$", "version ", "account ", ""]), r.choice(["{}{}-{}", "{}-{}-{}", "{} {} {}"]).format(d[:3], d[3:6], d[6:])

    for _ in range(n):
        kind, good = r.randrange(len(KINDS)), r.random() < 0.5
        before, m = example(kind, good)
        lead, tail = " ".join(word() for _ in range(r.randint(0, 5))), " ".join(word() for _ in range(r.randint(0, 5)))
        out.append({"t": f"{lead} {before}{m} {tail}", "kind": kind, "y": int(good)})
    return out


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> tuple | float:
    """A regression tree by second-order gains: (feature, limit, left, right), or a leaf's value."""
    value = -g.sum() / (h.sum() + 1.0)
    if not depth or len(g) < 20:
        return float(value)
    best, score = None, g.sum() ** 2 / (h.sum() + 1.0) + 1e-3
    for f in range(x.shape[1]):
        for limit in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= limit
            if 5 <= left.sum() <= len(g) - 5:
                gain = g[left].sum() ** 2 / (h[left].sum() + 1.0) + g[~left].sum() ** 2 / (h[~left].sum() + 1.0)
                if gain > score:
                    best, score = (f, float(limit), left), gain
    if best is None:
        return float(value)
    f, limit, left = best
    return f, limit, grow(x[left], g[left], h[left], depth - 1), grow(x[~left], g[~left], h[~left], depth - 1)


def predicted(node, x: np.ndarray) -> np.ndarray:
    if isinstance(node, float):
        return np.full(len(x), node)
    f, limit, a, b = node
    return np.where(x[:, f] <= limit, predicted(a, x), predicted(b, x))


def boost(x: np.ndarray, y: np.ndarray) -> tuple[list, float]:
    """Trees, and the least threshold of the log odds whose precision on a held-out fifth is PRECISION."""
    held = np.arange(len(y)) % 5 == 0
    trees, z = [], np.zeros(len(y))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        tree = grow(x[~held], (p - y)[~held], (p * (1 - p))[~held], DEPTH)
        trees.append(tree)
        z += RATE * predicted(tree, x)
    exact = [float(t) for t in np.unique(z[held]) if y[held][z[held] >= t].mean() >= PRECISION]
    threshold = min(exact, default=float("inf"))
    return trees, max(threshold - 1e-9, 0.0)


def fit(spark) -> dict[int, tuple[list, float]]:
    """Trees and threshold for each kind, from the made examples as the expressions see them."""
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(made_examples(EXAMPLES))), "array<struct<t:string,kind:int,y:int>>")).alias("r")).select("r.*")
    seen = rows.select("kind", "y", F.explode(candidates(F.col("t"), F.expr(f"cast(array() as {SPAN})"))).alias("c")).where(F.col("c.kind") == F.col("kind"))
    got = seen.select("kind", "y", F.array(*(f.cast("double") for f in features(F.col("c")).values())).alias("x")).collect()
    model = {}
    for k in range(len(KINDS)):
        mine = sorted(((r["x"], r["y"]) for r in got if r["kind"] == k))
        random.Random(k).shuffle(mine)
        if len({y for _, y in mine}) == 2:
            model[k] = boost(np.array([x for x, _ in mine]), np.array([y for _, y in mine]))
    return model


def as_expression(node, x: list[Column]) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    f, limit, a, b = node
    return F.when(x[f] <= limit, as_expression(a, x)).otherwise(as_expression(b, x))


def scored(c: Column, model: dict) -> Column:
    """A candidate's log odds above its kind's threshold; at most 0 means no."""
    values = features(c)
    packed = F.struct(*(v.cast("double").alias(k) for k, v in values.items()))

    def of(p: Column) -> Column:
        x, out = [p[k] for k in values], F.lit(-1.0)
        for k, (trees, threshold) in model.items():
            total = F.lit(-threshold)
            for t in trees:
                total = total + RATE * as_expression(t, x)
            out = F.when(c.kind == k, total).otherwise(out)
        return out

    return F.transform(F.array(packed), of)[0]


def added_spans(text: Column, base: Column, model: dict) -> Column:
    """The candidates that the trees accept; of touching ones the likeliest, then the first."""
    judged = F.transform(candidates(text, base), lambda c: F.struct(scored(c, model).alias("z"), (-c.kind).alias("k"), (-c.start).alias("s"), c.kind.alias("kind"), c.start.alias("start"), c.end.alias("end"), c.m.alias("m")))
    good = F.filter(judged, lambda c: c.z > 0)
    best = let(good, lambda g: F.filter(g, lambda c: ~F.exists(g, lambda o: touching(o, c) & (F.struct(o.z, o.k, o.s) > F.struct(c.z, c.k, c.s)))))
    return F.transform(best, lambda c: F.struct(c.kind.alias("kind"), c.start.alias("start"), c.end.alias("end"), c.m.alias("m")))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, by kind, then start, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat(F.get(names, s.kind), F.lit(":"), s.start.cast("string"), F.lit(":"), s.end.cast("string"))), ",")


def find(df: DataFrame, text: str = "text", model: dict | None = None) -> DataFrame:
    """df with base and added: arrays of spans (kind as a number, start, end, m)."""
    model = fit(df.sparkSession) if model is None else model
    kept = [c for c in df.columns if c not in ("base", "added")]
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.expr(f"cast(array() as {SPAN})")
    based = df.select(*kept, F.when(worth(t), base_spans(t)).otherwise(none).alias("base"))
    return based.withColumn("added", F.when(worth(t), let(F.col("base"), lambda b: added_spans(t, b, model))).otherwise(none))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with redacted: its text with each span replaced by its kind in brackets; of touching spans the first counts."""
    names = F.array(*map(F.lit, KINDS))
    found = find(df, text)
    by_start = F.sort_array(F.transform(F.concat("base", "added"), lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))
    t = F.coalesce(F.col(text), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.when(s.start < a.at, a).otherwise(F.struct(s.end.alias("at"), F.concat(a.out, F.substring(t, a.at + 1, s.start - a.at), F.lit("["), F.get(names, s.kind), F.lit("]")).alias("out")))
    done = F.aggregate(by_start, start, step, lambda a: F.concat(a.out, F.substring(t, a.at + 1, F.length(t))))
    return found.withColumn("redacted", F.when(F.col(text).isNotNull(), done)).drop("base", "added")


def op6(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("base", of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    spans = F.concat("base", "added")
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(spans).alias("spans"), F.size(spans).cast("long").alias("n_spans"))
