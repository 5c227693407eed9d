"""Quality rules: exact document statistics, and outliers by the minimum covariance determinant, with DataFrame functions.

Each group of language and source gets a robust location and scatter of transformed statistics: of several starts, each led by
concentration steps (the share H of the rows that are nearest by Mahalanobis distance give the next mean and covariance), the
one whose covariance has the least determinant. The starts are deterministic: median and median absolute deviation, the plain
mean and covariance, and the covariance of the rows' directions from the median. As some statistics are 0 in most documents,
each covariance is regularised by a floor on the variances. The scatter is scaled so that the H-quantile of the distances is
the chi-squared one. A row is rejected beyond the cut. Groups of under SMALL rows use their language's estimate, and else
everybody's. A step is a pass over the statistics that adds up moments by group; quantiles are read from counts in fine bins,
so nothing depends on the order of rows. Estimates, their factors and determinants are tables with a row for each group.

The chi-squared quantile would be a cut for normal statistics; these have long tails, by which a cut at 4.5 (0.999 of the
chi-squared distribution) would reject 5 % of the sound documents. CUT is set by the labels at sf0.1: it leaves all documents
that they call good (0.999 of whose distances are below 11.2) and none that they call bad.

Nulls: a null text has no words; a null language or source is one of its own. Repeated rows are treated alike. An empty
table gives an empty result. Other columns pass through, but for the text and columns with the names of the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE, dropped, let, table, unused, words, written

H, STEPS, SMALL = 0.75, 3, 200
OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
#: Least standard deviation of each transformed statistic.
FLOOR = {"x_words": 0.5, "x_length": 0.05, "x_symbols": 0.35, "x_lines": 0.6, "x_repeats": 0.6}
#: Rows beyond this distance go.
CUT = 12.5
#: Bins of a distance's logarithm for each factor of e, and of a statistic for each unit.
BINS, FINE = 32, 64


def repeated_words(w: Column, size: int = 3) -> Column:
    """Words in windows of so many words that a text has twice or more, the first included; by sorting the windows."""
    n = F.size(w)
    windows = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def positions(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(placed, lambda s: F.transform(F.filter(F.transform(s, lambda x, i: F.struct(x.i.alias("i"), (F.get(s, i - 1)["h"].eqNullSafe(x.h) | F.get(s, i + 1)["h"].eqNullSafe(x.h)).alias("two"))), lambda x: x.two), lambda x: x.i))
        start = F.struct(F.lit(-size).alias("last"), F.lit(0).cast("long").alias("n"))
        covered = F.aggregate(F.sort_array(twice), start, lambda acc, i: F.struct(i.alias("last"), (acc.n + F.least(F.lit(size), i - acc.last)).alias("n")))
        return covered["n"]

    counted = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(positions(h)))
    return F.when(n < size + 1, F.lit(0).cast("long")).otherwise(counted)


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, and _lines; without its text."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    (w,) = unused(df, "_words")
    out = df.withColumn(w, words(F.col(text))).select(
        *[c for c in df.columns if c not in (text, "_lines", *OUT)],
        F.size(w).cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(F.col(w), lambda w: repeated_words(w)).alias("n_repeat_words"),
        F.greatest(F.size(F.split(t, "\n")), F.lit(1)).alias("_lines"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def transformed(df: DataFrame) -> DataFrame:
    per = F.greatest(F.col("n_words"), F.lit(1))
    return df.withColumns({
        "x_words": F.log1p("n_words"),
        "x_length": F.log1p(F.col("word_chars") / per),
        "x_symbols": F.log1p(100 * F.col("n_symbols") / per),
        "x_lines": F.log1p(100 * F.col("n_dup_lines") / F.col("_lines")),
        "x_repeats": F.log1p(100 * F.col("n_repeat_words") / per),
    })


def chi_squared(share: float, p: int) -> float:
    """The quantile of the chi-squared distribution by Wilson and Hilferty; share in (0, 1)."""
    from statistics import NormalDist

    return p * (1 - 2 / (9 * p) + NormalDist().inv_cdf(share) * (2 / (9 * p)) ** 0.5) ** 3


def grouped(x: DataFrame, group: list[str]) -> DataFrame:
    """Each row three times, by the hash of its finest group, its first column's group, and all."""
    keys = [F.xxhash64(F.lit(level), *(F.col(c) for c in group[:level]), *(F.col(c).isNull() for c in group[:level])) for level in range(len(group), -1, -1)]
    return x.withColumn("_keys", F.array(*keys))


def distance(names: list[str]) -> Column:
    """The squared Mahalanobis distance by m and w, the rows of an inverse Cholesky factor."""
    total = F.lit(0.0)
    for i in range(len(names)):
        z = sum((F.col("w")[i][j] * (F.col(n) - F.col("m")[j]) for j, n in enumerate(names[: i + 1])), F.lit(0.0))
        total = total + z * z
    return total


def lower(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i + 1)]


def factored(moments: DataFrame, floor: list[float]) -> DataFrame:
    """moments (k, start, m, and s, the lower triangle of a covariance by rows) with w, the rows of the inverse Cholesky factor
    of the covariance plus the floors, and logdet, the logarithm of its determinant."""
    p = len(floor)
    at = {ij: n for n, ij in enumerate(lower(p))}
    out = moments
    for i, j in lower(p):  # the factor, entry by entry
        rest = sum((F.col(f"_l{i}_{k}") * F.col(f"_l{j}_{k}") for k in range(j)), F.lit(0.0))
        value = F.col("s")[at[i, j]] - rest
        out = out.withColumn(f"_l{i}_{j}", F.sqrt(F.greatest(value + floor[i] ** 2, F.lit(1e-12))) if i == j else value / F.col(f"_l{j}_{j}"))
    for j in range(p):  # its inverse, column by column
        for i in range(j, p):
            rest = sum((F.col(f"_l{i}_{k}") * F.col(f"_w{k}_{j}") for k in range(j, i)), F.lit(0.0))
            out = out.withColumn(f"_w{i}_{j}", (F.lit(1.0 if i == j else 0.0) - rest) / F.col(f"_l{i}_{i}"))
    rows = F.array(*(F.array(*(F.col(f"_w{i}_{j}") for j in range(i + 1))) for i in range(p)))
    return out.select("k", "start", "m", rows.alias("w"), (2 * sum((F.log(F.col(f"_l{i}_{i}")) for i in range(p)), F.lit(0.0))).alias("logdet"))


def moments_of(rows: DataFrame, names: list[str], least: float) -> DataFrame:
    """The mean and covariance of the rows of each _k and start, if they have so many."""
    p = len(names)
    sums = rows.groupBy("_k", "start").agg(F.count(F.lit(1)).alias("n"), *(F.sum(n).alias(f"s{i}") for i, n in enumerate(names)), *(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"q{i}_{j}") for i, j in lower(p)))
    mean = [F.col(f"s{i}") / F.col("n") for i in range(p)]
    cov = F.array(*(F.col(f"q{i}_{j}") / F.col("n") - mean[i] * mean[j] for i, j in lower(p)))
    return sums.where(F.col("n") >= least).select(F.col("_k").alias("k"), "start", F.array(*mean).alias("m"), cov.alias("s"))


def bin_quantiles(binned: DataFrame, by: list[str], share: float) -> DataFrame:
    """by and limit: the bin (_bin) that the share of the rows of each of by is reached in."""
    upto = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    counts = binned.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("_upto", F.sum("n").over(upto)).withColumn("_all", F.sum("n").over(Window.partitionBy(*by)))
    return counts.where(F.col("_upto") >= share * F.col("_all")).groupBy(*by).agg(F.min("_bin").alias("limit"))


def medians(rows: DataFrame, names: list[str], of) -> DataFrame:
    """_k and an array of the medians of of(name, i) for each statistic, each to a bin."""
    long = rows.select("_k", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.floor(FINE * of(n, i) + 0.5).alias("b")) for i, n in enumerate(names)))).alias("x"))
    limits = bin_quantiles(long.select("_k", F.col("x.i").alias("i"), F.col("x.b").alias("_bin")), ["_k", "i"], 0.5)
    return limits.groupBy("_k").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", (F.col("limit") / FINE).alias("v")))), lambda x: x.v).alias("v"))


def starts(rows: DataFrame, names: list[str], floor: list[float]) -> DataFrame:
    """moments of the three starts of each _k."""
    p = len(names)
    middle = written(medians(rows, names, lambda n, i: F.col(n)).select("_k", F.col("v").alias("mid")), "medians")
    spread = medians(rows.join(middle, "_k"), names, lambda n, i: F.abs(F.col(n) - F.col("mid")[i])).select("_k", F.transform("v", lambda v: 1.4826 * v).alias("mad"))
    center = written(middle.join(spread, "_k"), "centers")
    around = center.select(F.col("_k").alias("k"), F.lit(0).alias("start"), F.col("mid").alias("m"), F.array(*(F.col("mad")[i] ** 2 if i == j else F.lit(0.0) for i, j in lower(p))).alias("s"))
    plain = moments_of(rows.withColumn("start", F.lit(1)), names, 1)
    # directions from the median, by scales of their own
    scale = lambda i: F.sqrt(F.col("mad")[i] ** 2 + floor[i] ** 2)
    z = rows.join(center, "_k").select("_k", "mid", "mad", *(((F.col(n) - F.col("mid")[i]) / scale(i)).alias(f"z{i}") for i, n in enumerate(names)))
    norm = F.greatest(sum((F.col(f"z{i}") ** 2 for i in range(p)), F.lit(0.0)), F.lit(1e-12))
    signs = z.groupBy("_k").agg(F.first("mid").alias("m"), F.first("mad").alias("mad"), *(F.avg(F.col(f"z{i}") * F.col(f"z{j}") / norm).alias(f"u{i}_{j}") for i, j in lower(p)))
    signs = signs.select(F.col("_k").alias("k"), F.lit(2).alias("start"), "m", F.array(*(p * F.col(f"u{i}_{j}") * scale(i) * scale(j) for i, j in lower(p))).alias("s"))
    out = written(factored(around.unionByName(plain).unionByName(signs), floor), "starts")
    dropped(middle, center)
    return out


def concentrated(rows: DataFrame, params: DataFrame, names: list[str], floor: list[float], h: float) -> DataFrame:
    """params after one concentration step."""
    limited = written(params.join(limits_of(rows, params, names, h), ["k", "start"]), "limits")
    near = measured(rows, limited, names).where("_bin <= limit")
    out = written(factored(moments_of(near, names, 1), floor), "estimates")
    dropped(limited)
    return out


def measured(rows: DataFrame, params: DataFrame, names: list[str]) -> DataFrame:
    """Each row with each of its group's estimates, and the bin of its distance."""
    return rows.join(params, rows["_k"] == params["k"]).withColumn("_bin", F.floor(BINS * F.log(distance(names) + 1e-6)))


def limits_of(rows: DataFrame, params: DataFrame, names: list[str], h: float) -> DataFrame:
    return bin_quantiles(measured(rows, params, names).select("k", "start", "_bin"), ["k", "start"], h)


def estimate(x: DataFrame, group: list[str], h: float = H, steps: int = STEPS, small: int = SMALL, floor: dict = FLOOR) -> DataFrame:
    """A table of each group's key, mean (m) and inverse Cholesky factor (w), scaled; groups of under small rows have none."""
    names, least = list(floor), [float(v) for v in floor.values()]
    p = len(names)
    every = grouped(x, group).select(F.explode("_keys").alias("_k"), *names)
    large = every.groupBy("_k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= small).select("_k")
    rows = written(every.join(large, "_k", "left_semi"), "grouped")
    params = starts(rows, names, least)
    for _ in range(steps):
        last, params = params, concentrated(rows, params, names, least, h)
        dropped(last)
    best = params.groupBy("k").agg(F.min_by(F.struct("m", "w"), F.struct("logdet", "start")).alias("e")).select("k", F.lit(0).alias("start"), "e.m", "e.w")
    best = written(best, "best")
    factor = F.sqrt(F.lit(chi_squared(h, p)) / F.exp((F.col("limit") + 1) / BINS))
    scaled = best.join(limits_of(rows, best, names, h), ["k", "start"]).withColumn("_f", factor)
    out = written(scaled.select("k", "m", F.transform("w", lambda r: F.transform(r, lambda v: v * F.col("_f"))).alias("w")), "scaled")
    dropped(params, rows, best)
    return out


def judge(df: DataFrame, group=("lang", "source"), text: str = "text", cut: float = CUT) -> DataFrame:
    """df without its text, with the statistics, base_failed, distance and kept."""
    names, group = list(FLOOR), list(group)
    plain = [c for c in df.columns if c not in (text, "_lines", *OUT)]
    # the caller's columns go in one, so that no name of theirs meets one of these
    packed = df.select(F.struct(*plain).alias("_row"), *(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)), F.col(text).alias("_text"))
    keys = [f"_g{i}" for i in range(len(group))]
    seen = written(transformed(statistics(packed, "_text")), "rules")
    params = estimate(seen.where(~F.col("base_failed")), keys)
    # the finest group that has an estimate
    out = grouped(seen, keys)
    for i in range(len(group) + 1):
        one = params.select(F.col("k").alias(f"_k{i}"), F.struct("m", "w").alias(f"_e{i}"))
        out = out.join(one, F.col("_keys")[i] == F.col(f"_k{i}"), "left")
    out = out.withColumn("_e", F.coalesce(*(F.col(f"_e{i}") for i in range(len(group) + 1)))).withColumns({"m": F.col("_e.m"), "w": F.col("_e.w")})
    out = out.withColumn("distance", F.when(F.col("_e").isNull(), F.lit(0.0)).otherwise(F.sqrt(distance(names))))
    kept = ~F.col("base_failed") & (F.col("distance") <= cut)
    return out.select(*(F.col(f"_row.`{c}`").alias(c) for c in plain), *OUT[:6], kept.alias("kept"), "distance")


def op9(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")).drop("lang", "source")
