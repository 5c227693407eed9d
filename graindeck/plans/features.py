"""Queries of structure and information measures over documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import structure as st
from .catalogue import DOCS, docs, query, r6, s_, t_
from .rollouts import table
from .typed import ascii_words, quoted

# RE2 knows word boundaries of ASCII only: y is the text with other letters made one, for patterns only
TEXT = f"with d as (select doc_id, coalesce(text, '') t from documents), e as (select *, {ascii_words('t')} y from d)"


def found(x: str, p: str, flags: str = "(?i)", group: int = 0) -> str:
    return f"regexp_extract_all({x}, {quoted(flags + p)}, {group})"


def hits(x: str, patterns, flags: str = "(?i)") -> str:
    return " + ".join(f"len({found(x, p, flags)})" for p in patterns)


def any_of(x: str, patterns, flags: str = "(?i)") -> str:
    return "(" + " or ".join(f"regexp_matches({x}, {quoted(flags + p)})" for p in patterns) + ")"


MARKS = "list_distinct(flatten([" + ", ".join([found("y", p, "(?im)", 1) for p in (*st.STEP_MARKS, st.BULLET)] + [found("y", p, "(?i)", 1) for p in st.CONNECTORS]) + "]))"
STEPS = f"case when t = '' then 0 else least(20, greatest(len({MARKS}), len(list_filter(string_split(t, chr(10) || chr(10)), lambda p: {s_('p')} <> '')), 1)) end"
SENTENCES = "regexp_split_to_array(y, '[.!?]+')"
FULL = f"list_filter([{s_('x')} for x in {SENTENCES}], lambda x: x <> '')"


@query("structure_metrics", f"{TEXT}, m as (select *, {STEPS} steps, {hits('y', st.BRANCHES)} branches, {' + '.join(f'{w} * len({found(chr(121), p)})' for p, w in st.DECISIONS)} points from e) select doc_id, steps::int steps, branches::int branches, greatest(1, trunc(1 + points))::int cyclomatic, round(case when steps + branches > 0 then steps / (steps + branches) else 1 end::double, 6) linear_ratio, {any_of('y', st.CONCLUSIONS[:2])} or regexp_matches(t, {quoted(st.CONCLUSIONS[2])}) conclusion, {any_of('y', st.PREMISES)} premises from m")
def structure_metrics(spark, sf_dir):
    t = F.col("t")
    m = st.structure(t)
    return docs(spark, sf_dir).select("doc_id", m["steps"].alias("steps"), m["branches"].alias("branches"), st.cyclomatic(t).alias("cyclomatic"), r6(m["linear_ratio"]).alias("linear_ratio"), m["conclusion"].alias("conclusion"), m["premises"].alias("premises"))


DOWN, UP = any_of("x", st.DEEPER), any_of("x", st.BACK_UP)


@query("reasoning_depth", f"{TEXT}, m as (select doc_id, t, [struct_pack(now := 0, most := 0, d := {DOWN}::int, u := {UP}::int) for x in {SENTENCES}] l from e) select doc_id, (case when t = '' then 0 else list_reduce(list_prepend(struct_pack(now := 1, most := 1, d := 0, u := 0), l), lambda a, b: struct_pack(now := case when b.u = 1 then greatest(1, a.now + b.d - 1) else a.now + b.d end, most := greatest(a.most, a.now + b.d), d := 0, u := 0)).most end)::int depth from m")
def reasoning_depth(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", st.depth(F.col("t")).alias("depth"))


@query("reference_chain", f"{TEXT}, m as (select doc_id, t, {FULL} s from e), n as (select *, len(list_filter(s, lambda x: {any_of('x', st.BACKWARD)})) b, len(list_filter(s, lambda x: {any_of('x', st.FORWARD)})) f, len(list_filter(s[2:], lambda x: {any_of('x', st.TRANSITIONS)})) tr from m), o as (select *, case when len(s) > 1 then tr / (len(s) - 1) end d from n) select doc_id, (case when len(s) < 2 then 0 else b end)::int back, (case when len(s) < 2 then 0 else f end)::int forward, round(case when t = '' then 0 when len(s) < 2 then 1 else least(1.0, 2 * b / len(s)) end::double, 6) coherence, round(case when t = '' then 0 when len(s) < 2 then 0.5 when d < 0.2 then 0.3 + d * 1.5 when d <= 0.8 then 0.6 + 0.4 * (d - 0.2) / 0.6 else greatest(0.7, 1 - (d - 0.8)) end::double, 6) transitions from o")
def reference_chain(spark, sf_dir):
    t = F.col("t")
    m = st.references(t)
    return docs(spark, sf_dir).select("doc_id", m["back"].alias("back"), m["forward"].alias("forward"), r6(m["coherence"]).alias("coherence"), r6(st.transitions(t)).alias("transitions"))


@query("detail_level", f"{TEXT} select doc_id, round((case when t = '' then 0 else ({' + '.join(f'{w} * least(3, len({found(chr(121), p)})) / 3.0' for p, w in st.DETAILS)}) / {sum(w for _, w in st.DETAILS)} end)::double, 6) detail from e")
def detail_level(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", r6(st.detail(F.col("t"))).alias("detail"))


INSIDE = "[" + ", ".join(map(quoted, st.FUNCTION_WORDS)) + "]"


@query("halstead", f"with {DOCS}, m as (select doc_id, list_filter(w, lambda x: list_contains({INSIDE}, x)) a, list_filter(w, lambda x: not list_contains({INSIDE}, x)) b from k), n as (select doc_id, len(list_distinct(a)) n1, len(list_distinct(b)) n2, len(a) t1, len(b) t2 from m), o as (select *, case when n1 + n2 > 1 then (t1 + t2) * log2(n1 + n2) else 0 end v, case when n1 + n2 > 1 and n2 > 0 then n1 / 2 * t2 / n2 else 0 end d from n) select doc_id, (n1 + n2)::int vocabulary, (t1 + t2)::int length, round(v::double, 5) volume, round(d::double, 5) difficulty, round((d * v)::double, 3) effort from o")
def halstead(spark, sf_dir):
    m = st.halstead(F.col("t"))
    return docs(spark, sf_dir).select("doc_id", m["vocabulary"].alias("vocabulary"), m["length"].alias("length"), F.round(m["volume"], 5).alias("volume"), F.round(m["difficulty"], 5).alias("difficulty"), F.round(m["effort"], 3).alias("effort"))


SEGMENTS = f"with s as (select doc_id, coalesce(text, '') t, unnest(regexp_split_to_array(coalesce(text, ''), '[.!?\\n]+')) s from documents where length(coalesce(text, '')) >= 40), u as (select doc_id, regexp_replace(lower({s_('s')}), '\\s+', ' ', 'g') s from s where length({s_('s')}) >= 20), c as (select doc_id, s, count(*) n from u group by all having count(*) > 1), k as (select *, row_number() over (partition by doc_id order by length(s) * (n - 1) desc, s) rn from c)"


@query("clone_detection", f"{SEGMENTS} select doc_id, s segment, n::int n, length(s) * (n - 1) wasted from k where rn <= 10")
def clone_detection(spark, sf_dir):
    """The ten clones of each document that waste most; the number is the report's."""
    c = docs(spark, sf_dir).select("doc_id", F.explode(F.slice(st.clones(F.col("t")), F.lit(1), F.lit(10))).alias("c"))
    return c.select("doc_id", "c.segment", "c.n", (F.length("c.segment") * (F.col("c.n") - 1)).cast("long").alias("wasted"))


@query("clone_ratio", f"{SEGMENTS}, w as (select doc_id, sum(length(s) * (n - 1)) wasted from k where rn <= 10 group by 1) select doc_id, round(least(1.0, coalesce(wasted, 0) / greatest(1, length(coalesce(text, ''))))::double, 6) ratio from documents left join w using (doc_id)")
def clone_ratio(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", r6(st.clone_ratio(F.col("t"))).alias("ratio"))


GRAMS = " + ".join(f"case when {k} < len(w) // 2 then {k} * (len(w) - {k - 1} - len(list_distinct([array_to_string(w[i:i + {k - 1}], ' ') for i in range(1, len(w) - {k - 2})]))) else 0 end" for k in range(4, 11))


@query("phrase_repetition", f"with {DOCS} select doc_id, round(case when len(w) < 8 then 0 else least(1.0, ({GRAMS}) / len(w)) end::double, 6) repetition from k")
def phrase_repetition(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", r6(st.phrase_repetition(F.col("t"))).alias("repetition"))


@query("information_density", f"with {DOCS}, x as (select doc_id, unnest(w) w from k), c as (select doc_id, w, count(*) n from x group by all), e as (select doc_id, sum(n)::double n, count(*)::double v, log2(sum(n)) - sum(n * log2(n)) / sum(n) h from c group by 1), m as (select k.doc_id, t, coalesce(n, 0) n, coalesce(v, 0) v, coalesce(h, 0) h from k left join e using (doc_id)), o as (select *, case when n <= 1 then 1 else h / log2(n) end normal from m) select doc_id, round(h::double, 6) word_entropy, round(case when n <= 1 then 0 else log2(n) end::double, 6) max_entropy, round(normal::double, 6) normalized, round(case when v <= 1 then 0 else h / log2(v) end::double, 6) density, round(case when t = '' then 0 else 1 - normal end::double, 6) redundancy from o")
def information_density(spark, sf_dir):
    m = st.information(F.col("t"))
    return docs(spark, sf_dir).select("doc_id", *(r6(m[k]).alias(k) for k in ("word_entropy", "max_entropy", "normalized", "density", "redundancy")))


PAIRS = f"with x as (select conv_id, turn, coalesce(text, '') a, lead(coalesce(text, '')) over (partition by conv_id order by turn) b from conversations), p as (select *, {t_('a')} w, {t_('b')} r from x where b is not null), cw as (select conv_id, turn, u.w, count(*) n from p, unnest(w) u(w) group by all), cr as (select conv_id, turn, u.w, count(*) m from p, unnest(r) u(w) group by all), b as (select conv_id, turn, w, coalesce(n, 0) n, coalesce(m, 0) m from cw full join cr using (conv_id, turn, w))"


def neighbours(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("a"))
    return x.withColumn("b", F.lead("a").over(w)).where("b is not null")


@query("cross_entropy_reference", f"{PAIRS}, t as (select conv_id, turn, sum(n) nw, sum(m) nr, count(*) size from b group by all), s as (select conv_id, turn, sum(-n * log2((m + 0.1) / (nr + 0.1 * size))) / any_value(nw) e from b join t using (conv_id, turn) group by all) select conv_id, turn, round((case when len(w) = 0 or len(r) = 0 then 'infinity'::double else e end)::double, 5) bits from p left join s using (conv_id, turn)")
def cross_entropy_reference(spark, sf_dir):
    """Each turn under the words of the next."""
    return neighbours(spark, sf_dir).select("conv_id", "turn", F.round(st.cross_entropy(F.col("a"), F.col("b")), 5).alias("bits"))


@query("average_pmi", f"{PAIRS}, t as (select conv_id, turn, sum(n) nw, sum(m) nr, count(*) filter (n > 0) + count(*) filter (m > 0) total from b group by all), s as (select conv_id, turn, avg(log2(1 / total / (n / nw * m / nr + 1e-10))) e from b join t using (conv_id, turn) where n > 0 and m > 0 group by all) select conv_id, turn, round(coalesce(e, 0)::double, 5) pmi from p left join s using (conv_id, turn)")
def average_pmi(spark, sf_dir):
    return neighbours(spark, sf_dir).select("conv_id", "turn", F.round(st.mean_pmi(F.col("a"), F.col("b")), 5).alias("pmi"))
