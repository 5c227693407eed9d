"""Queries of the further scorers of single completions, over rollouts and samples, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import registry
from ..operators import r1
from .catalogue import TOK, per_rollout, query, r6, s_, t_
from .rollouts import SQL as ROLLOUTS, rollouts
from .samples import SQL as SAMPLES, samples
from .typed import THOUGHT, ascii_words, quoted, re2

BS = chr(92)


def said(c: str) -> str:
    tag = s_(f"regexp_extract({c}, '(?s)<answer>(.*?)</answer>', 1)")
    after = s_(f"regexp_replace(regexp_extract({c}, {quoted('(?s)<think>.*?</think>' + BS + 's*(.*)')}, 1), '</?answer>', '', 'g')")
    return f"case when not contains({c}, '<think>') then case when regexp_matches({c}, '(?s)<answer>.*?</answer>') then {tag} else {s_(c)} end when regexp_matches({c}, '(?s)<think>.*?</think>') then {after} when not contains({c}, '</think>') then '' else {s_(c)} end"


BASE = f"{ROLLOUTS}, a0 as (select *, {said('c')} x, coalesce({THOUGHT}, '') th from r), a1 as (select *, {TOK.format('x')} w, lower(x) lx, {TOK.format('th')} tw from a0)"
BAND = "case {0} " + " ".join(f"when '{k}' then {{{i + 1}}}" for i, k in enumerate(r1.BEST_THINKING)) + " else {6} end"


def near(band) -> str:
    low, high = band
    return f"case when len(tw) between {low} and {high} then 0.3 when len(tw) < {low} then 0.15 * len(tw) / {low}.0 else greatest(0.05, 0.3 - 0.2 * least((len(tw) - {high}) / {high}.0, 2.0)) end"


EFFICIENCY = BAND.format("lower(type)", *map(near, r1.BEST_THINKING.values()), near((20, 100)))


@query("score_information_density", f"with {BASE} select rollout_id, round((case when length({s_('c')}) < 20 or len(w) < 10 then 0.5 else 0.6 + 0.1 * regexp_matches({ascii_words('x')}, {quoted(r1.NUMBERS.replace('(?U)', ''))})::int + 0.1 * regexp_matches({ascii_words('x')}, {quoted(r1.TECHNICAL.replace('(?U)', ''))})::int + 0.1 * regexp_matches(x, {quoted(r1.CITED)})::int - case when len(list_filter(w, lambda v: v in ({', '.join(map(quoted, r1.FILLERS))}))) / len(w) > 0.2 then 0.3 else 0 end end)::double, 6) information_density from a1")
def score_information_density(spark, sf_dir):
    return per_rollout(spark, sf_dir, "information_density")


@query("score_thinking_efficiency", f"with {BASE}, b as (select *, case when lower(x) = lower({s_('answer')}) then 0.5 else 0.2 end base from a1) select rollout_id, round((case when th = '' then base * 0.5 else base + {EFFICIENCY} end)::double, 6) thinking_efficiency from b")
def score_thinking_efficiency(spark, sf_dir):
    return per_rollout(spark, sf_dir, "thinking_efficiency")


SINGLE, LONG = [u for u in r1.UNWANTED if " " not in u], [u for u in r1.UNWANTED if " " in u]


@query("score_answer_quality", f"with {BASE} select rollout_id, round((case when length(x) < 5 or len(list_filter(w, lambda v: v in ({', '.join(map(quoted, SINGLE))}))) > 0 or {' or '.join(f'contains(lx, {quoted(u)})' for u in LONG)} then 0 else 1 - 0.1 * regexp_matches(x, {quoted(r1.EMOJI)})::int end)::double, 6) answer_quality from a1")
def score_answer_quality(spark, sf_dir):
    return per_rollout(spark, sf_dir, "answer_quality")


LOW = "lower(f)"
PHRASES = " - ".join(f"case when {{0}} > 3 then least(0.2, 0.05 * ({{0}} - 3)) else 0 end".format(f"((length({LOW}) - length(replace({LOW}, {quoted(p)}, ''))) / {len(p)})") for p in r1.PHRASES)


@query("score_repetition_penalty", f"with {BASE}, b as (select *, th || ' ' || x f from a1), d as (select *, {t_('f')} fw from b), g as (select *, [array_to_string(fw[i:i + 3], ' ') for i in range(1, len(fw) - 2)] g from d), l as (select *, case when len(fw) < 4 then 0 else 1 - len(list_distinct(g)) / len(g) end loss from g) select rollout_id, round((case when length({s_('c')}) < 20 then 1 else greatest(0, 1 - case when loss > 0.3 then least(0.4, loss) else 0 end - {PHRASES}) end)::double, 6) repetition_penalty from l")
def score_repetition_penalty(spark, sf_dir):
    return per_rollout(spark, sf_dir, "repetition_penalty")


SETS = "list_distinct(regexp_extract_all(lower({0}), '[" + BS + "w" + BS + "p{{L}}" + BS + "p{{M}}" + BS + "p{{N}}]+'))"
BOXED = lambda x: f"case when regexp_matches({x}, {quoted(r1.BOX)}) then {s_('regexp_extract(' + x + ', ' + quoted(r1.BOX) + ', 1)')} else {x} end"


@query("score_semantic_similarity", f"with {SAMPLES}, b as (select *, {said('c')} x, {said('a')} y from s), d as (select *, {BOXED('x')} g, {BOXED('y')} w from b), e as (select *, {SETS.format('g')} sg, {SETS.format('w')} sw, length(g) / greatest(length(w), 1) ratio from d) select sample_id, round((case when x = '' or y = '' then 0 when lower({s_('g')}) = lower({s_('w')}) then 1 when len(sg) = 0 or len(sw) = 0 then 0 else len(list_intersect(sg, sw)) / len(list_distinct(list_concat(sg, sw))) * case when ratio > 2 then greatest(0.5, 1 - 0.1 * (ratio - 2)) else 1 end end)::double, 6) semantic_similarity from e")
def score_semantic_similarity(spark, sf_dir):
    return registry.score(samples(spark, sf_dir), ["semantic_similarity"]).select("sample_id", r6("semantic_similarity").alias("semantic_similarity"))


NAMED = f"list_concat(regexp_extract_all(x, {re2(r1.OPTION)}, 1), regexp_extract_all(x, {re2(r1.OPTION_NAMED)}, 1))"


@query("score_mcq_accuracy", f"with {SAMPLES}, b as (select *, {said('c')} x, regexp_extract(a, {re2(r1.OPTION_WANTED)}, 1) want from s) select sample_id, coalesce((upper({NAMED}[-1]) = upper(case when want <> '' then want else substr({s_('a')}, 1, 1) end))::int, 0)::double mcq_accuracy from b")
def score_mcq_accuracy(spark, sf_dir):
    return registry.score(samples(spark, sf_dir), ["mcq_accuracy"]).select("sample_id", "mcq_accuracy")


@query("score_convergence", f"with {ROLLOUTS}, a0 as (select r.*, {said('c')} x, coalesce({THOUGHT}, '') th, left(coalesce(d.text, ''), 60) ref from r join documents d on doc_id = rollout_id), b as (select *, [{SETS.format('l')} for l in list_filter([{s_('y')} for y in string_split(th, chr(10))], lambda y: y <> '')] ls, {SETS.format('ref')} rs, (lower(x) = lower({s_('ref')}))::int ok from a0), d as (select *, [case when len(l) = 0 or len(rs) = 0 then 0 else len(list_intersect(l, rs)) / len(list_distinct(list_concat(l, rs))) end for l in ls] si from b), e as (select *, coalesce(list_position([v > 0.6 for v in si], true), 0) k from d) select rollout_id, round((case when len(si) < 2 or k = 0 then 0.3 * ok else greatest(0, least(1, (1 / k - case when k < 3 then 0.3 else 0 end + (si[k] - si[1]) * 0.3 + ok) / 2.75)) end)::double, 6) convergence from e")
def score_convergence(spark, sf_dir):
    """How soon each rollout's thinking comes near the first 60 characters of its document."""
    from .catalogue import docs

    ref = docs(spark, sf_dir).select(F.col("doc_id").alias("rollout_id"), F.substring("t", 1, 60).alias("ref"))
    df = registry.score(rollouts(spark, sf_dir).join(ref, "rollout_id"), ["convergence"], answer="ref")
    return df.select("rollout_id", r6("convergence").alias("convergence"))


@query("score_phase_aware", f"with {BASE} select rollout_id, round((case when th <> '' then 0.3 * p(th2) + 0.7 * p(x) else p(x) end)::double, 6) anti_gaming from (select *, '<think>' || th || '</think>' th2 from a1)".replace("p(th2)", "(case when length(th2) < 10 then 0 when (length(th2) - length(regexp_replace(lower(th2), '[aeiou]', '', 'g'))) / length(th2) < 0.15 then 0 else 1 end)").replace("p(x)", "(case when length(x) < 10 then 0 when (length(x) - length(regexp_replace(lower(x), '[aeiou]', '', 'g'))) / length(x) < 0.15 then 0 when contains(x, '<think></think>') then 0 else 1 end)"))
def score_phase_aware(spark, sf_dir):
    """The gaming test of thinking and answer apart."""
    scorer = r1.phase_aware(registry.get("anti_gaming"))
    return rollouts(spark, sf_dir).select("rollout_id", r6(scorer(F.col("prompt"), F.col("completion"), F.col("answer"), F.col("type"))).alias("anti_gaming"))


@query("score_parsed_code", None)
def score_parsed_code(spark, sf_dir):
    return registry.score(samples(spark, sf_dir), ["parsed_code"]).select("sample_id", "parsed_code")


VALUES = ", ".join(f"({quoted(k)}, {', '.join(str(x / sum(v)) for x in v)})" for k, v in r1.TYPE_WEIGHTS.items())


@query("type_weights", f"with {ROLLOUTS}, w(kind, {', '.join(r1.SCORES)}) as (values {VALUES}) select type, " + ", ".join(f"round(any_value(coalesce(w.{s}, {v / sum(r1.DEFAULT_WEIGHTS)}))::double, 6) {s}" for s, v in zip(r1.SCORES, r1.DEFAULT_WEIGHTS)) + " from r left join w on kind = type group by 1")
def type_weights(spark, sf_dir):
    kinds = rollouts(spark, sf_dir).select("type").distinct()
    return kinds.select("type", *(r6(w).alias(k) for k, w in r1.weights_of(F.col("type")).items()))
