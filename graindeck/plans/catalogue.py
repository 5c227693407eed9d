"""The queries of the engine by name, and the SQL that says what each returns. Doubles are rounded on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import registry, structure as st, text as tx
from ..operators import advantage as adv, monitor as mon, policy as pol, sampling as smp, scoring
from .rollouts import SQL as ROLLOUTS, rollouts, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return wrap


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def r6(c):
    return F.round(c, 6)


# ---- SQL of the pieces that several oracles share
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
TOK = r"list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda x: x <> '')"


def s_(x: str) -> str:
    return STRIP.format(x)


def t_(x: str) -> str:
    return TOK.format(x)


AFTER = "substr(c, instr(c, '</think>') + 8)"
ORDERED = "(contains(c, '<think>') and contains(c, '</think>') and instr(c, '<think>') < instr(c, '</think>'))"
ANSWER = f"case when contains(c, '</think>') then {s_(AFTER)} when contains(c, '<think>') then '' else {s_('c')} end"
BOX = r"nullif(regexp_extract({0}, '\\boxed\{{([^{{}}]*)\}}', 1), '')"
THINKING = rf"case when regexp_matches(c, '(?s)<think>.*?</think>') then {s_(chr(39).join(['regexp_extract(c, ', '(?s)<think>(.*?)</think>', ', 1)']))} end"
FORMAT = f"case when {ORDERED} and length({s_(AFTER)}) >= 5 then 1.0 else 0.0 end"
TAGS = "case when len(string_split(c, '<think>')) = 2 and len(string_split(c, '</think>')) = 2 and instr(c, '<think>') < instr(c, '</think>') then 1.0 else 0.0 end"
ACCURACY = f"case when lower(coalesce({BOX.format('(' + ANSWER + ')')}, {ANSWER})) = lower(answer) then 1.0 else 0.0 end"


def band(n: str, b) -> str:
    least, low, high, most = b
    return f"case when {n} < {least} then greatest(0.2, {n} / {least}.0) when {n} between {low} and {high} then 1.0 when {n} <= {most} then 1.0 - 0.3 * ({n} - {high}) / {most - high}.0 else greatest(0.1, 0.7 - 0.4 * least(({n} - {most}) / {most}.0, 3.0)) end"


CONCISE = "least(1.0, case when length(" + s_("c") + ") < 10 then 0.0 else case type " + " ".join(f"when '{k}' then {band('n', b)}" for k, b in scoring.BANDS.items()) + f" else {band('n', scoring.OTHER_BAND)} end end)"
SCORED = f"with {ROLLOUTS}, rn as (select *, len({t_('c')}) n from r), s as (select *, ({FORMAT})::double f, ({TAGS})::double g, ({ACCURACY})::double a, ({CONCISE})::double k from rn)"
TOTAL = "(0.5 * a + 0.2 * f + 0.1 * g + 0.2 * k)"
WEIGHTS = {"accuracy": 0.5, "format": 0.2, "tag_structure": 0.1, "conciseness": 0.2}


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.score(rollouts(spark, sf_dir), list(WEIGHTS)).withColumn("reward", adv.weighted(WEIGHTS))


def per_rollout(spark, sf_dir, *names: str) -> DataFrame:
    df = registry.score(rollouts(spark, sf_dir), list(names))
    return df.select("rollout_id", *(r6(n).alias(n) for n in names))


# ---- rewards, advantages and their statistics
@query("group_advantage", f"{SCORED} select rollout_id, prompt_idx, round({TOTAL}, 6) reward, round(case when count(*) over w > 1 then ({TOTAL} - avg({TOTAL}) over w) / (stddev_pop({TOTAL}) over w + 1e-4) else 0 end, 5) advantage from s window w as (partition by prompt_idx)")
def group_advantage(spark, sf_dir):
    return adv.advantages(scored(spark, sf_dir), "prompt_idx").select("rollout_id", "prompt_idx", r6("reward").alias("reward"), F.round("advantage", 5).alias("advantage"))


@query("reward_function_stats", f"{SCORED}, x as (select unnest([{{'scorer': 'accuracy', 'v': a}}, {{'scorer': 'format', 'v': f}}, {{'scorer': 'tag_structure', 'v': g}}, {{'scorer': 'conciseness', 'v': k}}]) x from s) select x.scorer scorer, round(avg(x.v), 6) mean, round(stddev_pop(x.v), 6) std, round(count(x.v) / count(*), 6) coverage from x group by 1")
def reward_function_stats(spark, sf_dir):
    return adv.function_stats(scored(spark, sf_dir), list(WEIGHTS)).select("scorer", r6("mean").alias("mean"), r6("std").alias("std"), r6("coverage").alias("coverage"))


@query("grouped_reward_stats", f"{SCORED} select prompt_idx, round(avg({TOTAL}), 6) mean, round(stddev_pop({TOTAL}), 6) std, count(*) n from s group by 1")
def grouped_reward_stats(spark, sf_dir):
    return adv.group_stats(scored(spark, sf_dir), "prompt_idx").select("prompt_idx", r6("mean").alias("mean"), r6("std").alias("std"), "n")


@query("scaffold_penalty", f"{SCORED} select rollout_id, round({TOTAL} * (1 - scaffold * 0.3), 6) multiplicative, round({TOTAL} - scaffold * 0.3, 6) additive from s")
def scaffold_penalty(spark, sf_dir):
    df = scored(spark, sf_dir)
    return df.select("rollout_id", *(r6(adv.penalized(F.col("reward"), F.col("scaffold"), 0.3, m)).alias(m) for m in ("multiplicative", "additive")))


@query("reward_ranking", f"{SCORED} select rollout_id, prompt_idx, row_number() over (partition by prompt_idx order by round({TOTAL}, 6) desc, rollout_id) ranking from s")
def reward_ranking(spark, sf_dir):
    return adv.ranked(scored(spark, sf_dir).withColumn("reward", r6("reward")), "prompt_idx", "rollout_id").select("rollout_id", "prompt_idx", F.col("ranking").cast("long").alias("ranking"))


@query("score_format_family", f"{SCORED} select rollout_id, f as format, g as tag_structure, (case when contains(c, '<think>') then 0.25 else 0 end + case when contains(c, '</think>') then 0.25 else 0 end + case when contains(c, '</think>') and length({s_(chr(39).join(['list_extract(string_split(c, ', '</think>', '), -1)']))}) > 0 then 0.5 else 0 end)::double count_tags, (case when contains(c, '<think>') and contains(c, '</think>') then 1 else 0 end)::double soft_format, (case when regexp_matches({s_('c')}, '(?s)^<think>\\n.*?\\n</think>\\n') then 1 else 0 end)::double strict_format from s")
def score_format_family(spark, sf_dir):
    return per_rollout(spark, sf_dir, "format", "tag_structure", "count_tags", "soft_format", "strict_format")


@query("score_conciseness", f"{SCORED} select rollout_id, round(k, 6) conciseness from s")
def score_conciseness(spark, sf_dir):
    return per_rollout(spark, sf_dir, "conciseness")


@query("score_accuracy_boxed", f"{SCORED} select rollout_id, a accuracy from s")
def score_accuracy_boxed(spark, sf_dir):
    return per_rollout(spark, sf_dir, "accuracy")


@query("score_anti_gaming", f"with {ROLLOUTS} select rollout_id, (case when length(c) < 10 then 0 when (length(c) - length(regexp_replace(lower(c), '[aeiou]', '', 'g'))) / length(c) < 0.15 then 0 when contains(c, '<think></think>') then 0 else 1 end)::double anti_gaming from r")
def score_anti_gaming(spark, sf_dir):
    return per_rollout(spark, sf_dir, "anti_gaming")


@query("score_thinking_length", f"with {ROLLOUTS}, q as (select rollout_id, {THINKING} th from r), n as (select rollout_id, coalesce(th, '') th, len({t_('th')}) n from q) select rollout_id, round((case when th = '' then 0 else least(1.0, case when n < 20 then greatest(0.3, n / 20.0) when n > 80 then greatest(0.5, 1.0 - 0.2 * (n - 80) / 80.0) when n between 30 and 60 then 1.1 else 1.0 end) end)::double, 6) thinking_length from n")
def score_thinking_length(spark, sf_dir):
    return per_rollout(spark, sf_dir, "thinking_length")


@query("score_thinking_quality", None)
def score_thinking_quality(spark, sf_dir):
    return per_rollout(spark, sf_dir, "thinking_quality")


@query("score_general_qna", None)
def score_general_qna(spark, sf_dir):
    return per_rollout(spark, sf_dir, "qna_correctness", "qna_format", "general_qna")


@query("score_integer_answer", f"with {ROLLOUTS} select rollout_id, (case when regexp_matches({ANSWER}, '^[0-9]+$') then 0.5 else 0 end)::double integer_answer from r")
def score_integer_answer(spark, sf_dir):
    return per_rollout(spark, sf_dir, "integer_answer")


@query("type_distribution", f"{SCORED} select type, count(*) n, round(count(*) / sum(count(*)) over (), 6) share, round(count(*) filter ({TOTAL} > 0.5) / count(*), 6) accuracy from s group by 1")
def type_distribution(spark, sf_dir):
    by = scored(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reward") > 0.5).alias("h"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row for each type
    return by.select("type", "n", r6(F.col("n") / F.sum("n").over(every)).alias("share"), r6(F.col("h") / F.col("n")).alias("accuracy"))


@query("score_histogram", f"{SCORED}, h as (select least(4, floor(round({TOTAL}, 6) * 5))::int bin from s) select bin, count(*) n from h group by 1")
def score_histogram(spark, sf_dir):
    return scored(spark, sf_dir).groupBy(F.least(F.lit(4), F.floor(r6("reward") * 5)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("completion_corruption", None)
def completion_corruption(spark, sf_dir):
    return rollouts(spark, sf_dir).select("rollout_id", F.array_join(scoring.corruption_reasons(F.col("completion")), ",").alias("reasons"))


@query("accuracy_at_half", f"{SCORED} select quality, count(*) n, round(count(*) filter ({TOTAL} > 0.5) / count(*), 6) accuracy from s join labels on doc_id = rollout_id group by 1")
def accuracy_at_half(spark, sf_dir):
    df = scored(spark, sf_dir).join(table(spark, sf_dir, "labels"), F.col("rollout_id") == F.col("doc_id"))
    return df.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), r6(F.count_if(F.col("reward") > 0.5) / F.count(F.lit(1))).alias("accuracy"))


# ---- text features
DOCS = "d as (select doc_id, coalesce(text, '') t from documents), k as (select doc_id, t, " + t_("t") + " w from d)"


def docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))


@query("token_estimate", f"with {DOCS} select doc_id, trunc((length(t) / 4.0::double + len(w) * 1.3::double) / 2)::int tokens from k")
def token_estimate(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.token_estimate(F.col("t")).alias("tokens"))


@query("unique_token_ratio", f"with {DOCS} select doc_id, round(case when len(w) = 0 then 1.0 else len(list_distinct(w)) / len(w) end::double, 6) ratio from k")
def unique_token_ratio(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", r6(tx.let(tx.tok(F.col("t")), lambda w: tx.unique_ratio(w))).alias("ratio"))


@query("ngram_repetition", f"with {DOCS}, g as (select doc_id, len(w) n, [array_to_string(w[i:i+2], ' ') for i in range(1, len(w) - 1)] g from k) select doc_id, round(case when n < 4 then 0 else least(1.0, 3.0 * (len(g) - len(list_distinct(g))) / n) end::double, 6) repetition from g")
def ngram_repetition(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", r6(tx.let(tx.tok(F.col("t")), lambda w: tx.ngram_repetition(w, 3))).alias("repetition"))


@query("word_entropy", f"with {DOCS}, x as (select doc_id, unnest(w) w from k), c as (select doc_id, w, count(*) n from x group by all), e as (select doc_id, sum(n) total, count(*) vocabulary, sum(n * log2(n)) s from c group by 1) select doc_id, round(log2(total) - s / total, 6) entropy, vocabulary, round(case when vocabulary > 1 then (log2(total) - s / total) / log2(vocabulary) else 0 end, 6) density from e")
def word_entropy(spark, sf_dir):
    """A row's words are sorted and folded in place: no shuffle."""
    m = tx.let(tx.tok(F.col("t")), lambda w: F.struct(st.entropy_of(w).alias("h"), F.size(F.array_distinct(w)).cast("long").alias("v"), F.size(w).alias("n")))
    e = docs(spark, sf_dir).select("doc_id", m.alias("m")).where("m.n > 0")
    return e.select("doc_id", r6("m.h").alias("entropy"), F.col("m.v").alias("vocabulary"), r6(F.when(F.col("m.v") > 1, F.col("m.h") / F.log2("m.v")).otherwise(0.0)).alias("density"))


@query("char_entropy", "with x as (select doc_id, unnest(string_split(coalesce(text, ''), '')) ch from documents where coalesce(text, '') <> ''), c as (select doc_id, ch, count(*) n from x group by all), e as (select doc_id, sum(n) total, sum(n * log2(n)) s from c group by 1) select doc_id, round(log2(total) - s / total, 6) entropy from e")
def char_entropy(spark, sf_dir):
    return docs(spark, sf_dir).where("t <> ''").select("doc_id", r6(tx.let(st.characters(F.col("t")), st.entropy_of)).alias("entropy"))


@query("info_gain_per_token", f"with {DOCS}, x as (select doc_id, w, generate_subscripts(w, 1) i from k), y as (select doc_id, w[i] w, i - 1 i from x), z as (select doc_id, i, row_number() over (partition by doc_id, w order by i) - 1 seen from y) select doc_id, round(sum(case when seen = 0 then log2(i + 1) else log2(i::double / seen) end) / count(*), 5) gain from z where i > 0 group by 1")
def info_gain_per_token(spark, sf_dir):
    d = docs(spark, sf_dir).where(F.size(tx.tok(F.col("t"))) > 1)
    return d.select("doc_id", F.round(st.gain_per_token(F.col("t")), 5).alias("gain"))


@query("jaccard_neighbours", r"with x as (select turn, conv_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\w\p{L}\p{M}\p{N}]+')) w, lead(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\w\p{L}\p{M}\p{N}]+'))) over (partition by conv_id order by turn) v from conversations) select conv_id, turn, round(case when len(w) = 0 or len(v) = 0 then 0 else len(list_intersect(w, v)) / len(list_distinct(list_concat(w, v))) end::double, 6) jaccard from x where v is not null")
def jaccard_neighbours(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = table(spark, sf_dir, "conversations").withColumn("w", tx.word_set(F.coalesce("text", F.lit("")))).withColumn("v", F.lead("w").over(w)).where("v is not null")
    return x.select("conv_id", "turn", r6(tx.jaccard(F.col("w"), F.col("v"))).alias("jaccard"))


@query("curriculum_prefix", "with x as (select doc_id, string_split(coalesce(text, ''), chr(10)) l from documents) select doc_id, length(array_to_string(l[1:greatest(1, trunc(len(l) * 0.5)::int)], chr(10))) n_chars, md5(array_to_string(l[1:greatest(1, trunc(len(l) * 0.5)::int)], chr(10))) digest from x")
def curriculum_prefix(spark, sf_dir):
    cut = tx.truncated_lines(F.col("t"), F.lit(0.5))
    return docs(spark, sf_dir).select("doc_id", F.length(cut).cast("long").alias("n_chars"), F.md5(cut).alias("digest"))


# ---- loading
@query("dataset_union", "select _dataset, count(*) n, sum(length(text))::bigint chars from (select 'benchmark' _dataset, text from benchmark union all select 'documents', text from documents) group by 1")
def dataset_union(spark, sf_dir):
    frames = {n: table(spark, sf_dir, n).select("text") for n in ("benchmark", "documents")}
    return smp.union_tagged(frames).groupBy("_dataset").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("conversation_history", "select conv_id, count(*) n, string_agg(role || ':' || length(text), '|' order by turn) messages from conversations group by 1")
def conversation_history(spark, sf_dir):
    one = F.struct("turn", F.concat("role", F.lit(":"), F.length("text").cast("string")).alias("m"))
    messages = F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x.m), "|")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), messages.alias("messages"))


@query("conversation_pairs", "select * from (select conv_id, turn, length(text) n_prompt, case when lead(role) over w = 'assistant' then length(lead(text) over w) end n_answer, role from conversations window w as (partition by conv_id order by turn)) where role = 'user' and n_answer is not null")
def conversation_pairs(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    df = table(spark, sf_dir, "conversations").withColumns({"n_prompt": F.length("text").cast("long"), "n_answer": F.when(F.lead("role").over(w) == "assistant", F.length(F.lead("text").over(w)).cast("long"))})
    return df.where("role = 'user' and n_answer is not null").select("conv_id", "turn", "n_prompt", "n_answer", "role")


# ---- samplers
@query("balanced_interleave", "with c as (select lang, count(*) n from documents group by 1), t as (select lang, greatest(1, round_even(n / sum(n) over () * count(*) over (), 0))::int take from c), k as (select doc_id, lang, row_number() over (partition by lang order by doc_id) k from documents) select doc_id, lang, k, floor((k - 1) / take)::bigint as round from k join t using (lang)")
def balanced_interleave(spark, sf_dir):
    return smp.balanced_interleave(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", F.col("doc_id")).select("doc_id", "lang", F.col("k").cast("long").alias("k"), "round")


@query("length_batches", "with x as (select doc_id, length(coalesce(text, '')) length from documents), y as (select *, floor((row_number() over (order by length, doc_id) - 1) / 16)::bigint batch from x) select * from y where batch < (select count(*) // 16 from x)")
def length_batches(spark, sf_dir):
    df = docs(spark, sf_dir).withColumn("length", F.length("t").cast("long")).drop("t")
    return smp.length_batches(df, F.col("length"), "doc_id", 16)


@query("length_buckets", f"with {DOCS} select floor(len(w) / 64)::bigint bucket, count(*) n from k group by 1")
def length_buckets(spark, sf_dir):
    return smp.length_buckets(docs(spark, sf_dir), F.size(tx.tok(F.col("t"))))


@query("cross_sample_pairs", "with x as (select conv_id, turn, role from conversations) select conv_id, turn, role, coalesce(lead(conv_id) over w, first_value(conv_id) over w) paired from x where turn = 1 window w as (partition by role order by conv_id)")
def cross_sample_pairs(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").where("turn = 1").select("conv_id", "turn", "role")
    return smp.shifted_pairs(df, "role", F.col("conv_id"), "conv_id")


@query("percent_split", "with x as (select doc_id, row_number() over (order by doc_id) rn, count(*) over () n from documents) select doc_id, case when rn <= trunc(n * 0.1) then 'test' when rn <= trunc(n * 0.1) + trunc(n * 0.1) then 'valid' else 'train' end split from x")
def percent_split(spark, sf_dir):
    return smp.percent_split(table(spark, sf_dir, "documents").select("doc_id"), [F.col("doc_id")], 0.1, 0.1)


@query("checkpoint_retention", "with a as (select o_orderkey, o_totalprice from orders order by o_orderkey desc limit 5), b as (select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 5) select * from a union select * from b")
def checkpoint_retention(spark, sf_dir):
    return smp.retained(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", 5, 5)


# ---- monitoring
def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", "value", "ts", "user_id", "props")


STATUS = "case when value is null then 'UNKNOWN' when value > 60 then 'GOOD' when value >= 20 then 'WARNING' else 'CRITICAL' end"


@query("monitor_status", f"select event_type, {STATUS} status, count(*) n from events group by all")
def monitor_status(spark, sf_dir):
    return events(spark, sf_dir).withColumn("status", mon.status(F.col("value"), 60, 20)).groupBy("event_type", "status").agg(F.count(F.lit(1)).alias("n"))


@query("consecutive_criticals", f"with s as (select event_id, event_type, ts, {STATUS} status from events), i as (select *, sum(case when status <> 'CRITICAL' then 1 else 0 end) over (partition by event_type order by ts, event_id) island from s), r as (select *, sum(case when status = 'CRITICAL' then 1 else 0 end) over (partition by event_type, island order by ts, event_id) run from i) select event_type, max(run)::bigint longest, count(*) filter (run = 3)::bigint stops from r group by 1")
def consecutive_criticals(spark, sf_dir):
    df = mon.consecutive(events(spark, sf_dir).withColumn("status", mon.status(F.col("value"), 60, 20)), "event_type", ["ts", "event_id"])
    return df.groupBy("event_type").agg(F.max("run").alias("longest"), F.count_if(F.col("run") == 3).alias("stops"))


@query("best_so_far", "select event_id, round(max(value) over (partition by event_type order by ts, event_id rows unbounded preceding), 6) best from events")
def best_so_far(spark, sf_dir):
    return mon.best_so_far(events(spark, sf_dir), "event_type", ["ts", "event_id"], "value").select("event_id", r6("best").alias("best"))


@query("trend", "with w as (select event_id, array_agg(round(value, 2)) over (partition by event_type order by ts, event_id rows 4 preceding) l from events), h as (select event_id, len(l) n, list_avg(l[len(l) // 2 + 1:]) - list_avg(l[1:len(l) // 2]) d from w) select event_id, case when n < 2 then 'flat' when d > 0.01 + 1e-9 then 'up' when d < -0.01 - 1e-9 then 'down' else 'flat' end trend from h")
def trend(spark, sf_dir):
    return mon.trend(events(spark, sf_dir).withColumn("value", F.round("value", 2)), "event_type", ["ts", "event_id"], "value", limit=0.01 + 1e-9).select("event_id", "trend")


@query("curriculum_schedule", "select event_id, round(case when event_id < 100 then 0.85 when event_id >= 600 then 0.25 else 0.85 + (event_id - 100) / 500.0 * (0.25 - 0.85) end::double, 6) ratio from events")
def curriculum_schedule(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", r6(mon.curriculum_ratio(F.col("event_id"))).alias("ratio"))


@query("curriculum_progress", "select date_trunc('day', ts)::date as day, user_id % 5 level, round(avg(value), 6) mean, round(coalesce(stddev_samp(value), 0), 6) std, count(*) n from events group by all")
def curriculum_progress(spark, sf_dir):
    df = events(spark, sf_dir).withColumns({"day": F.to_date("ts"), "level": F.col("user_id") % 5})
    return mon.curriculum_progress(df, "day", "level", "value").select("day", "level", r6("mean").alias("mean"), r6("std").alias("std"), "n")


@query("iteration_rollup", "select event_type, date_trunc('day', ts)::date as day, count(*) n, round(avg(value), 6) mean, round(min(value), 6) least, round(max(value), 6) most from events group by grouping sets ((event_type, day), (event_type), ())")
def iteration_rollup(spark, sf_dir):
    v = F.col("value")
    return events(spark, sf_dir).withColumn("day", F.to_date("ts")).rollup("event_type", "day").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(v)).alias("mean"), r6(F.min(v)).alias("least"), r6(F.max(v)).alias("most"))


# ---- policy and vectors
@query("policy_stats", "with x as (select event_type, (value - 50) / 100 lr, case when event_id % 2 = 0 then 1.0 else -1.0 end a from events), y as (select *, exp(lr) ratio, exp(-lr) + lr - 1 kl from x) select event_type, count(*) tokens, round(avg(ratio), 6) ratio, round(avg((ratio < 0.8 and a < 0)::int), 6) clipped_low, round(avg((ratio > 1.2 and a > 0)::int), 6) clipped_high, round(avg(kl), 6) kl, round(avg(-least(ratio * a, greatest(0.8, least(1.2, ratio)) * a) + 0.1 * kl), 6) loss from y group by 1")
def policy_stats(spark, sf_dir):
    a = F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(-1.0)
    df = pol.policy_stats(events(spark, sf_dir), "event_type", (F.col("value") - 50) / 100, a)
    return df.select("event_type", "tokens", *(r6(c).alias(c) for c in ("ratio", "clipped_low", "clipped_high", "kl", "loss")))


@query("weighted_eval_metrics", "select l_returnflag, l_linestatus, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) price from lineitem group by all")
def weighted_eval_metrics(spark, sf_dir):
    df = pol.weighted_mean(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_quantity", "price")
    return df.withColumn("price", F.round("price", 4))


@query("vector_alignment", "with x as (select label, vec_id, embedding::double[] e, lead(embedding::double[]) over (partition by label order by vec_id) f from embeddings) select vec_id, round(sqrt(list_dot_product(e, e)), 5) norm_a, round(sqrt(list_dot_product(f, f)), 5) norm_b, round(list_dot_product(e, f) / sqrt(list_dot_product(e, e) * list_dot_product(f, f)), 5) cosine from x where f is not null")
def vector_alignment(spark, sf_dir):
    w = Window.partitionBy("label").orderBy("vec_id")
    df = table(spark, sf_dir, "embeddings").withColumn("f", F.lead("embedding").over(w)).where("f is not null")
    return df.select("vec_id", *(F.round(v, 5).alias(k) for k, v in pol.alignment(F.col("embedding"), F.col("f")).items()))


@query("fuzzy_similarity", None)
def fuzzy_similarity(spark, sf_dir):
    from ..functions.pyfuncs import fuzzy_ratio

    w = Window.partitionBy("conv_id").orderBy("turn")
    df = table(spark, sf_dir, "conversations").withColumn("other", F.lead("text").over(w)).where("other is not null")
    return df.select("conv_id", "turn", r6(fuzzy_ratio("text", "other")).alias("ratio"))


@query("compression_ratio", None)
def compression_ratio(spark, sf_dir):
    from ..functions.pyfuncs import compression_ratio as ratio

    return docs(spark, sf_dir).select("doc_id", r6(ratio("t")).alias("ratio"))


from . import exams, features, legacy, levels, reports, typed  # noqa: E402, F401  their queries register themselves
