"""Queries of run reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitor as mon, reports as rep, sampling as smp
from .catalogue import STATUS, docs, events, query, r6, t_
from .rollouts import table
from .samples import SQL as SAMPLES, samples

ORDER = ["ts", "event_id"]


@query("sparkline", f"with k as (select *, row_number() over (partition by event_type order by ts desc, event_id desc) rn from events), v as (select event_type, array_agg(round(value, 2) order by ts, event_id) v from k where rn <= 10 group by 1), m as (select *, list_min(v) lo, list_max(v) hi from v) select event_type, case when lo = hi then repeat('{rep.GLYPHS[4]}', 10) else array_to_string([substr('{rep.GLYPHS}', greatest(0, least(7, trunc((x - lo) / (hi - lo) * 7)::int)) + 1, 1) for x in list_concat([v[1] for i in range(10 - len(v))], v)], '') end line from m")
def sparkline(spark, sf_dir):
    return rep.sparklines(events(spark, sf_dir).withColumn("value", F.round("value", 2)), "event_type", ORDER, "value")


@query("monitor_summary", f"with s as (select *, {STATUS} status from events) select event_type, round(max(value), 6) best, round(arg_max(value, (ts, event_id)), 6) final, count(*) filter (status = 'WARNING') warnings, count(*) filter (status = 'CRITICAL') criticals from s group by 1")
def monitor_summary(spark, sf_dir):
    df = rep.metric_summary(events(spark, sf_dir).withColumn("status", mon.status(F.col("value"), 60, 20)), "event_type", ORDER, "value")
    return df.select("event_type", r6("best").alias("best"), r6("final").alias("final"), "warnings", "criticals")


@query("curriculum_summary", "with d as (select user_id % 5 level, date_trunc('day', ts)::date as day, avg(value) r from events group by all), p as (select level, array_agg(r order by day) v, count(*) n, min(day) f, max(day) t from d group by 1), h as (select *, case when n >= 4 then list_avg(v[1:n // 2]) else v[1] end a, case when n >= 4 then list_avg(v[n // 2 + 1:]) else v[-1] end b from p where n > 1) select level, round(v[1], 6) \"first\", round(v[-1], 6) \"last\", round(a, 6) first_half, round(b, 6) second_half, round(b - a, 6) improvement, case when b > a then 'improving' else 'stable_or_declining' end trend, n, f::varchar \"from\", t::varchar \"to\" from h")
def curriculum_summary(spark, sf_dir):
    daily = events(spark, sf_dir).groupBy((F.col("user_id") % 5).alias("level"), F.to_date("ts").alias("day")).agg(F.avg("value").alias("r"))
    df = rep.curriculum_summary(daily, "level", "day", "r")
    return df.select("level", *(r6(c).alias(c) for c in ("first", "last", "first_half", "second_half", "improvement")), "trend", "n", F.col("from").cast("string").alias("from"), F.col("to").cast("string").alias("to"))


BINS = ", ".join(f"count(*) filter (v >= {i / 5} and v {'<' if i < 4 else '<='} {(i + 1) / 5}) bin{i}" for i in range(5))


@query("batch_summary", f"with x as (select event_type, value / 100 v from events) select event_type, count(*) n, count(*) filter (v > 0.5) correct, round(avg(v), 6) mean, round(stddev_pop(v), 6) std, round(min(v), 6) least, round(max(v), 6) most, round(median(v), 6) median, {BINS} from x group by 1")
def batch_summary(spark, sf_dir):
    x = events(spark, sf_dir).withColumn("v", F.col("value") / 100)
    df = rep.batch_summary(x, ["event_type"], "v", F.col("v") > 0.5)
    return df.select("event_type", "n", "correct", *(r6(c).alias(c) for c in ("mean", "std", "least", "most", "median")), *(f"bin{i}" for i in range(5)))


@query("group_spreads", "with s as (select user_id, max(value) - min(value) s from events group by 1 having count(*) > 1) select count(*) groups, round(avg(s), 6) mean_spread, round(min(s), 6) least_spread, round(max(s), 6) most_spread from s")
def group_spreads(spark, sf_dir):
    return rep.group_spreads(events(spark, sf_dir), "user_id", "value").select("groups", *(r6(c).alias(c) for c in ("mean_spread", "least_spread", "most_spread")))


@query("ranking_signal", "with x as (select event_id, user_id, floor(value) / 1000 v from events), s as (select *, min(v) over g lo, max(v) over g hi, count(*) over g n, row_number() over (partition by user_id order by v, event_id) - 1 rk from x window g as (partition by user_id)), m as (select *, v + rk * (0.05 / n) mv from s), e as (select *, min(mv) over g a, max(mv) over g b from m window g as (partition by user_id)) select event_id, round(case when n > 1 and hi - lo < 0.05 then case when b > a then lo + (mv - a) * (hi - lo) / (b - a + 1e-8) else mv end else v end, 6) adjusted from e")
def ranking_signal(spark, sf_dir):
    x = events(spark, sf_dir).select("event_id", "user_id", (F.floor("value") / 1000).alias("v"))
    return rep.ranking_signal(x, "user_id", "event_id", "v").select("event_id", r6("adjusted").alias("adjusted"))


TOOL = "coalesce(raw in ('tool_call', 'tool', 'function_calling', 'func'), false)"


@query("answer_audit", rf"with {SAMPLES}, f as (select *, case when contains(a, '<tool_call>') and contains(a, '</tool_call>') then 'hermes' when regexp_matches(a, '(?s)^\s*\w+\(.*\)\s*$') then 'python_call' when contains(a, '<think>') or contains(a, '</think>') then 'thinking' else 'other' end f from s) select coalesce(raw, 'unknown') as type, f format, count(*) n, count(*) filter ({TOOL} and (contains(a, '<think>') or contains(a, '</think>'))) thinking_calls, count(*) filter ({TOOL} and f = 'python_call') plain_calls from f group by all")
def answer_audit(spark, sf_dir):
    return rep.audited(samples(spark, sf_dir))


@query("iteration_counts", "select lang, 3 * ceil(count(*) / 16)::bigint iterations from documents group by 1")
def iteration_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(rep.iterations(F.count(F.lit(1)), 16, 3).alias("iterations"))


@query("layer_specs", "with x as (select vec_id, case vec_id % 3 when 0 then 'all' else (vec_id % 8) || '-' || (vec_id % 8 + vec_id % 5) || ',20, 31 - 40' end spec from embeddings), p as (select vec_id, spec, unnest(case when spec = 'all' then ['0-31'] else string_split(spec, ',') end) p from x), l as (select distinct vec_id, unnest(range(trim(split_part(p, '-', 1))::int, trim(case when contains(p, '-') then split_part(p, '-', 2) else p end)::int + 1)) l from p) select vec_id, string_agg(l::varchar, ',' order by l) layers from l where l between 0 and 31 group by 1")
def layer_specs(spark, sf_dir):
    i = F.col("vec_id")
    spec = F.when(i % 3 == 0, "all").otherwise(F.concat((i % 8).cast("string"), F.lit("-"), (i % 8 + i % 5).cast("string"), F.lit(",20, 31 - 40")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(rep.layers(spec, 32).cast("array<string>"), ",").alias("layers"))


@query("gradient_projection", "with x as (select vec_id, embedding::double[] e, lead(embedding::double[]) over (partition by label order by vec_id) f from embeddings), y as (select vec_id, [e[i] + 0.1 * f[i] for i in range(1, len(e) + 1)] p from x where f is not null) select vec_id, round(sqrt(list_dot_product(p, p)), 4) norm from y")
def gradient_projection(spark, sf_dir):
    from pyspark.sql import Window

    df = table(spark, sf_dir, "embeddings").withColumn("f", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).where("f is not null")
    p = rep.projected(F.col("embedding").cast("array<double>"), F.col("f").cast("array<double>"), 0.1)
    return df.select("vec_id", F.round(F.sqrt(F.aggregate(p, F.lit(0.0), lambda s, v: s + v * v)), 4).alias("norm"))


@query("nearest_length", f"with d as (select doc_id, len({t_("coalesce(text, '')")}) n from documents), x as (select doc_id, floor(n / 64)::bigint b from d), t as (select item_id want, len({t_("coalesce(text, '')")}) l from benchmark), u as (select distinct l * 64 want, l t from t), m as (select want, doc_id, b, abs(b - floor(want / 64)) away from u join x on abs(b - floor(want / 64)) <= 9), r as (select *, row_number() over (partition by want order by away, b desc, doc_id) place from m) select want::bigint want, place::int place, doc_id, away::bigint away from r where place <= 10")
def nearest_length(spark, sf_dir):
    """For lengths made from benchmark items, the ten documents whose length bucket is nearest."""
    from ..functions import text as tx

    d = docs(spark, sf_dir).select("doc_id", F.size(tx.tok(F.col("t"))).alias("n"))
    target = table(spark, sf_dir, "benchmark").select((F.size(tx.tok(F.coalesce("text", F.lit("")))) * 64).cast("long").alias("want")).distinct()
    return rep.nearest_by_length(d, "doc_id", "n", target)


@query("props_json", "select event_type, count(*) n, count(*) filter (json_valid(props)) valid, count(distinct json_extract_string(props, '$.k')) kinds, max(try_cast(json_extract_string(props, '$.k') as bigint)) most from events group by 1")
def props_json(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.try_parse_json("props").isNotNull()).alias("valid"), F.countDistinct(k).alias("kinds"), F.max(k.try_cast("long")).alias("most"))


@query("percent_slices", "with x as (select doc_id, row_number() over (order by doc_id) rn, count(*) over () n from documents) select doc_id, rn <= round_even(n * 0.8, 0) train, rn > n - round_even(n * 0.1, 0) valid from x")
def percent_slices(spark, sf_dir):
    """Which documents the slices train[:80%] and train[-10%:] take."""
    from ..sources.loader import slice_bounds

    df = table(spark, sf_dir, "documents").select("doc_id")
    n = df.count()
    rows = smp.numbered(df, [F.col("doc_id")])
    inside = lambda spec: F.col("rn").between(*(lambda b: (b[0] + 1, b[1]))(slice_bounds(spec, n)[1:]))
    return rows.select("doc_id", inside("train[:80%]").alias("train"), inside("train[-10%:]").alias("valid"))


@query("ncd_similarity", None)
def ncd_similarity(spark, sf_dir):
    """Normalised compression distance of each turn and the next."""
    from ..functions.pyfuncs import compression_distance
    from .features import neighbours

    return neighbours(spark, sf_dir).select("conv_id", "turn", r6(compression_distance("a", "b")).alias("distance"))


@query("hermes_conversion", None)
def hermes_conversion(spark, sf_dir):
    """Answers converted to tagged calls; those already tagged or not calls stay."""
    from ..functions.pyfuncs import to_hermes

    return samples(spark, sf_dir).select("sample_id", to_hermes("answer").alias("converted"))

