"""Exam scoring queries over samples, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exam
from .catalogue import TOK, query, r6, s_, t_
from .samples import SQL as SAMPLES, samples
from .typed import ascii_words, num, quoted

INNER = r"[^{}]*"
for _ in range(4):
    INNER = rf"(?:[^{{}}]|\{{{INNER}\}})*"
BOX = rf"(?is)^\\boxed\{{({INNER})\}}"


def boxed(x: str) -> str:
    return f"nullif({s_('regexp_extract(substr(' + x + ', instr(lower(' + x + '), ' + quoted(chr(92) + 'boxed{') + ')), ' + quoted(BOX) + ', 1)')}, '')"


def has_box(x: str) -> str:
    return f"instr(lower({x}), {quoted(chr(92) + 'boxed{')}) > 0"


def a_box(x: str) -> str:
    return f"case when {has_box(x)} then {boxed(x)} end"


def letters(x: str) -> str:
    return f"regexp_matches(replace({x}, 'and', ''), '^[A-Za-z\\s,&]+$')"


def normal(x: str) -> str:
    plain = rf"regexp_replace(regexp_replace({ascii_words(x)}, '(?i)\b(and|or)\b', ' ', 'g'), '(?i)\b(options?|answer|choice|choices|the|is|are)\s*', ' ', 'g')"
    found = f"list_sort(list_distinct(list_filter([upper(l) for l in regexp_split_to_array({plain}, '[^A-Za-z]+')], lambda l: regexp_matches(l, '^[A-F]$'))))"
    return f"case when regexp_matches({s_(x)}, {quoted(exam.PLAIN_NUMBER)}) or regexp_matches({s_(x)}, '^[-+]?\\d+/\\d+$') then {s_(x)} when len({found}) > 0 then array_to_string({found}, '') else {s_(x)} end"


def ladder(c: str, want: str) -> str:
    """want: SQL of whether letters are wanted."""
    last = s_(f"string_split({s_(c)}, chr(10))[-1]")
    take = lambda x, p: f"nullif(regexp_extract({x}, {quoted(p)}, 1), '')"
    shaped = lambda v: f"case when {want} and {letters(v)} then {normal(v)} else {v} end"
    wanted = lambda v: f"case when {want} then {normal(v)} else {v} end"
    said = take(c, r"(?i)(?:answer|the answer is)[:\s]+([A-Za-z](?:\s*[,&]?\s*(?:and\s+)?[A-Za-z])*)")
    tag = f"case when regexp_matches({c}, '(?is)<answer>.*?</answer>') then {s_('regexp_extract(' + c + ', ' + quoted('(?is)<answer>' + chr(92) + 's*(.*?)' + chr(92) + 's*</answer>') + ', 1)')} end"
    steps = [shaped(f"({a_box(c)})"), shaped(f"({tag})"), take(c, r"(?i)(?:answer|the answer is)[:\s]+([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)"), f"case when lower({said}) not in ('is', 'a', 'an', 'the') then {wanted(said)} end",
             wanted(take(c, r"(?i)\*\*([A-Za-z](?:\s*[,&]?\s*[A-Za-z])*)\*\*\s*\.?\s*$")), wanted(take(last, r"(?i)^([A-Za-z](?:\s*[,&]?\s*(?:and\s+)?[A-Za-z])*)\.?$")), wanted(take(last, r"(?i)^(?:options?\s+)?([A-Za-z](?:\s*(?:,|and|&)\s*(?:options?\s+)?[A-Za-z])*)\.?$"))]
    return f"case when not (starts_with(lower({s_(c)}), '<think>') and not contains(lower({c}), '</think>')) then coalesce({', '.join(steps)}) end"


CHARS = "list_distinct(list_filter(string_split({0}, ''), lambda ch: ch <> ''))"
ACCURACY = f"""{SAMPLES}, e1 as (select *, coalesce({ladder('a', 'true')}, {a_box('a')}) fa from s), e2 as (select *, case when {letters('a')} then a else coalesce(fa, a) end w from e1),
e3 as (select *, coalesce({letters('w')}, false) ex from e2), e4 as (select *, coalesce({ladder('c', 'ex')}, {a_box('c')}) g from e3),
e5 as (select *, case when ex then {normal('g')} else {s_('g')} end mine, case when ex then {normal('w')} else {s_('w')} end rt from e4), e6 as (select *, {CHARS.format('mine')} cm, {CHARS.format('rt')} cr from e5)"""


@query("exam_accuracy", f"with {ACCURACY} select sample_id, g extracted, round((case when g is null then 0 when mine = rt or lower({s_('g')}) = lower({s_('w')}) then 1 when ex and len(cr) > 1 and len(list_intersect(cm, cr)) > 0 then 2.0 * len(list_intersect(cm, cr)) / (len(cm) + len(cr)) else 0 end)::double, 6) accuracy from e6")
def exam_accuracy(spark, sf_dir):
    c, a = F.col("completion"), F.col("answer")
    found = F.coalesce(exam.extracted(a, F.lit(True)), exam.boxed(a))
    want = F.when(exam.all_letters(a), a).otherwise(F.coalesce(found, a))
    got = F.coalesce(exam.extracted(c, exam.all_letters(want)), exam.boxed(c))
    return samples(spark, sf_dir).select("sample_id", got.alias("extracted"), r6(exam.accuracy(c, a)).alias("accuracy"))


THOUGHTS = "list_concat(regexp_extract_all(c, '(?is)<think>(.*?)</think>', 1), regexp_extract_all(c, '(?is)<thinking>(.*?)</thinking>', 1))"
TAIL = "regexp_extract(c, '(?is)" + chr(92) * 2 + "boxed" + chr(92) + "{[^}]*" + chr(92) + "}(.*)$', 1)"
FORMAT = f"""{SAMPLES}, f1 as (select *, lower(c) low, {THOUGHTS} th, case when regexp_matches(c, '(?i)\\\\boxed\\{{[^}}]*\\}}') then case when {s_(chr(39).join(['regexp_extract(c, ', '(?i)' + chr(92) * 2 + 'boxed' + chr(92) + '{([^}]*)' + chr(92) + '}', ', 1)']))} <> '' then 1.0 else 0.5 end else 0 end box from s),
f2 as (select *, instr(low, '\\boxed{{') bp, case when len(th) > 0 then {s_('th[list_position([length(x) for x in th], list_max([length(x) for x in th]))]')} end lt, lower(coalesce(th[1], '')) ft from f1),
f3 as (select *, coalesce(lt, '') l2, len({TOK.format("coalesce(lt, '')")}) nt, len({t_(TAIL)}) na from f2),
f4 as (select *, case when contains(low, '<think>') and contains(low, '</think>') then case when bp = 0 or length(low) - instr(reverse(low), reverse('</think>')) - 6 <= bp then 1.0 else 0.7 end
   when contains(low, '<thinking>') and contains(low, '</thinking>') then case when bp = 0 or length(low) - instr(reverse(low), reverse('</thinking>')) - 9 <= bp then 1.0 else 0.7 end else 0 end form,
  case when l2 = '' then 0.3 else case when nt >= 50 then 0.4 when nt >= 30 then 0.3 when nt >= 15 then 0.2 when nt >= 5 then 0.1 else 0 end + case when {' or '.join(f"contains(lower(l2), {quoted(w)})" for w in exam.ANALYSIS)} then 0.3 else 0 end + case when regexp_matches(regexp_replace(lower(l2), '[^\\x00-\\x7F]', '_', 'g'), {quoted(exam.OPTIONS.replace('(?U)', ''))}) then 0.3 else 0 end end reason from f3)"""


@query("exam_format", f"with {FORMAT} select sample_id, round(box::double, 6) boxed, round(form::double, 6) format, round(reason::double, 6) reasoning, round((box + form + reason)::double / 3, 6) formats from f4")
def exam_format(spark, sf_dir):
    c = F.col("completion")
    box, form, reason = exam.box_format(c), exam.format_compliance(c), exam.reasoning(c)
    return samples(spark, sf_dir).select("sample_id", r6(box).alias("boxed"), r6(form).alias("format"), r6(reason).alias("reasoning"), r6((box + form + reason) / 3.0).alias("formats"))


def counted(x: str, part: str) -> str:
    return f"((length({x}) - length(replace({x}, {quoted(part)}, ''))) / {len(part)})::int"


WORDS = "[lower(w) for w in regexp_extract_all(regexp_replace(c, '[^" + chr(92) + "x00-" + chr(92) + "x7F]', '_', 'g'), '" + chr(92) + "b([a-zA-Z]+)" + chr(92) + "b', 1)]"
HEDGES = " or ".join(f"regexp_matches(bx, {quoted(h.replace('(?iU)', '(?i)'))})" for h in exam.HEDGES)
SAID = [f"upper(regexp_extract(ft, {quoted(p.replace('(?iU)', '(?i)'))}, 0))" for p in exam.CONCLUDED]
AGAINST = " or ".join(f"regexp_replace(regexp_replace({x}, '[^A-D]', '', 'g'), upper(bx), '', 'g') <> ''" for x in SAID)
GRAMS = "list_filter(list_concat(case when len(fw) > 4 then [array_to_string(fw[i:i + 3], ' ') for i in range(1, len(fw) - 2)] else [] end, case when len(fw) > 5 then [array_to_string(fw[i:i + 4], ' ') for i in range(1, len(fw) - 3)] else [] end), lambda g: length(g) > 10)"
PENALTY = f"""{FORMAT}, p1 as (select *, {a_box('c')} bx, {TOK.format('ft')} fw, {TOK.format('c')} cw from f4),
p2 as (select *, {GRAMS} grams, len(list_filter(cw, lambda w: regexp_replace(w, '^[.,!?;:()\\[\\]]+|[.,!?;:()\\[\\]]+$', '', 'g') in ({', '.join(map(quoted, exam.HEDGE_WORDS))}))) hw, len(regexp_extract_all(c, '[^\\x20-\\x7E\\n\\r\\t\\x{{A0}}-\\x{{FF}}\\x{{2018}}-\\x{{201F}}\\x{{2013}}-\\x{{2014}}\\x{{2026}}]')) odd,
  list_filter({WORDS}, lambda w: length(w) >= 4 and w not in ({', '.join(map(quoted, exam.REPEATABLE))})) rw, len(list_filter({WORDS}, lambda w: w in ({', '.join(map(quoted, exam.BAD_WORDS))}))) bad, {' + '.join(counted('ft', f) for f in exam.FILLERS)} fill from p1),
rep as (select sample_id, sum(greatest(0, n - 4)) excess from (select sample_id, u.w, count(*) n from p2, unnest(rw) u(w) group by all) group by 1),
phr as (select sample_id, count(*) filter (n >= 4) types from (select sample_id, u.g, count(*) n from p2, unnest(grams) u(g) group by all) group by 1),
p3 as (select p2.*, coalesce(excess, 0) excess, coalesce(types, 0) types, (nt < 20)::int + (nt > 250)::int + (na > 80)::int k from p2 left join rep using (sample_id) left join phr using (sample_id)),
p4 as (select *, case when k > 0 then 0.1 * (case when nt < 20 then 1 - nt / 20 else 0 end + case when nt > 250 then least(1.0, (nt - 250) / 250) else 0 end + case when na > 80 then least(1.0, (na - 80) / 80) else 0 end) / k else 0 end plen,
  least(0.15, bad * 0.025) pbad, least(0.2, excess * 0.02) prep,
  case when len(regexp_extract_all(c, '\\\\boxed\\{{[^}}]*\\}}')) > 1 then 0.25 else 0 end + case when hw > 5 then least(0.12, (hw - 5) * 0.02) else 0 end + case when odd > 5 then least(0.2, (odd - 5) * 0.04) else 0 end + case when {HEDGES} then 0.4 else 0 end
  + case when len(fw) >= 10 and len(list_distinct(fw)) / len(fw) < 0.2 then 0.15 else 0 end + least(0.15, 0.05 * types) + case when fill > 4 then least(0.12, (fill - 4) * 0.04) else 0 end + case when regexp_matches(upper(bx), '^[A-D]$') and ({AGAINST}) then 0.2 else 0 end gaming from p3)"""


@query("exam_penalties", f"with {PENALTY} select sample_id, round(plen::double, 6) length, round(pbad::double, 6) bad_words, round(prep::double, 6) repeat_words, round(least(1.0, gaming)::double, 6) gaming from p4")
def exam_penalties(spark, sf_dir):
    c = F.col("completion")
    words = F.size(exam.tok(F.coalesce(exam.longest_thought(c), F.lit(""))))
    gaming = F.least(F.lit(1.0), sum(exam.gaming_penalties(c).values(), F.lit(0.0)))
    return samples(spark, sf_dir).select("sample_id", r6(exam.length_penalty(words, exam.words_after_box(c))).alias("length"), r6(exam.bad_words_penalty(c)).alias("bad_words"), r6(exam.repeat_words_penalty(c)).alias("repeat_words"), r6(gaming).alias("gaming"))


SMOOTH = ("sigmoid", "tanh", "clip", "none")


@query("exam_smoothing", "with x as (select event_id, value / 100 v from events) select event_id, round(1 / (1 + exp(-(v - 0.5) * 4)), 6) sigmoid, round(0.5 * (1 - 2 / (exp(2 * (v - 0.5) * 4) + 1) + 1), 6) tanh, round(greatest(0, least(1, v))::double, 6) clip, round(v, 6) none from x")
def exam_smoothing(spark, sf_dir):
    from .catalogue import events

    return events(spark, sf_dir).select("event_id", *(r6(exam.smoothed(F.col("value") / 100, k)).alias(k) for k in SMOOTH))


COMPOSITE = f"""{PENALTY}, acc as (with {ACCURACY} select sample_id, case when g is null then 0 when mine = rt or lower({s_('g')}) = lower({s_('w')}) then 1 when ex and len(cr) > 1 and len(list_intersect(cm, cr)) > 0 then 2.0 * len(list_intersect(cm, cr)) / (len(cm) + len(cr)) else 0 end acc from e6),
t as (select *, plen + pbad + prep + least(1.0, gaming) pen from p4 join acc using (sample_id))"""


@query("exam_score", f"with {COMPOSITE} select sample_id, round(1 / (1 + exp(-4 * (greatest(0, least(1, (0.75 * case when (box + form + reason) / 3 < 0.5 then acc * 0.3 else acc end + 0.02 * box + 0.03 * form + 0.2 * reason) * greatest(0, 1 - pen)))::double - 0.5))), 5) exam from t")
def exam_score(spark, sf_dir):
    c = F.col("completion")
    return samples(spark, sf_dir).select("sample_id", F.round(exam.composite(exam.parts(c, F.col("answer")), exam.penalty(c)), 5).alias("exam"))
