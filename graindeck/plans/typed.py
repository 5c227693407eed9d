"""Queries over samples: routing by type, validation, preparation, and the scorers of each type, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import registry
from ..functions.text import thinking
from ..operators import calls, routing, typed
from .catalogue import STRIP, TOK, query, r6, s_, t_
from .samples import SQL as SAMPLES, samples


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def alias_values(aliases: dict) -> str:
    return ", ".join(f"({quoted(n)}, {quoted(to)})" for to, names in aliases.items() for n in names)


def taken(kind: str) -> str:
    return "lower(coalesce(raw, '')) in (" + ", ".join(map(quoted, routing.TAKEN[kind])) + ")"


def ascii_words(x: str) -> str:
    """RE2 knows word boundaries of ASCII only, so other letters become one."""
    return rf"regexp_replace({x}, '[^\x00-\x7F]', 'q', 'g')"


NAMED = f"""{SAMPLES},
al(alias, canonical) as (values {alias_values(routing.ALIASES)}),
co(alias, coarse) as (values {alias_values(routing.COARSE)}),
n as (select s.*, case when raw is null then 'general_qna' else coalesce(al.canonical, lower({s_('raw')})) end kind, coalesce(co.coarse, lower({s_('raw')})) coarse
  from s left join al on al.alias = lower({s_('raw')}) left join co on co.alias = lower({s_('raw')}))"""

CALLS_SEEN = rf"(contains(a, '<tool_call>') or regexp_matches({ascii_words('a')}, '\b[a-zA-Z_]\w*\s*\([^)]*\)'))"
VALID = f"""{NAMED}, v as (select *, {s_('a')} x, lower(p) lp from n),
w as (select *,
  case when not {CALLS_SEEN} then 'no call' when contains(a, '<think>') or contains(a, '</think>') then 'thinking' when contains(a, '\\boxed{{') then 'boxed' end tool_call,
  case when not ({taken('mcq')} or regexp_matches(x, '^[A-Da-d]$')) then 'not an exam' end mcq,
  case when not ({taken('math')} or regexp_matches(x, '^-?\\d+(\\.\\d+)?$|\\\\boxed\\{{|####\\s*.|^-?\\d+/\\d+$') or regexp_matches(p, '[=<>≤≥±]|\\\\(?:frac|sqrt|sum|int|lim)\\b')) then 'not math' end math,
  case when not ({taken('python')} or regexp_matches(a, '(?i)def |class |import |from .+ import|```python|```py') or {' or '.join(f'contains(lp, {quoted(x)})' for x in routing.CODE_WORDS)}) then 'not code' end python,
  case when length({s_('p')}) < 5 then 'short prompt' when length(x) < 2 then 'short answer' end general_qna from v)"""


@query("alias_normalization", f"with {NAMED} select kind, coarse, count(*) n from n group by all")
def alias_normalization(spark, sf_dir):
    raw = F.col("type")
    return samples(spark, sf_dir).groupBy(routing.normalized_type(raw).alias("kind"), routing.coarse_type(raw).alias("coarse")).agg(F.count(F.lit(1)).alias("n"))


@query("type_validation", f"with {VALID} select sample_id, {', '.join(routing.TYPES)} from w")
def type_validation(spark, sf_dir):
    reasons = routing.invalid_reasons(F.col("prompt"), F.col("answer"), F.col("type"))
    return samples(spark, sf_dir).select("sample_id", *(r.alias(t) for t, r in reasons.items()))


@query("type_detection", f"with {VALID} select sample_id, case when raw is not null and kind in ({', '.join(map(quoted, routing.TYPES))}) then kind {' '.join(f'when {t} is null then {quoted(t)}' for t in routing.TYPES)} end as type from w")
def type_detection(spark, sf_dir):
    return samples(spark, sf_dir).select("sample_id", routing.detected_type(F.col("prompt"), F.col("answer"), F.col("type")).alias("type"))


@query("loader_reject_stats", f"with {VALID}, r as (" + " union all ".join(f"select {quoted(t)} as type, coalesce({t}, 'accepted') reason from w" for t in routing.TYPES) + ") select type, reason, count(*) n from r group by all")
def loader_reject_stats(spark, sf_dir):
    reasons = routing.invalid_reasons(F.col("prompt"), F.col("answer"), F.col("type"))
    one = F.explode(F.array(*(F.struct(F.lit(t).alias("type"), F.coalesce(r, F.lit("accepted")).alias("reason")) for t, r in reasons.items())))
    return samples(spark, sf_dir).select(one.alias("r")).groupBy("r.type", "r.reason").agg(F.count(F.lit(1)).alias("n"))


WORKED_TAIL = "regexp_extract(a, '(?m)####" + chr(92) + "s*(.+)$', 1)"
WORKED = rf"case when regexp_matches(a, '####\s*.') then replace({s_(WORKED_TAIL)}, ',', '') else {s_('a')} end"
HERMES_NAMES = r"list_filter([json_extract_string(x, '$.name') for x in regexp_extract_all(a, '(?s)<tool_call>\s*(.*?)\s*</tool_call>', 1)], lambda y: y is not null and y <> '')"
LEGACY_NAMES = rf"regexp_extract_all({ascii_words('a')}, '\b([a-zA-Z_]\w*)\s*\(', 1)"


@query("sample_preparation", rf"with {SAMPLES}, q as (select *, {WORKED} m from s) select sample_id, m math_answer, contains(m, '\boxed{{') is_boxed, regexp_matches(m, '^-?\d+(\.\d+)?$') is_numeric, regexp_matches({s_('a')}, '^[A-Da-d]$') is_letter, contains(a, '```') has_code, array_to_string(list_sort(list_distinct(case when contains(a, '<tool_call>') then {HERMES_NAMES} else {LEGACY_NAMES} end)), ',') functions from q")
def sample_preparation(spark, sf_dir):
    made = routing.prepared(F.col("answer"))
    return samples(spark, sf_dir).select("sample_id", *((F.array_join(c, ",") if k == "functions" else c).alias(k) for k, c in made.items()))


# ---- the scorers' SQL, piece by piece
THOUGHT = rf"case when regexp_matches(c, '(?s)<think>.*?</think>') then {STRIP.format('regexp_extract(c, ' + quoted('(?s)<think>(.*?)</think>') + ', 1)')} end"
AFTER = rf"case when regexp_matches(c, '(?s)<think>.*?</think>') then {STRIP.format('regexp_extract(c, ' + quoted('(?s)<think>.*?</think>' + chr(92) + 's*(.*)') + ', 1)')} else {s_('c')} end"
PARTS = f"{SAMPLES}, k as (select *, {THOUGHT} th, {AFTER} ans, instr(c, '<think>') o, instr(c, '</think>') e from s), kk as (select *, coalesce(th, '') h, len({TOK.format('coalesce(th, ' + quoted('') + ')')}) nh, case when o > 0 and e > o then {s_('substr(c, o + 7, e - o - 7)')} else '' end mid, case when e > 0 then {s_('substr(c, e + 8)')} else '' end tail from k)"


def unboxed(x: str, box: str) -> str:
    return s_(f"(case when regexp_matches({x}, {quoted(box)}) then regexp_extract({x}, {quoted(box)}, 1) else {x} end)")


def latex(x: str) -> str:
    out = rf"regexp_replace({s_(x)}, '\\frac\{{([^}}]*)\}}\{{([^}}]*)\}}', '(\1)/(\2)', 'g')"
    out = rf"regexp_replace({out}, '\\sqrt\{{([^}}]*)\}}', 'sqrt(\1)', 'g')"
    out = rf"regexp_replace({out}, '\\(?:text|mathrm|mathbf|mathit|left|right|displaystyle)\b\s*', '', 'g')"
    for old, new in typed.LATEX:
        out = f"replace({out}, {quoted(old)}, {quoted(new)})"
    return "lower(" + s_(rf"regexp_replace({out}, '\s+', ' ', 'g')") + ")"


def num(x: str) -> str:
    return f"case when regexp_matches({x}, {quoted(typed.NUMBER)}) then try_cast({x} as double) end"


def numeric(x: str) -> str:
    """x: a column of texts without commas and spaces."""
    half = lambda k: num(rf"regexp_replace(split_part({x}, '/', {k}), '^[()]+|[()]+$', '', 'g')")
    return f"coalesce(case when length({x}) - length(replace({x}, '/', '')) = 1 and ({half(2)}) <> 0 then ({half(1)}) / ({half(2)}) end, {num(x)}, case when ends_with({x}, '%') then ({num(f'left({x}, length({x}) - 1)')}) / 100 end)"


def by_length(score: str, short: int, long: int) -> str:
    return f"greatest(0.0, least(1.0, ({score}) * case when nh < {short} then greatest(0.3, nh / {short}.0) when nh > {long} then greatest(0.5, 1.0 - 0.2 * (nh - {long}) / {long}.0) else 1.0 end))"


def bit(x: str, value) -> str:
    return f"case when {x} then {value} else 0 end"


def words_in(x: str, patterns, form=r"(?i)\b{}\b") -> str:
    return " + ".join(bit(f"regexp_matches({ascii_words(x)}, {quoted(form.format(p))})", 1) for p in patterns)


STEPS = typed.STEPS.replace("(?iU)", "(?i)")
MATH = rf"""{PARTS}, b as (select *, {latex(unboxed('ans', typed.BOX))} l1, {latex(unboxed('a', typed.BOX))} l2 from kk),
d as (select *, replace(replace(l1, ',', ''), ' ', '') z1, replace(replace(l2, ',', ''), ' ', '') z2 from b),
f as (select *, {numeric('z1')} x1, {numeric('z2')} x2, len(regexp_extract_all(h, {quoted(STEPS)})) steps, len(regexp_extract_all(h, '[=<>≤≥]')) eqs from d),
g as (select *, case when ans = '' or a = '' then 0.0 when l1 = l2 then 1.0 when coalesce(abs(x1 - x2) <= 1e-6, false) then 1.0 when coalesce(x2 <> 0 and abs(x1 - x2) / abs(x2) < 0.01, false) then 0.8 when contains(l1, l2) or contains(l2, l1) then 0.7 else 0.0 end correct,
  case when regexp_matches({s_('c')}, '(?s)^<think>\n.*?\n</think>\n') then 1.0 else {' + '.join(bit(x, 0.2) for x in ("o > 0", "e > 0", "o > 0 and e > o and length(mid) >= 10", "e > 0 and length(tail) >= 2", "contains(c, '" + chr(92) + "boxed{')"))} end form,
  case when h = '' then 0.0 else {by_length("0.8 + case when steps >= 2 then 0.15 when steps >= 1 then 0.05 else 0 end + case when eqs >= 3 then 0.1 when eqs >= 1 then 0.05 else 0 end", 15, 200)} end thought from f)"""


def parts(name: str, correct, form, thought):
    return lambda df: df.select("sample_id", r6(correct).alias("correctness"), r6(form).alias("format"), r6(thought).alias("thinking"), r6(F.col(name)).alias(name))


def scored(spark, sf_dir, name: str):
    return registry.score(samples(spark, sf_dir), [name])


C, A = F.col, lambda: typed.answer_after(F.col("completion"))


def total(w, correct="correct", form="form", thought="thought") -> str:
    return f"round((case when length({s_('c')}) >= 2 then {w[0]} * {correct} + {w[1]} * {form} + {w[2]} * {thought} else 0 end)::double, 6)"


@query("score_math", f"with {MATH} select sample_id, round(correct::double, 6) correctness, round(form::double, 6) format, round(thought::double, 6) thinking, {total(typed.WEIGHTS['math'])} math from g")
def score_math(spark, sf_dir):
    return parts("math", typed.math_correctness(A(), C("answer")), typed.math_format(C("completion")), typed.math_thinking(thinking(C("completion"))))(scored(spark, sf_dir, "math"))


def re2(p: str) -> str:
    return quoted(p.replace("(?iU)", "(?i)").replace("(?=$|", "(?:$|"))


LETTERS = f"list_concat(regexp_extract_all(ans, {re2(typed.OPTION)}, 1), regexp_extract_all(ans, {re2(typed.OPTION_NAMED)}, 1))"
MCQ = rf"""{PARTS}, b as (select *, case when regexp_matches(ans, {quoted(typed.FLAT_BOX)}) then {s_(f"regexp_extract(ans, {quoted(typed.FLAT_BOX)}, 1)")} else coalesce(upper({LETTERS}[-1]), ans) end got, {s_('a')} want, upper(regexp_extract({s_('a')}, {re2(typed.OPTION_WANTED)}, 1)) letter from kk),
d as (select *, case when ans = '' or a = '' then 0.0 when lower(got) = lower(want) then 1.0 when letter <> '' and upper(got) = letter then 1.0 else 0.0 end match,
  least(1.0, {' + '.join(bit(f"regexp_matches({ascii_words('ans')}, {re2(h)})", 0.3) for h in typed.HEDGES)}) hedge,
  {' + '.join(bit(x, 0.25) for x in ("o > 0", "e > 0", "o > 0 and e > o", "e > 0 and length(tail) >= 2"))} form,
  case when h = '' then 0.0 else {by_length("1.0 - least(0.4, 0.1 * (" + words_in('h', [p.replace("'", "'") for p in typed.DOUBTS]) + ")) - 0.3 * (" + ' + '.join(bit(f"contains(h, {quoted(s)})", 1) for s in typed.SPECIAL) + ") + " + bit("regexp_matches(h, '" + chr(92) + "n" + chr(92) + "s*[-*]|" + chr(92) + "n" + chr(92) + "s*" + chr(92) + "d+" + chr(92) + "." + chr(92) + "s+')", 0.1), 10, 150)} end thought from b)"""


@query("score_mcq", f"with {MCQ} select sample_id, round(greatest(0, match - hedge)::double, 6) correctness, round(form::double, 6) format, round(thought::double, 6) thinking, {total(typed.WEIGHTS['mcq'], 'greatest(0, match - hedge)')} mcq from d")
def score_mcq(spark, sf_dir):
    match = F.greatest(F.lit(0.0), typed.mcq_match(A(), C("answer")) - typed.mcq_hedging(A()))
    return parts("mcq", match, typed.mcq_format(C("completion")), typed.mcq_reasoning(thinking(C("completion"))))(scored(spark, sf_dir, "mcq"))


PYTHON = rf"""{PARTS}, b as (select *, regexp_extract_all(ans, {quoted(typed.CODE_BLOCK)}, 1) blocks from kk), d as (select *, case when len(blocks) > 0 then array_to_string(blocks, chr(10)) else ans end code from b),
f as (select *, {s_(chr(39).join(['regexp_replace(code, ', chr(92) + 's+', ', ', ' ', ', ', 'g', ')']))} fc, {s_(chr(39).join(['regexp_replace(a, ', chr(92) + 's+', ', ', ' ', ', ', 'g', ')']))} fa, list_distinct(regexp_split_to_array({s_('code')}, '\r\n|\n|\r')) lc, list_distinct(regexp_split_to_array({s_('a')}, '\r\n|\n|\r')) la from d),
g as (select *, len(list_intersect(lc, la)) / len(la) share, {' + '.join(bit(f"contains(lower(h), {quoted(w)})", 1) for w in typed.CODE_TALK)} hits from f),
i as (select *, case when ans = '' or a = '' then 0.0 when {s_('code')} = {s_('a')} or fc = fa then 1.0 when contains(fc, fa) then 0.8 when share >= 0.8 then 0.7 when share >= 0.5 then 0.4 else 0.0 end correct,
  case when h = '' then 0.0 else {by_length("0.8 + case when hits >= 3 then 0.15 when hits >= 1 then 0.05 else 0 end", 10, 200)} end thought from g)"""


@query("score_python_parts", f"with {PYTHON} select sample_id, round(correct::double, 6) correctness, round(thought::double, 6) thinking, len(blocks)::int blocks, len(regexp_split_to_array({s_('code')}, '\\r\\n|\\n|\\r'))::int n_lines from i")
def score_python_parts(spark, sf_dir):
    """The parts of the code score that SQL can say; score_python adds the syntax check."""
    code = typed.code_of(A())
    return samples(spark, sf_dir).select("sample_id", r6(typed.python_correctness(A(), C("answer"))).alias("correctness"), r6(typed.python_thinking(thinking(C("completion")))).alias("thinking"), F.size(F.regexp_extract_all(A(), F.lit(typed.CODE_BLOCK), F.lit(1))).alias("blocks"), F.size(F.split(typed.strip(code), "\r\n|\n|\r")).alias("n_lines"))


@query("score_python", None)
def score_python(spark, sf_dir):
    return scored(spark, sf_dir, "python").select("sample_id", r6("python").alias("python"))


TOOL = r"""{0}, b as (select *, {1} tool from s),
d as (select *, regexp_extract_all(tool, '(?s)<tool_call>\s*(.*?)\s*</tool_call>', 1) gj, regexp_extract_all(a, '(?s)<tool_call>\s*(.*?)\s*</tool_call>', 1) wj, list_filter([regexp_extract({2}, '(?s)^(\w+)\(.*\)$', 1) for x in string_split({3}, chr(10))], lambda y: y <> '') legacy from b),
f as (select *, [struct_pack(name := coalesce(json_extract_string(x, '$.name'), ''), args := json_extract(x, '$.arguments')) for x in gj if json_valid(x)] g,
  case when len(wj) > 0 then [struct_pack(name := coalesce(json_extract_string(x, '$.name'), ''), args := json_extract(x, '$.arguments')) for x in wj if json_valid(x)] else [struct_pack(name := x, args := json('{{}}')) for x in legacy] end w from d),
h as (select *, [list_filter(g, lambda y: y.name = x.name)[1] for x in w] m from f),
i as (select *, len(list_filter(m, lambda y: y is not null)) / len(w) names,
  list_sum([case when m[j] is null then 0.0 when len(json_keys(w[j].args)) = 0 then 1.0 else len(list_filter(json_keys(w[j].args), lambda q: json_extract_string(m[j].args, '$.' || q) = json_extract_string(w[j].args, '$.' || q))) / len(json_keys(w[j].args)) end for j in range(1, len(w) + 1)]) / len(w) args from h)"""
TOOL = TOOL.format(SAMPLES, s_(r"regexp_replace(regexp_replace(c, '(?s)<think>.*?</think>\s*', '', 'g'), '(?s)<think>.*$', '', 'g')"), s_("x"), s_("a"))


@query("score_tool_call", rf"with {TOOL} select sample_id, round((case when not contains(tool, '<tool_call>') or contains(tool, '\boxed{{') or len(g) = 0 or len(w) = 0 or names = 0 then 0 else 0.5 * names + 0.5 * args end)::double, 6) tool_call from i")
def score_tool_call(spark, sf_dir):
    return scored(spark, sf_dir, "tool_call").select("sample_id", r6("tool_call").alias("tool_call"))


@query("type_dispatch_score", None)
def type_dispatch_score(spark, sf_dir):
    """Each sample by the scorer of its type; the code type needs a syntax check, which SQL lacks."""
    return scored(spark, sf_dir, "by_type").select("sample_id", routing.normalized_type(C("type")).alias("kind"), r6("by_type").alias("score"))


# ---- plain function calls
DIRTY = r"(contains(lower(c), '<think>') or contains(lower(c), '</think>') or contains(lower(c), '\boxed{'))"
FOUND = r"""[struct_pack(name := regexp_extract(x, '^([a-zA-Z_][a-zA-Z0-9_]*)', 1), params := [struct_pack(k := regexp_extract(y, '^([a-zA-Z_]\w*)', 1), v := lower(trim(regexp_extract(y, '(?s)=(.*)$', 1), ' "' || chr(39) || chr(10) || chr(9)))) for y in regexp_extract_all(regexp_extract(x, '(?s)\((.*)\)$', 1), '[a-zA-Z_]\w*\s*=\s*(?:"[^"]*"|[^,]*)')]) for x in regexp_extract_all({0}, '(?s)[a-zA-Z_][a-zA-Z0-9_]*\s*\([^)]*\)')]"""
SPACED = r"regexp_replace(lower({0}), '\s+', ' ', 'g')"
CALLS = f"""{SAMPLES}, q as (select *, {FOUND.format('c')} g, {FOUND.format('a')} w, {DIRTY} dirty from s),
u as (select *, list_distinct([x.name for x in g]) gn, list_distinct([x.name for x in w]) wn from q),
z as (select *, [struct_pack(f := (g[j].name = w[j].name)::int, e := (g[j].name = w[j].name and len(g[j].params) = len(w[j].params) and len(list_filter(w[j].params, lambda q: list_contains(g[j].params, q))) = len(w[j].params))::int,
  p := case when g[j].name <> w[j].name then 0.0 when len(w[j].params) = 0 then (len(g[j].params) = 0)::int::double else len(list_filter(w[j].params, lambda q: list_contains(g[j].params, q))) / len(w[j].params) end) for j in range(1, least(len(g), len(w)) + 1)] m from u),
y as (select *, (len(list_filter(m, lambda x: x.e = 1)) = len(w))::int e, list_sum([x.f for x in m]) / len(w) f, list_sum([x.p for x in m]) / len(w) p2, len(list_filter(g, lambda x: list_contains(wn, x.name))) / greatest(len(g), len(w)) hits from z)"""


def clean(score: str) -> str:
    return f"round((case when dirty then 0 else {score} end)::double, 6)"


def by_count(equal: str, unequal: str) -> str:
    return f"case when len(g) = 0 and len(w) = 0 then 1 when len(g) = 0 or len(w) = 0 then 0 when len(g) <> len(w) then {unequal} else {equal} end"


@query("tool_call_match", f"with {CALLS} select sample_id, {clean('(' + SPACED.format(s_('c')) + ' = ' + SPACED.format(s_('a')) + ')::int')} tool_call_exact, {clean('case when len(wn) = 0 then (len(gn) = 0)::int else len(list_intersect(gn, wn)) / len(wn) end')} tool_call_function, {clean(by_count('p2', '0'))} tool_call_params, {clean(by_count('0.4 * f + 0.4 * p2 + 0.2 * e', '0.5 * hits'))} tool_call_overall, {clean('(len(g) > 0)::int')} tool_call_parseable from y")
def tool_call_match(spark, sf_dir):
    names = ["tool_call_exact", "tool_call_function", "tool_call_params", "tool_call_overall", "tool_call_parseable"]
    return registry.score(samples(spark, sf_dir), names).select("sample_id", *(r6(n).alias(n) for n in names))


@query("tool_call_contamination", f"with {SAMPLES} select {DIRTY} dirty, count(*) n from s group by 1")
def tool_call_contamination(spark, sf_dir):
    return samples(spark, sf_dir).groupBy(calls.contaminated(C("completion")).alias("dirty")).agg(F.count(F.lit(1)).alias("n"))
