"""Queries of sections, curricula and the hierarchical levels over rollouts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sections as sec
from ..operators import hierarchical as hi
from .catalogue import TOK, docs, events, query, r6, s_, t_
from .rollouts import SQL as ROLLOUTS, rollouts
from .typed import ascii_words, quoted

Q = quoted
BS = chr(92)
THOUGHTS = f"[{s_('x')} for x in regexp_extract_all(c, '(?s)<think>(.*?)</think>', 1)]"
SECTIONS = f"""{ROLLOUTS}, z0 as (select *, case when contains(c, '</think>') then array_to_string({THOUGHTS}, chr(10) || chr(10)) when contains(c, '<think>') then {s_("substr(c, instr(c, '<think>') + 7)")} else '' end th,
  case when contains(c, '</think>') then {s_("string_split(c, '</think>')[-1]")} when contains(c, '<think>') then '' else {s_('c')} end an from r)"""


def C():
    return F.col("completion")


@query("completion_sections", f"with {SECTIONS} select rollout_id, length(th) n_thinking, md5(th) thinking, length(an) n_answer, md5(an) answer from z0")
def completion_sections(spark, sf_dir):
    th, an = sec.thinking_section(C()), sec.answer_section(C())
    return rollouts(spark, sf_dir).select("rollout_id", F.length(th).cast("long").alias("n_thinking"), F.md5(th).alias("thinking"), F.length(an).cast("long").alias("n_answer"), F.md5(an).alias("answer"))


def complete(x: str, field: str) -> str:
    """field: reason or confidence, of a column of texts."""
    pick = lambda why, sure: Q(why) if field == "reason" else str(sure)
    s = s_(x)
    out = f"case when {x} = '' then {pick('empty', 0.0)} when length({s}) < 3 then {pick('too_short', 0.0)}"
    for end, sure in sec.GOOD_ENDINGS:
        out += f" when ends_with({s}, {Q(end)}) then {pick('good_ending:' + end, sure)}"
    count = lambda ch: f"(length({s}) - length(replace({s}, {Q(ch)}, '')))"
    box = f"contains({s}, {Q(BS + 'boxed{')})"
    out += f" when {box} and {count('{')} = {count('}')} then {pick('complete_boxed', 0.90)} when {box} then {pick('unbalanced_braces', 0.3)}"
    for p, why, sure in sec.BROKEN:
        out += f" when regexp_matches({s}, {Q('(?i)' + p)}) then {pick(why, sure)}"
    for a, b in ("()", "[]", "{}"):
        out += f" when {count(a)} > {count(b)} then {pick(f'unbalanced:{a}{b}', 0.4)}"
    last = f"regexp_matches(right({s}, 1), '[{BS}p{{L}}{BS}p{{N}}]')"
    return out + f" when {last} and length({s}) < 50 then {pick('short_alnum_ok', 0.7)} when {last} then {pick('no_terminal_punct', 0.5)} else {pick('acceptable', 0.75)} end"


@query("completion_check", f"with {ROLLOUTS} select rollout_id, {complete('c', 'reason')} reason, ({complete('c', 'confidence')})::double confidence from r")
def completion_check(spark, sf_dir):
    x = sec.completeness(C())
    return rollouts(spark, sf_dir).select("rollout_id", x["reason"].alias("reason"), x["confidence"].alias("confidence"))


TAGS = rf"[struct_pack(x := regexp_extract(x, '<(/?)', 1) || lower(regexp_extract(x, '</?(\w+)', 1)), self := regexp_matches(x, '/\s*>$'), st := ['']) for x in regexp_extract_all(c, '<(?:/?)(?:\w+)(?:\s[^>]*)?(?:/)?\s*>')]"
STACK = "list_reduce(list_prepend(struct_pack(x := '', self := false, st := ['']), " + TAGS + "), lambda a, b: struct_pack(x := '', self := false, st := case when b.self then a.st when starts_with(b.x, '/') and a.st[-1] = substr(b.x, 2) then a.st[1:len(a.st) - 1] else list_append(a.st, b.x) end)).st"


@query("tag_balance", f"with {ROLLOUTS} select rollout_id, (len({STACK}) - 1)::int unmatched from r")
def tag_balance(spark, sf_dir):
    return rollouts(spark, sf_dir).select("rollout_id", sec.unmatched_tags(C()).alias("unmatched"))


def words(x: str) -> str:
    return f"len({t_(x)})"


FOUNDATION = f"""{SECTIONS}, f0 as (select *, {words('th')} nt, {words('an')} na, {words('c')} nc, len({STACK}) - 1 un, {complete('th', 'confidence')} st, {complete('an', 'confidence')} sa, {complete('c', 'confidence')} sc from z0),
f1 as (select *, case when c = '' then 0 else ((contains(c, '<think>')::int + contains(c, '</think>')::int) / 2 + case when nt >= 20 then 1 else nt / 20 end + case when na >= 5 then 1 when na > 0 then na / 5 when nt > 0 then 0.3 else 0 end + case when un = 0 then 1 else greatest(0.3, 1 - un * 0.2) end) / 4 end s1,
  case when c = '' then 0 else (case when nc < 10 then nc / 10 when nc <= 500 then 1 else greatest(0.5, 1 - (nc - 500) / 500 * 0.3) end + case when (length(c) - length(replace(c, ' ', ''))) / length(c) > 0.5 then 0.5 else 1 end + 1) / 3 end s2,
  case when c = '' then 0 when an <> '' then 0.3 * case when th <> '' then st else 0.5 end + 0.7 * sa else 0.5 * sc end s3 from f0),
f2 as (select *, case when length({s_('c')}) > 20 then greatest(0.1, 0.5 * s1 + 0.15 * s2 + 0.35 * s3) else 0.5 * s1 + 0.15 * s2 + 0.35 * s3 end foundation from f1)"""


@query("foundation_level", f"with {FOUNDATION} select rollout_id, round(s1::double, 6) structure, round(s2::double, 6) format, round(s3::double, 6) completeness, round(foundation::double, 6) foundation from f2")
def foundation_level(spark, sf_dir):
    return rollouts(spark, sf_dir).select("rollout_id", r6(hi.structure_score(C())).alias("structure"), r6(hi.format_score(C())).alias("format"), r6(hi.completeness_score(C())).alias("completeness"), r6(hi.foundation(C())).alias("foundation"))


CLEAN = s_(s_(rf"regexp_replace(regexp_replace(c, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')"))


def held(x: str, parts) -> str:
    return "(" + " + ".join(f"contains({x}, {Q(p)})::int" for p in parts) + ")"


def times(x: str, part: str) -> str:
    return f"((length({x}) - length(replace({x}, {Q(part)}, ''))) / {len(part)})"


def among(names) -> str:
    return f"len(list_filter(lw, lambda w: w in ({', '.join(map(Q, names))})))"


POLISH = f"""{SECTIONS}, p0 as (select *, {CLEAN} x, string_split(c, chr(10)) li, regexp_extract_all(c, '<(\\w+)>', 1) op, regexp_extract_all(c, '</(\\w+)>', 1) cl from z0),
p1 as (select *, lower(x) lx, string_split(lower(x), ' ') lw, list_filter([{s_('y')} for y in regexp_split_to_array(x, '[.!?]+')], lambda y: y <> '') se, list_distinct(list_concat(op, cl)) nm, list_filter(li, lambda y: {s_('y')} <> '') fu,
  length(c) / 4.0::double lc, trunc((length(c) / 4.0::double + {words('c')} * 1.3::double) / 2) kc, trunc((length(th) / 4.0::double + {words('th')} * 1.3::double) / 2) kt, trunc((length(an) / 4.0::double + {words('an')} * 1.3::double) / 2) ka from p0),
p2 as (select *, [len({TOK.format('y')}) for y in se] ll, (case when len(nm) > 0 then len(list_filter(nm, lambda n: len(list_filter(op, lambda o: o = n)) = len(list_filter(cl, lambda o: o = n)))) / len(nm) else 1 end + greatest(0, 1 - 0.2 * len(list_filter(list_intersect(op, cl), lambda n: instr(c, '</' || n || '>') < instr(c, '<' || n || '>'))))
   + case when len(fu) > 0 then len(list_filter(fu, lambda y: (length(y) - length(regexp_replace(y, '^\\s+', ''))) % 2 = 0)) / len(fu) else 0.5 end + 1 - len(list_filter(li, lambda y: regexp_matches(y, '\\s$'))) / len(li)) / 4 tidy from p1),
p3 as (select *, list_avg(ll) m, coalesce(list_stddev_pop(ll), 0) d, length(replace(x, ' ', '')) / len(string_split(x, ' ')) lt, len(string_split(x, ' ')) nx, kc / 450 u from p2),
e0 as (select rollout_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) h from (select rollout_id, u.ch, count(*) n from r, unnest(string_split(c, '')) u(ch) where u.ch <> '' group by all) group by 1),
p4 as (select p3.*, coalesce(h, 0) h, {among(hi.PAST)} pa, {among(hi.PRESENT)} pr, {held('lx', hi.CONTRACTED)} + {times('lx', ' i ')} + {times('lx', 'i ')} + {times('lx', ' my ')} inf, {held('lx', hi.FORMAL)} fo, (len(li) - 1) / greatest(1, length(c)) sh from p3 left join e0 using (rollout_id)),
p5 as (select *, case when length(x) < 20 then 0.5 else 0.35 * case when len(ll) = 0 then 0.5 when m between 10 and 20 then 1 when m < 10 then m / 10 else greatest(0.3, 1 - (m - 20) / 30) end + 0.25 * case when len(ll) = 0 then 0.5 when len(ll) < 2 then 0.7 when d between 5 and 10 then 1 when d < 5 then d / 5 else greatest(0.3, 1 - (d - 10) / 15) end
   + 0.2 * case when lt between 4 and 7 then 1 when lt < 4 then lt / 4 else greatest(0.4, 1 - (lt - 7) / 5) end + 0.2 * (0.5 + 0.5 * least(1, {held('lx', hi.FLOW)} / (nx / 50))) end readable,
  0.4 * case when u between 0.5 and 0.9 then 1 when u < 0.5 then u / 0.5 else greatest(0.7, 1 - (u - 0.9) * 2) end + 0.35 * case when kt > 0 and ka > 0 then case when kt / ka between 2 and 6 then 1 when kt / ka < 2 then kt / ka / 2 else greatest(0.6, 1 - (kt / ka - 6) / 10) end when ka > 0 then 0.5 else 0.3 end + 0.25 * case when length(c) <= 50 then 0.5 when h between 3.5 and 5.5 then 1 when h < 3.5 then h / 3.5 else 0.9 end lengths,
  case when length(x) < 50 or len(list_filter(ll, lambda k: k > 2)) < 2 then 0.7 else 0.35 * case when pa + pr > 0 then greatest(pa, pr) / (pa + pr) else 0.7 end + 0.35 * case when inf + fo > 0 then 0.5 + 0.5 * greatest(inf, fo) / (inf + fo + 1) else 0.7 end + 0.3 * case when regexp_matches(c, '\\$[^$]+\\$') and regexp_matches(c, '[0-9]+\\s*[+\\-*/=]\\s*[0-9]+') then 0.6 else 1 end end steady,
  (1 - len(list_filter(li, lambda y: length(y) > 200)) / len(li) + case when c = '' then 0.5 when sh between 0.01 and 0.05 then 1 when sh < 0.01 then 0.7 else greatest(0.5, 1 - (sh - 0.05) * 5) end + greatest(0.5, 1 - {held('c', hi.ARTIFACTS)} * 0.15) + case when an = '' then 0.4 when regexp_matches(an, '[.!?)0-9]$') then 1 else 0.7 end) / 4 shown from p4)"""


@query("polish_level", f"with {POLISH} select rollout_id, round(tidy::double, 6) tidy, round(readable::double, 6) readability, round(lengths::double, 6) length_efficiency, round(steady::double, 6) consistency, round(shown::double, 6) presentation, round((0.2 * tidy + 0.2 * readable + 0.25 * lengths + 0.15 * steady + 0.2 * shown)::double, 5) polish from p5")
def polish_level(spark, sf_dir):
    parts = {"tidy": hi.tidy_score, "readability": hi.readability, "length_efficiency": hi.length_efficiency, "consistency": hi.consistency, "presentation": hi.presentation}
    return rollouts(spark, sf_dir).select("rollout_id", *(r6(f(C())).alias(k) for k, f in parts.items()), F.round(hi.polish(C()), 5).alias("polish"))


def gate(x: str, k: str) -> str:
    g = hi.GATES[k]
    return f"({g.floor} + {1 - g.floor} / (1 + exp(-{g.steepness} * ({x} - {g.threshold}))))"


GATED = "0.10 * f * {0} + 0.45 * c * {1} * {0} + 0.30 * q * {2} * {1} + 0.15 * p * {3} * {2}".format(*(gate(x, k) for x, k in zip("fcqp", hi.GATES)))


@query("soft_gates", f"with x as (select event_id, value / 100 f, (event_id % 10) / 10 c, (event_id % 7) / 7 q, (event_id % 3) / 3 p from events), y as (select *, {GATED} b from x), z as (select *, 0.02 + 0.93 * greatest(0.02, b * 0.9) s from y) select event_id, round(b, 6) before, round(s, 6) score, case when s >= 0.9 then 'A' when s >= 0.8 then 'B' when s >= 0.7 then 'C' when s >= 0.6 then 'D' else 'F' end grade from z")
def soft_gates(spark, sf_dir):
    """Four levels made from events, gated and weighed; a tenth is taken for gaming."""
    i = F.col("event_id")
    _, before = hi.gated({"foundation": F.col("value") / 100, "correctness": i % 10 / 10, "quality": i % 7 / 7, "polish": i % 3 / 3})
    score = hi.final_score(before, F.lit(0.1))
    return events(spark, sf_dir).select("event_id", r6(before).alias("before"), r6(score).alias("score"), hi.grade(score).alias("grade"))


NORMAL = lambda x: s_(rf"regexp_replace(lower({x}), '\s+', ' ', 'g')")


@query("keyword_coverage", f"with {ROLLOUTS}, k as (select rollout_id, c, prompt, {NORMAL('c')} x, list_filter(string_split({NORMAL('t')}, ' '), lambda w: length(w) > 3 and w not in ({', '.join(map(Q, hi.STOPWORDS))})) k from (select r.*, left(coalesce(d.text, ''), 200) t from r join documents d on d.doc_id = rollout_id)) select rollout_id, round((case when c = '' then 0 when len(k) = 0 then 0.5 else len(list_filter(k, lambda w: contains(x, w))) / len(k) end)::double, 6) coverage from k")
def keyword_coverage(spark, sf_dir):
    """How much of each document's first 200 characters its rollout covers."""
    first = docs(spark, sf_dir).select(F.col("doc_id").alias("rollout_id"), F.substring("t", 1, 200).alias("want"))
    df = rollouts(spark, sf_dir).join(first, "rollout_id")
    covered = F.when(C() == "", 0.0).otherwise(hi.keyword_coverage(C(), F.concat(F.col("want"), F.lit(" "))))
    return df.select("rollout_id", r6(covered).alias("coverage"))


@query("hierarchical_score", None)
def hierarchical_score(spark, sf_dir):
    """All levels, the penalty, score and grade; compression and sequence matching have no SQL."""
    df = hi.hierarchical(rollouts(spark, sf_dir))
    return df.select("rollout_id", *(r6(k).alias(k) for k in (*hi.GATES, "penalty", "hierarchical")), "grade")


# ---- curricula
PARTED = f"""{ROLLOUTS}, q0 as (select *, instr(c, '<think>') o, instr(c, '</think>') e from r), q1 as (select *, case when o > 0 and e > o then substr(c, o + 7, e - o - 7) else '' end th, case when o > 0 and e > o then substr(c, 1, o - 1) else '' end be from q0),
q2 as (select *, string_split(th, chr(10)) li, trunc(len(string_split(th, chr(10))) * 0.5)::int kl, length(th) n, greatest(10, trunc(length(th) * 0.5)::int) kc from q1)"""
MIDDLE = "case when len(li) <= 2 or greatest(2, kl) >= len(li) then th else array_to_string(list_concat(li[1:greatest(2, kl) // 2], [chr(10) || '...' || chr(10)], li[len(li) - (greatest(2, kl) - greatest(2, kl) // 2) + 1:]), chr(10)) end"
MIDDLE_CHARS = "case when n <= 20 or kc >= n then th else substr(th, 1, kc // 2) || chr(10) || '...' || chr(10) || substr(th, n - (kc - kc // 2) + 1) end"


def prefixed(x: str) -> str:
    return f"md5(case when th = '' then '' else be || '<think>' || {x} end)"


@query("curriculum_modes", f"with {PARTED} select rollout_id, {prefixed('array_to_string(li[1:greatest(1, kl)], chr(10))')} by_lines, {prefixed(MIDDLE)} middle_lines, {prefixed('substr(th, 1, greatest(1, trunc(n * 0.5)::int))')} by_characters, {prefixed(MIDDLE_CHARS)} middle_characters from q2")
def curriculum_modes(spark, sf_dir):
    """Half of each rollout's thinking, kept in four ways."""
    ways = {"by_lines": {}, "middle_lines": {"middle": True}, "by_characters": {"by_lines": False}, "middle_characters": {"by_lines": False, "middle": True}}
    return rollouts(spark, sf_dir).select("rollout_id", *(F.md5(sec.curriculum_prefix(C(), F.lit(0.5), **how)).alias(k) for k, how in ways.items()))


WORDS = r"list_filter(regexp_split_to_array(regexp_extract(c, '(?s)<think>(.*?)</think>', 1), '\s+'), lambda w: w <> '')"


@query("curriculum_words", f"with {ROLLOUTS}, w as (select rollout_id, c, scaffold, {WORDS} w from r) select rollout_id, md5(case when scaffold >= 1 then c when scaffold <= 0 or len(w) = 0 then '' else '<think>' || chr(10) || array_to_string(w[1:trunc(len(w) * scaffold)::int], ' ') end) prefix from w")
def curriculum_words(spark, sf_dir):
    return rollouts(spark, sf_dir).select("rollout_id", F.md5(sec.word_prefix(C(), F.col("scaffold"))).alias("prefix"))


@query("thinking_words", rf"with {ROLLOUTS} select rollout_id, len(list_filter(regexp_split_to_array(case when contains(c, '<think>') then regexp_extract(c, '(?s)<think>(.*?)(?:</think>|$)', 1) else '' end, '\s+'), lambda w: w <> ''))::int n from r")
def thinking_words(spark, sf_dir):
    return rollouts(spark, sf_dir).select("rollout_id", sec.thinking_words(C()).alias("n"))
