"""Task types: aliases, validation by type, detection, and what each type's rows are prepared with."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.text import strip

# Other names of the canonical types.
ALIASES = {
    "tool_call": ("tool", "function", "function_calling", "functioncalling", "func", "tool_use", "api_call"),
    "mcq": ("exam", "aime", "exam_math", "exam_aime", "exam_olympiad", "olympiad", "multiple_choice"),
    "math": ("arithmetic", "calculus", "algebra", "geometry", "number_theory", "combinatorics", "probability", "statistics", "gsm8k", "math500", "competition_math"),
    "python": ("code", "coding", "programming", "py"),
    "general_qna": ("thinking", "reasoning", "default"),
}
# The coarser names, of tool calls and exams only.
COARSE = {"tool_call": ALIASES["tool_call"], "exam": ("aime", "math500", "exam_math", "exam_aime", "exam_olympiad", "olympiad", "mcq", "multiple_choice")}
#: In the order in which types are tried.
TYPES = ("tool_call", "mcq", "math", "python", "general_qna")
# Raw types that a validator takes without looking further.
TAKEN = {
    "math": ("math", "arithmetic", "calculus", "algebra", "geometry", "number_theory", "combinatorics", "probability", "statistics", "gsm8k", "competition_math"),
    "mcq": ("mcq", "exam", "aime", "math500", "exam_math", "exam_aime", "exam_olympiad", "olympiad", "multiple_choice"),
    "python": ("python", "code", "coding", "programming", "py"),
}
CODE_WORDS = ("write a function", "implement", "write code", "python", "def ", "class ", "algorithm")
SYSTEM = {
    "tool_call": "You are a helpful assistant.",
    "other": "Think step by step inside <think> tags, then answer.",
}


def named(raw: Column, aliases: dict[str, tuple[str, ...]]) -> Column:
    """The canonical name of a trimmed, lower-cased name; a name that is no alias is its own."""
    name = F.lower(strip(raw))
    lookup = F.create_map(*(F.lit(x) for to, names in aliases.items() for n in names for x in (n, to)))
    return F.coalesce(lookup[name], name)


def normalized_type(raw: Column) -> Column:
    """A null type is general_qna."""
    return F.when(raw.isNull(), "general_qna").otherwise(named(raw, ALIASES))


def coarse_type(raw: Column) -> Column:
    """Null for a null or blank type."""
    return F.nullif(named(raw, COARSE), F.lit(""))


def invalid_reasons(prompt: Column, answer: Column, raw: Column, ground_truth: Column | None = None, possible: Column | None = None, strict: bool = True, think_tags: bool = False) -> dict[str, Column]:
    """For each type why a row isn't one of it; null for a valid row."""
    a, kind = strip(answer), F.lower(F.coalesce(raw, F.lit("")))
    missing = F.when(prompt.isNull(), "no prompt").when(answer.isNull(), "no answer")
    call = answer.contains("<tool_call>") | answer.rlike(r"(?U)\b[a-zA-Z_]\w*\s*\([^)]*\)")
    tool = missing.when(~call, "no call")
    if strict:
        tool = tool.when(answer.contains("<think>") | answer.contains("</think>"), "thinking").when(answer.contains("\\boxed{"), "boxed")
    given = F.lit(False)
    for c in (ground_truth, possible):
        given = given if c is None else given | c.isNotNull()
    mcq = kind.isin(*TAKEN["mcq"]) | given | a.rlike("^[A-Da-d]$")
    math = kind.isin(*TAKEN["math"]) | a.rlike(r"^-?\d+(\.\d+)?$|\\boxed\{|####\s*.|^-?\d+/\d+$") | prompt.rlike(r"(?U)[=<>≤≥±]|\\(?:frac|sqrt|sum|int|lim)\b")
    asked = F.lower(prompt)
    code = kind.isin(*TAKEN["python"]) | answer.rlike(r"(?i)def |class |import |from .+ import|```python|```py")
    for w in CODE_WORDS:
        code = code | asked.contains(w)
    general = missing.when(F.length(strip(prompt)) < 5, "short prompt").when(F.length(a) < 2, "short answer")
    if think_tags:
        general = general.when(~answer.contains("<think>"), "no thinking")
    return {"tool_call": tool, "mcq": missing.when(~mcq, "not an exam"), "math": missing.when(~math, "not math"), "python": missing.when(~code, "not code"), "general_qna": general}


def detected_type(prompt: Column, answer: Column, raw: Column) -> Column:
    """The given type if it is a known one, else the first type whose validator accepts the row; null if none does."""
    reasons = invalid_reasons(prompt, answer, raw)
    given = normalized_type(raw)
    out = F.when(raw.isNotNull() & given.isin(*TYPES), given)
    for t in TYPES:
        out = out.when(reasons[t].isNull(), t)
    return out


def worked_answer(answer: Column) -> Column:
    """What follows the first #### of a worked answer, without thousands' commas; else the answer, trimmed."""
    tail = strip(F.regexp_extract(answer, r"(?m)####\s*(.+)$", 1))
    return F.when(answer.rlike(r"####\s*."), F.replace(tail, F.lit(","), F.lit(""))).otherwise(strip(answer))


def prepared(answer: Column) -> dict[str, Column]:
    """What the types' rows are prepared with: the math answer and its shape, letters, code, and names of functions called."""
    a = worked_answer(answer)
    hermes = F.filter(F.transform(F.regexp_extract_all(answer, F.lit(r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"), F.lit(1)), lambda x: F.get_json_object(x, "$.name")), lambda x: x.isNotNull() & (x != ""))
    legacy = F.regexp_extract_all(answer, F.lit(r"(?U)\b([a-zA-Z_]\w*)\s*\("), F.lit(1))
    return {
        "math_answer": a,
        "is_boxed": a.contains("\\boxed{"),
        "is_numeric": a.rlike(r"^-?\d+(\.\d+)?$"),
        "is_letter": strip(answer).rlike("^[A-Da-d]$"),
        "has_code": answer.contains("```"),
        "functions": F.sort_array(F.array_distinct(F.when(answer.contains("<tool_call>"), hermes).otherwise(legacy))),
    }


def cleaned_call(answer: Column) -> Column:
    """A tool call's answer without thinking sections and boxes."""
    return strip(F.regexp_replace(F.regexp_replace(answer, r"(?s)<think>.*?</think>\s*", ""), r"\\boxed\{[^}]*\}", ""))


def system_prompt(kind: Column) -> Column:
    return F.when(kind == "tool_call", SYSTEM["tool_call"]).otherwise(SYSTEM["other"])
