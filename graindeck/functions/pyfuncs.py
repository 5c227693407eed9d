"""What built-in expressions can't say, in Arrow batches: sequence matching, compression and call parsing."""

from __future__ import annotations

import ast
import json
import re
import zlib
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F, types as T


def normalized(x: str | None) -> str:
    return " ".join((x or "").lower().split())


def match_ratio(a: str, b: str) -> float:
    """1 for equal texts, 0 without one of them, else the share of matching blocks."""
    if a == b:
        return 1.0
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


@F.pandas_udf(T.DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([match_ratio(normalized(x), normalized(y)) for x, y in zip(a, b)], dtype=float)


def close_number(x: str) -> float | None:
    """A number with thousands' commas, a decimal comma, a percentage, a fraction, or the first one in a text."""
    s = re.sub(r"(?<=\d),(?=\d{3}(?:\D|$))", "", x.strip())
    share = 0.01 if s.endswith("%") else 1.0
    s = s[:-1].strip() if share < 1 else s
    tries = [s, s.replace(",", ".") if s.count(",") == 1 else s]
    for t in tries:
        try:
            return float(t) * share
        except ValueError:
            pass
    if m := re.fullmatch(r"\s*(-?[\d.]+)\s*/\s*(-?[\d.]+)\s*", s):
        try:
            return float(m.group(1)) / float(m.group(2))
        except (ValueError, ZeroDivisionError):
            pass
    m = re.search(r"-?\d+\.?\d*", s)
    return float(m.group()) * share if m else None


def likeness(a: str | None, b: str | None) -> float:
    """1 for equal texts, 0.9 and more for one within the other, by bands for near numbers, else the share of matching blocks."""
    x, y = normalized(a), normalized(b)
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    if y in x or x in y:
        return 0.9 + 0.1 * min(len(x), len(y)) / max(len(x), len(y))
    p, q = close_number(x), close_number(y)
    if p is not None and q is not None:
        if p == q:
            return 1.0
        if q:
            error = abs(p - q) / max(abs(p), abs(q))
            for limit, score in ((0.001, 0.99), (0.01, 0.95), (0.05, 0.85)):
                if error < limit:
                    return score
    return match_ratio(x, y)


@F.pandas_udf(T.DoubleType())
def fuzzy_match(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([likeness(x, y) for x, y in zip(a, b)], dtype=float)


@F.pandas_udf(T.DoubleType())
def compression_ratio(a: pd.Series) -> pd.Series:
    """Compressed bytes over bytes; 1 for no text."""
    raw = [(x or "").encode() for x in a]
    return pd.Series([len(zlib.compress(x, 9)) / len(x) if x else 1.0 for x in raw], dtype=float)


def distance(a: bytes, b: bytes) -> float:
    """Normalized compression distance, in [0, 1]."""
    x, y, xy = (len(zlib.compress(s, 9)) for s in (a, b, a + b))
    return min(1.0, max(0.0, (xy - min(x, y)) / max(x, y)))


@F.pandas_udf(T.DoubleType())
def compression_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 if either text is empty."""
    return pd.Series([distance(x.encode(), y.encode()) if x and y else 1.0 for x, y in zip(a, b)], dtype=float)


@F.pandas_udf(T.DoubleType())
def similarity_by_compression(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([1.0 - distance(x.encode(), y.encode()) if x and y else 0.0 for x, y in zip(a, b)], dtype=float)


def parses_one(code: str | None) -> bool:
    try:
        ast.parse(code or "")
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return False
    return True


@F.pandas_udf(T.BooleanType())
def parses(codes: pd.Series) -> pd.Series:
    """Whether any of a row's codes is valid Python. Nothing is run."""
    return pd.Series([any(parses_one(c) for c in row) if row is not None else False for row in codes])


CALL_TEXT = re.compile(r"([a-zA-Z_][a-zA-Z0-9_]*)\s*\(([^)]*)\)")
NAMED = re.compile(r"\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*")


def canonical(value) -> str | None:
    """A value as a text that equal values share: texts without quotes and case, floats to 6 places."""
    if value is None or value == "null":
        return None
    if isinstance(value, str):
        return "s" + value.strip().strip("\"'").lower()
    if isinstance(value, (bool, int, float)):
        return "n" + repr(round(float(value), 6))
    if isinstance(value, (list, tuple)):
        return "l" + repr([canonical(v) for v in value])
    if isinstance(value, dict):
        return "d" + repr(sorted((str(k), canonical(v)) for k, v in value.items()))
    return "o" + repr(value)


def literal(text: str):
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return text.strip("\"'")


def pieces(text: str):
    """What commas part at no depth of brackets and outside quotes."""
    depth, quote, start = 0, "", 0
    for i, ch in enumerate(text):
        if ch in "\"'":
            quote = "" if quote == ch else quote or ch
        elif not quote and ch in "([{":
            depth += 1
        elif not quote and ch in ")]}":
            depth -= 1
        elif not quote and not depth and ch == ",":
            yield text[start:i]
            start = i + 1
    yield text[start:]


def parameters(text: str) -> dict[str, str | None]:
    """The parameters of a call, as canonical texts: those of a dict's inside, else name=value until one has no name."""
    try:
        whole = ast.literal_eval("{" + text + "}")
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        whole = None
    if isinstance(whole, dict):
        return {str(k): canonical(v) for k, v in whole.items()}
    out = {}
    for piece in pieces(text):
        m = NAMED.match(piece)
        if not m:
            break
        out[m.group(1)] = canonical(literal(piece[m.end() :].strip()))
    return out


def called(text: str | None) -> list[dict]:
    """The calls f(...) of a text, without nested parentheses."""
    return [{"name": m.group(1), "params": parameters(m.group(2).strip()) if m.group(2).strip() else {}} for m in CALL_TEXT.finditer(text or "")]


def call_score(got: list[dict], want: list[dict]) -> tuple[float, float, float, float]:
    """exact, names, parameters and overall. Calls meet by position if there are as many; else names count, for half."""
    if not got or not want:
        same = float(not got and not want)
        return same, same, same, same
    if len(got) != len(want):
        wanted = {w["name"] for w in want}
        hits = sum(g["name"] in wanted for g in got) / max(len(got), len(want))
        return 0.0, hits, 0.0, hits / 2
    names = shares = 0.0
    exact = True
    for g, w in zip(got, want):
        if g["name"] != w["name"]:
            exact = False
            continue
        names += 1
        if g["params"] == w["params"]:
            shares += 1
            continue
        exact = False
        if w["params"]:
            shares += sum(k in g["params"] and g["params"][k] == v for k, v in w["params"].items()) / len(w["params"])
    names, shares = names / len(want), shares / len(want)
    return float(exact), names, shares, 0.4 * names + 0.4 * shares + 0.2 * exact


SCORES = ("exact", "names", "parameters", "overall")


@F.pandas_udf(T.StructType([T.StructField(k, T.DoubleType()) for k in SCORES]))
def call_scores(got: pd.Series, want: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([call_score(called(g), called(w)) for g, w in zip(got, want)], columns=SCORES)


WHOLE_CALL = re.compile(r"(\w+)\((.*)\)$", re.DOTALL)


def plain_arguments(text: str) -> dict:
    """The parameters of a call by name, as values."""
    out = {}
    for piece in pieces(text):
        if m := NAMED.match(piece):
            out[m.group(1)] = literal(piece[m.end() :].strip())
    return out


def tagged(call: dict) -> str:
    return f"<tool_call>\n{json.dumps(call, default=str)}\n</tool_call>"


def hermes(answer: str | None) -> str | None:
    """An answer's lines that are calls, as JSON or as f(a=1), in tags; other lines stay."""
    if answer is None or "<tool_call>" in answer:
        return answer
    out = []
    for line in filter(None, map(str.strip, answer.strip().split("\n"))):
        try:
            found = json.loads(line) if line.startswith("{") else None
        except ValueError:
            found = None
        if isinstance(found, dict) and "name" in found:
            arguments = found.get("arguments", {})
            if isinstance(arguments, str):
                try:
                    arguments = json.loads(arguments)
                except ValueError:
                    pass
            out.append(tagged({"name": found["name"], "arguments": arguments}))
        elif m := WHOLE_CALL.match(line):
            out.append(tagged({"name": m.group(1), "arguments": plain_arguments(m.group(2).strip())}))
        else:
            out.append(line)
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def to_hermes(a: pd.Series) -> pd.Series:
    return pd.Series([hermes(x) for x in a], dtype=object)


# JSON schema types of parameter types.
JSON_TYPES = {"str": "string", "string": "string", "int": "integer", "integer": "integer", "float": "number", "number": "number", "bool": "boolean", "boolean": "boolean", "list": "array", "array": "array", "dict": "object", "object": "object"}


def json_type(kind: str) -> str:
    """string for a type without a JSON one; what follows a comma, as in "int, optional", doesn't count."""
    return JSON_TYPES.get(kind.split(",")[0].strip().lower(), "string")


def tool_schema(tool: str | None) -> str | None:
    """A tool's simple definition as the JSON of a function schema; parameters without a default are required. Null for no object."""
    try:
        given = json.loads(tool or "")
    except ValueError:
        return None
    if not isinstance(given, dict):
        return None
    properties, required = {}, []
    for name, info in (given.get("parameters") or {}).items():
        if not isinstance(info, dict):
            properties[name] = {"type": json_type(str(info))}
            required.append(name)
            continue
        properties[name] = {"type": json_type(str(info.get("type", "string"))), "description": info.get("description", "")} | {k: info[k] for k in ("enum", "default") if k in info}
        if info.get("default", "") == "":
            required.append(name)
    parameters = {"type": "object", "properties": properties} | ({"required": required} if required else {})
    return json.dumps({"type": "function", "function": {"name": given.get("name", "unknown"), "description": given.get("description", ""), "parameters": parameters}})


@F.pandas_udf(T.StringType())
def to_tool_schema(a: pd.Series) -> pd.Series:
    return pd.Series([tool_schema(x) for x in a], dtype=object)
