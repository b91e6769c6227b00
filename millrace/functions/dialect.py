"""The few spellings that Spark's parser refuses, rewritten outside literals, quoted names and comments."""

from __future__ import annotations

import re

from millrace.errors import MillraceError

_QUIET = re.compile(r"('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/)", re.S)


_TOKEN = re.compile(r"\s+|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|[A-Za-z_][A-Za-z0-9_]*|.", re.S)
#: Words that end the condition of QUALIFY, and those before which a SELECT of the same depth ends.
_AFTER = {"ORDER", "LIMIT", "OFFSET", "UNION", "EXCEPT", "INTERSECT", "MINUS", "CLUSTER", "DISTRIBUTE", "SORT"}


def operator_place(sql: str, start: int, stop: int) -> list[int]:
    """Where the last division outside brackets stands in a part of the text: the operator of that part."""
    depth, found = 0, []
    for m in _TOKEN.finditer(sql, start, stop):
        depth += {"(": 1, ")": -1, "[": 1, "]": -1}.get(m[0], 0)
        if m[0] == "/" and depth == 0:
            found.append(m.start())
    return found[-1:]


def qualify(sql: str) -> str:
    """`SELECT a FROM t QUALIFY c` as a filter over the same SELECT with the condition as one more column; at any depth."""
    while True:
        tokens = _TOKEN.findall(sql)
        at = next((i for i, t in enumerate(tokens) if t.upper() == "QUALIFY"), None)
        if at is None:
            return sql
        start, depth = at - 1, 0
        while start >= 0 and not (depth == 0 and tokens[start].upper() == "SELECT") and depth >= 0:
            depth += {")": 1, "(": -1}.get(tokens[start], 0)
            start -= 1
        if start < 0 or depth:
            raise MillraceError("validate_sql", "parse_error", "QUALIFY without a SELECT")
        end, depth = at + 1, 0
        while end < len(tokens) and not (depth == 0 and (tokens[end] == ")" or tokens[end].upper() in _AFTER)):
            depth += {"(": 1, ")": -1}.get(tokens[end], 0)
            end += 1
        first = next(i for i in range(start + 1, at) if tokens[i].strip())
        distinct = tokens[first].upper() == "DISTINCT"
        source, depth = first, 0
        while source < at and not (depth == 0 and tokens[source].upper() == "FROM"):
            depth += {"(": 1, ")": -1}.get(tokens[source], 0)
            source += 1
        columns, rest, condition = ("".join(x) for x in (tokens[first + distinct : source], tokens[source:at], tokens[at + 1 : end]))
        inner = f"SELECT {columns.strip()}, ({condition.strip()}) AS __qualifies {rest.strip()}"
        sql = "".join(tokens[:start]) + f"SELECT {'DISTINCT ' if distinct else ''}* EXCEPT (__qualifies) FROM ({inner}) WHERE __qualifies " + "".join(tokens[end:])


def to_spark(sql: str) -> str:
    """Bare VARCHAR becomes STRING; generate_series(a, b) in FROM becomes range over the same values; the g flag of
    regexp_replace, which replaces all matches anyway, is dropped; QUALIFY becomes a filter."""
    if re.search(r"\bqualify\b", sql, re.I):
        sql = qualify(sql)
    parts = _QUIET.split(sql)
    for i in range(0, len(parts), 2):
        parts[i] = re.sub(r"\bvarchar\b(?!\s*\()", "STRING", parts[i], flags=re.I)
        parts[i] = re.sub(r"\bgenerate_series\s*\(\s*([^(),]+?)\s*,\s*([^(),]+?)\s*\)", r"(SELECT id AS value FROM range(\1, (\2) + 1))", parts[i], flags=re.I)
    out = "".join(parts)
    return re.sub(r"(\bregexp_replace\s*\((?:[^()']|'(?:[^']|'')*'|\([^()]*\))*),\s*'g'\s*\)", r"\1)", out, flags=re.I)
