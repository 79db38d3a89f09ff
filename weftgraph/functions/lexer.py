"""A tolerant scan of script sources: imports, HTTP calls and query keys of one file.

Comments are left out and strings kept whole; calls are found by name, and
their arguments by matching brackets.  One file is one row; Spark deals rows.
"""

from __future__ import annotations

import re

from weftgraph.functions.text import HTTP_CLIENTS, HTTP_METHODS, QUERY_HOOKS

_TOKEN = re.compile(r"""//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*"|`(?:\\.|\$\{[^}]*\}|[^`\\])*`""", re.S)
_FROM = re.compile(r"""(?<![\w.$])(?:import|export)\s*(?:type\s+)?(?:[\w$*\s{},]*?\bfrom\s*)?(['"])([^'"\n]+)\1""")
_CALL = re.compile(r"(?<![\w$.])(fetch|(?:%s)(?:\.(?:%s))?|%s)\s*(?:<[^<>()]*>)?\s*\(" % ("|".join(HTTP_CLIENTS), "|".join(HTTP_METHODS), "|".join(QUERY_HOOKS)))
_OPEN, _CLOSE = "([{", ")]}"
_MARK = re.compile(r"""[()\[\]{},'"`]""")


def without_comments(text: str) -> str:
    """Comments as spaces, so that places stay."""
    return _TOKEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][:2] in ("//", "/*") else m[0], text)


def split_arguments(text: str, at: int) -> list[str]:
    """Arguments of a call whose bracket opens before ``at``; none if it never closes."""
    parts, depth, start, i = [], 0, at, at
    while m := _MARK.search(text, i):
        i, c = m.start(), m[0]
        if c in "'\"`":
            held = _TOKEN.match(text, i)
            i = held.end() if held else i + 1
            continue
        if c in _OPEN:
            depth += 1
        elif c in _CLOSE:
            depth -= 1
            if depth < 0:
                parts.append(text[start:i])
                return [p.strip() for p in parts if p.strip()]
        elif c == "," and depth == 0:
            parts.append(text[start:i])
            start = i + 1
        i += 1
    return []


def property_of(literal: str, name: str) -> str | None:
    """Source of a property of an object literal; of a shorthand, the name."""
    for part in split_arguments(literal, 1):
        key, colon, value = part.partition(":")
        if key.strip().strip("'\"") == name:
            return value.strip() if colon else part.strip()
    return None


def specifiers(text: str) -> list[str]:
    """What a file imports, or exports again, in order."""
    return [m[2] for m in _FROM.finditer(without_comments(text))]


def calls(text: str) -> list[tuple[str, int, str, str]]:
    """(kind, line, value, extra): ``api`` with raw endpoint and method, ``query`` with key and hook."""
    clean, out = without_comments(text), []
    for m in _CALL.finditer(clean):
        arguments = split_arguments(clean, m.end())
        if not arguments:
            continue
        first, name, line = arguments[0], m[1], clean.count("\n", 0, m.start()) + 1
        if name in QUERY_HOOKS:
            if first.startswith("{"):
                key = property_of(first, "queryKey") or property_of(first, "mutationKey")
                if key:
                    out.append(("query", line, key, name))
        elif first[:1] in "'\"`":
            client, _, method = name.partition(".")
            if not method and len(arguments) > 1 and arguments[1].startswith("{"):
                method = re.sub("['\"`]", "", property_of(arguments[1], "method") or "")
            out.append(("api", line, first, (method or "GET").upper()))
    return out
