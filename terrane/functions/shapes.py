"""Shapes of responses: the top-level keys of objects that handlers send, told by a walk over brackets, strings and comments.

The walk looks at every token once and keeps a stack of open brackets, so its time is that of the text's length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_STRINGS = r""""(?:[^"\\]|\\.)*(?:"|\Z)|'(?:[^'\\]|\\.)*(?:'|\Z)"""
SCRIPT = re.compile(rf"""(?P<skip>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>{_STRINGS}|`(?:[^`\\]|\\.)*(?:`|\Z))|(?P<word>[A-Za-z_$][\w$]*)|(?P<sign>\.\.\.|[{{}}()\[\],:.]|[^\s\w])""", re.S)
PHP = re.compile(rf"""(?P<skip>//[^\n]*|\#[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>{_STRINGS})|(?P<word>[A-Za-z_$][\w$]*)|(?P<sign>=>|[{{}}()\[\],]|[^\s\w])""", re.S)
CLOSERS = {"}": "{", ")": "(", "]": "["}
CHAINED = re.compile(r"\.status\s*\(\s*(\d{3})\s*\)\s*\Z")
OPTIONS = re.compile(r"\s*,\s*\{[^}]*status\s*:\s*(\d{3})")
PHP_END = re.compile(r"\b(?:exit|die)\s*(?:\([^)]*\))?\s*;")
PHP_STATUS = (re.compile(r"http_response_code\s*\(\s*(\d{3})\s*\)"), re.compile(r"header\s*\(\s*['\"]HTTP/[\d.]+\s+(\d{3})"), re.compile(r"header\s*\(\s*['\"]Status:\s*(\d{3})"))
PLAIN_KEY = re.compile(r"[A-Za-z_]\w*\Z")
#: How far from a call its status is looked for.
BEFORE, AFTER, PHP_BEFORE = 200, 150, 300


class Walk:
    """A stack of open brackets; those that open a response collect its keys."""

    def __init__(self) -> None:
        self.open: list[list] = []  # bracket, response or None, whether an entry begins, candidate for a key
        self.counts = dict.fromkeys("{([", 0)
        self.found: list[dict] = []

    def push(self, bracket: str, response: dict | None = None) -> None:
        self.open.append([bracket, response, True, None])
        self.counts[bracket] += 1
        if response is not None:
            self.found.append(response)

    def close(self, bracket: str, at: int) -> None:
        """Close the nearest bracket of this kind, and what was left open within it; a closer without one is ignored."""
        if not self.counts[bracket]:
            return
        while True:
            top = self.open.pop()
            self.counts[top[0]] -= 1
            if top[0] == bracket:
                if top[1] is not None:
                    top[1]["end"] = at
                return


def script_responses(content: str) -> list[tuple[list[str], int | None]]:
    """Keys and status of every ``.json(`` call that is given an object: names and strings before ``:``, and names that stand alone.

    The object is the first that opens before a parenthesis closes. Only what begins an entry is a key; values, spreads, methods and computed
    names are not. What stands in strings and comments does not count; template literals are strings as a whole.
    """
    walk, last, waiting = Walk(), ["", ""], None
    for m in SCRIPT.finditer(content):
        if m["skip"]:
            continue
        token, kind = m[0], m.lastgroup
        top = walk.open[-1] if walk.open else None
        response = top[1] if top else None
        if response is not None and top[3] is not None:
            name, quoted = top[3]
            if token == ":" or (not quoted and token in (",", "}")):
                response["keys"].append(name)
            top[3] = None
        if response is not None and token not in CLOSERS:
            if top[2] and kind in ("word", "text"):
                top[3] = (token[1:-1], True) if kind == "text" else (token, False)
            top[2] = token == ","
        if token in "{([":
            starts = waiting is not None and token == "{"
            walk.push(token, {"keys": [], "at": waiting, "end": None} if starts else None)
            waiting = None if starts else waiting
            if token == "(" and last == [".", "json"]:
                waiting = dot
        elif token in CLOSERS:
            waiting = None if token == ")" else waiting
            walk.close(CLOSERS[token], m.start())
        if token == ".":
            dot = m.start()
        last = [last[1], token]
    out = []
    for r in walk.found:
        status = CHAINED.search(content[max(0, r["at"] - BEFORE) : r["at"]]) or (r["end"] and OPTIONS.match(content[r["end"] + 1 : r["end"] + 1 + AFTER]))
        out.append((r["keys"], int(status[1]) if status else None))
    return out


def php_responses(content: str) -> list[tuple[list[str], int | None]]:
    """Keys and status of every ``json_encode`` of an array literal: plain strings before ``=>``; the status is the last one set since the script last ended."""
    walk, last, waiting = Walk(), ["", "", ""], None
    for m in PHP.finditer(content):
        if m["skip"]:
            continue
        token, kind = m[0], m.lastgroup
        top = walk.open[-1] if walk.open else None
        if top and top[1] is not None:
            if token == "=>" and top[3] is not None:
                top[1]["keys"].append(top[3])
            top[3] = token[1:-1] if kind == "text" and PLAIN_KEY.match(token[1:-1]) else None
        if token in "{([":
            call = last[1:] == ["json_encode", "("] and token == "[" or last == ["json_encode", "(", "array"] and token == "("
            walk.push(token, {"keys": [], "at": waiting, "end": None} if call else None)
        elif token in CLOSERS:
            walk.close(CLOSERS[token], m.start())
        if token == "json_encode":
            waiting = m.start()
        last = [*last[1:], token]
    out = []
    for r in walk.found:
        before = content[max(0, r["at"] - PHP_BEFORE) : r["at"]]
        before = before[max((m.end() for m in PHP_END.finditer(before)), default=0) :]
        status = next((s[-1] for s in (p.findall(before) for p in PHP_STATUS) if s), None)
        if r["end"] is not None:
            out.append((r["keys"], int(status) if status else None))
    return out


SHAPES = "path string, key string, kind string, seq int"


def response_shapes(files: DataFrame) -> DataFrame:
    """``path``, ``key``, ``kind`` (success or error: status 400 and above), ``seq`` (order of first sight) of ``files`` (``path``, ``content``).

    Each key once for each kind. PHP files are read by their own calls, all others as scripts. Null and empty contents have none; very long
    ones are read whole. Other columns play no part.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                read = php_responses if (path or "").lower().endswith(".php") else script_responses
                seen: dict[tuple[str, str], int] = {}
                for keys, status in read(content or ""):
                    for key in keys:
                        seen.setdefault((key, "error" if status is not None and status >= 400 else "success"), len(seen))
                rows += [(path, key, kind, n) for (key, kind), n in seen.items()]
            yield pd.DataFrame(rows, columns=["path", "key", "kind", "seq"])

    return files.select("path", "content").mapInPandas(run, SHAPES)
