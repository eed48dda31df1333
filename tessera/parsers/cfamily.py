"""C and C++ sources: symbols, comments, includes, file headers, statements."""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame

from . import parse

# Forms of declarations, and how far each is trusted.
COMMENT = re.compile(r"/\*.*?\*/|//[^\n]*", re.DOTALL)
INCLUDE = re.compile(r'^\s*#\s*include\s*(<[^>]+>|"[^"]+")')
DEFINE = re.compile(r"^\s*#\s*define\s+([A-Za-z_]\w*)\b")
COMPOSITE = re.compile(r"(?ms)^\s*(?:typedef\s+)?(struct|enum|union|class)\s+([A-Za-z_]\w+)?\s*\{.*?\}\s*([A-Za-z_]\w+)?\s*;")
TYPEDEF = re.compile(r"(?m)^\s*typedef\s+(?!struct\b|enum\b|union\b|class\b)[^;{]+?\b([A-Za-z_]\w+)\s*;")
FORWARD = re.compile(r"(?m)^\s*(struct|enum|union|class)\s+([A-Za-z_]\w+)\s*;")
CONTROL = {"case", "catch", "do", "else", "for", "if", "return", "sizeof", "switch", "while"}
TRUST = {("function", True): 0.63, ("function", False): 0.58, ("macro", True): 0.82, ("type", True): 0.61, ("type", False): 0.61}
SYMBOLS = "name string, kind string, raw_kind string, is_definition boolean, signature string, start_line int, end_line int, confidence double"


class Lines:
    def __init__(self, text: str):
        self.starts = [0, *[m.end() for m in re.finditer("\n", text)]]

    def of(self, at: int) -> int:
        return bisect_right(self.starts, at)


def without_comments(text: str) -> str:
    """The text with comments blanked, every line and column in its place."""
    return COMMENT.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


_TOKEN = re.compile(r"\"(?:\\.|[^\"\\])*(?:\"|$)|'(?:\\.|[^'\\])*(?:'|$)|[(){};]", re.DOTALL)


def statements(masked: str):
    """(start, end) of what ends at a ``{`` (a definition) or ``;`` (a prototype)
    outside of parentheses and braces. Strings are stepped over."""
    parens = braces = at = 0
    for m in _TOKEN.finditer(masked):
        c = m[0]
        if c == "(":
            parens += 1
        elif c == ")":
            parens = max(0, parens - 1)
        elif c == "}":
            braces = max(0, braces - 1)
            at = m.end() if not braces else at
        elif c in "{;":
            if not parens and not braces:
                start = at + len(masked[at : m.end()]) - len(masked[at : m.end()].lstrip())
                yield start, m.end()
                at = m.end()
            braces += c == "{"


def symbols(path: str, text: str):
    """Macros, types and functions by line, kind and name."""
    masked, lines = without_comments(text), Lines(text)
    short = lambda a, b: " ".join(masked[a:b].split())
    found: dict[tuple, tuple] = {}

    def add(name, kind, raw, defined, signature, first, last):
        found.setdefault((name, kind, first, defined), (name, kind, raw, defined, signature, first, last, TRUST[kind, defined]))

    for n, line in enumerate(text.splitlines(), 1):
        if m := DEFINE.match(line):
            add(m[1], "macro", "define", True, line.strip(), n, n)
    for m in COMPOSITE.finditer(masked):
        where = (short(*m.span()), lines.of(m.start()), lines.of(m.end() - 1))
        for name, raw in ((m[2], m[1]), (m[3], "typedef")):
            if name:
                add(name, "type", raw, True, *where)
    for pattern, name, raw, defined in ((TYPEDEF, 1, None, True), (FORWARD, 2, 1, False)):
        for m in pattern.finditer(masked):
            add(m[name], "type", m[raw] if raw else "typedef", defined, short(*m.span()), lines.of(m.start()), lines.of(m.end() - 1))
    for a, b in statements(masked):
        said = masked[a:b]
        if "(" not in said or said.startswith(("#", "typedef ", "struct ", "enum ", "union ", "class ")):
            continue
        left = said[: said.index("(")].rstrip()
        m = re.search(r"([A-Za-z_]\w*)$", left)
        before = left[: m.start()].strip() if m else ""
        if not m or m[1] in CONTROL or not before or before.endswith(")") or before.startswith("#") or "=" in before:
            continue
        defined = said.endswith("{")
        add(m[1], "function", "definition" if defined else "prototype", defined, short(a, b), lines.of(a), lines.of(b - 1))
    yield from sorted(found.values(), key=lambda r: (r[5], r[1], r[0]))


def code_symbols(rows: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """(key, name, kind, raw_kind, is_definition, signature, lines, confidence)."""
    return parse(rows, key, path, text, symbols, SYMBOLS)


def _comments(path: str, text: str):
    lines = Lines(text)
    for m in COMMENT.finditer(text):
        yield "block" if m[0].startswith("/*") else "line", m[0].strip(), lines.of(m.start()), lines.of(m.end() - 1)


def comments(rows: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """(key, kind, text, start_line, end_line)."""
    return parse(rows, key, path, text, _comments, "kind string, text string, start_line int, end_line int")


def _includes(path: str, text: str):
    for n, line in enumerate(text.splitlines(), 1):
        if m := INCLUDE.match(line):
            yield m[1][1:-1], m[1].startswith("<"), n


def includes(rows: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """(key, target, is_system, line)."""
    return parse(rows, key, path, text, _includes, "target string, is_system boolean, line int")


def _header(path: str, text: str):
    lines = text.splitlines()
    first = next((k for k, x in enumerate(lines) if x.strip()), None)
    if first is None:
        return
    end, inside, targets, macros = first, False, [], []
    for k in range(first, len(lines)):
        bare = lines[k].strip()
        if inside:
            inside = "*/" not in bare
        elif bare.startswith("/*"):
            inside = "*/" not in bare
        elif m := INCLUDE.match(lines[k]):
            targets.append(m[1][1:-1])
        elif m := DEFINE.match(lines[k]):
            macros.append(m[1])
        elif bare and not bare.startswith(("//", "#")):
            break
        end = k + 1 if bare else end
    said = "\n".join(lines[first:end]).strip()
    if said:
        yield said, first + 1, end, targets, macros


def file_headers(rows: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """(key, text, start_line, end_line, include_targets, macro_names): comments and
    directives before a file's first line of code (I7)."""
    return parse(rows, key, path, text, _header, "text string, start_line int, end_line int, include_targets array<string>, macro_names array<string>")
