"""Markdown and HTML: front matter, headings, sections."""

from __future__ import annotations

import json
import os
import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from . import parse

try:
    import yaml
except ImportError:
    yaml = None

# Forms of headings and fences, fields of front matter.
ATX = re.compile(r"^\s{0,3}(#{1,6})[ \t]+(.+?)(?:[ \t]+#+[ \t]*)?$")
UNDER_1, UNDER_2 = re.compile(r"^\s*=+\s*$"), re.compile(r"^\s*-+\s*$")
FENCE = re.compile(r"^\s*(```+|~~~+)")
COMMON = {"title": "string", "authority_level": "string", "profiles": "string_list", "tags": "string_list"}
BY_CATEGORY = {
    "api": {"module": "string", "version": "string", "code_symbols": "string_list"},
    "widgets": {"widget": "string", "ui_framework": "string", "code_paths": "string_list"},
}
CATEGORIES = {"widget": "widgets"}
SECTIONS = "ordinal int, chunk_type string, heading_path array<string>, anchor string, level int, start_line int, end_line int, text string"
HEADINGS = "ordinal int, level int, title string, heading_path array<string>, anchor string, start_line int"


def flat(text: str) -> str:
    return " ".join(text.split())


def category_of(path: str) -> str | None:
    """The folder below knowledge-sources, else the last folder."""
    parts = path.split("/")
    name = None
    if "knowledge-sources" in parts[:-1]:
        name = parts[parts.index("knowledge-sources") + 1]
    elif len(parts) > 1:
        name = parts[-2]
    return None if name is None else CATEGORIES.get(name.strip().lower(), name.strip().lower())


# --- front matter (I1) --------------------------------------------------------------------------


def _plain_yaml(text: str):
    """Flat ``key: value`` lines, ``[a, b]`` and ``- item`` lists, for where no YAML
    library is at hand; anything else is an error."""
    scalar = lambda v: None if v in ("", "~", "null") else v.strip("\"'")
    out: dict = {}
    last = None
    for line in text.split("\n"):
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        if bare.startswith("- ") and last is not None and out[last] in (None, []) or bare.startswith("- ") and isinstance(out.get(last), list):
            out[last] = [*(out[last] or []), scalar(bare[2:].strip())]
            continue
        m = re.match(r"^([A-Za-z_][\w -]*):(?:\s+(.*))?$", line)
        if not m:
            raise ValueError(f"can't read {line!r}")
        last, value = m[1], (m[2] or "").strip()
        out[last] = [scalar(x.strip()) for x in value[1:-1].split(",") if x.strip()] if value[:1] == "[" and value[-1:] == "]" else scalar(value)
    return out


def front_matter(text: str) -> tuple[dict, list[str], int, list[str]]:
    """(fields, lines of the body, number of its first line, warnings)."""
    lines = text.splitlines()
    if not lines or lines[0].strip() != "---":
        return {}, lines, 1, []
    end = next((k for k, x in enumerate(lines[1:], 1) if x.strip() in ("---", "...")), None)
    if end is None:
        return {}, lines, 1, ["doc.front_matter_unterminated"]
    body, block = lines[end + 1 :], "\n".join(lines[1:end])
    try:
        held = (yaml.safe_load(block) if yaml else _plain_yaml(block)) if block.strip() else None
    except Exception:  # whatever the library raises on bad YAML
        return {}, body, end + 2, ["doc.front_matter_invalid_yaml"]
    if held is None:
        return {}, body, end + 2, []
    if not isinstance(held, dict):
        return {}, body, end + 2, ["doc.front_matter_not_mapping"]
    return {str(k): v for k, v in held.items()}, body, end + 2, []


def typed_fields(fields: dict, category: str | None) -> tuple[dict, dict, list[str]]:
    """(known, others, warnings): known fields as texts or lists of texts."""
    kinds = COMMON | BY_CATEGORY.get(category or "", {})
    known, others, warnings = {}, {}, []
    simple = (str, int, float, bool)
    for k, v in fields.items():
        kind = kinds.get(k)
        if kind is None:
            others[k] = v
        elif kind == "string":
            if isinstance(v, simple):
                known[k] = str(v)
            elif v is not None:
                warnings.append("doc.front_matter_invalid_type")
        elif v is not None:
            items = [v] if isinstance(v, str) else v if isinstance(v, (list, tuple)) else None
            good = items is not None and all(isinstance(x, simple) for x in items)
            known[k] = [str(x) for x in items] if good else []
            warnings += [] if good else ["doc.front_matter_invalid_type"]
    return known, others, warnings


def _front(path: str, text: str):
    fields, _, first, warned = front_matter(text)
    known, others, more = typed_fields(fields, category_of(path))
    yield json.dumps(known, sort_keys=True, ensure_ascii=True), json.dumps(others, sort_keys=True, ensure_ascii=True, default=str), first, warned + more


def front_matters(rows: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """(key, known, others, body_line, warnings) (I1); fields are JSON objects."""
    return parse(rows, key, path, text, _front, "known string, others string, body_line int, warnings array<string>")


# --- headings (I2, I3) ----------------------------------------------------------------------------


def marked_lines(lines: list[str]):
    """(index, level, title) of headings: ``#`` lines and underlined lines outside fences."""
    fence, skip = None, False
    for k, line in enumerate(lines):
        if skip:
            skip = False
            continue
        if m := FENCE.match(line):
            mark = m[1][:3]
            fence = mark if fence is None else None if fence == mark else fence
        elif fence is None:
            below = lines[k + 1] if k + 1 < len(lines) else ""
            if m := ATX.match(line):
                yield k, len(m[1]), flat(m[2])
            elif line.strip() and below and (UNDER_1.match(below) or UNDER_2.match(below)):
                skip = True
                yield k, 1 if UNDER_1.match(below) else 2, flat(line)


class Outline:
    """Paths of nested headings, and anchors that are unique in a document."""

    def __init__(self):
        self.open: list[tuple[int, str]] = []
        self.used: dict[str, int] = {}

    def add(self, level: int, title: str) -> tuple[list[str], str]:
        self.open = [h for h in self.open if h[0] < level] if any(h[0] >= level for h in self.open) else self.open
        self.open.append((level, title))
        base = re.sub("[^a-z0-9]+", "-", title.lower()).strip("-") or "section"
        self.used[base] = n = self.used.get(base, 0) + 1
        return [t for _, t in self.open], base if n == 1 else f"{base}-{n}"


def _headings(path: str, text: str):
    _, body, first, _ = front_matter(text)
    outline = Outline()
    for n, (k, level, title) in enumerate(marked_lines(body)):
        yield n, level, title, *outline.add(level, title), first + k


def headings(rows: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """(key, ordinal, level, title, heading_path, anchor, start_line)."""
    return parse(rows, key, path, text, _headings, HEADINGS)


# --- sections (I4, I5) ------------------------------------------------------------------------------


def _markdown(path: str, text: str):
    _, body, first, _ = front_matter(text)
    yield from _below(body, first)


def _below(body: list[str], first: int):
    """Sections of the lines below front matter."""
    outline, marks = Outline(), list(marked_lines(body))
    parts = [(0, marks[0][0] if marks else len(body), "markdown.lead" if marks else "markdown.body", [], None, None)]
    for (k, level, title), (end, *_) in zip(marks, [*marks[1:], (len(body),)], strict=False):  # without marks: none
        parts.append((k, end, "markdown.section", *outline.add(level, title), level))
    n = 0
    for a, b, kind, names, anchor, level in parts:
        while a < b and not body[a].strip():
            a += 1
        while b > a and not body[b - 1].strip():
            b -= 1
        if a < b:
            yield n, kind, names, anchor, level, first + a, first + b - 1, "\n".join(body[a:b]).strip()
            n += 1


class _Blocks(HTMLParser):
    """(kind, text, first line, last line, level) of headings, paragraphs, items and
    table rows; loose text apart."""

    PARTS = {"title": "title", "p": "body", "li": "body"} | {f"h{k}": "heading" for k in range(1, 7)}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple] = []
        self.loose: list[tuple[int, str]] = []
        self.open: list[tuple[str, int, list[str]]] = []
        self.row: tuple[int, list[str]] | None = None
        self.cell: list[str] | None = None
        self.title: str | None = None

    def handle_starttag(self, tag, attrs):
        line = self.getpos()[0]
        if tag in self.PARTS:
            self.open.append((tag, line, []))
        elif tag == "tr":
            self.row = (line, [])
        elif tag in ("td", "th") and self.row is not None:
            self.cell = []

    def handle_endtag(self, tag):
        line = self.getpos()[0]
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == tag), None)
        if at is not None:
            _, start, said = self.open.pop(at)
            text, kind = flat("".join(said)), self.PARTS[tag]
            if text and kind == "title":
                self.title = text
            elif text:
                self.found.append((kind, text, start, line, int(tag[1]) if kind == "heading" else None))
        elif tag in ("td", "th") and self.cell is not None:
            text, self.cell = flat("".join(self.cell)), None
            if text and self.row is not None:
                self.row[1].append(text)
        elif tag == "tr" and self.row is not None:
            (start, cells), self.row = self.row, None
            if cells:
                self.found.append(("table_row", " | ".join(cells), start, line, None))

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)
        elif self.open:
            self.open[-1][2].append(data)
        elif text := flat(data):
            self.loose.append((self.getpos()[0], text))

    @classmethod
    def of(cls, text: str) -> _Blocks:
        out = cls()
        out.feed(text)
        out.close()
        if not out.found and out.loose:
            out.found.append(("body", "\n".join(t for _, t in out.loose), out.loose[0][0], out.loose[-1][0], None))
        return out


def _html_blocks(path: str, text: str):
    for n, (kind, said, a, b, level) in enumerate(_Blocks.of(text).found):
        yield n, kind, said, a, b, level


def html_blocks(rows: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """(key, ordinal, kind, text, start_line, end_line, level) of an HTML page."""
    return parse(rows, key, path, text, _html_blocks, "ordinal int, kind string, text string, start_line int, end_line int, level int")


def _html(path: str, text: str):
    found = _Blocks.of(text).found
    marks = [k for k, b in enumerate(found) if b[0] == "heading"]
    outline = Outline()
    parts = [(0, marks[0] if marks else len(found), "html.lead" if marks else "html.body", [], None, None)]
    for k, end in zip(marks, [*marks[1:], len(found)], strict=False):
        parts.append((k, end, "html.section", *outline.add(found[k][4], found[k][1]), found[k][4]))
    for n, (a, b, kind, names, anchor, level) in enumerate(p for p in parts if p[0] < p[1]):
        yield n, kind, names, anchor, level, found[a][2], found[b - 1][3], "\n".join(x[1] for x in found[a:b])


def _sections(path: str, text: str):
    return _html(path, text) if path.lower().endswith((".html", ".htm")) else _markdown(path, text)


def sections(rows: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """(key, ordinal, chunk_type, heading_path, anchor, level, start_line, end_line,
    text): a document by its headings (I4, I5), HTML if its path says so."""
    return parse(rows, key, path, text, _sections, SECTIONS)


def _titles(path: str, text: str):
    html = path.lower().endswith((".html", ".htm"))
    named = _Blocks.of(text).title if html else typed_fields(front_matter(text)[0], category_of(path))[0].get("title")
    if not named:
        named = next((b[1] for b in _Blocks.of(text).found if b[0] == "heading"), None) if html else next((t for _, _, t in marked_lines(front_matter(text)[1])), None)
    yield named or os.path.splitext(path.rsplit("/", 1)[-1])[0], category_of(path)


def titles(rows: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """(key, title, category): front matter's or the page's title, else the first heading, else the file's name."""
    return parse(rows, key, path, text, _titles, "title string, category string")


def _outline(path: str, text: str):
    fields, body, first, _ = front_matter(text)
    category = category_of(path)
    known, _, _ = typed_fields(fields, category)
    html = path.lower().endswith((".html", ".htm"))
    named = known.get("title") or next((t for _, _, t in marked_lines(body)), None)
    title = next(_titles(path, text))[0] if html else named or os.path.splitext(path.rsplit("/", 1)[-1])[0]
    names = [f.split()[0] for f in SECTIONS.split(", ")]
    yield json.dumps(known, sort_keys=True, ensure_ascii=True), title, category, [dict(zip(names, s, strict=True)) for s in (_html(path, text) if html else _below(body, first))]


def outlines(rows: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """(key, known, title, category, sections): what ``front_matters``, ``titles`` and
    ``sections`` give, of one reading of each text."""
    fields = ", ".join(": ".join(f.split()) for f in SECTIONS.split(", "))
    return parse(rows, key, path, text, _outline, f"known string, title string, category string, sections array<struct<{fields}>>")
