"""Text and path columns. All of them are built-in expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File name and suffix to language; case counts (fixed values).
FILE_NAMES = {"Kconfig": "kconfig", "Makefile": "makefile", "CMakeLists.txt": "cmake"}
LANGUAGES = {
    ".c": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".h": "c-header", ".hpp": "cpp-header", ".hh": "cpp-header", ".py": "python", ".rs": "rust",
    ".go": "go", ".java": "java", ".js": "javascript", ".ts": "typescript", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml",
    ".md": "markdown", ".rst": "restructuredtext", ".sh": "shell", ".cmake": "cmake", ".mk": "makefile", ".S": "assembly", ".s": "assembly",
}
#: Languages of documents and of code, as full-text routing names them (fixed values).
DOC_LANGUAGES = ("md", "markdown", "rst", "txt", "html")
CODE_LANGUAGES = ("c", "cpp", "cc", "h", "hpp", "py", "ts", "js", "java", "go", "rs")
#: Letters with a diacritic to their base letter, by canonical decomposition.
_FOLDED = {c: d[0] for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if (d := unicodedata.normalize("NFD", c := chr(i))) != c and d[0].isascii()}


def metadata_text(metadata: Column, key: str) -> Column:
    """A value of JSON metadata as text; a list is joined by spaces; empty, an object or missing: null."""
    raw = F.get_json_object(metadata, f"$.{key}")
    joined = F.when(F.startswith(raw, F.lit("[")), F.array_join(F.from_json(raw, "array<string>"), " ")).when(~F.startswith(raw, F.lit("{")), raw)
    return F.nullif(joined, F.lit(""))


def metadata_joined(metadata: Column, key: str) -> Column:
    """Like ``metadata_text``, but an empty list is an empty text; an object gives ``key:value`` pairs."""
    raw = F.get_json_object(metadata, f"$.{key}")
    pairs = F.array_join(F.transform(F.map_entries(F.from_json(raw, "map<string,string>")), lambda e: F.concat_ws(":", e["key"], e["value"])), " ")
    return F.when(F.startswith(raw, F.lit("[")), F.array_join(F.from_json(raw, "array<string>"), " ")).when(F.startswith(raw, F.lit("{")), pairs).otherwise(raw)


def metadata_list(metadata: Column, key: str) -> Column:
    """A list of trimmed, non-empty texts; one text is a list of itself; else empty."""
    raw = F.get_json_object(metadata, f"$.{key}")
    several = F.filter(F.transform(F.from_json(raw, "array<string>"), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.startswith(raw, F.lit("[")), several).when(raw.isNull() | (raw == "") | F.startswith(raw, F.lit("{")), F.array().cast("array<string>")).otherwise(F.array(raw))


def exact_form(text: Column) -> Column:
    """Lower-cased, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def lookup_form(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, joined by spaces."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def fold(text: Column) -> Column:
    """Letters without their diacritics."""
    return F.translate(text, "".join(_FOLDED), "".join(_FOLDED.values()))


def query_terms(text: Column) -> Column:
    """Terms of a full-text query, case kept (F2)."""
    return F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0))


def compile_query(text: Column) -> Column:
    """A full-text expression: kept tokens, all required (F1)."""
    return F.array_join(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_./:-]+"), F.lit(0)), " ")


def tokens(text: Column) -> Column:
    """Index tokens: runs of letters and digits, lower-cased, without diacritics; ``_`` splits."""
    return F.regexp_extract_all(F.lower(fold(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _shell(pattern: str, star: str = ".*", one: str = ".") -> str:
    """A shell pattern as a regular expression: ``*``, ``?`` and ``[..]`` classes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + (3 if pattern[i + 1 : i + 2] == "!" else 2)) if c == "[" else -1
        if close > 0:
            inside = pattern[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[" + ("^" + inside[1:] if inside[0] == "!" else "\\" + inside if inside[0] == "^" else inside) + "]"
            i = close
        else:
            out += star if c == "*" else one if c == "?" else re.escape(c)
        i += 1
    return out


def glob_regex(pattern: str) -> str:
    """A regular expression for a path pattern (A2).

    ``x/**`` is x and all below it, ``**/x/**`` at any depth; a pattern without a
    slash names any one component; any other matches the whole path, where ``*``
    crosses slashes, or its last components one by one.
    """
    pattern = pattern.strip().replace("\\", "/").strip("/")
    if not pattern:
        return "(?!)"
    if pattern.endswith("/**"):
        prefix = pattern[:-3].rstrip("/")
        return f"(^|/){re.escape(prefix[3:])}(/|$)" if prefix.startswith("**/") else f"^{re.escape(prefix)}(/|$)"
    if "/" not in pattern:
        return f"(?s)(^|/){_shell(pattern, '[^/]*', '[^/]')}(/|$)"
    tail = "/".join(_shell("*" if p == "**" else p, "[^/]*", "[^/]") for p in pattern.split("/"))
    return f"(?s)^{_shell(pattern)}$|(^|/){tail}$"


def matches_any(path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob_regex(p))
    return out


def language_of(path: Column) -> Column:
    """By file name, then by what follows its last dot (A4); a name's leading dot starts no suffix."""
    name = F.element_at(F.split(path, "/"), -1)
    known = lambda m: F.create_map(*[F.lit(x) for pair in m.items() for x in pair])
    return F.coalesce(F.try_element_at(known(FILE_NAMES), name), F.try_element_at(known(LANGUAGES), F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)))


def area_of(path: Column) -> Column:
    """First path component; null for files at the top (A5)."""
    return F.when(F.instr(path, "/") > 0, F.split_part(path, F.lit("/"), F.lit(1)))


def under(path: Column, scope: Column | str) -> Column:
    """Equal to a path scope or below it (C14)."""
    scope = F.lit(scope) if isinstance(scope, str) else scope
    return (path == scope) | F.startswith(path, F.concat(scope, F.lit("/")))


def excerpt(text: Column, limit: int = 240) -> Column:
    """White space collapsed, cut with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 3)), F.lit("..."))).otherwise(flat)


#: What is redacted, in order, and by what (fixed values); values of keys keep the key.
REDACTIONS = (
    (r"(?i)\b(bearer)\s+[A-Za-z0-9._~+/\-=]+", "$1"),
    (r"(?i)\b((?:api[_-]?key|password|secret|token)\s*)([:=])\s*['\"]?[^'\"\s,;]+", "$1$2***REDACTED***"),
    (r"\bAKIA[0-9A-Z]{16}\b", "***REDACTED***"),
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "***REDACTED***"),
)
ABSOLUTE_PATH = r"(?<![A-Za-z0-9_.-])/(?:[^/\s]+/){2,}[^,\s:]+"
SENSITIVE_KEYS = ("api_key", "authorization", "client_secret", "credential", "password", "private_key", "refresh_token", "secret", "token")


def redact(text: Column) -> Column:
    """Secrets and deep absolute paths replaced (Q11)."""
    (bearer, _), *rest = REDACTIONS
    # A bearer value that holds an equals sign keeps what precedes it.
    text = F.regexp_replace(text, r"(?i)\b(bearer\s+[A-Za-z0-9._~+/\-]*)=[A-Za-z0-9._~+/\-=]*", "$1=***REDACTED***")
    text = F.regexp_replace(text, r"(?i)\bbearer\s+[A-Za-z0-9._~+/\-]+(?![A-Za-z0-9._~+/\-=])", "Bearer ***REDACTED***")
    for pattern, to in rest:
        text = F.regexp_replace(text, pattern, to)
    return F.regexp_replace(text, ABSOLUTE_PATH, "[redacted:absolute_path]")


#: Characters of a query that an audit row may show (fixed value).
PREVIEW = 160


def normalized(query: Column) -> Column:
    """White space at the ends gone, elsewhere one blank."""
    return F.trim(F.regexp_replace(query, r"(?U)[\s\x1c-\x1f]+", " "))


def query_hash(query: Column) -> Column:
    """Digest of a query whatever its white space (Q12)."""
    return F.sha2(normalized(query), 256)


def query_preview(query: Column) -> Column:
    """What an audit row shows of a query: nothing of an empty or long one or one of
    several lines, else the query without its secrets (Q12)."""
    said = normalized(query)
    lines = F.length(query) - F.length(F.replace(query, F.lit("\n")))
    return F.when((said != "") & (F.length(said) <= PREVIEW) & (lines <= 1), F.substring(redact(said), 1, PREVIEW))


def audit_value(text: Column, key: str | None = None) -> Column:
    """A text as an audit row may hold it: values of sensitive keys and large texts go, long ones are cut."""
    if key is not None and any(part in key.lower() for part in SENSITIVE_KEYS):
        return F.when(text.isNotNull(), F.lit("***REDACTED***"))
    safe = redact(text)
    large = (F.length(safe) > 512) | (F.length(safe) - F.length(F.replace(safe, F.lit("\n"))) >= 3)
    return F.when(large, "[redacted:large_text]").when(F.length(safe) > 256, F.concat(F.substring(safe, 1, 256), F.lit("...<truncated>"))).otherwise(safe)


def secret_kinds(text: Column) -> Column:
    """Which secrets a text holds (Q10); any of them keeps it from being embedded."""
    names = ("bearer", "assignment", "access_key", "private_key")
    return F.filter(F.array(*[F.when(text.rlike(p), n) for n, (p, _) in zip(names, REDACTIONS, strict=True)]), lambda x: x.isNotNull())


def words_of_name(name: Column) -> Column:
    """camelCase and digit parts of a name, lower-cased."""
    return F.transform(F.regexp_extract_all(name, F.lit("[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"), F.lit(0)), F.lower)


def slug(text: Column) -> Column:
    """Anchor of a heading."""
    base = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(base == "", "section").otherwise(base)


def rounded(value: Column, places: int = 6) -> Column:
    """A double rounded as SQL on doubles does it, half away from zero after scaling;
    ``round`` alone judges the half by the shortest decimal form."""
    return F.round(value * float(10**places)) / float(10**places)
