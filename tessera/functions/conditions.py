"""Build conditions as columns: Kleene logic is SQL's own."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s*(\|\||&&|ifn?eq\s*(?=\()|\(|\)|,|!|not\b|\$\([A-Za-z_]\w*\)|"[^"]*"|'[^']*'|[A-Za-z_][\w.]*|[^\s(),&|]+)""")
_NAME, _REF = re.compile(r"[A-Za-z_][\w.]*"), re.compile(r"\$\(([A-Za-z_]\w*)\)")


def compile_condition(text: str, macros: dict[str, Column] | None = None, truth: Callable[[str], Column] | None = None, value: Callable[[str], Column] | None = None) -> Column:
    """``||``, ``&&``, ``not``, parentheses, ``ifeq(a,b)``, ``ifneq(a,b)`` and macros, plain
    or as ``$(NAME)``; a macro that is not known is null, and so are ``!``, other forms
    and what can't be read.

    ``truth(name)`` is whether a macro holds, ``value(name)`` its text for
    comparisons; ``macros`` is a plain way to give the former.
    """
    try:
        return _compile(text, macros, truth, value)
    except ValueError:
        return F.lit(None).cast("boolean")


def _compile(text: str, macros, truth, value) -> Column:
    null = F.lit(None)
    truth = truth or (lambda name: (macros or {}).get(name, null.cast("boolean")))
    value = value or (lambda name: null.cast("string"))
    found, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read a condition at {text[at:]!r}")
        found.append(m[1].strip())
        at = m.end()
    found.append("")

    def either() -> Column:
        left = both()
        while found[0] == "||":
            found.pop(0)
            left = left | both()
        return left

    def both() -> Column:
        left = one()
        while found[0] == "&&":
            found.pop(0)
            left = left & one()
        return left

    def operand() -> Column:
        """What stands up to a comma or parenthesis, as text; nothing: null."""
        said = []
        while found[0] not in (",", ")", ""):
            said.append(found.pop(0))
        whole = " ".join(said)
        if not whole:
            return null.cast("string")
        if m := _REF.fullmatch(whole):
            return value(m[1])
        if whole[0] in "\"'" and whole[-1] == whole[0]:
            return F.lit(whole[1:-1])
        # A bare word is a macro's value if there is such a macro, else itself.
        return F.coalesce(value(whole), F.lit(whole)) if _NAME.fullmatch(whole) else F.lit(whole)

    def one() -> Column:
        token = found.pop(0)
        if token == "not":
            return ~one()
        if token == "!":
            one()
            return null.cast("boolean")
        if token in ("ifeq", "ifneq"):
            found.pop(0)
            left = operand()
            if found.pop(0) != ",":
                raise ValueError("a comparison needs two sides")
            right = operand()
            if found.pop(0) != ")":
                raise ValueError("a parenthesis is open")
            return left == right if token == "ifeq" else left != right
        if token == "(":
            inner = either()
            if found.pop(0) != ")":
                raise ValueError("a parenthesis is open")
            return inner
        if not token or token in ("||", "&&", ")", ","):
            raise ValueError("a condition ends too soon")
        if m := _REF.fullmatch(token):
            return truth(m[1])
        return truth(token) if _NAME.fullmatch(token) else null.cast("boolean")

    out = either()
    if found != [""]:
        raise ValueError(f"can't read {found[0]!r}")
    return out
