"""Terms and their canonical strings.

A ground term is one string, equal exactly when the terms are: ``<iri>``, ``_:label``, literals as a quoted
form with ``^^<datatype>`` or ``@lang--dir`` behind it, triple terms as ``<<( s p o )>>``. Joins, distinct and
anti-joins on terms are plain string equality. A plain string and one tagged xsd:string are different terms.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
INTEGER, DECIMAL, DOUBLE, BOOLEAN, STRING = (XSD + x for x in ("integer", "decimal", "double", "boolean", "string"))
NUMERIC = (INTEGER, DECIMAL, DOUBLE)
TYPE, FIRST, REST, NIL, REIFIES = (f"<{RDF}{x}>" for x in ("type", "first", "rest", "nil", "reifies"))


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Nested:
    """A triple term that has variables."""

    s: object
    p: object
    o: object


def iri(value: str) -> str:
    return f"<{value}>"


def quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def number_text(x: float) -> str:
    """A number's shortest form, integers without a point, exponents from 1e21 and below 1e-6."""
    if isinstance(x, int):
        return str(x)
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "Infinity" if x > 0 else "-Infinity"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    mantissa, _, exponent = repr(x).partition("e")
    if not exponent:
        return mantissa if abs(x) >= 1e-6 else _small(mantissa)
    power = int(exponent)
    if -7 < power < 21:
        return format(x, "f").rstrip("0") if power < 0 else str(int(x))
    return f"{mantissa.removesuffix('.0')}e{'+' if power > 0 else '-'}{abs(power)}"


def _small(text: str) -> str:
    digits = text.partition(".")[2]
    zeros = len(digits) - len(digits.lstrip("0"))
    rest = digits[zeros:]
    return f"{rest[0]}{'.' + rest[1:] if rest[1:] else ''}e-{zeros + 1}"


def number(x: float) -> str:
    """Computed numbers: integers if they are integral, else decimals."""
    whole = isinstance(x, int) or (x == x and abs(x) != float("inf") and x == int(x))
    return f'"{number_text(x)}"^^<{INTEGER if whole else DECIMAL}>'


def literal(lexical: str, datatype: str | None = None, lang: str | None = None, direction: str | None = None) -> str:
    if lang:
        return f"{quoted(lexical)}@{lang.lower()}{'--' + direction if direction else ''}"
    if datatype in (None, STRING):
        return quoted(lexical)
    if datatype == INTEGER and re.fullmatch(r"[+-]?\d+", lexical):
        lexical = str(int(lexical))
    elif datatype in (DECIMAL, DOUBLE):
        try:
            lexical = number_text(float(lexical))
        except ValueError:
            lexical = "NaN"
    elif datatype == BOOLEAN:
        lexical = "true" if lexical in ("true", "1") else "false"
    return f"{quoted(lexical)}^^<{datatype}>"


def triple_term(s: str, p: str, o: str) -> str:
    return f"<<( {s} {p} {o} )>>"


def is_ground(t: object) -> bool:
    return isinstance(t, str)


def variables(t: object) -> set[str]:
    if isinstance(t, Var):
        return {t.name}
    return variables(t.s) | variables(t.p) | variables(t.o) if isinstance(t, Nested) else set()


_LITERAL = re.compile(r'"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@(.*))?\Z', re.DOTALL)
_LOCAL = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_.-]*(?<!\.)\Z|\Z")


def parts(term: str) -> list[str]:
    """s, p and o of a triple term."""
    out, depth, text, at = [], 0, False, 4
    body, start = term[:-4], 4
    while at < len(body):
        c = body[at]
        if text:
            at += c == "\\"
            text = c != '"'
        elif c == '"':
            text = True
        elif body.startswith("<<(", at):
            depth += 1
        elif body.startswith(")>>", at):
            depth -= 1
        elif c == "<" and not body.startswith("<<", at) and depth == 0:
            at = body.index(">", at)
        elif c == " " and depth == 0:
            if at > start:
                out.append(body[start:at])
            start = at + 1
        at += 1
    return [*out, body[start:]] if body[start:].strip() else out


def show(term: str, prefixes: dict[str, str]) -> str:
    """The term as text, with prefixes."""
    if term.startswith("<<("):
        return f"<<({' '.join(show(x, prefixes) for x in parts(term))})>>"
    if term.startswith("<"):
        value = term[1:-1]
        for name, base in sorted(prefixes.items(), key=lambda kv: (-len(kv[1]), kv[0])):
            if value.startswith(base) and base and _LOCAL.match(value[len(base) :]):
                return f"{name}:{value[len(base) :]}"
        return term
    m = _LITERAL.match(term)
    if not m:
        return term
    text = re.sub(r"\\(.)", r"\1", m[1], flags=re.DOTALL)
    if m[2] in (INTEGER, DECIMAL, BOOLEAN):
        return text
    shown = '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'
    if m[3]:
        return f"{shown}@{m[3]}"
    return shown if m[2] in (None, STRING) else f"{shown}^^{show(iri(m[2]), prefixes | {'xsd': XSD})}"
