"""Expressions and builtin functions, compiled to Columns.

A value is a Column with a kind known at compile time: ``term`` (canonical string), or a native ``num``,
``str``, ``bool`` or ``ts``. Native values stay native, so that expressions over tables are plain typed
Spark expressions; terms are decoded only where a value is needed. What is an error in an expression
is NULL here, which a filter rejects and an assignment drops.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferrule import terms as T
from ferrule.functions import bigint


@dataclass(frozen=True)
class V:
    kind: str
    col: Column


@dataclass
class Context:
    """What expressions may refer to besides variables."""

    base: str = ""
    now: str = ""
    functions: dict[str, Callable[..., Column]] = field(default_factory=dict)
    uuids: Callable[[], Column] | None = None
    wide: bool = False


#: Names and arities of the builtin functions.
ARITY = {
    "STR": (1, 1), "LANG": (1, 1), "LANGDIR": (1, 1), "LANGMATCHES": (2, 2), "HASLANG": (1, 1), "HASLANGDIR": (1, 1), "DATATYPE": (1, 1), "IRI": (1, 1), "URI": (1, 1), "BNODE": (0, 1),
    "ABS": (1, 1), "CEIL": (1, 1), "FLOOR": (1, 1), "ROUND": (1, 1), "CONCAT": (0, 99), "SUBSTR": (2, 3), "STRLEN": (1, 1), "REPLACE": (3, 4), "REGEX": (2, 3), "UCASE": (1, 1), "LCASE": (1, 1),
    "ENCODE_FOR_URI": (1, 1), "CONTAINS": (2, 2), "STRSTARTS": (2, 2), "STRENDS": (2, 2), "STRBEFORE": (2, 2), "STRAFTER": (2, 2), "YEAR": (1, 1), "MONTH": (1, 1), "DAY": (1, 1), "HOURS": (1, 1),
    "MINUTES": (1, 1), "SECONDS": (1, 1), "TIMEZONE": (1, 1), "TZ": (1, 1), "NOW": (0, 0), "UUID": (0, 0), "STRUUID": (0, 0), "IF": (3, 3), "STRLANG": (2, 2), "STRLANGDIR": (3, 3), "STRDT": (2, 2),
    "SAMETERM": (2, 2), "ISIRI": (1, 1), "ISURI": (1, 1), "ISBLANK": (1, 1), "ISLITERAL": (1, 1), "ISTRIPLE": (1, 1), "ISNUMERIC": (1, 1), "TRIPLE": (3, 3), "SUBJECT": (1, 1), "PREDICATE": (1, 1), "OBJECT": (1, 1),
}
VOLATILE = frozenset({"BNODE", "UUID", "STRUUID"})


def kind_of(spark_type: str) -> str:
    """Kind of a table column."""
    if spark_type == "boolean":
        return "bool"
    if spark_type in ("tinyint", "smallint", "int", "bigint", "float", "double") or spark_type.startswith("decimal"):
        return "num"
    return "ts" if spark_type.startswith(("timestamp", "date")) else "str"


def constant(term: str) -> V:
    """Numbers, plain strings and booleans of an expression are native; other terms stay terms."""
    if term.startswith('"'):
        body, _, tail = term.rpartition('"')
        text = body[1:].replace('\\"', '"').replace("\\\\", "\\")
        if not tail:
            return V("str", F.lit(text))
        datatype = tail[3:-1]
        if datatype == T.INTEGER:
            return V("num", F.lit(int(text))) if abs(int(text)) < 1 << 63 else V("term", F.lit(term))
        if datatype in T.NUMERIC:
            return V("num", F.lit(float(text)))
        if datatype == T.BOOLEAN:
            return V("bool", F.lit(text == "true"))
    return V("term", F.lit(term))


# decoding
def _lexical(c: Column) -> Column:
    escaped = F.regexp_replace(F.regexp_extract(c, r'(?s)^"((?:[^"\\]|\\.)*)"', 1), r"(?s)\\(.)", "$1")
    return F.when(F.contains(c, F.lit("\\")), escaped).otherwise(F.substring_index(F.substring(c, F.lit(2), F.length(c)), '"', 1))


def _tail(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(c, r'(?s)^"(?:[^"\\]|\\.)*"' + pattern + "$", group)


#: Digits and sign of integers that doubles hold exactly, at most; longer ones are computed as text.
_EXACT = 15
_WHOLE = "^-?[0-9]+$"


def _is_literal(c: Column) -> Column:
    return c.startswith('"')


def datatype(c: Column) -> Column:
    return _tail(c, r"\^\^<([^>]*)>")


def _number_text(c: Column) -> Column:
    whole = c.cast("string")  # integers of any width as they are; others as the shortest text of a double
    return F.when(whole.rlike(_WHOLE), whole).otherwise(_double_text(c.cast("double")))


def _double_text(d: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(d.cast("string"), r"(\.0)?E(-?)", "e$2"), r"e(\d)", "e+$1")
    return F.when((d == F.floor(d)) & (F.abs(d) < 1e18), d.cast("decimal(38,0)").cast("string")).otherwise(text)


def as_str(v: V) -> Column:
    c = v.col
    if v.kind == "term":
        return F.when(_is_literal(c), _lexical(c)).when(c.startswith("<<(") | c.startswith("_:"), c).otherwise(F.regexp_replace(c, "^<|>$", ""))
    if v.kind == "num":
        return _number_text(c)
    if v.kind == "ts":
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return c.cast("string")


def is_num(v: V) -> Column:
    return datatype(v.col).isin(list(T.NUMERIC)) if v.kind == "term" else F.lit(v.kind == "num")


def as_num(v: V) -> Column:
    if v.kind == "num":
        return v.col
    if v.kind == "bool":
        return v.col.cast("int")
    return as_str(v).try_cast("double")


def as_bool(v: V) -> Column:
    """Effective boolean value."""
    if v.kind == "bool":
        return v.col
    if v.kind == "num":
        return (v.col != 0) & ~F.isnan(v.col.cast("double"))
    if v.kind == "term":
        dt = datatype(v.col)
        number = as_num(v)
        text = as_str(v)
        return F.when(dt.isin(list(T.NUMERIC)), (number != 0) & ~F.isnan(number)).otherwise((text != "") & (text != "false"))
    text = as_str(v)
    return (text != "") & (text != "false")


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(c, r'([\\"])', r"\\$1"), F.lit('"'))


#: Datatypes of native values other than numbers.
TAGS = {"bool": T.BOOLEAN, "ts": T.XSD + "dateTime", "str": T.STRING}


def as_term(v: V) -> Column:
    """Canonical string of a computed or table value."""
    if v.kind == "term":
        return v.col
    if v.kind == "num":
        d = v.col.cast("double")
        kind = F.when(d == F.floor(d), F.lit(T.INTEGER)).otherwise(F.lit(T.DECIMAL))
        return F.concat(F.lit('"'), _number_text(v.col), F.lit('"^^<'), kind, F.lit(">"))
    return F.concat(_quoted(as_str(v)), F.lit(f"^^<{TAGS[v.kind]}>"))


# operators
def _equal(a: V, b: V) -> Column:
    if a.kind == b.kind:
        return a.col == b.col
    if "term" not in (a.kind, b.kind):
        return F.lit(False) if "ts" not in (a.kind, b.kind) else as_str(a) == as_str(b)
    t, p = (a, b) if a.kind == "term" else (b, a)
    dt = datatype(t.col)
    if p.kind == "num":
        same = F.when((dt == T.INTEGER) & (F.length(as_str(t)) > _EXACT), as_str(t) == as_str(p)).otherwise(as_num(t) == p.col)
        return dt.isin(list(T.NUMERIC)) & F.coalesce(same, F.lit(False))
    if p.kind == "bool":
        return (dt == T.BOOLEAN) & (as_str(t) == p.col.cast("string"))
    # the value of an IRI or a typed, untyped or tagged string is its text
    return ~dt.isin([*T.NUMERIC, T.BOOLEAN]) & (as_str(t) == as_str(p))


def _order(op: str, a: V, b: V) -> Column:
    def by(x: Column, y: Column) -> Column:
        return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    if a.kind == b.kind and a.kind in ("num", "ts", "str"):
        return by(a.col, b.col)
    if {a.kind, b.kind} <= {"str", "ts", "bool"}:
        return by(as_str(a), as_str(b))
    x, y = as_str(a), as_str(b)
    long = _both_whole(a, b) & (F.greatest(F.length(x), F.length(y)) > _EXACT)
    return F.when(long, by(bigint.compare(x, y), F.lit(0))).when(is_num(a) & is_num(b), by(as_num(a), as_num(b))).otherwise(by(x, y))


def _both_whole(a: V, b: V) -> Column:
    whole = lambda v: datatype(v.col) == T.INTEGER if v.kind == "term" else v.col.cast("string").rlike(_WHOLE) if v.kind == "num" else F.lit(False)
    return whole(a) & whole(b)


_OPS = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}


def _arithmetic(op: str, a: V, b: V, wide: bool = False) -> V:
    """Sum, difference, product: exact for integers if one of them is a term (up to 38 digits, with ``wide`` of any
    length); + of others is text."""
    if a.kind == b.kind == "num":
        return V("num", _OPS[op](a.col, b.col))
    if "term" not in (a.kind, b.kind):
        return V("str", F.concat(as_str(a), as_str(b))) if op == "+" else V("num", _OPS[op](as_num(a), as_num(b)))
    x, y = as_str(a), as_str(b)
    long = _both_whole(a, b) & (F.length(x) + F.length(y) > _EXACT)
    whole = _both_whole(a, b)
    text = bigint.of_decimals(op, x, y)
    if wide:
        text = F.coalesce(text, bigint.of_any_length(op, F.when(whole, x), F.when(whole, y)))
    number = as_term(V("num", _OPS[op](x.try_cast("double"), y.try_cast("double"))))
    out = F.when(long, F.concat(F.lit('"'), text, F.lit(f'"^^<{T.INTEGER}>')))
    return V("term", out.when(is_num(a) & is_num(b), number).otherwise(as_term(V("str", F.concat(x, y)))) if op == "+" else out.otherwise(number))


def _divide(a: V, b: V) -> V:
    x, y = as_num(a).cast("double"), as_num(b).cast("double")
    inf = F.lit(float("inf"))
    return V("num", F.when(y != 0, F.try_divide(x, y)).when((x == 0) | F.isnan(x), F.lit(float("nan"))).when(x > 0, inf).when(x < 0, -inf))


# functions
_DATE = r"^(-?\d{4,})-(\d\d)-(\d\d)(?:T(\d\d):(\d\d):(\d\d(?:\.\d+)?))?(Z|[+-]\d\d:\d\d)?$"


def _date_part(group: int) -> Callable[[V], V]:
    def part(v: V) -> V:
        text = as_str(v)
        found = F.regexp_extract(text, _DATE, group)
        number = F.when(found == "", "0").otherwise(found).cast("double") if group > 3 else found.try_cast("double")
        return V("num", F.when(text.rlike(_DATE), number))

    return part


def _timezone(v: V) -> V:
    z = F.regexp_extract(as_str(v), _DATE, 7)
    h, m = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
    body = F.concat(F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(""))
    text = F.when((z == "Z") | (body == ""), "PT0S").otherwise(F.concat(F.when(z.startswith("-"), "-").otherwise(""), F.lit("PT"), body))
    return V("term", F.when(z != "", F.concat(_quoted(text), F.lit(f"^^<{T.XSD}dayTimeDuration>"))))


def _regex_flags(flags: V | None) -> Column:
    if flags is None:
        return F.lit("")
    kept = F.regexp_replace(as_str(flags), "[^ims]", "")
    return F.when(kept != "", F.concat(F.lit("(?"), kept, F.lit(")"))).otherwise("")


def _component(k: int) -> Callable[[V], V]:
    item = r"(<<\(.*\)>>|<[^>]*>|_:[^ ]+|\"(?:[^\"\\]|\\.)*\"(?:\^\^<[^>]*>|@[^ ]+)?)"
    pattern = rf"(?s)^<<\( {item} {item} {item} \)>>$"

    def part(v: V) -> V:
        found = F.regexp_extract(v.col, pattern, k)
        return V("term", F.when(v.col.startswith("<<(") & (found != ""), found))

    return part


def _test(pattern: Callable[[Column], Column]) -> Callable[[V], V]:
    return lambda v: V("bool", pattern(v.col) if v.kind == "term" else F.lit(False))


def _tagged(text: Column, lang: Column, direction: Column | None = None) -> V:
    tail = F.lower(lang) if direction is None else F.concat(F.lower(lang), F.lit("--"), direction)
    return V("term", F.concat(_quoted(text), F.lit("@"), tail))


def _strdt(a: V, b: V) -> V:
    dt = as_str(b)
    return V("term", F.when(dt == T.STRING, F.concat(_quoted(as_str(a)), F.lit(f"^^<{T.STRING}>"))).otherwise(F.concat(_quoted(as_str(a)), F.lit("^^<"), dt, F.lit(">"))))


def _datatype(v: V) -> V:
    if v.kind == "num":
        d = v.col.cast("double")
        return V("term", F.when(v.col.isNotNull(), F.when(d == F.floor(d), F.lit(f"<{T.INTEGER}>")).otherwise(F.lit(f"<{T.DECIMAL}>"))))
    if v.kind != "term":
        return V("term", F.when(v.col.isNotNull(), F.lit(f"<{TAGS[v.kind]}>")))
    c, dt = v.col, datatype(v.col)
    lang = F.when(_tail(c, r"@[^@]*--(\w+)") != "", f"<{T.RDF}dirLangString>").when(_tail(c, r"@(.+)") != "", f"<{T.RDF}langString>")
    return V("term", F.when(_is_literal(c), F.coalesce(lang, F.when(dt != "", F.concat(F.lit("<"), dt, F.lit(">"))), F.lit(f"<{T.STRING}>"))))


def _lang(v: V) -> Column:
    return _tail(v.col, r"@([A-Za-z0-9-]+?)(?:--\w+)?") if v.kind == "term" else F.lit("")


def _direction(v: V) -> Column:
    return _tail(v.col, r"@[A-Za-z0-9-]+?--(\w+)") if v.kind == "term" else F.lit("")


def _units(text: Column) -> Column:
    """Length in UTF-16 units, as the language has it."""
    return F.call_function("div", F.octet_length(F.encode(text, "UTF-16BE")), F.lit(2)).cast("int")


def _substr(v: V, start: V, length: V | None = None) -> V:
    begin = F.greatest(as_num(start).cast("int") - 1, F.lit(0))
    size = F.greatest(as_num(length).cast("int"), F.lit(0)) if length is not None else F.lit(1 << 30)

    def units(text: Column) -> Column:
        """Characters that lie in the range as a whole; those outside the plane of 16 bits take two units."""
        step = lambda acc, c: F.struct(
            (acc["at"] + _units(c)).alias("at"), F.when((acc["at"] >= begin) & (acc["at"] + _units(c) <= begin + size), F.concat(acc["out"], c)).otherwise(acc["out"]).alias("out")
        )
        return F.aggregate(F.split(text, ""), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)["out"]

    text = as_str(v)
    return V("str", F.when(_units(text) == F.length(text), F.substring(text, begin + 1, size)).otherwise(units(text)))


def _around(v: V, mark: V, before: bool) -> V:
    s, m = as_str(v), as_str(mark)
    at = F.call_function("instr", s, m)
    found = F.substring(s, F.lit(1), at - 1) if before else F.substring(s, at + F.length(m), F.length(s))
    return V("str", F.when(at > 0, found).otherwise(""))


def _dotless(path: Column) -> Column:
    """A path without . and .. segments."""
    parts = F.split(path, "/")

    def step(acc: Column, x: Column) -> Column:
        up = F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
        return F.when(x == ".", acc).when(x == "..", up).otherwise(F.concat(acc, F.array(x)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    open_ = F.element_at(parts, -1).isin(".", "..")
    return F.concat(F.array_join(kept, "/"), F.when(open_, F.lit("/")).otherwise(F.lit("")))


def _iri(v: V, ctx: Context) -> V:
    """Resolved against the base as RFC 3986 has it; the parts of the base are known here, the reference is a column."""
    text = as_str(v)
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?", ctx.base)
    scheme, host, path, asked = (x or "" for x in m.groups())
    own = F.regexp_extract(text, r"^[^?#]*", 0)
    tail = F.substring(text, F.length(own) + 1, F.length(text))
    folder = path[: path.rfind("/") + 1] or ("/" if host else "")
    found = (
        F.when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), text)
        .when(text.startswith("//"), F.concat(F.lit(scheme), text))
        .when(own == "", F.concat(F.lit(scheme + host + path), F.when(tail.startswith("?"), F.lit("")).otherwise(F.lit(asked)), tail))
        .otherwise(F.concat(F.lit(scheme + host), _dotless(F.when(own.startswith("/"), own).otherwise(F.concat(F.lit(folder), own))), tail))
    )
    return V("term", F.concat(F.lit("<"), found if ctx.base else text, F.lit(">")))


def _round(v: V) -> V:
    return V("num", F.floor(as_num(v).cast("double") + 0.5))


def _encode(v: V) -> V:
    out = F.regexp_replace(F.url_encode(as_str(v)), r"\+", "%20")
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return V("str", out)


def _replace(v: V, pattern: V, by: V, flags: V | None = None) -> V:
    return V("str", F.regexp_replace(as_str(v), F.concat(_regex_flags(flags), as_str(pattern)), F.regexp_replace(as_str(by), r"\$&", r"\$0")))


FUNCTIONS: dict[str, Callable[..., V]] = {
    "STR": lambda v: V("str", as_str(v)),
    "LANG": lambda v: V("str", _lang(v)),
    "LANGDIR": lambda v: V("str", _direction(v)),
    "LANGMATCHES": lambda a, b: V("bool", F.when(as_str(b) == "*", as_str(a) != "").otherwise((F.lower(as_str(a)) == F.lower(as_str(b))) | F.lower(as_str(a)).startswith(F.concat(F.lower(as_str(b)), F.lit("-"))))),
    "HASLANG": lambda v: V("bool", _lang(v) != ""),
    "HASLANGDIR": lambda v: V("bool", _direction(v) != ""),
    "DATATYPE": _datatype,
    "ABS": lambda v: V("num", F.abs(as_num(v))),
    "CEIL": lambda v: V("num", F.ceil(as_num(v).cast("double"))),
    "FLOOR": lambda v: V("num", F.floor(as_num(v).cast("double"))),
    "ROUND": _round,
    "CONCAT": lambda *vs: V("str", F.concat(*[as_str(v) for v in vs]) if vs else F.lit("")),
    "SUBSTR": _substr,
    "STRLEN": lambda v: V("num", _units(as_str(v))),
    "REPLACE": _replace,
    "REGEX": lambda v, p, f=None: V("bool", F.regexp_like(as_str(v), F.concat(_regex_flags(f), as_str(p)))),
    "UCASE": lambda v: V("str", F.upper(as_str(v))),
    "LCASE": lambda v: V("str", F.lower(as_str(v))),
    "ENCODE_FOR_URI": _encode,
    "CONTAINS": lambda a, b: V("bool", F.contains(as_str(a), as_str(b))),
    "STRSTARTS": lambda a, b: V("bool", F.startswith(as_str(a), as_str(b))),
    "STRENDS": lambda a, b: V("bool", F.endswith(as_str(a), as_str(b))),
    "STRBEFORE": lambda a, b: _around(a, b, True),
    "STRAFTER": lambda a, b: _around(a, b, False),
    "YEAR": _date_part(1), "MONTH": _date_part(2), "DAY": _date_part(3), "HOURS": _date_part(4), "MINUTES": _date_part(5), "SECONDS": _date_part(6),
    "TIMEZONE": _timezone,
    "TZ": lambda v: V("str", F.regexp_extract(as_str(v), _DATE, 7)),
    "STRLANG": lambda a, b: _tagged(as_str(a), as_str(b)),
    "STRLANGDIR": lambda a, b, c: _tagged(as_str(a), as_str(b), as_str(c)),
    "STRDT": _strdt,
    "SAMETERM": lambda a, b: V("bool", _equal(a, b)),
    "ISIRI": _test(lambda c: c.startswith("<") & ~c.startswith("<<(")), "ISURI": _test(lambda c: c.startswith("<") & ~c.startswith("<<(")),
    "ISBLANK": _test(lambda c: c.startswith("_:")),
    "ISLITERAL": _test(lambda c: c.startswith('"')),
    "ISTRIPLE": _test(lambda c: c.startswith("<<(")),
    "ISNUMERIC": lambda v: V("bool", is_num(v)),
    "TRIPLE": lambda s, p, o: V("term", F.concat(F.lit("<<( "), as_term(s), F.lit(" "), as_term(p), F.lit(" "), as_term(o), F.lit(" )>>"))),
    "SUBJECT": _component(1), "PREDICATE": _component(2), "OBJECT": _component(3),
    "UUID": lambda: V("term", F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))),
    "STRUUID": lambda: V("str", F.uuid()),
}


def compile_expression(e: tuple, env: dict[str, V], ctx: Context) -> V:
    op, *args = e
    if op == "term":
        return constant(args[0])
    if op == "var":
        if args[0] not in env:
            return V("term", F.lit(None).cast("string"))
        return env[args[0]]
    if op == "call":
        name, *args = args
        values = [compile_expression(a, env, ctx) for a in args]
        if name.startswith("<"):
            if name not in ctx.functions:
                if len(values) == 1 and re.split(r"[#/:]", name[1:-1])[-1].lower() == "sudoku":
                    from ferrule.functions.sudoku import sudoku

                    return V("str", sudoku(as_str(values[0])))
                raise ValueError(f"unknown function {name}")
            return V("term", ctx.functions[name](*[as_term(v) for v in values]))
        if name == "IF":
            test, a, b = values
            if a.kind == b.kind:
                return V(a.kind, F.when(as_bool(test), a.col).otherwise(b.col))
            return V("term", F.when(as_bool(test), as_term(a)).otherwise(as_term(b)))
        if name == "ISLITERAL" and args[0][0] == "var" and values[0].kind != "term":
            return V("bool", F.lit(True))  # a value of a table column is a literal
        if name in ("IRI", "URI"):
            return _iri(values[0], ctx)
        if name == "NOW":
            return V("term", F.lit(f'"{ctx.now}"^^<{T.XSD}dateTime>'))
        if name in ("UUID", "STRUUID") and ctx.uuids is not None:
            return V("term", F.concat(F.lit("<urn:uuid:"), ctx.uuids(), F.lit(">"))) if name == "UUID" else V("str", ctx.uuids())
        if name == "BNODE":
            return V("term", F.concat(F.lit("_:"), as_str(values[0]) if values else F.uuid()))
        return FUNCTIONS[name](*values)
    values = [compile_expression(a, env, ctx) for a in args]
    if op in ("||", "&&"):
        a, b = as_bool(values[0]), as_bool(values[1])
        # an error on the left stays an error; the right one counts only if it decides
        return V("bool", F.when(a, True if op == "||" else b).when(~a, b if op == "||" else False))
    if op == "u!":
        return V("bool", ~as_bool(values[0]))
    if op == "u-":
        return V("num", -as_num(values[0])) if values[0].kind != "term" else _arithmetic("-", V("num", F.lit(0)), values[0], ctx.wide)
    if op == "u+":
        return V("num", as_num(values[0]))
    if op in ("in", "not in"):
        found = F.lit(False)
        for v in values[1:]:
            found = found | _equal(values[0], v)
        return V("bool", found if op == "in" else ~found)
    a, b = values
    if op in ("=", "!="):
        return V("bool", _equal(a, b) if op == "=" else ~_equal(a, b))
    if op in ("<", "<=", ">", ">="):
        return V("bool", _order(op, a, b))
    return _divide(a, b) if op == "/" else _arithmetic(op, a, b, ctx.wide)


def expression_variables(e: tuple) -> set[str]:
    if e[0] == "var":
        return {e[1]}
    return set().union(*[expression_variables(a) for a in e[1:] if isinstance(a, tuple)]) if e[0] != "term" else set()


def is_volatile(e: tuple) -> bool:
    return (e[0] == "call" and e[1] in VOLATILE) or any(is_volatile(a) for a in e[1:] if isinstance(a, tuple))
