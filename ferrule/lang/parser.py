"""Parser of rule programs, graph data (Turtle, TriG) and query bodies, on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import urljoin

from ferrule import terms as T
from ferrule.terms import Nested, Var

PREFIXES = {"rdf": T.RDF, "rdfs": T.RDFS, "xsd": T.XSD}


class ParseError(ValueError):
    pass


@dataclass(frozen=True)
class Atom:
    """A triple pattern; p may be a path: ("inverse", path) or ("seq", path, path)."""

    s: object
    p: object
    o: object


@dataclass(frozen=True)
class Filter:
    expr: tuple


@dataclass(frozen=True)
class Set:
    var: str
    expr: tuple


@dataclass(frozen=True)
class Not:
    body: tuple


@dataclass
class Rule:
    head: list[Atom]
    body: list
    name: str = ""


@dataclass
class Program:
    base: str = ""
    version: str | None = None
    imports: list[str] = field(default_factory=list)
    prefixes: dict[str, str] = field(default_factory=lambda: dict(PREFIXES))
    data: list[tuple[str, str, str]] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    #: Rules of one shape that were turned to facts (class, implied class), and the classes that can occur (None: all).
    implied: tuple[list[tuple[str, str]], set[str] | None] | None = None


_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
  |(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')
  |(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  |(?P<iri><(?![<(=\s])(?:[^<>"{}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
  |(?P<open><<\(|\)>>|<<|>>|\{\||\|\})
  |(?P<var>[?$]\w+)
  |(?P<number>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+)
  |(?P<blank>_:[\w](?:[\w.-]*[\w-])?)
  |(?P<name>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?!=)(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\.)(?:(?:[\w:.-]|%[0-9A-Fa-f]{2}|\\.)*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\.))?)?)
  |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*(?:--[A-Za-z]+)?)
  |(?P<word>[A-Za-z_][\w-]*)
  |(?P<op>\^\^|:=|&&|\|\||!=|<=|>=|=>|[=<>!+\-*/^(){}\[\].,;~|?])""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            return chr(int(m[1][1:], 16))
        if m[2] not in _ESCAPES:
            raise ParseError(f"bad escape \\{m[2]}")
        return _ESCAPES[m[2]]

    return re.sub(r"\\(?:(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})|(.))", one, text, flags=re.DOTALL)


def tokenize(source: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise ParseError(f"unexpected {source[at]!r} at line {source.count(chr(10), 0, at) + 1}")
        if m.lastgroup != "skip":
            out.append((m.lastgroup, m[0], at))
        at = m.end()
    return [*out, ("end", "", len(source))]


class Parser:
    def __init__(self, source: str, base: str = "", prefixes: dict[str, str] | None = None, strict: bool = False):
        self.source, self.tokens, self.at, self.strict = source, tokenize(source), 0, strict
        self.program = Program(base)
        self.program.prefixes.update(prefixes or {})
        self.fresh = 0
        self.blank_scope = ""
        self.lexical = False  # keep typed literals as they are written

    # tokens
    def error(self, what: str) -> ParseError:
        line = self.source.count("\n", 0, self.tokens[self.at][2]) + 1
        return ParseError(f"line {line}: {what}; got {self.tokens[self.at][1]!r}")

    @property
    def kind(self) -> str:
        return self.tokens[self.at][0]

    @property
    def text(self) -> str:
        return self.tokens[self.at][1]

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1][1]

    def match(self, text: str) -> bool:
        found = self.kind in ("op", "open") and self.text == text
        self.at += found
        return found

    def match_word(self, *words: str) -> bool:
        found = self.kind == "word" and self.text.upper() in words
        self.at += found
        return found

    def expect(self, text: str) -> None:
        if not self.match(text):
            raise self.error(f"expected {text}")

    # names
    def resolve(self, value: str) -> str:
        base = self.program.base
        return value if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", value) or not base else urljoin(base, value)

    def iri_value(self) -> str:
        if self.kind == "iri":
            return self.resolve(unescape(self.take()[1:-1]))
        if self.kind == "name":
            prefix, _, local = self.text.partition(":")
            if prefix not in self.program.prefixes:
                raise self.error(f"unknown prefix {prefix}:")
            self.take()
            return self.program.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        if self.kind == "word" and self.text == "a":
            self.take()
            return T.RDF + "type"
        raise self.error("expected an IRI")

    # programs
    def parse(self) -> Program:
        p = self.program
        while self.kind != "end":
            if self.directive():
                continue
            if self.match_word("IMPORTS"):
                p.imports.append(self.iri_value())
                self.match(".")
            elif self.match_word("DATA"):
                self.expect("{")
                self.blank_scope = ""
                self.graph(p.data, "}")
            elif self.match_word("RULE"):
                self.expect("{")
                head = self.block(False)
                if not self.match_word("WHERE"):
                    raise self.error("expected WHERE")
                self.expect("{")
                p.rules.append(Rule(head, self.body(), f"rule {len(p.rules) + 1}"))
            elif self.match_word("IF"):
                self.expect("{")
                body = self.body()
                if not self.match_word("THEN"):
                    raise self.error("expected THEN")
                self.expect("{")
                p.rules.append(Rule(self.block(False), body, f"rule {len(p.rules) + 1}"))
            elif self.match_word("TRANSITIVE", "SYMMETRIC", "INVERSE"):
                self.declaration(self.tokens[self.at - 1][1].upper())
            else:
                raise self.error("expected a statement")
        return p

    def directive(self) -> bool:
        p = self.program
        at = self.kind == "lang" and self.text in ("@prefix", "@base", "@version")
        word = self.text[1:].upper() if at else self.text.upper() if self.kind == "word" else ""
        if word not in ("PREFIX", "BASE", "VERSION"):
            return False
        self.take()
        if word == "PREFIX":
            if self.kind != "name" or not self.text.endswith(":"):
                raise self.error("expected a prefix name with :")
            name = self.take()[:-1]
            if self.kind != "iri":
                raise self.error("expected an IRI")
            p.prefixes[name] = self.iri_value()
        elif word == "BASE":
            p.base = self.iri_value()
        else:
            if self.kind != "string" and (self.strict or self.kind != "long"):
                raise self.error("expected a version string")
            p.version = self.take()[1:-1]
            if self.strict and p.version != "1.2":
                raise self.error('version must be "1.2"')
        if at:
            self.expect(".")
        return True

    def declaration(self, word: str) -> None:
        self.expect("(")
        first = T.iri(self.iri_value())
        second = first
        if word == "INVERSE":
            self.expect(",")
            second = T.iri(self.iri_value())
        self.expect(")")
        self.match(".")
        x, y, z = Var("x"), Var("y"), Var("z")
        rules = self.program.rules
        if word == "TRANSITIVE":
            rules.append(Rule([Atom(x, first, z)], [Atom(x, first, y), Atom(y, first, z)], f"{word}({first})"))
        else:
            rules.append(Rule([Atom(y, second, x)], [Atom(x, first, y)], f"{word}({first})"))
            if word == "INVERSE":
                rules.append(Rule([Atom(y, first, x)], [Atom(x, second, y)], f"{word}({second})"))

    # graph data
    def graph(self, out: list, end: str | None) -> None:
        """Turtle and TriG statements; graph names are dropped, as evaluation has one graph."""
        while not (self.match(end) if end else self.kind == "end"):
            if self.directive() or self.match("."):
                continue
            named = self.match_word("GRAPH")
            if named or self.kind in ("iri", "name", "blank"):
                mark = self.at
                self.node("data", [])
                if self.match("{"):
                    self.graph(out, "}")
                    continue
                if named:
                    raise self.error("expected {")
                self.at = mark
            elif self.match("{"):
                self.graph(out, "}")
                continue
            atoms: list[Atom] = []
            self.statement("data", atoms)
            for a in atoms:
                if not all(isinstance(t, str) for t in (a.s, a.p, a.o)):
                    raise self.error("data may not contain variables")
                if not a.p.startswith("<") or a.p.startswith("<<"):
                    raise self.error("data predicates must be IRIs")
                out.append((a.s, a.p, a.o))

    def block(self, paths: bool) -> list[Atom]:
        atoms: list[Atom] = []
        while not self.match("}"):
            self.statement("body" if paths else "head", atoms)
            self.match(".")
        return atoms

    def body(self, inside_not: bool = False) -> list:
        out: list = []
        while not self.match("}"):
            if self.match_word("FILTER"):
                out.append(Filter(self.expression() if self.kind != "op" or self.text != "(" else self.bracketed()))
            elif self.kind == "word" and self.text.upper() in ("SET", "BIND", "NOT"):
                word = self.take().upper()
                if inside_not or (word == "BIND" and self.strict):
                    raise self.error(f"{word} is not allowed here")
                if word == "NOT":
                    self.expect("{")
                    out.append(Not(tuple(self.body(True))))
                else:
                    out.append(self.assignment(word))
            else:
                atoms: list[Atom] = []
                self.statement("body", atoms)
                out += atoms
            self.match(".")
        return out

    def assignment(self, word: str) -> Set:
        self.expect("(")
        if word == "SET":
            name = self.variable()
            self.expect(":=")
            expr = self.expression()
        else:
            expr = self.expression()
            if not self.match_word("AS"):
                raise self.error("expected AS")
            name = self.variable()
        self.expect(")")
        return Set(name, expr)

    def variable(self) -> str:
        if self.kind != "var":
            raise self.error("expected a variable")
        return self.take()[1:]

    def statement(self, where: str, out: list[Atom]) -> None:
        subject = self.node(where, out)
        self.properties(subject, where, out)

    def properties(self, subject: object, where: str, out: list[Atom]) -> None:
        while True:
            if self.kind == "end" or (self.kind in ("op", "open") and self.text in (".", "}", "]", "|}", ";")):
                if self.match(";"):
                    continue
                return
            verb = self.path(where) if where == "body" else self.term(where)
            while True:
                start = len(out)
                value = self.node(where, out)
                inner = out[start:]
                del out[start:]
                out += [*inner, Atom(subject, verb, value)]
                self.annotations(Atom(subject, verb, value), where, out)
                if not self.match(","):
                    break
            if not self.match(";"):
                return

    def annotations(self, atom: Atom, where: str, out: list[Atom]) -> None:
        reifier = None
        while True:
            if self.match("~"):
                named = self.kind in ("iri", "name", "blank", "var")
                reifier = self.term(where) if named else self.blank(where)
                out.append(Atom(reifier, T.REIFIES, nested(atom.s, atom.p, atom.o)))
            elif self.match("{|"):
                if reifier is None:
                    reifier = self.blank(where)
                    out.append(Atom(reifier, T.REIFIES, nested(atom.s, atom.p, atom.o)))
                self.properties(reifier, where, out)
                self.expect("|}")
                reifier = None
            else:
                return

    def blank(self, where: str, label: str | None = None) -> object:
        if label is None:
            self.fresh += 1
            label = f"b{self.fresh}"
        return Var(f"__b_{label}") if where == "body" else f"_:{self.blank_scope}{label}"

    def node(self, where: str, out: list[Atom]) -> object:
        if self.match("["):
            node = self.blank(where)
            self.properties(node, where, out)
            self.expect("]")
            return node
        if self.match("("):
            items = []
            while not self.match(")"):
                items.append(self.node(where, out))
            cells = [self.blank(where) for _ in items]
            for k, (cell, item) in enumerate(zip(cells, items, strict=True)):
                out += [Atom(cell, T.FIRST, item), Atom(cell, T.REST, cells[k + 1] if k + 1 < len(cells) else T.NIL)]
            return cells[0] if cells else T.NIL
        if self.match("<<"):
            s, p, o = self.node(where, out), self.term(where), self.node(where, out)
            reifier = (self.term(where) if self.kind in ("iri", "name", "blank", "var") else self.blank(where)) if self.match("~") else self.blank(where)
            self.expect(">>")
            out.append(Atom(reifier, T.REIFIES, nested(s, p, o)))
            return reifier
        return self.term(where)

    def term(self, where: str) -> object:
        if self.kind == "var":
            return Var(self.take()[1:])
        if self.kind == "blank":
            return self.blank(where, self.take()[2:])
        if self.match("<<("):
            s, p, o = self.term(where), self.term(where), self.term(where)
            self.expect(")>>")
            return nested(s, p, o)
        if self.kind in ("string", "long"):
            text = unescape(self.take()[1:-1] if self.kind == "string" else self.take()[3:-3])
            if self.kind == "lang":
                lang, _, direction = self.take()[1:].partition("--")
                return T.literal(text, None, lang, direction or None)
            if self.match("^^"):
                datatype = self.iri_value()
                return f"{T.quoted(text)}^^<{datatype}>" if self.lexical and datatype != T.STRING else T.literal(text, datatype)
            return T.literal(text)
        sign = "-" if self.match("-") else "" if self.match("+") else None
        if self.kind == "number":
            text = (sign or "") + self.take()
            return T.number(int(text) if re.fullmatch(r"-?\d+", text) else float(text))
        if sign is not None:
            raise self.error("expected a number")
        if self.kind == "word" and self.text in ("true", "false"):
            return T.literal(self.take(), T.BOOLEAN)
        return T.iri(self.iri_value())

    # paths
    def path(self, where: str) -> object:
        if self.kind == "var":
            return Var(self.take()[1:])
        out = self.step(where)
        while self.match("/"):
            out = ("seq", out, self.step(where))
        return out

    def step(self, where: str) -> object:
        if self.match("^"):
            return ("inverse", self.step(where))
        if self.match("("):
            out = self.path(where)
            self.expect(")")
            return out
        return T.iri(self.iri_value())

    # expressions: ("term", t), ("var", name), ("call", name, args), (op, args...)
    def bracketed(self) -> tuple:
        return self.expression()

    def expression(self) -> tuple:
        return self.binary(0)

    _LEVELS = (("||",), ("&&",), ("=", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "/"))

    def binary(self, level: int) -> tuple:
        if level == len(self._LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while True:
            if self.kind == "op" and self.text in self._LEVELS[level]:
                left = (self.take(), left, self.binary(level + 1))
            elif level == 2 and self.kind == "word" and self.text.upper() in ("IN", "NOT"):
                negated = self.take().upper() == "NOT"
                if negated and not self.match_word("IN"):
                    raise self.error("expected IN")
                self.expect("(")
                items = []
                while not self.match(")"):
                    items.append(self.expression())
                    self.match(",")
                left = ("not in" if negated else "in", left, *items)
            else:
                return left

    def unary(self) -> tuple:
        for op in ("!", "-", "+"):
            if self.match(op):
                return ("u" + op, self.unary())
        if self.match("("):
            out = self.expression()
            self.expect(")")
            return out
        if self.kind == "var":
            return ("var", self.take()[1:])
        if self.match("<<("):
            args = [self.unary(), self.unary(), self.unary()]
            self.expect(")>>")
            return ("call", "TRIPLE", *args)
        follows = self.tokens[self.at + 1][1] == "(" if self.kind in ("word", "name", "iri") else False
        if self.kind == "word" and self.text not in ("true", "false"):
            if not follows:
                raise self.error("expected an expression")
            name = self.take().upper()
            return self.call(name)
        if follows:
            return self.call(T.iri(self.iri_value()))
        return ("term", self.term("data"))

    def call(self, name: str) -> tuple:
        from ferrule.functions.expressions import ARITY

        self.expect("(")
        args = []
        while not self.match(")"):
            args.append(self.expression())
            self.match(",")
        if not name.startswith("<"):
            if name not in ARITY:
                raise self.error(f"unknown function {name}")
            least, most = ARITY[name]
            if not least <= len(args) <= most:
                raise self.error(f"{name} has {len(args)} arguments")
        return ("call", name, *args)


def nested(s: object, p: object, o: object) -> object:
    return T.triple_term(s, p, o) if all(isinstance(x, str) for x in (s, p, o)) else Nested(s, p, o)


def parse(source: str, base: str = "", strict: bool = False) -> Program:
    return Parser(source, base, strict=strict).parse()


def parse_graph(source: str, base: str = "", prefixes: dict[str, str] | None = None, scope: str = "", lexical: bool = False) -> tuple[list[tuple[str, str, str]], dict[str, str]]:
    """Triples and prefixes of a Turtle or TriG text. lexical: typed literals keep their written form, as entailment needs."""
    p = Parser(source, base, prefixes)
    p.lexical = lexical
    p.blank_scope = scope
    out: list = []
    p.graph(out, None)
    return out, p.program.prefixes


def parse_body(source: str, prefixes: dict[str, str], base: str = "") -> list:
    if re.match(r"\s*(SELECT|QUERY)\b", source, re.IGNORECASE):
        raise ParseError("a query is a body pattern")
    return Parser(source + "\n}", base, prefixes).body()
