"""Rule sets that are written as RDF: a graph of rule, pattern and expression nodes becomes a program."""

from __future__ import annotations

import re

from ferrule import terms as T
from ferrule.lang.parser import Atom, Filter, Not, ParseError, Program, Rule, Set, parse_graph

# The vocabularies of the encoding.
RULES = "http://www.w3.org/ns/shacl-rules#"
NODES = "http://www.w3.org/ns/shacl-node-expr#"
SPARQL = "http://www.w3.org/ns/sparql#"
IMPORTS = "<http://www.w3.org/2002/07/owl#imports>"
OPERATORS = {
    "less-than": "<", "lessThan": "<", "less-than-or-equal": "<=", "lessThanOrEqual": "<=",
    "greater-than": ">", "greaterThan": ">", "greater-than-or-equal": ">=", "greaterThanOrEqual": ">=",
    "equal": "=", "equals": "=", "not-equal": "!=", "notEqual": "!=",
    "add": "+", "subtract": "-", "multiply": "*", "divide": "/",
    "and": "&&", "function-and": "&&", "or": "||", "function-or": "||",
}
#: Operators that take more than two arguments, from left to right.
CHAINED = ("+", "*", "&&", "||")


def looks_like_rules(source: str) -> bool:
    return bool(re.search(r"\bsrl:(RuleSet|rules)\b", source)) or f"{RULES}RuleSet" in source


def _srl(name: str) -> str:
    return f"<{RULES}{name}>"


class Reader:
    def __init__(self, source: str, base: str = ""):
        triples, self.prefixes = parse_graph(source, base)
        self.of: dict[str, dict[str, list[str]]] = {}
        for s, p, o in dict.fromkeys(triples):
            self.of.setdefault(s, {}).setdefault(p, []).append(o)

    def all(self, node: str, *predicates: str) -> list[str]:
        return [o for p in predicates for o in self.of.get(node, {}).get(p, [])]

    def one(self, node: str, *predicates: str) -> str:
        found = self.all(node, *predicates)
        if len(found) != 1:
            raise ParseError(f"{node} has {len(found)} values of {predicates[0]}, not one")
        return found[0]

    def items(self, head: str) -> list[str]:
        out, seen = [], set()
        while head != T.NIL:
            if head in seen:
                raise ParseError(f"the list at {head} comes back to itself")
            seen.add(head)
            out.append(self.one(head, T.FIRST))
            head = self.one(head, T.REST)
        return out

    def term(self, node: str) -> object:
        """A term, or the variable that the node names."""
        return T.Var(self.text(self.one(node, _srl("varName")))) if self.all(node, _srl("varName")) else node

    @staticmethod
    def text(literal: str) -> str:
        if not literal.startswith('"'):
            raise ParseError(f"{literal} is not a name")
        return T.show(literal.partition("^^")[0], {})[1:-1]

    def atom(self, node: str) -> Atom:
        if node.startswith("<<("):
            return Atom(*T.parts(node))
        return Atom(*(self.term(self.one(node, _srl(x))) for x in ("subject", "predicate", "object")))

    def clause(self, node: str) -> Atom | Filter | Set | Not:
        if node.startswith("<<(") or self.all(node, *map(_srl, ("subject", "predicate", "object"))):
            return self.atom(node)
        if self.all(node, _srl("filter"), _srl("expr")):
            return Filter(self.expression(self.one(node, _srl("filter"), _srl("expr"))))
        if self.all(node, _srl("assign")):
            inner = self.one(node, _srl("assign"))
            var = self.term(self.one(inner, _srl("assignVar")))
            if not isinstance(var, T.Var):
                raise ParseError(f"{inner} assigns to no variable")
            return Set(var.name, self.expression(self.one(inner, _srl("assignValue"))))
        if self.all(node, _srl("not")):
            body = [self.clause(x) for x in self.items(self.one(node, _srl("not")))]
            if any(isinstance(c, Set | Not) for c in body):
                raise ParseError("a negation has patterns and filters only")
            return Not(tuple(body))
        raise ParseError(f"{node} is no pattern, filter, assignment or negation")

    def expression(self, node: str) -> tuple:
        names = self.all(node, f"<{NODES}var>", _srl("varName"))
        if names:
            return ("var", self.text(self.one(node, f"<{NODES}var>", _srl("varName"))))
        if node.startswith("_:"):
            lists = [(p, os[0]) for p, os in self.of.get(node, {}).items() if p != T.REST and len(os) == 1 and (os[0] == T.NIL or T.FIRST in self.of.get(os[0], {}))]
            if len(lists) == 1:
                return self.call(lists[0][0][1:-1], [self.expression(x) for x in self.items(lists[0][1])])
        return ("term", node)

    @staticmethod
    def call(name: str, args: list[tuple]) -> tuple:
        from ferrule.functions.expressions import ARITY

        if not name.startswith(SPARQL):
            return ("call", f"<{name}>", *args)
        local = name.removeprefix(SPARQL)
        if local == "not" and len(args) == 1:
            return ("u!", args[0])
        if op := OPERATORS.get(local):
            if len(args) < 2 or (len(args) > 2 and op not in CHAINED):
                raise ParseError(f"{local} has {len(args)} arguments")
            out = args[0]
            for x in args[1:]:
                out = (op, out, x)
            return out
        key = local.replace("-", "").replace("_", "").upper()
        for known, (least, most) in ARITY.items():
            if known.replace("_", "").upper() == key and least <= len(args) <= most:
                return ("call", known, *args)
        raise ParseError(f"unknown function {local} of {len(args)} arguments")

    def sets(self, chosen: str | None) -> list[str]:
        if chosen:
            if chosen.startswith(("<", "_:")):
                return [chosen]
            prefix, colon, local = chosen.partition(":")
            return [T.iri((self.prefixes | {"srl": self.prefixes.get("srl", RULES)})[prefix] + local if colon and prefix in {*self.prefixes, "srl"} else chosen)]
        typed = [s for s, po in self.of.items() if _srl("RuleSet") in po.get(T.TYPE, [])]
        return typed or [s for s in self.of if self.all(s, _srl("data"), _srl("rules"))]


def parse_rules(source: str, base: str = "", ruleset: str | None = None, imports: bool = False) -> Program:
    """The program of the rule sets of a Turtle text: the one that ``ruleset`` names, else those of the type,
    else all with data or rules. ``imports``: imports of the ontology count as imports."""
    g = Reader(source, base)
    chosen = g.sets(ruleset)
    if not chosen:
        raise ParseError("no rule set")
    out = Program(base, prefixes=dict(g.prefixes))
    if imports:
        out.imports = [o[1:-1] for s in g.of for o in g.all(s, IMPORTS)]
    for one in chosen:
        for node in (x for head in g.all(one, _srl("data")) for x in g.items(head)):
            a = g.atom(node)
            if any(not isinstance(x, str) for x in (a.s, a.p, a.o)) or not a.p.startswith("<") or a.p.startswith("<<("):
                raise ParseError("data are triples without variables, and their predicate is an IRI")
            out.data.append((a.s, a.p, a.o))
        for node in (x for head in g.all(one, _srl("rules")) for x in g.items(head)):
            body = [g.clause(x) for x in g.items(g.one(node, _srl("body")))]
            out.rules.append(Rule([g.atom(x) for x in g.items(g.one(node, _srl("head")))], body, node))
    return out
