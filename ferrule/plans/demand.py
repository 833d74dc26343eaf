"""Queries on demand: constants of a query reach into the rules (magic sets), so that a fixpoint covers what the answer
needs and not the whole closure.

For each predicate that rules make and each way it is asked for (subject, object or both known) there is a copy that
holds the wanted part, and a demand predicate with the values asked for. Rules of the copy begin with the demand; what
stands before a pattern in a rule tells the demand on it. Patterns with nothing known, in NOT, in paths, and
predicates whose rules make new nodes or run once need the whole relation; their rules stay as they are. So do those of
predicates without recursion below them: they are plans, which the demand joins without storing them.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from ferrule.functions.expressions import constant
from ferrule.lang.parser import Atom, Filter, Not, Program, Rule, Set
from ferrule.plans.analyze import Analysis, atom_variables, has_head_blank, reads
from ferrule.sources.catalog import Relation
from ferrule.terms import INTEGER, Var


class _Whole(Exception):
    def __init__(self, predicate: str):
        self.predicate = predicate


def _wanted(p: str, how: str) -> str:
    return f"<urn:demand:{how}:{p[1:-1]}>"


def _asked(p: str, how: str, s: object, o: object) -> Atom:
    a, b = (s if how[0] == "b" else o), (o if how[1] == "b" else s)
    return Atom(a, f"<urn:demand:of-{how}:{p[1:-1]}>", b)


def _equal_to(e: tuple, out: dict[str, str]) -> None:
    """Variables that a filter holds equal to a constant."""
    if e[0] == "&&":
        _equal_to(e[1], out), _equal_to(e[2], out)
    elif e[0] == "=":
        for a, b in ((e[1], e[2]), (e[2], e[1])):
            if a[0] == "var" and b[0] == "term":
                out[a[1]] = b[1]


def rewrite(program: Program, analysis: Analysis, body: list, as_terms: bool, based=lambda p: True) -> tuple[Program, list, list[tuple[str, str, str]]] | None:
    """(program, body, first demands as triples); None if nothing is gained. based: may a predicate have facts of its own?"""
    made: dict[str, list[int]] = {}
    for i, r in enumerate(program.rules):
        for a in r.head:
            if not isinstance(a.p, str):
                return None
            made.setdefault(a.p, []).append(i)
    whole = {p for p, rules in made.items() if any(has_head_blank(program.rules[i]) or i in analysis.run_once for i in rules)}
    deep: set[int] = set(analysis.recursive)  # rules with recursion in or below them
    while more := {i for i, needs in analysis.edges.items() if i not in deep and needs & deep}:
        deep |= more
    whole |= {p for p, rules in made.items() if not deep & set(rules)}
    bodies = [*[r.body for r in program.rules], body]
    if program.implied is not None or any(isinstance(p, Var) for b in bodies for c in b for a in (c.body if isinstance(c, Not) else [c]) if isinstance(a, Atom) for _, p, _ in reads(a)):
        return None

    def usable(t: object) -> bool:
        """A constant that compares as a join does."""
        return isinstance(t, str) and (as_terms or constant(t).kind == "num" or t.startswith("<"))

    fixed: dict[str, str] = {}
    for c in body:
        if isinstance(c, Filter):
            _equal_to(c.expr, fixed)
    fixed = {k: t for k, t in fixed.items() if (t.startswith("<") if as_terms else constant(t).kind == "num")}

    def changed(clauses: list, start: list, bound: set[str], known: dict[str, str], rules: list[Rule], goals: list, seeds: list) -> list:
        out, before = [], list(start)
        bound = set(bound) | set(known)
        for c in clauses:
            if isinstance(c, Not):
                for a in c.body:
                    if isinstance(a, Atom):
                        for _, p, _ in reads(a):
                            if p in made and p not in whole:
                                raise _Whole(p)
                out.append(c)
                continue
            new = c
            if isinstance(c, Atom):
                if isinstance(c.p, tuple):
                    for _, p, _ in reads(c):
                        if p in made and p not in whole:
                            raise _Whole(p)
                elif c.p in made and c.p not in whole:
                    told = lambda t: usable(t) or (isinstance(t, Var) and t.name in bound)
                    how = "".join("b" if told(t) else "f" for t in (c.s, c.o))
                    if how == "ff":
                        raise _Whole(c.p)
                    value = lambda t: known.get(t.name, t) if isinstance(t, Var) else t
                    want = _asked(c.p, how, value(c.s), value(c.o))
                    if isinstance(want.s, str) and isinstance(want.o, str):
                        seeds.append((want.s, want.p, want.o))
                    elif before != [want]:
                        rules.append(Rule([want], list(before), f"demand for {c.p} ({how})"))
                    goals.append((c.p, how))
                    new = Atom(c.s, _wanted(c.p, how), c.o)
                bound |= atom_variables(c)
            elif isinstance(c, Set):
                bound.add(c.var)
            out.append(new)
            before.append(new)
        return out

    while True:
        rules, goals, seeds, done = [], [], [], set()
        try:
            asked = changed(body, [], set(), fixed, rules, goals, seeds)
            while goals:
                p, how = goals.pop()
                if (p, how) in done:
                    continue
                done.add((p, how))
                x, y = Var("x"), Var("y")
                if based(p):
                    rules.append(Rule([Atom(x, _wanted(p, how), y)], [_asked(p, how, x, y), Atom(x, p, y)], f"facts of {p}"))
                for i in dict.fromkeys(made[p]):
                    r = program.rules[i]
                    computed = {c.var for c in r.body if isinstance(c, Set)}
                    for h in r.head:
                        if h.p != p:
                            continue
                        want = _asked(p, how, h.s, h.o)
                        given = [t for t, b in zip((h.s, h.o), how, strict=True) if b == "b"]
                        late = any(not isinstance(t, (Var, str)) or (isinstance(t, Var) and t.name in computed) for t in given)
                        begin = [] if late else [want]
                        inner = changed(r.body, begin, set() if late else {t.name for t in given if isinstance(t, Var)}, {}, rules, goals, seeds)
                        rules.append(Rule([Atom(h.s, _wanted(p, how), h.o)], [*begin, *inner, *([want] if late else [])], f"{r.name} ({how})"))
            break
        except _Whole as found:
            whole.add(found.predicate)
    if not done:
        return None
    # rules of what is needed as a whole, and of all that they read
    todo, kept = [p for c in [*asked, *[c for r in rules for c in r.body]] for a in (c.body if isinstance(c, Not) else [c]) if isinstance(a, Atom) for _, p, _ in reads(a) if p in whole], set()
    seen = set(todo)
    while todo:
        for i in made[todo.pop()]:
            if i not in kept:
                kept.add(i)
                read = {p for c in program.rules[i].body for a in (c.body if isinstance(c, Not) else [c]) if isinstance(a, Atom) for _, p, _ in reads(a) if p in made}
                read |= {a.p for a in program.rules[i].head}
                todo += read - seen
                seen |= read
    if any(p in seen for p, _ in done):  # a relation that is made as a whole anyway serves all
        whole_too = {p for p, _ in done} & seen
        return None if whole_too == {p for p, _ in done} else _without(program, analysis, body, as_terms, based, whole_too)
    return replace(program, rules=[*[program.rules[i] for i in sorted(kept)], *rules]), asked, list(dict.fromkeys(seeds))


def _without(program: Program, analysis: Analysis, body: list, as_terms: bool, based, whole: set[str]):
    once = replace(analysis, run_once=analysis.run_once | {i for i, r in enumerate(program.rules) for a in r.head if a.p in whole})
    return rewrite(program, once, body, as_terms, based)


def relations(spark: SparkSession, seeds: list[tuple[str, str, str]]) -> dict[str, Relation]:
    """First demands as relations of native values."""
    out: dict[str, Relation] = {}
    for s, p, o in seeds:
        a, b = constant(s), constant(o)
        wide = lambda t, v: v.col.cast("long") if v.kind == "num" and t.endswith(f"^^<{INTEGER}>") else v.col
        row: DataFrame = spark.range(1).select(wide(s, a).alias("s"), wide(o, b).alias("o"))
        new = Relation(row, a.kind, b.kind)
        out[p] = out[p].union(new) if p in out else new
    return out
