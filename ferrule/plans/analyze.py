"""Safety, dependencies, strata of a program, on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

from ferrule.functions.expressions import expression_variables, is_volatile
from ferrule.lang.parser import Atom, Filter, Not, Program, Rule, Set
from ferrule.terms import Nested, Var, variables


@dataclass
class Diagnostic:
    severity: str
    code: str
    message: str


@dataclass
class Analysis:
    diagnostics: list[Diagnostic] = field(default_factory=list)
    layers: list[list[int]] = field(default_factory=list)
    edges: dict[int, set[int]] = field(default_factory=dict)  # rule -> rules it needs
    recursive: set[int] = field(default_factory=set)
    run_once: set[int] = field(default_factory=set)

    @property
    def errors(self) -> list[Diagnostic]:
        return [d for d in self.diagnostics if d.severity == "error"]


def atom_variables(a: Atom) -> set[str]:
    return variables(a.s) | (variables(a.p) if not isinstance(a.p, tuple) else set()) | variables(a.o)


def path_predicates(p: object) -> list[tuple[object, object, object]]:
    """(s, p, o) shapes that a path reads."""
    if isinstance(p, tuple):
        return [x for part in p[1:] for x in path_predicates(part)]
    return [(None, p, None)]


def reads(a: Atom) -> list[tuple[object, object, object]]:
    return path_predicates(a.p) if isinstance(a.p, tuple) else [(a.s, a.p, a.o)]


def unify(a: object, b: object) -> bool:
    if a is None or b is None or isinstance(a, Var) or isinstance(b, Var):
        return True
    if isinstance(a, Nested) and isinstance(b, Nested):
        return unify(a.s, b.s) and unify(a.p, b.p) and unify(a.o, b.o)
    if isinstance(a, Nested) or isinstance(b, Nested):
        other = b if isinstance(a, Nested) else a
        return isinstance(other, str) and other.startswith("<<(")
    return a == b or (a.startswith("_:") or b.startswith("_:"))


def has_head_blank(rule: Rule) -> bool:
    def blank(t: object) -> bool:
        return (isinstance(t, str) and t.startswith("_:")) or (isinstance(t, Nested) and any(map(blank, (t.s, t.p, t.o))))

    return any(blank(t) for a in rule.head for t in (a.s, a.o))


def body_variables(body: list) -> set[str]:
    out: set[str] = set()
    for c in body:
        out |= atom_variables(c) if isinstance(c, Atom) else {c.var} if isinstance(c, Set) else set()
    return out


def _check(rule: Rule, say) -> None:
    bound: set[str] = set()

    def clauses(body, bound: set[str]) -> None:
        for c in body:
            if isinstance(c, Atom):
                bound |= atom_variables(c)
            elif isinstance(c, Filter):
                if missing := expression_variables(c.expr) - bound:
                    say("error", "unbound-filter-variable", f"{rule.name}: FILTER uses {sorted(missing)} before it is bound")
            elif isinstance(c, Set):
                if missing := expression_variables(c.expr) - bound:
                    say("error", "unbound-assignment-variable", f"{rule.name}: SET uses {sorted(missing)} before it is bound")
                if c.var in bound:
                    say("error", "rebound-variable", f"{rule.name}: SET binds ?{c.var} again")
                bound.add(c.var)
            elif isinstance(c, Not):
                clauses(c.body, set(bound))

    clauses(rule.body, bound)
    for a in rule.head:
        if missing := atom_variables(a) - bound:
            say("error", "unsafe-head-variable", f"{rule.name}: head variable {sorted(missing)} isn't bound by the body")
        if isinstance(a.p, str) and (not a.p.startswith("<") or a.p.startswith("<<")):
            say("error", "invalid-head-predicate", f"{rule.name}: head predicate {a.p} is no IRI")


def components(nodes: list[int], edges: dict[int, set[int]]) -> list[list[int]]:
    """Strongly connected components, those that are needed first (Tarjan, without recursion)."""
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    stack: list[int] = []
    on: set[int] = set()
    out: list[list[int]] = []
    for root in nodes:
        if root in index:
            continue
        work = [(root, iter(sorted(edges[root])))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(sorted(edges[w]))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        part.append(w)
                        if w == v:
                            break
                    out.append(sorted(part))
    return out


def analyze(program: Program, strict: bool = False, relaxed_recursion: bool = True, every_set_once: bool = False) -> Analysis:
    out = Analysis()
    say = lambda *x: out.diagnostics.append(Diagnostic(*x))
    rules = program.rules
    for r in rules:
        _check(r, say)
    by_predicate: dict[object, list[tuple[int, Atom]]] = {}
    for i, r in enumerate(rules):
        for a in r.head:
            by_predicate.setdefault(a.p if isinstance(a.p, str) else None, []).append((i, a))
    negative: set[tuple[int, int]] = set()
    out.edges = {i: set() for i in range(len(rules))}
    for i, r in enumerate(rules):
        sets = any(isinstance(c, Set) for c in r.body)
        once = (sets and (every_set_once or any(isinstance(c, Not) for c in r.body))) or has_head_blank(r) or any(is_volatile(c.expr) for c in r.body if isinstance(c, Set))
        if once:
            out.run_once.add(i)

        def needs(atom: Atom, is_not: bool, i: int = i, once: bool = once) -> None:
            for s, p, o in reads(atom):
                known = by_predicate.get(p, []) + by_predicate.get(None, []) if isinstance(p, str) else [x for v in by_predicate.values() for x in v]
                for j, head in known:
                    if unify(s, head.s) and unify(p, head.p) and unify(o, head.o):
                        if is_not and once and i == j and not has_head_blank(rules[i]):
                            continue
                        out.edges[i].add(j)
                        if is_not:
                            negative.add((i, j))

        for c in r.body:
            if isinstance(c, Atom):
                needs(c, False)
            elif isinstance(c, Not):
                for x in c.body:
                    if isinstance(x, Atom):
                        needs(x, True)
    parts = components(list(range(len(rules))), out.edges)
    of = {i: k for k, part in enumerate(parts) for i in part}
    level: dict[int, int] = {}
    for k, part in enumerate(parts):
        level[k] = 1 + max((level[of[j]] for i in part for j in out.edges[i] if of[j] != k), default=-1)
        if len(part) > 1 or part[0] in out.edges[part[0]]:
            out.recursive |= set(part)
        for i in part:
            if any((i, j) in negative and of[j] == k for j in out.edges[i]):
                say("error", "unstratified-negation", f"{rules[i].name}: negation inside a recursive layer")
            if i in out.recursive and (any(isinstance(c, Set) for c in rules[i].body) or has_head_blank(rules[i])):
                say("warning", "recursive-assignment-rule", f"{rules[i].name}: makes terms in a recursive layer")
                if relaxed_recursion and len(part) > 0 and i in out.run_once and not any(isinstance(c, Not) for c in rules[i].body):
                    out.run_once.discard(i)
    for i in range(len(rules)):
        at = level[of[i]]
        while len(out.layers) <= at:
            out.layers.append([])
        out.layers[at].append(i)
    if strict:
        for d in out.diagnostics:
            d.severity = "error"
    return out
