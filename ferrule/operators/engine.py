"""Evaluation: layers of rules, fixpoints by deltas, queries.

A layer without recursion is one DataFrame plan. A recursive layer is a loop on the driver: each
pass joins the last pass's new rows with everything so far, and keeps what is new. New rows are written to
the shared folder; a few of them (``LOCAL_ROWS`` at most) are kept as a constant relation of the plan instead, which
joins by broadcast and costs no files. What is known is one such relation, or a few files that are compacted.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule import terms as T
from ferrule.functions.expressions import Context, is_volatile
from ferrule.lang.parser import Atom, Not, Program, Rule, Set, parse, parse_body
from ferrule.operators.chains import chain_of, closed
from ferrule.plans import demand
from ferrule.plans.analyze import Analysis, analyze, atom_variables, has_head_blank, reads
from ferrule.plans.compiler import Compiler
from ferrule.sources.catalog import INTERNAL, Relation, Store
from ferrule.sources.graphs import from_triples


@dataclass(frozen=True)
class Options:
    max_iterations: int = 10_000
    strict: bool = False
    strict_grammar: bool = False
    relaxed_recursion: bool = True
    every_set_once: bool = False
    hybrid: bool = True
    hidden: frozenset[str] = frozenset()
    base: str = ""
    now: str = ""  # the time of the run
    uuids: Callable[[], Column] | None = None
    trace: bool = False
    #: Integers in terms of any length, by a pandas UDF; without it they are exact up to 38 digits, and an error beyond.
    wide_integers: bool = False
    functions: dict[str, Callable[..., Column]] = field(default_factory=dict)
    resolver: Callable[[str], str] | None = None


class RuleError(ValueError):
    pass


@dataclass
class Result:
    store: Store
    input: DataFrame | None
    analysis: Analysis
    iterations: int
    hidden: frozenset[str]
    #: With the option ``trace``: (rule, pass, predicate or None, new rows) in the order of evaluation.
    trace: list[tuple[str, int, str | None, int]] = field(default_factory=list)

    def relation(self, predicate: str) -> DataFrame:
        """(s, o) of a predicate, typed if it is derived from tables."""
        found = self.store.scan(predicate)
        return found.df if found.once else found.df.distinct()

    def closure(self) -> DataFrame:
        return self.store.scan_all().where(~F.col("p").isin(list(self.hidden)) if self.hidden else F.lit(True)).distinct()

    def inferred(self) -> DataFrame:
        """Triples that are not in the input."""
        out = from_triples(self.store.spark, [])
        for p, r in self.store.derived.items():
            if p not in INTERNAL:
                out = out.union(r.as_terms().df.select("s", F.lit(p).alias("p"), "o"))
        if self.store.graph is not None:
            out = out.union(self.store.graph.select("s", "p", "o"))
        if self.hidden:
            out = out.where(~F.col("p").isin(list(self.hidden)))
        out = out.distinct()
        return out if self.input is None else out.join(self.input, ["s", "p", "o"], "left_anti")


_own: list[str] = []
#: New rows of a pass up to which they are a constant of the plan (pairs or triples of terms: a few MB).
LOCAL_ROWS = 20_000
#: Files that what is known of a predicate is spread over, before they are written as one.
PARTS = 8


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where Spark runs in this process alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="ferrule-"))
        base = _own[0]
    return base.rstrip("/")


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """Cut the lineage with a table in the shared folder; lost executors don't matter."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rules-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@dataclass
class Known:
    """Rows that are known of a relation: constant parts as one table of Arrow, others in files."""

    few: pa.Table | None = None
    files: list[DataFrame] = field(default_factory=list)
    schema: object = None
    rows: set[tuple] = field(default_factory=set)  # those of few

    def unseen(self, new: pa.Table) -> list[int]:
        """Rows of new that are not known, each once."""
        out, here = [], set()
        for k, t in enumerate(zip(*[c.to_pylist() for c in new.columns], strict=True)):
            if t not in self.rows and t not in here:
                here.add(t)
                out.append(k)
        return out

    def frame(self, spark: SparkSession, start: DataFrame | None) -> DataFrame:
        parts = ([] if start is None else [start]) + self.files + ([constant_frame(spark, self.few, self.schema)] if self.few is not None and self.few.num_rows else [])
        out = parts[0]
        for x in parts[1:]:
            out = out.union(x)
        return out

    def put(self, rows: pa.Table | DataFrame, schema) -> None:
        self.schema = schema
        if isinstance(rows, pa.Table):
            self.few = rows if self.few is None else pa.concat_tables([self.few, rows.cast(self.few.schema)]).combine_chunks()
            self.rows.update(zip(*[c.to_pylist() for c in rows.columns], strict=True))
            if self.few.num_rows > LOCAL_ROWS:
                self.files.append(written(constant_frame(rows_spark(), self.few, schema))[0])
                self.few = None
                self.rows.clear()
        else:
            self.files.append(rows)
        if len(self.files) > PARTS:
            out = self.files[0]
            for x in self.files[1:]:
                out = out.union(x)
            self.files = [written(out)[0]]


def _wider(a: str, b: str) -> str:
    """Of two types of one kind, that which holds the values of both."""
    order = ["tinyint", "smallint", "int", "bigint", "float", "double"]
    return max(a, b, key=order.index) if a in order and b in order else a


def rows_spark() -> SparkSession:
    return SparkSession.getActiveSession()


def constant_frame(spark: SparkSession, rows: pa.Table, schema) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def taken(fresh: DataFrame, before: int) -> tuple[pa.Table | DataFrame, int]:
    """Rows of a pass and their number: as a constant if they are few. before: the number in the last pass, which tells
    what to try first."""
    if before <= LOCAL_ROWS:
        few = fresh.limit(LOCAL_ROWS + 1).toArrow()
        if few.num_rows <= LOCAL_ROWS:
            return few, few.num_rows
    df, _ = written(fresh)
    return df, df.count()


def resolve_imports(program: Program, resolver: Callable[[str], str] | None, seen: set[str] | None = None) -> Program:
    """Imported programs first, each once; without a resolver imports are an error."""
    seen = set() if seen is None else seen
    merged = Program(program.base, program.version, [], dict(program.prefixes), implied=program.implied)
    for target in program.imports:
        if target in seen:
            continue
        seen.add(target)
        if resolver is None:
            raise RuleError(f"no resolver for the import {target}")
        inner = resolve_imports(parse_any(resolver(target), target), resolver, seen)
        merged.data += inner.data
        merged.rules += inner.rules
    merged.data += program.data
    merged.rules += program.rules
    return merged


def parse_any(source: str, base: str = "", strict: bool = False, syntax: str = "auto", ruleset: str | None = None, include_facts: bool = False) -> Program:
    """A program from rule text ("srl"), its RDF encoding ("rdf") or a message log ("messages")."""
    from ferrule.lang.rdf_rules import looks_like_rules, parse_rules
    from ferrule.streaming.messages import looks_like_log, replay

    if syntax == "messages" or (syntax == "auto" and looks_like_log(source)):
        return Program(base, data=replay(source, base, include_facts))
    if syntax == "rdf" or (syntax == "auto" and looks_like_rules(source)):
        return parse_rules(source, base, ruleset)
    return parse(source, base, strict)


def compile_program(program: Program | str, options: Options = Options(), change: Callable[[Program], Program] = lambda p: p) -> tuple[Program, Analysis]:
    if isinstance(program, str):
        program = parse_any(program, options.base, options.strict_grammar)
    program = change(resolve_imports(program, options.resolver))
    analysis = analyze(program, options.strict, options.relaxed_recursion, options.every_set_once)
    if analysis.errors:
        raise RuleError("; ".join(f"{d.code}: {d.message}" for d in analysis.errors))
    return program, analysis


def helper_predicates(program: Program) -> frozenset[str]:
    """Predicates that are computed on demand and kept out of results: each of their rules assigns
    values, makes no new nodes and has only plain patterns, and some body asks for them."""
    asked = {p for r in program.rules for c in r.body for a in (c.body if isinstance(c, Not) else [c]) if isinstance(a, Atom) for _, p, _ in reads(a)}
    heads: dict[object, list[Rule]] = {}
    for r in program.rules:
        for a in r.head:
            heads.setdefault(a.p, []).append(r)

    def plain(r: Rule) -> bool:
        return not has_head_blank(r) and all(isinstance(a.p, str) for a in r.head) and not any(isinstance(c, Atom) and isinstance(c.p, tuple) for c in r.body)

    good = {p for p, rs in heads.items() if isinstance(p, str) and p in asked and all(plain(r) for r in rs) and any(isinstance(c, Set) for r in rs for c in r.body)}
    return frozenset(p for p in good if all({a.p for a in r.head} <= good for r in heads[p]))


def evaluate(program: Program, analysis: Analysis, store: Store, options: Options = Options()) -> Result:
    spark = store.spark
    as_terms = store.graph is not None or bool(program.data)
    if program.data:
        data = from_triples(spark, program.data)
        store = replace(store, graph=data if store.graph is None else store.graph.union(data).distinct(), derived=dict(store.derived))
    else:
        store = replace(store, derived=dict(store.derived))
    if program.implied is not None:
        store.derived[IMPLIES] = Relation(written(closure_of(spark, *program.implied))[0])
    if store.graph is None and any(not isinstance(a.p, str) for r in program.rules for a in r.head):
        store.graph, as_terms = from_triples(spark, []), True
    start = store.graph
    ctx = Context(options.base or program.base, options.now, options.functions, options.uuids, options.wide_integers)
    compiler = Compiler(store, ctx)
    iterations = 0

    def wanted(rule: Rule) -> set[str] | None:
        """Variables of the head; all where a new node depends on them."""
        return None if has_head_blank(rule) else set().union(*map(atom_variables, rule.head)) if rule.head else set()

    def heads(indexes: list[int], delta_of=None) -> list:
        out = []
        for i in indexes:
            rule = program.rules[i]
            if any(isinstance(c, Atom) and isinstance(c.p, str) and store.graph is None and c.p not in store.predicates and c.p not in store.derived for c in rule.body):
                continue  # a relation that has no rows yet
            if delta_of is None and (met := compiler.pairs(rule)) is not None:
                out.append((rule.head[0].p, met))
                continue
            for found in [compiler.body(rule.body, wanted=wanted(rule))] if delta_of is None else delta_of(i, rule):
                out += compiler.head(rule.head, found, i, as_terms)
        return out

    def gathered(parts: list) -> dict[str | None, Relation | DataFrame]:
        out: dict = {}
        for p, r in parts:
            out[p] = r if p not in out else out[p].union(r)
        return out

    state: dict[str | None, Known] = {}
    counts: dict[str | None, int] = {}
    traced: list[tuple[str, int, str | None, int]] = []

    bases: dict[str | None, DataFrame | None] = {}

    def start_of(p: str | None) -> DataFrame | None:
        """What a relation had before its first pass in a loop: a constant if it is small, else a file."""
        if p not in state:
            old = store.graph if p is None else store.derived[p].df if p in store.derived else None
            state[p], bases[p] = Known(), None
            if old is not None:
                few = old.limit(LOCAL_ROWS + 1).toArrow()
                if few.num_rows <= LOCAL_ROWS:
                    state[p].put(few, old.schema)
                else:
                    bases[p] = written(old)[0]
        return bases[p]

    def unique(p: str) -> bool:
        """Are the rows of a predicate distinct as they are: made by one rule from the rows of one table, with their key?"""
        rules = [r for r in program.rules if any(a.p == p for a in r.head)]
        subjects = {c.s for r in rules for c in r.body if isinstance(c, Atom)}
        if len(rules) != 1 or len(subjects) != 1 or store.graph is not None or p in store.derived or p in store.predicates:
            return False
        tables = {store.table_atom(c.p).table if isinstance(c.p, str) and store.table_atom(c.p) else None for c in rules[0].body if isinstance(c, Atom)}
        return len(tables) == 1 and None not in tables and all(s in (a.s, a.o) for s in subjects for a in rules[0].head if a.p == p)

    def add(p: str | None, new) -> None:
        """Add the rows of rules that run once, as a plan."""
        if p is None:
            store.graph = store.graph.union(written(new.distinct().join(store.graph, ["s", "p", "o"], "left_anti"))[0])
            return
        old = store.derived.get(p)
        if old is not None and (old.s_kind, old.o_kind) != (new.s_kind, new.o_kind):
            old, new = old.as_terms(), new.as_terms()
        if old is None and new.once:
            store.derived[p] = new
            return
        rows, kept = new.df if old is None else old.df.union(new.df), unique(p)
        store.derived[p] = Relation(rows if kept else rows.distinct(), new.s_kind, new.o_kind, not kept)

    def put(p: str | None, new) -> DataFrame | None:
        """Add the rows of a pass; the new ones, None if there are none."""
        key = ["s", "p", "o"] if p is None else ["s", "o"]
        old = None if p is None else store.derived.get(p)
        if old is not None and (old.s_kind, old.o_kind) != (new.s_kind, new.o_kind):
            new = new.as_terms()
            if (old.s_kind, old.o_kind) != ("term", "term"):
                store.derived[p] = old = old.as_terms()
                state.pop(p, None)
        start, known = start_of(p), state[p]
        rows = new if p is None else new.df
        if known.schema is not None or start is not None:
            types = {f.name: f.dataType.simpleString() for f in (known.schema or start.schema)}
            wider = {c: _wider(types[c], t) for c, t in rows.dtypes}
            if wider != types:  # what is known takes the wider type too
                cast = lambda df: df.select(*[F.col(c).cast(wider[c]) for c in key])
                start = bases[p] = None if start is None else cast(start)
                known.files = [cast(x) for x in known.files]
                if known.few is not None:
                    known.few = cast(constant_frame(spark, known.few, known.schema)).toArrow()
            rows = rows.select(*[F.col(c).cast(wider[c]) for c in key])
            known.schema = rows.schema
        found = None
        if start is None and not known.files:  # all that is known is here: a few new rows are compared here too
            got = rows.limit(LOCAL_ROWS + 1).toArrow()
            if got.num_rows <= LOCAL_ROWS:
                found = got.take(pa.array(known.unseen(got), pa.int64()))
        if found is None:
            rows = rows.distinct()
            if start is not None or known.files or known.few is not None:
                rows = rows.join(known.frame(spark, start), key, "left_anti")
            found, n = taken(rows, counts.get(p, 0))
        else:
            n = found.num_rows
        counts[p] = n
        if not n:
            return None
        known.put(found, rows.schema)
        whole = known.frame(spark, start)
        if p is None:
            store.graph = whole
        else:
            store.derived[p] = Relation(whole, new.s_kind, new.o_kind)
        return constant_frame(spark, found, rows.schema) if isinstance(found, pa.Table) else found

    def told(indexes: list[int], passes: int, delta_of=None) -> None:
        """With trace: each rule by itself, what it adds to what is known."""
        for i in indexes:
            for p, new in gathered(heads([i], delta_of)).items():
                seen = store.graph if p is None else store.derived.get(p)
                rows = new if p is None else new.df if seen is None else new.as_terms().df
                if seen is not None:
                    rows = rows.join(seen if p is None else seen.as_terms().df, rows.columns, "left_anti")
                if n := rows.distinct().count():
                    traced.append((program.rules[i].name or f"rule {i + 1}", passes, p, n))

    for layer in analysis.layers:
        once = [i for i in layer if i in analysis.run_once]
        plain = [i for i in layer if i not in analysis.run_once and i not in analysis.recursive]
        loop = [i for i in layer if i not in analysis.run_once and i in analysis.recursive]
        if options.trace:
            told(once + plain, 0)
        for p, new in gathered(heads(once + plain)).items():
            drawn = p is not None and any(is_volatile(c.expr) for i in once for c in program.rules[i].body if isinstance(c, Set))
            add(p, replace(new, df=written(new.df)[0]) if drawn else new)  # random values are drawn once
        if not loop:
            continue
        chain = None if options.trace or as_terms else chain_of([program.rules[i] for i in loop])
        if chain is not None and (whole := closed(store, chain, written)) is not None:
            store.derived[chain.p], passes = whole
            iterations += passes
            continue
        state.clear(), bases.clear(), counts.clear()
        if options.trace:
            told(loop, 0)
        deltas = {p: put(p, new) for p, new in gathered(heads(loop)).items()}
        while True:
            iterations += 1
            if iterations > options.max_iterations:
                raise RuleError(f"no fixpoint after {options.max_iterations} iterations")
            live = {p: d for p, d in deltas.items() if d is not None}
            if not live:
                break

            def from_delta(i: int, rule: Rule, live=live) -> list:
                out = []
                for k, c in enumerate(rule.body):
                    if not isinstance(c, Atom):
                        continue
                    if as_terms:
                        d = live[None]
                        if isinstance(c.p, tuple):  # a path: its parts change together
                            return [compiler.body(rule.body, wanted=wanted(rule))]
                        out.append(compiler.body(rule.body, k, d if not isinstance(c.p, str) else d.where(F.col("p") == c.p).select("s", "o"), wanted=wanted(rule)))
                    elif isinstance(c.p, tuple):
                        return [compiler.body(rule.body, wanted=wanted(rule))]
                    elif c.p in live:
                        r = store.derived[c.p]
                        out.append(compiler.body(rule.body, k, live[c.p], (r.s_kind, r.o_kind), wanted(rule)))
                return out

            if options.trace:
                told(loop, iterations, from_delta)
            deltas = {p: put(p, x) for p, x in gathered(heads(loop, from_delta)).items()}
    hidden = options.hidden | (helper_predicates(program) if options.hybrid and not options.every_set_once else frozenset())
    return Result(store, start, analysis, iterations, hidden, traced)


def run(spark: SparkSession, program: Program | str, store: Store | None = None, options: Options = Options()) -> Result:
    """Forward closure of a program over a store (tables, graph) and its own data."""
    options = timed(options)
    store = store or Store(spark, graph=from_triples(spark, []))
    parsed, analysis = compile_program(program, options, lambda p: implied(p, store))
    return evaluate(parsed, analysis, store, options)


def timed(options: Options) -> Options:
    """NOW() is one time for a run."""
    return options if options.now else replace(options, now=datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z")


def demanded(program: Program, body: list) -> Program:
    """The rules that a query can need."""
    from ferrule.lang.parser import Rule as R

    analysis = analyze(Program(rules=[*program.rules, R([Atom("<urn:query>", "<urn:query>", "<urn:query>")], body, "query")], prefixes=program.prefixes))
    last = len(program.rules)
    todo, seen = [last], set()
    while todo:
        i = todo.pop()
        if i not in seen:
            seen.add(i)
            todo += analysis.edges[i]
    return replace(program, rules=[r for i, r in enumerate(program.rules) if i in seen])


def query(spark: SparkSession, program: Program | str, body: str, store: Store | None = None, options: Options = Options(), mode: str = "auto") -> DataFrame:
    """Distinct bindings of a body pattern over the closure. Mode "auto" and "backward": on demand, so constants of the
    pattern reach into the rules (see ``plans.demand``), and only rules that it can need are run; "forward": all of them."""
    options = timed(options)
    store = store or Store(spark, graph=from_triples(spark, []))
    parsed, analysis = compile_program(program, options, lambda p: implied(p, store))
    clauses = parse_body(body, parsed.prefixes, parsed.base)
    part, asked, seeds = parsed, clauses, []
    if mode != "forward":
        part = demanded(parsed, clauses)
        as_terms = store.graph is not None or bool(parsed.data)
        changed = demand.rewrite(part, analyze(part, options.strict, options.relaxed_recursion, options.every_set_once), clauses, as_terms, lambda p: as_terms or p in store.predicates or p in store.derived)
        if changed is not None:
            part, asked, seeds = changed
    if seeds and (store.graph is not None or part.data):
        part = replace(part, data=[*part.data, *seeds])
    elif seeds:
        store = replace(store, derived=store.derived | demand.relations(spark, seeds))
    result = evaluate(part, analyze(part, False, options.relaxed_recursion, options.every_set_once), store, options)
    return Compiler(result.store, Context(options.base or parsed.base, options.now, options.functions, options.uuids, options.wide_integers)).solutions(asked)


#: Rules of the shape ``?x a C => ?x a D`` from which on they are data.
SHAPED = 50


def implied(program: Program, store: Store | None = None) -> Program:
    """Many rules of the shape ``?x a C => ?x a D`` as one lookup in the closure of the facts ``C <urn:implies> D``, so
    that their number makes rows and not layers."""
    return rules_as_data(program, store) if len(program.rules) >= SHAPED else program


def rules_as_data(program: Program, store: Store | None = None) -> Program:
    """The rewriting of ``implied`` for any number of rules. The closure is searched from classes that can occur: those
    of the data and the graph, and all if another rule makes types."""
    x, c, d = T.Var("x"), T.Var("c"), T.Var("d")
    facts, rest = [], []
    for r in program.rules:
        body = r.body[0] if len(r.body) == 1 else None
        simple = isinstance(body, Atom) and isinstance(body.s, T.Var) and body.p == T.TYPE and isinstance(body.o, str)
        if simple and all(a.s == body.s and a.p == T.TYPE and isinstance(a.o, str) for a in r.head):
            facts += [(body.o, a.o) for a in r.head]
        else:
            rest.append(r)
    if not facts:
        return program
    sources: set[str] | None = {o for _, p, o in program.data if p == T.TYPE}
    if store is None or any(not isinstance(a.p, str) or a.p == T.TYPE for r in rest for a in r.head) or T.TYPE in store.predicates or T.TYPE in store.derived:
        sources = None
    elif store.graph is not None:
        classes = store.graph.where(F.col("p") == T.TYPE).select("o").distinct()
        sources |= {r.o for r in classes.join(F.broadcast(store.spark.createDataFrame([(f,) for f in {f for f, _ in facts}], "o string")), "o", "left_semi").collect()}
    lookup = Rule([Atom(x, T.TYPE, d)], [Atom(x, T.TYPE, c), Atom(c, IMPLIES, d)], "implied types")
    return replace(program, data=program.data, rules=[lookup, *rest], implied=(facts, sources))


IMPLIES = "<urn:implies>"


def closure_of(spark: SparkSession, facts: list[tuple[str, str]], sources: set[str] | None) -> DataFrame:
    """(s, o): what each source reaches. The facts are program text and so fit every task; sources are dealt out, and a
    task yields the pairs of one source after the other."""
    after: dict[str, list[str]] = {}
    for s, o in facts:
        after.setdefault(s, []).append(o)
    begin = sorted(s for s in after if sources is None or s in sources)

    def reached(batches):
        for batch in batches:
            for s in batch.column(0).to_pylist():
                seen, todo = set(), list(after[s])
                while todo:
                    v = todo.pop()
                    if v not in seen:
                        seen.add(v)
                        todo += after.get(v, ())
                found = list(seen)
                for k in range(0, len(found), 50_000):
                    part = found[k : k + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([s] * len(part), pa.string()), pa.array(part, pa.string())], names=["s", "o"])

    rows = spark.createDataFrame([(s,) for s in begin], "s string")
    return rows.repartition(max(1, min(len(begin) // 16, 200))).mapInArrow(reached, "s string, o string")
