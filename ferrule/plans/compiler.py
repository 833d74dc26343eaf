"""Rule bodies as DataFrame plans.

A body is compiled from left to right: triple patterns join, NOT is an anti-join on the variables bound so
far, FILTER is a selection, SET a projection. Patterns with one subject over one table become one scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.expressions import FUNCTIONS, VOLATILE, Context, V, as_bool, as_term, compile_expression, constant, expression_variables, is_volatile, kind_of
from ferrule.lang.parser import Atom, Filter, Not, Rule, Set
from ferrule.plans.analyze import atom_variables
from ferrule.sources.catalog import Relation, Store
from ferrule.terms import Nested, Var


@dataclass
class Solutions:
    """Bindings: a column a variable; kinds says how values are kept. df None is the one empty binding."""

    df: DataFrame | None = None
    kinds: dict[str, str] = field(default_factory=dict)

    def env(self) -> dict[str, V]:
        return {k: V(kind, F.col(f"`{k}`")) for k, kind in self.kinds.items()}


def _match(df: DataFrame, shape: list[tuple[str, str, object]]) -> Solutions:
    """Bind columns (name, kind, pattern) of df to variables; constants and repeated variables select."""
    conditions: list[Column] = []
    bound: dict[str, V] = {}
    todo = [(V(kind, F.col(name)), pattern) for name, kind, pattern in shape]
    while todo:
        v, pattern = todo.pop(0)
        if isinstance(pattern, Var):
            if pattern.name in bound:
                other = bound[pattern.name]
                conditions.append(v.col == other.col if v.kind == other.kind else as_term(v) == as_term(other))
            else:
                bound[pattern.name] = v
        elif isinstance(pattern, Nested):
            conditions.append(v.col.startswith("<<(") if v.kind == "term" else F.lit(False))
            todo += [(FUNCTIONS[f](v), part) for f, part in (("SUBJECT", pattern.s), ("PREDICATE", pattern.p), ("OBJECT", pattern.o))]
        elif v.kind == "term":
            conditions.append(v.col == pattern)
        else:
            c = constant(pattern)
            conditions.append(v.col == c.col if c.kind == v.kind else as_term(v) == F.lit(pattern))
    for c in conditions:
        df = df.where(c)
    return Solutions(df.select(*[v.col.alias(k) for k, v in bound.items()]) if bound else df.select(F.lit(1).alias("__one")), {k: v.kind for k, v in bound.items()})


def join(a: Solutions, b: Solutions, semi: bool = False) -> Solutions:
    """semi: nothing that b alone binds is wanted, so a row of a stays once however many rows of b it meets."""
    if a.df is None:
        return b
    shared = [k for k in b.kinds if k in a.kinds]
    left, right = a.df, b.df
    kinds = {**a.kinds, **b.kinds}
    for k in shared:
        if a.kinds[k] != b.kinds[k]:
            left = left.withColumn(k, as_term(V(a.kinds[k], F.col(f"`{k}`"))))
            right = right.withColumn(k, as_term(V(b.kinds[k], F.col(f"`{k}`"))))
            kinds[k] = "term"
    if not shared:
        return Solutions(_cross(left, right, a, b), kinds)
    if semi:
        return Solutions(left.join(right, shared, "left_semi"), {k: kinds[k] for k in a.kinds})
    return Solutions(left.join(right, shared), kinds)


def _once(df: DataFrame, name: str, values: Column) -> DataFrame:
    """df with a column of the elements of a list of one or no value. A generator keeps the optimizer from writing
    the expression out wherever the column is read, which grows without bound along a chain of assignments."""
    return df.select(*[F.col(f"`{k}`") for k in df.columns], F.explode(values).alias(name))


def variables_of(clauses) -> set[str]:
    """Variables that clauses read or bind."""
    out: set[str] = set()
    for c in clauses:
        if isinstance(c, Atom):
            out |= atom_variables(c)
        elif isinstance(c, Not):
            out |= variables_of(c.body)
        else:
            out |= expression_variables(c.expr) | ({c.var} if isinstance(c, Set) else set())
    return out


def _cross(left: DataFrame, right: DataFrame, a: Solutions, b: Solutions) -> DataFrame:
    """No shared variable: all pairs; a side without variables only asks whether it has a row."""
    if not b.kinds:
        return left.join(right.withColumnRenamed("__one", "__any").limit(1), F.lit(True), "left_semi")
    if not a.kinds:
        return right.join(left.withColumnRenamed("__one", "__any").limit(1), F.lit(True), "left_semi")
    return left.crossJoin(right)


def path_relation(path: object, scan) -> Relation:
    if not isinstance(path, tuple):
        return scan(path)
    if path[0] == "inverse":
        r = path_relation(path[1], scan)
        return Relation(r.df.select(F.col("o").alias("s"), F.col("s").alias("o")), r.o_kind, r.s_kind)
    a, b = path_relation(path[1], scan), path_relation(path[2], scan)
    if a.o_kind != b.s_kind:
        a, b = a.as_terms(), b.as_terms()
    left, right = a.df.select(F.col("s").alias("a"), F.col("o").alias("m")), b.df.select(F.col("s").alias("m"), F.col("o").alias("b"))
    return Relation(left.join(right, "m").select(F.col("a").alias("s"), F.col("b").alias("o")).distinct(), a.s_kind, b.o_kind)


#: Parts that the rows of one value are dealt into where pairs of rows are met.
SHARES = 32


class Compiler:
    """delta: the relation that stands for atom number ``delta_at`` (semi-naive evaluation)."""

    def __init__(self, store: Store, ctx: Context):
        self.store, self.ctx = store, ctx

    def atom(self, a: Atom, replaced: DataFrame | None = None, kinds: tuple[str, str] = ("term", "term")) -> Solutions:
        if isinstance(a.p, (Var, Nested)):
            df = replaced if replaced is not None else self.store.scan_all()
            return _match(df, [("s", "term", a.s), ("p", "term", a.p), ("o", "term", a.o)])
        if replaced is not None:
            return _match(replaced, [("s", kinds[0], a.s), ("o", kinds[1], a.o)])
        r = path_relation(a.p, self.store.scan)
        return _match(r.df, [("s", r.s_kind, a.s), ("o", r.o_kind, a.o)])

    def star(self, atoms: list[Atom]) -> Solutions:
        """Patterns with one subject over one table as one scan of the columns they name."""
        columns = [self.store.table_atom(a.p) for a in atoms]
        df = self.store.tables[columns[0].table].select(columns[0].subject.alias("s"), *[c.object.alias(f"o{k}") for k, c in enumerate(columns)])
        types = dict(df.dtypes)
        for k in range(len(atoms)):
            df = df.where(F.col(f"o{k}").isNotNull())
        return _match(df, [("s", kind_of(types["s"]), atoms[0].s), *[(f"o{k}", kind_of(types[f"o{k}"]), a.o) for k, a in enumerate(atoms)]])

    def body(self, body, delta_at: int | None = None, delta: DataFrame | None = None, kinds: tuple[str, str] = ("term", "term"), wanted: set[str] | None = None) -> Solutions:
        """wanted: the variables that are read afterwards, None for all; patterns that bind no such variable are semi-joins."""
        out, k = Solutions(), 0
        computed: set[str] = set()
        spread = False

        def joined(found: Solutions, after: int) -> Solutions:
            if wanted is not None:
                found = self.nearest(found, out, body[after:], wanted)
            semi = wanted is not None and out.df is not None and not ((set(found.kinds) - set(out.kinds)) & (wanted | variables_of(body[after:])))
            return join(out, found, semi and bool(set(found.kinds) & set(out.kinds)))

        body = list(body)
        while k < len(body):
            c = body[k]
            if isinstance(c, Atom):
                here = self.store.table_atom(c.p) if isinstance(c.p, str) and k != delta_at else None
                run = [c]
                if here is not None and isinstance(c.s, Var):
                    while k + len(run) < len(body) and k + len(run) != delta_at and self._same_row(body[k + len(run)], c, here.table):
                        run.append(body[k + len(run)])
                if here is not None and self.store.graph is None:
                    out = joined(self.star(run), k + len(run))
                    k += len(run)
                    continue
                out = joined(self.atom(c, delta if k == delta_at else None, kinds), k + 1)
            elif isinstance(c, Filter):
                df = self._frame(out)
                staged, expr, env = self._staged(df, c.expr, out.env())
                out = Solutions(staged.where(as_bool(compile_expression(expr, env, self.ctx))).select(*df.columns), out.kinds)
            elif isinstance(c, Set):
                df = self._frame(out)
                staged, expr, env = self._staged(df, c.expr, out.env())
                v = compile_expression(expr, env, self.ctx)
                read = any(c.var in variables_of([x]) for x in body[k + 1 :] if not isinstance(x, Atom))
                heavy = staged is not df or v.kind == "term" and read
                if heavy and not spread and out.kinds and delta is None and not any(is_volatile(x.expr) for x in body if isinstance(x, Set)):
                    # work on texts of terms isn't left to the few tasks that read a small table
                    spread, df = True, df.repartition(*[F.col(f"`{n}`") for n in out.kinds])
                    staged, expr, env = self._staged(df, c.expr, out.env())
                    v = compile_expression(expr, env, self.ctx)
                if c.var in out.kinds:
                    out = Solutions(staged.where(as_term(out.env()[c.var]) == as_term(v)).select(*df.columns), out.kinds)
                else:
                    if v.kind == "term" and (read or expr[0] in ("+", "-", "*")) or computed & expression_variables(c.expr):
                        staged = _once(staged, c.var, F.array_compact(F.array(v.col)))
                    else:
                        staged = staged.withColumn(c.var, v.col).where(F.col(f"`{c.var}`").isNotNull())
                    computed.add(c.var)
                    out = Solutions(staged.select(*[F.col(f"`{k}`") for k in (*df.columns, c.var)]), {**out.kinds, c.var: v.kind})
            else:
                out = self.negation(out, c)
            k += 1
        return out

    def nearest(self, found: Solutions, out: Solutions, rest: list, wanted: set[str]) -> Solutions:
        """Where all that is asked of found is whether a value stands below (above) one that out has, the least (greatest)
        value of each key decides, and pairs need not be met."""
        new = (set(found.kinds) - set(out.kinds)) & (wanted | variables_of(rest))
        if not out.kinds or len(new) != 1 or new & wanted:
            return found
        (y,) = new
        reading = [c for c in rest if y in variables_of([c])]
        if len(reading) != 1 or not isinstance(reading[0], Filter) or reading[0].expr[0] not in ("<", "<=", ">", ">="):
            return found
        op, a, b = reading[0].expr
        if ("var", y) not in (a, b):
            return found
        other = b if a == ("var", y) else a
        if expression_variables(other) - set(out.kinds) or is_volatile(other):
            return found
        kind = compile_expression(other, out.env(), self.ctx).kind
        if kind != found.kinds[y] or kind not in ("num", "ts", "str"):
            return found  # compared as text or as terms, in another order than that of the column
        least = (a == ("var", y)) == (op in ("<", "<="))
        keys = [k for k in found.kinds if k in out.kinds]
        value = F.col(f"`{y}`")
        df = found.df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg((F.min(value) if least else F.max(value)).alias(y))
        return Solutions(df, {k: found.kinds[k] for k in (*keys, y)})

    def pairs(self, rule: Rule) -> Relation | None:
        """Pairs of rows of tables that agree in some values, by their keys: None for rules of another shape. The pairs of one
        value are dealt over many tasks, and are distinct as they are met: only those of subjects that have several rows
        are compared with each other."""
        atoms = [c for c in rule.body if isinstance(c, Atom)]
        filters = rule.body[len(atoms) :]
        if len(rule.head) != 1 or self.store.graph is not None or not all(isinstance(c, Filter) for c in filters):
            return None
        h = rule.head[0]
        if not (isinstance(h.p, str) and isinstance(h.s, Var) and isinstance(h.o, Var)) or h.s == h.o or not all(isinstance(a.p, str) for a in atoms):
            return None
        stars = [[a for a in atoms if a.s == x] for x in (h.s, h.o)]
        tables = [{c and c.table for c in (self.store.table_atom(a.p) for a in star)} for star in stars]
        if len(stars[0]) + len(stars[1]) != len(atoms) or any(len(t) != 1 or None in t for t in tables):
            return None
        a, b = map(self.star, stars)
        shared = [k for k in a.kinds if k in b.kinds]
        if not shared or {h.s.name, h.o.name} & set(shared) or any(a.kinds[k] != b.kinds[k] for k in shared) or any(is_volatile(c.expr) for c in filters):
            return None

        def rows(side: Solutions, subject: str) -> DataFrame:
            return side.df.distinct().withColumn("__several", F.count(F.lit(1)).over(Window.partitionBy(f"`{subject}`")) > 1)

        left = rows(a, h.s.name).withColumn("__share", F.pmod(F.xxhash64(F.col(f"`{h.s.name}`")), F.lit(SHARES)).cast("int"))
        right = rows(b, h.o.name).withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        parts = max(2 * SHARES, int(self.store.spark.conf.get("spark.sql.shuffle.partitions")))
        kinds = {**a.kinds, **b.kinds}

        def met(x: DataFrame, y: DataFrame) -> DataFrame:
            keys = [*shared, "__share"]
            x, y = (df.drop("__several").repartition(parts, *[F.col(f"`{k}`") for k in keys]) for df in (x, y))
            found = Solutions(x.hint("merge").join(y, keys), kinds)
            for c in filters:
                staged, expr, env = self._staged(found.df, c.expr, found.env())
                found = Solutions(staged.where(as_bool(compile_expression(expr, env, self.ctx))), kinds)
            return found.df.select(F.col(f"`{h.s.name}`").alias("s"), F.col(f"`{h.o.name}`").alias("o")).where("s is not null and o is not null")

        once, several = ~F.col("__several"), F.col("__several")
        rest = met(left.where(several), right).union(met(left.where(once), right.where(several))).distinct()
        return Relation(met(left.where(once), right.where(once)).union(rest), kinds[h.s.name], kinds[h.o.name], True)

    def _staged(self, df: DataFrame, e: tuple, env: dict[str, V]) -> tuple[DataFrame, tuple, dict[str, V]]:
        """Arithmetic inside arithmetic over terms, and calls inside calls that give terms, become columns of their own, so
        that plans grow with the text of an expression and not with its depth."""
        env = dict(env)

        def walk(e: object, inner: bool) -> object:
            nonlocal df
            if not isinstance(e, tuple) or e[0] in ("var", "term"):
                return e
            lead = 2 if e[0] == "call" else 1
            sums = e[0] in ("+", "-", "*")
            called = e[0] == "call" and e[1] in FUNCTIONS
            e = (*e[:lead], *[walk(x, sums or called) for x in e[lead:]])
            if inner and (sums or called and e[1] not in VOLATILE) and (v := compile_expression(e, env, self.ctx)).kind == "term":
                name = f"__e{len(env)}"
                df = _once(df, name, F.array(v.col))
                env[name] = V("term", F.col(name))
                return ("var", name)
            return e

        expr = walk(e, False)
        return df, expr, env

    def _same_row(self, c, first: Atom, table: str) -> bool:
        if not isinstance(c, Atom) or c.s != first.s or not isinstance(c.p, str):
            return False
        column = self.store.table_atom(c.p)
        return column is not None and column.table == table

    def _frame(self, s: Solutions) -> DataFrame:
        return self.store.spark.range(1).select(F.lit(1).alias("__one")) if s.df is None else s.df

    def negation(self, out: Solutions, c: Not) -> Solutions:
        """Anti-join on what is bound so far; filters inside may look at both sides."""
        atoms = [x for x in c.body if not isinstance(x, Filter)]
        inner = self.nearest(self.body(atoms), out, [x for x in c.body if isinstance(x, Filter)], set())
        df = self._frame(out)
        names = {k: f"__n_{k}" for k in inner.kinds}
        right = self._frame(inner).select(*[F.col(f"`{k}`").alias(n) for k, n in names.items()] or [F.lit(1).alias("__n")])
        env = {k: V(kind, F.col(f"`{names[k]}`")) for k, kind in inner.kinds.items()} | out.env()
        conditions = []
        for k, n in names.items():
            if k in out.kinds:
                a, b = out.env()[k], V(inner.kinds[k], F.col(f"`{n}`"))
                conditions.append(a.col == b.col if a.kind == b.kind else as_term(a) == as_term(b))
        conditions += [F.coalesce(as_bool(compile_expression(x.expr, env, self.ctx)), F.lit(False)) for x in c.body if isinstance(x, Filter)]
        if not conditions:  # all or nothing: one row decides
            right = right.limit(1)
        on = F.lit(True)
        for x in conditions:
            on = on & x
        return Solutions(df.join(right, on, "left_anti"), out.kinds)

    def solutions(self, body) -> DataFrame:
        """Distinct bindings of the named variables, in the order of their names."""
        found = self.body(body)
        shown = sorted(k for k in found.kinds if not k.startswith("__b"))
        return self._frame(found).select(*[F.col(f"`{k}`") for k in shown] or [F.lit(True).alias("found")]).distinct()

    def head(self, atoms: list[Atom], found: Solutions, rule: int, as_terms: bool) -> list[tuple[str | None, Relation | DataFrame]]:
        """(predicate, relation) of each head atom; (None, triples) for variable predicates or if as_terms."""
        env, df = found.env(), self._frame(found)

        def seed() -> Column:
            return F.concat_ws("\x1f", F.lit(str(rule)), *[as_term(env[k]) for k in sorted(env) if not k.startswith("__b")])

        def value(t: object) -> V:
            if isinstance(t, Var):
                return env[t.name]
            if isinstance(t, Nested):
                return FUNCTIONS["TRIPLE"](*[V("term", as_term(value(x))) for x in (t.s, t.p, t.o)])
            if t.startswith("_:"):
                return V("term", F.concat(F.lit("_:sk_"), F.md5(F.concat_ws("\x1f", seed(), F.lit(t)))))
            return V("term", F.lit(t)) if as_terms else constant(t)

        out = []
        if as_terms and len(atoms) > 1:  # one pass over the bindings for all atoms
            rows = F.array(*[F.struct(*[as_term(value(t)).alias(n) for t, n in ((a.s, "s"), (a.p, "p"), (a.o, "o"))]) for a in atoms])
            triples = df.select(F.explode(rows).alias("t")).select("t.*")
            return [(None, triples.where("s is not null and o is not null and p like '<%' and p not like '<<(%'"))]
        for a in atoms:
            s, o = value(a.s), value(a.o)
            if as_terms or not isinstance(a.p, str):
                triples = df.select(as_term(s).alias("s"), as_term(value(a.p)).alias("p"), as_term(o).alias("o"))
                out.append((None, triples.where("s is not null and o is not null and p like '<%' and p not like '<<(%'")))
            else:
                out.append((a.p, Relation(df.select(s.col.alias("s"), o.col.alias("o")).where("s is not null and o is not null"), s.kind, o.kind)))
        return out
