"""Closures of relations whose nodes have one successor each, as lists that double their reach a pass.

A pass of the general loop compares its rows with all that is known, so a deep tree costs the square of its depth. Where
each node has one successor, what it reaches is a list: a pass appends to each list that of its last node. Passes are
the logarithm of the depth, and rows of the closure are made once, when lists are unfolded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.lang.parser import Atom, Rule
from ferrule.sources.catalog import Relation, Store
from ferrule.terms import Var

#: Nodes of a list; longer chains are left to the general loop.
LONGEST = 4096
_WHOLE = ("tinyint", "smallint", "int", "bigint")


@dataclass(frozen=True)
class Chain:
    """``?x p ?z`` from ``?x p ?y . ?y step ?z``; flipped: from ``?x step ?y . ?y p ?z``. step None: p itself."""

    p: str
    step: str | None
    flipped: bool = False


def chain_of(rules: list[Rule]) -> Chain | None:
    """The shape of a layer's recursive rules, if they are one rule of two patterns one after the other."""
    if len(rules) != 1 or len(rules[0].head) != 1 or len(rules[0].body) != 2 or not all(isinstance(c, Atom) and isinstance(c.p, str) for c in rules[0].body):
        return None
    h = rules[0].head[0]
    if not isinstance(h.p, str) or not all(isinstance(t, Var) for a in (h, *rules[0].body) for t in (a.s, a.o)):
        return None
    for a, b in (rules[0].body, rules[0].body[::-1]):
        if a.o == b.s and (h.s, h.o) == (a.s, b.o) and len({a.s, a.o, b.o}) == 3 and h.p in (a.p, b.p):
            return Chain(h.p, None if a.p == b.p else b.p if a.p == h.p else a.p, a.p != h.p)
    return None


def _swapped(df: DataFrame) -> DataFrame:
    return df.select(F.col("o").alias("s"), F.col("s").alias("o"))


def lists(edges: DataFrame, written: Callable[[DataFrame], tuple[DataFrame, str]]) -> tuple[DataFrame | None, int]:
    """(x, l): what each subject of edges reaches, nearest first, and the number of passes. None if a subject has several
    successors or a chain is too long. edges: distinct, without null."""
    n, subjects = edges.agg(F.count(F.lit(1)), F.countDistinct("s")).first()
    if n != subjects:
        return None, 0
    known, reach, passes = edges.select(F.col("s").alias("x"), F.array("o").alias("l"), F.lit(True).alias("open")), 1, 0
    while True:
        if 2 * reach > LONGEST:
            return None, passes
        passes += 1
        more = known.select(F.col("x").alias("last"), F.col("l").alias("m"))
        growing = known.where("open").withColumn("last", F.element_at("l", -1)).join(more, "last", "left")
        both = F.when(F.col("m").isNull(), F.col("l")).otherwise(F.array_distinct(F.concat("l", "m")))
        # a list that has not doubled has come to an end, or round a cycle
        grown = growing.select("x", both.alias("l")).withColumn("open", F.size("l") == 2 * reach)
        known, _ = written(known.where("not open").union(grown))
        reach *= 2
        if known.where("open").isEmpty():
            return known.select("x", "l"), passes


def closed(store: Store, chain: Chain, written: Callable[[DataFrame], tuple[DataFrame, str]]) -> tuple[Relation, int] | None:
    """The relation p with its closure and the number of passes; None where the general loop has to do it."""
    if store.graph is not None or chain.p in store.predicates or chain.p not in store.derived:
        return None
    start = store.derived[chain.p]
    step = start if chain.step is None else store.scan(chain.step) if chain.step in store.predicates or chain.step in store.derived else None
    if step is None or len({start.s_kind, start.o_kind, step.s_kind, step.o_kind}) != 1:
        return None
    types = [t for r in (start, step) for _, t in r.df.dtypes]
    if not all(t in _WHOLE for t in types) and set(types) != {"string"}:
        return None
    to = "string" if types[0] == "string" else "bigint"

    def plain(r: Relation) -> DataFrame:
        return r.df.select(F.col("s").cast(to), F.col("o").cast(to)).where("s is not null and o is not null")

    first = written(plain(start) if start.once else plain(start).distinct())[0]
    edges = first if chain.step is None else written(plain(step) if step.once else plain(step).distinct())[0]
    passes = 0
    for flipped in (False, True) if chain.step is None else (chain.flipped,):
        found, n = lists(_swapped(edges) if flipped else edges, written)
        passes += n
        if found is None:
            continue
        if chain.step is None:
            rows = found.select(F.col("x").alias("s"), F.explode("l").alias("o"))
        else:
            met = (_swapped(first) if flipped else first).join(found.withColumnRenamed("x", "o"), "o", "left")
            all_ = F.when(F.col("l").isNull(), F.array("o")).otherwise(F.array_distinct(F.concat(F.array("o"), F.col("l"))))
            rows = met.select("s", F.explode(all_).alias("o"))
            many = _swapped(first) if flipped else first
            n, subjects = many.agg(F.count(F.lit(1)), F.countDistinct("s")).first()
            if n != subjects:
                rows = rows.distinct()
        if flipped:
            rows = _swapped(rows)
        old = dict(start.df.dtypes), dict(step.df.dtypes)
        wider = lambda a, b: a if a == "string" else max(a, b, key=_WHOLE.index)
        kept = old[0] if chain.step is None else {"s": wider(old[0]["s"], old[1]["s"]), "o": old[0]["o"]} if flipped else {"s": old[0]["s"], "o": wider(old[0]["o"], old[1]["o"])}
        return Relation(rows.select(*[F.col(c).cast(kept[c]).alias(c) for c in ("s", "o")]), start.s_kind, start.o_kind, True), passes
    return None
