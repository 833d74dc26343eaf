"""Comparing graphs: difference, and isomorphism (equal but for the labels of blank nodes)."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule import terms as T

#: Triples with blank nodes that the search of ``isomorphic`` holds on the driver, of each graph; more is an error.
MOST_BLANK = 200_000
_BLANK = re.compile(r"_:[^ ]+")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, s, p, o): triples of one graph only; side says which, "a" or "b"."""
    key = ["s", "p", "o"]
    only = lambda x, y, side: x.select(*key).distinct().join(y.select(*key).distinct(), key, "left_anti").select(F.lit(side).alias("side"), *key)
    return only(a, b, "a").union(only(b, a, "b"))


def _blanks(term: str) -> list[str]:
    if term.startswith("_:"):
        return [term]
    return [x for part in T.parts(term) for x in _blanks(part)] if term.startswith("<<(") else []


def _named(term: str, names: dict[str, str]) -> str:
    if term.startswith("_:"):
        return names.get(term, term)
    return T.triple_term(*[_named(x, names) for x in T.parts(term)]) if term.startswith("<<(") else term


def _coloured(triples: list[tuple], fixed: dict[str, str]) -> dict[str, str]:
    """A colour for each blank node from what it stands with, refined until no class splits."""
    at = defaultdict(list)
    for t in triples:
        for b in {x for term in t for x in _blanks(term)}:
            at[b].append(t)
    colour = {b: fixed.get(b, "") for b in at}
    while True:
        new = {}
        for b, ts in at.items():
            seen = sorted(" ".join(_named(x, colour | {b: "self"}) for x in t) for t in ts)
            new[b] = hashlib.blake2b("\n".join([colour[b], *seen]).encode(), digest_size=16).hexdigest()
        if len(set(new.values())) == len(set(colour.values())):
            return new
        colour = new


def _same(a: list[tuple], b: list[tuple]) -> bool:
    """Search with an explicit stack: colours first; of the smallest ambiguous class one node is fixed on each side."""
    todo: list[tuple[dict, dict]] = [({}, {})]
    while todo:
        fa, fb = todo.pop()
        ca, cb = _coloured(a, fa), _coloured(b, fb)
        if Counter(ca.values()) != Counter(cb.values()):
            continue
        classes = Counter(ca.values())
        open_ = [c for c, n in classes.items() if n > 1]
        if not open_:
            if {tuple(_named(x, ca) for x in t) for t in a} == {tuple(_named(x, cb) for x in t) for t in b}:
                return True
            continue
        c = min(open_, key=lambda c: (classes[c], c))
        one = min(x for x, k in ca.items() if k == c)
        mark = f"fixed {len(fa)}"
        todo += [(fa | {one: mark}, fb | {x: mark}) for x, k in cb.items() if k == c]
    return False


def isomorphic(a: DataFrame, b: DataFrame) -> bool:
    """Ground triples are compared by joins; only triples with blank nodes come to the driver."""
    key = ["s", "p", "o"]
    blank = F.col("s").contains("_:") | F.col("o").contains("_:")
    sides = []
    for x in (a, b):
        rows = [tuple(r) for r in x.select(*key).distinct().where(blank).limit(MOST_BLANK + 1).collect()]
        if len(rows) > MOST_BLANK:
            raise ValueError(f"more than {MOST_BLANK} triples with blank nodes")
        sides.append([t for t in rows if any(_blanks(x) for x in t)])
    if len(sides[0]) != len(sides[1]):
        return False
    spark = a.sparkSession
    ground = [x.select(*key).distinct().join(F.broadcast(spark.createDataFrame(t or [("", "", "")], "s string, p string, o string")), key, "left_anti") for x, t in zip((a, b), sides, strict=True)]
    return difference(*ground).isEmpty() and _same(*sides)
