"""Relations: what a predicate reads, over tables (typed columns) and graphs (canonical terms)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions.expressions import V, as_term, kind_of


#: Relations of the evaluation itself, which no pattern with a variable predicate sees.
INTERNAL = frozenset({"<urn:implies>"})


@dataclass(frozen=True)
class Relation:
    """Pairs (s, o) with the kinds of their columns."""

    df: DataFrame
    s_kind: str = "term"
    o_kind: str = "term"
    #: No row is there twice.
    once: bool = False

    def as_terms(self) -> Relation:
        return Relation(self.df.select(as_term(V(self.s_kind, F.col("s"))).alias("s"), as_term(V(self.o_kind, F.col("o"))).alias("o")))

    def union(self, other: Relation) -> Relation:
        if (self.s_kind, self.o_kind) != (other.s_kind, other.o_kind):
            a, b = self.as_terms(), other.as_terms()
            return Relation(a.df.union(b.df))
        return Relation(self.df.union(other.df), self.s_kind, self.o_kind)


@dataclass(frozen=True)
class TableColumn:
    """A predicate over a table: subject and object columns of one row."""

    table: str
    subject: Column
    object: Column


@dataclass
class Store:
    """Tables behind a predicate catalogue, a graph of triples, and derived relations."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    predicates: dict[str, TableColumn] = field(default_factory=dict)
    graph: DataFrame | None = None
    derived: dict[str, Relation] = field(default_factory=dict)

    def add_table(self, name: str, df: DataFrame, subject: Column | str, base: str = "urn:table#") -> Store:
        """One predicate a column: <base + column>, from the subject to the column's value."""
        self.tables[name] = df
        key = F.col(subject) if isinstance(subject, str) else subject
        for c in df.columns:
            self.predicates[f"<{base}{c}>"] = TableColumn(name, key, F.col(c))
        return self

    def table_atom(self, predicate: str) -> TableColumn | None:
        return None if predicate in self.derived else self.predicates.get(predicate)

    def scan(self, predicate: str) -> Relation:
        parts: list[Relation] = []
        if predicate in self.predicates:
            c = self.predicates[predicate]
            df = self.tables[c.table].select(c.subject.alias("s"), c.object.alias("o")).where("o is not null")
            parts.append(Relation(df, *(kind_of(t) for _, t in df.dtypes)))
        if predicate in self.derived:
            parts.append(self.derived[predicate])
        if self.graph is not None:
            parts.append(Relation(self.graph.where(F.col("p") == predicate).select("s", "o")))
        if not parts:
            return Relation(self.spark.createDataFrame([], "s string, o string"))
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def scan_all(self) -> DataFrame:
        """(s, p, o) of every predicate, as terms."""
        parts = [] if self.graph is None else [self.graph.select("s", "p", "o")]
        for p in {**self.predicates, **self.derived}:
            if p in INTERNAL:
                continue
            rel = self.derived[p] if p in self.derived and p not in self.predicates else self.scan(p)
            parts.append(rel.as_terms().df.select("s", F.lit(p).alias("p"), "o"))
        out = parts[0] if parts else self.spark.createDataFrame([], "s string, p string, o string")
        for x in parts[1:]:
            out = out.union(x)
        return out
