"""Readers and writers of graph files, as DataFrames of canonical terms."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule import terms as T
from ferrule.lang.parser import parse_graph

TRIPLE = "s string, p string, o string"


def from_triples(spark: SparkSession, triples: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(dict.fromkeys(triples)), TRIPLE)


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples and N-Quads, in parallel by line; graph names are dropped. A malformed line fails the job."""

    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for line in pdf["value"]:
                text = line.strip()
                if text and not text.startswith("#"):
                    rows += parse_line(text)
            yield pd.DataFrame(rows, columns=["s", "p", "o"])

    return spark.read.text(path).mapInPandas(lines, TRIPLE).distinct()


def parse_line(text: str) -> list[tuple[str, str, str]]:
    from ferrule.lang.parser import ParseError, Parser

    p = Parser(text)
    nodes = []
    while not p.match("."):
        if p.kind not in ("iri", "blank", "string") and p.text != "<<(":
            raise ParseError(f"not an N-Triples line: {text[:80]}")
        nodes.append(p.term("data"))
    if len(nodes) not in (3, 4) or p.kind != "end":
        raise ParseError(f"not an N-Triples line: {text[:80]}")
    return [tuple(nodes[:3])]


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """Turtle and TriG files: one file a row, blank nodes kept apart by file."""

    def files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, text in zip(pdf["name"], pdf["value"], strict=True):
                scope = f"f{zlib.crc32(name.encode()):08x}_"
                yield pd.DataFrame(parse_graph(text, scope=scope)[0], columns=["s", "p", "o"])

    rows = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("name"))
    return rows.mapInPandas(files, TRIPLE).distinct()


def format_triples(triples: DataFrame, prefixes: dict[str, str]) -> list[str]:
    """Sorted lines with prefixes, for results that a person reads."""
    return sorted(f"{T.show(s, prefixes)} {'a' if p == T.TYPE else T.show(p, prefixes)} {T.show(o, prefixes)} ." for s, p, o in triples.select("s", "p", "o").collect())


def write_nquads(triples: DataFrame, path: str) -> None:
    """One line a triple; plain and xsd:string literals are written alike. Quotes and backslashes of canonical terms
    are escaped already; line ends are escaped here, so a line stays a line."""

    def line(c: Column) -> Column:
        for raw, escaped in (("\n", "\\n"), ("\r", "\\r")):
            c = F.replace(c, F.lit(raw), F.lit(escaped))
        return F.regexp_replace(c, rf'(?<=")\^\^<{T.STRING}>$', "")

    triples.select(F.concat_ws(" ", line(F.col("s")), "p", line(F.col("o")), F.lit(".")).alias("value")).distinct().write.text(path)
