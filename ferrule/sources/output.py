"""Results as text: bindings and JSON. For results that a person reads, so they come to the driver."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule import terms as T


def format_bindings(rows: DataFrame, prefixes: dict[str, str]) -> list[str]:
    """A sorted line a solution; ``true`` where no variable is asked for."""
    names = sorted(rows.columns)
    return sorted("; ".join(f"?{n} = {'UNDEF' if r[n] is None else T.show(str(r[n]), prefixes)}" for n in names) or "true" for r in rows.collect())


def write_json(triples: DataFrame, path: str) -> None:
    """JSON lines, one object a triple, written by the executors: for results of any size."""

    def of(frames):
        for pdf in frames:
            yield pd.DataFrame({"value": [json.dumps(dict(zip("spo", map(term_json, t), strict=True)), ensure_ascii=False) for t in zip(pdf["s"], pdf["p"], pdf["o"], strict=True)]})

    triples.select("s", "p", "o").mapInPandas(of, "value string").write.text(path)


def write_lines(triples: DataFrame, path: str, prefixes: dict[str, str]) -> None:
    """Compact lines in order, written by the executors: the sorted files follow one another."""

    def of(frames):
        for pdf in frames:
            yield pd.DataFrame({"value": [f"{T.show(s, prefixes)} {'a' if p == T.TYPE else T.show(p, prefixes)} {T.show(o, prefixes)} ." for s, p, o in zip(pdf["s"], pdf["p"], pdf["o"], strict=True)]})

    triples.select("s", "p", "o").mapInPandas(of, "value string").orderBy(F.col("value")).write.text(path)


def term_json(term: str) -> dict:
    """A canonical term as an object with type, value, datatype, lang and direction."""
    if term.startswith("<<("):
        return {"type": "triple", **dict(zip("spo", map(term_json, T.parts(term)), strict=True))}
    if term.startswith("<"):
        return {"type": "iri", "value": term[1:-1]}
    if term.startswith("_:"):
        return {"type": "blank", "value": term[2:]}
    text, datatype, lang = re.fullmatch(r'"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@(.*))?', term, re.DOTALL).groups()
    value: object = re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)
    if datatype == T.BOOLEAN:
        value = value == "true"
    elif datatype == T.INTEGER and re.fullmatch(r"-?\d+", value):
        value = int(value) if abs(int(value)) <= 2**53 else value  # longer ones stay text
    elif datatype in (T.DECIMAL, T.DOUBLE):
        number = float(value) if re.fullmatch(r"-?\d+(\.\d+)?(e[+-]\d+)?", value) else None
        value = number if number is None or number != int(number) else int(number)
    language, _, direction = (lang or "").partition("--")
    return {"type": "literal", "value": value, "datatype": datatype, "lang": language or None, "langDir": direction or None}


def to_json(triples: DataFrame, prefixes: dict[str, str], base: str = "", iterations: int = 0, diagnostics: list | None = None, query: DataFrame | None = None, trace: list | None = None, analysis: dict | None = None) -> str:
    rows = sorted(tuple(r) for r in triples.select("s", "p", "o").collect())
    out = {
        "baseIRI": base or None,
        "iterations": iterations,
        "prefixes": prefixes,
        "diagnostics": [{"severity": d.severity, "code": d.code, "message": d.message} for d in diagnostics or []],
        "triples": [dict(zip("spo", map(term_json, r), strict=True)) for r in rows],
    }
    if trace is not None:
        out["trace"] = [{"rule": r, "iteration": k, "predicate": p, "added": n} for r, k, p, n in trace]
    if analysis is not None:
        out["analysis"] = analysis
    if query is not None:
        names = sorted(query.columns)
        out["query"] = {"select": names, "bindings": [{n: term_json(str(r[n])) for n in names if r[n] is not None} for r in query.collect()]}
    return json.dumps(out, ensure_ascii=False, indent=2)
