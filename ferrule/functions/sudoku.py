"""The SUDOKU function: a puzzle of 81 digits (0 or a dot for an open cell) to its solution, empty if there is none."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = [{9 * r + c for c in range(9)} for r in range(9)] + [{9 * r + c for r in range(9)} for c in range(9)] + [{9 * (b // 3 * 3 + i) + b % 3 * 3 + j for i in range(3) for j in range(3)} for b in range(9)]
_PEERS = [set().union(*[u for u in _UNITS if i in u]) - {i} for i in range(81)]


def solve(puzzle: str) -> str | None:
    """The solution; "" if there is none, None (an error) for a text that is no puzzle or repeats a digit."""
    text = puzzle.strip().replace(".", "0")
    if not re.fullmatch(r"[0-9]{81}", text) or any(text[i] != "0" and text[i] == text[p] for i in range(81) for p in _PEERS[i]):
        return None
    todo = [text]
    while todo:
        cells = todo.pop()
        best = None
        for i in range(81):
            if cells[i] == "0":
                fits = sorted(set("123456789") - {cells[p] for p in _PEERS[i]}, reverse=True)
                if best is None or len(fits) < len(best[1]):
                    best = (i, fits)
        if best is None:
            return cells
        todo += [cells[: best[0]] + d + cells[best[0] + 1 :] for d in best[1]]
    return ""


def sudoku(text: Column) -> Column:
    def solved(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else solve(x))

    return F.pandas_udf(solved, "string")(text)
