"""Integers beyond the range of doubles, as decimal text: exact in DECIMAL(38) expressions, and by a pandas UDF beyond.

The expressions are flat on purpose: Catalyst asks nested ones for their types again and again.
"""

from __future__ import annotations

import operator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_DECIMAL = "decimal(38,0)"
_NATIVE = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}
_PYTHON = {"+": operator.add, "-": operator.sub, "*": operator.mul}


def of_decimals(op: str, a: Column, b: Column) -> Column:
    """Text of the result, null if it has more than 38 digits."""
    return _NATIVE[op](a.try_cast(_DECIMAL), b.try_cast(_DECIMAL)).try_cast(_DECIMAL).cast("string")


def of_any_length(op: str, a: Column, b: Column) -> Column:
    """The same for any number of digits."""
    fn = _PYTHON[op]

    def exact(x: pd.Series, y: pd.Series) -> pd.Series:
        import sys

        sys.set_int_max_str_digits(0)
        return pd.Series([None if u is None or v is None else str(fn(int(u), int(v))) for u, v in zip(x, y, strict=True)], dtype=object)

    return F.pandas_udf(exact, "string")(a, b)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for two canonical decimal texts."""
    x, y = a.startswith("-"), b.startswith("-")
    size = F.when(F.length(a) != F.length(b), F.signum(F.length(a) - F.length(b))).when(a == b, 0.0).when(a < b, -1.0).otherwise(1.0)
    return F.when(x & ~y, -1.0).when(~x & y, 1.0).when(x, -size).otherwise(size).cast("int")
