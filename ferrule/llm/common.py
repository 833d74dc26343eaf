"""Shared pieces of the training-data operators: tables, shared folders, text arrays.

Folders: everything an operator stores between stages goes to the folder named in
``spark.checkpoint.dir`` (shared by driver and executors). Only where that setting is
missing and Spark runs in this process alone, as in unit tests, a temporary folder is used.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: a word is a run of anything else.
SPACES = "[\\x20\\x09-\\x0D]+"
#: Rows up to which a side with narrow rows (a few dozen bytes) is broadcast after counting it.
BROADCAST_ROWS = 500_000

_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="llm-shared-"))
    return _own[0]


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs inside are removed when each ends: what they give is a file or a count."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREED) if before is None else spark.conf.set(_FREED, before)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet into the shared folder and read it again: cuts the lineage and
    survives lost executors. Returns the table and its path, for ``drop_path``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, *paths: str) -> None:
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has few enough rows; else unchanged, and the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def words_of(text: Column) -> Column:
    """Array of the words of a whole text (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also inside lambdas of body."""
    return F.transform(F.array(value), body)[0]


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow of a function from one record batch to an iterator of record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(run, schema)


def text_chunks(column: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of whole texts of about ``limit`` bytes."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes, modulo 2**64, for ``range_hash``."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data), BASE), out=out[1:])
    return out


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range, independent of where it stands."""
    back = _powers(len(sums), _INVERSE)
    return mix((sums[ends] - sums[starts]) * back[starts] ^ (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts in a chunk: document index, start, end and hash of each word, A-Z in lower case."""
    lower = np.where((data >= 65) & (data <= 90), data + 32, data)
    space = (lower == 32) | ((lower >= 9) & (lower <= 13))
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~space
    first = inside[1:-1] & ~inside[:-2]
    cut = offsets[1:-1]
    cut = cut[cut < len(data)]
    first[cut] = inside[1:-1][cut]  # a text begins a word of its own
    last = inside[1:-1] & ~inside[2:]
    last[cut[cut > 0] - 1] |= inside[1:-1][cut[cut > 0] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    docs = np.searchsorted(offsets, starts, "right") - 1
    return docs, starts, ends, range_hash(prefix_sums(lower), starts, ends)
