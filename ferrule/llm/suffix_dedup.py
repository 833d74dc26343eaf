"""Suffix-array dedup: bytes covered by a long string (400 bytes) that starts anywhere else too.

The suffixes are sorted by column-wise construction over many strings at once: each round inserts one
symbol before every string, which re-sorts all of them by one stable pass over the symbols (the
new column of the Burrows-Wheeler transform) and updates the common prefixes of neighbours. Neighbours
with a common prefix of the wanted length are repeats.

Over whole documents that takes as many rounds, and passes over all files, as the longest document
has bytes. So the collection is cut first: of each window of the wanted length the k-gram with the
smallest hash is its seed, the same in every copy of the window. The windows of one seed are a short segment
around it; equal windows meet in the files of one seed, lined up at it, and segments of at most
twice the window length are sorted in as many rounds. Segments that are equal as a whole are counted
instead of sorted. Seeds with very many different segments are cut further: by halves of the window
range, with all bytes that the windows of a half share as the new seed, so no task gets an unbounded group.

Definitions for odd input: a null text is empty; equal texts have equal results (all of the text if it
is long enough); repeated rows are copies; rows without doc_id count like others; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ferrule.llm.common import arrow_map, drop_path, mix, prefix_sums, range_hash, stored, table, text_chunks

LENGTH = 400
GRAM = 32
#: Different segments of a seed that one task sorts; seeds with more are cut further.
GROUP = 8192
#: Classes of texts up to which those to open are picked by a broadcast of their keys (32 bytes each).
OPENED = 200_000
_AT = 28  # bits of the position in a window's smallest key


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _keys() -> dict[str, Column]:
    return {"t1": F.xxhash64(_text()), "t2": F.xxhash64(F.lit(1), _text())}


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def seeds_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of a chunk of texts, for each seed: document, place, first and last start of its windows (all
    relative to the document), hash of the gram and hash of the segment."""
    sums = prefix_sums(data)
    if len(data) < length:
        return tuple(np.zeros(0, k) for k in [np.int64] * 4 + [np.uint64] * 2)
    at = np.arange(len(data) - gram + 1)
    grams = range_hash(sums, at, at + gram)
    smallest = window_minima((grams >> np.uint64(_AT) << np.uint64(_AT)) | at.astype(np.uint64), length - gram + 1)
    place = (smallest & np.uint64((1 << _AT) - 1)).astype(np.int64)
    docs = np.searchsorted(offsets, np.arange(len(place)), "right") - 1
    valid = np.flatnonzero(np.arange(len(place)) + length <= offsets[docs + 1])
    docs, place = docs[valid], place[valid]
    new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (docs[1:] != docs[:-1])) if len(place) else np.zeros(0, bool))
    last = np.append(new[1:], len(place)) - 1
    doc, seed, a, b = docs[new], place[new], valid[new], valid[last]
    segment = mix(range_hash(sums, a, b + length) + (seed - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    base = offsets[doc]
    return doc, seed - base, a - base, b - base, grams[seed], segment


SEED = "t1 long, t2 long, m int, a int, b int, lo int, hi int, key long, segment long"
#: Bytes of a text whose windows are hashed at once: bounds the memory that a long text takes.
BLOCK = 8 << 20


def merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans as maximal runs (touching ones are one), by owner and start."""
    order = np.lexsort((end, start, owner))
    owner, start, end = owner[order], start[order], end[order]
    far = np.maximum.accumulate(end + (owner << 33))  # ends of later owners are above all before
    new = np.append(True, (owner[1:] != owner[:-1]) | (start[1:] + (owner[1:] << 33) > far[:-1])) if len(owner) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return owner[at], start[at], np.maximum.reduceat(end, at) if len(at) else end


def seeds(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """The seeds of all texts. Texts and segments that a batch has several times leave it once: the repeats of a
    segment are known there, and are rows without key, with a repeated run in a and b."""

    def blocks(column: pa.Array):
        for x, _, data, offsets in text_chunks(column, 1 << 20):
            for at in range(0, max(len(data) - length + 1, 1), BLOCK) if len(offsets) == 2 else (0,):
                part = data[at : at + BLOCK + length - 1] if len(offsets) == 2 else data
                doc, m, a, b, key, segment = seeds_of(part, np.array([0, len(part)]) if len(offsets) == 2 else offsets, length, gram)
                yield doc + x, m + at, a + at, b + at, key, segment

    def of(batch: pa.RecordBatch):
        ids = np.stack([batch.column(k).to_numpy() for k in (0, 1)], 1)
        batch = batch.take(pa.array(np.sort(np.unique(ids, axis=0, return_index=True)[1])))
        doc, m, a, b, key, segment = (np.concatenate(v) for v in zip(*blocks(batch.column(2)), strict=True)) if batch.num_rows else [np.zeros(0, k) for k in [np.int64] * 4 + [np.uint64] * 2]
        key, segment = key.view(np.int64), segment.view(np.int64)
        order = np.lexsort((segment, key))
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = (key[order[1:]] == key[order[:-1]]) & (segment[order[1:]] == segment[order[:-1]])
        again = order[same[1:] | same[:-1]]
        owner, start, end = merged(doc[again], a[again], b[again] + length)
        one = np.sort(order[~same[:-1]])
        take = pa.array(np.concatenate([doc[one], owner]))
        pad = np.zeros(len(owner), np.int64)
        ints = [np.concatenate(v) for v in ((m[one], pad), (a[one], start), (b[one], end), (one * 0, pad), (one * 0 + length - gram, pad))]
        known = np.arange(len(take)) >= len(one)
        longs = [pa.array(np.concatenate([v[one], pad]), mask=known) for v in (key, segment)]
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in (0, 1)), *[pa.array(v.astype(np.int32)) for v in ints], *longs], names=["t1", "t2", "m", "a", "b", "lo", "hi", "key", "segment"])

    return arrow_map(docs.select(*[c.alias(k) for k, c in _keys().items()], _text().alias("text")), of, SEED)


def sort_columns(symbols: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which windows of ``length`` stand elsewhere too: [string, column]. symbols: strings in rows, lined
    up, -1 outside; strings of different groups are not compared. Columns are inserted from the last on."""
    n, columns = symbols.shape
    out = np.zeros((n, columns), bool)
    order = np.argsort(group, kind="stable")
    common = np.zeros(n + 1, np.int32)  # with the neighbour before, in the present order
    keys = group.astype(np.int64) * 257
    for j in range(columns - 1, -1, -1):
        new = symbols[order, j]
        key = keys[order] + new + 1
        by = np.argsort(key, kind="stable")
        same = np.zeros(n, bool)
        same[1:] = (key[by[1:]] == key[by[:-1]]) & (new[by[1:]] >= 0)
        at = np.flatnonzero(same)
        first, end = by[at - 1] + 1, by[at]
        value = common[end].copy()
        wide = np.flatnonzero(first < end)
        if len(wide):
            wide = wide[np.argsort(first[wide], kind="stable")]
            value[wide] = np.minimum.reduceat(common, np.stack([first[wide], end[wide] + 1], 1).ravel())[::2]
        order = order[by]
        common[:] = 0
        common[at] = value + 1
        hit = at[value + 1 >= length]
        out[order[hit], j] = True
        out[order[hit - 1], j] = True
    return out


def group_spans(members: pd.DataFrame, length: int, gram: int) -> pd.DataFrame:
    """Repeated spans (t1, t2, s, e) among segments, compared inside equal keys."""
    members = members.drop_duplicates(["key", "t1", "t2", "m", "a"]).reset_index(drop=True)
    left = length - gram
    symbols = np.full((len(members), left + length), -1, np.int16)
    a, m = (members[k].to_numpy(np.int64) for k in ("a", "m"))
    for i, segment in enumerate(members["bytes"]):
        begin = left - m[i] + a[i]
        symbols[i, begin : begin + len(segment)] = np.frombuffer(segment, np.uint8)
    group = members.groupby("key", sort=False).ngroup().to_numpy()
    repeated = sort_columns(symbols, group, length)
    edge = np.diff(np.pad(repeated, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    _, stop = np.nonzero(edge == -1)
    shift = m[row] - left
    return pd.DataFrame({"t1": members["t1"].to_numpy()[row], "t2": members["t2"].to_numpy()[row], "s": (start + shift).astype(np.int32), "e": (stop - 1 + length + shift).astype(np.int32)})


def opened(docs: DataFrame, first: DataFrame, rows: DataFrame, schema: str, fn) -> DataFrame:
    """fn(key columns, seeds of a text, bytes of the text) -> pandas frame, for one text of each class that has seeds in rows."""
    at = rows.groupBy("t1", "t2").agg(F.collect_list(F.struct("m", "a", "b", "lo", "hi", "key")).alias("seeds"))
    wanted = at.join(first.withColumnRenamed("doc_id", "__first"), ["t1", "t2"])
    texts = docs.select("doc_id", _text().alias("text")).withColumns(_keys())
    ids = wanted.select("t1", "t2").distinct()
    if ids.limit(OPENED + 1).count() <= OPENED:  # else texts are shuffled without this filter
        texts = texts.join(F.broadcast(ids), ["t1", "t2"], "left_semi")

    def of(frames):
        for pdf in frames:
            found = [fn(t1, t2, s, text.encode()) for t1, t2, text, s in zip(pdf["t1"], pdf["t2"], pdf["text"], pdf["seeds"], strict=True)]
            for k in range(0, len(found), 64):
                yield pd.concat(found[k : k + 64])

    return texts.join(wanted, ["t1", "t2"]).where(F.col("doc_id").eqNullSafe(F.col("__first"))).select("t1", "t2", "text", "seeds").mapInPandas(of, schema)


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(t1, t2, spans): for each class of equal texts, the repeated bytes as maximal runs (s, e)."""
    spark = docs.sparkSession
    classes, _ = stored(docs.select("doc_id", *[c.alias(k) for k, c in _keys().items()], F.octet_length(_text()).alias("n")).groupBy("t1", "t2", "n").agg(F.count("*").alias("many"), F.min("doc_id").alias("doc_id")), "classes")
    found = [classes.where((F.col("many") > 1) & (F.col("n") >= length)).select("t1", "t2", F.lit(0).alias("s"), F.col("n").cast("int").alias("e"))]

    def keep(spans: DataFrame) -> None:
        found.append(stored(spans, "spans")[0])

    every, every_path = stored(seeds(docs, length, gram), "seeds")
    keep(every.where("key is null").select("t1", "t2", F.col("a").alias("s"), F.col("b").alias("e")))
    # keys that only one segment has can't be repeats: they are found by the key alone, before rows move
    shared = every.where("key is not null").groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    rows, rows_path = stored(every.where("key is not null").join(shared, "key", "left_semi"), "seeds")
    drop_path(spark, every_path)

    def segments(t1, t2, s, text: bytes) -> pd.DataFrame:
        return pd.DataFrame([(t1, t2, x["m"], x["a"], x["b"], x["lo"], x["hi"], x["key"], text[x["a"] : x["b"] + length]) for x in s], columns=["t1", "t2", "m", "a", "b", "lo", "hi", "key", "bytes"])

    def halves(t1, t2, s, text: bytes) -> pd.DataFrame:
        out = []
        for x in s:
            mid = (x["lo"] + x["hi"]) // 2
            for lo, hi in ((x["lo"], mid), (mid + 1, x["hi"])):
                a, b = max(x["a"], x["m"] - hi), min(x["b"], x["m"] - lo)
                if a <= b and lo <= hi:
                    shared = hashlib.blake2b(text[x["m"] - lo : x["m"] - hi + length] + lo.to_bytes(4, "little") + hi.to_bytes(4, "little"), digest_size=8).digest()
                    whole = hashlib.blake2b(text[a : b + length] + (x["m"] - a).to_bytes(4, "little"), digest_size=8).digest()
                    out.append((t1, t2, x["m"], a, b, lo, hi, *(int.from_bytes(h, "little", signed=True) for h in (shared, whole))))
        return pd.DataFrame(out, columns=["t1", "t2", "m", "a", "b", "lo", "hi", "key", "segment"])

    def sort_groups(frames):
        held = None
        for pdf in frames:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if len(held) < group:
                continue
            open_ = held["key"] == held["key"].iloc[-1]
            if not open_.all():
                yield group_spans(held[~open_], length, gram)
                held = held[open_].reset_index(drop=True)
        if held is not None and len(held):
            yield group_spans(held, length, gram)

    while True:
        # equal segments are repeats as a whole; one of each goes on
        same, same_path = stored(rows.groupBy("key", "segment").agg(F.count("*").alias("many"), F.min(F.struct("t1", "t2", "m", "a", "b", "lo", "hi")).alias("one")), "segments")
        again = same.where("many > 1").select("key", "segment")
        keep(rows.join(again, ["key", "segment"], "left_semi").select("t1", "t2", F.col("a").alias("s"), (F.col("b") + length).alias("e")))
        sizes, sizes_path = stored(same.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1"), "sizes")
        members = same.join(sizes, "key").select("key", "kinds", "one.*")
        usual = opened(docs, classes.select("t1", "t2", "doc_id"), members.where(F.col("kinds") <= group), SEED.replace("segment long", "bytes binary"), segments)
        keep(usual.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key").mapInPandas(sort_groups, "t1 long, t2 long, s int, e int"))
        large = members.where(F.col("kinds") > group)
        more = not sizes.where(F.col("kinds") > group).isEmpty()
        # a half of one kind of segment stands for all members with that segment
        fresh = stored(opened(docs, classes.select("t1", "t2", "doc_id"), large, SEED, halves), "seeds") if more else None
        drop_path(spark, rows_path, same_path, sizes_path)
        if fresh is None:
            break
        rows, rows_path = fresh
    every = found[0]
    for x in found[1:]:
        every = every.union(x)
    return runs(every)


def runs(spans: DataFrame) -> DataFrame:
    """(t1, t2, spans): the spans (t1, t2, s, e) of a text as maximal runs; one shuffle, then sorted streams."""
    inside = W.partitionBy("t1", "t2").orderBy("s", "e")
    before = F.max("e").over(inside.rowsBetween(W.unboundedPreceding, -1))
    opens = spans.distinct().withColumn("opens", F.coalesce(F.col("s") > before, F.lit(True)).cast("int"))
    numbered = opens.withColumn("run", F.sum("opens").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    each = numbered.groupBy("t1", "t2", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return each.groupBy("t1", "t2").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))


def cleaned(text: bytes, spans) -> tuple[bytes, int, int]:
    """What is left, bytes removed, maximal runs removed."""
    kept, end, runs, removed = [], 0, 0, 0
    last = -1
    for s, e in spans:
        if s > last:
            kept.append(text[end:s])
            runs += 1
            removed += e - s
            last = end = e
        elif e > last:
            removed += e - last
            last = end = e
    kept.append(text[end:])
    return b"".join(kept), removed, runs


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of each row of docs."""
    marks, _ = stored(repeats(docs, length, gram, group), "marks")
    rows = docs.select("doc_id", _text().alias("text")).withColumns(_keys()).join(marks, ["t1", "t2"], "left").select("doc_id", "text", "spans")

    def of(batch: pa.RecordBatch):
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            out = []
            for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                data = text.encode()
                kept, removed, runs = cleaned(data, [(x["s"], x["e"]) for x in spans or ()])
                out.append((len(data), removed, runs, kept))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return arrow_map(rows, of, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept binary")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The same from all windows: hexadecimal text, cut into blocks so that a window is a short way from its start.
OP10_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
e AS (SELECT r, o, least(1024, n - 399 - o) AS m, substring(h, 2 * o + 1, 2846) AS h FROM (SELECT r, h, n, unnest(range(0, n - 399, 1024)) AS o FROM d WHERE n >= 400)),
w AS (SELECT r, o + j AS i, md5_number(substring(h, 2 * j + 1, 800)) AS k FROM (SELECT r, o, h, unnest(range(0, m)) AS j FROM e)),
c AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
p AS (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 400, true) AS opens FROM w SEMI JOIN c USING (k)),
q AS (SELECT r, i, sum(CAST(opens AS INT)) OVER (PARTITION BY r ORDER BY i) AS g FROM p),
s AS (SELECT r, g, min(i) AS a, max(i) + 400 AS b FROM q GROUP BY r, g),
g AS (SELECT s.r, s.a AS pos, substring(h, 2 * coalesce(lag(b) OVER (PARTITION BY s.r ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY s.r ORDER BY a), 0))) AS piece FROM s JOIN d ON d.r = s.r
      UNION ALL SELECT d.r, d.n, substring(h, 2 * coalesce(e, 0) + 1) FROM d LEFT JOIN (SELECT r, max(b) AS e FROM s GROUP BY r) USING (r)),
k AS (SELECT r, sha256(unhex(string_agg(piece, '' ORDER BY pos))) AS kept_sha256 FROM g GROUP BY r),
t AS (SELECT r, sum(b - a) AS removed, count(*) AS runs FROM s GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_spans, kept_sha256 FROM d JOIN k USING (r) LEFT JOIN t USING (r)
"""
