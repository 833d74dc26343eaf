"""Token-id files: Parquet with a list column of token ids, laid out for selective reads.

Each document's ids (with an end id) are a row: doc_id, n_tokens, where it starts in its file, and the
list. Ids are dictionary-encoded, the other columns delta-encoded (writer version 2), row groups and
pages are bounded and pages are indexed, so that metadata and single documents are read without the
rest. Spark's own writer and reader are used: any shared store works, and lost tasks are done again.

Texts are encoded word by word: the tokenizer never joins across a single space or line end that stands
between other characters, so words that were seen before come from a table of their ids.

Definitions for odd input: a null text is empty and has the end id only; rows of one doc_id follow
each other; rows without doc_id come first. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ferrule.llm.common import arrow_map, shared_dir, table

ROW_GROUP_BYTES = 32 << 20
PAGE_ROWS = 500
#: Pieces whose ids a task remembers; as many older ones are kept beside them.
SEEN_PIECES = 250_000
_MARKS = ".,;:!?*$%&#"
#: Texts with white space at an end, twice in a row, or of another kind than space and line end.
_ODD = r"\A[ \n]|[ \n]\z|[ \n]{2}|[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A word of letters and digits, and what comes before the marks at its end.
_STEM = r"\A[\t\n]?[\p{L}\p{N}]+\z"
_UNMARKED = r"\A[\t\n]?[\p{L}\p{N}]+"
#: Text of a chunk that is encoded at once.
CHUNK_BYTES = 4 << 20

OPTIONS = {
    "compression": "zstd", "parquet.compression.codec.zstd.level": "1", "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(ROW_GROUP_BYTES), "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#first": "false", "parquet.enable.dictionary#n_tokens": "false",
}


def _gather(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ids, whose sizes are given, in the order of codes, and where each ends."""
    length = sizes[codes]
    ends = np.cumsum(length)
    first = (np.cumsum(sizes) - sizes)[codes] - (ends - length)
    return ids[np.repeat(first, length) + np.arange(ends[-1] if len(ends) else 0)], ends


class Encoder:
    """Token ids of texts.

    A text is cut at single spaces and line ends between other characters, where the tokenizer never
    joins, and before marks at the end of a word of letters and digits. Keys of the words seen are
    words after a space as they are, words after a line end with it, first words with a tab before
    them, and marks with two."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.line_end = self._new(["\n"])[0]

    def _new(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str], before: str) -> list[bytes]:
        """Ids of many words after a space or nothing, by one call: line ends between them are tokens of their own."""
        if not words:
            return []
        texts = [before + ("\n" + before).join(words[i : i + 2000]) + "\n" for i in range(0, len(words), 2000)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        cut = np.flatnonzero(ids == np.frombuffer(self.line_end, "<u4")[0])
        if len(cut) != len(words):
            return self._new([before + w for w in words])
        data, ends = ids.tobytes(), (4 * cut).tolist()
        return [data[a:b] for a, b in zip([0, *(x + 4 for x in ends[:-1])], ends, strict=True)]

    def _learn(self, keys: list[str]) -> None:
        if len(self.seen) > SEEN_PIECES:
            self.seen, self.older = {}, self.seen
        odd = [k for k in keys if "<" in k or k in ("", "\t", "\n")]
        known = set(odd)
        spaced = [k for k in keys if k[:1] not in ("\t", "\n") and k not in known]
        bare = [k for k in keys if k[:1] in ("\t", "\n") and k not in known]
        self.seen.update(zip(spaced, self._joined(spaced, " "), strict=True))
        ids = self._joined([k.lstrip("\t\n") for k in bare], "") + self._new([k.lstrip("\t\n") if k[:1] in ("\t", "\n") else " " + k for k in odd])
        self.seen.update((k, self.line_end + v if k[:1] == "\n" else v) for k, v in zip(bare + odd, ids, strict=True))

    def _of_keys(self, keys: list[str]) -> list[bytes]:
        values = list(map(self.seen.get, keys))
        gaps = [i for i, v in enumerate(values) if v is None]
        missing = [keys[i] for i in gaps]
        older = list(map(self.older.get, missing))
        self._learn([k for k, v in zip(missing, older, strict=True) if v is None])
        self.seen.update((k, v) for k, v in zip(missing, older, strict=True) if v is not None)
        for i, v in zip(gaps, map(self.seen.__getitem__, missing), strict=True):
            values[i] = v
        return values

    def _regular(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts whose white space is single spaces and line ends, and where each text ends.

        Words are told apart by a dictionary of the whole chunk, and their stems and marks by another,
        so each is looked up once."""
        keyed = pc.binary_join_element_wise("\t", pc.replace_substring(texts, "\n", " \n"), "")
        words = pc.split_pattern(keyed, " ")
        coded = words.flatten().dictionary_encode()
        whole = coded.dictionary
        stems = pc.ascii_rtrim(whole, _MARKS)
        cut = pc.and_(pc.match_substring_regex(stems, _STEM), pc.not_equal(stems, whole))
        marks = pc.replace_substring_regex(whole.filter(cut), _UNMARKED, "\t\t")
        pieces = pa.concat_arrays([pc.if_else(cut, stems, whole), marks]).dictionary_encode()
        values = self._of_keys(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        codes, marked = pieces.indices.to_numpy(), cut.to_numpy(zero_copy_only=False)
        count = 1 + marked
        at = np.cumsum(count) - count
        order = np.empty(len(codes), np.int64)
        order[at] = codes[: len(whole)]
        order[at[marked] + 1] = codes[len(whole) :]
        ids, ends = _gather(np.frombuffer(b"".join(values), "<u4"), sizes, order)
        ends = ends[at + marked]
        ids, ends = _gather(ids, np.diff(ends, prepend=0), coded.indices.to_numpy())
        return ids, np.concatenate([[0], ends])[words.offsets.to_numpy()[1:] - words.offsets[0].as_py()]

    def encode_many(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        """Ids of each text of a chunk without nulls."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        out: list = [None] * len(texts)
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        plain, other = np.flatnonzero(~odd).tolist(), np.flatnonzero(odd).tolist()
        if plain:
            ids, ends = self._regular(texts.take(pa.array(plain)) if other else texts)
            for i, a, b in zip(plain, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                out[i] = ids[a:b]
        if other:
            for i, v in zip(other, self._new(texts.take(pa.array(other)).to_pylist()), strict=True):
                out[i] = np.frombuffer(v, "<u4")
        return out


@cache
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Encoder(path)


def in_ranges(docs: DataFrame, n: int) -> DataFrame:
    """docs dealt by ascending doc_id over n partitions of about equal counts, rows without doc_id in the first. The bounds
    come from doc_id alone: repartitionByRange would read the texts once more for its sample."""
    bounds = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n).alias("b")).first()["b"] if n > 1 else None
    if not bounds:
        return docs.coalesce(1)
    values = F.array(*map(F.lit, sorted(set(bounds))))
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))))
    # how many bounds are below doc_id, by halving: beyond the last bound the comparison is null
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(values, at + step - 1) < F.col("doc_id"), at + step).otherwise(at))
    return docs.repartitionById(n, below)


def write_tokens(docs: DataFrame, vocabulary: str, path: str, end_id: int = 0) -> None:
    """Write docs (doc_id, text) in ascending doc_id order: part and first say where a row stands."""
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = in_ranges(narrow, int(spark.conf.get("spark.sql.shuffle.partitions"))).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def encode(batches):
        part, first, end = TaskContext.get().partitionId(), 0, np.array([end_id], "<u4")
        enc = encoder(vocabulary)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            a = 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + CHUNK_BYTES, "right")))
                ids = [part_ids for x in enc.encode_many(texts.slice(a, b - a)) for part_ids in (x, end)]
                lengths = np.array([len(x) + 1 for x in ids[::2]], np.int64)
                ends = first + np.cumsum(lengths)
                values = np.concatenate(ids).view("<i4")
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.full(b - a, part, np.int32)), pa.array(ends - lengths), pa.array(lengths), lists], names=["doc_id", "part", "first", "n_tokens", "tokens"])
                first, a = int(ends[-1]), b

    ordered.mapInArrow(encode, "doc_id long, part int, first long, n_tokens long, tokens array<int>").write.options(**OPTIONS).parquet(path)


def starts(files: DataFrame) -> DataFrame:
    """(part, before): ids before each file; one narrow row a file."""
    totals = files.groupBy("part").agg(F.max(F.col("first") + F.col("n_tokens")).alias("t"))
    return totals.select("part", F.coalesce(F.sum("t").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, tokens; columns and doc_id ranges that aren't asked for aren't read."""
    files = spark.read.parquet(path)
    return files.join(F.broadcast(starts(files)), "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "tokens")


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens (counted from the list) and the list's crc32."""

    def of(batch: pa.RecordBatch):
        lists = batch.column(2)
        offsets = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return arrow_map(tokens.select("doc_id", "start", "tokens"), of, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return checksums(read_tokens(spark, path))
