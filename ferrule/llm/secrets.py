"""Secret scans: patterns, and a token-efficiency test.

A run of characters without spaces that a tokenizer needs many tokens for (few characters a token) is
no word of any language: with letters and digits mixed it is a random string. Digests of
known lengths, UUIDs and listed values are left out. Patterns are the base; spans of the test that
overlap them are theirs.

Definitions for odd input: a null text is empty; results are one row a row, repeated rows included;
other columns are ignored. Offsets are code points of the whole text, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ferrule.llm.common import arrow_map, table

#: Fixed values of the base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
_KEYS = ("passw", "secret", "token", "apikey", "api_key")

RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: Characters a token below which a run counts as random; prose has 2.3 and more, random strings 1.9 and less.
LEAST_RATIO = 2.0
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
DIGEST_LENGTHS = frozenset({32, 40, 56, 64, 96, 128})
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")


@cache
def vocabulary(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def is_random(run: str, encoding, least: float = LEAST_RATIO, known: frozenset[str] = frozenset()) -> bool:
    if run in known or _UUID.match(run) or (len(run) in DIGEST_LENGTHS and _DIGEST.match(run)):
        return False
    kinds = any(c.isdigit() for c in run) + any(c.islower() for c in run) + any(c.isupper() for c in run)
    return kinds >= 2 and len(run) < least * len(encoding.encode_ordinary(run))


def find(text: str, encoding, least: float = LEAST_RATIO, known: frozenset[str] = frozenset()) -> tuple[list, list]:
    """(base spans, further spans), both by start, then kind."""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(base_spans(text), key=order)
    more = []
    if any(len(w) >= 20 for w in text.split()):
        more = [("random", *m.span()) for m in RUN.finditer(text) if is_random(m[0], encoding, least, known)]
        more = [s for s in more if not any(s[1] < e and a < s[2] for _, a, e in base)]
    return base, more


def scan(docs: DataFrame, path: str, least: float = LEAST_RATIO, known: frozenset[str] = frozenset()) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans."""

    def joined(spans: list) -> str:
        return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    def of(batch: pa.RecordBatch):
        encoding, rows = vocabulary(path), []
        for text in batch.column(1).to_pylist():
            base, more = find(text or "", encoding, least, known)
            counts = [sum(s[0] == k for s in base) for k in KINDS[:3]]
            every = sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return arrow_map(docs.select("doc_id", docs["text"].cast("string").alias("text")), of, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return scan(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
