"""Message logs: a bounded log of graphs, replayed as triples about its envelopes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule import terms as T
from ferrule.lang.parser import parse_graph, tokenize

#: Vocabulary of envelopes, unless another is asked for.
LOG = "urn:message-log:vocabulary#"
#: Triples of a frame that a task of a replay yields, about, and tasks of a replay at least.
BATCH, TASKS = 20_000, 24
NAME_OF = "<http://www.w3.org/2000/10/swap/log#nameOf>"


def looks_like_log(source: str) -> bool:
    return bool(re.search(r"""^\s*(?:@version|VERSION)\s+["']1\.[12](?:\.\d+)?-messages["']""", source, re.MULTILINE | re.IGNORECASE))


def split_log(source: str) -> tuple[str, list[str]]:
    """Shared directives and the texts of the messages, cut at MESSAGE outside brackets and strings."""
    cuts, depth, tokens = [0], 0, tokenize(re.sub(r"""(?im)^\s*(@version|VERSION)\s+["'][^"']*["']\s*\.?""", lambda m: " " * len(m[0]), source))
    for kind, text, at in tokens:
        if kind in ("op", "open"):
            depth += text in ("{", "[", "(", "<<", "<<(", "{|")
            depth -= text in ("}", "]", ")", ">>", ")>>", "|}")
        elif depth == 0 and ((kind == "word" and text.upper() == "MESSAGE") or (kind == "lang" and text == "@message")):
            cuts += [at, at + len(text)]
    pieces = [source[a:b] for a, b in zip(cuts[::2], [*cuts[1::2], len(source)], strict=True)]
    directive = re.compile(r"(?im)^\s*(?:@?(?:prefix|base|version)\b[^\n]*)$")
    shared = "\n".join(x.strip() for p in pieces for x in directive.findall(p) if "version" not in x.lower())
    bodies = [re.sub(r"^\s*\.", "", directive.sub("", p)) for p in pieces]
    return shared, bodies


def fnv(text: str) -> str:
    h = 0x811C9DC5
    for c in text:
        h = (h ^ ord(c)) * 0x01000193 & 0xFFFFFFFF
    return f"{h:08x}"


def replay(source: str, base: str = "", include_facts: bool = False, vocabulary: str = LOG) -> list[tuple[str, str, str]]:
    """Triples of the stream, its envelopes and payloads."""
    shared, bodies = split_log(source)
    stream = T.iri(f"urn:message-log:{fnv(source)}")
    v = lambda x: T.iri(vocabulary + x)
    envelopes = [T.iri(f"{stream[1:-1]}#envelope-{k + 1:03d}") for k in range(len(bodies))]
    out = [(stream, T.TYPE, v("Stream")), (stream, v("messageCount"), T.number(len(bodies)))]

    def collection(items: list[str], label: str) -> str:
        cells = [f"_:{label}{k}" for k in range(len(items))]
        for k, (cell, item) in enumerate(zip(cells, items, strict=True)):
            out.extend([(cell, T.FIRST, item), (cell, T.REST, cells[k + 1] if k + 1 < len(cells) else T.NIL)])
        return cells[0] if cells else T.NIL

    out.append((stream, v("orderedEnvelopes"), collection(envelopes, "envelopes")))
    if envelopes:
        out += [(stream, v("firstEnvelope"), envelopes[0]), (stream, v("lastEnvelope"), envelopes[-1])]
    for k, (body, envelope) in enumerate(zip(bodies, envelopes, strict=True)):
        triples, _ = parse_graph(shared + "\n" + body, base, scope=f"msg{k + 1:03d}_")
        out += [
            (stream, v("envelope"), envelope), (envelope, T.TYPE, v("Envelope")), (envelope, v("offset"), T.number(k + 1)),
            (envelope, v("payloadKind"), v("graph" if triples else "empty")), (envelope, v("tripleCount"), T.number(len(triples))),
        ]
        if k + 1 < len(envelopes):
            out.append((envelope, v("nextEnvelope"), envelopes[k + 1]))
        if triples:
            payload = T.iri(f"{stream[1:-1]}#payload-{k + 1:03d}")
            terms = [T.triple_term(*t) for t in triples]
            out += [(envelope, v("payloadGraph"), payload), (payload, NAME_OF, collection(terms, f"payload{k + 1}_"))]
            out += [(payload, v("payloadTriple"), t) for t in terms]
            if include_facts:
                out += triples
    return out


def replay_logs(logs: DataFrame, log: str = "log", text: str = "text", include_facts: bool = False, vocabulary: str = LOG) -> DataFrame:
    """(log, s, p, o): many logs, one a row, each replayed where it lies; blank nodes are kept apart by log. A null log is empty."""

    own = re.compile(r"(?<![^ ])_:(?=\w)")

    def of(frames):
        out: list[tuple] = []
        for pdf in frames:
            for name, source in zip(pdf["log"], pdf["text"], strict=True):
                rows = replay(source or "", "", include_facts, vocabulary)
                scope = f"_:l{fnv(str(name))}_"
                apart = lambda t: own.sub(scope, t) if "_:" in t and not t.startswith('"') else t
                out += [(name, *map(apart, t)) for t in rows]
                if len(out) >= BATCH:  # many small logs make one frame
                    yield pd.DataFrame(out, columns=["log", "s", "p", "o"])
                    out = []
        if out:
            yield pd.DataFrame(out, columns=["log", "s", "p", "o"])

    kind = dict(logs.dtypes)[log]
    # a number of its own, so that texts, small as they are, stay dealt over many tasks: to read them is what takes time
    parts = max(TASKS, int(logs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return logs.select(F.col(log).alias("log"), F.col(text).cast("string").alias("text")).repartition(parts, "log").mapInPandas(of, f"log {kind}, s string, p string, o string")


def envelopes(rows: DataFrame, log: str, order: str) -> DataFrame:
    """Rows of many logs with their offset (from 1) and the order value of the next envelope."""
    w = Window.partitionBy(log).orderBy(order)
    return rows.withColumns({"offset": F.row_number().over(w).cast("long"), f"next_{order}": F.lead(order).over(w)})
