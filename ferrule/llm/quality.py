"""Quality rules: statistics of a text in Spark expressions, and a learned decision list over them.

The list is learned by sequential covering: from a bounded sample of labelled rows, conjunctions of
threshold conditions that single out bad texts are grown on one part (by information gain) and pruned
on the other; each covers bad rows that none before it covers. The list is emitted as one ordered
CASE expression. Everything on the data path is a DataFrame expression.

Definitions for odd input: a null text has no words; empty texts fail the base rule. Rows of labels
without id or quality are ignored, and of an id with conflicting labels the worse counts. Without
labelled rows of both kinds the list is empty and keeps all. Repeated rows get repeated results.
Other columns are ignored (``with_stats`` keeps them, and replaces those of its own names).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import drop_path, let, stored, table, words_of

#: Labelled rows that the learner looks at, at most: those with the smallest hashes of their ids.
FIT_ROWS = 6000
#: Rules with less precision than this on the pruning part are not taken: clean texts stay.
LEAST_PRECISION = 0.97
SYMBOLS = "#*$%&|<>"


def n_dup_lines(text: Column) -> Column:
    """Lines (split at \\n) with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(words: Column, size: int = 8) -> Column:
    """Words in windows of ``size`` words that stand twice or more in the text."""

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            again = F.filter(s, lambda e, k: ((k > 0) & (F.get(s, k - 1)["h"] == e["h"])) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False)))
            starts = F.sort_array(F.transform(again, lambda e: e["i"]))
            zero = F.struct(F.lit(-size).alias("last"), F.lit(0).alias("total"))
            step = lambda acc, p: F.struct(p.alias("last"), (acc["total"] + F.least(F.lit(size), p - acc["last"])).alias("total"))
            return F.aggregate(starts, zero, step)["total"]

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(ordered, repeated))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (size - 1)), lambda i: F.xxhash64(F.slice(h, i, size))))
    return F.when(F.size(words) >= size, let(windows, covered)).otherwise(F.lit(0)).cast("long")


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics that conditions are made of.
FEATURES = {
    "chars_per_word": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "repeat_share": "n_repeat_words / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "marks_per_word": "n_marks / n_words",
    "distinct_share": "n_distinct / n_words",
    "words": "cast(n_words as double)",
}


def with_stats(docs: DataFrame) -> DataFrame:
    """docs with the base counts, the further counts and the features."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = {*BASE, *FEATURES, "n_lines", "n_marks", "n_distinct", "base_failed"}
    counted = (
        docs.select(*[c for c in docs.columns if c not in own], words_of(F.col("text")).alias("__words"))
        .withColumns(
            {
                "n_words": F.size("__words").cast("long"),
                "word_chars": F.length(F.array_join("__words", "")).cast("long"),
                "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
                "n_dup_lines": n_dup_lines(F.col("text")),
                "n_repeat_words": n_repeat_words(F.col("__words")),
                "n_lines": F.size(F.split(text, "\n")),
                "n_marks": F.length(text) - F.length(F.translate(text, "!?", "")),
                "n_distinct": F.size(F.array_distinct("__words")),
            }
        )
        .drop("__words")
    )
    return counted.withColumns({k: F.when(F.col("n_words") > 0, F.expr(v)).otherwise(0.0) for k, v in FEATURES.items()}).withColumn(
        "base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    )


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, is it >=, threshold): a text that meets it is rejected."""

    conditions: tuple[tuple[str, bool, float], ...]

    def covers(self, row: dict) -> bool:
        return all((row[f] >= t) if up else (row[f] < t) for f, up, t in self.conditions)

    def expression(self) -> Column:
        out = F.lit(True)
        for f, up, t in self.conditions:
            out = out & ((F.col(f) >= t) if up else (F.col(f) < t))
        return out


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0


def _grow(rows: list[dict], cuts: dict[str, list[float]]) -> tuple:
    conditions: tuple = ()
    while any(not r["bad"] for r in rows) and len(conditions) < 4:
        p0 = sum(r["bad"] for r in rows)
        best = (0.0, None)
        for f, values in cuts.items():
            ordered = sorted((r[f], r["bad"]) for r in rows)
            at = p_below = n_below = 0
            for t in values:
                while at < len(ordered) and ordered[at][0] < t:
                    p_below, n_below, at = p_below + ordered[at][1], n_below + (not ordered[at][1]), at + 1
                n0 = len(rows) - p0
                for up, p, n in ((True, p0 - p_below, n0 - n_below), (False, p_below, n_below)):
                    best = max(best, (_gain(p, n, p0, n0), (f, up, t)), key=lambda x: x[0])
        if best[1] is None or best[0] <= 1e-9:
            break
        conditions += (best[1],)
        rows = [r for r in rows if Rule((best[1],)).covers(r)]
    return conditions


def learn(rows: list[dict], features: tuple[str, ...] = tuple(FEATURES), least_precision: float = LEAST_PRECISION) -> list[Rule]:
    """Ordered rules from rows of features, ``bad`` and ``part`` (0: grow, 1: prune)."""
    cuts = {}
    for f in features:
        values = sorted({r[f] for r in rows})
        mids = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
        cuts[f] = mids if len(mids) <= 200 else [mids[i * len(mids) // 200] for i in range(200)]
    grow, prune, rules = [r for r in rows if r["part"] == 0], [r for r in rows if r["part"] == 1], []
    while any(r["bad"] for r in grow) and any(not r["bad"] for r in grow):
        conditions = _grow(grow, cuts)
        best = None
        for k in range(1, len(conditions) + 1):  # prune: the prefix that does best on the other part
            hit = [r["bad"] for r in prune if Rule(conditions[:k]).covers(r)]
            worth = (2 * sum(hit) - len(hit)) / (len(hit) or 1)
            if hit and (best is None or worth > best[0]):
                best = (worth, conditions[:k], sum(hit) / len(hit))
        if best is None or best[2] < least_precision:
            break
        rule = Rule(best[1])
        left = [r for r in grow if not rule.covers(r)]
        if len(left) == len(grow):
            break
        rules.append(rule)
        grow, prune = left, [r for r in prune if not rule.covers(r)]
    return rules


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[Rule]:
    """Learn from at most ``fit_rows`` labelled documents that pass the base rule. They are stored before their
    statistics are computed, so those of other documents are not; of rows that share a doc_id, the smallest text counts."""
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumn("at", F.xxhash64("doc_id", F.lit(7))).orderBy("at", "doc_id").limit(fit_rows)
    few, path = stored(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality", "at").agg(F.min("text").alias("text")), "labelled")
    sample = with_stats(few).where("not base_failed").select(*FEATURES, "quality", "at", "doc_id").collect()
    drop_path(docs.sparkSession, path)
    seen, rows = [0, 0], []
    for r in sorted(sample, key=lambda r: (r["at"], r["doc_id"])):  # each third of either kind is for pruning
        bad = int(r["quality"] == 0)
        rows.append(r.asDict() | {"bad": bad, "part": int(seen[bad] % 3 == 2)})
        seen[bad] += 1
    return learn(rows)


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional: False from the first rule that covers."""
    out = None
    for r in rules:
        out = F.when(r.expression(), False) if out is None else out.when(r.expression(), False)
    return F.lit(True) if out is None else out.otherwise(True)


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs with statistics and ``kept``."""
    own = [c for c in docs.columns if c != "kept"]
    return with_stats(docs.select(*own)).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return judged(docs.select("doc_id", "text"), rules).select("doc_id", *BASE, "base_failed", "kept")


def base_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6 has besides the learned verdict, so that SQL can tell it all."""
    return with_stats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *BASE, "base_failed")


BASE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT r, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM (SELECT r, i, md5_number(array_to_string(w[i : i + 7], ' ')) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8))),
p AS (SELECT r, least(8, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i), 8)) AS more FROM g WHERE c > 1),
q AS (SELECT r, sum(more) AS n_repeat_words FROM p GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
       CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * len(w) AS base_failed
FROM d LEFT JOIN l USING (r) LEFT JOIN q USING (r)
"""
