"""Benchmark decontamination with a distributed positional inverted index.

Test texts are cut into phrases. The two rarest terms of each phrase (by their frequency in the
whole corpus) are its anchors; the index stores the positional postings of anchor terms. Posting
lists are adjusted by the offset of the term in its phrase and intersected, rarest first; what
remains is compared with the words at that place (exact phrases), or returned as it is with the
distance of the anchors (proximity). Everything is a DataFrame operation. Tables of terms and
candidates are broadcast only after counting them, and joined by shuffles beyond that.

Definitions for odd input: null and empty texts have no words; phrases with a term that the
corpus lacks can't occur; repeated rows get equal results, as do rows that share doc_id and text;
test rows without item_id are ignored, repeated ones count once. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import drop_path, small, stored, table

#: What parts words: all ASCII but letters and digits.
_PARTS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def raw_terms(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), _PARTS), "")


def lowered(term: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.octet_length(term) == F.length(term), F.lower(term)).otherwise(F.translate(term, _UPPER, _LOWER))


def _key() -> Column:
    return F.struct(F.col("doc_id").cast("long").alias("d"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("t"))


def phrases(items: DataFrame, size: int) -> DataFrame:
    """(phrase_id, phrase, items): the distinct windows of ``size`` words of the test texts."""
    words = items.where("item_id is not null").select("item_id", F.transform(raw_terms(F.col("text")), lowered).alias("w")).where("size(w) > 0")
    cut = words.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1))), lambda i: F.slice("w", i, size))).alias("phrase"))
    return cut.groupBy("phrase").agg(F.collect_set("item_id").alias("items")).withColumn("phrase_id", F.sha2(F.array_join("phrase", " "), 256))


def anchored(phrase_table: DataFrame, docs: DataFrame) -> DataFrame:
    """Phrases with ``anchors``: their terms (term, offset, frequency) from the rarest on, the first two.
    Phrases with a term that the corpus lacks are left out."""
    terms = phrase_table.select("phrase_id", F.posexplode("phrase").alias("o", "term"))
    wanted = small(terms.select("term").distinct())
    found = docs.select(F.explode(raw_terms(F.col("text"))).alias("w")).select(lowered(F.col("w")).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("f"))
    ranked = terms.join(found, "term", "left").groupBy("phrase_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "o", "term"))).alias("a"))
    return phrase_table.join(ranked.where(F.col("a")[0]["f"] > 0).select("phrase_id", F.slice("a", 1, 2).alias("anchors")), "phrase_id")


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Positional postings (term, key, positions) of the given terms over whole texts."""
    words = docs.select(_key().alias("key"), raw_terms(F.col("text")).alias("w")).select("key", F.posexplode("w").alias("p", "w"))
    return words.select("key", "p", lowered(F.col("w")).alias("term")).join(small(terms.distinct()), "term").groupBy("term", "key").agg(F.sort_array(F.collect_set("p")).alias("positions"))


def candidates(anchors: DataFrame, postings: DataFrame) -> DataFrame:
    """(phrase_id, key, start): where the offset-adjusted lists of both anchors meet."""
    first = anchors.select("phrase_id", F.col("anchors")[0]["term"].alias("term"), F.col("anchors")[0]["o"].alias("o"), F.get("anchors", F.lit(1)).alias("b"))
    starts = postings.join(small(first, 100_000), "term").select("phrase_id", "key", "b", F.explode(F.transform("positions", lambda p: p - F.col("o"))).alias("start")).where("start >= 0")
    alone = starts.where("b is null").select("phrase_id", "key", "start")
    second = postings.select(F.col("term").alias("t2"), F.col("key").alias("k2"), F.col("positions").alias("p2"))
    both = starts.where("b is not null").join(second, (F.col("b")["term"] == F.col("t2")) & (F.col("key") == F.col("k2"))).where(F.array_contains("p2", F.col("start") + F.col("b")["o"]))
    return both.select("phrase_id", "key", "start").union(alone)


def proximity(docs: DataFrame, items: DataFrame, size: int = 10, within: int = 20) -> DataFrame:
    """(doc_id, item_id, distance): documents in which the two rarest terms of a phrase of an item stand
    at most ``within`` words apart, with the least distance."""
    phrase_table = phrases(items, size)
    anchors = anchored(phrase_table, docs).where("size(anchors) > 1")
    postings = index(docs, anchors.select(F.explode("anchors.term").alias("term")))
    a = postings.join(anchors.select("phrase_id", "items", F.col("anchors")[0]["term"].alias("term"), F.col("anchors")[1]["term"].alias("t2")), "term")
    b = postings.select(F.col("term").alias("t2"), "key", F.col("positions").alias("p2"))
    least = F.array_min(F.transform("positions", lambda p: F.array_min(F.transform("p2", lambda q: F.when(p != q, F.abs(p - q))))))
    return a.join(b, ["t2", "key"]).select(F.col("key")["d"].alias("doc_id"), F.explode("items").alias("item_id"), least.alias("distance")).where(F.col("distance") <= within).groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def hits(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """(key, n_hit, items) of documents with exact occurrences of phrases."""
    spark = docs.sparkSession
    phrase_table, phrases_path = stored(phrases(items, size), "phrases")
    anchors, anchors_path = stored(anchored(phrase_table, docs), "anchors")
    postings, index_path = stored(index(docs, anchors.select(F.explode("anchors.term").alias("term"))), "index")
    found, found_path = stored(candidates(anchors, postings).distinct(), "candidates")
    # only the texts of candidates are opened again
    texts = docs.withColumn("key", _key()).join(small(found.select("key").distinct(), 200_000), "key", "left_semi").dropDuplicates(["key"]).select("key", F.transform(raw_terms(F.col("text")), lowered).alias("w"))
    # a document's candidates meet it as one list of phrase numbers; phrases are looked up afterwards
    at = found.groupBy("key").agg(F.collect_list(F.struct("phrase_id", "start")).alias("c"))
    # what stands at a candidate is its window's hash for the phrase's length
    lengths = anchors.select("phrase_id", F.size("phrase").alias("k"), "items")
    opened = texts.join(at, "key").select("key", "w", F.explode("c").alias("c")).select("key", F.col("c")["phrase_id"].alias("phrase_id"), F.col("c")["start"].alias("start"), F.slice("w", F.col("c")["start"] + 1, size).alias("here"))
    exact = opened.join(small(lengths, 100_000), "phrase_id").where(F.sha2(F.array_join(F.slice("here", F.lit(1), F.col("k")), " "), 256) == F.col("phrase_id")).where(F.size("here") >= F.col("k"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(x["e"] - F.greatest(x["s"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], x["e"]).alias("end"))
    spans = exact.groupBy("key").agg(
        F.sort_array(F.collect_set(F.struct(F.col("start").alias("s"), (F.col("start") + F.col("k")).alias("e")))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
    )
    out, _ = stored(spans.select("key", F.aggregate("spans", zero, step)["n"].alias("n_hit"), "items"), "hits")
    drop_path(spark, phrases_path, anchors_path, index_path, found_path)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """docs with n_words, n_hit, items (array) and contaminated; columns of these names are replaced."""
    found = hits(docs, items, size).withColumnsRenamed({"key": "__key", "n_hit": "__hit", "items": "__items"})
    own = [c for c in docs.columns if c not in ("n_words", "n_hit", "items", "contaminated")]
    joined = docs.select(*own, _key().alias("__k"), F.size(raw_terms(F.col("text"))).cast("long").alias("n_words")).join(small(found, 20_000), F.col("__k") == F.col("__key"), "left")
    return joined.select(*own, "n_words", F.coalesce("__hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("__items", F.array().cast(found.schema["__items"].dataType)).alias("items")).withColumn("contaminated", F.col("n_hit") > 0)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    ids = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bs AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, w[i : i + 9] AS phrase, len(w[i : i + 9]) AS k FROM bs),
k AS (SELECT DISTINCT k FROM p),
ds AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k),
m AS (SELECT DISTINCT ds.doc_id, ds.i, p.k, p.item_id FROM ds JOIN p ON p.k = ds.k AND p.phrase = ds.w[ds.i : ds.i + ds.k - 1]),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS j FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
