"""N-gram Jaccard join with count-vector R-trees.

Tokens (word shingles) are hashed into groups. The group counts of a document are a point;
R-trees over such points bound the overlap of two documents, and of two boxes, by the sum of
coordinate minima; pairs that survive the bound are verified on the shingle sets.

One R-tree over a whole corpus would have to compare almost every pair of leaves (points of
hashed counts are close to each other in every single dimension), so the trees are many and
small: a forest with one tree for each *pivot*. Two sets with Jaccard similarity of at least
t differ in at most floor((1-t)/t * size) shingles. Hashing the shingles of a document into
more groups than that leaves at least one group with the same content in both, so each
document files the hashes of its fullest groups (one more than may differ), and the smallest
document that filed a hash is its pivot. All documents that share a filed hash meet in the tree
of its pivot: no link is lost, and a group of near copies has a few trees instead of one for
each of its hashes. Trees above a bounded weight are searched in blocks.

Definitions for odd input: null and empty texts have no shingles, link with nothing and are
their own component; a text with fewer words than the shingle length is one shingle; repeated
rows are one node; rows that share a doc_id are taken as one document; a row without doc_id
gets the component of its text's class, null if that class has no id. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import arrow_map, drop_path, mix, small, stored, table, text_chunks, word_hashes

#: Dimensions of the points.
DIMS = 64
#: Shingles that one tree, or one of the two sides of a block pair, holds at most (8 bytes each), but for a single longer text.
TREE_SHINGLES = 2_000_000
LEAF = 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Document index and hash of the distinct shingles of a chunk of texts, sorted by both."""
    docs, _, _, words = word_hashes(data, offsets)
    n_docs = len(offsets) - 1
    counts = np.bincount(docs, minlength=n_docs)
    whole = (counts > 0) & (counts < size)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    # full windows: all positions whose window stays in the document
    position = np.arange(len(words)) - first[docs]
    at = np.flatnonzero(position + size <= counts[docs])
    hashes = np.full(len(at), np.uint64(size))
    for k in range(size):
        hashes = mix(hashes * np.uint64(0x9E3779B97F4A7C15) + words[at + k])
    owner = docs[at]
    if whole.any():
        short = np.flatnonzero(whole)
        value = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            value[has] = mix(value[has] * np.uint64(0x9E3779B97F4A7C15) + words[first[short[has]] + k])
        value = mix(value + counts[short].astype(np.uint64))
        owner, hashes = np.concatenate([owner, short]), np.concatenate([hashes, value])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[keep], hashes[keep]


def _filed(owner: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, group hash): what each document files. near: the threshold in per cent."""
    differ = (100 - near) * sizes // near
    out_docs, out_keys = [], []
    home = np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    lower = np.ceil(np.log2(np.maximum(-(-near * sizes // 100), 1))).astype(np.int64)
    for level in (home, np.where(lower < home, lower, -1)):
        use = (level >= 0) & (differ > 0)
        if not use.any():
            continue
        most = (2 ** np.maximum(level, 0)) * 100 // near
        groups = (100 - near) * most // near * 3 // 2 + 16
        take = use[owner]
        who, h = owner[take], hashes[take]
        # groups are ranges of the hash, so a sorted set is already in the order of its groups
        group = (((h >> np.uint64(32)) * groups[who].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        new = np.ones(len(who), bool)
        new[1:] = (who[1:] != who[:-1]) | (group[1:] != group[:-1])
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(who)))
        content = mix(np.add.reduceat(mix(h), at) + group[at].astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + level[who[at]].astype(np.uint64))
        who = who[at]
        order = np.lexsort((content, -count, who))
        who, content = who[order], content[order]
        begin = np.searchsorted(who, who, "left")
        rank = np.arange(len(who)) - begin
        keep = rank <= differ[who]
        out_docs.append(who[keep])
        out_keys.append(content[keep])
        # all filled groups may differ: what is common may then be the empty ones
        filled = np.bincount(who, minlength=len(sizes))
        empty = np.flatnonzero(use & (filled <= differ))
        out_docs.append(empty)
        out_keys.append(mix(level[empty].astype(np.uint64) + np.uint64(1 << 40)))
    if not out_docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    docs, keys = np.concatenate(out_docs), np.concatenate(out_keys)
    order = np.argsort(docs, kind="stable")
    return docs[order], keys[order]


def _lists(docs: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.uint64).view(np.int64)))


def profile(docs: DataFrame, shingle: int, near: int) -> DataFrame:
    """doc_id, n (set size), fp1 and fp2 (fingerprint of the set) and the filed group hashes of each row."""

    def of(batch: pa.RecordBatch):
        for a, b, data, offsets in text_chunks(batch.column(1)):
            owner, hashes = shingle_sets(data, offsets, shingle)
            n = b - a
            sizes = np.bincount(owner, minlength=n)
            sums = np.zeros((2, n), np.uint64)
            if len(owner):
                at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                for k in range(2):
                    sums[k, owner[at]] = np.add.reduceat(mix(hashes + np.uint64(k + 1)), at)
            who, keys = _filed(owner, hashes, sizes, near)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, n), pa.array(sizes), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), _lists(who, keys, n)],
                names=["doc_id", "n", "fp1", "fp2", "filed"],
            )

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), of, "doc_id long, n long, fp1 long, fp2 long, filed array<long>")


class Tree:
    """A packed R-tree over count vectors: leaves of LEAF points, boxes kept by their upper corners
    (the bound on overlap needs no lower ones)."""

    def __init__(self, sets: list[np.ndarray]):
        self.points = np.zeros((len(sets), DIMS), np.int32)
        for i, s in enumerate(sets):
            self.points[i] = np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=DIMS)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        # sort-tile packing: slabs by size, inside them by where the mass of the point lies
        slab = np.argsort(np.argsort(self.sizes, kind="stable"), kind="stable") // (LEAF * 8)
        self.order = np.lexsort((self.points @ np.arange(DIMS), slab))
        self.leaves = [self.order[i : i + LEAF] for i in range(0, len(sets), LEAF)]
        self.upper = np.array([self.points[x].max(0) for x in self.leaves])
        self.least = np.array([self.sizes[x].min() for x in self.leaves])

    def near(self, other: Tree, leaf: np.ndarray, near: int) -> list[int]:
        """Leaves of self that may hold a partner of a point of other's leaf."""
        bound = np.minimum(self.upper, other.points[leaf].max(0)).sum(1)
        least = self.least + other.sizes[leaf].min()
        return np.flatnonzero((100 + near) * bound >= near * least).tolist()

    def pairs(self, mine: np.ndarray, other: Tree, theirs: np.ndarray, near: int) -> np.ndarray:
        """Mask of pairs whose overlap may suffice: overlap >= near/(100+near) * sum of sizes."""
        bound = np.minimum(self.points[mine][:, None, :], other.points[theirs][None, :, :]).sum(2)
        return (100 + near) * bound >= near * (self.sizes[mine][:, None] + other.sizes[theirs][None, :])


def linked(a: np.ndarray, b: np.ndarray, near: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= near * (len(a) + len(b) - both)


def spanning_links(ids: list, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, near: int) -> list[tuple]:
    """Links (id, id) that connect what the links between left and right positions connect; pairs
    already connected are not verified again."""
    up = np.arange(len(ids))  # union-find: a root is its own parent
    out: list[tuple] = []

    def roots(i: np.ndarray) -> np.ndarray:
        r = up[i]
        while (up[r] != r).any():
            r = up[r]
        up[i] = r
        return r

    def try_link(i: int, j: int) -> None:
        if linked(sets[i], sets[j], near):
            out.append((ids[i], ids[j]))
            a, b = roots(np.array([i, j]))
            up[max(a, b)] = min(a, b)

    sizes = np.array([len(s) for s in sets])
    for j in right:  # most near copies are linked to the first: a star settles them
        i = left[0]
        if i != j and 100 * min(sizes[i], sizes[j]) >= near * max(sizes[i], sizes[j]) and np.ptp(roots(np.array([i, j]))):
            try_link(i, j)
    one, two = Tree([sets[i] for i in left]), Tree([sets[j] for j in right])
    first = lambda: roots(left[:1])[0]
    for leaf in two.leaves:
        theirs = right[leaf]
        if (roots(theirs) == first()).all() and (roots(left) == first()).all():
            continue
        for k in one.near(two, leaf, near):
            mine = left[one.leaves[k]]
            mask = roots(mine)[:, None] != roots(theirs)[None, :]
            if not mask.any():
                continue
            mask &= one.pairs(one.leaves[k], two, leaf, near)
            for x, y in zip(*np.nonzero(mask), strict=True):
                if np.ptp(roots(np.array([mine[x], theirs[y]]))):
                    try_link(int(mine[x]), int(theirs[y]))
    return out


def components(links: DataFrame) -> DataFrame:
    """(id, component) of each id in links (a, b): alternating large and small stars until no edge
    changes. Minima are aggregated before the shuffle, and the joins can be split at hot stars."""
    spark = links.sparkSession
    edges, path = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())

    now = state(edges)
    while now[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        fresh, fresh_path = stored(star.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        drop_path(spark, path)
        edges, path, last, now = fresh, fresh_path, now, state(fresh)
        if now == last:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def links_of(docs: DataFrame, reps: DataFrame, shingle: int, near: int, tree_shingles: int) -> DataFrame:
    """Verified links (a, b) between the documents in reps (rep, n, filed), whose texts are in docs."""
    filed = reps.select("rep", "n", F.explode("filed").alias("key"))
    # stored by itself, so that its shuffle is gone before the rows of the keys move
    shared, shared_path = stored(filed.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("many")).where("many > 1").select("key", "pivot"), "pivots")
    members, members_path = stored(filed.join(shared, "key").select("pivot", "rep", "n").distinct(), "members")
    drop_path(docs.sparkSession, shared_path)
    weights = members.groupBy("pivot").agg(F.sum("n").alias("weight"), F.count("*").alias("m")).where("m > 1")
    blocks = members.join(weights, "pivot").select(
        "pivot", "rep", F.ceil(F.col("weight") / tree_shingles).cast("int").alias("blocks"), F.pmod(F.xxhash64("rep", F.lit(11)), F.ceil(F.col("weight") / tree_shingles)).cast("int").alias("block")
    )
    # in a tree of more than one block, a block meets each other block: the pair (i, j) is a tree of its own
    placed = blocks.select(
        "rep",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.col("pivot"), F.least(F.col("block"), o).alias("i"), F.greatest(F.col("block"), o).alias("j"), F.col("block")))).alias("tree"),
    )
    trees = placed.groupBy("rep").agg(F.collect_list("tree").alias("trees"))

    def sets_of(batch: pa.RecordBatch):
        for a, b, data, offsets in text_chunks(batch.column(1)):
            owner, hashes = shingle_sets(data, offsets, shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), _lists(owner, hashes, b - a)], names=["rep", "trees", "hashes"])

    tree_type = "array<struct<pivot:bigint,i:int,j:int,block:int>>"
    wanted = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text")).join(small(trees.select("rep"), 200_000), "rep", "left_semi").dropDuplicates(["rep", "text"]).join(trees, "rep").select("rep", "text", F.col("trees").cast(tree_type))
    sets = arrow_map(wanted, sets_of, f"rep long, trees {tree_type}, hashes array<long>").select(F.explode("trees").alias("t"), "rep", "hashes").select("t.*", "rep", "hashes")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rep"])
        sets_ = [np.asarray(x).view(np.uint64) for x in pdf["hashes"]]
        i, j = pdf["i"].iat[0], pdf["j"].iat[0]
        every = np.arange(len(pdf))
        left, right = (every[pdf["block"] == i], every[pdf["block"] == j]) if i != j else (every, every)
        found = spanning_links(pdf["rep"].tolist(), sets_, left, right, near) if len(left) and len(right) else []
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    links, _ = stored(sets.groupBy("pivot", "i", "j").applyInPandas(search, "a long, b long").distinct(), "links")
    drop_path(docs.sparkSession, members_path)
    return links


def ngram_join(docs: DataFrame, shingle: int = 5, near: int = 80, tree_shingles: int = TREE_SHINGLES) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, class_id (smallest doc_id with the same set)
    and component_id (smallest doc_id reachable by links of at least ``near`` per cent)."""
    spark = docs.sparkSession
    wide, wide_path = stored(profile(docs, shingle, near), "profile")
    rows, _ = stored(wide.drop("filed"), "sizes")
    classes, _ = stored(rows.where("n > 0").groupBy("n", "fp1", "fp2").agg(F.min("doc_id").alias("class_id")), "classes")
    # the filed hashes of a class are those of the row with its smallest id
    reps = (
        wide.where("n > 0 and doc_id is not null and size(filed) > 0").join(classes.select(F.col("class_id").alias("doc_id"), "n", "fp1", "fp2"), ["doc_id", "n", "fp1", "fp2"], "left_semi")
        .dropDuplicates(["doc_id", "fp1", "fp2"]).select(F.col("doc_id").alias("rep"), "n", "filed")
    )
    # rows of one doc_id with different sets are one document: their classes are linked
    own = rows.where("n > 0 and doc_id is not null").join(classes, ["n", "fp1", "fp2"]).select("doc_id", "class_id").distinct()
    several = own.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).where("a <> b").select("doc_id", "a")
    found = components(links_of(docs, reps, shingle, near, tree_shingles).union(own.join(several, "doc_id").where("a <> class_id").select("a", "class_id")))
    drop_path(spark, wide_path)
    named = classes.join(found, classes.class_id == found.id, "left").select("n", "fp1", "fp2", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    empty = rows.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    full = rows.where("n > 0").select("doc_id", "n", "fp1", "fp2").join(named, ["n", "fp1", "fp2"]).select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id")
    return full.union(empty)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-word shingles, 85 per cent, over all documents."""
    return ngram_join(table(spark, sf_dir, "documents"), shingle=4, near=85)


#: The same by joining all shared shingles and following links recursively.
OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, md5_number(array_to_string(w[i : i + 3], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k)) AS s FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS class_id FROM n)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(k.class_id, d.doc_id) AS class_id, c.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
"""
