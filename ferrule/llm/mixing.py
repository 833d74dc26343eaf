"""Mixing sources to target weights by hierarchical budgeting.

Sources form a tree: domain, language, source. A token budget goes from the root down by the weights
of the children. A child that can't use its part (its tokens times the epochs allowed) leaves the
rest to its siblings, by their weights; only what no child can use goes up to the siblings of the parent.
Each leaf takes whole epochs and then a token-prefix of the next one, in an order seeded by epoch.

The order is a hash, so a prefix is a hash threshold: it is found from buckets of the narrow table of
(leaf, hash, tokens), never by sorting a leaf in one task, and applied without shuffling texts.

Definitions for odd input: null and empty texts have no tokens and go with the rows about them in the
order; a null level is a node named ``(none)``; rows that share a doc_id are taken or left together;
rows without doc_id take part like others. Empty tables give no rows. A weight that isn't given
is 1. Columns of the names of the results are replaced by them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ferrule.llm.common import drop_path, stored, table, words_of

#: Leaves that the tree may have: metadata that the driver holds. More is an error.
MOST_LEAVES = 100_000
BUCKET_ROWS = 500
NONE = "(none)"


@dataclass
class Node:
    weight: float = 1.0
    tokens: int = 0
    children: dict[str, Node] = field(default_factory=dict)

    def room(self, epochs: int) -> int:
        return sum(c.room(epochs) for c in self.children.values()) if self.children else self.tokens * epochs


def share_out(budget: int, weights: list[float], rooms: list[int]) -> list[int]:
    """Split budget by weights; what a room can't take goes to the others by theirs."""
    out, open_ = [0] * len(rooms), [k for k in range(len(rooms)) if weights[k] > 0 and rooms[k] > 0]
    while open_ and budget > 0:
        total = sum(weights[k] for k in open_)
        full = [k for k in open_ if budget * weights[k] >= rooms[k] * total]
        if not full:
            given = 0
            for k in open_:
                out[k] = int(budget * weights[k] / total)
                given += out[k]
            for k in sorted(open_, key=lambda k: (-weights[k], k)):  # the rest of rounding, a token each
                if given < budget and out[k] < rooms[k]:
                    out[k], given = out[k] + 1, given + 1
            break
        left = sum(rooms[k] for k in full)
        for k in full:
            out[k] = rooms[k]
        budget, open_ = budget - left, [k for k in open_ if k not in full]
    return out


def budgets(root: Node, budget: int, epochs: int) -> dict[tuple[str, ...], int]:
    """Tokens of each leaf."""
    if not root.children:
        return {(): min(budget, root.tokens * epochs)}
    names = sorted(root.children)
    parts = share_out(budget, [root.children[x].weight for x in names], [root.children[x].room(epochs) for x in names])
    return {(name, *path): v for name, part in zip(names, parts, strict=True) for path, v in budgets(root.children[name], part, epochs).items()}


def tree_of(leaves: list[tuple], weights: dict[tuple[str, ...], float]) -> Node:
    root = Node()
    for *path, tokens in leaves:
        node = root
        for k in range(len(path)):
            node = node.children.setdefault(path[k], Node(weights.get(tuple(path[: k + 1]), weights.get(("*",) * k + (path[k],), 1.0))))
        node.tokens += tokens
    return root


def mixed(docs: DataFrame, levels: dict[str, Column], weights: dict[tuple[str, ...], float], budget: int | None = None, epochs: int = 4, seed: int = 1, tokens: Column | None = None) -> DataFrame:
    """docs with the level columns, n_tokens and ``copies`` (how often the mixture has the row).

    weights: by path from the root; ("*", "en") means "en" below any node. budget: tokens of
    the mixture, by default as many as there are."""
    spark = docs.sparkSession
    names = list(levels)
    own = [c for c in docs.columns if c not in {*names, "n_tokens", "copies"}]
    keys = {f"__{k}": F.coalesce(c.cast("string"), F.lit(NONE)) for k, c in levels.items()}
    order = lambda epoch: F.xxhash64(F.col("doc_id"), F.lit(seed), epoch)
    rows = docs.select(*own, *[c.alias(k) for k, c in keys.items()], (F.size(words_of(F.col("text"))) if tokens is None else tokens).cast("long").alias("n_tokens"))
    narrow, narrow_path = stored(rows.select("doc_id", *keys, "n_tokens"), "mixing")
    totals = narrow.groupBy(*keys).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    leaves = [tuple(r) for r in totals.limit(MOST_LEAVES + 1).collect()]
    if len(leaves) > MOST_LEAVES:
        raise ValueError(f"the tree has more than {MOST_LEAVES} leaves")
    root = tree_of([x[:-1] for x in leaves], weights)
    given = budgets(root, sum(x[-2] for x in leaves) if budget is None else budget, epochs)
    plan = []
    for *path, t, n in leaves:
        amount = given.get(tuple(path), 0)
        plan.append((*path, amount // t if t else 0, amount % t if t else 0, -(-n // BUCKET_ROWS)))
    leaf = F.broadcast(spark.createDataFrame(plan, ", ".join(f"`{k}` string" for k in keys) + ", __whole long, __rest long, __buckets long"))
    # where the prefix ends: bucket totals first, then rows inside buckets only
    placed = narrow.join(leaf, list(keys)).withColumn("__h", order(F.col("__whole"))).withColumn("__bucket", F.floor((F.col("__h") / F.lit(2.0**64) + 0.5) * F.col("__buckets")))
    before = F.coalesce(F.sum("b").over(W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy(*keys, "__bucket").agg(F.sum("n_tokens").alias("b")).select(*keys, "__bucket", before.alias("__before"))
    up_to = F.sum("n_tokens").over(W.partitionBy(*keys, "__bucket").orderBy("__h").rangeBetween(W.unboundedPreceding, W.currentRow))
    ends = placed.withColumn("__in", up_to).join(starts, [*keys, "__bucket"]).where(F.col("__before") + F.col("__in") <= F.col("__rest")).groupBy(*keys).agg(F.max("__h").alias("__end"))
    cuts, _ = stored(leaf.join(ends, list(keys), "left"), "cuts")
    drop_path(spark, narrow_path)
    out = rows.join(F.broadcast(cuts), list(keys)).withColumn("copies", (F.col("__whole") + F.coalesce((order(F.col("__whole")) <= F.col("__end")).cast("long"), F.lit(0))).cast("long"))
    return out.select(*own, *[F.col(f"__{k}").alias(k) for k in names if k not in own], "n_tokens", "copies")


def levels() -> dict[str, Column]:
    """The tree of the production run: four domains of sources, languages, sources."""
    domain = F.concat(F.lit("d"), F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(4)).cast("string"))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


WEIGHTS = {("*", "en"): 4.0, ("*", "de"): 2.0, ("*", "fr"): 2.0, ("*", "es"): 2.0}


def mixture(docs: DataFrame) -> DataFrame:
    """The production run: as many tokens as there are, four epochs at most."""
    return mixed(docs, levels(), WEIGHTS)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens and copies of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixture(docs).select("doc_id", "domain", "lang", "source", "n_tokens", "copies")
