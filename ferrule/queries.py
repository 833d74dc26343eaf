"""Registered rule programs over the driver's tables, each with the SQL of its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.lang.parser import Atom, Program, Rule
from ferrule.operators.engine import Options, query, rules_as_data, run
from ferrule.sources.catalog import Store
from ferrule.streaming import messages
from ferrule.terms import TYPE, Var, iri

KEYS: dict[str, Column | str] = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id",
    "documents": "doc_id", "labels": "doc_id", "pages": "page_id", "benchmark": "item_id", "embeddings": "vec_id",
}
HEAD = "PREFIX : <urn:table#>\n"


def store_of(spark: SparkSession, sf_dir: str, *tables: str) -> Store:
    """Tables with one predicate a column (:c_name and so on), subject the primary key. lineitem has no
    key, so its subject is made of two hashes of all columns; conversations are keyed by conversation and turn."""
    store = Store(spark)
    for t in tables:
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        key = F.concat_ws("-", F.xxhash64(*df.columns), F.xxhash64(F.lit(1), *df.columns)) if t == "lineitem" else F.concat_ws("-", "conv_id", "turn") if t == "conversations" else KEYS[t]
        store.add_table(t, df, key, "urn:table#")
    return store


def _derived(tables: tuple[str, ...], program: str, predicate: str, s: str, o: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    def of(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = run(spark, HEAD + program, store_of(spark, sf_dir, *tables), Options(**options))
        return result.relation(f"<urn:table#{predicate}>").toDF(s, o)

    return of


def _answers(tables: tuple[str, ...], program: str, body: str, **names: str) -> Callable[[SparkSession, str], DataFrame]:
    def of(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(spark, HEAD + program, body, store_of(spark, sf_dir, *tables)).withColumnsRenamed(names)

    return of


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = fn
    if sql:
        ORACLE_SQL[name] = sql


_add("bgp_filter", _derived(("orders",), "RULE { ?c :bigSpender ?o } WHERE { ?o :o_custkey ?c ; :o_totalprice ?t . FILTER(?t > 400000) }", "bigSpender", "cust", "ord"),
     "SELECT DISTINCT o_custkey AS cust, o_orderkey AS ord FROM orders WHERE o_totalprice > 400000")
_add("star_join", _answers(("orders",), "", '?o :o_custkey ?c ; :o_orderstatus "F" ; :o_orderpriority ?p ; :o_totalprice ?t . FILTER(?t < 5000)'),
     "SELECT DISTINCT o_orderkey AS o, o_custkey AS c, o_orderpriority AS p, o_totalprice AS t FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 5000")
_add("chain_join", _derived(("orders", "customer", "nation", "region"), "RULE { ?o :orderRegion ?r } WHERE { ?o :o_custkey ?c . ?c :c_nationkey ?n . ?n :n_regionkey ?k . ?k :r_name ?r }", "orderRegion", "ord", "region"),
     "SELECT DISTINCT o_orderkey AS ord, r_name AS region FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
_add("theta_join", _derived(("supplier",), "RULE { ?a :richer ?b } WHERE { ?a :s_nationkey ?n ; :s_acctbal ?x . ?b :s_nationkey ?n ; :s_acctbal ?y . FILTER(?x > ?y) }", "richer", "a", "b"),
     "SELECT DISTINCT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_acctbal > b.s_acctbal")
_add("cross_small", _answers(("region", "nation"), "", "?r :r_name ?x . ?n :n_name ?y"), "SELECT DISTINCT r_regionkey AS r, r_name AS x, n_nationkey AS n, n_name AS y FROM region, nation")
_add("anti_join", _derived(("customer", "orders"), "RULE { ?c :idle ?n } WHERE { ?c :c_name ?n . NOT { ?o :o_custkey ?c ; :o_orderpriority \"1-URGENT\" } }", "idle", "cust", "name"),
     "SELECT DISTINCT c_custkey AS cust, c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
_add("anti_corr_filter", _derived(("supplier",), "RULE { ?s :richest ?n } WHERE { ?s :s_nationkey ?n ; :s_acctbal ?b . NOT { ?t :s_nationkey ?n ; :s_acctbal ?d . FILTER(?d > ?b) } }", "richest", "supp", "nation"),
     "SELECT DISTINCT s_suppkey AS supp, s_nationkey AS nation FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM supplier t WHERE t.s_nationkey = s.s_nationkey AND t.s_acctbal > s.s_acctbal)")
_add("anti_uncorrelated", _derived(("nation", "region"), 'RULE { ?n :ok ?x } WHERE { ?n :n_name ?x . NOT { ?r :r_name "ATLANTIS" } }', "ok", "nation", "name"),
     "SELECT DISTINCT n_nationkey AS nation, n_name AS name FROM nation WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_name = 'ATLANTIS')")
_add("union_rules", _derived(("customer", "supplier"), "RULE { ?c :party ?n } WHERE { ?c :c_nationkey ?n } RULE { ?s :party ?n } WHERE { ?s :s_nationkey ?n }", "party", "id", "nation"),
     "SELECT c_custkey AS id, c_nationkey AS nation FROM customer UNION SELECT s_suppkey, s_nationkey FROM supplier")
_add("set_arith", _derived(("part",), "RULE { ?p :net ?v } WHERE { ?p :p_retailprice ?x ; :p_size ?s . SET(?v := ?x * 2 - ?s / 4 + 1) }", "net", "part", "net"),
     "SELECT DISTINCT p_partkey AS part, p_retailprice * 2 - CAST(p_size AS DOUBLE) / 4 + 1 AS net FROM part")
_add("set_string", _derived(("customer",), 'RULE { ?c :tag ?t } WHERE { ?c :c_name ?n ; :c_mktsegment ?m . SET(?t := CONCAT(LCASE(?m), "/", SUBSTR(?n, 1, 4), "/", STRAFTER(?n, "#"))) }', "tag", "cust", "tag"),
     "SELECT DISTINCT c_custkey AS cust, concat(lower(c_mktsegment), '/', substr(c_name, 1, 4), '/', CASE WHEN strpos(c_name, '#') > 0 THEN substr(c_name, strpos(c_name, '#') + 1) ELSE '' END) AS tag FROM customer")
_add("set_date", _derived(("orders",), "RULE { ?o :ym ?v } WHERE { ?o :o_orderdate ?d . SET(?v := YEAR(?d) * 100 + MONTH(?d)) }", "ym", "ord", "ym"),
     "SELECT DISTINCT o_orderkey AS ord, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS DOUBLE) AS ym FROM orders")
_add("if_lazy", _derived(("part",), 'RULE { ?p :band ?b } WHERE { ?p :p_size ?s . SET(?b := IF(?s >= 25, "large", "small")) }', "band", "part", "band"),
     "SELECT DISTINCT p_partkey AS part, CASE WHEN p_size >= 25 THEN 'large' ELSE 'small' END AS band FROM part")
_add("in_list", _answers(("customer",), "", '?c :c_mktsegment ?m . FILTER(?m IN ("BUILDING", "MACHINERY"))'), "SELECT DISTINCT c_custkey AS c, c_mktsegment AS m FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
_add("regex_replace", _derived(("part",), 'RULE { ?p :short ?v } WHERE { ?p :p_type ?t . FILTER(REGEX(?t, "^[A-M]", "i")) SET(?v := REPLACE(?t, "[AEIOU]", "")) }', "short", "part", "short"),
     "SELECT DISTINCT p_partkey AS part, regexp_replace(p_type, '[AEIOU]', '', 'g') AS short FROM part WHERE regexp_matches(p_type, '^[A-Ma-m]')")
_add("path_seq", _derived(("customer", "nation"), "RULE { ?c :inRegion ?r } WHERE { ?c :c_nationkey/:n_regionkey ?r }", "inRegion", "cust", "region"),
     "SELECT DISTINCT c_custkey AS cust, n_regionkey AS region FROM customer JOIN nation ON n_nationkey = c_nationkey")
_add("path_inverse", _derived(("nation", "supplier"), "RULE { ?r :supplied ?s } WHERE { ?r ^:n_regionkey/^:s_nationkey ?s }", "supplied", "region", "supp"),
     "SELECT DISTINCT n_regionkey AS region, s_suppkey AS supp FROM nation JOIN supplier ON s_nationkey = n_nationkey")
_add("symmetric", _derived(("supplier",), "RULE { ?a :near ?b } WHERE { ?a :s_nationkey ?b . } SYMMETRIC(:near)", "near", "a", "b"),
     "SELECT CAST(s_suppkey AS BIGINT) AS a, CAST(s_nationkey AS BIGINT) AS b FROM supplier UNION SELECT CAST(s_nationkey AS BIGINT), CAST(s_suppkey AS BIGINT) FROM supplier")
_add("inverse", _derived(("nation",), "RULE { ?n :within ?r } WHERE { ?n :n_regionkey ?r } INVERSE(:within, :contains)", "contains", "region", "nation"), "SELECT DISTINCT n_regionkey AS region, n_nationkey AS nation FROM nation")

_TREE = "RULE { ?c :parent ?p } WHERE { ?c :c_name ?n . FILTER(?c > 1) SET(?p := FLOOR(?c / 2)) }\n"
_TREE_SQL = "WITH RECURSIVE e AS (SELECT c_custkey AS s, c_custkey // 2 AS o FROM customer WHERE c_custkey > 1), t AS (SELECT s, o FROM e UNION SELECT t.s, e.o FROM t JOIN e ON e.s = t.o) SELECT s, o FROM t"
_add("transitive", _derived(("customer",), _TREE + "TRANSITIVE(:parent)", "parent", "s", "o"), _TREE_SQL)
_add("tc_tree", _derived(("customer",), _TREE + "RULE { ?x :above ?y } WHERE { ?x :parent ?y } RULE { ?x :above ?z } WHERE { ?x :above ?y . ?y :parent ?z }", "above", "s", "o"), _TREE_SQL)
_RING = "RULE { ?n :next ?m } WHERE { ?n :n_name ?x . SET(?m := FLOOR(?n - FLOOR(?n / 5) * 5 + 1)) }\n"
_add("reach_cycle", _derived(("nation",), _RING + "RULE { ?x :reach ?y } WHERE { ?x :next ?y } RULE { ?x :reach ?z } WHERE { ?x :reach ?y . ?y :next ?z }", "reach", "s", "o"),
     "WITH RECURSIVE e AS (SELECT n_nationkey AS s, CAST(n_nationkey % 5 + 1 AS BIGINT) AS o FROM nation), t AS (SELECT s, o FROM e UNION SELECT t.s, e.o FROM t JOIN e ON e.s = t.o) SELECT s, o FROM t")
_add("stratified_neg", _derived(("customer", "orders"), "RULE { ?c :active ?c } WHERE { ?o :o_custkey ?c ; :o_orderpriority \"1-URGENT\" ; :o_totalprice ?t . FILTER(?t > 100000) } RULE { ?c :dormant ?n } WHERE { ?c :c_nationkey ?n . NOT { ?c :active ?c } } RULE { ?n :lively ?x } WHERE { ?n :n_name ?x . NOT { ?c :dormant ?n } }".replace("?n :n_name ?x", "?d :c_nationkey ?n . ?d :c_mktsegment ?x"), "lively", "nation", "segment"),
     "WITH a AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000), d AS (SELECT c_custkey AS c, c_nationkey AS n FROM customer WHERE c_custkey NOT IN (SELECT c FROM a)) SELECT DISTINCT c_nationkey AS nation, c_mktsegment AS segment FROM customer WHERE c_nationkey NOT IN (SELECT n FROM d)")
_add("dominated_min", _derived(("part",), "RULE { ?p :dominated ?b } WHERE { ?p :p_brand ?b ; :p_retailprice ?x . ?q :p_brand ?b ; :p_retailprice ?y . FILTER(?y < ?x) } RULE { ?b :cheapest ?p } WHERE { ?p :p_brand ?b . NOT { ?p :dominated ?b } }", "cheapest", "brand", "part"),
     "SELECT DISTINCT p_brand AS brand, p_partkey AS part FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_brand = p.p_brand AND q.p_retailprice < p.p_retailprice)")
_add("multi_head", _answers(("supplier",), "RULE { ?s :kind :Supplier . ?s :at ?n } WHERE { ?s :s_nationkey ?n }", "?s :at ?n ; :kind :Supplier"), "SELECT DISTINCT s_suppkey AS s, s_nationkey AS n FROM supplier")
_add("query_projection", _answers(("orders",), "", "?o :o_orderpriority ?p ; :o_orderstatus ?st . FILTER(?o < 200)"), "SELECT DISTINCT o_orderkey AS o, o_orderpriority AS p, o_orderstatus AS st FROM orders WHERE o_orderkey < 200")
_add("query_projection_all", _answers(("orders",), "", "?o :o_orderpriority ?p ; :o_orderstatus ?st"), "SELECT DISTINCT o_orderkey AS o, o_orderpriority AS p, o_orderstatus AS st FROM orders")
_add("demand_slice", _answers(("customer",), _TREE + "RULE { ?x :above ?z } WHERE { ?x :parent ?z } RULE { ?x :above ?z } WHERE { ?x :above ?y . ?y :parent ?z } RULE { ?x :unused ?y } WHERE { ?x :c_nationkey ?y }", "?x :above ?y . FILTER(?x = 77)"),
     "WITH RECURSIVE e AS (SELECT c_custkey AS s, c_custkey // 2 AS o FROM customer WHERE c_custkey > 1), t AS (SELECT s, o FROM e WHERE s = 77 UNION SELECT t.s, e.o FROM t JOIN e ON e.s = t.o) SELECT s AS x, o AS y FROM t")


def hidden_helper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A helper that a rule computes for others isn't in the result."""
    program = HEAD + "RULE { ?p :half ?h } WHERE { ?p :p_size ?s . SET(?h := ?s / 2) } RULE { ?p :bulky ?b } WHERE { ?p :half ?h ; :p_brand ?b . FILTER(?h > 20) }"
    inferred = run(spark, program, store_of(spark, sf_dir, "part")).inferred()
    return inferred.groupBy(F.regexp_extract("p", "#(.*)>", 1).alias("predicate")).agg(F.count("*").alias("n"))


_add("hidden_helper", hidden_helper, "SELECT 'bulky' AS predicate, count(*) AS n FROM (SELECT DISTINCT p_partkey, p_brand FROM part WHERE p_size / 2.0 > 20) HAVING count(*) > 0")


def skolem_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One new node for each binding of the body."""
    result = run(spark, HEAD + "RULE { ?n :account _:a . _:a :owner ?n } WHERE { ?n :n_regionkey ?r }", store_of(spark, sf_dir, "nation"))
    return result.relation("<urn:table#account>").agg(F.countDistinct("o").alias("nodes"), F.countDistinct("s").alias("nations"))


_add("skolem_count", skolem_count, "SELECT count(DISTINCT n_nationkey) AS nodes, count(DISTINCT n_nationkey) AS nations FROM nation")


def var_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """?s ?p ?o over every predicate of a table."""
    found = query(spark, HEAD, "?s ?p ?o", store_of(spark, sf_dir, "region"))
    return found.groupBy(F.regexp_extract("p", "#(.*)>", 1).alias("predicate")).agg(F.count("*").alias("n"))


_add("var_predicate", var_predicate, "SELECT 'r_regionkey' AS predicate, count(*) AS n FROM region UNION ALL SELECT 'r_name', count(*) FROM region")


def taxonomy_chain(spark: SparkSession, sf_dir: str, depth: int = 100) -> DataFrame:
    """Rules of one shape as data: depth levels of types over the regions."""
    x = Var("x")
    c = lambda k: iri(f"urn:table#N{k}")
    rules = [Rule([Atom(x, TYPE, c(k + 1))], [Atom(x, TYPE, c(k))], f"level {k}") for k in range(depth)]
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.concat(F.lit("<urn:region#"), F.col("r_regionkey").cast("string"), F.lit(">")).alias("s"), F.lit(TYPE).alias("p"), F.lit(c(0)).alias("o"))
    store = Store(spark, graph=regions)
    result = run(spark, rules_as_data(Program(rules=rules), store), store)
    return result.inferred().where(F.col("p") == TYPE).select(F.regexp_extract("s", "#(.*)>", 1).cast("long").alias("region"), F.regexp_extract("o", "#N(.*)>", 1).cast("long").alias("level"))


_add("taxonomy_chain", taxonomy_chain, "SELECT CAST(r_regionkey AS BIGINT) AS region, CAST(k AS BIGINT) AS level FROM region, range(1, 101) t(k)")


def rdfs_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subclass inheritance: nations typed by their region, regions below :Place."""
    from ferrule.operators.entailment import rdfs_program

    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    term = lambda kind, col: F.concat(F.lit(f"<urn:{kind}#"), F.col(col).cast("string"), F.lit(">"))
    sub = "<http://www.w3.org/2000/01/rdf-schema#subClassOf>"
    graph = nation.select(term("nation", "n_nationkey").alias("s"), F.lit(TYPE).alias("p"), term("region", "n_regionkey").alias("o")).union(
        nation.select(term("region", "n_regionkey").alias("s"), F.lit(sub).alias("p"), F.lit("<urn:region#Place>").alias("o")).distinct()
    )
    result = run(spark, rdfs_program(), Store(spark, graph=graph))
    found = result.relation(TYPE).where("s like '<urn:nation#%' and o like '<urn:region#%'")
    return found.select(F.regexp_extract("s", "#(.*)>", 1).cast("long").alias("nation"), F.regexp_extract("o", "#(.*)>", 1).alias("class"))


_add("rdfs_types", rdfs_types, "SELECT CAST(n_nationkey AS BIGINT) AS nation, CAST(n_regionkey AS VARCHAR) AS class FROM nation UNION SELECT CAST(n_nationkey AS BIGINT), 'Place' FROM nation")


def msg_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as messages of a log each: offset in its log and the next envelope."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return messages.envelopes(turns, "conv_id", "turn").select("conv_id", "turn", "offset", F.coalesce("next_turn", F.lit(-1)).cast("long").alias("next_turn"))


_add("msg_envelopes", msg_envelopes, "SELECT conv_id, turn, CAST(row_number() OVER w AS BIGINT) AS \"offset\", CAST(coalesce(lead(turn) OVER w, -1) AS BIGINT) AS next_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
