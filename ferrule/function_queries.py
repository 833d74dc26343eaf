"""Further registered queries: builtin functions, readers and sinks, rule forms, messages and entailment, each with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule import terms as T
from ferrule.operators import compare, engine, entailment
from ferrule.operators.engine import Options, parse_any, query, run
from ferrule.plans.analyze import analyze
from ferrule.plans.compiler import path_relation
from ferrule.queries import HEAD, _add, _answers, _derived, store_of
from ferrule.sources import graphs, output
from ferrule.sources.catalog import Store
from ferrule.streaming import messages


def _values(name: str, tables: tuple[str, ...], body: str, columns: dict[str, str], sql: str, program: str = "", **options) -> None:
    """A query whose solutions are cast to the named types, in both forms."""

    def of(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = query(spark, HEAD + program, body, store_of(spark, sf_dir, *tables), Options(**options))
        return found.select(*[F.col(k).cast(t).alias(k) for k, t in columns.items()])

    kinds = {"long": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    _add(name, of, f"SELECT DISTINCT {', '.join(f'CAST({chr(34)}{k}{chr(34)} AS {kinds[t]}) AS {chr(34)}{k}{chr(34)}' for k, t in columns.items())} FROM ({sql})")


_C = ("customer",)
# strings
_values("fn_case_and_parts", _C, '?c :c_name ?n ; :c_mktsegment ?m . SET(?up := UCASE(?n)) SET(?low := LCASE(?m)) SET(?head := STRBEFORE(?n, "#")) SET(?tail := STRAFTER(?n, "#")) SET(?none := STRBEFORE(?n, "zz"))',
        {"c": "long", "up": "string", "low": "string", "head": "string", "tail": "string", "none": "string"},
        "SELECT c_custkey AS c, upper(c_name) AS up, lower(c_mktsegment) AS low, split_part(c_name, '#', 1) AS head, split_part(c_name, '#', 2) AS tail, '' AS none FROM customer")
_values("fn_string_tests", _C, '?c :c_name ?n ; :c_mktsegment ?m . SET(?has := CONTAINS(?n, "00")) SET(?st := STRSTARTS(?m, "B")) SET(?en := STRENDS(?n, "7")) SET(?len := STRLEN(?m)) SET(?t := STR(?c))',
        {"c": "long", "has": "boolean", "st": "boolean", "en": "boolean", "len": "long", "t": "string"},
        "SELECT c_custkey AS c, contains(c_name, '00') AS has, starts_with(c_mktsegment, 'B') AS st, suffix(c_name, '7') AS en, length(c_mktsegment) AS len, CAST(c_custkey AS VARCHAR) AS t FROM customer")
_values("fn_encode_for_uri", _C, '?c :c_mktsegment ?m . SET(?v := ENCODE_FOR_URI(CONCAT(?m, " & é/", STR(?c))))', {"c": "long", "v": "string"}, "SELECT c_custkey AS c, c_mktsegment || '%20%26%20%C3%A9%2F' || c_custkey AS v FROM customer")
_values("fn_utf16", _C, '?c :c_mktsegment ?m . SET(?s := CONCAT("😀", ?m)) SET(?len := STRLEN(?s)) SET(?sub := SUBSTR(?s, 3, 2)) SET(?all := SUBSTR(?s, 0))', {"c": "long", "len": "long", "sub": "string", "all": "string"},
        "SELECT c_custkey AS c, length(c_mktsegment) + 2 AS len, substr(c_mktsegment, 1, 2) AS sub, '😀' || c_mktsegment AS \"all\" FROM customer")
_values("fn_regex_flags", ("part",), '?p :p_type ?t . FILTER(REGEX(?t, "^[a-m].*$", "i")) SET(?v := REPLACE(?t, "([aeiou])", "<$1>", "i")) SET(?w := REPLACE(?t, "[A-Z]", "$&."))', {"p": "long", "v": "string", "w": "string"},
        r"SELECT p_partkey AS p, regexp_replace(p_type, '([aeiouAEIOU])', '<\1>', 'g') AS v, regexp_replace(p_type, '([A-Z])', '\1.', 'g') AS w FROM part WHERE regexp_matches(p_type, '^[A-Ma-m]')")
# numbers
_values("fn_numbers", _C, "?c :c_acctbal ?a . SET(?b := ABS(?a)) SET(?up := CEIL(?a)) SET(?dn := FLOOR(?a)) SET(?r := ROUND(?a)) SET(?neg := -?a) SET(?pos := +?a)",
        {"c": "long", "b": "double", "up": "long", "dn": "long", "r": "long", "neg": "double", "pos": "double"},
        "SELECT c_custkey AS c, abs(c_acctbal) AS b, ceil(c_acctbal) AS up, floor(c_acctbal) AS dn, floor(c_acctbal + 0.5::DOUBLE) AS r, -c_acctbal AS neg, c_acctbal AS pos FROM customer")
_values("fn_big_integers", ("nation",), "?n :n_regionkey ?r . ?n :big ?x . SET(?y := ?x * ?x - ?n) SET(?v := STR(?y)) SET(?more := ?y > ?x)", {"n": "long", "v": "string", "more": "boolean"},
        "SELECT n_nationkey AS n, CAST(CAST(81129638414606699710187514626049 AS HUGEINT) - n_nationkey AS VARCHAR) AS v, true AS more FROM nation",
        'RULE { ?n :big ?x } WHERE { ?n :n_name ?m . SET(?x := STRDT("9007199254740993", xsd:integer)) }')
_values("op_logic", ("part",), '?p :p_size ?s ; :p_brand ?b . FILTER(!(?s < 10) && (?s <= 20 || ?b = "Brand#11") && !(?s != 15 && ?s > 40))', {"p": "long", "s": "long", "b": "string"},
        "SELECT p_partkey AS p, p_size AS s, p_brand AS b FROM part WHERE NOT p_size < 10 AND (p_size <= 20 OR p_brand = 'Brand#11') AND NOT (p_size <> 15 AND p_size > 40)")
_values("op_not_in", ("part",), "?p :p_size ?s . FILTER(?s NOT IN (1, 2, 3, 5, 8) && ?s IN (?p, 4, 13))", {"p": "long", "s": "long"}, "SELECT p_partkey AS p, p_size AS s FROM part WHERE p_size NOT IN (1, 2, 3, 5, 8) AND p_size IN (p_partkey, 4, 13)")
# dates
_values("fn_dates", ("orders",), "?o :o_orderdate ?d . SET(?y := YEAR(?d)) SET(?m := MONTH(?d)) SET(?dd := DAY(?d)) SET(?h := HOURS(?d)) SET(?mi := MINUTES(?d)) SET(?s := SECONDS(?d)) SET(?z := TZ(?d))",
        {"o": "long", "y": "long", "m": "long", "dd": "long", "h": "long", "mi": "long", "s": "double", "z": "string"},
        "SELECT o_orderkey AS o, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, hour(o_orderdate) AS h, minute(o_orderdate) AS mi, second(o_orderdate) AS s, 'Z' AS z FROM orders")
_values("fn_event_times", ("events",), "?e :ts ?t ; :user_id ?u . SET(?h := HOURS(?t)) SET(?mi := MINUTES(?t)) FILTER(?h >= 6 && ?h < 18)", {"e": "long", "h": "long", "mi": "long", "u": "long"},
        "SELECT event_id AS e, hour(ts) AS h, minute(ts) AS mi, user_id AS u FROM events WHERE hour(ts) >= 6 AND hour(ts) < 18")
_values("fn_timezone", ("nation",), '?n :n_regionkey ?r . SET(?d := CONCAT("2024-03-05T10:20:30.5+0", STR(?r), ":30")) SET(?z := STR(TIMEZONE(?d))) SET(?tz := TZ(?d)) SET(?s := SECONDS(?d)) SET(?no := STR(TIMEZONE("2024-03-05Z")))',
        {"n": "long", "z": "string", "tz": "string", "s": "double", "no": "string"},
        "SELECT n_nationkey AS n, 'PT' || CASE WHEN n_regionkey > 0 THEN n_regionkey || 'H' ELSE '' END || '30M' AS z, '+0' || n_regionkey || ':30' AS tz, 30.5 AS s, 'PT0S' AS no FROM nation")
_values("fn_now", ("region",), "?r :r_name ?n . SET(?y := YEAR(NOW())) SET(?t := STR(NOW()))", {"r": "long", "y": "long", "t": "string"}, "SELECT r_regionkey AS r, 2024 AS y, '2024-05-06T07:08:09.123Z' AS t FROM region", now="2024-05-06T07:08:09.123Z")


def now_of_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the option NOW() is the time of the run, one for all rows."""
    found = query(spark, HEAD, "?r :r_name ?n . SET(?t := STR(NOW()))", store_of(spark, sf_dir, "region"))
    near = F.abs(F.unix_timestamp(F.substring("t", 1, 19), "yyyy-MM-dd'T'HH:mm:ss") - F.unix_timestamp()) < 86_400
    return found.agg(F.countDistinct("t").alias("times"), F.min(near).alias("near"))


_add("fn_now_of_run", now_of_run, "SELECT CAST(1 AS BIGINT) AS times, true AS near")
# languages, datatypes, kinds of terms
_values("fn_languages", _C, '?c :c_mktsegment ?m . SET(?t := STRLANG(?m, "EN-gb")) SET(?d := STRLANGDIR(?m, "ar", "rtl")) SET(?l := LANG(?t)) SET(?ld := LANGDIR(?d)) SET(?mt := LANGMATCHES(?l, "en")) SET(?any := LANGMATCHES(LANG(?m), "*")) SET(?hl := hasLANG(?t)) SET(?hd := hasLANGDIR(?t)) SET(?hdd := hasLANGDIR(?d)) SET(?s := STR(?t))',
        {"c": "long", "l": "string", "ld": "string", "mt": "boolean", "any": "boolean", "hl": "boolean", "hd": "boolean", "hdd": "boolean", "s": "string", "t": "string"},
        """SELECT c_custkey AS c, 'en-gb' AS l, 'rtl' AS ld, true AS mt, false AS "any", true AS hl, false AS hd, true AS hdd, c_mktsegment AS s, '"' || c_mktsegment || '"@en-gb' AS t FROM customer""")  # fmt: skip
_values("fn_datatypes", _C, '?c :c_name ?n . SET(?t := STRDT(STR(?c), xsd:int)) SET(?dt := STR(DATATYPE(?t))) SET(?dc := STR(DATATYPE(?c))) SET(?dl := STR(DATATYPE(STRLANG(?n, "de")))) SET(?num := isNUMERIC(?c)) SET(?nn := isNUMERIC(?n)) SET(?v := STR(?t))',
        {"c": "long", "dt": "string", "dc": "string", "dl": "string", "num": "boolean", "nn": "boolean", "v": "string"},
        f"SELECT c_custkey AS c, '{T.XSD}int' AS dt, '{T.INTEGER}' AS dc, '{T.RDF}langString' AS dl, true AS num, false AS nn, CAST(c_custkey AS VARCHAR) AS v FROM customer")
_values("fn_term_tests", _C, '?c :c_name ?n . SET(?i := IRI(CONCAT("http://t/", STR(?c)))) SET(?b := BNODE(STR(?c))) SET(?ii := isIRI(?i)) SET(?iu := isURI(?b)) SET(?ib := isBLANK(?b)) SET(?il := isLITERAL(?n)) SET(?ln := isLITERAL(?i)) SET(?it := isTRIPLE(<<( ?i :p ?c )>>)) SET(?same := sameTerm(?i, IRI(CONCAT("http://t/", STR(?c))))) SET(?u := STR(URI(CONCAT("../x/", STR(?c), "?q"))))',
        {"c": "long", "i": "string", "b": "string", "ii": "boolean", "iu": "boolean", "ib": "boolean", "il": "boolean", "ln": "boolean", "it": "boolean", "same": "boolean", "u": "string"},
        "SELECT c_custkey AS c, '<http://t/' || c_custkey || '>' AS i, '_:' || c_custkey AS b, true AS ii, false AS iu, true AS ib, true AS il, false AS ln, true AS it, true AS same, 'http://h/a/x/' || c_custkey || '?q' AS u FROM customer", base="http://h/a/b/c")
_values("fn_triple_terms", ("supplier",), '?s :s_nationkey ?n . SET(?t := TRIPLE(IRI(CONCAT("urn:s:", STR(?s))), :at, ?n)) SET(?a := STR(SUBJECT(?t))) SET(?b := STR(PREDICATE(?t))) SET(?o := STR(OBJECT(?t)))', {"s": "long", "a": "string", "b": "string", "o": "string"},
        "SELECT s_suppkey AS s, 'urn:s:' || s_suppkey AS a, 'urn:table#at' AS b, CAST(s_nationkey AS VARCHAR) AS o FROM supplier")


def triple_term_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts about facts, taken apart by a pattern with variables inside a triple term."""
    program = HEAD + "RULE { ?s :says <<( ?s :at ?n )>> } WHERE { ?s :s_nationkey ?n }"
    found = query(spark, program, "?s :says <<( ?who :at ?where )>>", store_of(spark, sf_dir, "supplier"))
    value = lambda c: F.regexp_extract(c, '"(.*)"', 1).cast("long")
    return found.select(F.col("s").cast("long").alias("s"), value("who").alias("who"), value("where").alias("place"))


_add("triple_term_patterns", triple_term_patterns, "SELECT DISTINCT s_suppkey AS s, s_suppkey AS who, CAST(s_nationkey AS BIGINT) AS place FROM supplier")


def drawn_uuids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UUIDs are drawn once for each row of the rule, and stay the same afterwards."""
    program = HEAD + "RULE { ?n :id ?u } WHERE { ?n :n_name ?x . SET(?u := STRUUID()) } RULE { ?n :urn ?u } WHERE { ?n :n_name ?x . SET(?u := UUID()) }"
    result = run(spark, program, store_of(spark, sf_dir, "nation"))
    ids, urns = result.relation("<urn:table#id>"), result.relation("<urn:table#urn>")
    hex_ = "[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}"
    again = ids.join(result.relation("<urn:table#id>"), ["s", "o"]).count()
    return ids.where(F.col("o").rlike(f"^{hex_}$")).agg(F.countDistinct("o").alias("ids")).crossJoin(urns.where(F.col("o").rlike(f"^<urn:uuid:{hex_}>$")).agg(F.countDistinct("o").alias("urns"))).withColumn("stable", F.lit(again).cast("long"))


_add("fn_uuids", drawn_uuids, "SELECT count(*) AS ids, count(*) AS urns, count(*) AS stable FROM nation")
_values("custom_function", ("region",), "?r :r_name ?n . SET(?v := STR(<urn:f#twice>(?n)))", {"r": "long", "v": "string"}, "SELECT r_regionkey AS r, r_name || r_name AS v FROM region",
        functions={"<urn:f#twice>": lambda t: F.concat(F.lit('"'), F.repeat(F.regexp_extract(t, '"(.*)"', 1), 2), F.lit('"'))})
_PUZZLE = "530070000600195000098000060800060003400803001700020006060000280000419005000080079"
_SOLVED = "534678912672195348198342567859761423426853791713924856961537284287419635345286179"
_values("fn_sudoku", ("region",), f'?r :r_name ?n . SET(?v := <urn:f#sudoku>("{_PUZZLE}"))', {"r": "long", "v": "string"}, f"SELECT r_regionkey AS r, '{_SOLVED}' AS v FROM region")

# forms of rules
_add("if_then", _derived(_C, "IF { ?c :c_acctbal ?a . FILTER(?a < 0) } THEN { ?c :debtor ?a }", "debtor", "cust", "balance"), "SELECT DISTINCT c_custkey AS cust, c_acctbal AS balance FROM customer WHERE c_acctbal < 0")
_add("bind_form", _derived(("part",), "RULE { ?p :double ?v } WHERE { ?p :p_size ?s . BIND(?s * 2 AS ?v) }", "double", "part", "v"), "SELECT DISTINCT p_partkey AS part, p_size * 2 AS v FROM part")
_add("set_compares", _derived(("part",), "RULE { ?p :square ?q } WHERE { ?p :p_size ?s . ?q :p_size ?t . FILTER(?p = ?q) FILTER(?s * ?s = ?t * 3) }", "square", "part", "other"), "SELECT DISTINCT p_partkey AS part, p_partkey AS other FROM part WHERE p_size * p_size = p_size * 3")
_add("empty_body", _answers(("region",), "RULE { :all :limit 3 } WHERE { }", "?r :r_name ?n . :all :limit ?k . FILTER(?r < ?k)"), "SELECT DISTINCT r_regionkey AS r, r_name AS n, CAST(3 AS INTEGER) AS k FROM region WHERE r_regionkey < 3")
_add("run_once", _derived(("part",), "RULE { ?p :mark ?v } WHERE { ?p :p_size ?s . NOT { ?p :mark ?w } SET(?v := ?s + 1) }", "mark", "part", "v"), "SELECT DISTINCT p_partkey AS part, p_size + 1 AS v FROM part")
_add("not_with_path", _derived(("customer", "nation", "orders"), "RULE { ?c :quiet ?r } WHERE { ?c :c_nationkey/:n_regionkey ?r . NOT { ?c ^:o_custkey/:o_orderstatus \"F\" } }", "quiet", "cust", "region"),
     "SELECT DISTINCT c_custkey AS cust, n_regionkey AS region FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
_add("path_group", _derived(("customer", "nation", "orders"), "RULE { ?r :ordered ?o } WHERE { ?r ^(:o_custkey/(:c_nationkey/:n_regionkey)) ?o }", "ordered", "region", "ord"),
     "SELECT DISTINCT n_regionkey AS region, o_orderkey AS ord FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
_add("semi_join", _derived(("customer", "orders"), "RULE { ?n :served ?m } WHERE { ?c :c_nationkey ?n ; :c_mktsegment ?m . ?o :o_custkey ?c ; :o_orderstatus \"P\" }", "served", "nation", "segment"),
     "SELECT DISTINCT c_nationkey AS nation, c_mktsegment AS segment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
_add("intersect", _answers(("customer", "supplier"), "RULE { ?n :a ?n } WHERE { ?c :c_nationkey ?n } RULE { ?n :b ?n } WHERE { ?s :s_nationkey ?n ; :s_acctbal ?x . FILTER(?x > 5000) }", "?n :a ?n . ?n :b ?n"),
     "SELECT c_nationkey AS n FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
_add("lineitem_parts", _derived(("lineitem",), "RULE { ?p :cheap ?s } WHERE { ?l :l_partkey ?p ; :l_suppkey ?s ; :l_discount ?d ; :l_quantity ?q . FILTER(?d >= 0.05 && ?q < 24) }", "cheap", "part", "supp"),
     "SELECT DISTINCT l_partkey AS part, l_suppkey AS supp FROM lineitem WHERE l_discount >= 0.05 AND l_quantity < 24")
_add("lineitem_chain", _derived(("lineitem", "orders", "customer"), "RULE { ?s :soldTo ?n } WHERE { ?l :l_suppkey ?s ; :l_orderkey ?o ; :l_returnflag \"R\" . ?o :o_custkey ?c . ?c :c_nationkey ?n }", "soldTo", "supp", "nation"),
     "SELECT DISTINCT l_suppkey AS supp, c_nationkey AS nation FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_returnflag = 'R'")
_add("events_anti", _derived(("events",), "RULE { ?u :buys ?u } WHERE { ?e :user_id ?u ; :event_type \"purchase\" } RULE { ?u :looksOnly ?t } WHERE { ?e :user_id ?u ; :event_type ?t . NOT { ?u :buys ?u } }", "looksOnly", "usr", "kind"),
     "SELECT DISTINCT user_id AS usr, event_type AS kind FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
_add("embedding_labels", _answers(("embeddings",), "", "?v :label ?l . FILTER(?l < 3)"), "SELECT DISTINCT vec_id AS v, label AS l FROM embeddings WHERE label < 3")
_add("demand_right", _answers(_C, "RULE { ?c :up ?p } WHERE { ?c :c_name ?n . FILTER(?c > 1) SET(?p := FLOOR(?c / 2)) } RULE { ?x :over ?y } WHERE { ?x :up ?y } RULE { ?x :over ?z } WHERE { ?x :up ?y . ?y :over ?z }", "100 :over ?y"),
     "WITH RECURSIVE e AS (SELECT c_custkey AS s, c_custkey // 2 AS o FROM customer WHERE c_custkey > 1), t AS (SELECT s, o FROM e WHERE s = 100 UNION SELECT t.s, e.o FROM t JOIN e ON e.s = t.o) SELECT CAST(o AS BIGINT) AS y FROM t")


def variable_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A head with a variable predicate: triples whose predicate is no IRI are left out."""
    program = HEAD + 'RULE { ?n ?p ?r } WHERE { ?n :n_regionkey ?r . SET(?p := IF(?r < 2, IRI(CONCAT("urn:kind#", STR(?r))), "no iri")) }'
    found = run(spark, program, store_of(spark, sf_dir, "nation")).inferred()
    return found.groupBy(F.regexp_extract("p", "#(.*)>", 1).alias("kind")).agg(F.count("*").alias("n"))


_add("variable_heads", variable_heads, "SELECT CAST(n_regionkey AS VARCHAR) AS kind, count(*) AS n FROM nation WHERE n_regionkey < 2 GROUP BY 1")


def no_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, HEAD, store_of(spark, sf_dir, "region")).inferred().agg(F.count("*").alias("n"))


_add("no_rules", no_rules, "SELECT CAST(0 AS BIGINT) AS n")


def path_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a path, as a set."""
    store = store_of(spark, sf_dir, "customer", "nation")
    return path_relation(("inverse", ("seq", "<urn:table#c_nationkey>", "<urn:table#n_regionkey>")), store.scan).df.select(F.col("s").alias("region"), F.col("o").alias("cust"))


_add("path_pairs", path_pairs, "SELECT DISTINCT n_regionkey AS region, c_custkey AS cust FROM customer JOIN nation ON n_nationkey = c_nationkey")


def deep_taxonomy(spark: SparkSession, sf_dir: str, depth: int = 10_000) -> DataFrame:
    """A program of many rules of one shape, run as it is: depth levels with three heads each, over the nations."""
    names = lambda k: f"<urn:t#N{k}> , <urn:t#I{k}> , <urn:t#J{k}>"
    text = "\n".join(f"RULE {{ ?x a {names(k + 1)} }} WHERE {{ ?x a <urn:t#N{k}> }}" for k in range(depth))
    start = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("<urn:n#"), F.col("n_nationkey").cast("string"), F.lit(">")).alias("s"), F.lit(T.TYPE).alias("p"), F.lit("<urn:t#N0>").alias("o"))
    found = run(spark, text, Store(spark, graph=start)).inferred()
    return found.groupBy(F.regexp_extract("s", "#(.*)>", 1).cast("long").alias("nation"), F.regexp_extract("o", "#([NIJ])", 1).alias("kind")).agg(F.count("*").alias("n"), F.max(F.regexp_extract("o", "#[NIJ](.*)>", 1).cast("long")).alias("deepest"))


_add("deep_taxonomy", deep_taxonomy, "SELECT CAST(n_nationkey AS BIGINT) AS nation, kind, CAST(10000 AS BIGINT) AS n, CAST(10000 AS BIGINT) AS deepest FROM nation, (VALUES ('N'), ('I'), ('J')) t(kind)")

# readers, sinks, other front ends


def _folder(spark: SparkSession) -> str:
    return engine.shared_folder(spark) + f"/graph-{uuid.uuid4().hex}"


def _nation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("<urn:n#"), F.col("n_nationkey").cast("string"), F.lit(">"))
    text = F.concat(F.lit('"a\\"b\\\\\n\r'), F.col("n_name"), F.lit('"@en'))
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    region = F.concat(F.lit('"'), F.col("n_regionkey").cast("string"), F.lit(f'"^^<{T.INTEGER}>'))
    return nation.select(key.alias("s"), F.lit("<urn:p#name>").alias("p"), text.alias("o")).union(nation.select(key, F.lit("<urn:p#region>"), region))


def nquads_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written and read again, texts with quotes, backslashes and line ends included: nothing differs."""
    graph, path = _nation_graph(spark, sf_dir), _folder(spark)
    graphs.write_nquads(graph, path)
    again = graphs.read_ntriples(spark, path)
    return again.agg(F.count("*").alias("triples")).crossJoin(compare.difference(graph, again).agg(F.count("*").alias("other")))


_add("nquads_round_trip", nquads_round_trip, "SELECT 2 * count(*) AS triples, CAST(0 AS BIGINT) AS other FROM nation")


def turtle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turtle files, one for each region: prefixes, lists and blank nodes that are apart by file."""
    nation, path = spark.read.parquet(f"{sf_dir}/nation.parquet"), _folder(spark)
    item = F.concat(F.lit(":n"), F.col("n_nationkey").cast("string"))
    text = F.concat(F.lit("@prefix : <urn:t#> .\n[] :holds ( "), F.array_join(F.sort_array(F.collect_list(item)), " "), F.lit(" ) ; :size "), F.count("*").cast("string"), F.lit(" ."))
    nation.groupBy("n_regionkey").agg(text.alias("value")).repartition(5, "n_regionkey").select("value").write.text(path)
    store = Store(spark, graph=graphs.read_turtle(spark, path))
    found = query(spark, "PREFIX : <urn:t#>", "?g :holds/rdf:rest/rdf:first ?second ; :size ?k", store)
    value = lambda c, p: F.regexp_extract(c, p, 1).cast("long")
    return found.select(value("second", "#n(.*)>").alias("second"), value("k", '"(.*)"').alias("k"))


_add("turtle_files", turtle_files, "SELECT CAST(substr(list_sort(list('n' || n_nationkey))[2], 2) AS BIGINT) AS second, count(*) AS k FROM nation GROUP BY n_regionkey HAVING count(*) > 1")


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples as JSON lines, read again by Spark."""
    path = _folder(spark)
    output.write_json(_nation_graph(spark, sf_dir), path)
    rows = spark.read.json(path)
    return rows.where("p.value = 'urn:p#region'").select(F.regexp_extract("s.value", "#(.*)", 1).cast("long").alias("nation"), F.col("o.value").cast("long").alias("region"), F.col("o.type").alias("kind"))


_add("json_lines", json_lines, "SELECT CAST(n_nationkey AS BIGINT) AS nation, CAST(n_regionkey AS BIGINT) AS region, 'literal' AS kind FROM nation")


def compact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    output.write_lines(_nation_graph(spark, sf_dir).where("p like '%region>'"), path, {"n": "urn:n#", "p": "urn:p#"})
    return spark.read.text(path).select(F.col("value").alias("line"))


_add("compact_lines", compact_lines, "SELECT 'n:' || n_nationkey || ' p:region ' || n_regionkey || ' .' AS line FROM nation")
_ENCODED = """PREFIX : <urn:table#>
PREFIX srl: <http://www.w3.org/ns/shacl-rules#>
PREFIX shnex: <http://www.w3.org/ns/shacl-node-expr#>
PREFIX sparql: <http://www.w3.org/ns/sparql#>
:main srl:rules ( [
  srl:body ( [ srl:subject [ srl:varName "s" ] ; srl:predicate :s_acctbal ; srl:object [ srl:varName "b" ] ]
             [ srl:filter [ sparql:greater-than ( [ shnex:var "b" ] 4000 ) ] ]
             [ srl:assign [ srl:assignVar [ srl:varName "v" ] ; srl:assignValue [ sparql:add ( [ shnex:var "b" ] 1 ) ] ] ]
             [ srl:not ( [ srl:subject [ srl:varName "s" ] ; srl:predicate :s_nationkey ; srl:object 7 ] ) ] ) ;
  srl:head ( [ srl:subject [ srl:varName "s" ] ; srl:predicate :more ; srl:object [ srl:varName "v" ] ] ) ] ) .
:spare srl:rules () ."""


def encoded_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule set encoded as RDF, one of two in the document."""
    program = parse_any(_ENCODED, ruleset="<urn:table#main>")
    return run(spark, program, store_of(spark, sf_dir, "supplier")).relation("<urn:table#more>").select(F.col("s").alias("supp"), F.col("o").cast("double").alias("v"))


_add("encoded_rules", encoded_rules, "SELECT DISTINCT s_suppkey AS supp, s_acctbal + 1 AS v FROM supplier WHERE s_acctbal > 4000 AND s_nationkey <> 7")


def imported_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs that import each other are merged once."""
    texts = {"urn:lib": HEAD + "IMPORTS <urn:main> RULE { ?s :rich ?b } WHERE { ?s :s_acctbal ?b . FILTER(?b > 9000) }"}
    main = HEAD + "IMPORTS <urn:lib> RULE { ?n :hasRich ?s } WHERE { ?s :rich ?b ; :s_nationkey ?n }"
    texts["urn:main"] = main
    return run(spark, main, store_of(spark, sf_dir, "supplier"), Options(resolver=texts.__getitem__)).relation("<urn:table#hasRich>").toDF("nation", "supp")


_add("imported_rules", imported_rules, "SELECT DISTINCT s_nationkey AS nation, s_suppkey AS supp FROM supplier WHERE s_acctbal > 9000")


def rule_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis as rows: the layer of each rule, and what rules depend on."""
    program = parse_any(HEAD + "RULE { ?x :c ?y } WHERE { ?x :b ?y . NOT { ?x :a ?y } } RULE { ?x :a ?y } WHERE { ?x :p ?y } RULE { ?x :a ?z } WHERE { ?x :a ?y . ?y :a ?z } RULE { ?x :b ?y } WHERE { ?x :a ?y }")
    found = analyze(program)
    rows = [(i + 1, k, i in found.recursive, len(found.edges[i])) for k, layer in enumerate(found.layers) for i in layer]
    return spark.createDataFrame(rows, "rule int, layer int, recursive boolean, needs int")


_add("rule_layers", rule_layers, "SELECT * FROM (VALUES (1, 3, false, 3), (2, 0, false, 0), (3, 1, true, 2), (4, 2, false, 2)) t(rule, layer, recursive, needs)")


def rule_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule adds, by pass."""
    program = HEAD + "RULE { ?n :next ?m } WHERE { ?n :n_name ?x . FILTER(?n < 5) SET(?m := ?n + 1) } RULE { ?x :reach ?y } WHERE { ?x :next ?y } RULE { ?x :reach ?z } WHERE { ?x :reach ?y . ?y :next ?z }"
    rows = run(spark, program, store_of(spark, sf_dir, "nation"), Options(trace=True, hybrid=False)).trace
    return spark.createDataFrame([(r, k, n) for r, k, _, n in rows], "rule string, pass int, added long")


_add("rule_trace", rule_trace, "SELECT * FROM (VALUES ('rule 1', 0, CAST(5 AS BIGINT)), ('rule 2', 0, 5), ('rule 3', 0, 4), ('rule 3', 1, 3), ('rule 3', 2, 2), ('rule 3', 3, 1)) t(rule, pass, added)")

# messages


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log for each conversation: a message a turn, empty for turns of the system."""
    turn = F.concat(F.lit("\n_:m :turn "), F.col("turn").cast("string"), F.lit(" ; :role :"), F.col("role"), F.lit(" .\n"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("turn is not null and role rlike '^[a-z]+$'")
    body = F.when(F.col("turn") % 3 == 0, F.lit("\n")).otherwise(turn)
    texts = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", body.alias("b")))), lambda x: x["b"]).alias("t"))
    return texts.select("conv_id", F.concat(F.lit('VERSION "1.2-messages"\nPREFIX : <urn:t#>\n'), F.array_join("t", "MESSAGE")).alias("text"))


def message_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many logs at once: messages, empty ones and payload triples of each."""
    triples = messages.replay_logs(_logs(spark, sf_dir), "conv_id", include_facts=True)
    is_ = lambda name: F.col("p") == f"<{messages.LOG}{name}>"
    count = lambda c: F.count(F.when(c, 1))
    return triples.groupBy("log").agg(
        count(is_("envelope")).alias("messages"), count(is_("payloadKind") & F.col("o").endswith("#empty>")).alias("hollow"), count(is_("payloadTriple")).alias("payload"),
        count(is_("nextEnvelope")).alias("links"), F.countDistinct(F.when(F.col("p") == "<urn:t#turn>", F.col("s"))).alias("nodes"),
    ).withColumnRenamed("log", "conv_id")


_add("message_logs", message_logs, "SELECT conv_id, count(*) AS messages, count(*) FILTER (turn % 3 = 0) AS hollow, 2 * count(*) FILTER (turn % 3 <> 0) AS payload, count(*) - 1 AS links, count(*) FILTER (turn % 3 <> 0) AS nodes FROM conversations WHERE turn IS NOT NULL AND regexp_matches(role, '^[a-z]+$') GROUP BY conv_id")

# entailment


def _class_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    term = lambda kind, c: F.concat(F.lit(f"<urn:{kind}#"), F.col(c).cast("string"), F.lit(">"))
    facts = supplier.select(term("s", "s_suppkey").alias("s"), F.lit("<urn:p#in>").alias("p"), term("n", "s_nationkey").alias("o"))
    schema = [("<urn:p#in>", f"<{T.RDFS}domain>", "<urn:c#Firm>"), ("<urn:p#in>", f"<{T.RDFS}range>", "<urn:c#Land>"), ("<urn:p#in>", f"<{T.RDFS}subPropertyOf>", "<urn:p#at>"), ("<urn:c#Land>", f"<{T.RDFS}subClassOf>", "<urn:c#Place>")]
    return facts.union(graphs.from_triples(spark, schema))


def rdfs_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains, ranges, sub-properties and classes, with axioms: things by their classes, and what is inherited."""
    closed = entailment.closure(spark, _class_graph(spark, sf_dir))
    typed = closed.where(F.col("p") == T.TYPE).where("o like '<urn:c#%'").groupBy(F.regexp_extract("o", "#(.*)>", 1).alias("what")).agg(F.count("*").alias("n"))
    return typed.union(closed.where("p = '<urn:p#at>'").agg(F.lit("at").alias("what"), F.count("*").alias("n")))


_add("rdfs_inference", rdfs_inference, "WITH p AS (SELECT DISTINCT s_suppkey, s_nationkey FROM supplier) SELECT 'Firm' AS what, count(DISTINCT s_suppkey) AS n FROM p UNION ALL SELECT 'Land', count(DISTINCT s_nationkey) FROM p UNION ALL SELECT 'Place', count(DISTINCT s_nationkey) FROM p UNION ALL SELECT 'at', count(*) FROM p")


def entailment_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yes and no for patterns with existential nodes, values of literals and inconsistent graphs."""
    graph = graphs.from_triples(spark, [("<urn:a>", "<urn:v>", f'"1.0"^^<{T.DECIMAL}>'), ("<urn:p>", f"<{T.RDFS}range>", "<urn:C>"), ("<urn:a>", "<urn:p>", "<urn:b>")])
    bad = graphs.from_triples(spark, [("<urn:a>", "<urn:v>", f'"x"^^<{T.INTEGER}>')])
    clash = graphs.from_triples(spark, [("<urn:a>", T.TYPE, T.iri(T.INTEGER)), ("<urn:a>", T.TYPE, T.iri(T.BOOLEAN))])
    numbers, ask = [T.INTEGER, T.DECIMAL, T.BOOLEAN], entailment.entails
    rows = [
        ("blank", ask(spark, graph, [("_:x", "<urn:v>", "_:y")])),
        ("value", ask(spark, graph, [("<urn:a>", "<urn:v>", f'"01"^^<{T.INTEGER}>')], "simple", numbers)),
        ("value unknown", ask(spark, graph, [("<urn:a>", "<urn:v>", f'"01"^^<{T.INTEGER}>')])),
        ("range", ask(spark, graph, [("<urn:b>", T.TYPE, "<urn:C>")], "rdfs")),
        ("range simple", ask(spark, graph, [("<urn:b>", T.TYPE, "<urn:C>")])),
        ("property", ask(spark, graph, [("<urn:v>", T.TYPE, f"<{T.RDF}Property>")], "rdf")),
        ("literal", ask(spark, graph, [("_:l", T.TYPE, T.iri(T.DECIMAL))])),
        ("inconsistent", ask(spark, bad, [("<urn:q>", "<urn:q>", "<urn:q>")], "simple", numbers)),
        ("clash", ask(spark, clash, [("<urn:q>", "<urn:q>", "<urn:q>")], "simple", numbers)),
    ]
    return spark.createDataFrame(rows, "test string, yes boolean")


_add("entailment_tests", entailment_tests, "SELECT * FROM (VALUES ('blank', true), ('value', true), ('value unknown', false), ('range', true), ('range simple', false), ('property', true), ('literal', true), ('inconsistent', true), ('clash', true)) t(test, yes)")


def graph_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isomorphism of graphs with relabelled nodes, and of ones that differ in a single edge; their difference."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    node = lambda prefix, c: F.concat(F.lit(f"_:{prefix}"), F.col(c).cast("string"))
    of = lambda a, b, last: nation.select(node(a, "n_nationkey").alias("s"), F.lit("<urn:in>").alias("p"), node(b, "n_regionkey").alias("o")).union(graphs.from_triples(spark, [("<urn:x>", "<urn:y>", last)]))
    one, two, other = of("n", "r", "<urn:z>"), of("k", "m", "<urn:z>"), of("n", "r", "<urn:w>")
    moved = one.withColumn("o", F.when(F.col("s") == "_:n0", F.lit("_:r4")).otherwise(F.col("o")))
    rows = [("relabelled", compare.isomorphic(one, two), compare.difference(one, one).count()), ("ground", compare.isomorphic(one, other), compare.difference(one, other).count()), ("moved", compare.isomorphic(one, moved), compare.difference(one, moved).count())]
    return spark.createDataFrame(rows, "test string, same boolean, differ long")


_add("graph_comparison", graph_comparison, "SELECT 'relabelled' AS test, true AS same, CAST(0 AS BIGINT) AS differ UNION ALL SELECT 'ground', false, 2 UNION ALL SELECT 'moved', (SELECT n_regionkey = 4 FROM nation WHERE n_nationkey = 0), (SELECT CASE WHEN n_regionkey = 4 THEN 0 ELSE 2 END FROM nation WHERE n_nationkey = 0)")
