"""Functions, demand, readers and comparison: registered queries against their SQL, and what SQL can't tell."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_entry import SF, rows

import ferrule.function_queries  # noqa: F401  registers its queries
from ferrule.functions.sudoku import solve
from ferrule.lang.parser import parse, parse_body, parse_graph
from ferrule.operators.compare import isomorphic
from ferrule.operators.engine import Options, RuleError, analyze, compile_program, query, run
from ferrule.plans import demand
from ferrule.queries import ORACLE_SQL, QUERIES
from ferrule.sources.catalog import Store
from ferrule.sources.graphs import format_triples, from_triples, read_ntriples, write_nquads
from ferrule.streaming.messages import replay, replay_logs

P = "PREFIX : <http://t/>\n"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "conversations")


@pytest.mark.parametrize(
    "name",
    ["fn_case_and_parts", "fn_utf16", "fn_regex_flags", "fn_numbers", "fn_big_integers", "fn_timezone", "fn_languages", "fn_datatypes", "fn_term_tests", "triple_term_patterns", "fn_uuids", "empty_body", "path_group", "semi_join", "lineitem_parts", "variable_heads", "turtle_files", "nquads_round_trip", "message_logs", "rule_trace", "demand_right", "symmetric"],
)
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert rows(tuple(r) for r in got.select(*[f"`{n}`" for n in names]).collect()) == rows(want)


def test_integers_of_any_length(spark):
    n = 123456789012345678901234567890
    program = P + f'DATA {{ :a :n "{n}"^^xsd:integer . }} RULE {{ :o :cube ?v }} WHERE {{ :a :n ?n . SET(?v := ?n * ?n * ?n - 1) }}'
    assert format_triples(run(spark, program, options=Options(wide_integers=True, hybrid=False)).inferred(), {"": "http://t/"}) == [f":o :cube {n**3 - 1} ."]
    assert format_triples(run(spark, program, options=Options(hybrid=False)).inferred(), {}) == []  # more than 38 digits: an error


def test_demand_keeps_to_what_is_asked():
    program = parse(P + "RULE { ?x :r ?y } WHERE { ?x :e ?y } RULE { ?x :r ?z } WHERE { ?x :r ?y . ?y :e ?z } RULE { ?x :all ?y } WHERE { ?x :r ?y }")
    asked = lambda body: demand.rewrite(program, analyze(program), parse_body(body, program.prefixes), True)
    changed, body, seeds = asked(":a :all ?y")
    assert seeds and all("demand" in r.head[0].p for r in changed.rules) and "demand" in body[0].p
    assert asked("?x :r ?y") is None and asked("?x ?p ?y") is None
    part, _, _ = asked(":a :all ?y . NOT { ?y :r :b }")  # :r is needed as a whole, :all only for :a
    heads = {r.head[0].p for r in part.rules}
    assert "<http://t/r>" in heads and "<http://t/all>" not in heads


def test_demand_gives_the_same_answers(spark):
    program = P + "DATA { " + " ".join(f":n{k} :e :n{k + 1} ." for k in range(12)) + " :n3 :e :n0 . } RULE { ?x :r ?y } WHERE { ?x :e ?y } RULE { ?x :r ?z } WHERE { ?x :e ?y . ?y :r ?z } RULE { ?x :far ?y } WHERE { ?x :r ?y . NOT { ?x :e ?y } }"
    for body in (":n9 :r ?y", "?x :r :n2", ":n0 :r :n12", ":n8 :far ?y", "?x :e ?y . ?y :r :n11 . FILTER(?x = :n5)"):
        answers = [sorted(map(tuple, query(spark, program, body, mode=m).collect())) for m in ("auto", "forward")]
        assert answers[0] == answers[1] and answers[0], body


def test_rejected_and_empty_programs(spark):
    with pytest.raises(RuleError, match="unstratified-negation"):
        compile_program(P + "RULE { ?x :made _:n } WHERE { ?x :p ?y . NOT { ?x :made ?z } }")
    with pytest.raises(RuleError, match="no fixpoint"):
        run(spark, P + "DATA { :a :n 1 . } RULE { ?x :n ?m } WHERE { ?x :n ?k . SET(?m := ?k + 1) }", options=Options(max_iterations=3))
    with pytest.raises(RuleError, match="recursive-assignment-rule"):
        compile_program(P + "RULE { ?x :n ?m } WHERE { ?x :n ?k . SET(?m := ?k + 1) }", Options(strict=True))


def test_quads_keep_line_ends(spark, tmp_path):
    graph = from_triples(spark, [("<urn:a>", "<urn:p>", '"x\ny\r\\\\n \\"q\\""'), ("_:b", "<urn:p>", '<<( <urn:a> <urn:p> "l\nm"@en )>>')])
    write_nquads(graph, str(tmp_path / "g"))
    assert sorted(map(tuple, read_ntriples(spark, str(tmp_path / "g")).collect())) == sorted(map(tuple, graph.collect()))


def test_isomorphism_of_cycles(spark):
    ring = lambda names: from_triples(spark, [(f"_:{a}", "<urn:e>", f"_:{b}") for a, b in zip(names, names[1:] + names[:1], strict=True)])
    two = ring(list("abc")).union(ring(list("def")))
    assert isomorphic(two, ring(list("uvw")).union(ring(list("xyz")))) and not isomorphic(two, ring(list("uvwxyz")))


def test_sudoku():
    assert solve("." * 80) is None and solve("11" + "." * 79) is None
    done = solve("." * 81)
    assert len(done) == 81 and solve(done) == done
    assert parse_graph('<a> <b> "01"^^<http://www.w3.org/2001/XMLSchema#integer> .', lexical=True)[0][0][2].startswith('"01"')


def rivals(spark, rows):
    return Store(spark).add_table("t", spark.createDataFrame(rows, "k long, g int, x double"), "k", "http://t/")


ODD = [(k, k % 2, float(k * 7 % 30)) for k in range(40)] + [(3, 0, 1.0), (3, 1, 30.0), (3, 1, 30.0), (4, None, 5.0), (5, 1, None), (None, 1, 50.0), (6, 0, float("nan"))]


def over(x, y):
    """x > y where nan is above all."""
    return x == x and y == y and x > y or x != x and y == y


def test_a_least_value_stands_for_all_pairs(spark):
    lower = "RULE { ?p :low ?g } WHERE { ?p :g ?g ; :x ?x . ?q :g ?g ; :x ?y . FILTER(?y < ?x) }"
    got = run(spark, P + lower, rivals(spark, ODD)).relation("<http://t/low>")
    rows = [r for r in ODD if None not in r]
    all_rows = [r for r in ODD if None not in r[1:]]  # as in SQL, rows without a key are rivals too
    assert {tuple(r) for r in got.collect()} == {(k, g) for k, g, x in rows if any(g == h and over(x, y) for _, h, y in all_rows)}
    assert "min(" in got._jdf.queryExecution().optimizedPlan().toString()
    top = run(spark, P + "RULE { ?p :top ?g } WHERE { ?p :g ?g ; :x ?x . NOT { ?q :g ?g ; :x ?y . FILTER(?x < ?y) } }", rivals(spark, ODD)).relation("<http://t/top>")
    assert {tuple(r) for r in top.collect()} == {(k, g) for k, g, x in rows if not any(g == h and over(y, x) for _, h, y in all_rows)}
    assert "max(" in top._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_one_group_are_dealt_over_tasks_and_met_once(spark):
    rule = "RULE { ?a :above ?b } WHERE { ?a :g ?g ; :x ?x . ?b :g ?g ; :x ?y . FILTER(?x > ?y) }"
    got = run(spark, P + rule, rivals(spark, ODD)).relation("<http://t/above>")
    rows = [r for r in ODD if None not in r]
    found = [tuple(r) for r in got.collect()]
    assert sorted(found) == sorted({(k, j) for k, g, x in rows for j, h, y in rows if g == h and over(x, y)})
    one = run(spark, P + rule, rivals(spark, [(k, 1, float(k)) for k in range(300)])).relation("<http://t/above>")
    assert one.count() == 300 * 299 // 2 and one.select(F.spark_partition_id()).distinct().count() >= 16


FORMS = {
    "right": "RULE { ?x :up ?y } WHERE { ?x :g ?y } RULE { ?x :up ?z } WHERE { ?y :g ?z . ?x :up ?y }",
    "left": "RULE { ?x :up ?y } WHERE { ?x :g ?y } RULE { ?x :up ?z } WHERE { ?x :g ?y . ?y :up ?z }",
    "self": "RULE { ?x :up ?y } WHERE { ?x :g ?y } TRANSITIVE(:up)",
}
TREE = [(k, (k - 1) // 2) for k in range(1, 30)] + [(30, 31), (31, 32), (32, 30), (33, 31), (34, 34), (35, None), (None, 3)]


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("edges", [TREE, [(b, a) for a, b in TREE], [*TREE, (7, 30), (8, 31), (7, 3), (7, 3)]], ids=["one successor", "one predecessor", "several"])
def test_closures_of_chains(spark, form, edges):
    store = Store(spark).add_table("t", spark.createDataFrame(edges, "k long, g long"), "k", "http://t/")
    got = [tuple(r) for r in run(spark, P + FORMS[form], store).relation("<http://t/up>").collect()]
    known = {e for e in edges if None not in e}
    while more := {(a, d) for a, b in known for c, d in known if b == c} - known:
        known |= more
    assert sorted(got) == sorted(known)


def test_passes_of_a_chain_are_the_logarithm_of_its_length(spark):
    store = Store(spark).add_table("t", spark.createDataFrame([(k, k + 1) for k in range(300)], "k int, g long"), "k", "http://t/")
    result = run(spark, P + FORMS["right"], store, Options(max_iterations=12))
    got = result.relation("<http://t/up>")
    assert got.count() == 300 * 301 // 2 and result.iterations <= 10 and dict(got.dtypes) == {"s": "int", "o": "bigint"}


def test_texts_of_terms_are_read_once_a_step(spark):
    plan = QUERIES["fn_datatypes"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert max(line.count("regexp_") for line in plan.splitlines()) <= 6 and "RepartitionByExpression" in plan
    program = 'RULE { ?k :v ?v } WHERE { ?k :s ?s . SET(?t := STRLANG(?s, "DE")) SET(?v := STR(?t)) } RULE { ?k :d ?d } WHERE { ?k :s ?s . SET(?d := STR(DATATYPE(?s))) }'
    texts = ["", "plain", 'a "quote"', "back\\slash", "line\nbreak", "<b>", "😀 é", '"', "\\"]
    store = Store(spark).add_table("t", spark.createDataFrame(list(enumerate(texts)), "k int, s string"), "k", "http://t/")
    result = run(spark, P + program, store)
    assert sorted(map(tuple, result.relation("<http://t/v>").collect())) == list(enumerate(texts))
    assert {r.o for r in result.relation("<http://t/d>").collect()} == {"http://www.w3.org/2001/XMLSchema#string"}


def test_logs_are_replayed_by_many_tasks(spark):
    text = 'VERSION "1.2-messages"\nPREFIX : <urn:t#>\n\n_:m :turn 1 .\nMESSAGE\n'
    logs = spark.range(200).select(F.col("id").alias("log"), F.lit(text).alias("text")).repartition(1)
    got = replay_logs(logs)
    assert got.groupBy("log").count().agg(F.min("count"), F.max("count"), F.count("*")).first() == (len(replay(text)),) * 2 + (200,)
    assert got.select(F.spark_partition_id()).distinct().count() >= 16
    assert got.where("s like '\\_:%'").groupBy("s").agg(F.countDistinct("log").alias("n")).where("n > 1").isEmpty()
