"""The rule engine on small graphs written for these tests."""

import pytest

from ferrule.lang.parser import ParseError, parse, parse_graph
from ferrule.operators.engine import Options, RuleError, compile_program, query, run
from ferrule.operators.entailment import entails
from ferrule.sources.graphs import format_triples, from_triples
from ferrule.streaming.messages import looks_like_log, replay
from ferrule.terms import number_text, parts, triple_term

P = "PREFIX : <http://t/>\n"
PREFIXES = {"": "http://t/"}


def lines(spark, program, **options):
    return format_triples(run(spark, P + program, options=Options(**options)).inferred(), PREFIXES)


def test_union_negation_and_layers(spark):
    program = """DATA { :a :kind :P . :b :kind :P . :b :off true . :c :kind :Q . }
    RULE { ?x :live true } WHERE { ?x :kind :P . NOT { ?x :off true } }
    RULE { ?x :live true } WHERE { ?x :kind :Q }
    RULE { ?x :dead true } WHERE { ?x :kind ?k . NOT { ?x :live true } }"""
    assert lines(spark, program) == [":a :live true .", ":b :dead true .", ":c :live true ."]


def test_declarations_and_recursion_on_a_cycle(spark):
    program = "DATA { :a :to :b . :b :to :c . :c :to :a . } TRANSITIVE(:to)"
    assert len(lines(spark, program)) == 6
    assert lines(spark, "DATA { :a :s :b . :a :i :c . } SYMMETRIC(:s) INVERSE(:i, :j)") == [":b :s :a .", ":c :j :a ."]


def test_paths_lists_and_triple_terms(spark):
    program = """DATA { :r :l ( 1 [ :k 2 ] ) . :x :says :y ~ :c {| :src :chat |} . << :z :says :w ~ :d >> :src :mail . }
    RULE { :t :first ?v } WHERE { :r :l/rdf:first ?v }
    RULE { :t :second ?v } WHERE { :r :l/rdf:rest/rdf:first/:k ?v }
    RULE { ?s :from ?o } WHERE { ?c rdf:reifies <<(?s :says ?x)>> ; :src ?o }"""
    assert [x for x in lines(spark, program) if ":t " in x or ":from" in x] == [":t :first 1 .", ":t :second 2 .", ":x :from :chat .", ":z :from :mail ."]


def test_expressions_on_terms(spark):
    program = """DATA { :a :n 5 ; :s "Héllo"@fr ; :d "2024-03-05T10:20:30+02:30"^^xsd:dateTime . }
    RULE { :o :sum ?v } WHERE { :a :n ?n . SET(?v := ?n / 2 + 1) }
    RULE { :o :up ?v } WHERE { :a :s ?s . SET(?v := CONCAT(UCASE(SUBSTR(?s, 1, 2)), "-", LANG(?s))) }
    RULE { :o :year ?v } WHERE { :a :d ?d . SET(?v := YEAR(?d)) }
    RULE { :o :tz ?v } WHERE { :a :d ?d . SET(?v := TZ(?d)) }
    RULE { :o :iri ?v } WHERE { :a :n ?n . SET(?v := IRI(CONCAT("http://t/n", STR(?n)))) }
    RULE { :o :in true } WHERE { :a :n ?n . FILTER(?n IN (4, 5.0) && !(?n < 3)) }
    RULE { :o :round ?v } WHERE { :a :n ?n . SET(?v := ROUND(0 - ?n / 2)) }"""
    assert lines(spark, program, hybrid=False) == [":o :in true .", ":o :iri :n5 .", ":o :round -2 .", ":o :sum 3.5 .", ':o :tz "+02:30" .', ':o :up "HÉ-fr" .', ":o :year 2024 ."]


def test_filters_in_negation_see_both_sides(spark):
    program = """DATA { :a :v 1 . :b :v 2 . :c :v 3 . }
    RULE { ?x :top true } WHERE { ?x :v ?n . NOT { ?y :v ?m . FILTER(?m > ?n) } }"""
    assert lines(spark, program) == [":c :top true ."]


def test_new_nodes_and_multiple_heads(spark):
    found = lines(spark, "DATA { :a :p :b . :c :p :d . } RULE { ?x :made _:n . _:n :of ?y } WHERE { ?x :p ?y }")
    assert len(found) == 4 and len({x.split()[2] for x in found if ":made" in x}) == 2


def test_query_uses_only_what_it_needs(spark):
    program = P + "DATA { :a :p :b . :b :p :c . } RULE { ?x :q ?y } WHERE { ?x :p ?y } RULE { ?x :q ?z } WHERE { ?x :q ?y . ?y :p ?z } RULE { ?x :z ?n } WHERE { ?x :p ?n }"
    assert [tuple(r) for r in query(spark, program, "?x :q ?y . FILTER(?x = :a)").orderBy("y").collect()] == [("<http://t/a>", "<http://t/b>"), ("<http://t/a>", "<http://t/c>")]
    assert query(spark, program, ":a :q :c").collect() == [(True,)] and query(spark, program, ":c :q :a").collect() == []


@pytest.mark.parametrize(
    ("program", "code"),
    [
        ("RULE { ?x :p ?y } WHERE { ?x :q ?z }", "unsafe-head-variable"),
        ("RULE { ?x :p 1 } WHERE { FILTER(?x > 1) ?x :q ?z }", "unbound-filter-variable"),
        ("RULE { ?x :a 1 } WHERE { ?x :k 1 . NOT { ?x :b 1 } } RULE { ?x :b 1 } WHERE { ?x :k 1 . NOT { ?x :a 1 } }", "unstratified-negation"),
    ],
)
def test_bad_programs(program, code):
    with pytest.raises(RuleError, match=code):
        compile_program(P + program)


def test_syntax_errors():
    for text in ("RULE { ?x :p ?y }", "DATA { ?x :p :y }", "SELECT ?x", 'RULE { } WHERE { FILTER(NOSUCH(1)) }'):
        with pytest.raises(ParseError):
            parse(P + text)


def test_imports_are_merged_once(spark):
    texts = {"http://m/b": P + "IMPORTS <http://m/c> DATA { :a :p :b . }", "http://m/c": P + "IMPORTS <http://m/b> RULE { ?x :q ?y } WHERE { ?x :p ?y }"}
    assert lines(spark, "IMPORTS <http://m/b>", resolver=texts.__getitem__) == [":a :q :b ."]


def test_messages():
    log = 'VERSION "1.2-messages"\nPREFIX : <http://t/>\n_:r :v 1 .\nMESSAGE\nMESSAGE\n_:r :v 2 .'
    assert looks_like_log(log)
    found = replay(log)
    assert sum(p.endswith("vocabulary#envelope>") for _, p, _ in found) == 3 and sum("empty" in o for _, _, o in found) == 1


def test_entailment(spark):
    graph = from_triples(spark, parse_graph("@prefix : <http://t/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . :C rdfs:subClassOf :D . :x a :C .")[0])
    typed = [("<http://t/x>", "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>", "<http://t/D>")]
    assert entails(spark, graph, typed, "rdfs") and not entails(spark, graph, typed)


def test_terms():
    assert [number_text(x) for x in (1.0, 0.5, 1e21, 1.5e-7, 123456789012345680.0)] == ["1", "0.5", "1e+21", "1.5e-7", "123456789012345680"]
    inner = triple_term("<a>", "<b>", '"x ) y"')
    assert parts(triple_term(inner, "<p>", "_:o")) == [inner, "<p>", "_:o"]
