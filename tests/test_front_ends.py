"""Rule sets encoded as RDF, output forms and the command line."""

import json

import pytest

from ferrule.__main__ import main
from ferrule.lang.parser import ParseError, parse
from ferrule.lang.rdf_rules import looks_like_rules, parse_rules
from ferrule.operators.engine import query, run
from ferrule.sources.graphs import format_triples
from ferrule.sources.output import format_bindings, term_json

ENCODED = """PREFIX : <http://t/>
PREFIX srl: <http://www.w3.org/ns/shacl-rules#>
PREFIX shnex: <http://www.w3.org/ns/shacl-node-expr#>
PREFIX sparql: <http://www.w3.org/ns/sparql#>
:set a srl:RuleSet ;
  srl:data ( <<( :a :age 12 )>> [ srl:subject :b ; srl:predicate :age ; srl:object 40 ] <<( :c :age 50 )>> <<( :c :out true )>> ) ;
  srl:rules ( [
    srl:head ( [ srl:subject [ srl:varName "x" ] ; srl:predicate :next ; srl:object [ srl:varName "n" ] ] ) ;
    srl:body (
      [ srl:subject [ srl:varName "x" ] ; srl:predicate :age ; srl:object [ srl:varName "y" ] ]
      [ srl:filter [ sparql:greater-than ( [ shnex:var "y" ] 18 ) ] ]
      [ srl:assign [ srl:assignVar [ srl:varName "n" ] ; srl:assignValue [ sparql:add ( [ shnex:var "y" ] 1 1 ) ] ] ]
      [ srl:not ( [ srl:subject [ srl:varName "x" ] ; srl:predicate :out ; srl:object true ] ) ]
    ) ] ) .
:other srl:rules () ."""
TEXT = """PREFIX : <http://t/>
DATA { :a :age 12 . :b :age 40 . :c :age 50 . :c :out true . }
RULE { ?x :next ?n } WHERE { ?x :age ?y . FILTER(?y > 18) SET(?n := ?y + 1 + 1) NOT { ?x :out true } }"""


def test_encoded_rules_are_the_same_program(spark):
    found, told = parse_rules(ENCODED), parse(TEXT)
    assert looks_like_rules(ENCODED) and not looks_like_rules(TEXT)
    assert set(found.data) == set(told.data)
    assert found.rules[0].head == told.rules[0].head and found.rules[0].body == told.rules[0].body
    assert format_triples(run(spark, ENCODED).inferred(), {"": "http://t/"}) == [":b :next 42 ."]


def test_choice_of_rule_sets_and_errors():
    assert parse_rules(ENCODED, ruleset=":other").rules == []
    assert len(parse_rules(ENCODED, ruleset="<http://t/set>").rules) == 1
    for bad in (":x :y :z .", ":s a srl:RuleSet ; srl:rules ( [ srl:head () ] ) .", ":s a srl:RuleSet ; srl:data ( [ srl:subject [ srl:varName 'x' ] ; srl:predicate :p ; srl:object 1 ] ) ."):
        with pytest.raises(ParseError):
            parse_rules("PREFIX : <http://t/>\nPREFIX srl: <http://www.w3.org/ns/shacl-rules#>\n" + bad)


def test_terms_and_bindings(spark):
    assert term_json("<http://t/a>") == {"type": "iri", "value": "http://t/a"}
    assert term_json('"a\\"b"@en--ltr') == {"type": "literal", "value": 'a"b', "datatype": None, "lang": "en", "langDir": "ltr"}
    assert term_json('"9007199254740993"^^<http://www.w3.org/2001/XMLSchema#integer>')["value"] == "9007199254740993"
    assert term_json('<<( <a> <b> "1.5"^^<http://www.w3.org/2001/XMLSchema#decimal> )>>')["o"]["value"] == 1.5
    assert format_bindings(query(spark, TEXT, "?x :next ?n"), {"": "http://t/"}) == ["?n = 42; ?x = :b"]


def test_command_line(spark, tmp_path, capsys):
    rules, encoded = tmp_path / "r.srl", tmp_path / "r.ttl"
    rules.write_text(TEXT)
    encoded.write_text(ENCODED)
    for file in (rules, encoded):
        assert main([str(file)], spark) == 0
        assert capsys.readouterr().out == ":b :next 42 .\n"
    assert main([str(rules), "--query", "?x :next ?n"], spark) == 0
    assert capsys.readouterr().out == "?n = 42; ?x = :b\n"
    assert main([str(rules), "--json", "--all", "--stats"], spark) == 0
    out = capsys.readouterr()
    assert len(json.loads(out.out)["triples"]) == 5 and "rules 1" in out.err
    assert main([str(rules), "--check", "--deps"]) == 0
    assert "no rule dependencies" in capsys.readouterr().err
    (tmp_path / "bad.srl").write_text("PREFIX : <http://t/>\nRULE { ?x :p ?z } WHERE { ?x :q ?y }")
    (tmp_path / "main.srl").write_text(f"IMPORTS <{rules.as_uri()}>\n" + TEXT.splitlines()[0] + "\nRULE { ?x :older ?n } WHERE { ?x :next ?n }")
    assert main([str(tmp_path / "bad.srl")]) == 1 and "error" in capsys.readouterr().err
    assert main([str(tmp_path / "main.srl")], spark) == 0  # :next is a helper that :older asks for
    assert capsys.readouterr().out == ":b :older 42 .\n"
    assert main([str(tmp_path / "main.srl"), "--no-hybrid"], spark) == 0
    assert capsys.readouterr().out == ":b :next 42 .\n:b :older 42 .\n"
    assert main([str(tmp_path / "none.srl")]) == 1


def test_long_sums_stay_small(spark):
    terms = " + ".join(["?y"] + ["1"] * 8)
    text = f'PREFIX : <http://t/>\nDATA {{ :b :age 40 . :c :age "x" . }}\nRULE {{ ?x :sum ?n }} WHERE {{ ?x :age ?y SET(?n := {terms}) }}'
    assert format_triples(run(spark, text).inferred(), {"": "http://t/"}) == [":b :sum 48 .", ':c :sum "x11111111" .']
