"""RDF and RDFS closure, consistency and entailment, as rules for the same engine and joins over its result."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule import terms as T
from ferrule.functions.expressions import Context
from ferrule.lang.parser import Atom, Program, parse
from ferrule.operators.engine import Options, run
from ferrule.plans.compiler import Compiler
from ferrule.sources.catalog import Store
from ferrule.sources.graphs import TRIPLE, from_triples
from ferrule.terms import Var

_RULES = """
RULE { ?p a rdf:Property } WHERE { ?s ?p ?o }
RULE { ?p a rdf:Property . ?c a rdfs:Class } WHERE { ?p rdfs:domain ?c }
RULE { ?p a rdf:Property . ?c a rdfs:Class } WHERE { ?p rdfs:range ?c }
RULE { ?p a rdf:Property . ?q a rdf:Property } WHERE { ?p rdfs:subPropertyOf ?q }
RULE { ?c a rdfs:Class . ?d a rdfs:Class } WHERE { ?c rdfs:subClassOf ?d }
RULE { ?x a ?c } WHERE { ?p rdfs:domain ?c . ?x ?p ?y }
RULE { ?y a ?c } WHERE { ?p rdfs:range ?c . ?x ?p ?y }
RULE { ?p rdfs:subPropertyOf ?r } WHERE { ?p rdfs:subPropertyOf ?q . ?q rdfs:subPropertyOf ?r }
RULE { ?p rdfs:subPropertyOf ?p } WHERE { ?p a rdf:Property }
RULE { ?x ?q ?y } WHERE { ?p rdfs:subPropertyOf ?q . ?x ?p ?y . FILTER(isIRI(?q)) }
RULE { ?c rdfs:subClassOf rdfs:Resource ; rdfs:subClassOf ?c } WHERE { ?c a rdfs:Class }
RULE { ?x a ?d } WHERE { ?c rdfs:subClassOf ?d . ?x a ?c }
RULE { ?c rdfs:subClassOf ?e } WHERE { ?c rdfs:subClassOf ?d . ?d rdfs:subClassOf ?e }
RULE { ?p rdfs:subPropertyOf rdfs:member } WHERE { ?p a rdfs:ContainerMembershipProperty }
RULE { ?p rdfs:subPropertyOf rdfs:member } WHERE { ?s ?p ?o . FILTER(REGEX(STR(?p), "^http://www.w3.org/1999/02/22-rdf-syntax-ns#_[1-9][0-9]*$")) }
RULE { ?d rdfs:subClassOf rdfs:Literal } WHERE { ?d a rdfs:Datatype }
"""

#: Names of the vocabulary and what the axioms say of them; members _1 to _10.
_PROPERTIES = "rdf:type rdf:subject rdf:predicate rdf:object rdf:first rdf:rest rdf:value rdfs:subClassOf rdfs:subPropertyOf rdfs:domain rdfs:range rdfs:label rdfs:comment rdfs:seeAlso rdfs:isDefinedBy rdfs:member"
_CLASSES = "rdfs:Resource rdfs:Class rdfs:Literal rdfs:Datatype rdf:Property rdf:List rdfs:ContainerMembershipProperty rdfs:Proposition"
_DATATYPES = "rdf:langString rdf:dirLangString rdf:XMLLiteral rdf:HTML rdf:JSON"
_SCHEMA = """
rdfs:Datatype rdfs:subClassOf rdfs:Class . rdfs:ContainerMembershipProperty rdfs:subClassOf rdf:Property . rdf:TripleTerm rdfs:subClassOf rdfs:Proposition . rdf:Proposition rdfs:subClassOf rdfs:Proposition .
rdfs:subClassOf rdfs:domain rdfs:Class ; rdfs:range rdfs:Class . rdfs:subPropertyOf rdfs:domain rdf:Property ; rdfs:range rdf:Property .
rdfs:domain rdfs:domain rdf:Property ; rdfs:range rdfs:Class . rdfs:range rdfs:domain rdf:Property ; rdfs:range rdfs:Class .
rdfs:member rdfs:domain rdfs:Resource ; rdfs:range rdfs:Resource . rdf:reifies a rdf:Property ; rdfs:domain rdfs:Resource ; rdfs:range rdfs:Proposition .
"""


def rdfs_program() -> Program:
    return parse(_RULES)


def axioms(regime: str, datatypes: Iterable[str] = ()) -> list[tuple[str, str, str]]:
    """Triples that hold in every graph of a regime: "simple", "rdf" or "rdfs"."""
    if regime == "simple":
        return []
    members = " ".join(f"rdf:_{k}" for k in range(1, 11))
    said = [f"{p} a rdf:Property ." for p in f"{_PROPERTIES} {members}".split()]
    if regime == "rdfs":
        said += [f"{c} a rdfs:Class ." for c in _CLASSES.split()] + [f"{d} a rdfs:Datatype ." for d in [*_DATATYPES.split(), *[f"<{d}>" for d in datatypes]]]
        said += [_SCHEMA, *[f"{m} a rdfs:ContainerMembershipProperty ; rdfs:subPropertyOf rdfs:member ." for m in members.split()]]
    return parse("DATA { " + "\n".join(said) + " }").data


def datatype_of(literal: str) -> str:
    _, datatype, lang = T._LITERAL.match(literal).groups()
    return datatype or (T.RDF + ("dirLangString" if "--" in lang else "langString") if lang else T.STRING)


def typed_terms(graph: DataFrame, regime: str) -> DataFrame:
    """(s, p, o): literals have their datatype, triple terms are propositions, reifiers stand for one."""
    proposition, triple_term, literal_class = T.iri(T.RDFS + "Proposition"), T.iri(T.RDF + "TripleTerm"), T.iri(T.RDFS + "Literal")

    def of(frames):
        for pdf in frames:
            out = []
            todo = [x for c in "spo" for x in pdf[c]]
            while todo:
                x = todo.pop()
                if x.startswith('"'):
                    out.append((x, T.TYPE, T.iri(datatype_of(x))))
                    if regime == "rdfs":
                        out.append((x, T.TYPE, literal_class))
                elif x.startswith("<<("):
                    out += [(x, T.TYPE, triple_term), (x, T.TYPE, proposition)]
                    todo += T.parts(x)
            out += [(x, T.TYPE, proposition) for k in pdf.index if pdf["p"][k] == T.REIFIES for x in (pdf["s"][k], pdf["o"][k])]
            yield pd.DataFrame(sorted(set(out)), columns=["s", "p", "o"])

    wanted = F.col("s").startswith("<<(") | F.col("s").startswith('"') | F.col("o").startswith("<<(") | F.col("o").startswith('"')
    return graph.select("s", "p", "o").where(wanted).mapInPandas(of, TRIPLE).distinct()


def closure(spark: SparkSession, graph: DataFrame, regime: str = "rdfs", datatypes: Iterable[str] = ()) -> DataFrame:
    """The graph with all that its regime adds."""
    start = graph.select("s", "p", "o").union(typed_terms(graph, regime)).union(from_triples(spark, axioms(regime, datatypes)))
    if regime == "rdf":
        start = start.union(graph.select(F.col("p").alias("s"), F.lit(T.TYPE).alias("p"), F.lit(T.iri(T.RDF + "Property")).alias("o")))
    if regime != "rdfs":
        return start.distinct()
    return run(spark, rdfs_program(), Store(spark, graph=start.distinct()), Options(hybrid=False)).closure()


def rdfs_closure(spark: SparkSession, graph: DataFrame) -> DataFrame:
    """Only what the rules add, without axioms."""
    return run(spark, rdfs_program(), Store(spark, graph=graph), Options(hybrid=False)).closure()


# values of literals
_INT = T.XSD + "int"
_SPACES = {T.INTEGER: "decimal", _INT: "decimal", T.DECIMAL: "decimal", T.XSD + "float": "float", T.DOUBLE: "double", T.STRING: "string", T.BOOLEAN: "boolean"} | {
    T.RDF + k: k for k in ("langString", "dirLangString", "XMLLiteral", "JSON")
}
_FORMS = {
    T.INTEGER: r"[+-]?[0-9]+", _INT: r"[+-]?[0-9]+", T.DECIMAL: r"[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)", T.BOOLEAN: "true|false|1|0",
    T.XSD + "float": r"[+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|INF)|NaN", T.DOUBLE: r"[+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|INF)|NaN",
}


def _well_formed(text: str) -> bool:
    """Is it well-formed content of an XML element?"""
    from xml.etree import ElementTree

    try:
        ElementTree.fromstring(f"<x>{text}</x>")
    except ElementTree.ParseError:
        return False
    return True


def valid(text: str, datatype: str) -> bool:
    if datatype == T.RDF + "XMLLiteral":
        return _well_formed(text)
    if datatype == T.RDF + "JSON":
        try:
            json.loads(text)
        except ValueError:
            return False
        return True
    if datatype in _FORMS and not re.fullmatch(_FORMS[datatype], text):
        return False
    return datatype != _INT or -(2**31) <= int(text) < 2**31


def _number(x: float) -> str:
    return "NaN" if x != x else repr(x)  # repr tells -0.0 from 0.0


def _json_value(x: object) -> str:
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return json.dumps(x)
    if isinstance(x, (int, float)):
        return _number(float(x))
    if isinstance(x, list):
        return "[" + ",".join(map(_json_value, x)) + "]"
    return "{" + ",".join(f"{json.dumps(k)}:{_json_value(x[k])}" for k in sorted(x)) + "}"


def value_of(term: str, datatypes: frozenset[str]) -> str:
    """A term that is the same for all literals of one value, as far as their datatypes are recognized."""
    if term.startswith("<<("):
        return T.triple_term(*[value_of(x, datatypes) for x in T.parts(term)])
    if not term.startswith('"'):
        return term
    datatype = datatype_of(term)
    quoted, _, lang = T._LITERAL.match(term).groups()
    text = re.sub(r"\\(.)", r"\1", quoted, flags=re.DOTALL)
    known = datatypes | ({T.INTEGER} if _INT in datatypes else frozenset())
    if lang or datatype not in known or not valid(text, datatype):
        return term if datatype != T.STRING else T.quoted(text)
    space = _SPACES.get(datatype)
    if space == "decimal":
        sign, whole, part = re.fullmatch(r"([+-]?)0*(\d*)\.?(\d*?)0*", text if "." in text else text + ".").groups()
        text = f"{'-' if sign == '-' and (whole or part) else ''}{whole or '0'}{'.' + part if part else ''}"
    elif space == "boolean":
        text = "true" if text in ("true", "1") else "false"
    elif space == "double":
        text = _number(float(text))
    elif space == "float":
        text = _number(struct.unpack("f", struct.pack("f", float(text)))[0])
    elif space == "JSON":
        text = _json_value(json.loads(text))
    return T.quoted(text) + f"^^<urn:value:{space or datatype}>" if space != "string" else T.quoted(text)


def with_values(graph: DataFrame, datatypes: frozenset[str]) -> DataFrame:
    def of(frames):
        for pdf in frames:
            yield pd.DataFrame({c: [value_of(x, datatypes) for x in pdf[c]] for c in "spo"})

    return graph.select("s", "p", "o").mapInPandas(of, TRIPLE).distinct()


def inconsistent(graph: DataFrame, datatypes: Iterable[str]) -> bool:
    """Has a (closed) graph an ill-typed literal, a thing of two disjoint datatypes, or one datatype below another?"""
    known = frozenset(datatypes) | ({T.INTEGER} if _INT in datatypes else frozenset())
    spark = graph.sparkSession

    def ill(frames):
        for pdf in frames:
            bad, todo = False, [x for c in "spo" for x in pdf[c]]
            while todo and not bad:
                x = todo.pop()
                if x.startswith("<<("):
                    todo += T.parts(x)
                elif x.startswith('"'):
                    quoted, datatype, _ = T._LITERAL.match(x).groups()
                    bad = datatype in known and not valid(re.sub(r"\\(.)", r"\1", quoted, flags=re.DOTALL), datatype)
            yield pd.DataFrame({"bad": [True] if bad else []}, dtype="bool")

    if not graph.select("s", "p", "o").mapInPandas(ill, "bad boolean").isEmpty():
        return True
    spaces = spark.createDataFrame([(T.iri(d), _SPACES[d]) for d in sorted(known) if d in _SPACES], "t string, space string")
    typed = graph.where(F.col("p") == T.TYPE).join(F.broadcast(spaces), F.col("o") == F.col("t")).select("s", "space")
    if not typed.groupBy("s").agg(F.min("space").alias("a"), F.max("space").alias("b")).where("a <> b").isEmpty():
        return True
    below = graph.where(F.col("p") == T.iri(T.RDFS + "subClassOf"))
    pairs = below.join(F.broadcast(spaces), F.col("s") == F.col("t")).select("o", F.col("space").alias("a")).join(F.broadcast(spaces), F.col("o") == F.col("t"))
    return not pairs.where("a <> space").isEmpty()


def entails(spark: SparkSession, graph: DataFrame, expected: list[tuple[str, str, str]], regime: str = "simple", datatypes: Iterable[str] = ()) -> bool:
    """Does graph entail the expected triples? Their blank nodes are existential: they are variables of a pattern that
    must have an answer. Literals compare by value; an inconsistent graph entails all."""
    known = frozenset(datatypes)
    facts = closure(spark, graph, regime, known)
    if known and inconsistent(facts, known):
        return True

    def term(t: str) -> object:
        if t.startswith("_:"):
            return Var("__b_" + t[2:])
        if t.startswith("<<(") and "_:" in t:
            return T.Nested(*map(term, T.parts(t)))
        return value_of(t, known)

    body = [Atom(*map(term, t)) for t in expected]
    return not body or not Compiler(Store(spark, graph=with_values(facts, known)), Context()).solutions(body).isEmpty()
