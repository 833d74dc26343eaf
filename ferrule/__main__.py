"""Command line: run programs, ask queries, check and show dependencies (``python -m ferrule --help``)."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path
from urllib.parse import unquote, urlparse

from ferrule.lang.parser import ParseError, Program
from ferrule.plans.analyze import Analysis, analyze


def arguments(argv: list[str]) -> argparse.Namespace:
    a = argparse.ArgumentParser("ferrule", description="Rules over graphs and tables on Spark.")
    a.add_argument("files", nargs="*", help="programs, joined in order; none or -: standard input")
    for flag, text in (("all", "input and inferred triples"), ("json", "JSON output"), ("stats", "layers and passes, on standard error"), ("check", "analyse only"), ("strict", "warnings are errors"), ("deps", "dependencies of rules, on standard error"), ("trace", "what each rule adds in each pass, on standard error or in JSON"), ("no-hybrid", "keep helper predicates in the result"), ("no-imports", "leave imports out"), ("rdf-messages", "the input is a message log"), ("include-message-facts", "payloads of a message log are facts")):
        a.add_argument(f"--{flag}", action="store_true", help=text)
    a.add_argument("--query", help="a body pattern; its solutions are the output")
    a.add_argument("--query-file", help="a file with such a pattern")
    a.add_argument("--query-mode", choices=("auto", "backward", "forward"), default="auto")
    a.add_argument("--max-iterations", type=int, default=10_000)
    a.add_argument("--syntax", choices=("auto", "srl", "rdf"), default="auto")
    a.add_argument("--ruleset", help="the rule set of an RDF encoding to run")
    a.add_argument("--version", action="version", version="ferrule 0.1")
    return a.parse_args(argv)


def file_of(target: str) -> str:
    url = urlparse(target)
    if url.scheme != "file":
        raise ParseError(f"only file imports are read: {target}")
    return Path(unquote(url.path)).read_text()


def show_dependencies(program: Program, analysis: Analysis) -> list[str]:
    names = [r.name or f"rule {i + 1}" for i, r in enumerate(program.rules)]
    uses = [f"deps: {names[i]} -> {names[j]}" for i in sorted(analysis.edges) for j in sorted(analysis.edges[i])]
    return (uses or ["deps: no rule dependencies"]) + [f"deps: layer {k + 1}: {', '.join(names[i] for i in layer)}" for k, layer in enumerate(analysis.layers)]


def main(argv: list[str] | None = None, spark=None) -> int:
    """Exit status 1 for errors in the program or while it runs."""
    from ferrule.operators import engine
    from ferrule.sources.graphs import format_triples
    from ferrule.sources.output import format_bindings, to_json

    a = arguments(sys.argv[1:] if argv is None else argv)
    say = lambda text: print(text, file=sys.stderr)
    try:
        files = [f for f in a.files if f != "-"]
        source = "\n".join(Path(f).read_text() for f in files) if files else sys.stdin.read()
        base = Path(files[0]).resolve().as_uri() if len(files) == 1 else ""
        syntax = "messages" if a.rdf_messages else "rdf" if a.syntax == "auto" and base.endswith((".ttl", ".trig", ".nt", ".n3")) else a.syntax
        options = engine.Options(a.max_iterations, base=base, hybrid=not a.no_hybrid, trace=a.trace)
        program = engine.parse_any(source, base, syntax=syntax, ruleset=a.ruleset, include_facts=a.include_message_facts)
        if a.no_imports:
            program.imports = []
        prefixes = program.prefixes
        program = engine.resolve_imports(program, file_of)
        analysis = analyze(program, a.strict)
        for d in analysis.diagnostics:
            say(f"{d.severity}: {d.code}: {d.message}")
        if a.deps:
            for line in show_dependencies(program, analysis):
                say(line)
        if a.check and not analysis.diagnostics:
            say("ok")
        if a.check or analysis.errors:
            return int(bool(analysis.errors))
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("ferrule").getOrCreate()
        pattern = Path(a.query_file).read_text() if a.query_file else a.query
        if pattern is not None and not a.json:
            lines = format_bindings(engine.query(spark, program, pattern, None, options, a.query_mode), prefixes)
        else:
            result = engine.run(spark, program, None, options)
            triples = result.closure() if a.all else result.inferred()
            if a.json:
                asked = engine.query(spark, program, pattern, None, options, a.query_mode) if pattern is not None else None
                told = {"layers": [[program.rules[i].name for i in layer] for layer in analysis.layers], "edges": [[i, j] for i in sorted(analysis.edges) for j in sorted(analysis.edges[i])]} if a.deps else None
                lines = [to_json(triples, prefixes, base, result.iterations, analysis.diagnostics, asked, result.trace if a.trace else None, told)]
            else:
                lines = format_triples(triples, prefixes)
            for r, k, p, n in result.trace if a.trace and not a.json else []:
                say(f"trace: pass {k}: {r} added {n}{'' if p is None else ' to ' + p}")
            if a.stats:
                say(f"rules {len(program.rules)}, layers {len(analysis.layers)}, passes {result.iterations}")
        print("\n".join(lines))
        return 0
    except (ValueError, OSError) as error:
        say(f"error: {error}")
        return 1


if __name__ == "__main__":
    sys.exit(main())
