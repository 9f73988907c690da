"""Command line: lineage, tables, template, dissect and graph."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from lineora.config import Config, load_config, pick
from lineora.operators import graph as G
from lineora.operators.dissect import Dissector
from lineora.operators.lineage import Analyzer
from lineora.sources import diagrams, sinks
from lineora.sources.catalogs import CatalogError, catalogs
from lineora.sources.files import Corpus, format_schema, read_manifest, list_files, read_schema, read_sql
from lineora.template import TemplaterError, all_variables, templaters


def session() -> SparkSession:
    found = SparkSession.getActiveSession()
    if found is None:
        found = SparkSession.builder.appName("lineora").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        found.sparkContext.setLogLevel("ERROR")
    return found


def _text(path: str | None) -> str:
    if path:
        return read_sql(path)
    if sys.stdin.isatty():
        raise ValueError("No SQL: give a file or pipe the text in")
    return sys.stdin.read()


def _rendered(a: argparse.Namespace, c: Config, sql: str, path: str | None) -> str:
    name = pick(a.templater, c.templater, "none")
    own = c.templating.get("variables", {})
    return templaters.get(name).render(sql, all_variables(a.var or [], pick(a.vars_file, c.templating.get("variables_file")), own), path)


def _analyzer(a: argparse.Namespace, c: Config) -> Analyzer:
    schema = read_schema(x) if (x := pick(a.provide_schema, c.provide_schema)) else None
    return Analyzer(session(), _rendered(a, c, _text(a.file), a.file), pick(a.dialect, c.dialect, "spark"), bool(pick(a.no_star or None, c.no_star, False)), schema, file_path=a.file or "")


def _format(a: argparse.Namespace, c: Config) -> str:
    return pick(a.output_format, c.output_format, "text")


def lineage(a: argparse.Namespace, c: Config) -> str:
    if a.column and a.source_column:
        raise ValueError("--column and --source-column exclude each other")
    an = _analyzer(a, c)
    rows = an.lineage(pick(a.level, c.level, "column"), a.column, a.source_column, a.table).collect()
    for _, index, kind, reason, _ in an.skipped:
        print(f"Warning: query {index} ({kind}) skipped: {reason}", file=sys.stderr)
    return sinks.FORMATS["lineage"][_format(a, c)](rows)


def tables_overview(a: argparse.Namespace, c: Config) -> str:
    return sinks.FORMATS["tables"][_format(a, c)](_analyzer(a, c).tables(a.table).collect())


def _catalog(a: argparse.Namespace, c: Config):
    kind = pick(a.catalog_type, c.catalog_type)
    if not kind:
        return None
    made = catalogs.get(kind)
    if options := c.catalog.get(kind):
        made.configure(**options)
    return made


def tables_pull(a: argparse.Namespace, c: Config) -> str:
    names = sorted({r["table_name"] for r in _analyzer(a, c).tables(a.table).collect() if r["object_type"] != "CTE"})
    found = (_catalog(a, c) or catalogs.get("spark")).get_ddl_batch(names)
    folder = pick(a.ddl_folder, c.ddl_folder)
    if folder:
        Path(folder).mkdir(parents=True, exist_ok=True)
        for name, ddl in found.items():
            if not ddl.startswith("ERROR:"):
                (Path(folder) / f"{name}.sql").write_text(ddl, encoding="utf-8")
        return "\n".join(f"{n}: {'failed, ' + d if d.startswith('ERROR:') else 'written'}" for n, d in found.items())
    return "\n\n".join(f"-- {n}\n{d}" for n, d in found.items())


def _corpus(a: argparse.Namespace, c: Config) -> Corpus:
    out = Corpus(session(), pick(a.dialect, c.dialect, "spark"), bool(a.no_star), bool(getattr(a, "strict_schema", False)), lambda sql, path: _rendered(a, c, sql, path))
    if x := pick(a.provide_schema, c.provide_schema):
        out.schema = read_schema(x)
    if a.manifest:
        for path, dialect in read_manifest(a.manifest):
            out.add_file(path, dialect)
    for path in a.paths:
        out.add_files(list_files(path, a.glob, a.recursive))
    if not out.files:
        raise ValueError("No SQL files found")
    return out


def tables_scrape(a: argparse.Namespace, c: Config) -> str:
    return format_schema(_corpus(a, c).resolve_schema(_catalog(a, c)), pick(a.output_format, c.output_format, "text"))


def template(a: argparse.Namespace, c: Config) -> str:
    if a.list:
        return "\n".join(templaters.names())
    a.templater = pick(a.templater, c.templater, "jinja")
    return _rendered(a, c, _text(a.file), a.file)


def dissect(a: argparse.Namespace, c: Config) -> str:
    d = Dissector(session(), _rendered(a, c, _text(a.file), a.file), pick(a.dialect, c.dialect, "spark"))
    rows = d.components().collect()
    kind = _format(a, c)
    return sinks.dissection_json(rows, {s.index: s.sql for s in d.statements}) if kind == "json" else sinks.FORMATS["dissection"][kind](rows)


def graph_build(a: argparse.Namespace, c: Config) -> str:
    for flag in ("strict_schema", "catalog_type", "dump_schema"):
        if getattr(a, flag) and not a.resolve_schema:
            raise ValueError(f"--{flag.replace('_', '-')} requires --resolve-schema")
    corpus = _corpus(a, c)
    if a.resolve_schema:
        schema = corpus.resolve_schema(_catalog(a, c))
        if a.dump_schema:
            Path(a.dump_schema).write_text(format_schema(schema, pick(a.dump_schema_format, "text")), encoding="utf-8")
    built = corpus.graph(a.node_format)
    for path, why in corpus.skipped_files:
        print(f"Warning: {path} skipped: {why}", file=sys.stderr)
    return G.to_json(built)


def _load(path: str) -> G.Graph:
    return G.read_json(session(), path) if "://" in path else G.from_json(session(), read_sql(path))


def graph_merge(a: argparse.Namespace, c: Config) -> str:
    paths = [*a.paths, *(list_files(".", a.glob) if a.glob else [])]
    if not paths:
        raise ValueError("No graphs to merge")
    return G.to_json(G.merge(_load(p) for p in paths))


def graph_query(a: argparse.Namespace, c: Config) -> str:
    g = _load(a.graph)
    names, tables = ([a.upstream, a.downstream], False) if a.upstream or a.downstream else ([a.upstream_table, a.downstream_table], True)
    if sum(x is not None for x in (a.upstream, a.downstream, a.upstream_table, a.downstream_table)) != 1:
        raise ValueError("Give exactly one of --upstream, --downstream, --upstream-table, --downstream-table")
    result = G.related(g, names[0] or names[1], "upstream" if names[0] else "downstream", tables)
    if a.output_format in ("mermaid", "mermaid-markdown", "dot", "plotly"):
        return diagrams.render(a.output_format, diagrams.Picture.of_query(result, g), g)
    return sinks.FORMATS["related"][_format(a, c)](result, result.rows())


def graph_visualize(a: argparse.Namespace, c: Config) -> str:
    g = _load(a.graph)
    return diagrams.render(a.output_format or "mermaid", diagrams.Picture.of_graph(g), g)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lineora", description="SQL lineage and query structure on Spark")
    commands = top.add_subparsers(dest="command", required=True)

    def add(group, name: str, run, *what: str, formats: tuple[str, ...] = ("text", "json", "csv")):
        p = group.add_parser(name, help=run.__doc__)
        p.set_defaults(run=run)
        p.add_argument("-o", "--output-file")
        p.add_argument("-f", "--output-format", choices=formats)
        p.add_argument("--dialect")
        if "sql" in what:
            p.add_argument("file", nargs="?")
        if "paths" in what:
            p.add_argument("paths", nargs="*")
            p.add_argument("--manifest")
            p.add_argument("--glob", default="*.sql")
            p.add_argument("--recursive", action="store_true")
        if "sql" in what or "paths" in what:
            p.add_argument("--templater")
            p.add_argument("--var", action="append")
            p.add_argument("--vars-file")
            p.add_argument("--no-star", action="store_true")
            p.add_argument("--provide-schema")
            p.add_argument("--catalog-type")
        return p

    p = add(commands, "lineage", lineage, "sql")
    p.add_argument("--level", choices=("column", "table"))
    for flag in ("--column", "--source-column", "--table"):
        p.add_argument(flag)
    group = commands.add_parser("tables").add_subparsers(dest="sub", required=True)
    add(group, "overview", tables_overview, "sql").add_argument("--table")
    p = add(group, "pull", tables_pull, "sql")
    p.add_argument("--table")
    p.add_argument("--ddl-folder")
    add(group, "scrape", tables_scrape, "paths")
    add(commands, "template", template, "sql").add_argument("--list", action="store_true")
    add(commands, "dissect", dissect, "sql")
    group = commands.add_parser("graph").add_subparsers(dest="sub", required=True)
    p = add(group, "build", graph_build, "paths")
    p.add_argument("--node-format", default="qualified", choices=("qualified", "structured"))
    p.add_argument("--resolve-schema", action="store_true")
    p.add_argument("--strict-schema", action="store_true")
    p.add_argument("--dump-schema")
    p.add_argument("--dump-schema-format", choices=("text", "json", "csv"))
    p = add(group, "merge", graph_merge)
    p.add_argument("paths", nargs="*")
    p.add_argument("--glob")
    shapes = ("mermaid", "mermaid-markdown", "dot", "plotly")
    p = add(group, "query", graph_query, formats=("text", "json", "csv", *shapes))
    p.add_argument("graph")
    for flag in ("--upstream", "--downstream", "--upstream-table", "--downstream-table"):
        p.add_argument(flag, nargs="+")
    add(group, "visualize", graph_visualize, formats=shapes).add_argument("graph")
    return top


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    try:
        sinks.write_output(a.run(a, load_config()), a.output_file)
    except (ValueError, OSError, KeyError, CatalogError, TemplaterError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
