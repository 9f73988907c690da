"""The engine's registered queries and the SQL that gives the same rows.

Facts about SQL text are compared with VALUES worked out by hand from the text; component and graph queries run over the
test tables and are compared with independently written SQL.
"""

from __future__ import annotations

import contextlib
import io
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineora import workload
from lineora.functions.tables import fresh_path
from lineora.operators import graph as G
from lineora.operators.dissect import Dissector
from lineora.operators.lineage import Analyzer, schema_frame, usage_summary
from lineora.operators.resolve import SchemaResolutionError
from lineora.plans.split import preview
from lineora.sources import diagrams, files, sinks
from lineora.sources.catalogs import Catalog
from lineora.sources.files import Corpus
from lineora.template import MiniTemplater, all_variables

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def views(spark: SparkSession, sf_dir: str) -> None:
    for t in BASE_TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def analyzer(spark: SparkSession, sql: str = workload.SQL, **options) -> Analyzer:
    return Analyzer(spark, sql, file_path="workload.sql", **options)


def _items(df: DataFrame) -> DataFrame:
    return df.select("query_index", "output_name", "source_name")


def lineage_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(analyzer(spark).lineage())


def lineage_one_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(analyzer(spark).lineage(column="BIG_ORDERS.rn"))


def lineage_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(analyzer(spark).lineage(source_column="orders.o_totalprice"))


def lineage_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(analyzer(spark).lineage("table", table_filter="order"))


def skipped_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analyzer(spark)
    a.lineage_rows()
    return a.skipped_queries().select("query_index", "statement_type")


def table_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzer(spark).tables().select("query_index", "table_name", "usage", "object_type")


def table_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_summary(analyzer(spark).tables()).select("table_name", "usage", "statements")


def schema_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_frame(spark, analyzer(spark, "; ".join(workload.STATEMENTS[1:3])).extract_schema_only()).select("table_name", "column_name", "ordinal")


def star_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star over a table whose columns come from the table itself."""
    columns = spark.read.parquet(f"{sf_dir}/nation.parquet").columns
    a = analyzer(spark, "INSERT INTO copy SELECT n.*, r.r_name FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey", schema={"nation": dict.fromkeys(columns, "UNKNOWN")})
    return _items(a.lineage())


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Dissector(spark, workload.SQL).components().select("query_index", "component_index", "component_type", "name", "parent_index", "depth", "is_executable", F.array_join("dependencies", ";").alias("dependencies"), "location")


def _component(query: int, component: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir)
        return Dissector(spark, workload.SQL).execute(query, component)

    return run


def _construct(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """Run a construct as the main component of its dissection."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir)
        d = Dissector(spark, workload.CONSTRUCTS[name][0])
        main = next(r for r in d.rows() if r["component_type"] == "MAIN_QUERY")
        return d.execute(0, main["component_index"])

    return run


def statement_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, preview(s)) for i, s in enumerate(workload.STATEMENTS)], "query_index int, query_preview string")


# graphs: keys of the test tables as nodes, region -> nation -> customer -> orders


def key_graph(spark: SparkSession, sf_dir: str) -> G.Graph:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    link = lambda t, up, k, down, j: read(t).select(F.concat(F.lit(f"{up}."), F.col(k).cast("string")).alias("source_name"), F.concat(F.lit(f"{down}."), F.col(j).cast("string")).alias("output_name"), F.lit(t).alias("file_path"))
    rows = link("nation", "region", "n_regionkey", "nation", "n_nationkey").union(link("customer", "nation", "c_nationkey", "customer", "c_custkey")).union(link("orders", "customer", "o_custkey", "orders", "o_orderkey")).union(link("supplier", "nation", "s_nationkey", "supplier", "s_suppkey"))
    return G.graph_of(rows.withColumns({"query_index": F.lit(0), "item_index": F.lit(0)}))


_RELATED = ("identifier", "hops", "is_root", "is_leaf")


def graph_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.find_downstream(key_graph(spark, sf_dir), "region.0", with_paths=False).related.select(*_RELATED)


def graph_upstream_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = key_graph(spark, sf_dir)
    out = G.find_upstream(g, ["orders.1", "supplier.1"]).related
    return out.select(*_RELATED, F.array_join(F.transform("paths", lambda p: F.array_join(p, " -> ")), "; ").alias("paths"))


def graph_upstream_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.find_upstream_table(key_graph(spark, sf_dir), "supplier", with_paths=False).related.select(*_RELATED, "output_column")


def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(key_graph(spark, sf_dir)).groupBy("is_root", "is_leaf").agg(F.count("*").alias("n"))


def graph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = key_graph(spark, sf_dir)
    few = G.Graph(g.nodes.where(F.col("table").isin("region", "nation")), g.edges.where("file_path = 'nation'"))
    return G.merge([few, g]).nodes.groupBy("table").agg(F.count("*").alias("n"))


def graph_of_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Corpus(spark).add_text("workload.sql", workload.SQL).graph()
    return g.edges.select("source_node", "target_node", "query_index")


def graph_recursive_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.recursive_paths(key_graph(spark, sf_dir), "orders.1", "upstream").select("identifier", F.array_join("path", " <- ").alias("path"))


def graph_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.layers(key_graph(spark, sf_dir)).groupBy("layer").agg(F.count("*").alias("n"))


SHAPES = ";\n".join(workload.SHAPES)


def lineage_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(analyzer(spark, SHAPES).lineage())


def lineage_shapes_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(analyzer(spark, SHAPES).lineage("table")).drop("output_name")


def lineage_quoted_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(analyzer(spark, 'SELECT c_name AS "full name" FROM customer').lineage())


def shapes_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzer(spark, SHAPES).tables().select("query_index", "table_name", "usage", "object_type")


def shapes_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analyzer(spark, SHAPES)
    a.lineage_rows()
    return a.skipped_queries().select("query_index", "statement_type")


def statement_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(s.index, s.label) for s in analyzer(spark, SHAPES).statements], "query_index int, statement_type string")


def shapes_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Dissector(spark, SHAPES).components().select("query_index", "component_index", "component_type", "name", "is_executable", "location")


def component_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Dissector(spark, workload.SQL)
    found = {"named": d.named("SEGMENTS"), "of_type": d.of_type("scalar_subquery"), "executable": d.executable()}
    return spark.createDataFrame([(k, r["query_index"], r["component_index"]) for k, rows in found.items() for r in rows], "lookup string, query_index int, component_index int")


def star_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars over semi and anti joins take the columns of the left side only."""
    schema = {t: dict.fromkeys(spark.read.parquet(f"{sf_dir}/{t}.parquet").columns, "UNKNOWN") for t in ("region", "nation")}
    sql = "INSERT INTO s SELECT * FROM region r LEFT SEMI JOIN nation n ON n.n_regionkey = r.r_regionkey; INSERT INTO a SELECT * FROM nation n LEFT ANTI JOIN region r ON r.r_regionkey = n.n_regionkey"
    return _items(analyzer(spark, sql, schema=schema).lineage())


def schema_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that a query does not qualify over a join are errors in strict mode and left out otherwise."""
    texts = ("SELECT c_name FROM customer", "SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
    rows = []
    for i, sql in enumerate(texts):
        for strict in (False, True):
            try:
                found = Analyzer(spark, sql, strict_schema=strict).extract_schema_only()
                rows.append((i, strict, ",".join(f"{t}.{c}" for t in sorted(found) for c in sorted(found[t]))))
            except SchemaResolutionError:
                rows.append((i, strict, "error"))
    return spark.createDataFrame(rows, "statement int, strict boolean, columns string")


class _Files(Catalog):
    """DDL of the test tables from their Parquet schemas; region is not there."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def get_ddl(self, table: str) -> str:
        if table == "region":
            raise ValueError("no such table")
        fields = self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet").schema
        return f"CREATE TABLE {table} ({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in fields)})"


def catalog_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that no statement gives columns come from a catalog's DDL; what is known stays."""
    found = files.fill_schema(spark, {"supplier": {"s_name": "UNKNOWN"}}, ["nation", "region", "supplier"], _Files(spark, sf_dir))
    return spark.createDataFrame([(t, c) for t in found for c in found[t]], "table_name string, column_name string")


def corpus_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage of a folder of SQL files that Spark reads, with stars resolved over all files."""
    folder = fresh_path(spark, "sql")
    folder = folder if "://" in folder else f"file://{folder}"
    texts = [("1.sql", "CREATE VIEW v AS SELECT c_custkey, c_name FROM customer"), ("2.sql", "INSERT INTO copy SELECT * FROM v")]
    for name, sql in texts:
        spark.createDataFrame([(sql,)], "value string").coalesce(1).write.text(f"{folder}/{name}")
    corpus = Corpus(spark).add_directory(folder, "part-*", recursive=True)
    corpus.resolve_schema()
    return corpus.lineage().select("file_ordinal", "output_name", "source_name")


def sink_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV of lineage, tables and components, and the pairs of the JSON of lineage, line by line."""
    a = analyzer(spark, "; ".join(workload.STATEMENTS[1:3]))
    lineage = a.lineage().collect()
    pairs = [f"{x['output_name']}<{x['source_name']}" for q in json.loads(sinks.lineage_json(lineage))["queries"] for x in q["lineage"]]
    parts = {"lineage": sinks.lineage_csv(lineage).splitlines(), "tables": sinks.tables_csv(a.tables().collect()).splitlines(), "pairs": pairs}
    return spark.createDataFrame([(k, i, x) for k, lines in parts.items() for i, x in enumerate(lines)], "sink string, line int, text string")


def diagram_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrows of the Mermaid and DOT diagrams of a graph."""
    picture = diagrams.Picture.of_graph(Corpus(spark).add_text("w.sql", "; ".join(workload.STATEMENTS[1:3])).graph())
    arrows = {k: [x.strip() for x in diagrams.render(k, picture).splitlines() if mark in x] for k, mark in (("mermaid", "-->"), ("dot", "->"))}
    return spark.createDataFrame([(k, len(v)) for k, v in arrows.items()], "kind string, arrows int")


def schema_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemas written and read back in all three formats."""
    schema = {t: dict.fromkeys(spark.read.parquet(f"{sf_dir}/{t}.parquet").columns, files.UNKNOWN) for t in ("nation", "region")}
    rows = [(k, t, c) for k in ("json", "csv", "text") for t, cs in files.parse_schema(files.format_schema(schema, k), k).items() for c in cs]
    return spark.createDataFrame(rows, "format string, table_name string, column_name string")


def templated_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage of a templated statement; later variables win."""
    sql = "INSERT INTO {{ target }} SELECT {% for c in columns %}{{ c }}{% if not loop.last %}, {% endif %}{% endfor %} FROM {{ source | upper }}"
    rendered = MiniTemplater().render(sql, all_variables(["target=report"], None, {"target": "old", "source": "nation", "columns": ["n_name", "n_regionkey"]}))
    return _items(analyzer(spark, rendered).lineage())


def cli_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command line prints for the tables of the workload."""
    from lineora import cli

    out, old = io.StringIO(), sys.stdin
    sys.stdin = io.StringIO(workload.SQL)
    try:
        with contextlib.redirect_stdout(out):
            cli.main(["tables", "overview", "--output-format", "csv"])
    finally:
        sys.stdin = old
    return spark.createDataFrame([tuple(x.split(",")) for x in out.getvalue().split()[1:]], "query_index string, table_name string, usage string, object_type string")


def graph_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Corpus(spark).add_text("shapes.sql", SHAPES).graph()
    return g.nodes.groupBy("is_literal").agg(F.count("*").alias("n"))


def graph_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of a graph, each looked up by its name in other case."""
    g = Corpus(spark).add_text("workload.sql", "; ".join(workload.STATEMENTS[1:3])).graph()
    one = g.node("BIG_ORDERS.RN").select("identifier", F.col("table").alias("table_name"), F.col("column").alias("column_name"))
    return g.columns().join(one, "identifier", "left")


def graph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph written as JSON and read again by Spark; an edge without its node goes."""
    g = Corpus(spark).add_text("workload.sql", workload.SQL).graph()
    document = json.loads(G.to_json(g))
    document["edges"].append({"source_node": "nowhere.x", "target_node": "part.p_brand", "file_path": "f", "query_index": 0})
    path = fresh_path(spark, "graph")
    spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1).write.text(path)
    return G.read_json(spark, path).connected().edges.select("source_node", "target_node", "query_index")


def graph_multi_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies above two tables; hops are the fewest from any of their columns."""
    return G.find_upstream_table(key_graph(spark, sf_dir), ["supplier", "customer"], with_paths=False).related.select(*_RELATED, "output_column")


def month_chain(spark: SparkSession, sf_dir: str) -> G.Graph:
    """Each month with orders leads to the next."""
    months = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.date_format("o_orderdate", "yyyy-MM").alias("m")).distinct()
    by_month = Window.orderBy("m")  # a row for each month
    rows = months.select(F.concat(F.lit("month."), "m").alias("source_name"), F.concat(F.lit("month."), F.lead("m").over(by_month)).alias("output_name")).where("output_name is not null")
    return G.graph_of(rows.withColumns({"file_path": F.lit("m"), "query_index": F.lit(0), "item_index": F.lit(0)}))


def graph_long_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of up to 79 hops, listed whole."""
    g = month_chain(spark, sf_dir)
    last = g.nodes.agg(F.max("identifier")).first()[0]
    out = G.find_upstream(g, last).related
    return out.select("identifier", "hops", F.size("paths").alias("n_paths"), F.array_join(F.col("paths")[0], ">").alias("path"), "truncated")


def graph_limited_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a limit of hops the listing says where it stopped; hops stay exact."""
    return G.find_upstream(key_graph(spark, sf_dir), "orders.1", max_hops=1).related.select("identifier", "hops", F.size("paths").alias("n_paths"), "truncated")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (lineage_shapes, lineage_shapes_tables, lineage_quoted_alias, shapes_inventory, shapes_skipped, statement_types, shapes_components, component_lookups, star_semi_anti, schema_strict, catalog_fill, corpus_folder, sink_lines, diagram_lines, schema_files, templated_lineage, cli_tables, graph_literals, graph_columns, graph_json, graph_multi_table, graph_long_paths, graph_limited_paths, lineage_columns, lineage_one_column, lineage_reverse, lineage_tables, skipped_statements, table_inventory, table_usage, schema_inference, star_expansion, components, statement_previews, graph_downstream, graph_upstream_paths, graph_upstream_table, graph_degrees, graph_merge, graph_of_workload, graph_recursive_sql, graph_layers)
} | {
    "component_cte": _component(0, 0), "component_dependent_cte": _component(0, 1), "component_source_query": _component(0, 3), "component_union_branch": _component(3, 2), "component_merge_source": _component(4, 1), "component_subquery": _component(6, 1), "component_scalar_subquery": _component(6, 2), "component_main_query": _component(6, 0),
} | {f"construct_{name}": _construct(name) for name in workload.CONSTRUCTS}


def _values(columns: str, rows: str) -> str:
    return f"SELECT * FROM (VALUES {rows}) AS v({columns})"


_I = "query_index, output_name, source_name"
_KEYS = """WITH RECURSIVE e AS (
    SELECT DISTINCT 'region.' || n_regionkey AS s, 'nation.' || n_nationkey AS t FROM nation UNION SELECT 'nation.' || c_nationkey, 'customer.' || c_custkey FROM customer
    UNION SELECT 'customer.' || o_custkey, 'orders.' || o_orderkey FROM orders UNION SELECT 'nation.' || s_nationkey, 'supplier.' || s_suppkey FROM supplier),
nodes AS (SELECT s AS id FROM e UNION SELECT t FROM e),
ends AS (SELECT id, id NOT IN (SELECT t FROM e) AS is_root, id NOT IN (SELECT s FROM e) AS is_leaf FROM nodes)"""
_TOTALS = "SELECT o_custkey, ROUND(SUM(o_totalprice), 2) AS total, COUNT(*) AS n_orders FROM orders GROUP BY o_custkey"
_SEGMENTS = f"SELECT c.c_custkey, c.c_name, c.c_mktsegment, t.total, t.n_orders FROM customer c JOIN ({_TOTALS}) t ON c.c_custkey = t.o_custkey"
_PARTS = "SELECT l_partkey, COUNT(*) AS n FROM lineitem GROUP BY l_partkey"

ORACLES = {
    "statement_previews": "SELECT i AS query_index, CASE WHEN length(t) > 100 THEN substr(t, 1, 100) || '...' ELSE t END AS query_preview FROM (SELECT i, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS t FROM (VALUES " + ", ".join("({}, '{}')".format(i, s.replace("'", "''")) for i, s in enumerate(workload.STATEMENTS)) + ") v(i, s))",
    "lineage_columns": _values(_I, """
        (0, 'customer_report.c_name', 'customer.c_name'), (0, 'customer_report.c_mktsegment', 'customer.c_mktsegment'), (0, 'customer_report.total', 'orders.o_totalprice'),
        (1, 'big_orders.o_orderkey', 'orders.o_orderkey'), (1, 'big_orders.o_custkey', 'orders.o_custkey'), (1, 'big_orders.o_totalprice', 'orders.o_totalprice'),
        (1, 'big_orders.rn', 'orders.o_custkey'), (1, 'big_orders.rn', 'orders.o_orderkey'), (1, 'big_orders.rn', 'orders.o_totalprice'),
        (2, 'top_orders.o_orderkey', 'big_orders.o_orderkey'), (2, 'top_orders.o_custkey', 'big_orders.o_custkey'), (2, 'top_orders.o_totalprice', 'big_orders.o_totalprice'), (2, 'top_orders.rn', 'big_orders.rn'),
        (3, 'kind', '<literal: ''customer''>'), (3, 'kind', '<literal: ''supplier''>'), (3, 'supplier.name', 'customer.c_name'), (3, 'supplier.name', 'supplier.s_name'), (3, 'supplier.balance', 'customer.c_acctbal'), (3, 'supplier.balance', 'supplier.s_acctbal'),
        (4, 'nation_stats.k', 'nation.n_nationkey'), (4, 'nation_stats.n', 'n'),
        (6, 'part.p_brand', 'part.p_brand'), (6, 'top_quantity', 'lineitem.l_quantity'), (6, 'q.n', 'q.n')"""),
    "lineage_one_column": _values(_I, "(1, 'big_orders.rn', 'orders.o_custkey'), (1, 'big_orders.rn', 'orders.o_orderkey'), (1, 'big_orders.rn', 'orders.o_totalprice')"),
    "lineage_reverse": _values(_I, "(0, 'orders.o_totalprice', 'customer_report.total'), (1, 'orders.o_totalprice', 'big_orders.o_totalprice'), (1, 'orders.o_totalprice', 'big_orders.rn')"),
    "lineage_tables": _values(_I, """
        (0, 'query_result', 'customer AS c'), (0, 'query_result', 'customer_report'), (0, 'query_result', 'order_totals AS t'), (0, 'query_result', 'orders'), (0, 'query_result', 'segments'),
        (1, 'query_result', 'big_orders'), (1, 'query_result', 'orders'), (2, 'query_result', 'big_orders'), (2, 'query_result', 'top_orders')"""),
    "lineage_shapes": _values(_I, """
        (0, 'hot_orders.o_orderkey', 'orders.o_orderkey'), (0, 'hot_orders.o_totalprice', 'orders.o_totalprice'), (1, 'names.name', 'customer.c_name'), (1, 'names.n_name', 'nation.n_name'),
        (2, 'customer.c_custkey', 'customer.c_custkey'), (2, 'customer.c_acctbal', 'customer.c_acctbal'), (6, 'nation.n_name', 'nation.n_name'), (6, 'w.word', 'nation.n_name'),
        (7, 'supplier.who', 'customer.c_name'), (7, 'supplier.who', 'supplier.s_name'), (7, 'score', '<literal: 0>'), (7, 'score', '<literal: NULL>'), (8, 'customer.one', 'customer.c_name'), (8, 'customer.other', 'customer.c_name'),
        (9, 'customer.c_mktsegment', 'customer.c_mktsegment'), (9, 'usual', 'customer.c_nationkey'), (9, 'code', 'customer.c_mktsegment'), (10, 'kept.k', 'orders.o_orderkey'), (10, 'kept.v', 'orders.o_custkey'), (11, 'b.k', 'nation.n_regionkey')"""),
    "lineage_shapes_tables": _values("query_index, source_name", """
        (0, 'hot_orders'), (0, 'orders'), (1, 'customer AS c'), (1, 'names'), (1, 'nation AS n'), (2, 'customer'), (2, 'rich'), (6, 'nation AS n'), (7, 'customer'), (7, 'supplier'), (8, 'customer AS a'), (8, 'customer AS b'), (9, 'customer'),
        (10, 'customer AS c'), (10, 'kept'), (10, 'orders'), (11, 'a'), (11, 'b'), (11, 'nation'), (11, 'region AS r')"""),
    "lineage_quoted_alias": _values(_I, "(0, 'customer.full name', 'customer.c_name')"),
    "shapes_inventory": _values("query_index, table_name, usage, object_type", """
        (0, 'hot_orders', 'OUTPUT', 'TABLE'), (0, 'orders', 'INPUT', 'UNKNOWN'), (1, 'customer', 'INPUT', 'UNKNOWN'), (1, 'names', 'OUTPUT', 'TABLE'), (1, 'nation', 'INPUT', 'UNKNOWN'), (2, 'customer', 'INPUT', 'UNKNOWN'), (2, 'rich', 'OUTPUT', 'VIEW'),
        (3, 'names', 'OUTPUT', 'UNKNOWN'), (4, 'customer', 'INPUT', 'UNKNOWN'), (4, 'names', 'OUTPUT', 'UNKNOWN'), (5, 'names', 'OUTPUT', 'UNKNOWN'), (6, 'nation', 'INPUT', 'UNKNOWN'), (7, 'customer', 'INPUT', 'UNKNOWN'), (7, 'supplier', 'INPUT', 'UNKNOWN'),
        (8, 'customer', 'INPUT', 'UNKNOWN'), (9, 'customer', 'INPUT', 'UNKNOWN'), (10, 'customer', 'INPUT', 'UNKNOWN'), (10, 'kept', 'OUTPUT', 'UNKNOWN'), (10, 'orders', 'INPUT', 'UNKNOWN'), (11, 'a', 'INPUT', 'CTE'), (11, 'b', 'INPUT', 'CTE'), (11, 'nation', 'INPUT', 'UNKNOWN'), (11, 'region', 'INPUT', 'UNKNOWN')"""),
    "shapes_skipped": _values("query_index, statement_type", "(3, 'UPDATE'), (4, 'UPDATE'), (5, 'DELETE'), (12, 'TRUNCATE')"),
    "statement_types": _values("query_index, statement_type", "(0, 'CACHE TABLE'), (1, 'CREATE TABLE'), (2, 'CREATE VIEW'), (3, 'UPDATE'), (4, 'UPDATE'), (5, 'DELETE'), (6, 'SELECT'), (7, 'SELECT'), (8, 'SELECT'), (9, 'SELECT'), (10, 'INSERT'), (11, 'SELECT'), (12, 'TRUNCATE')"),
    "shapes_components": _values("query_index, component_index, component_type, name, is_executable, location", """
        (0, 0, 'MAIN_QUERY', NULL, true, 'Top-level SELECT'), (1, 0, 'TARGET_TABLE', 'names', false, 'CREATE TABLE'), (1, 1, 'SOURCE_QUERY', NULL, true, 'CREATE TABLE AS SELECT'), (2, 0, 'TARGET_TABLE', 'rich', false, 'CREATE VIEW'), (2, 1, 'SOURCE_QUERY', NULL, true, 'CREATE VIEW AS SELECT'),
        (6, 0, 'MAIN_QUERY', NULL, true, 'Top-level SELECT'), (7, 0, 'MAIN_QUERY', NULL, true, 'Top-level SELECT'), (7, 1, 'UNION_BRANCH', 'branch_0', true, 'UNION branch 0 of 2'), (7, 2, 'UNION_BRANCH', 'branch_1', true, 'UNION branch 1 of 2 (UNION)'),
        (8, 0, 'MAIN_QUERY', NULL, true, 'Top-level SELECT'), (9, 0, 'MAIN_QUERY', NULL, true, 'Top-level SELECT'), (10, 0, 'TARGET_TABLE', 'kept', false, 'INSERT INTO'), (10, 1, 'SOURCE_QUERY', NULL, true, 'INSERT source SELECT'), (10, 2, 'SUBQUERY', 'o', true, 'FROM clause in source query'),
        (11, 0, 'CTE', 'a', true, 'WITH clause'), (11, 1, 'CTE', 'b', true, 'WITH clause'), (11, 2, 'MAIN_QUERY', NULL, true, 'Top-level SELECT')"""),
    "component_lookups": _values("lookup, query_index, component_index", """
        ('named', 0, 1), ('of_type', 6, 2), ('executable', 0, 0), ('executable', 0, 1), ('executable', 0, 3), ('executable', 1, 1), ('executable', 2, 1), ('executable', 3, 0), ('executable', 3, 1), ('executable', 3, 2), ('executable', 4, 1), ('executable', 6, 0), ('executable', 6, 1), ('executable', 6, 2)"""),
    "star_semi_anti": _values(_I, "(0, 's.r_regionkey', 'region.r_regionkey'), (0, 's.r_name', 'region.r_name'), (1, 'a.n_nationkey', 'nation.n_nationkey'), (1, 'a.n_name', 'nation.n_name'), (1, 'a.n_regionkey', 'nation.n_regionkey')"),
    "schema_strict": _values("statement, strict, columns", "(0, false, 'customer.c_name'), (0, true, 'customer.c_name'), (1, false, ''), (1, true, 'error')"),
    "catalog_fill": _values("table_name, column_name", "('supplier', 's_name'), ('nation', 'n_nationkey'), ('nation', 'n_name'), ('nation', 'n_regionkey')"),
    "corpus_folder": _values("file_ordinal, output_name, source_name", "(0, 'v.c_custkey', 'customer.c_custkey'), (0, 'v.c_name', 'customer.c_name'), (1, 'copy.c_custkey', 'v.c_custkey'), (1, 'copy.c_name', 'v.c_name')"),
    "sink_lines": _values("sink, line, text", """
        ('lineage', 0, 'query_index,output_column,source_column'), ('lineage', 1, '0,big_orders.o_orderkey,orders.o_orderkey'), ('lineage', 2, '0,big_orders.o_custkey,orders.o_custkey'), ('lineage', 3, '0,big_orders.o_totalprice,orders.o_totalprice'),
        ('lineage', 4, '0,big_orders.rn,orders.o_custkey'), ('lineage', 5, '0,big_orders.rn,orders.o_orderkey'), ('lineage', 6, '0,big_orders.rn,orders.o_totalprice'),
        ('lineage', 7, '1,top_orders.o_orderkey,big_orders.o_orderkey'), ('lineage', 8, '1,top_orders.o_custkey,big_orders.o_custkey'), ('lineage', 9, '1,top_orders.o_totalprice,big_orders.o_totalprice'), ('lineage', 10, '1,top_orders.rn,big_orders.rn'),
        ('tables', 0, 'query_index,table_name,usage,object_type'), ('tables', 1, '0,big_orders,OUTPUT,VIEW'), ('tables', 2, '0,orders,INPUT,UNKNOWN'), ('tables', 3, '1,big_orders,INPUT,UNKNOWN'), ('tables', 4, '1,top_orders,OUTPUT,UNKNOWN'),
        ('pairs', 0, 'big_orders.o_orderkey<orders.o_orderkey'), ('pairs', 1, 'big_orders.o_custkey<orders.o_custkey'), ('pairs', 2, 'big_orders.o_totalprice<orders.o_totalprice'),
        ('pairs', 3, 'big_orders.rn<orders.o_custkey'), ('pairs', 4, 'big_orders.rn<orders.o_orderkey'), ('pairs', 5, 'big_orders.rn<orders.o_totalprice'),
        ('pairs', 6, 'top_orders.o_orderkey<big_orders.o_orderkey'), ('pairs', 7, 'top_orders.o_custkey<big_orders.o_custkey'), ('pairs', 8, 'top_orders.o_totalprice<big_orders.o_totalprice'), ('pairs', 9, 'top_orders.rn<big_orders.rn')"""),
    "diagram_lines": _values("kind, arrows", "('mermaid', 10), ('dot', 10)"),
    "schema_files": "SELECT f AS format, t AS table_name, c AS column_name FROM (VALUES ('json'), ('csv'), ('text')) a(f), (VALUES ('nation', 'n_nationkey'), ('nation', 'n_name'), ('nation', 'n_regionkey'), ('region', 'r_regionkey'), ('region', 'r_name')) b(t, c)",
    "templated_lineage": _values(_I, "(0, 'report.n_name', 'nation.n_name'), (0, 'report.n_regionkey', 'nation.n_regionkey')"),
    "graph_literals": _values("is_literal, n", "(true, 2), (false, 25)"),
    "graph_columns": _values("identifier, table_name, column_name", """
        ('big_orders.o_custkey', NULL, NULL), ('big_orders.o_orderkey', NULL, NULL), ('big_orders.o_totalprice', NULL, NULL), ('big_orders.rn', 'big_orders', 'rn'), ('orders.o_custkey', NULL, NULL), ('orders.o_orderkey', NULL, NULL), ('orders.o_totalprice', NULL, NULL),
        ('top_orders.o_custkey', NULL, NULL), ('top_orders.o_orderkey', NULL, NULL), ('top_orders.o_totalprice', NULL, NULL), ('top_orders.rn', NULL, NULL)"""),
    "graph_multi_table": f"""{_KEYS}, up AS (SELECT DISTINCT 'nation.' || s_nationkey AS n, 1 AS hops FROM supplier UNION SELECT DISTINCT 'nation.' || c_nationkey, 1 FROM customer UNION SELECT DISTINCT 'region.' || n_regionkey, 2 FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier UNION SELECT c_nationkey FROM customer))
        SELECT id AS identifier, hops, is_root, is_leaf, 'supplier, customer' AS output_column FROM ends JOIN up ON n = id""",
    "graph_long_paths": """WITH m AS (SELECT 'month.' || k AS id, row_number() OVER (ORDER BY k DESC) - 1 AS hops FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS k FROM orders))
        SELECT a.id AS identifier, CAST(a.hops AS INTEGER) AS hops, 1 AS n_paths, string_agg(b.id, '>' ORDER BY b.hops DESC) AS path, false AS truncated FROM m a JOIN m b ON b.hops <= a.hops WHERE a.hops > 0 GROUP BY ALL""",
    "graph_limited_paths": """SELECT 'customer.' || o_custkey AS identifier, 1 AS hops, 1 AS n_paths, false AS truncated FROM orders WHERE o_orderkey = 1
        UNION ALL SELECT 'nation.' || c_nationkey, 2, 0, true FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey = 1
        UNION ALL SELECT 'region.' || n_regionkey, 3, 0, true FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey = 1""",
    "skipped_statements": _values("query_index, statement_type", "(5, 'DROP TABLE')"),
    "table_inventory": _values("query_index, table_name, usage, object_type", """
        (0, 'customer', 'INPUT', 'UNKNOWN'), (0, 'customer_report', 'OUTPUT', 'UNKNOWN'), (0, 'order_totals', 'INPUT', 'CTE'), (0, 'orders', 'INPUT', 'UNKNOWN'), (0, 'segments', 'INPUT', 'CTE'),
        (1, 'big_orders', 'OUTPUT', 'VIEW'), (1, 'orders', 'INPUT', 'UNKNOWN'), (2, 'big_orders', 'INPUT', 'UNKNOWN'), (2, 'top_orders', 'OUTPUT', 'UNKNOWN'),
        (3, 'customer', 'INPUT', 'UNKNOWN'), (3, 'supplier', 'INPUT', 'UNKNOWN'), (4, 'customer', 'INPUT', 'UNKNOWN'), (4, 'nation', 'INPUT', 'UNKNOWN'), (4, 'nation_stats', 'OUTPUT', 'UNKNOWN'),
        (5, 'old_report', 'OUTPUT', 'TABLE'), (6, 'lineitem', 'INPUT', 'UNKNOWN'), (6, 'part', 'INPUT', 'UNKNOWN')"""),
    "table_usage": "SELECT table_name, usage, CAST(n AS BIGINT) AS statements FROM (VALUES ('customer', 'INPUT', 3), ('customer_report', 'OUTPUT', 1), ('order_totals', 'INPUT', 1), ('orders', 'INPUT', 2), ('segments', 'INPUT', 1), ('big_orders', 'BOTH', 2), ('top_orders', 'OUTPUT', 1), ('supplier', 'INPUT', 1), ('nation', 'INPUT', 1), ('nation_stats', 'OUTPUT', 1), ('old_report', 'OUTPUT', 1), ('lineitem', 'INPUT', 1), ('part', 'INPUT', 1)) AS v(table_name, usage, n)",
    "schema_inference": _values("table_name, column_name, ordinal", "('big_orders', 'o_orderkey', 0), ('big_orders', 'o_custkey', 1), ('big_orders', 'o_totalprice', 2), ('big_orders', 'rn', 3), ('orders', 'o_orderkey', 0), ('orders', 'o_custkey', 1), ('orders', 'o_totalprice', 2)"),
    "star_expansion": _values(_I, "(0, 'copy.n_nationkey', 'nation.n_nationkey'), (0, 'copy.n_name', 'nation.n_name'), (0, 'copy.n_regionkey', 'nation.n_regionkey'), (0, 'copy.r_name', 'region.r_name')"),
    "components": _values("query_index, component_index, component_type, name, parent_index, depth, is_executable, dependencies, location", """
        (0, 0, 'CTE', 'order_totals', NULL, 0, true, '', 'WITH clause'), (0, 1, 'CTE', 'segments', NULL, 0, true, 'order_totals', 'WITH clause'), (0, 2, 'TARGET_TABLE', 'customer_report', NULL, 0, false, '', 'INSERT INTO'), (0, 3, 'SOURCE_QUERY', NULL, NULL, 0, true, 'segments', 'INSERT source SELECT'),
        (1, 0, 'TARGET_TABLE', 'big_orders', NULL, 0, false, '', 'CREATE VIEW'), (1, 1, 'SOURCE_QUERY', NULL, NULL, 0, true, '', 'CREATE VIEW AS SELECT'),
        (2, 0, 'TARGET_TABLE', 'top_orders', NULL, 0, false, '', 'INSERT INTO'), (2, 1, 'SOURCE_QUERY', NULL, NULL, 0, true, '', 'INSERT source SELECT'),
        (3, 0, 'MAIN_QUERY', NULL, NULL, 0, true, '', 'Top-level SELECT'), (3, 1, 'UNION_BRANCH', 'branch_0', 0, 1, true, '', 'UNION branch 0 of 2'), (3, 2, 'UNION_BRANCH', 'branch_1', 0, 1, true, '', 'UNION branch 1 of 2 (UNION ALL)'),
        (4, 0, 'TARGET_TABLE', 'nation_stats', NULL, 0, false, '', 'MERGE INTO'), (4, 1, 'SOURCE_QUERY', NULL, NULL, 0, true, '', 'MERGE USING clause'),
        (6, 0, 'MAIN_QUERY', NULL, NULL, 0, true, '', 'Top-level SELECT'), (6, 1, 'SUBQUERY', 'q', 0, 1, true, '', 'FROM clause in main query'), (6, 2, 'SCALAR_SUBQUERY', 'top_quantity', 0, 1, true, '', 'SELECT list')"""),
    "component_cte": _TOTALS,
    "component_dependent_cte": _SEGMENTS,
    "component_source_query": f"SELECT c_name, c_mktsegment, total FROM ({_SEGMENTS}) WHERE total > 1000000",
    "component_union_branch": "SELECT 'customer' AS customer, c_name, c_acctbal FROM customer",
    "component_merge_source": "SELECT c_nationkey AS k, COUNT(*) AS n FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation) GROUP BY c_nationkey",
    "component_subquery": _PARTS,
    "component_scalar_subquery": 'SELECT MAX(l_quantity) AS "max(l_quantity)" FROM lineitem',
    "component_main_query": f"SELECT p_brand, (SELECT MAX(l_quantity) FROM lineitem) AS top_quantity, n FROM part JOIN ({_PARTS}) ON p_partkey = l_partkey",
    "graph_downstream": f"""{_KEYS}, walk AS (SELECT 'region.0' AS id, 0 AS hops UNION SELECT e.t, w.hops + 1 FROM walk w JOIN e ON e.s = w.id)
        SELECT w.id AS identifier, CAST(MIN(hops) AS INTEGER) AS hops, any_value(is_root) AS is_root, any_value(is_leaf) AS is_leaf FROM walk w JOIN ends ON ends.id = w.id WHERE hops > 0 GROUP BY w.id""",
    "graph_upstream_paths": f"""{_KEYS}, walk AS (SELECT x AS id, 0 AS hops, x AS path FROM (VALUES ('orders.1'), ('supplier.1')) v(x) UNION ALL SELECT e.s, w.hops + 1, e.s || ' -> ' || w.path FROM walk w JOIN e ON e.t = w.id)
        SELECT w.id AS identifier, CAST(MIN(hops) AS INTEGER) AS hops, any_value(is_root) AS is_root, any_value(is_leaf) AS is_leaf, string_agg(path, '; ' ORDER BY path) AS paths FROM walk w JOIN ends ON ends.id = w.id WHERE hops > 0 GROUP BY w.id""",
    "graph_upstream_table": f"""{_KEYS} SELECT id AS identifier, hops, is_root, is_leaf, 'supplier' AS output_column FROM ends JOIN (
        SELECT DISTINCT 'nation.' || s_nationkey AS n, 1 AS hops FROM supplier UNION SELECT DISTINCT 'region.' || n_regionkey, 2 FROM supplier JOIN nation ON n_nationkey = s_nationkey) ON n = id""",
    "graph_degrees": f"{_KEYS} SELECT is_root, is_leaf, COUNT(*) AS n FROM ends GROUP BY ALL",
    "graph_merge": f"{_KEYS} SELECT split_part(id, '.', 1) AS \"table\", COUNT(*) AS n FROM nodes GROUP BY 1",
    "graph_of_workload": _values("source_node, target_node, query_index", """
        ('customer.c_name', 'customer_report.c_name', 0), ('customer.c_mktsegment', 'customer_report.c_mktsegment', 0), ('orders.o_totalprice', 'customer_report.total', 0),
        ('orders.o_orderkey', 'big_orders.o_orderkey', 1), ('orders.o_custkey', 'big_orders.o_custkey', 1), ('orders.o_totalprice', 'big_orders.o_totalprice', 1), ('orders.o_custkey', 'big_orders.rn', 1), ('orders.o_orderkey', 'big_orders.rn', 1), ('orders.o_totalprice', 'big_orders.rn', 1),
        ('big_orders.o_orderkey', 'top_orders.o_orderkey', 2), ('big_orders.o_custkey', 'top_orders.o_custkey', 2), ('big_orders.o_totalprice', 'top_orders.o_totalprice', 2), ('big_orders.rn', 'top_orders.rn', 2),
        ('<literal: ''customer''>', 'kind', 3), ('<literal: ''supplier''>', 'kind', 3), ('customer.c_name', 'supplier.name', 3), ('supplier.s_name', 'supplier.name', 3), ('customer.c_acctbal', 'supplier.balance', 3), ('supplier.s_acctbal', 'supplier.balance', 3),
        ('nation.n_nationkey', 'nation_stats.k', 4), ('n', 'nation_stats.n', 4), ('part.p_brand', 'part.p_brand', 6), ('lineitem.l_quantity', 'top_quantity', 6), ('q.n', 'q.n', 6)"""),
    "graph_recursive_sql": f"{_KEYS}, walk AS (SELECT 'orders.1' AS id, 'orders.1' AS path, 0 AS hops UNION ALL SELECT e.s, w.path || ' <- ' || e.s, w.hops + 1 FROM walk w JOIN e ON e.t = w.id) SELECT id AS identifier, path FROM walk WHERE hops > 0",
    "graph_layers": f"{_KEYS} SELECT CASE split_part(id, '.', 1) WHEN 'region' THEN 0 WHEN 'nation' THEN 1 WHEN 'customer' THEN CASE WHEN is_root THEN 0 ELSE 2 END WHEN 'supplier' THEN 2 ELSE 3 END AS layer, COUNT(*) AS n FROM ends GROUP BY 1",
} | {f"construct_{name}": other or sql for name, (sql, other) in workload.CONSTRUCTS.items()}

ORACLES["graph_json"] = ORACLES["graph_of_workload"]
ORACLES["cli_tables"] = f"SELECT CAST(query_index AS VARCHAR) AS query_index, table_name, usage, object_type FROM ({ORACLES['table_inventory']})"
