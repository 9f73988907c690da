"""The lineage graph as DataFrames: build, merge, traverse, read and write.

nodes: identifier, file_path, query_index, schema_name, table, column, is_literal, ordinal. edges: source_node,
target_node, file_path, query_index, ordinal. Traversal joins a frontier with the edges, one hop a round, and keeps what
it has seen in tables in the shared folder; it ends on cycles and self-loops.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineora.functions.tables import cut

NODES = T.StructType([T.StructField("identifier", T.StringType()), T.StructField("file_path", T.StringType()), T.StructField("query_index", T.IntegerType()), T.StructField("schema_name", T.StringType()), T.StructField("table", T.StringType()), T.StructField("column", T.StringType())])
EDGES = T.StructType([T.StructField("source_node", T.StringType()), T.StructField("target_node", T.StringType()), T.StructField("file_path", T.StringType()), T.StructField("query_index", T.IntegerType())])

#: Hops of paths that one table takes.
HOPS_AT_ONCE = 4
#: A layer with so many nodes that lead on, at most, is broadcast; they are counted first.
FEW = 50_000


def parsed_identifier(identifier: Column) -> dict[str, Column]:
    """schema_name, table and column of a dotted identifier: of three or more parts the first, the second and the rest."""
    parts = F.split(identifier, r"\.")
    n = F.size(parts)
    return {
        "schema_name": F.when(n >= 3, parts[0]),
        "table": F.when(n >= 3, F.get(parts, F.lit(1))).when(n == 2, parts[0]),
        "column": F.when(n >= 3, F.array_join(F.slice(parts, 3, F.greatest(n - 2, F.lit(0))), ".")).when(n == 2, F.get(parts, F.lit(1))).otherwise(parts[0]),
    }


def _first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by order; the order is compared before rows move."""
    rest = [c for c in df.columns if c not in keys]
    lead = F.struct(*order, *(c for c in rest if c not in order))
    best = df.groupBy(*keys).agg(F.min(lead).alias("__best"))
    return best.select(*keys, *(F.col(f"__best.{c}").alias(c) for c in rest))


@dataclass
class Graph:
    """nodes and edges with what is known about them."""

    nodes: DataFrame
    edges: DataFrame
    node_format: str = "qualified"
    dialect: str = "spark"
    source_files: list[str] = field(default_factory=list)
    created_at: str = field(default_factory=lambda: datetime.now(UTC).isoformat())
    whole: bool = False  # the ends of all edges are known to be among the nodes

    def metadata(self) -> dict:
        return {"node_format": self.node_format, "default_dialect": self.dialect, "created_at": self.created_at, "source_files": self.source_files, "total_nodes": self.nodes.count(), "total_edges": self.edges.count()}

    def columns(self) -> DataFrame:
        return self.nodes.select("identifier").distinct().orderBy("identifier")

    def node(self, identifier: str) -> DataFrame:
        return self.nodes.where(F.lower("identifier") == identifier.lower())

    def connected(self) -> Graph:
        """Without the edges of which an end is missing."""
        if self.whole:
            edges = self.edges.where("source_node IS NOT NULL AND target_node IS NOT NULL")
            return Graph(self.nodes, edges, self.node_format, self.dialect, self.source_files, self.created_at, True)
        ids = self.nodes.select("identifier")
        edges = self.edges.join(ids, F.col("source_node") == F.col("identifier"), "left_semi").join(ids, F.col("target_node") == F.col("identifier"), "left_semi")
        return Graph(self.nodes, edges, self.node_format, self.dialect, self.source_files, self.created_at, True)


def graph_of(lineage: DataFrame, source_files: list[str] | None = None, node_format: str = "qualified", dialect: str = "spark") -> Graph:
    """The graph of lineage rows (operators.lineage.LINEAGE, with file_ordinal). Identifiers are lower-cased; the first
    place where a node or an edge is met gives its file and statement."""
    rows = lineage.where(F.length("source_name") > 0)
    if "file_ordinal" not in rows.columns:
        rows = rows.withColumn("file_ordinal", F.col("file_path"))
    rows = rows.select(F.lower("source_name").alias("source_node"), F.lower("output_name").alias("target_node"), "file_path", "query_index", "file_ordinal", "item_index")
    order = ["file_ordinal", "query_index", "item_index"]
    edges = _first(rows, ["source_node", "target_node"], order)
    met = rows.select(F.explode(F.array(F.struct(F.col("target_node").alias("identifier"), F.lit(0).alias("side")), F.struct(F.col("source_node").alias("identifier"), F.lit(1).alias("side")))).alias("__n"), "file_path", *order)
    nodes = _first(met.select("__n.identifier", "__n.side", "file_path", *order), ["identifier"], [*order, "side"])
    nodes = nodes.select("identifier", "file_path", "query_index", *(c.alias(n) for n, c in parsed_identifier(F.col("identifier")).items()), F.col("identifier").startswith("<literal").alias("is_literal"))
    return Graph(nodes, edges.select("source_node", "target_node", "file_path", "query_index"), node_format, dialect, source_files or [], whole=True)


def merge(graphs: Iterable[Graph]) -> Graph:
    """All nodes and edges of several graphs; of equal ones those of the first graph. Names are compared with case."""
    graphs = list(graphs)
    if not graphs:
        raise ValueError("nothing to merge")
    stack = lambda name: _stacked([getattr(g, name).withColumn("__graph", F.lit(i)) for i, g in enumerate(graphs)])
    nodes = _first(stack("nodes"), ["identifier"], ["__graph"]).drop("__graph")
    edges = _first(stack("edges"), ["source_node", "target_node"], ["__graph"]).drop("__graph")
    files = list(dict.fromkeys(f for g in graphs for f in g.source_files))
    return Graph(nodes, edges, source_files=files).connected()


def _stacked(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# JSON


def to_json(graph: Graph) -> str:
    """The whole graph as one JSON document (for graphs that fit one)."""
    rows = lambda df, schema: [{f.name: r[f.name] for f in schema} for r in df.collect()]
    nodes = rows(graph.nodes.orderBy("identifier"), NODES)
    edges = rows(graph.edges.orderBy("source_node", "target_node"), EDGES)
    meta = {"node_format": graph.node_format, "default_dialect": graph.dialect, "created_at": graph.created_at, "source_files": graph.source_files, "total_nodes": len(nodes), "total_edges": len(edges)}
    return json.dumps({"metadata": meta, "nodes": nodes, "edges": edges}, indent=2)


_META = "node_format string, default_dialect string, created_at string, source_files array<string>"


def from_json(spark: SparkSession, text: str) -> Graph:
    """A graph from its JSON document."""
    return _from_documents(spark.createDataFrame([(text,)], "value string"))


def read_json(spark: SparkSession, path: str) -> Graph:
    """A graph from its JSON file, in any store Spark reads; the file is parsed on an executor."""
    return _from_documents(spark.read.text(path, wholetext=True))


def _from_documents(documents: DataFrame) -> Graph:
    schema = f"metadata struct<{_META.replace(' ', ':')}>, nodes array<{NODES.simpleString()}>, edges array<{EDGES.simpleString()}>".replace(",:", ",")
    read = documents.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("g"))
    meta = read.select("g.metadata").first()[0]
    rows = lambda name: read.select(F.inline(f"g.{name}"))
    known = {k: v for k, v in (meta.asDict() if meta else {}).items() if v is not None}
    nodes = rows("nodes").withColumn("is_literal", F.col("identifier").startswith("<literal"))
    return Graph(nodes, rows("edges"), known.get("node_format", "qualified"), known.get("default_dialect", "spark"), known.get("source_files", []), known.get("created_at", ""))


def write_tables(graph: Graph, path: str) -> None:
    """The graph as Parquet tables, for graphs of any size."""
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_tables(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


# traversal


def degrees(graph: Graph) -> DataFrame:
    """identifier, is_root (nothing flows in) and is_leaf (nothing flows out) of every node; self-loops count."""
    into = graph.edges.groupBy(F.col("target_node").alias("__in")).agg(F.count("*").alias("n_in"))
    out = graph.edges.groupBy(F.col("source_node").alias("__out")).agg(F.count("*").alias("n_out"))
    met = graph.nodes.select("identifier").distinct().join(into, F.col("identifier") == F.col("__in"), "left").join(out, F.col("identifier") == F.col("__out"), "left")
    return met.select("identifier", F.coalesce(F.col("n_in") == 0, F.lit(True)).alias("is_root"), F.coalesce(F.col("n_out") == 0, F.lit(True)).alias("is_leaf"))


def _steps(graph: Graph, direction: str) -> DataFrame:
    """(at, to) of every hop in a direction; self-loops lead nowhere."""
    a, b = ("source_node", "target_node") if direction == "downstream" else ("target_node", "source_node")
    return graph.edges.select(F.col(a).alias("at"), F.col(b).alias("to")).where("at != to").distinct()


def reachable(graph: Graph, seeds: DataFrame, direction: str) -> DataFrame:
    """(seed, identifier, hops) of everything that seeds (identifier) reach, the seed itself left out; hops are the fewest."""
    steps = _steps(graph, direction)
    seen = cut(seeds.select(F.col("identifier").alias("seed"), "identifier", F.lit(0).alias("hops")), "seen")
    front, hops = seen, 0
    while not front.isEmpty():
        hops += 1
        onward = front.join(steps, F.col("identifier") == F.col("at")).select("seed", F.col("to").alias("identifier"), F.lit(hops).alias("hops")).distinct()
        front = cut(onward.join(seen.select("seed", "identifier"), ["seed", "identifier"], "left_anti"), "front")
        seen = seen.unionByName(front)
        if hops % 8 == 0:
            seen = cut(seen, "seen")
    return seen.where("hops > 0")


def _walked(graph: Graph, seeds: DataFrame, direction: str, max_hops: int | None) -> tuple[DataFrame, DataFrame | None]:
    """Paths away from the seeds (seed, identifier, path, hops), and those of max_hops hops that may go on."""
    steps = cut(_steps(graph, direction), "steps")
    front = seeds.select(F.col("identifier").alias("seed"), "identifier", F.array("identifier").alias("path"), F.lit(0).alias("hops"))
    found, hops = front.limit(0), 0
    while max_hops is None or hops < max_hops:
        levels = [front]
        for _ in range(HOPS_AT_ONCE if max_hops is None else min(HOPS_AT_ONCE, max_hops - hops)):
            hops += 1
            onward = levels[-1].join(steps, F.col("identifier") == F.col("at")).where(~F.array_contains("path", F.col("to")))
            levels.append(onward.select("seed", F.col("to").alias("identifier"), F.concat("path", F.array("to")).alias("path"), F.lit(hops).alias("hops")))
        new = cut(_stacked(levels[1:]), "paths")
        found, front = found.unionByName(new), new.where(F.col("hops") == hops)
        if front.isEmpty():
            return found, None
    return found, front


def paths(graph: Graph, seeds: DataFrame, direction: str, max_hops: int | None = None) -> DataFrame:
    """(seed, identifier, path) of every simple path, in the direction of the data flow; of at most max_hops hops, if given."""
    found = _walked(graph, seeds, direction, max_hops)[0].drop("hops")
    return found.withColumn("path", F.reverse("path")) if direction == "upstream" else found


def _listed(graph: Graph, seeds: DataFrame, direction: str, max_hops: int | None, max_paths: int | None) -> DataFrame:
    """(identifier, paths, truncated): sorted; truncated if one of the limits may have left paths out."""
    found, on = _walked(graph, seeds, direction, max_hops)
    way = F.reverse("path") if direction == "upstream" else F.col("path")
    found = found.select("identifier", way.alias("path")).distinct()
    over = F.lit(False)
    if max_paths is not None:  # counted before they are gathered
        of_node = Window.partitionBy("identifier").orderBy("path")
        found = found.withColumn("__n", F.row_number().over(of_node)).where(F.col("__n") <= max_paths + 1)
        over = F.max("__n") > max_paths
        found = found.withColumn("path", F.when(F.col("__n") <= max_paths, F.col("path")))
    out = found.groupBy("identifier").agg(F.array_sort(F.collect_list("path")).alias("paths"), over.alias("truncated"))
    if on is None:
        return out
    further = reachable(graph, on.select("identifier").distinct(), direction).select("identifier").distinct().withColumn("__on", F.lit(True))
    out = out.join(further, "identifier", "full")
    return out.select("identifier", F.coalesce("paths", F.array().cast("array<array<string>>")).alias("paths"), (F.coalesce("truncated", F.lit(False)) | F.coalesce("__on", F.lit(False))).alias("truncated"))


@dataclass
class QueryResult:
    """Related columns of one or more queried columns or tables."""

    query: str
    direction: str
    queried: list[str]
    is_table_query: bool
    related: DataFrame

    def rows(self) -> list:
        """The rows of the result, sorted by lower-cased identifier."""
        return self.related.orderBy(F.lower("identifier")).collect()


def _found(graph: Graph, names: list[str], tables: bool) -> list[str]:
    """Identifiers of the queried columns, in the order asked. Raises ValueError for a name that is not there."""
    out: list[str] = []
    for name in names:
        low = name.lower()
        if not tables:
            hit = graph.nodes.where(F.lower("identifier") == low)
        elif "." in name:
            hit = graph.nodes.where(F.lower("identifier").startswith(low + "."))
        else:
            hit = graph.nodes.where(F.lower("table") == low)
        if tables and "is_literal" in graph.nodes.columns:
            hit = hit.where("not is_literal")
        ids = sorted(r[0] for r in hit.select("identifier").distinct().collect())  # columns of one table
        if not ids:
            raise ValueError(f"{'Table' if tables else 'Column'} '{name}' not found in graph")
        out += ids
    return list(dict.fromkeys(out))


def related(graph: Graph, names: str | list[str], direction: str, tables: bool = False, with_paths: bool = True, max_hops: int | None = None, max_paths: int | None = None) -> QueryResult:
    """What lies upstream or downstream of columns or of tables' columns: the node's fields, hops (the fewest from any of
    them), output_column, is_root, is_leaf, and all simple paths; max_hops and max_paths (a node) limit the list of paths
    and set truncated where they may have left some out. Queried columns are left out. In no order; QueryResult.rows()
    sorts by lower-cased identifier."""
    if direction not in ("upstream", "downstream"):
        raise ValueError(f"Unknown direction '{direction}'")
    names = [names] if isinstance(names, str) else list(names)
    graph = Graph(cut(graph.nodes, "nodes"), graph.edges, whole=graph.whole)
    graph = Graph(graph.nodes, cut(graph.connected().edges, "edges"))  # every round below reads them again
    queried = _found(graph, names, tables)
    seeds = graph.nodes.sparkSession.createDataFrame([(x,) for x in queried], "identifier string")
    reach = reachable(graph, seeds, direction).join(F.broadcast(seeds), "identifier", "left_anti").groupBy("identifier").agg(F.min("hops").alias("hops"))
    ends = lambda side, name: graph.edges.select(F.col(side).alias("identifier")).distinct().withColumn(name, F.lit(True))
    out = reach.join(graph.nodes, "identifier").join(ends("target_node", "__in"), "identifier", "left").join(ends("source_node", "__out"), "identifier", "left")
    out = out.withColumns({"is_root": F.col("__in").isNull(), "is_leaf": F.col("__out").isNull()}).drop("__in", "__out")
    if with_paths:
        out = out.join(_listed(graph, seeds, direction, max_hops, max_paths), "identifier", "left")
    label = ", ".join(names)
    return QueryResult(label, direction, queried, tables, out.withColumn("output_column", F.lit(label)))


def find_upstream(graph: Graph, columns: str | list[str], **options) -> QueryResult:
    return related(graph, columns, "upstream", **options)


def find_downstream(graph: Graph, columns: str | list[str], **options) -> QueryResult:
    return related(graph, columns, "downstream", **options)


def find_upstream_table(graph: Graph, tables: str | list[str], **options) -> QueryResult:
    return related(graph, tables, "upstream", tables=True, **options)


def find_downstream_table(graph: Graph, tables: str | list[str], **options) -> QueryResult:
    return related(graph, tables, "downstream", tables=True, **options)


def recursive_paths(graph: Graph, column: str, direction: str, max_level: int = 100) -> DataFrame:
    """Simple paths from one column by recursive SQL: an alternative to paths() for shallow graphs."""
    spark = graph.nodes.sparkSession
    _steps(graph, direction).createOrReplaceTempView("__lineora_steps")
    return spark.sql(
        f"""WITH RECURSIVE walk(identifier, path) MAX RECURSION LEVEL {max_level} AS (
            SELECT :start, array(:start) UNION ALL
            SELECT s.to, concat(w.path, array(s.to)) FROM walk w JOIN __lineora_steps s ON w.identifier = s.at WHERE NOT array_contains(w.path, s.to))
        SELECT identifier, path FROM walk WHERE size(path) > 1""",
        {"start": column.lower()},
    )


def layers(graph: Graph) -> DataFrame:
    """(identifier, layer, x, y): a node's layer is the longest way to it from a root; nodes of cycles take the next free one.

    Each edge carries how many edges its target has and whether the target leads on. A round follows the edges of the nodes
    that the last one has freed (all edges are shuffled for it only where these are too many to broadcast) and writes the nodes
    it met: those it frees, and those that wait for other edges. Nodes that no round has met are not written again."""
    edges = cut(graph.connected().edges.select(F.col("source_node").alias("a"), F.col("target_node").alias("b")).where("a != b"), "edges")
    into = edges.groupBy(F.col("b").alias("__in")).agg(F.count("*").alias("n_in"))
    out = edges.select(F.col("a").alias("__out")).distinct()
    ends = graph.nodes.select("identifier").distinct().join(into, F.col("identifier") == F.col("__in"), "left").join(out, F.col("identifier") == F.col("__out"), "left")
    ends = cut(ends.select("identifier", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.col("__out").isNotNull().alias("leads")), "ends")
    steps = cut(edges.join(ends, F.col("b") == F.col("identifier")).select("a", "b", "n_in", "leads"), "steps")
    met, placed, n_placed = ends.where("n_in = 0").withColumn("n", F.lit(0).cast("long")), [], 0
    while True:
        free = met.where("n = n_in")
        n_free, n_on = met.agg(F.count_if(F.col("n") == F.col("n_in")), F.count_if((F.col("n") == F.col("n_in")) & F.col("leads"))).first()
        if n_free:
            placed.append(free.select("identifier", F.lit(len(placed)).alias("layer")))
            n_placed += n_free
        if not n_on:
            break
        front = free.where("leads").select("identifier")
        front = F.broadcast(front) if n_on <= FEW else front
        onward = steps.join(front, F.col("a") == F.col("identifier")).select(F.col("b").alias("identifier"), "n_in", "leads", F.lit(1).cast("long").alias("n"))
        met = cut(onward.unionByName(met.where("n < n_in")).groupBy("identifier", "n_in", "leads").agg(F.sum("n").alias("n")), "met")
    if n_placed < ends.count():  # cycles, and what lies behind them
        done = _stacked(placed).select("identifier") if placed else ends.select("identifier").limit(0)
        placed.append(ends.where("n_in > 0").join(done, "identifier", "left_anti").select("identifier", F.lit(len(placed)).alias("layer")))
    placed = _stacked(placed) if placed else ends.select("identifier", F.lit(0).alias("layer"))
    order = Window.partitionBy("layer").orderBy("identifier")
    size = Window.partitionBy("layer")
    return placed.withColumns({"x": F.col("layer") * 250.0, "y": (F.row_number().over(order) - 1 - (F.count("*").over(size) - 1) / 2) * 100.0})
