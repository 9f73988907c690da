import json

import pytest

from lineora.operators import graph as G
from lineora.sources import diagrams, sinks
from lineora.sources.files import Corpus


def make(spark, edges):
    rows = [("f.sql", 0, i, b, a) for i, (a, b) in enumerate(edges)]
    return G.graph_of(spark.createDataFrame(rows, "file_path string, query_index int, item_index int, output_name string, source_name string"))


def hops(result):
    return {r["identifier"]: r["hops"] for r in result.related.collect()}


def test_diamond(spark):
    g = make(spark, [("A.x", "b.x"), ("a.x", "c.x"), ("b.x", "d.x"), ("c.x", "d.x")])
    assert (g.nodes.count(), g.edges.count()) == (4, 4)
    up = G.find_upstream(g, "D.X")
    rows = {r["identifier"]: r for r in up.related.collect()}
    assert {k: (r["hops"], r["is_root"], r["is_leaf"]) for k, r in rows.items()} == {"a.x": (2, True, False), "b.x": (1, False, False), "c.x": (1, False, False)}
    assert [list(p) for p in rows["a.x"]["paths"]] == [["a.x", "b.x", "d.x"], ["a.x", "c.x", "d.x"]]
    assert hops(G.find_downstream(g, "a.x")) == {"b.x": 1, "c.x": 1, "d.x": 2}
    with pytest.raises(ValueError, match="not found"):
        G.find_upstream(g, "no.such")


def test_cycles_end(spark):
    g = make(spark, [("a.x", "b.x"), ("b.x", "c.x"), ("c.x", "a.x"), ("c.x", "c.x")])
    assert hops(G.find_upstream(g, "a.x")) == {"c.x": 1, "b.x": 2}
    assert not G.degrees(g).where("is_root or is_leaf").count()
    assert G.layers(g).count() == 3


def test_tables_and_several(spark):
    g = make(spark, [("ta.x", "tb.x"), ("tb.x", "tc.x"), ("ta.y", "tb.y")])
    assert set(hops(G.find_upstream_table(g, ["tb", "tc"]))) == {"ta.x", "ta.y"}
    assert hops(G.find_downstream_table(g, "ta")) == {"tb.x": 1, "tb.y": 1, "tc.x": 2}
    out = G.find_upstream(g, ["tb.y", "tc.x"])
    assert out.query == "tb.y, tc.x" and hops(out) == {"ta.y": 1, "tb.x": 1, "ta.x": 2}


def test_identifier_parts(spark):
    g = make(spark, [("cat.db.t.c", "c"), ("s.t.c", "t.c")])
    assert {r["identifier"]: (r["schema_name"], r["table"], r["column"]) for r in g.nodes.collect()} == {"cat.db.t.c": ("cat", "db", "t.c"), "c": (None, None, "c"), "s.t.c": ("s", "t", "c"), "t.c": (None, "t", "c")}


def test_merge_and_json(spark, tmp_path):
    a, b = make(spark, [("a.x", "b.x")]), make(spark, [("a.x", "b.x"), ("b.x", "c.x")])
    m = G.merge([a, b])
    assert (m.nodes.count(), m.edges.count()) == (3, 2)
    again = G.from_json(spark, G.to_json(m))
    assert json.loads(G.to_json(again))["nodes"] == json.loads(G.to_json(m))["nodes"]
    broken = G.Graph(a.nodes, b.edges)
    assert broken.connected().edges.count() == 1
    G.write_tables(m, str(tmp_path / "g"))
    assert G.read_tables(spark, str(tmp_path / "g")).edges.count() == 2


def test_first_place_wins(spark):
    c = Corpus(spark).add_text("one.sql", "INSERT INTO o SELECT a FROM t").add_text("two.sql", "INSERT INTO o SELECT a FROM t; DROP TABLE x")
    edge = c.graph().edges.collect()
    assert [(r["source_node"], r["target_node"], r["file_path"]) for r in edge] == [("t.a", "o.a", "one.sql")]
    assert c.skipped_files == []


def test_schema_pass_makes_order_irrelevant(spark):
    files = [("a.sql", "INSERT INTO o SELECT * FROM v"), ("b.sql", "CREATE VIEW v AS SELECT p, q FROM t")]
    c = Corpus(spark)
    for f in files:
        c.add_text(*f)
    assert ("v.*", "o.*") in {(r[0], r[1]) for r in c.graph().edges.collect()}
    c.resolve_schema()
    assert ("v.p", "o.p") in {(r[0], r[1]) for r in c.graph().edges.collect()}


def test_formats(spark):
    g = make(spark, [("a.x", "b.x"), ("b.x", "c.x")])
    result = G.find_upstream(g, "c.x")
    rows = result.rows()
    assert json.loads(sinks.related_json(result, rows))["columns"][0]["paths"] == [["a.x", "b.x", "c.x"]]
    assert "a.x -> b.x -> c.x" in sinks.related_csv(result, rows)
    picture = diagrams.Picture.of_query(result, g)
    text = diagrams.render("mermaid", picture)
    assert text.startswith("flowchart TD") and "    a_x -->|f.sql| b_x" in text and "style c_x fill:#ffc107" in text and "Legend" in text
    assert diagrams.render("mermaid-markdown", picture).startswith("```mermaid\n")
    assert '"a.x" -> "b.x" [label="f.sql"];' in diagrams.render("dot", picture)
    figure = json.loads(diagrams.render("plotly", diagrams.Picture.of_graph(g), g))
    assert figure["layout"]["height"] == 400 and figure["data"][1]["text"] == ["a.x", "b.x", "c.x"]


def graph_of_edges(spark, edges):
    rows = [(a, b, "f.sql", 0, i) for i, (a, b) in enumerate(edges)]
    return G.graph_of(spark.createDataFrame(rows, "source_name string, output_name string, file_path string, query_index int, item_index int"))


def test_paths_have_no_limit_unless_asked(spark):
    g = graph_of_edges(spark, [(f"t.c{i:03}", f"t.c{i + 1:03}") for i in range(70)])
    seeds = spark.createDataFrame([("t.c000",)], "identifier string")
    found = G.paths(g, seeds, "downstream").collect()
    assert sorted(len(r["path"]) for r in found) == [*range(2, 72)]
    assert max(len(r["path"]) for r in G.paths(g, seeds, "downstream", 3).collect()) == 4


def test_limits_are_flagged(spark):
    # two ways to d, a cycle back to a, and f behind it
    g = graph_of_edges(spark, [("t.a", "t.b"), ("t.a", "t.c"), ("t.b", "t.d"), ("t.c", "t.d"), ("t.d", "t.a"), ("t.d", "t.f")])
    rows = {r["identifier"]: (r["paths"], r["truncated"]) for r in G.find_downstream(g, "t.a").rows()}
    assert rows["t.f"] == ([["t.a", "t.b", "t.d", "t.f"], ["t.a", "t.c", "t.d", "t.f"]], False)
    rows = {r["identifier"]: (len(r["paths"]), r["truncated"]) for r in G.find_downstream(g, "t.a", max_paths=1).rows()}
    assert rows["t.f"] == (1, True) and rows["t.b"] == (1, False)
    rows = {r["identifier"]: (len(r["paths"] or []), r["truncated"]) for r in G.find_downstream(g, "t.a", max_hops=2).rows()}
    assert rows["t.f"] == (0, True) and rows["t.d"][0] == 2


def test_json_is_read_by_spark(spark, tmp_path):
    g = graph_of_edges(spark, [("t.a", "t.b")])
    (tmp_path / "g.json").write_text(G.to_json(g))
    again = G.read_json(spark, str(tmp_path / "g.json"))
    assert again.edges.collect() == g.edges.select(*again.edges.columns).collect() and again.nodes.count() == 2


def layered(edges, nodes):
    """Layers by the plain rule: free nodes have no edge from a node that is left; where none is free, all that are left take the layer."""
    edges = {(a, b) for a, b in edges if a != b and {a, b} <= nodes}
    out, left, layer = {}, set(nodes), 0
    while left:
        free = left - {b for a, b in edges if a in left} or left
        out |= dict.fromkeys(free, layer)
        left, layer = left - free, layer + 1
    return out


LAYERED = {
    "long and short ways": ([("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("a", "c"), ("x", "d"), ("d", "d")], "abcdxi"),
    "a cycle and what lies behind it": ([("r", "a"), ("r", "z"), ("a", "b"), ("b", "a"), ("b", "t"), ("t", "u")], "rabztu"),
    "no root": ([("a", "b"), ("b", "a")], "ab"),
    "repeated edges and missing ends": ([("a", "b"), ("a", "b"), ("a", "b"), ("b", "c"), ("a", "c"), ("gone", "a"), ("c", "gone")], "abc"),
    "no edges": ([], "ab"),
    "nothing": ([], ""),
}


@pytest.mark.parametrize("name", LAYERED)
def test_layers_by_the_plain_rule(spark, name, monkeypatch):
    edges, nodes = LAYERED[name]
    g = G.Graph(spark.createDataFrame([(x,) for x in nodes], "identifier string"), spark.createDataFrame(edges, "source_node string, target_node string"))
    want = layered(edges, set(nodes))
    for few in (G.FEW, 0):
        monkeypatch.setattr(G, "FEW", few)
        rows = G.layers(g).collect()
        assert {r["identifier"]: r["layer"] for r in rows} == want and len(rows) == len(want)
        assert all(r["x"] == r["layer"] * 250 for r in rows)


def test_layers_write_each_node_a_few_times(spark, monkeypatch):
    edges = [(f"t.c{i}", f"t.c{i + 1}") for i in range(8)] + [("t.c8", f"t.leaf{i}") for i in range(100)]
    g, written, cut = graph_of_edges(spark, edges), [], G.cut
    monkeypatch.setattr(G, "cut", lambda df, name: written.append(cut(df, name)) or written[-1])
    assert {r["identifier"]: r["layer"] for r in G.layers(g).collect()} == layered(edges, {x for e in edges for x in e})
    assert sum(x.count() for x in written) <= 5 * 109  # 109 nodes in ten layers


def test_a_graph_just_built_needs_no_join_to_be_connected(spark):
    g = graph_of_edges(spark, [("t.a", "t.b")])
    assert "Join" not in g.connected().edges._jdf.queryExecution().optimizedPlan().toString() and g.connected().edges.count() == 1
    assert G.Graph(g.nodes.where("identifier = 't.a'"), g.edges).connected().edges.count() == 0
