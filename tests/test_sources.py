import json

import pytest

from lineora.cli import main
from lineora.config import load_config
from lineora.operators.lineage import Analyzer
from lineora.sources import files, sinks
from lineora.sources.catalogs import CatalogError, DatabricksCatalog, SparkCatalog, catalogs
from lineora.template import MiniTemplater, TemplaterError, all_variables, templaters, typed, variables_of_pairs


def test_files(tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("b.sql", "a.sql", "sub/c.sql", "x.txt"):
        (tmp_path / name).write_text("SELECT 1")
    assert [f.rsplit("/", 1)[-1] for f in files.list_files(str(tmp_path))] == ["a.sql", "b.sql"]
    assert len(files.list_files(str(tmp_path), recursive=True)) == 3
    (tmp_path / "m.csv").write_text("file_path,dialect\na.sql,spark\nb.sql,\n")
    assert files.read_manifest(str(tmp_path / "m.csv")) == [(str(tmp_path / "a.sql"), "spark"), (str(tmp_path / "b.sql"), None)]
    with pytest.raises(FileNotFoundError):
        files.read_sql(str(tmp_path / "none.sql"))
    with pytest.raises(ValueError):
        files.read_sql(str(tmp_path))


@pytest.mark.parametrize("kind", ["json", "csv", "text"])
def test_schema_formats(kind):
    schema = {"b.t": {"y": "UNKNOWN", "x": "UNKNOWN"}, "a": {"k": "UNKNOWN"}}
    assert files.parse_schema(files.format_schema(schema, kind), kind) == schema


def test_ddl_and_catalog(spark):
    ddl = "CREATE TABLE Db.T (Id BIGINT, Name STRING) USING parquet; CREATE TABLE n AS SELECT 1 AS a"
    assert files.schema_of_ddl(spark, ddl) == {"db.t": {"id": "UNKNOWN", "name": "UNKNOWN"}}
    spark.createDataFrame([(1, "a")], "id int, name string").createOrReplaceTempView("people_view")
    found = SparkCatalog(spark).get_ddl_batch(["people_view", "no_such_table"])
    assert "`id` int" in found["people_view"] and found["no_such_table"].startswith("ERROR:")
    schema = {"kept": {"a": "INT"}}
    files.fill_schema(spark, schema, ["people_view", "kept", "no_such_table"], SparkCatalog(spark))
    assert schema == {"kept": {"a": "INT"}, "people_view": {"id": "UNKNOWN", "name": "UNKNOWN"}}
    with pytest.raises(CatalogError):
        DatabricksCatalog().configure()
    assert {"spark", "databricks"} <= {*catalogs.names()}


def test_sinks(spark):
    a = Analyzer(spark, "INSERT INTO o SELECT a + b AS c FROM t")
    rows = a.lineage().collect()
    assert json.loads(sinks.lineage_json(rows))["queries"][0]["lineage"] == [{"output_name": "o.c", "source_name": "t.a"}, {"output_name": "o.c", "source_name": "t.b"}]
    assert sinks.lineage_csv(rows).splitlines()[0] == "query_index,output_column,source_column"
    assert sinks.lineage_csv([]) == ""
    assert "Output Column" in sinks.lineage_text(rows)
    assert sinks.tables_csv(a.tables().collect()).splitlines()[1:] == ["0,o,OUTPUT,UNKNOWN", "0,t,INPUT,UNKNOWN"]


def test_templates(tmp_path):
    render = lambda sql, **v: MiniTemplater().render(sql, v, str(tmp_path / "q.sql"))
    assert render("SELECT {{ c | upper }} {# no #}FROM {{ t['n'] }}", c="a", t={"n": "x"}) == "SELECT A FROM x"
    assert render("{% for c in cols %}{{ c }}{% if not loop.last %}, {% endif %}{% endfor %}", cols=["a", "b"]) == "a, b"
    assert render("{% if n > 1 and x is defined %}y{% elif n == 1 %}one{% else %}z{% endif %}", n=1) == "one"
    (tmp_path / "inc.sql").write_text("WHERE {{ w }}")
    assert render("{% include 'inc.sql' %}", w="k = 1") == "WHERE k = 1"
    assert render("{{ missing | default('d') }}") == "d"
    for bad in ("{{ nope }}", "{% if %}", "{% for x %}{% endfor %}", "{% include 'gone.sql' %}", "{{ ''.__class__ }}"):
        with pytest.raises((TemplaterError, SyntaxError)):
            render(bad)
    assert templaters.get("none").render("{{ x }}") == "{{ x }}"
    with pytest.raises(KeyError):
        templaters.get("other")


def test_variables(tmp_path, monkeypatch):
    assert [typed(x) for x in ("1", "1.5", "TRUE", "x")] == [1, 1.5, True, "x"]
    with pytest.warns(UserWarning):
        assert variables_of_pairs(["a=1", "bad"]) == {"a": 1}
    (tmp_path / "v.toml").write_text("a = 2\nb = 3")
    monkeypatch.setenv("LINEORA_VAR_C", "4")
    assert all_variables(["a=1"], str(tmp_path / "v.toml"), {"b": 9, "c": 5}) == {"a": 1, "b": 3, "c": 5}
    for name, text in (("v.json", '{"k": 1}'), ("v.yaml", "k: 1")):
        (tmp_path / name).write_text(text)
        assert all_variables([], str(tmp_path / name))["k"] == 1


def test_config(tmp_path):
    assert load_config(tmp_path).dialect is None
    (tmp_path / "lineora.toml").write_text('[lineora]\ndialect = "spark"\nunknown = 1\n[lineora.templating.variables]\nx = 1')
    c = load_config(tmp_path)
    assert c.dialect == "spark" and c.templating == {"variables": {"x": 1}}
    (tmp_path / "lineora.toml").write_text("not toml [")
    with pytest.warns(UserWarning):
        assert load_config(tmp_path).dialect is None


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "a.sql").write_text("INSERT INTO o SELECT a FROM {{ t }}")
    (tmp_path / "b.sql").write_text("INSERT INTO p SELECT a FROM o")
    assert main(["lineage", "a.sql", "-f", "csv", "--templater", "jinja", "--var", "t=src"]) == 0
    assert "0,o.a,src.a" in capsys.readouterr().out
    assert main(["graph", "build", "a.sql", "b.sql", "--templater", "jinja", "--var", "t=src", "-o", "g.json"]) == 0
    assert main(["graph", "query", "g.json", "--upstream", "p.a", "-f", "csv"]) == 0
    assert "src.a -> o.a -> p.a" in capsys.readouterr().out
    assert main(["graph", "merge", "g.json", "g.json", "-o", "m.json"]) == 0
    assert json.loads((tmp_path / "m.json").read_text())["metadata"]["total_edges"] == 2
    assert main(["graph", "visualize", "m.json", "-f", "dot"]) == 0
    assert main(["tables", "overview", "b.sql"]) == 0
    assert main(["tables", "scrape", "b.sql", "-f", "csv"]) == 0
    assert "o,a,UNKNOWN" in capsys.readouterr().out
    assert main(["dissect", "b.sql", "-f", "json"]) == 0
    assert json.loads(capsys.readouterr().out)["queries"][0]["original_sql"].startswith("INSERT")
    assert main(["template", "a.sql", "--var", "t=z"]) == 0
    assert "FROM z" in capsys.readouterr().out
    assert main(["lineage", "none.sql"]) == 1
    assert main(["graph", "build", "b.sql", "--strict-schema"]) == 1


def test_stream(spark, tmp_path):
    from lineora.streaming.incremental import keep_graph, sql_stream, stored_graph

    (tmp_path / "in").mkdir()
    for i, sql in enumerate(("INSERT INTO o SELECT a FROM t", "INSERT INTO p SELECT a FROM o")):
        (tmp_path / "in" / f"{i}.sql").write_text(sql)
        keep_graph(sql_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {(r[0], r[1]) for r in stored_graph(spark, str(tmp_path / "out")).edges.collect()} == {("t.a", "o.a"), ("o.a", "p.a")}
