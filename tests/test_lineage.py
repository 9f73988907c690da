import pytest

from lineora.operators.lineage import Analyzer, schema_dict, schema_frame
from lineora.operators.resolve import SchemaResolutionError, StarResolutionError
from lineora.plans.split import preview, split_statements
from lineora.plans.tree import ParseError
from lineora.sources.files import nested_schema

REPORT = """WITH spend AS (SELECT buyer, SUM(paid) AS total, COUNT(*) AS n FROM sales GROUP BY buyer),
named AS (SELECT s.buyer, p.name, p.area, s.total, CASE WHEN s.total > 10 THEN 'big' ELSE 'small' END AS grade FROM spend s JOIN people p ON s.buyer = p.id)
INSERT INTO REPORT SELECT name, area, grade, total FROM named WHERE grade = 'big'"""


def items(spark, sql, **options):
    lineage = {k: options.pop(k) for k in ("level", "column", "source_column", "table_filter") if k in options}
    return [(r[1], r[5], r[6]) for r in Analyzer(spark, sql, **options).lineage_rows(**lineage)]


def pairs(spark, sql, **options):
    return {(o, s) for _, o, s in items(spark, sql, **options)}


def test_split():
    assert split_statements("SELECT ';' ; -- a; b\n SELECT `x;y`; /* ; */ ;") == ["SELECT ';'", "-- a; b\n SELECT `x;y`"]
    assert split_statements("-- only\n/* comments */ ;") == []
    assert preview("a  \n b") == "a b" and preview("x" * 101) == "x" * 100 + "..."


def test_cte_chain_with_target(spark):
    assert pairs(spark, REPORT) == {("report.name", "people.name"), ("report.area", "people.area"), ("report.grade", "sales.paid"), ("report.total", "sales.paid")}


def test_reverse(spark):
    assert pairs(spark, REPORT, source_column="SALES.PAID") == {("sales.paid", "report.grade"), ("sales.paid", "report.total")}
    assert pairs(spark, REPORT, source_column="report.name") == {("report.name", "report.name")}
    with pytest.raises(ValueError, match="Source column 'No.Such' not found in any query"):
        items(spark, REPORT, source_column="No.Such")


def test_one_column(spark):
    assert items(spark, REPORT, column="report.TOTAL") == [(0, "report.total", "sales.paid")]
    with pytest.raises(ValueError, match="Column 'REPORT.Nothing' not found"):
        items(spark, REPORT, column="REPORT.Nothing")


@pytest.mark.parametrize(
    ("sql", "expected"),
    [
        ("SELECT id FROM cat.db.users", {("cat.db.users.id", "cat.db.users.id")}),
        ("SELECT u.id AS k FROM db.users u", {("db.users.k", "db.users.id")}),
        ("SELECT id FROM users u", {("u.id", "users.id")}),
        ("SELECT a, b FROM t JOIN s ON t.k = s.k", {("a", "a"), ("b", "b")}),
        ("SELECT x + y AS z, x * 2 FROM t", {("z", "t.x"), ("z", "t.y"), ("x * 2", "t.x")}),
        ("SELECT 'v' AS label FROM t", {("label", "label")}),
        ("SELECT a, NULL AS b FROM t UNION ALL SELECT c, 0 FROM s", {("t.a", "t.a"), ("t.a", "s.c"), ("b", "<literal: NULL>"), ("b", "<literal: 0>")}),
        ("SELECT row_number() OVER (PARTITION BY a ORDER BY b) AS rn FROM t", {("rn", "t.a"), ("rn", "t.b")}),
        ("SELECT CASE WHEN a > 1 THEN b ELSE c END AS d FROM t", {("d", "t.a"), ("d", "t.b"), ("d", "t.c")}),
        ("SELECT a.x FROM a LEFT SEMI JOIN b ON a.k = b.k", {("a.x", "a.x")}),
        ("SELECT e.item FROM t LATERAL VIEW explode(items) e AS item", {("e.item", "t.items")}),
        ("SELECT q.n FROM (SELECT m AS n FROM t) q", {("q.n", "t.m")}),
        ("SELECT (SELECT max(v) FROM s) AS top FROM t", {("top", "s.v")}),
        ("CREATE VIEW w AS (SELECT a FROM t)", {("t.a", "t.a")}),
        ("CREATE TABLE w AS SELECT a AS b FROM t", {("w.b", "t.a")}),
        ("CACHE LAZY TABLE w AS SELECT a FROM t", {("w.a", "t.a")}),
        ("INSERT INTO w (p, q) SELECT a, b FROM t", {("w.p", "t.a"), ("w.q", "t.b")}),
        ("WITH c AS (SELECT a FROM t) CREATE TABLE w AS SELECT a FROM c", {("w.a", "t.a")}),
        ("MERGE INTO w USING (SELECT k, v FROM t) s ON w.k = s.k WHEN MATCHED THEN UPDATE SET w.v = s.v", {("w.k", "t.k"), ("w.v", "t.v")}),
        ("UPDATE w SET v = s.v FROM (SELECT k, v FROM t) s WHERE w.k = s.k", {("w.k", "t.k"), ("w.v", "t.v")}),
        ("SELECT a FROM t INTERSECT SELECT b FROM s EXCEPT SELECT c FROM r", {("t.a", "t.a"), ("t.a", "s.b"), ("t.a", "r.c")}),
    ],
)
def test_naming_and_sources(spark, sql, expected):
    assert pairs(spark, sql) == expected


def test_views_of_a_file_are_leaves(spark):
    sql = "CREATE TEMP VIEW v AS SELECT a, b FROM t; CREATE TEMP VIEW w AS WITH c AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY b) AS n FROM v) SELECT * FROM c; INSERT OVERWRITE o SELECT * FROM w"
    found = items(spark, sql)
    assert {x for x in found if x[0] == 1} == {(1, "w.a", "v.a"), (1, "w.b", "v.b"), (1, "w.n", "v.a"), (1, "w.n", "v.b")}
    assert {x for x in found if x[0] == 2} == {(2, "o.a", "w.a"), (2, "o.b", "w.b"), (2, "o.n", "w.n")}


def test_stars(spark):
    assert pairs(spark, "SELECT t.*, s.z FROM t JOIN s ON t.k = s.k", schema={"t": {"k": "INT", "x": "INT"}}) == {("k", "t.k"), ("x", "t.x"), ("s.z", "s.z")}
    assert pairs(spark, "SELECT * FROM a LEFT ANTI JOIN b ON a.k = b.k", schema={"a": {"k": ""}, "b": {"k": "", "m": ""}}) == {("k", "a.k")}
    assert {o for o, _ in pairs(spark, "SELECT * FROM t")} == {"*"}
    with pytest.raises(StarResolutionError):
        items(spark, "SELECT * FROM t", no_star=True)


def test_skipped_and_filter(spark):
    a = Analyzer(spark, "DROP TABLE x; SELECT a FROM t; TRUNCATE TABLE y; CACHE TABLE z; CREATE TEMPORARY FUNCTION f AS 'c.D'")
    rows = a.lineage_rows()
    assert [r[1] for r in rows] == [1]
    assert [(s[1], s[2]) for s in a.skipped] == [(0, "DROP TABLE"), (2, "TRUNCATE"), (3, "CACHE TABLE"), (4, "CREATE FUNCTION")]
    assert "does not support lineage analysis" in a.skipped[0][3]
    assert [x[0] for x in items(spark, "SELECT a FROM first_t; SELECT b FROM second_t", table_filter="SECOND")] == [1]


def test_table_level_and_inventory(spark):
    assert pairs(spark, "INSERT INTO o SELECT a FROM t JOIN s ON t.k = s.k", level="table") == {("query_result", x) for x in ("o", "t", "s")}
    rows = Analyzer(spark, "WITH c AS (SELECT 1 AS k FROM b) MERGE INTO o USING c ON o.k = c.k WHEN MATCHED THEN DELETE; INSERT INTO o SELECT * FROM o; DELETE FROM d WHERE k IN (SELECT k FROM s); CREATE VIEW v AS SELECT 1 AS x").table_rows()
    assert [r[1:2] + r[3:] for r in rows] == [(0, "b", "INPUT", "UNKNOWN"), (0, "c", "INPUT", "CTE"), (0, "o", "OUTPUT", "UNKNOWN"), (1, "o", "BOTH", "UNKNOWN"), (2, "d", "OUTPUT", "UNKNOWN"), (2, "s", "INPUT", "UNKNOWN"), (3, "v", "OUTPUT", "VIEW")]


def test_schema_inference(spark):
    sql = "CREATE VIEW v AS SELECT a, b AS c FROM db.t; SELECT t.x, s.y, z FROM t JOIN s ON t.k = s.k"
    assert Analyzer(spark, sql).extract_schema_only() == {"v": {"a": "UNKNOWN", "c": "UNKNOWN"}, "db.t": {"a": "UNKNOWN", "b": "UNKNOWN"}, "t": {"x": "UNKNOWN", "k": "UNKNOWN"}, "s": {"y": "UNKNOWN", "k": "UNKNOWN"}}
    with pytest.raises(SchemaResolutionError):
        Analyzer(spark, sql, strict_schema=True).extract_schema_only()
    schema = {"t": {"b": "INT", "a": "STRING"}}
    assert schema_dict(schema_frame(spark, schema)) == schema
    assert nested_schema({"a.b": {"c": "x"}, "t": {"d": "y"}}) == {"a": {"b": {"c": "x"}}, "": {"t": {"d": "y"}}}


def test_schema_is_reset_between_calls(spark):
    a = Analyzer(spark, "SELECT * FROM v; CREATE VIEW v AS SELECT a FROM t")
    assert a.lineage_rows() == a.lineage_rows()


def test_errors(spark):
    with pytest.raises(ParseError, match="No valid SQL"):
        Analyzer(spark, "-- nothing")
    with pytest.raises(ParseError, match="Invalid SQL syntax"):
        Analyzer(spark, "SELEKT 1")
    with pytest.raises(ValueError, match="Dialect"):
        Analyzer(spark, "SELECT 1", dialect="tsql")
