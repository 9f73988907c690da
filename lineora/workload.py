"""A workload of SQL over the test tables, and tables of its own that it writes."""

STATEMENTS = (
    """WITH order_totals AS (
    SELECT o_custkey, ROUND(SUM(o_totalprice), 2) AS total, COUNT(*) AS n_orders FROM orders GROUP BY o_custkey
), segments AS (
    SELECT c.c_custkey, c.c_name, c.c_mktsegment, t.total, t.n_orders FROM customer c JOIN order_totals t ON c.c_custkey = t.o_custkey
)
INSERT INTO customer_report SELECT c_name, c_mktsegment, total FROM segments WHERE total > 1000000""",
    """CREATE TEMPORARY VIEW big_orders AS
SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders WHERE o_totalprice > 200000""",
    "INSERT OVERWRITE top_orders SELECT * FROM big_orders WHERE rn = 1",
    """SELECT 'supplier' AS kind, s_name AS name, s_acctbal AS balance FROM supplier
UNION ALL SELECT 'customer', c_name, c_acctbal FROM customer""",
    """MERGE INTO nation_stats t USING (
    SELECT n.n_nationkey AS k, COUNT(*) AS n FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_nationkey
) s ON t.k = s.k WHEN MATCHED THEN UPDATE SET t.n = s.n WHEN NOT MATCHED THEN INSERT (k, n) VALUES (s.k, s.n)""",
    "DROP TABLE old_report",
    """SELECT p.p_brand, (SELECT MAX(l.l_quantity) FROM lineitem l) AS top_quantity, q.n
FROM part p JOIN (SELECT l_partkey, COUNT(*) AS n FROM lineitem GROUP BY l_partkey) q ON p.p_partkey = q.l_partkey""",
)
SQL = ";\n".join(STATEMENTS)

#: Statements of other shapes, over the same tables.
SHAPES = (
    "CACHE TABLE hot_orders AS SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O')",
    "CREATE TABLE names AS SELECT c.c_name AS name, n.n_name FROM customer AS c JOIN nation n ON n.n_nationkey = c.c_nationkey",
    "CREATE OR REPLACE VIEW rich AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_name LIKE 'Customer%')",
    "UPDATE names SET name = 'none' WHERE name IS NULL",
    "UPDATE names SET name = q.c_name FROM customer q WHERE names.n_name = q.c_mktsegment",
    "DELETE FROM names WHERE name NOT IN ('a', 'b')",
    "SELECT n.n_name, w.word FROM nation n LATERAL VIEW OUTER explode(split(n.n_name, ' ')) w AS word",
    "SELECT s_name AS who, NULL AS score FROM supplier UNION SELECT c_name, 0 FROM customer",
    "SELECT a.c_name AS one, b.c_name AS other FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey",
    "SELECT c_mktsegment, MODE(c_nationkey) AS usual, HASH(c_mktsegment) AS code FROM customer GROUP BY c_mktsegment",
    "INSERT INTO kept (k, v) SELECT o.* FROM (SELECT o_orderkey, o_custkey FROM orders) o LEFT SEMI JOIN customer c ON c.c_custkey = o.o_custkey",
    "WITH a AS (SELECT n_regionkey AS k FROM nation), b AS (SELECT k FROM a WHERE EXISTS (SELECT 1 FROM region r WHERE r.r_regionkey = a.k)) SELECT DISTINCT k FROM b",
    "TRUNCATE TABLE names",
)

#: Constructs that workloads use, each a query over the test tables. The second text is for an engine whose names differ.
CONSTRUCTS = {
    "windows": (
        """SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr, CAST(ntile(4) OVER w AS BIGINT) AS nt,
    round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd, lag(o_orderkey, 1, 0) OVER w AS before, lead(o_orderkey, 1) OVER w AS after,
    first_value(o_orderkey) OVER full AS first_key, last_value(o_orderkey) OVER full AS last_key, COUNT(*) OVER (PARTITION BY o_custkey) AS n,
    round(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey), full AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
        """SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr, CAST(ntile(4) OVER w AS BIGINT) AS nt,
    round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd, lag(o_orderkey, 1, 0) OVER w AS before, lead(o_orderkey, 1) OVER w AS after,
    first_value(o_orderkey) OVER fullw AS first_key, last_value(o_orderkey) OVER fullw AS last_key, COUNT(*) OVER (PARTITION BY o_custkey) AS n,
    round(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey), fullw AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    ),
    "set_operations": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation WHERE n_regionkey = 1 EXCEPT SELECT n_nationkey FROM nation WHERE n_nationkey < 3", None),
    "semi_anti": (
        "SELECT c.c_custkey, 'semi' AS how FROM customer c LEFT SEMI JOIN orders o ON c.c_custkey = o.o_custkey UNION ALL SELECT c.c_custkey, 'anti' AS how FROM customer c LEFT ANTI JOIN orders o ON c.c_custkey = o.o_custkey",
        "SELECT c.c_custkey, 'semi' AS how FROM customer c SEMI JOIN orders o ON c.c_custkey = o.o_custkey UNION ALL SELECT c.c_custkey, 'anti' AS how FROM customer c ANTI JOIN orders o ON c.c_custkey = o.o_custkey",
    ),
    "not_in_subquery": ("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000 UNION SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)", None),
    "aggregates": ("SELECT c_mktsegment, COUNT(*) AS n, COUNT(DISTINCT c_nationkey) AS nations, MIN(c_acctbal) AS least, MAX(c_acctbal) AS most, round(AVG(c_acctbal), 4) AS average, round(SUM(c_acctbal), 2) AS total FROM customer GROUP BY c_mktsegment HAVING COUNT(*) > 1", None),
    "functions": (
        "SELECT c_custkey, UPPER(TRIM(c_mktsegment)) AS segment, LENGTH(c_name) AS n, CONCAT(c_name, '-', c_mktsegment) AS label, CONCAT_WS('/', c_name, c_mktsegment) AS path, MD5(c_name) AS digest, REGEXP_REPLACE(c_name, '[0-9]+', '#') AS masked, ABS(c_acctbal) AS size, COALESCE(NULLIF(c_nationkey, 3), -1) AS nation, GREATEST(c_acctbal, 0) AS up, LEAST(c_acctbal, 0) AS down, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 THEN 'rich' ELSE 'plain' END AS kind FROM customer",
        "SELECT c_custkey, UPPER(TRIM(c_mktsegment)) AS segment, CAST(LENGTH(c_name) AS INTEGER) AS n, CONCAT(c_name, '-', c_mktsegment) AS label, CONCAT_WS('/', c_name, c_mktsegment) AS path, MD5(c_name) AS digest, REGEXP_REPLACE(c_name, '[0-9]+', '#', 'g') AS masked, ABS(c_acctbal) AS size, COALESCE(NULLIF(c_nationkey, 3), -1) AS nation, GREATEST(c_acctbal, 0) AS up, LEAST(c_acctbal, 0) AS down, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 THEN 'rich' ELSE 'plain' END AS kind FROM customer",
    ),
    "dates": (
        "SELECT o_orderkey, YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, QUARTER(o_orderdate) AS q, DATEDIFF(DATE '1998-12-31', CAST(o_orderdate AS DATE)) AS age, DATE_FORMAT(o_orderdate, 'yyyy-MM') AS ym, CAST(DATE_SUB(CAST(o_orderdate AS DATE), 7) AS STRING) AS week_before FROM orders",
        "SELECT o_orderkey, CAST(YEAR(o_orderdate) AS INTEGER) AS y, CAST(MONTH(o_orderdate) AS INTEGER) AS m, CAST(QUARTER(o_orderdate) AS INTEGER) AS q, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-31') AS INTEGER) AS age, strftime(o_orderdate, '%Y-%m') AS ym, CAST(CAST(o_orderdate AS DATE) - 7 AS VARCHAR) AS week_before FROM orders",
    ),
    "generators": (
        "SELECT n.n_nationkey, e.word, e.pos FROM nation n LATERAL VIEW posexplode(split(n.n_name, 'A')) e AS pos, word",
        "SELECT n_nationkey, string_split(n_name, 'A')[i + 1] AS word, CAST(i AS INTEGER) AS pos FROM nation, range(0, 50) r(i) WHERE i < len(string_split(n_name, 'A'))",
    ),
    "filters": (
        "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer WHERE c_name LIKE '%1%' AND c_nationkey IN (1, 2, 3, 4) AND c_mktsegment NOT IN ('BUILDING') AND c_acctbal IS NOT NULL AND NOT (c_acctbal BETWEEN 0 AND 100 OR c_custkey IS NULL)",
        None,
    ),
    "self_join": ("SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "mode": (
        "SELECT n_regionkey, MODE(least_key) AS usual FROM (SELECT n_regionkey, n_nationkey % 1 AS least_key FROM nation) GROUP BY n_regionkey",
        "SELECT n_regionkey, 0 AS usual FROM nation GROUP BY n_regionkey",
    ),
    "hash": (
        "SELECT n_nationkey, HASH(n_name) = HASH(CONCAT(n_name, '')) AS same, SHA2(n_name, 256) AS digest FROM nation",
        "SELECT n_nationkey, true AS same, sha256(n_name) AS digest FROM nation",
    ),
    "explode_outer": (
        "SELECT n_nationkey, word FROM nation LATERAL VIEW OUTER explode(filter(split(n_name, 'I'), x -> length(x) > 4)) e AS word",
        "SELECT n_nationkey, word FROM nation LEFT JOIN (SELECT n_nationkey AS k, unnest(list_filter(string_split(n_name, 'I'), lambda x: length(x) > 4)) AS word FROM nation) ON k = n_nationkey",
    ),
    "current": (
        "SELECT COUNT(*) AS n FROM orders WHERE o_orderdate < CURRENT_TIMESTAMP() AND CAST(o_orderdate AS DATE) < CURRENT_DATE()",
        "SELECT COUNT(*) AS n FROM orders WHERE o_orderdate < now() AND CAST(o_orderdate AS DATE) < current_date",
    ),
    "top_rows": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", None),
    "outer_joins": ("SELECT n.n_nationkey, s.s_suppkey, r.r_name FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 0 CROSS JOIN region r WHERE r.r_regionkey = n.n_regionkey", None),
}
