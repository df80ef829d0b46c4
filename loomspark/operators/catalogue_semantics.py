"""Queries whose text means something else in Spark: order of nulls, casts, dates, division, QUALIFY, ordered aggregates."""

from __future__ import annotations

from .catalogue import of_sql

_NULLED = "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey % 10 END AS v FROM orders"

of_sql(
    "null_order",
    f"""SELECT o_orderkey, v, row_number() OVER (PARTITION BY o_orderstatus ORDER BY v, o_orderkey) AS up,
    row_number() OVER (PARTITION BY o_orderstatus ORDER BY v DESC, o_orderkey) AS down, rank() OVER (PARTITION BY o_orderstatus ORDER BY v NULLS FIRST) AS first_nulls FROM ({_NULLED}) AS x""",
)
of_sql("top_with_nulls", f"SELECT v, COUNT(*) AS n FROM ({_NULLED}) AS x GROUP BY v ORDER BY v LIMIT 4")
of_sql("bottom_with_nulls", f"SELECT o_orderkey, v FROM ({_NULLED}) AS x ORDER BY v DESC, o_orderkey LIMIT 7")
of_sql(
    "rounding_casts",
    """SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS whole, CAST((o_orderkey % 100) + 0.5 AS INTEGER) AS up, CAST(CAST(o_orderkey AS DOUBLE) / 2 AS BIGINT) AS even,
    TRY_CAST(CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE CAST(o_orderkey AS VARCHAR) || '.5' END AS BIGINT) AS parsed, (-(o_orderkey % 9) - 0.5)::INT AS down, (o_custkey > 50)::INT AS flag FROM orders""",
)
of_sql(
    "days_between",
    """WITH o AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT o_custkey, DATE '2000-01-01' - MAX(day) AS recency, MAX(day) - MIN(day) AS span, COUNT(*) AS n FROM o GROUP BY o_custkey""",
)
of_sql(
    "days_since_last",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) - LAG(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS gap FROM orders",
)
of_sql("next_month", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS later, CAST(CAST(o_orderdate AS DATE) - INTERVAL '10 days' AS DATE) AS before, CAST(o_orderdate AS DATE) + 3 AS soon FROM orders")
of_sql(
    "qualify_in_cte",
    f"""WITH latest AS (SELECT o_orderkey, o_orderstatus, v FROM ({_NULLED}) AS x QUALIFY row_number() OVER (PARTITION BY o_orderstatus, v ORDER BY o_orderkey DESC) = 1)
SELECT o_orderstatus, COUNT(*) AS n, COUNT(v) AS known, MAX(o_orderkey) AS last FROM latest GROUP BY o_orderstatus""",
)
of_sql(
    "qualify_in_union",
    """SELECT o_custkey AS k, o_orderkey FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) = 1
UNION ALL SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) <= 2""",
)
of_sql(
    "ordered_aggregates",
    """SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate DESC, o_orderkey) AS newest, string_agg(DISTINCT o_orderstatus, '' ORDER BY o_orderstatus) AS states,
    group_concat(o_orderpriority ORDER BY o_orderkey) AS priorities FROM orders GROUP BY o_custkey""",
)
of_sql("whole_division", "SELECT o_orderkey, o_orderkey // 7 AS q, -o_orderkey // 7 AS n, o_orderkey % 7 AS r, o_orderkey / 8 AS part FROM orders")
of_sql(
    "division_by_zero",
    """SELECT o_orderkey, r > 1e300 AS beyond, CASE WHEN r <= 1e300 THEN ROUND(r, 4) END AS r, q IS NULL AS undefined
FROM (SELECT o_orderkey, o_totalprice / (o_orderkey % 3) AS r, o_totalprice / NULLIF(o_orderkey % 3, 0) AS q FROM orders) AS x""",
)
of_sql("list_values", "SELECT n_nationkey, len([n_nationkey, n_regionkey]) AS n, [n_name, 'none'][2] AS second, [n_regionkey, 7][1] AS head FROM nation")
of_sql(
    "pattern_flags",
    """SELECT p_partkey, regexp_replace(p_name, '([A-Z])\\w*', '<\\1>', 'i') AS head, regexp_replace(p_name, '\\s+', '_', 'g') AS joined, regexp_replace(p_name, 'E', '.', 'gi') AS dotted,
    regexp_matches(p_type, '^[A-Z]+\\b') AS named, p_brand LIKE 'Brand#1%' AS ones FROM part""",
)
of_sql(
    "text_functions",
    """SELECT s_suppkey, SUBSTRING(s_name, 3, 5) AS mid, RIGHT(s_name, 3) AS tail, RPAD(LEFT(s_name, 2), 4, '*') AS padded, CHR(CAST(65 + s_nationkey AS INTEGER)) AS letter, REPEAT('ab', CAST(s_suppkey % 4 AS INTEGER)) AS again,
    CONCAT(s_name, '/', CAST(s_nationkey AS VARCHAR)) AS path, LOWER(s_name) AS low, strpos(s_name, '#') AS hash, 'it''s' AS quoted, 'a\\b' AS slash FROM supplier""",
)
of_sql(
    "number_functions",
    """SELECT s_suppkey, ABS(s_acctbal) AS a, CAST(CEIL(s_acctbal) AS BIGINT) AS c, CAST(FLOOR(s_acctbal) AS BIGINT) AS f, ROUND(SQRT(ABS(s_acctbal)), 6) AS s, MOD(s_suppkey, 5) AS m, LEAST(s_acctbal, 0) AS l, GREATEST(s_suppkey, s_nationkey) AS g,
    POWER(s_nationkey, 2) AS p, -s_acctbal AS n, CAST(SIGN(s_acctbal) AS INTEGER) AS sg FROM supplier""",
)
of_sql("scalar_subqueries", "SELECT r_regionkey, (SELECT COUNT(*) FROM nation WHERE n_regionkey = r_regionkey) AS nations, (SELECT MAX(c_acctbal) FROM customer) - r_regionkey AS rest FROM region")
of_sql("join_using", "SELECT k, COUNT(*) AS n, MIN(o) AS first FROM (SELECT c_custkey AS k, c_nationkey FROM customer) AS c JOIN (SELECT o_custkey AS k, o_orderkey AS o FROM orders) AS x USING (k) GROUP BY k")
of_sql(
    "customers_without_large_orders",
    "SELECT c.c_custkey FROM customer c LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 350000) AS o ON o.o_custkey = c.c_custkey WHERE o.o_custkey IS NULL",
)
of_sql("clock_and_chance", "SELECT r_regionkey, CURRENT_DATE > DATE '2020-01-01' AS later, random() < 1 AS below, CURRENT_DATE - CURRENT_DATE AS none FROM region")
