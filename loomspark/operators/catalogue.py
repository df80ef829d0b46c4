"""Queries over the test tables, each with SQL that gives the same rows.

SQL queries go through the front end: their text is that of the other engine. Frame queries use the library's
functions. Project queries run whole projects.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import joined
from ..model import Column, Kind, Model
from ..plans.runner import Runner, RunRequest
from ..sources.inference import PRECEDENCE, SENTINELS, detect_sentinels, infer_types
from ..sqlfront.dialect import translate
from ..streaming.feed import windowed
from . import analytics, data_tests
from .materialize import Backend

#: Schemas of the test tables: reading needs no job to infer them.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str


QUERIES: dict[str, Query] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    low = text.lower()
    for name in TABLES:
        if name in low:
            table(spark, sf_dir, name).createOrReplaceTempView(name)


def of_sql(name: str, sql: str, schema: dict[str, dict[str, str]] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, sql)
        return spark.sql(translate(sql, "duckdb", schema, lambda t: dict(spark.table(t).dtypes)))

    QUERIES[name] = Query(run, sql)


def frame(name: str, sql: str) -> Callable:
    def keep(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = Query(run, sql)
        return run

    return keep


# relational surface, as SQL of the other dialect

of_sql(
    "stg_orders",
    "SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS order_date, LOWER(TRIM(o_orderpriority)) AS priority, "
    "o_totalprice AS amount FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice IS NOT NULL",
)
of_sql(
    "daily_revenue",
    "SELECT CAST(o_orderdate AS DATE) AS day, COUNT(*) AS orders, COUNT(DISTINCT o_custkey) AS customers, ROUND(SUM(o_totalprice), 2) AS revenue, "
    "ROUND(AVG(o_totalprice), 7) AS mean_order FROM orders GROUP BY CAST(o_orderdate AS DATE) ORDER BY day",
)
of_sql(
    "order_facts",
    """WITH lines AS (
    SELECT l_orderkey, COUNT(*) AS n_lines, ROUND(SUM(l_extendedprice * (1 - l_discount)), 5) AS net, SUM(CAST(l_quantity AS BIGINT))::BIGINT AS quantity
    FROM lineitem GROUP BY l_orderkey)
SELECT o.o_orderkey, n.n_name AS nation, CAST(EXTRACT(YEAR FROM o.o_orderdate) AS INTEGER) AS order_year, CAST(EXTRACT(MONTH FROM o.o_orderdate) AS INTEGER) AS order_month,
       CAST(DATE_TRUNC('month', o.o_orderdate) AS DATE) AS month_start, COALESCE(l.n_lines, 0) AS n_lines, COALESCE(l.net, 0.0) AS net, COALESCE(l.quantity, 0) AS quantity
FROM orders o LEFT JOIN lines l ON l.l_orderkey = o.o_orderkey
JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey""",
)
of_sql(
    "customer_open_orders",
    "SELECT c.c_custkey, COUNT(o.o_orderkey) AS open_orders, ROUND(COALESCE(SUM(o.o_totalprice), 0), 2) AS open_value "
    "FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O' GROUP BY c.c_custkey",
)
#: Lines are aggregated by part before they meet the parts: what is shuffled is lines, and parts only once.
BY_PART = """WITH l AS (SELECT l_partkey, COUNT(*) AS lines, COUNT(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS returned_orders,
    SUM(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0.0 END) AS returned_value, SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned FROM lineitem GROUP BY l_partkey)
SELECT p_partkey, p_brand, COALESCE(lines, 0) AS lines, COALESCE(returned_orders, 0) AS returned_orders, ROUND(COALESCE(returned_value, 0.0), 2) AS returned_value,
    COALESCE(ROUND(CAST(returned AS DOUBLE) / NULLIF(lines, 0), 6), CAST(0 AS DOUBLE)) AS return_rate FROM part LEFT JOIN l ON l_partkey = p_partkey"""


@frame(
    "product_performance",
    """SELECT p.p_partkey, p.p_brand, COUNT(l.l_orderkey) AS lines,
    COUNT(DISTINCT CASE WHEN l.l_returnflag = 'R' THEN l.l_orderkey END) AS returned_orders,
    ROUND(SUM(CASE WHEN l.l_returnflag = 'R' THEN l.l_extendedprice ELSE 0.0 END), 2) AS returned_value,
    CASE WHEN COUNT(l.l_orderkey) = 0 THEN CAST(0 AS DOUBLE) ELSE ROUND(CAST(SUM(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(l.l_orderkey), 6) END AS return_rate
FROM part p LEFT JOIN lineitem l ON l.l_partkey = p.p_partkey GROUP BY p.p_partkey, p.p_brand""",
)
def product_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, BY_PART)
    return spark.sql(translate(BY_PART))


of_sql("top_customers", "SELECT o_custkey, ROUND(SUM(o_totalprice), 2) AS spent FROM orders GROUP BY o_custkey ORDER BY spent DESC, o_custkey LIMIT 10")
of_sql("distinct_flags", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
of_sql("union_keys", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer WHERE c_acctbal > 0")
of_sql("union_all_events", "SELECT event_type, COUNT(*) AS n FROM (SELECT event_type FROM events WHERE value > 50 UNION ALL SELECT event_type FROM events WHERE user_id < 100) AS e GROUP BY event_type HAVING COUNT(*) > 1")
of_sql("customers_without_orders", "SELECT c.c_custkey, c.c_name FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey WHERE o.o_orderkey IS NULL")
of_sql("above_average_orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1.5 * (SELECT AVG(o_totalprice) FROM orders)")
of_sql("comma_join", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name <> 'ASIA'")
of_sql("multi_key_join", "SELECT l.l_orderkey, l.l_linenumber, x.n AS same_part FROM lineitem l JOIN (SELECT l_partkey, l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey) AS x ON x.l_partkey = l.l_partkey AND x.l_suppkey = l.l_suppkey WHERE x.n > 1")
of_sql("inline_rows", "SELECT r_name, t.label, t.n FROM (VALUES (0, 'zero', 10), (1, 'one', 20), (9, 'nine', 30)) AS t(k, label, n) LEFT JOIN region ON r_regionkey = t.k")
of_sql("row_generator", "SELECT range % 7 AS bucket, COUNT(*) AS n, CAST(SUM(range) AS BIGINT) AS total FROM range(10000) GROUP BY 1 ORDER BY total DESC LIMIT 5")
of_sql("semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
of_sql("schema_only", "SELECT o_orderkey, o_totalprice FROM orders LIMIT 0")

# the front end: constructs that Spark spells or means otherwise

of_sql("latest_order_qualify", "SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
of_sql("months_since_first", "SELECT o_orderkey, CAST(DATE_DIFF('month', CAST('1995-01-31' AS DATE), CAST(o_orderdate AS DATE)) AS BIGINT) AS months, CAST(DATE_DIFF('day', CAST('1995-01-31' AS DATE), CAST(o_orderdate AS DATE)) AS BIGINT) AS days FROM orders")
of_sql("month_labels", "SELECT strftime(o_orderdate, '%Y-%m') AS month, COUNT(*) AS n FROM orders GROUP BY 1")
of_sql("replace_first", "SELECT p_partkey, regexp_replace(p_name, '([aeiou])', '<\\1>') AS first_only, regexp_replace(p_name, '[aeiou]', '*', 'g') AS every_one FROM part")
of_sql("power_operator", "SELECT p_partkey, CAST(p_size ^ 2 AS BIGINT) AS squared FROM part WHERE p_size ^ 2 > 100")
of_sql("exclude_columns", "SELECT * EXCLUDE (s_acctbal, s_nationkey) FROM supplier WHERE s_acctbal::BIGINT > 0")
of_sql("text_types", "SELECT CAST(c_custkey AS VARCHAR) || '-' || c_mktsegment AS \"label\", UPPER(REPLACE(c_name, '#', ' ')) AS named, LEFT(c_name, 3) AS head, LPAD(CAST(c_nationkey AS VARCHAR), 3, '0') AS padded, CAST(LENGTH(c_name) AS INTEGER) AS n FROM customer")
of_sql("mixed_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS class, COALESCE(NULLIF(o_orderpriority, '1-URGENT'), 'now') AS p FROM orders")
of_sql(
    "harmonized_comparison",
    "SELECT o.o_orderkey FROM orders o JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AS c ON TRY_CAST(c.c_custkey AS VARCHAR) = CAST(o.o_custkey AS VARCHAR)",
)
of_sql("active_window", "SELECT o_custkey, COUNT(*) AS n FROM orders WHERE o_orderdate >= CAST('1996-01-01' AS DATE) - INTERVAL '90 days' AND o_orderdate < CAST('1996-01-01' AS DATE) GROUP BY o_custkey")


# type repairs: the text that users write against text columns, and what the oracle has to spell out

TEXTS = "SELECT event_id, ts, CAST(event_id AS VARCHAR) AS id_text, CASE WHEN event_id % 10 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS value_text FROM events"
TEXT_TYPES = {"texts": {"event_id": "BIGINT", "ts": "TIMESTAMP", "id_text": "VARCHAR", "value_text": "VARCHAR"}}


def of_texts(name: str, sql: str, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, "events")
        spark.sql(translate(TEXTS)).createOrReplaceTempView("texts")
        return spark.sql(translate(sql, "duckdb", TEXT_TYPES))

    QUERIES[name] = Query(run, f"WITH texts AS ({TEXTS}) {oracle}")


of_texts(
    "repaired_aggregates",
    "SELECT event_id % 7 AS k, ROUND(SUM(value_text), 4) AS total, MAX(value_text) AS top FROM texts GROUP BY 1",
    "SELECT event_id % 7 AS k, ROUND(SUM(TRY_CAST(value_text AS DOUBLE)), 4) AS total, MAX(TRY_CAST(value_text AS DOUBLE)) AS top FROM texts GROUP BY 1",
)
of_texts(
    "repaired_comparison",
    "SELECT t.event_id FROM texts t WHERE t.value_text > 90.5 AND t.event_id = t.id_text",
    "SELECT t.event_id FROM texts t WHERE TRY_CAST(t.value_text AS DOUBLE) > 90.5 AND t.event_id = TRY_CAST(t.id_text AS BIGINT)",
)
of_texts(
    "repaired_days",
    "SELECT event_id, CAST(ts - 2 AS DATE) AS before, CAST(ts + 1 AS DATE) AS after FROM texts",
    "SELECT event_id, CAST(ts - INTERVAL '2' DAY AS DATE) AS before, CAST(ts + INTERVAL '1' DAY AS DATE) AS after FROM texts",
)
of_texts(
    "repaired_case",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'third' WHEN event_id % 3 = 1 THEN 1 ELSE CASE WHEN event_id > 50 THEN UPPER(id_text) ELSE -2 END END AS label FROM texts",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'third' WHEN event_id % 3 = 1 THEN '1' ELSE CASE WHEN event_id > 50 THEN UPPER(id_text) ELSE '-2' END END AS label FROM texts",
)


# analytics


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("customer"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"))


def customer_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("customer")).agg(
        F.datediff(F.lit("2000-01-01").cast("date"), F.max("o_orderdate").cast("date")).cast("long").alias("recency"),
        F.count(F.lit(1)).alias("frequency"),
        F.round(F.sum("o_totalprice"), 2).alias("monetary"),
    )


INPUTS = "SELECT o_custkey AS customer, CAST(DATE_DIFF('day', CAST(MAX(o_orderdate) AS DATE), DATE '2000-01-01') AS BIGINT) AS recency, COUNT(*) AS frequency, ROUND(SUM(o_totalprice), 2) AS monetary FROM orders GROUP BY o_custkey"


def _codes(column: str, name: str) -> str:
    edges = ", ".join(f"quantile_cont({column}, {q}) AS e{i}" for i, q in enumerate((0, 0.2, 0.4, 0.6, 0.8, 1)))
    return f"{name} AS (SELECT list_sort(list_distinct([CAST(e0 AS DOUBLE), e1, e2, e3, e4, CAST(e5 AS DOUBLE)])) AS e FROM (SELECT {edges} FROM i))"


def _code(column: str, name: str) -> str:
    return f"CASE WHEN len({name}.e) < 2 THEN 3 ELSE 1 + len(list_filter({name}.e[2:len({name}.e) - 1], lambda x: x < {column})) END"


@frame(
    "rfm_scores",
    f"""WITH i AS ({INPUTS}), {_codes('recency', 'qr')}, {_codes('frequency', 'qf')}, {_codes('monetary', 'qm')},
s AS (SELECT i.*, CAST(6 - ({_code('recency', 'qr')}) AS INTEGER) AS r, CAST({_code('frequency', 'qf')} AS INTEGER) AS f, CAST({_code('monetary', 'qm')} AS INTEGER) AS m FROM i, qr, qf, qm)
SELECT customer, recency, frequency, monetary, r, f, m, r * 100 + f * 10 + m AS rfm_score,
CASE WHEN r * 100 + f * 10 + m >= 454 THEN 'champion' WHEN r * 100 + f * 10 + m >= 344 THEN 'loyal' WHEN r * 100 + f * 10 + m >= 234 THEN 'potential' WHEN r * 100 + f * 10 + m >= 123 THEN 'at_risk' ELSE 'hibernating' END AS tier FROM s""",
)
def rfm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.rfm(customer_inputs(spark, sf_dir), "customer", "recency", "frequency", "monetary")


@frame(
    "cohort_retention",
    """WITH o AS (SELECT o_custkey AS customer, CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS month FROM orders),
f AS (SELECT customer, MIN(month) AS cohort FROM o GROUP BY customer),
z AS (SELECT cohort, COUNT(*) AS cohort_size FROM f GROUP BY cohort),
a AS (SELECT cohort, month, COUNT(DISTINCT f.customer) AS active FROM f JOIN o ON o.customer = f.customer WHERE month >= cohort GROUP BY cohort, month)
SELECT a.cohort, a.month, active, cohort_size, CAST(DATE_DIFF('month', a.cohort, a.month) AS INTEGER) AS months, ROUND(active / cohort_size, 6) AS retention FROM a JOIN z ON z.cohort = a.cohort""",
)
def cohort_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = monthly(spark, sf_dir)
    first = o.groupBy("customer").agg(F.min("month").alias("cohort"))
    return analytics.cohorts(first, o, "customer", "cohort", "month", []).withColumn("retention", F.round("retention", 6))


@frame(
    "revenue_anomalies",
    """WITH d AS (SELECT o_orderpriority AS priority, CAST(o_orderdate AS DATE) AS day, ROUND(SUM(o_totalprice), 2) AS revenue FROM orders GROUP BY 1, 2),
r AS (SELECT *, COUNT(*) OVER w AS n, AVG(revenue) OVER w AS a, STDDEV_SAMP(revenue) OVER w AS s FROM d WINDOW w AS (PARTITION BY priority ORDER BY day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
z AS (SELECT priority, day, revenue, CASE WHEN n < 3 THEN 0.0 WHEN s = 0 THEN CASE WHEN revenue = a THEN 0.0 ELSE 1e9 END ELSE (revenue - a) / s END AS z FROM r)
SELECT priority, day, revenue, ROUND(z, 4) AS z, ABS(z) >= 2 AS is_anomaly FROM z""",
)
def revenue_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    daily = o.groupBy(F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").cast("date").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    found = analytics.anomalies(daily, "revenue", ["priority"], "day")
    return found.select("priority", "day", "revenue", F.round("z", 4).alias("z"), "is_anomaly")


SEGMENTS = f"""WITH i AS ({INPUTS}),
w AS (SELECT o_custkey AS customer, COUNT(*) AS in_window FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY o_custkey),
s AS (SELECT c.c_custkey AS customer, COALESCE(i.frequency, 0) AS frequency, COALESCE(i.monetary, 0.0) AS monetary,
CASE WHEN COALESCE(i.frequency, 0) >= 15 AND COALESCE(i.monetary, 0) >= 100000 THEN 'vip' WHEN w.in_window >= 3 THEN 'loyal' WHEN w.in_window IS NOT NULL THEN 'regular'
WHEN i.recency <= 365 THEN 'at_risk' ELSE 'lost' END AS segment
FROM customer c LEFT JOIN i ON i.customer = c.c_custkey LEFT JOIN w ON w.customer = c.c_custkey)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = table(spark, sf_dir, "orders").where("o_orderdate >= '1998-01-01'").groupBy(F.col("o_custkey").alias("customer")).agg(F.count(F.lit(1)).alias("in_window"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"))
    df = c.join(customer_inputs(spark, sf_dir), "customer", "left").join(recent, "customer", "left")
    kind = analytics.segment(F.col("frequency"), F.col("monetary"), F.col("in_window"), F.col("recency"), 15, 100000.0)
    return df.select("customer", F.coalesce("frequency", F.lit(0)).alias("frequency"), F.coalesce("monetary", F.lit(0.0)).alias("monetary"), kind.alias("segment"))


@frame("customer_segments", SEGMENTS + " SELECT * FROM s")
def customer_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir)


@frame(
    "customer_lifetime_value",
    SEGMENTS
    + """ SELECT customer, segment, CASE segment WHEN 'vip' THEN 36 WHEN 'loyal' THEN 24 WHEN 'regular' THEN 18 WHEN 'at_risk' THEN 9 ELSE 3 END AS expected_months,
ROUND(CASE WHEN frequency = 0 THEN 0.0 ELSE monetary / frequency END * frequency / 2 * CASE segment WHEN 'vip' THEN 36 WHEN 'loyal' THEN 24 WHEN 'regular' THEN 18 WHEN 'at_risk' THEN 9 ELSE 3 END / 12, 5) AS ltv FROM s""",
)
def customer_lifetime_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.lifetime_value(segments(spark, sf_dir), "segment", "frequency", "monetary").select("customer", "segment", "expected_months", "ltv")


@frame("priorities_joined", "SELECT o_custkey, STRING_AGG(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_custkey")
def priorities_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(joined(F.col("o_orderpriority")).alias("priorities"))


# data tests, inference, sentinels


@frame(
    "data_test_failures",
    """SELECT 'not_null' AS test, (SELECT COUNT(*) FROM lineitem WHERE l_shipdate IS NULL) AS failing
UNION ALL SELECT 'unique', (SELECT COUNT(*) FROM (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey HAVING COUNT(*) > 1) AS d)
UNION ALL SELECT 'relationships', (SELECT COUNT(*) FROM orders o LEFT JOIN (SELECT DISTINCT c_custkey FROM customer WHERE c_acctbal > 0) AS c ON c.c_custkey = o.o_custkey WHERE o.o_custkey IS NOT NULL AND c.c_custkey IS NULL)
UNION ALL SELECT 'accepted_values', (SELECT COUNT(*) FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('F', 'O'))""",
)
def data_test_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    counts = {
        "not_null": data_tests.not_null(lines, "l_shipdate"),
        "unique": data_tests.unique(orders, "o_custkey"),
        "relationships": data_tests.relationships(orders, "o_custkey", table(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey"),
        "accepted_values": data_tests.accepted_values(orders, "o_orderstatus", ["F", "O"]),
    }
    return spark.createDataFrame(list(counts.items()), "test string, failing long")


_TEXTS = "SELECT CAST(event_id AS VARCHAR) AS a, CAST(value AS VARCHAR) AS b, CAST(CAST(ts AS DATE) AS VARCHAR) AS c, event_type AS d, CASE WHEN event_id % 10 = 0 THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS e FROM events"


@frame(
    "inferred_types",
    "SELECT * FROM (VALUES ('a', 'BIGINT'), ('b', 'DOUBLE'), ('c', 'DATE'), ('d', 'VARCHAR'), ('e', 'VARCHAR')) AS t(name, type)",
)
def inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "events")
    found = infer_types(spark.sql(translate(_TEXTS)))
    return spark.createDataFrame(sorted(found.types.items()), "name string, type string")


@frame(
    "inference_failures",
    f"""WITH t AS ({_TEXTS})
SELECT 'a' AS name, 'BIGINT' AS type, COUNT(*) FILTER (NOT regexp_full_match(trim(a), '-?[0-9]+')) AS failing FROM t
UNION ALL SELECT 'b', 'BIGINT', COUNT(*) FILTER (NOT regexp_full_match(trim(b), '-?[0-9]+')) FROM t
UNION ALL SELECT 'c', 'DATE', COUNT(*) FILTER (NOT regexp_full_match(trim(c), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) FROM t
UNION ALL SELECT 'd', 'DOUBLE', COUNT(*) FILTER (TRY_CAST(d AS DOUBLE) IS NULL AND d IS NOT NULL) FROM t
UNION ALL SELECT 'e', 'BIGINT', COUNT(*) FILTER (NOT regexp_full_match(trim(e), '-?[0-9]+')) FROM t""",
)
def inference_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "events")
    found = infer_types(spark.sql(translate(_TEXTS))).failures
    wanted = (("a", "BIGINT"), ("b", "BIGINT"), ("c", "DATE"), ("d", "DOUBLE"), ("e", "BIGINT"))
    assert set(PRECEDENCE) >= {k for _, k in wanted}
    return spark.createDataFrame([(c, k, found[c][k]) for c, k in wanted], "name string, type string, failing long")


@frame(
    "sentinel_shares",
    f"WITH t AS ({_TEXTS}), c AS (SELECT 'e' AS name, e AS v FROM t UNION ALL SELECT 'd', d FROM t) "
    f"SELECT name, v AS sentinel, ROUND(COUNT(*) / ANY_VALUE(n), 4) AS share FROM (SELECT name, v, COUNT(*) OVER (PARTITION BY name) AS n FROM c WHERE v IS NOT NULL) AS x "
    f"WHERE v IN ({', '.join(repr(s) for s in SENTINELS)}) GROUP BY name, v HAVING COUNT(*) / ANY_VALUE(n) >= 0.02",
)
def sentinel_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "events")
    found = detect_sentinels(spark.sql(translate(_TEXTS)), ["d", "e"])
    return spark.createDataFrame([(c, s, x) for c, p in found.items() for s, x in p.shares.items()], "name string, sentinel string, share double")


# whole projects and scripts


def _schema(name: str) -> str:
    return f"loom_{name}"


def _project(files: dict[str, str], name: str) -> Path:
    root = Path(tempfile.mkdtemp(prefix="loom-project-"))
    for path, text in {"loom.yaml": f"name: {name}\ndefault_schema: {_schema(name)}\njinja: true\nvars:\n  least: 1000\n", **files}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


def _seed(sf_dir: str, name: str) -> str:
    return f"SELECT * FROM parquet.`{sf_dir}/{name}.parquet`"


@frame(
    "project_run",
    """WITH s AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS day, o_totalprice AS amount FROM orders WHERE o_totalprice >= 1000)
SELECT strftime(day, '%Y-%m') AS month, COUNT(*) AS orders, ROUND(SUM(amount), 2) AS revenue, CASE WHEN SUM(amount) > 1000000 THEN 'high' ELSE 'low' END AS class FROM s GROUP BY 1""",
)
def project_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = {
        "macros/dates.sql": "{% macro month_of(c) -%} strftime({{ c }}, '%Y-%m') {%- endmacro %}",
        "models/raw_orders.sql": _seed(sf_dir, "orders"),
        "models/stg_orders.sql": "SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS day, o_totalprice AS amount FROM {{ ref('raw_orders') }} WHERE o_totalprice >= {{ var('least') }}",
        "models/monthly.sql": "SELECT {{ month_of('day') }} AS month, COUNT(*) AS orders, ROUND(SUM(amount), 2) AS revenue FROM {{ ref('stg_orders') }} GROUP BY 1",
        "models/classes.py": "from pyspark.sql import functions as F\nfrom loomspark.model import transform\n\n@transform(depends_on=['monthly'])\ndef classes(ctx):\n    df = ctx.ref('monthly')\n    return df.withColumn('class', F.when(F.col('revenue') > 1000000, 'high').otherwise('low'))\n",
        "models/schema.yml": "models:\n  - name: raw_orders\n    materialization: view\n  - name: stg_orders\n    materialization: ephemeral\n    columns:\n      - name: order_id\n        tests: [not_null, unique]\n",
    }
    report = Runner(_project(files, "project_run"), spark).run(RunRequest(test=True, history=False))
    if not report.ok:
        raise RuntimeError([(m.model.name, m.error) for m in report.models] + report.tests)
    return spark.table(f"{_schema('project_run')}.classes")


@frame(
    "incremental_upsert",
    """WITH b AS (SELECT event_id, user_id, value, 1 AS batch FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, user_id, value * 2, 2 FROM events WHERE event_id % 3 <> 1)
SELECT event_id, user_id, value, batch FROM b QUALIFY ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY batch DESC) = 1""",
)
def incremental_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    backend = Backend(spark, _schema("incremental"))
    backend.write_incremental("latest", e.where("event_id % 3 <> 0").withColumn("batch", F.lit(1)), ["event_id"], full_refresh=True)
    backend.write_incremental("latest", e.where("event_id % 3 <> 1").withColumn("value", F.col("value") * 2).withColumn("batch", F.lit(2)), ["event_id"])
    return backend.table("latest")


@frame(
    "script_with_changes",
    """SELECT r_name AS region, CASE WHEN r_name = 'ASIA' THEN 0 ELSE COUNT(*) END AS nations, COUNT(*) * 10 AS score FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'AFRICA' GROUP BY r_name
UNION ALL SELECT 'NOWHERE', 0, 0""",
)
def script_with_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    backend = Backend(spark, _schema("script"))
    backend.execute(
        f"""CREATE OR REPLACE TABLE n AS {_seed(sf_dir, 'nation')};
CREATE OR REPLACE TABLE r AS {_seed(sf_dir, 'region')};
CREATE OR REPLACE TABLE totals AS SELECT r_name AS region, COUNT(*) AS nations, COUNT(*) * 10 AS score FROM n JOIN r ON n_regionkey = r_regionkey GROUP BY r_name;
UPDATE totals SET nations = 0 WHERE region = 'ASIA';
DELETE FROM totals WHERE region = 'AFRICA';
INSERT INTO totals VALUES ('NOWHERE', 0, 0)""",
        parallelism=3,
    )
    return backend.table("totals")


@frame(
    "merged",
    "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS balance FROM customer UNION ALL SELECT -1 - s_suppkey, s_acctbal FROM supplier",
)
def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    backend = Backend(spark, _schema("merge"))
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    backend.write_table("target", c.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")))
    changes = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") + 1).alias("balance"))
    backend.write_table("changes", changes.unionByName(s.select((-1 - F.col("s_suppkey")).alias("id"), F.col("s_acctbal").alias("balance"))))
    backend.execute("MERGE INTO target t USING changes c ON t.id = c.id WHEN MATCHED THEN UPDATE SET balance = c.balance WHEN NOT MATCHED THEN INSERT (id, balance) VALUES (c.id, c.balance)")
    return backend.table("target")


@frame("split_script", "SELECT o_orderpriority AS priority, ROUND(SUM(o_totalprice), 2) AS revenue FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority")
def split_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..migrate import write_split

    root = _project({}, "split_script")
    found = write_split(f"CREATE TABLE raw AS {_seed(sf_dir, 'orders')}; CREATE VIEW closed AS SELECT * FROM raw WHERE o_orderstatus = 'F'; CREATE TABLE by_priority AS SELECT o_orderpriority AS priority, ROUND(SUM(o_totalprice), 2) AS revenue FROM closed GROUP BY 1", root / "models")
    assert [m.name for m in found.models] == ["raw", "closed", "by_priority"]
    report = Runner(root, spark).run(RunRequest(history=False))
    if not report.ok:
        raise RuntimeError([(m.model.name, m.error) for m in report.models])
    return spark.table(f"{_schema('split_script')}.by_priority")


@frame("fused_data_tests", "SELECT 'order_id' AS name, 'not_null' AS test, CAST(0 AS BIGINT) AS failing UNION ALL SELECT 'status', 'accepted_values', (SELECT COUNT(*) FROM orders WHERE o_orderstatus NOT IN ('F')) UNION ALL SELECT 'order_id', 'unique', 0")
def fused_data_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    backend = Backend(spark, _schema("tests"))
    backend.write_temporary("o", table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status")))
    m = Model("o", Kind.SQL, columns=[Column("order_id", tests=["not_null", "unique"]), Column("status", tests=[{"accepted_values": {"values": ["F"]}}])])
    rows = [(t.column, t.name, t.failing_rows) for t in data_tests.DataTests(backend).run_model(m)]
    return spark.createDataFrame(rows, "name string, test string, failing long")


@frame(
    "run_history_summary",
    """WITH r AS (SELECT 'm' || CAST(o_custkey % 5 AS VARCHAR) AS name, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'success' END AS status FROM orders)
SELECT name, COUNT(*) AS runs, ROUND(AVG(CASE WHEN status = 'success' THEN 1.0 ELSE 0.0 END), 6) AS success_rate, arg_max(status, o_orderkey) AS last_status FROM r GROUP BY name""",
)
def run_history_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..observe.reliability import summary

    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "failed").otherwise("success")
    rows = o.select(F.concat(F.lit("m"), (F.col("o_custkey") % 5).cast("string")).alias("name"), F.timestamp_seconds("o_orderkey").alias("started_at"), status.alias("status"), F.lit(1.0).alias("elapsed_seconds"))
    return summary(rows).select("name", "runs", F.round("success_rate", 6).alias("success_rate"), "last_status")


# streams, an extension


@frame(
    "stream_hourly_events",
    "SELECT DATE_TRUNC('hour', ts) AS hour, event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1, 2",
)
def stream_hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    counted = windowed(stream, "ts", ["event_type"], "value")
    name = "loom_stream_hourly"
    q = counted.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.col("window_start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


from . import catalogue_engine, catalogue_semantics, catalogue_surface  # noqa: E402, F401  their queries are added to the ones above
