"""The registered queries and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import ID, LABEL, Edge, Graph
from .api import Store
from .functions import similarity, values
from .functions.work import new_folder
from .operators import discover, edges, paths, records, schema, vectors
from .plans.search import labels_histogram, search, total
from .sources import connectors, csv_files, json_import, star
from .streaming.changes import bucketed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

FLAGSHIP = {
    "labels": ["NATION"],
    "where": {"CUSTOMER": {"c_mktsegment": "BUILDING", "ORDER": {"$alias": "$o", "o_totalprice": {"$gt": 1000}}}},
    "select": {"revenue": {"$sum": "$o.o_totalprice"}, "orders": {"$count": "$o"}},
    "groupBy": ["$record.n_name"],
    "orderBy": {"revenue": "desc"},
    "limit": 10,
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(star.load(spark, sf_dir, ["NATION", "CUSTOMER", "ORDER"]), FLAGSHIP).withColumn("revenue", F.round("revenue", 2))


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


def ask(name: str, labels: str, query: dict, columns: list[str], sql: str, full_scan: bool = True, **how) -> None:
    """Registers a search over some labels, the first of which is asked for unless the query names others."""
    needed = labels.split()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = star.load(spark, sf_dir, needed)
        return search(graph, {"labels": needed[:1]} | query, full_scan=full_scan, **how).selectExpr(*columns)

    register(name, sql)(run)


def rounded(name: str, digits: int = 2) -> str:
    return f"round({name}, {digits}) AS {name}"


register(
    "flagship",
    """SELECT n_name, round(sum(o_totalprice), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM nation
    JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
    WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 1000 GROUP BY n_name ORDER BY sum(o_totalprice) DESC, n_name LIMIT 10""",
)(flagship)

# scans

ask("scan_label", "SUPPLIER", {}, ["s_suppkey", "s_name", "__label AS label"], "SELECT s_suppkey, s_name, 'SUPPLIER' AS label FROM supplier")
ask(
    "scan_multi_label", "NATION REGION", {"labels": ["NATION", "REGION"]}, ["__id AS id", "__label AS label", "n_name", "r_name"],
    "SELECT 'NATION:' || n_nationkey AS id, 'NATION' AS label, n_name, NULL AS r_name FROM nation UNION ALL SELECT 'REGION:' || r_regionkey, 'REGION', NULL, r_name FROM region",
)
ask("find_all", "REGION", {}, ["r_regionkey", "r_name"], "SELECT r_regionkey, r_name FROM region")
ask("find_by_id", "CUSTOMER", {"where": {"$id": "CUSTOMER:7"}}, ["c_custkey", "c_name"], "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7")
ask(
    "find_from_id", "ORDER CUSTOMER NATION", {"id": "CUSTOMER:7"}, ["o_orderkey", "o_totalprice"],
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7",
)
ask("find_one", "CUSTOMER", {"where": {"c_custkey": {"$lt": 50}}, "orderBy": {"c_custkey": "desc"}, "limit": 1}, ["c_custkey"], "SELECT max(c_custkey) AS c_custkey FROM customer WHERE c_custkey < 50", full_scan=False)
ask("find_uniq", "CUSTOMER", {"where": {"c_name": "Customer#000000007"}, "limit": 1}, ["c_custkey"], "SELECT c_custkey FROM customer WHERE c_name = 'Customer#000000007'", full_scan=False)

# predicates on one property

ORDERS = {
    "filter_eq": ({"o_orderstatus": "O"}, "o_orderstatus = 'O'"),
    "filter_eq_op": ({"o_note": {"$eq": None}}, "note IS NULL"),
    "filter_ne": ({"o_note": {"$ne": "1-URGENT"}}, "note <> '1-URGENT'"),
    "filter_range": ({"o_totalprice": {"$gte": 200000}}, "o_totalprice >= 200000"),
    "filter_between": ({"o_totalprice": {"$gt": 100000, "$lte": 200000}}, "o_totalprice > 100000 AND o_totalprice <= 200000"),
    "filter_dt_range": ({"o_orderdate": {"$gte": "1995-01-01", "$lt": "1996-07-01"}}, "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-07-01'"),
    "filter_dt_text": ({"o_day": {"$gte": "1995-01-01", "$lt": "1996-07-01"}}, "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-07-01'"),
    "filter_dt_parts": ({"o_orderdate": {"$gte": {"$year": 1996, "$month": 3}}}, "o_orderdate >= TIMESTAMP '1996-03-01'"),
    "filter_in": ({"o_orderpriority": {"$in": ["1-URGENT", "2-HIGH"]}}, "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "filter_in_null": ({"o_note": {"$in": ["1-URGENT", None]}}, "note = '1-URGENT' OR note IS NULL"),
    "filter_nin": ({"o_note": {"$nin": ["1-URGENT", "2-HIGH"]}}, "note NOT IN ('1-URGENT', '2-HIGH')"),
    "filter_contains": ({"o_orderpriority": {"$contains": "urg"}}, "lower(o_orderpriority) LIKE '%urg%'"),
    "filter_starts_ends": ({"o_orderpriority": {"$startsWith": "1-", "$endsWith": "T"}}, "o_orderpriority LIKE '1-%' AND o_orderpriority LIKE '%T'"),
    "filter_exists": ({"o_note": {"$exists": True}}, "note IS NOT NULL"),
    "filter_type": ({"o_day": {"$type": "datetime"}, "o_totalprice": {"$type": "number"}, "o_note": {"$type": "string"}}, "note IS NOT NULL"),
    "filter_null": ({"o_note": None}, "note IS NULL"),
    "logic_and": ({"$and": [{"o_orderstatus": "F"}, {"o_totalprice": {"$lt": 50000}}]}, "o_orderstatus = 'F' AND o_totalprice < 50000"),
    "logic_or": ({"$or": [{"o_orderstatus": "P"}, {"o_totalprice": {"$gt": 300000}}]}, "o_orderstatus = 'P' OR o_totalprice > 300000"),
    "logic_not": ({"$not": {"o_note": "1-URGENT", "o_orderstatus": "O"}}, "NOT (note = '1-URGENT' AND o_orderstatus = 'O')"),
    "logic_nor": ({"$nor": [{"o_orderstatus": "O"}, {"o_note": "1-URGENT"}]}, "NOT (o_orderstatus = 'O' OR note = '1-URGENT')"),
    "logic_xor": ({"$xor": [{"o_orderstatus": "O"}, {"o_note": "1-URGENT"}, {"o_totalprice": {"$gt": 150000}}]}, "((o_orderstatus = 'O') <> (note = '1-URGENT')) <> (o_totalprice > 150000)"),
    "logic_field_level": ({"o_totalprice": {"$or": [{"$lt": 10000}, {"$gt": 300000}]}, "o_orderstatus": {"$not": {"$eq": "F"}}}, "(o_totalprice < 10000 OR o_totalprice > 300000) AND NOT o_orderstatus = 'F'"),
    "where_literal_ref": ({"o_orderpriority": "$record.o_note"}, "o_orderpriority = '$record.o_note'"),
}
for _name, (_where, _sql) in ORDERS.items():
    ask(_name, "ORDER", {"where": _where}, ["o_orderkey", "o_totalprice"],
        f"SELECT o_orderkey, o_totalprice FROM (SELECT *, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS note FROM orders) WHERE {_sql}")
ask("filter_array_any", "PART", {"where": {"tags": {"$in": ["red", "blue", "steel"]}}}, ["p_partkey"], "SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), ['red', 'blue', 'steel'])")
ask("filter_array_nin", "PART", {"where": {"tags": {"$nin": ["red", "blue", "steel"]}}}, ["p_partkey"], "SELECT p_partkey FROM part WHERE NOT list_has_any(string_split(p_name, ' '), ['red', 'blue', 'steel'])")

# projections, order, pages

ask(
    "select_fields", "CUSTOMER", {"select": {"name": "$record.c_name", "id": "$record.__id"}}, ["c_custkey", "name", "id"],
    "SELECT c_custkey, c_name AS name, 'CUSTOMER:' || c_custkey AS id FROM customer",
)
ask(
    "expr_math", "LINEITEM", {"select": {"net": {"$multiply": ["$record.l_extendedprice", {"$subtract": [1, "$record.l_discount"]}]}, "per": {"$divide": ["$record.l_extendedprice", "$record.l_quantity"]}, "plus": {"$add": ["$record.l_quantity", 1]}}},
    ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "net", "per", "plus"],
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * (1 - l_discount) AS net, l_extendedprice / l_quantity AS per, l_quantity + 1 AS plus FROM lineitem",
)
ask("expr_literal", "REGION", {"select": {"answer": 42, "yes": True}}, ["r_name", "answer", "yes"], "SELECT r_name, 42 AS answer, true AS yes FROM region")
ask("order_default", "SUPPLIER", {"limit": 20}, ["s_suppkey"], "SELECT s_suppkey FROM supplier ORDER BY 'SUPPLIER:' || s_suppkey DESC LIMIT 20", full_scan=False)
ask(
    "order_multi", "ORDER", {"orderBy": {"o_note": "asc", "o_totalprice": "desc"}, "limit": 50}, ["o_orderkey", "o_note"],
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS o_note FROM orders
    ORDER BY o_note ASC NULLS LAST, o_totalprice DESC, 'ORDER:' || o_orderkey LIMIT 50""", full_scan=False,
)
ask("paginate", "PART", {"orderBy": {"p_partkey": "asc"}, "skip": 30, "limit": 25}, ["p_partkey"], "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 25 OFFSET 30", full_scan=False)
ask(
    "paginate_traversal", "CUSTOMER ORDER", {"where": {"ORDER": {"o_totalprice": {"$gt": 200000}}}, "orderBy": {"c_custkey": "asc"}, "skip": 5, "limit": 40}, ["c_custkey"],
    "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) ORDER BY c_custkey LIMIT 40 OFFSET 5", full_scan=False,
)

# related records

COK = "CUSTOMER ORDER"
ask("join_traverse", COK, {"where": {"ORDER": {"o_totalprice": {"$gt": 250000}}}}, ["c_custkey"], "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
ask(
    "join_traverse_or", COK, {"where": {"$or": [{"c_mktsegment": "BUILDING"}, {"ORDER": {"o_totalprice": {"$gt": 300000}}}]}}, ["c_custkey"],
    "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
)
ask(
    "join_traverse_xor", COK, {"where": {"$xor": [{"c_mktsegment": "BUILDING"}, {"ORDER": {"o_totalprice": {"$gt": 300000}}}]}}, ["c_custkey"],
    "SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING') <> (c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000))",
)
ask(
    "join_multihop_labels", "REGION NATION CUSTOMER ORDER", {"where": {"NATION": {"CUSTOMER": {"ORDER": {"o_totalprice": {"$gt": 300000}}}}}}, ["r_name"],
    "SELECT r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 300000)",
)
ask(
    "join_directed", "NATION CUSTOMER SUPPLIER REGION", {"where": {"REGION": {"$relation": {"direction": "out"}, "r_name": {"$in": ["ASIA", "EUROPE"]}}, "CUSTOMER": {"$relation": {"direction": "in"}, "c_acctbal": {"$gt": 9000}}}}, ["n_name"],
    "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name IN ('ASIA', 'EUROPE')) AND n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)",
)
ask("join_typed", "NATION SUPPLIER", {"where": {"SUPPLIER": {"$relation": "FROM_NATION", "s_acctbal": {"$lt": 0}}}}, ["n_name"], "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
ask("join_semi", COK, {"where": {"ORDER": {}}}, ["c_custkey"], "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
ask("join_anti", COK, {"where": {"$not": {"ORDER": {"o_orderstatus": "P"}}}}, ["c_custkey"], "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
ask(
    "join_not_nested", "NATION CUSTOMER ORDER", {"where": {"CUSTOMER": {"c_mktsegment": "BUILDING", "$not": {"ORDER": {"o_orderstatus": "F"}}}}}, ["n_name"],
    "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'))",
)
ask(
    "join_alias_select", COK, {"where": {"ORDER": {"$alias": "$o", "o_totalprice": {"$gt": 250000}}}, "select": {"price": "$o.o_totalprice", "order": "$o.o_orderkey"}}, ["c_custkey", "`order`", "price"],
    "SELECT c_custkey, o_orderkey AS \"order\", o_totalprice AS price FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 250000",
)
ask(
    "hops_exact", "CUSTOMER ORDER LINEITEM PART", {"where": {"LINEITEM": {"$relation": {"direction": "out", "hops": 2}, "l_quantity": {"$gt": 49}}}}, ["c_custkey"],
    "SELECT DISTINCT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 49",
)
ask(
    "hops_range", "REGION NATION CUSTOMER SUPPLIER", {"where": {"CUSTOMER": {"$relation": {"direction": "in", "hops": {"min": 1, "max": 3}}, "c_acctbal": {"$gt": 9500}}}}, ["r_name"],
    "SELECT DISTINCT r_name FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 9500",
)
ask(
    "hops_untyped", "SUPPLIER NATION REGION", {"where": {"REGION": {"$relation": {"hops": {"min": 1, "max": 2}}, "r_name": "ASIA"}}}, ["s_suppkey"],
    "SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
)

_TRADES = """sold AS (
  SELECT s_nationkey AS a, c_nationkey AS b, sum(CAST(round(l_extendedprice * (1 - l_discount), 4) AS DECIMAL(18, 4))) AS v
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  WHERE s_nationkey <> c_nationkey GROUP BY 1, 2
), trades AS (SELECT a, b FROM sold QUALIFY row_number() OVER (PARTITION BY a ORDER BY v DESC, b) = 1)"""
_WALK = """walk AS (
  SELECT a AS start, b AS cur, 1 AS n FROM trades UNION SELECT start, b, n + 1 FROM walk JOIN trades ON cur = a WHERE n < 6 AND cur <> start
)"""


def _traders(spark: SparkSession, sf_dir: str) -> Graph:
    graph = star.load(spark, sf_dir, ["NATION", "CUSTOMER", "SUPPLIER", "ORDER", "LINEITEM"])
    return Graph(spark, {"NATION": graph.records("NATION")}, [star.trades(graph)])


CYCLE = {"$cycle": {"type": "TRADES", "direction": "out", "hops": {"max": 6}}}
register("cycle_detect", f"WITH RECURSIVE {_TRADES}, {_WALK} SELECT n_name FROM nation WHERE n_nationkey IN (SELECT start FROM walk WHERE cur = start AND n >= 2)")(
    lambda s, d: search(_traders(s, d), {"labels": ["NATION"], "where": CYCLE}, full_scan=True).select("n_name")
)
register("cycle_not", f"WITH RECURSIVE {_TRADES}, {_WALK} SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT start FROM walk WHERE cur = start AND n >= 2)")(
    lambda s, d: search(_traders(s, d), {"labels": ["NATION"], "where": {"$not": CYCLE}}, full_scan=True).select("n_name")
)

# aggregation

BY_STATUS = {"groupBy": ["$record.o_orderstatus"]}


def grouped(name: str, metric: dict, sql: str, column=None) -> None:
    ask(name, "ORDER", {"select": {"m": metric}, **BY_STATUS}, ["o_orderstatus", column if column is not None else "m"], f"SELECT o_orderstatus, {sql} AS m FROM (SELECT *, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS note FROM orders) GROUP BY o_orderstatus")


grouped("agg_sum", {"$sum": "$record.o_totalprice"}, "round(sum(o_totalprice), 2)", rounded("m"))
grouped("agg_avg", {"$avg": "$record.o_totalprice"}, "round(avg(o_totalprice), 4)", rounded("m", 4))
grouped("agg_avg_precision", {"$avg": "$record.o_totalprice", "$precision": 0}, "CAST(trunc(avg(o_totalprice)) AS BIGINT)")
grouped("agg_count_star", {"$count": "*"}, "count(DISTINCT o_orderkey)")
grouped("agg_count_distinct", {"$count": "$record.o_note"}, "count(DISTINCT note)")
grouped("agg_math", {"$sum": {"$multiply": ["$record.o_totalprice", 2]}}, "round(sum(o_totalprice * 2), 2)", rounded("m"))
ask(
    "agg_min_max", "ORDER", {"select": {"lo": {"$min": "$record.o_totalprice"}, "hi": {"$max": "$record.o_totalprice"}}, **BY_STATUS}, ["o_orderstatus", "lo", "hi"],
    "SELECT o_orderstatus, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1",
)
ask(
    "group_dim", "LINEITEM", {"select": {"items": {"$count": "*"}, "quantity": {"$sum": "$record.l_quantity"}}, "groupBy": ["$record.l_returnflag"]}, ["l_returnflag", "items", "quantity"],
    "SELECT l_returnflag, count(DISTINCT (l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice)) AS items, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1",
)
ask(
    "group_multi", "LINEITEM", {"select": {"quantity": {"$sum": "$record.l_quantity"}, "price": {"$sum": "$record.l_extendedprice"}}, "groupBy": ["$record.l_returnflag", "$record.l_linestatus"]},
    ["l_returnflag", "l_linestatus", "quantity", rounded("price")],
    "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1, 2",
)
ask("group_self", "ORDER", {"select": {"total": {"$sum": "$record.o_totalprice"}, "n": {"$count": "*"}}, "groupBy": ["total"]}, [rounded("total"), "n"], "SELECT round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders")
ask(
    "group_related", COK, {"where": {"ORDER": {"$alias": "$o"}}, "select": {"customers": {"$count": "*"}, "value": {"$sum": "$o.o_totalprice"}}, "groupBy": ["$o.o_orderpriority"]},
    ["o_orderpriority", "customers", rounded("value")],
    "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS value FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1",
)
ask(
    "group_time_bucket", "ORDER", {"select": {"month": {"$timeBucket": {"field": "$record.o_orderdate", "unit": "month"}}, "n": {"$count": "*"}}, "groupBy": ["month"]}, ["month", "n"],
    "SELECT epoch_ms(date_trunc('month', o_orderdate)) AS month, count(*) AS n FROM orders GROUP BY 1",
)
ask(
    "agg_per_record", COK, {"where": {"ORDER": {"$alias": "$o"}}, "select": {"spent": {"$sum": "$o.o_totalprice"}, "orders": {"$count": "$o"}}}, ["c_custkey", "c_name", rounded("spent"), "orders"],
    "SELECT c_custkey, c_name, round(sum(o_totalprice), 2) AS spent, count(*) AS orders FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2",
)
ask(
    "agg_ref_derived", "ORDER", {"select": {"value": {"$sum": "$record.o_totalprice"}, "n": {"$count": "*"}, "per": {"$divide": [{"$ref": "value"}, {"$ref": "n"}]}, "half": {"$divide": [{"$ref": "per"}, 2]}}, "groupBy": ["$record.o_orderpriority"]},
    ["o_orderpriority", "n", rounded("per", 4), rounded("half", 4)],
    "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice) / count(*), 4) AS per, round(sum(o_totalprice) / count(*) / 2, 4) AS half FROM orders GROUP BY 1",
)
ask(
    "late_order_topn", COK, {"where": {"ORDER": {"$alias": "$o"}}, "select": {"spent": {"$sum": "$o.o_totalprice"}}, "groupBy": ["$record.c_name"], "orderBy": {"spent": "desc"}, "limit": 25}, ["c_name", rounded("spent")],
    "SELECT c_name, round(sum(o_totalprice), 2) AS spent FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 ORDER BY sum(o_totalprice) DESC, c_name LIMIT 25", full_scan=False,
)
ask(
    "early_limit_agg", "ORDER", {"select": {"value": {"$sum": "$record.o_totalprice"}}, "groupBy": ["$record.o_orderstatus"], "orderBy": {"o_orderkey": "desc"}, "limit": 100}, ["o_orderstatus", rounded("value")],
    "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS value FROM (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 100) GROUP BY 1", full_scan=False,
)
ask(
    "legacy_agg", COK, {"where": {"ORDER": {"$alias": "$o"}}, "aggregate": {"n": {"fn": "count", "alias": "$o"}, "value": {"fn": "sum", "field": "o_totalprice", "alias": "$o"}, "mean": {"fn": "avg", "field": "o_totalprice", "alias": "$o", "precision": 1}, "name": "$record.c_name"}},
    ["c_custkey", "n", rounded("value"), "name"],
    "SELECT c_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS value, c_name AS name FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name",
)


def _total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return total(star.load(spark, sf_dir, ["CUSTOMER", "ORDER"]), {"labels": ["CUSTOMER"], "where": {"ORDER": {"o_totalprice": {"$gt": 200000}}}})


register("search_total", "SELECT count(DISTINCT o_custkey) AS total FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 200000")(_total)
register("labels_histogram", "SELECT 'CUSTOMER' AS label, count(*) AS records FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT 'SUPPLIER', count(*) FROM supplier WHERE s_acctbal > 5000")(
    lambda s, d: labels_histogram(star.load(s, d, ["CUSTOMER", "SUPPLIER"]), {"labels": ["CUSTOMER", "SUPPLIER"], "where": {"$or": [{"c_acctbal": {"$gt": 5000}}, {"s_acctbal": {"$gt": 5000}}]}}).select(F.col(LABEL).alias("label"), "records")
)
register("project_stats", "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) AS records, 10 AS properties")(
    lambda s, d: schema.project_stats(star.load(s, d, ["REGION", "NATION", "CUSTOMER"]))
)

# collections

ask(
    "collect_alias", COK, {"where": {"ORDER": {"$alias": "$o"}}, "select": {"orders": {"$collect": {"from": "$o", "select": {"key": "$self.o_orderkey", "price": "$self.o_totalprice"}, "orderBy": {"o_totalprice": "desc"}, "limit": 3}}}},
    ["c_custkey", "posexplode(orders) AS (at, o)"],
    """SELECT c_custkey, n - 1 AS pos, o_orderkey AS key, o_totalprice AS price FROM (
    SELECT c_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, 'ORDER:' || o_orderkey DESC) AS n FROM customer JOIN orders ON o_custkey = c_custkey) WHERE n <= 3""",
)
_collect_alias = QUERIES["collect_alias"]
QUERIES["collect_alias"] = lambda s, d: _collect_alias(s, d).select("c_custkey", F.col("at").alias("pos"), "o.key", "o.price")
ask(
    "collect_slice", COK, {"where": {"ORDER": {"$alias": "$o"}}, "select": {"keys": {"$collect": {"from": "$o", "select": {"key": "$self.o_orderkey"}, "orderBy": {"o_orderkey": "asc"}, "skip": 2, "limit": 5}}}},
    ["c_custkey", "explode(keys) AS o"],
    "SELECT c_custkey, o_orderkey AS key FROM (SELECT o_custkey AS c_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders JOIN customer ON c_custkey = o_custkey) WHERE n > 2 AND n <= 5",
)
_collect_slice = QUERIES["collect_slice"]
QUERIES["collect_slice"] = lambda s, d: _collect_slice(s, d).select("c_custkey", "o.key")
ask(
    "legacy_collect_field", COK, {"where": {"ORDER": {"$alias": "$o"}}, "aggregate": {"states": {"fn": "collect", "field": "o_orderstatus", "alias": "$o"}}}, ["c_custkey", "concat_ws(',', states) AS states"],
    "SELECT c_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS states FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1",
)
ask(
    "collect_label", COK, {"select": {"big": {"$collect": {"label": "ORDER", "where": {"o_totalprice": {"$gt": 200000}}, "select": {"key": "$self.o_orderkey"}, "orderBy": {"o_orderkey": "asc"}}}}},
    ["c_custkey", "concat_ws(',', transform(big, x -> CAST(x.key AS STRING))) AS keys"],
    "SELECT c_custkey, coalesce(string_agg(o_orderkey, ',' ORDER BY o_orderkey), '') AS keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 GROUP BY 1",
)
NESTED = {"customers": {"$collect": {"label": "CUSTOMER", "where": {"c_acctbal": {"$gt": 9000}}, "select": {"name": "$self.c_name", "orders": {"$collect": {"label": "ORDER", "select": {"key": "$self.o_orderkey"}, "orderBy": {"o_orderkey": "asc"}, "limit": 2}}}, "orderBy": {"c_custkey": "asc"}}}}
ask(
    "collect_nested", "NATION CUSTOMER ORDER", {"select": NESTED}, ["n_name", "explode(customers) AS c"],
    """SELECT n_name, c_name AS customer, coalesce(string_agg(o_orderkey, ',' ORDER BY o_orderkey), '') AS keys FROM nation JOIN customer ON c_nationkey = n_nationkey
    LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2) o ON o_custkey = c_custkey WHERE c_acctbal > 9000 GROUP BY n_name, c_name""",
)
_collect_nested = QUERIES["collect_nested"]
QUERIES["collect_nested"] = lambda s, d: _collect_nested(s, d).select("n_name", F.col("c.name").alias("customer"), F.concat_ws(",", F.transform("c.orders", lambda x: x["key"].cast("string"))).alias("keys"))

ask(
    "legacy_collect_nested", "NATION CUSTOMER ORDER",
    {"where": {"CUSTOMER": {"$alias": "$c", "c_acctbal": {"$gt": 9000}, "ORDER": {"$alias": "$o", "o_totalprice": {"$gt": 100000}}}},
     "aggregate": {"customers": {"fn": "collect", "alias": "$c", "orderBy": {"c_custkey": "asc"}, "aggregate": {"orders": {"fn": "collect", "alias": "$o", "orderBy": {"o_orderkey": "desc"}, "limit": 3}}}}},
    ["n_name", "posexplode(customers) AS (pos, c)"],
    """SELECT n_name, row_number() OVER (PARTITION BY n_name ORDER BY c_custkey) - 1 AS pos, c_name AS customer, keys FROM (
    SELECT n_name, c_custkey, c_name, string_agg(o_orderkey, ',' ORDER BY o_orderkey DESC) AS keys FROM nation JOIN customer ON c_nationkey = n_nationkey
    JOIN (SELECT * FROM orders WHERE o_totalprice > 100000 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 3) ON o_custkey = c_custkey WHERE c_acctbal > 9000 GROUP BY 1, 2, 3)""",
)
_legacy_nested = QUERIES["legacy_collect_nested"]
QUERIES["legacy_collect_nested"] = lambda s, d: _legacy_nested(s, d).select("n_name", "pos", F.col("c.c_name").alias("customer"), F.concat_ws(",", F.transform("c.orders", lambda x: x["o_orderkey"].cast("string"))).alias("keys"))

# time buckets

for _unit in ("day", "week", "month", "quarter", "year", "hour", "minute", "second"):
    ask(
        f"bucket_{_unit}", "EVENT", {"select": {"b": {"$timeBucket": {"field": "$record.ts", "unit": _unit}}}}, ["event_id", "b"],
        f"SELECT event_id, epoch_ms(date_trunc('{_unit}', ts)) AS b FROM events",
    )
SIZED = {
    "months": (5, "make_timestamp(year(ts), (month(ts) - 1) // 5 * 5 + 1, 1, 0, 0, 0)"),
    "years": (3, "make_timestamp(year(ts) // 3 * 3, 1, 1, 0, 0, 0)"),
    "hours": (6, "make_timestamp(year(ts), month(ts), day(ts), hour(ts) // 6 * 6, 0, 0)"),
    "minutes": (15, "make_timestamp(year(ts), month(ts), day(ts), hour(ts), minute(ts) // 15 * 15, 0)"),
    "seconds": (20, "make_timestamp(year(ts), month(ts), day(ts), hour(ts), minute(ts), second(ts) // 20 * 20)"),
}
for _unit, (_size, _sql) in SIZED.items():
    ask(f"bucket_{_unit}_n", "EVENT", {"select": {"b": {"$timeBucket": {"field": "$record.ts", "unit": _unit, "size": _size}}}}, ["event_id", "b"], f"SELECT event_id, epoch_ms({_sql}) AS b FROM events")
ask(
    "legacy_time_bucket", "EVENT", {"aggregate": {"b": {"fn": "timeBucket", "field": "ts", "granularity": "months", "size": 2}}}, ["event_id", "b"],
    "SELECT event_id, make_timestamp(year(ts), (month(ts) - 1) // 2 * 2 + 1, 1, 0, 0, 0) AS b FROM events",
)
register("stream_bucket_counts", "SELECT date_trunc('day', ts) AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2")(
    lambda s, d: bucketed_counts(s.read.parquet(f"{d}/events.parquet"), "ts", "day", ["event_type"])
)

# relationships


def _table(graph: Graph, *types: str) -> DataFrame:
    return graph.all_edges(list(types) or None)


def _ids(df: DataFrame) -> DataFrame:
    return df.select("src", "dst", "type")


def _wealthy(s: SparkSession, d: str) -> tuple[Graph, DataFrame]:
    g = star.load(s, d, ["CUSTOMER", "SUPPLIER", "NATION"])
    return g, _table(g, "FROM_NATION")


@register("edge_join_keys", "SELECT 'CUSTOMER:' || c_custkey AS src, 'SUPPLIER:' || s_suppkey AS dst, 'NEAR' AS type FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_acctbal > 9000 AND s_acctbal > 5000")
def edge_join_keys(s: SparkSession, d: str) -> DataFrame:
    g, old = _wealthy(s, d)
    out = edges.create_many(g, old.where("type = 'NEAR'"), {"label": "CUSTOMER", "key": "c_nationkey", "where": {"c_acctbal": {"$gt": 9000}}}, {"label": "SUPPLIER", "key": "s_nationkey", "where": {"s_acctbal": {"$gt": 5000}}}, "NEAR")
    return _ids(out)


@register("edge_join_array_keys", "SELECT DISTINCT 'PART:' || p_partkey AS src, 'TAG:' || t AS dst, 'TAGGED' AS type FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS t FROM part)")
def edge_join_array_keys(s: SparkSession, d: str) -> DataFrame:
    g = star.load(s, d, ["PART"])
    tags = g.records("PART").select(F.explode("tags").alias("word")).distinct().withColumn(ID, F.concat(F.lit("TAG:"), "word"))
    g = g.with_records("TAG", tags)
    return _ids(edges.create_many(g, _table(g), {"label": "PART", "key": "tags"}, {"label": "TAG", "key": "word"}, "TAGGED"))


@register("edge_cross_join", "SELECT 'REGION:' || r_regionkey AS src, 'NATION:' || n_nationkey AS dst, 'ALL' AS type FROM region, nation WHERE r_name <> 'ASIA' AND n_regionkey = 2")
def edge_cross_join(s: SparkSession, d: str) -> DataFrame:
    g = star.load(s, d, ["REGION", "NATION"])
    return _ids(edges.create_many(g, _table(g).where("false"), {"label": "REGION", "where": {"r_name": {"$ne": "ASIA"}}}, {"label": "NATION", "where": {"n_regionkey": 2}}, "ALL", many_to_many=True))


register("edge_join_probe", "SELECT least(count(*), 100) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey")(
    lambda s, d: edges.probe(star.load(s, d, ["CUSTOMER", "SUPPLIER"]), {"label": "CUSTOMER", "key": "c_nationkey"}, {"label": "SUPPLIER", "key": "s_nationkey"}, 100)
)


@register("edge_delete_keys", "SELECT 'CUSTOMER:' || c_custkey AS src, 'NATION:' || c_nationkey AS dst, 'FROM_NATION' AS type FROM customer WHERE c_acctbal <= 0 UNION ALL SELECT 'SUPPLIER:' || s_suppkey, 'NATION:' || s_nationkey, 'FROM_NATION' FROM supplier")
def edge_delete_keys(s: SparkSession, d: str) -> DataFrame:
    g, e = _wealthy(s, d)
    return _ids(edges.delete_many(g, e, {"label": "CUSTOMER", "key": "c_nationkey", "where": {"c_acctbal": {"$gt": 0}}}, {"label": "NATION", "key": "n_nationkey"}, "FROM_NATION"))


register("edge_delete_labels", "SELECT 'CUSTOMER:' || c_custkey AS src, 'NATION:' || c_nationkey AS dst, 'FROM_NATION' AS type FROM customer")(
    lambda s, d: _ids(edges.delete_between(_wealthy(s, d)[1], "NATION", "SUPPLIER", "FROM_NATION"))
)
register("edge_retype", "SELECT 'NATION:' || s_nationkey AS src, 'SUPPLIER:' || s_suppkey AS dst, 'HOSTS' AS type FROM supplier UNION ALL SELECT 'CUSTOMER:' || c_custkey, 'NATION:' || c_nationkey, 'FROM_NATION' FROM customer")(
    lambda s, d: _ids(edges.retype(_wealthy(s, d)[1], "NATION", "SUPPLIER", "FROM_NATION", "HOSTS"))
)


@register("edge_attach", "SELECT 'NATION:0' AS src, 'SUPPLIER:' || s_suppkey AS dst, 'FROM_NATION' AS type FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT 'SUPPLIER:' || s_suppkey, 'NATION:' || s_nationkey, 'FROM_NATION' FROM supplier WHERE NOT (s_acctbal > 5000 AND s_nationkey = 0)")
def edge_attach(s: SparkSession, d: str) -> DataFrame:
    g = star.load(s, d, ["SUPPLIER", "NATION"])
    rich = g.records("SUPPLIER").where("s_acctbal > 5000").select(F.col(ID).alias("id"))
    return _ids(edges.attach(_table(g), "NATION:0", rich, "FROM_NATION"))


@register("edge_detach", "SELECT 'SUPPLIER:' || s_suppkey AS src, 'NATION:' || s_nationkey AS dst, 'FROM_NATION' AS type FROM supplier WHERE NOT (s_acctbal > 5000 AND s_nationkey = 3)")
def edge_detach(s: SparkSession, d: str) -> DataFrame:
    g = star.load(s, d, ["SUPPLIER", "NATION"])
    rich = g.records("SUPPLIER").where("s_acctbal > 5000").select(F.col(ID).alias("id"))
    return _ids(edges.detach(_table(g), "NATION:3", rich))


_FOUND = "SELECT 'ORDER:' || o_orderkey AS \"sourceId\", 'ORDER' AS \"sourceLabel\", 'LINEITEM:' || concat_ws(':', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS \"targetId\" FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 300000 AND l_quantity > 40"


@register("edge_search", "SELECT 'CUSTOMER:' || c_custkey AS \"sourceId\", 'CUSTOMER' AS \"sourceLabel\", 'ORDER:' || o_orderkey AS \"targetId\", 'ORDER' AS \"targetLabel\", 'PLACED' AS type, 'out' AS direction FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 200000")
def edge_search(s: SparkSession, d: str) -> DataFrame:
    g = star.load(s, d, ["CUSTOMER", "ORDER"])
    return edges.find(g, _table(g), {"labels": ["CUSTOMER"], "where": {"c_mktsegment": "BUILDING"}}, {"labels": ["ORDER"], "where": {"o_totalprice": {"$gt": 200000}}}, limit=None)


@register("edge_search_in", "SELECT 'ORDER:' || o_orderkey AS \"sourceId\", 'CUSTOMER:' || c_custkey AS \"targetId\", 'in' AS direction FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 250000")
def edge_search_in(s: SparkSession, d: str) -> DataFrame:
    g = star.load(s, d, ["CUSTOMER", "ORDER"])
    return edges.find(g, _table(g), {"labels": ["ORDER"], "where": {"o_totalprice": {"$gt": 250000}}}, None, direction="in", limit=None).select("sourceId", "targetId", "direction")


def _weighted(s: SparkSession, d: str) -> tuple[Graph, DataFrame]:
    g = star.load(s, d, ["ORDER", "CUSTOMER"])
    o = g.records("ORDER").select(F.concat(F.lit("CUSTOMER:"), "o_custkey").alias("src"), F.col(ID).alias("dst"), F.lit("PLACED").alias("type"), F.lit("CUSTOMER").alias("src_label"), F.lit("ORDER").alias("dst_label"), F.col("o_totalprice").alias("amount"), F.col("o_note").alias("note"))
    return g, o


_W = "(SELECT *, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS note FROM orders)"
register("edge_filter_type", "SELECT 'SUPPLIER:' || s_suppkey AS src, 'NATION:' || s_nationkey AS dst, 'FROM_NATION' AS type FROM supplier UNION ALL SELECT 'NATION:' || n_nationkey, 'REGION:' || n_regionkey, 'IN_REGION' FROM nation")(
    lambda s, d: (lambda e: _ids(e.where(edges.edge_where(e, {"type": {"$in": ["FROM_NATION", "IN_REGION"]}, "$not": {"type": {"$startsWith": "PLACED"}}}))))(_table(star.load(s, d, ["SUPPLIER", "NATION", "REGION"])))
)
register("edge_filter_props", f"SELECT 'CUSTOMER:' || o_custkey AS src, 'ORDER:' || o_orderkey AS dst FROM {_W} WHERE o_totalprice > 200000 AND (note IS NULL OR note = '1-URGENT')")(
    lambda s, d: (lambda e: e.where(edges.edge_where(e, {"amount": {"$gt": 200000}, "$or": [{"note": None}, {"note": {"$contains": "urgent"}}]})).select("src", "dst"))(_weighted(s, d)[1])
)
register("edge_order", "SELECT 'ORDER:' || o_orderkey AS \"targetId\", o_totalprice AS amount FROM orders ORDER BY o_totalprice DESC, 'CUSTOMER:' || o_custkey, 'ORDER:' || o_orderkey LIMIT 50")(
    lambda s, d: edges.find(*_weighted(s, d), order_by={"amount": "desc"}, limit=50).select("targetId", "amount")
)
register("schema_edge_props", f"SELECT 'amount' AS property, count(o_totalprice) AS n FROM orders UNION ALL SELECT 'note', count(note) FROM {_W}")(
    lambda s, d: schema.edge_properties(_weighted(s, d)[1]).select("property", "n")
)

# introspection

register("schema_labels", "SELECT 'CUSTOMER' AS label, count(*) AS records FROM customer UNION ALL SELECT 'ORDER', count(*) FROM orders UNION ALL SELECT 'NATION', count(*) FROM nation")(
    lambda s, d: schema.label_counts(star.load(s, d, ["CUSTOMER", "ORDER", "NATION"]))
)
_PROPS = {"o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "string", "o_totalprice": "number", "o_orderdate": "datetime", "o_orderpriority": "string", "o_note": "string", "o_day": "datetime"}
register("schema_property_counts", " UNION ALL ".join(f"SELECT '{p}' AS property, '{t}' AS type, count({'note' if p == 'o_note' else 'o_orderdate' if p == 'o_day' else p}) AS records FROM {_W}" for p, t in _PROPS.items()))(
    lambda s, d: schema.property_counts(star.load(s, d, ["ORDER"]), "ORDER")
)
register("schema_property_stats", " UNION ALL ".join(f"SELECT '{p}' AS property, 'number' AS type, false AS \"isArray\", CAST(min({p}) AS DOUBLE) AS lo, CAST(max({p}) AS DOUBLE) AS hi FROM customer" for p in ("c_custkey", "c_nationkey", "c_acctbal")))(
    lambda s, d: schema.property_stats(star.load(s, d, ["CUSTOMER"]), "CUSTOMER").select("property", "type", "isArray", F.col("min").cast("double").alias("lo"), F.col("max").cast("double").alias("hi"))
)
register("schema_samples", "SELECT value FROM (SELECT DISTINCT c_mktsegment AS value FROM (SELECT * FROM customer ORDER BY 'CUSTOMER:' || c_custkey LIMIT 100)) ORDER BY value LIMIT 10")(
    lambda s, d: schema.samples(star.load(s, d, ["CUSTOMER"]), "CUSTOMER", "c_mktsegment")
)
register("property_values", "SELECT DISTINCT t AS value, min(t) OVER () AS min, max(t) OVER () AS max FROM (SELECT unnest(string_split(p_name, ' ')) AS t FROM part WHERE p_size > 10)")(
    lambda s, d: schema.property_values(star.load(s, d, ["PART"]), "tags", where={"p_size": {"$gt": 10}})
)
register("facet_counts", "SELECT t AS value, count(DISTINCT p_partkey) AS records FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS t FROM part) WHERE lower(t) LIKE '%e%' GROUP BY 1")(
    lambda s, d: schema.facets(star.load(s, d, ["PART"]), "tags", query="e")
)
register("find_properties", "SELECT 'REGION' AS label, 'r_regionkey' AS property, 'number' AS type, count(*) AS records FROM region UNION ALL SELECT 'REGION', 'r_name', 'string', count(*) FROM region")(
    lambda s, d: schema.find_properties(star.load(s, d, ["REGION"]))
)


@register("delete_property", "SELECT n_nationkey, n_regionkey FROM nation")
def delete_property(s: SparkSession, d: str) -> DataFrame:
    store = Store(star.load(s, d, ["NATION"]))
    store.properties.delete("n_name")
    return store.graph.records("NATION").drop(ID)


register(
    "schema_relationships",
    """WITH r AS (SELECT 'CUSTOMER' AS a, 'FROM_NATION' AS t, 'NATION' AS b, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT 'SUPPLIER', 'FROM_NATION', 'NATION', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT a AS label, 'out' AS direction, t AS type, b AS other, n FROM r UNION ALL SELECT b, 'in', t, a, n FROM r""",
)(lambda s, d: schema.relationship_counts(star.load(s, d, ["CUSTOMER", "SUPPLIER", "NATION"])))
register(
    "schema_full",
    """SELECT 'REGION' AS label, count(*) AS records, 2 AS properties, 1 AS relationships, min(r_regionkey)::VARCHAR AS lo FROM region
    UNION ALL SELECT 'NATION', count(*), 3, 2, min(n_nationkey)::VARCHAR FROM nation UNION ALL SELECT 'CUSTOMER', count(*), 5, 1, min(c_custkey)::VARCHAR FROM customer""",
)(lambda s, d: schema.full_schema(star.load(s, d, ["REGION", "NATION", "CUSTOMER"])).select("label", "records", F.size("properties").alias("properties"), F.size("relationships").alias("relationships"), F.filter("properties", lambda p: p["property"].rlike("^[rnc]_(region|nation|cust)key$"))[0]["min"].alias("lo")))

# records in and out


def _events_tree(s: SparkSession, d: str) -> Graph:
    e = s.read.parquet(f"{d}/events.parquet").select("event_id", "event_type", F.from_json("props", "k long").alias("DETAIL"))
    return json_import.flatten(e, "EVENT", F.concat(F.lit("EVENT:"), "event_id"))


@register("import_json_flatten", "SELECT 'EVENT:' || event_id AS src, 'EVENT:' || event_id || '/DETAIL/0' AS dst, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def import_json_flatten(s: SparkSession, d: str) -> DataFrame:
    g = _events_tree(s, d)
    (e,) = g.edges
    parents, children = g.records("EVENT").withColumnRenamed(ID, "src"), g.records("DETAIL").withColumnRenamed(ID, "dst")
    return e.df.join(parents, "src").join(children, "dst").select("src", "dst", "event_type", "k")


_TYPED = "CASE WHEN regexp_full_match({x}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN 'number' WHEN {x} IN ('true', 'false') THEN 'boolean' WHEN regexp_full_match({x}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'datetime' ELSE 'string' END"
_TEXTS = "CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN o_orderpriority ELSE CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END END"


@register("infer_types", f"SELECT o_orderkey, {_TYPED.format(x='x')} AS type FROM (SELECT o_orderkey, {_TEXTS} AS x FROM orders)")
def infer_types(s: SparkSession, d: str) -> DataFrame:
    o = s.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey") % 4
    x = F.when(k == 0, F.col("o_custkey").cast("string")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 2, F.col("o_orderpriority")).otherwise(F.when(F.col("o_orderstatus") == "O", "true").otherwise("false"))
    return o.select("o_orderkey", values.inferred_type(x).alias("type"))


register("skip_empty", "SELECT doc_id, nullif(CASE WHEN n_chars % 3 = 0 THEN '' ELSE source END, '') AS source, len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS n FROM documents WHERE length(text) > 0")(
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").where(F.length("text") > 0).select("doc_id", values.skip_empty(F.when(F.col("n_chars") % 3 == 0, "").otherwise(F.col("source"))).alias("source"), F.size(values.skip_empty_array(F.split("text", " "))).alias("n"))
)
register("split_values", "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name, 'e'), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM part")(
    lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat_ws("|", values.split_values(F.col("p_name"), "e")).alias("parts"))
)
register("token_estimate", "SELECT doc_id, greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT)) AS tokens FROM documents")(
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", values.token_estimate(F.col("text")).alias("tokens"))
)
register("event_id_hash", "SELECT event_id, sha256('{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}') AS hash, sha256('s' || chr(30) || event_type || chr(31) || user_id) AS scope FROM events")(
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", values.event_id(("user_id", F.col("user_id")), ("event_type", F.col("event_type"))).alias("hash"), values.scope_hash("s", F.col("event_type"), F.col("user_id").cast("string")).alias("scope"))
)
@register("id_to_timestamp", "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")
def id_to_timestamp(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet")
    digits = F.lpad(F.lower(F.hex(F.unix_millis(F.col("ts").cast("timestamp")))), 12, "0")
    made = F.concat(F.substring(digits, 1, 8), F.lit("-"), F.substring(digits, 9, 4), F.lit("-7000-8000-000000000000"))
    return e.select("event_id", F.unix_millis(values.id_time(made)).alias("ms"))


def _customers(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = star.load(s, d, ["CUSTOMER"]).records("CUSTOMER").select(ID, "c_custkey", "c_name", "c_acctbal")
    new = c.where("c_custkey % 2 = 0").select((F.col("c_custkey") * 3).alias("c_custkey"), F.concat(F.lit("new "), "c_name").alias("c_name"), F.lit("gold").alias("tier"))
    return c, new.withColumn(ID, F.concat(F.lit("NEW:"), "c_custkey"))


_NEW = "new AS (SELECT c_custkey * 3 AS k, 'new ' || c_name AS name FROM customer WHERE c_custkey % 2 = 0)"
register("upsert_append", f"WITH {_NEW} SELECT coalesce('CUSTOMER:' || c_custkey, 'NEW:' || k) AS id, coalesce(name, c_name) AS c_name, c_acctbal, CASE WHEN k IS NOT NULL THEN 'gold' END AS tier FROM customer FULL JOIN new ON c_custkey = k")(
    lambda s, d: records.upsert(*_customers(s, d), ["c_custkey"]).select(F.col(ID).alias("id"), "c_name", "c_acctbal", "tier")
)
register("upsert_rewrite", f"WITH {_NEW} SELECT coalesce('CUSTOMER:' || c_custkey, 'NEW:' || k) AS id, coalesce(name, c_name) AS c_name, CASE WHEN k IS NULL THEN c_acctbal END AS c_acctbal, CASE WHEN k IS NOT NULL THEN 'gold' END AS tier FROM customer FULL JOIN new ON c_custkey = k")(
    lambda s, d: records.upsert(*_customers(s, d), ["c_custkey"], "rewrite").select(F.col(ID).alias("id"), "c_name", "c_acctbal", "tier")
)
register("update_record", "SELECT c_custkey, CASE WHEN c_custkey = 5 THEN 'Renamed' ELSE c_name END AS c_name, c_acctbal FROM customer")(
    lambda s, d: records.patch(_customers(s, d)[0], ["CUSTOMER:5"], {"c_name": "Renamed"}).drop(ID)
)
register("set_record", "SELECT CASE WHEN c_custkey <> 5 THEN c_custkey END AS c_custkey, CASE WHEN c_custkey = 5 THEN 'Only' ELSE c_name END AS c_name, CASE WHEN c_custkey <> 5 THEN c_acctbal END AS c_acctbal FROM customer")(
    lambda s, d: records.replace_record(_customers(s, d)[0], "CUSTOMER:5", {"c_name": "Only"}).drop(ID)
)
register("set_properties", "SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")(
    lambda s, d: (lambda c: records.patch(c, c.where("c_acctbal < 0"), {"c_acctbal": 0.0}).drop(ID))(_customers(s, d)[0])
)
register("delete_by_id", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey <> 5")(
    lambda s, d: (lambda c: records.delete(c, c.where(F.col(ID) == "CUSTOMER:5")).drop(ID))(_customers(s, d)[0])
)


@register("delete_by_query", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))")
def delete_by_query(s: SparkSession, d: str) -> DataFrame:
    g = star.load(s, d, ["ORDER", "CUSTOMER"])
    hits = search(g, {"labels": ["ORDER"], "where": {"o_orderstatus": "F", "CUSTOMER": {"c_mktsegment": "BUILDING"}}}, full_scan=True)
    return records.delete(g.records("ORDER"), hits).select("o_orderkey", "o_custkey")


@register("create_on_conflict", "SELECT c_custkey, c_name, tier FROM (SELECT c_custkey, c_name, NULL AS tier FROM customer UNION ALL SELECT c_custkey * 3, 'new ' || c_name, 'gold' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey * 3 NOT IN (SELECT c_custkey FROM customer))")
def create_on_conflict(s: SparkSession, d: str) -> DataFrame:
    c, new = _customers(s, d)
    return records.create_unique(c, new.withColumn("tier", F.lit(None).cast("string")), ["c_custkey"], "skip", {"tier": "gold"}).select("c_custkey", "c_name", "tier")


register("export_csv", "SELECT 'NATION:' || n_nationkey AS __id, 'NATION' AS __label, n_name, CAST(n_nationkey AS VARCHAR) AS n_nationkey, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")(
    lambda s, d: csv_files.export_frame(search(star.load(s, d, ["NATION"]), {"labels": ["NATION"]}, full_scan=True))
)


@register("import_csv", "SELECT event_id, event_type, value, strftime(ts, '%Y-%m-%d') AS day, 'datetime' AS type FROM events")
def import_csv(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias(" event id"), "event_type", "value", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    path, store = new_folder(s, "csv"), Store(Graph(s))
    e.write.option("header", True).csv(path)
    store.records.import_csv("EVENT", path)
    return store.graph.records("EVENT").select(F.col("event_id").cast("long").alias("event_id"), "event_type", "value", "day", F.lit(store.graph.type_of("EVENT", "day")).alias("type"))


@register("import_jsonl", "SELECT c_mktsegment AS segment, c_custkey AS key, c_name AS name, CAST(NULL AS VARCHAR) AS tier FROM customer WHERE c_acctbal <= 0 UNION ALL SELECT c_mktsegment, c_custkey, c_name, 'gold' FROM customer WHERE c_acctbal > 0")
def import_jsonl(s: SparkSession, d: str) -> DataFrame:
    """Customers nested in an account each, imported twice: the second time merges those of a positive balance by key."""
    c = star.load(s, d, ["CUSTOMER"]).records("CUSTOMER")
    store = Store(Graph(s))
    for rows, tier in ((c, None), (c.where("c_acctbal > 0"), "gold")):
        path = new_folder(s, "jsonl")
        inner = F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.lit(tier).cast("string").alias("tier"))
        rows.select(F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.concat(F.lit("a"), "c_custkey").alias("account"), F.array(inner).alias("HOLDER"))).alias("value")).write.text(path)
        store.records.import_json("ACCOUNT", path, merge_by=["key"] if tier else None)
    g = store.graph
    (edge,) = [e for e in g.edges if e.dst == "HOLDER"]
    holders = g.records("HOLDER").select(F.col(ID).alias("dst"), "key", "name", "tier")
    return edge.df.join(g.records("ACCOUNT").withColumnRenamed(ID, "src"), "src").join(holders, "dst").select("segment", F.col("key").cast("long").alias("key"), "name", "tier").distinct()


@register("restore_backup", "SELECT 'NATION:' || n_nationkey AS src, n_name, 'REGION:' || n_regionkey AS dst FROM nation")
def restore_backup(s: SparkSession, d: str) -> DataFrame:
    g, path = star.load(s, d, ["NATION", "REGION"]), new_folder(s, "graph") + ".backup"
    json_import.write_backup(g.scan(), g.all_edges(), path)
    recs, rels = json_import.restore_backup(s, path)
    return rels.join(recs.where("__label = 'NATION'").select(F.col(ID).alias("src"), "n_name"), "src").select("src", "n_name", "dst")


@register("connector_transform", "SELECT event_id AS \"eventId\", event_type AS \"eventType\", CAST(json_extract(props, '$.k') AS BIGINT) AS \"detailK\", event_id || ':' || user_id AS __key FROM events")
def connector_transform(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet").withColumn("detail", F.from_json("props", "k long"))
    return connectors.transform(e, ignore=["props", "ts", "value", "user_id"], separator="_", camel_case=True, key=["event_id", "user_id"])


@register("raw_sql", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 100 GROUP BY 1")
def raw_sql(s: SparkSession, d: str) -> DataFrame:
    return Store(star.load(s, d, ["CUSTOMER"])).query.raw("SELECT c_mktsegment, count(*) AS n FROM CUSTOMER WHERE c_acctbal > :least GROUP BY 1", least=100)


# vectors

QUERY = [((k * 37) % 64 - 31.5) / 32 for k in range(64)]
_Q = "[" + ", ".join(map(str, QUERY)) + "]::DOUBLE[]"


def _vectors(s: SparkSession, d: str) -> tuple[Graph, vectors.VectorIndex]:
    e = s.read.parquet(f"{d}/embeddings.parquet").withColumn(ID, F.concat(F.lit("VECTOR:"), "vec_id"))
    g = Graph(s, {"VECTOR": e.select(ID, "vec_id", "label", F.col("vec_id").cast("string").alias("name"))})
    return g, vectors.VectorIndex("VECTOR", "name", 64, "cosine", "external", e.select(F.col(ID).alias("record_id"), F.col("embedding").alias("vector")))


_COS = f"round((1 + list_cosine_similarity(embedding::DOUBLE[], {_Q})) / 2, 6)"
register("vec_cosine", f"SELECT vec_id, {_COS} AS score FROM embeddings")(
    lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.round(similarity.cosine(F.col("embedding"), F.array(*map(F.lit, QUERY))), 6).alias("score"))
)
register("vec_euclid", f"SELECT vec_id, round(1 / (1 + list_distance(embedding::DOUBLE[], {_Q}) ** 2), 6) AS score FROM embeddings")(
    lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.round(similarity.euclidean(F.col("embedding"), F.array(*map(F.lit, QUERY))), 6).alias("score"))
)
register("vec_search", f"SELECT vec_id, {_COS} AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_Q}) DESC LIMIT 20")(
    lambda s, d: vectors.vector_search(*_vectors(s, d), QUERY).select("vec_id", F.round("__score", 6).alias("score"))
)
register("vec_search_where", f"SELECT vec_id, {_COS} AS score FROM embeddings WHERE label <= 3 ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_Q}) DESC LIMIT 10")(
    lambda s, d: vectors.vector_search(*_vectors(s, d), QUERY, where={"label": {"$lte": 3}}, limit=10).select("vec_id", F.round("__score", 6).alias("score"))
)


@register("vec_upsert", "SELECT 'VECTOR:' || vec_id AS record_id, round(CASE WHEN vec_id % 10 = 0 THEN 1.0 ELSE embedding[1]::DOUBLE END, 6) AS first FROM embeddings")
def vec_upsert(s: SparkSession, d: str) -> DataFrame:
    g, index = _vectors(s, d)
    new = g.records("VECTOR").where("vec_id % 10 = 0").select(F.col(ID).alias("record_id"), F.array_repeat(F.lit(1.0).cast("float"), 64).alias("vector"))
    return vectors.upsert_vectors(g, index, new).vectors.select("record_id", F.round(F.col("vector")[0].cast("double"), 6).alias("first"))


register("vec_stats", 'SELECT count(*) AS "totalRecords", count(*) AS "indexedRecords" FROM embeddings')(lambda s, d: vectors.index_stats(*_vectors(s, d)))
register("mean_pool", "SELECT vec_id, round((embedding[1] + embedding[17] + embedding[33] + embedding[49])::DOUBLE / 4, 5) AS first, round((embedding[16] + embedding[32] + embedding[48] + embedding[64])::DOUBLE / 4, 5) AS last FROM embeddings")(
    lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", similarity.mean_pool(F.array(*[F.slice("embedding", k, 16) for k in (1, 17, 33, 49)])).alias("p")).select("vec_id", F.round(F.col("p")[0], 5).alias("first"), F.round(F.col("p")[15], 5).alias("last"))
)


@register("memory_upsert", "SELECT event_type, user_id, count(*) AS seen, max_by(value, event_id) AS value FROM events GROUP BY 1, 2")
def memory_upsert(s: SparkSession, d: str) -> DataFrame:
    """Events persisted by the hash of what they are, the newest value kept."""
    e = s.read.parquet(f"{d}/events.parquet").select("event_type", "user_id", "event_id", "value")
    e = e.withColumn("eventId", values.event_id(("event_type", F.col("event_type")), ("user_id", F.col("user_id")))).withColumn(ID, F.col("eventId"))
    stored = records.deduplicated(e.where("event_type <> 'click'"), ["eventId"], "event_id")
    merged = records.upsert(stored, e, ["eventId"], order="event_id")
    seen = e.groupBy("eventId").agg(F.count(F.lit(1)).alias("seen"))
    return merged.join(seen, "eventId").select("event_type", "user_id", "seen", "value")


@register("memory_recall", f"""WITH e AS (SELECT vec_id::VARCHAR AS id, 'topic ' || label AS text, label, embedding FROM embeddings),
    v AS (SELECT id, text, (1 + list_cosine_similarity(embedding::DOUBLE[], {_Q})) / 2 AS score FROM e WHERE label NOT IN (3, 9)),
    r AS (SELECT id, text, 0.55 + 0.25 * (CASE WHEN label = 7 THEN 2 ELSE 1 END) AS score FROM e)
    SELECT id, round(max(score), 6) AS score FROM (SELECT id, score FROM v UNION ALL SELECT id, least(1.0, score) FROM r) GROUP BY id ORDER BY max(score) DESC, id LIMIT 8""")  # fmt: skip
def memory_recall(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("id"), F.concat(F.lit("topic "), "label").alias("text"), "label", F.col("label").cast("string").alias("session"), "embedding", (F.col("label") != 9).alias("active"))
    out = vectors.recall(e.where("label <= 5"), e.where("label > 5"), e.select(F.col("id").alias("record_id"), F.col("embedding").alias("vector")), e.select("id", "text"), QUERY, ["topic", "7"], {}, exclude_session="3")
    return out.select("id", F.round("score", 6).alias("score"))


# discovery


@register("pattern_probe", "SELECT 'l_suppkey' AS source, least(100, count(*)) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def pattern_probe(s: SparkSession, d: str) -> DataFrame:
    g = star.load(s, d, ["LINEITEM", "SUPPLIER"])
    return edges.probe(g, {"label": "LINEITEM", "key": "l_suppkey"}, {"label": "SUPPLIER", "key": "s_suppkey"}, 100).select(F.lit("l_suppkey").alias("source"), "n")


@register("pattern_apply", "SELECT 'SUPPLIER:' || s_suppkey AS src, 'NATION:' || s_nationkey AS dst, 'HAS_NATION' AS type FROM supplier")
def pattern_apply(s: SparkSession, d: str) -> DataFrame:
    g = star.load(s, d, ["SUPPLIER", "NATION"])
    plain = _table(g).withColumn("type", F.lit("DEFAULT"))
    return _ids(discover.apply(g, plain, discover.Candidate("SUPPLIER", "s_nationkey", "NATION", "n_nationkey", "HAS_NATION", 0.86)))


def reach_counts(s: SparkSession, d: str) -> DataFrame:
    g = star.load(s, d, ["NATION", "REGION", "CUSTOMER"])
    starts = g.records("REGION").select(F.col(ID).alias("start"))
    return paths.reach(g, starts, (1, 2), None, "in").groupBy("start", "hops").agg(F.count(F.lit(1)).alias("n"))


register("hops_reach", "SELECT 'REGION:' || n_regionkey AS start, 1 AS hops, count(*) AS n FROM nation GROUP BY 1 UNION ALL SELECT 'REGION:' || n_regionkey, 2, count(*) FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")(reach_counts)
register("edge_table", "SELECT 'SUPPLIER:' || s_suppkey AS src, 'NATION:' || s_nationkey AS dst, 'LIVES_IN' AS type FROM supplier")(
    lambda s, d: (lambda g: _ids(g.edge_rows(Edge("LIVES_IN", "SUPPLIER", "NATION", ("s_nationkey", "n_nationkey")))))(star.load(s, d, ["SUPPLIER", "NATION"]))
)
