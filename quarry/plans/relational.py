"""The relational core over the business sources: scans, predicates, joins, grouping, totals, order, unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import scalars
from quarry.operators import registers, repository
from quarry.sources.registry import Registry

from .base import query

TS = "CAST('{}' AS TIMESTAMP)"


def _ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


# Scans and sources


@query("scan_table", "SELECT r_regionkey, r_name FROM region")
def scan_table(spark, d):
    return Registry(spark, d).table("region")


@query("scan_catalog", "SELECT c_custkey AS code, c_name AS description, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_catalog(spark, d):
    return Registry(spark, d).scan("customer")


@query("scan_document", "SELECT o_orderkey AS number, o_orderdate AS date, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def scan_document(spark, d):
    return Registry(spark, d).scan("orders")


@query("scan_register", "SELECT ts AS period, event_id, user_id, event_type, value, props FROM events")
def scan_register(spark, d):
    return Registry(spark, d).scan("events")


@query("vt_slice_last", "SELECT user_id, event_type, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00') WHERE rn = 1")
def vt_slice_last(spark, d):
    rows = Registry(spark, d).table("events").select("user_id", "event_type", "ts", "event_id", "value")
    return registers.slice_last(rows, "ts", ["user_id", "event_type"], _ts("2024-01-20 00:00:00"), ("event_id",))


@query("vt_balance", "SELECT l_suppkey, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE -l_quantity END), 2) AS l_quantity_balance FROM lineitem WHERE l_shipdate <= TIMESTAMP '1997-01-01 00:00:00' GROUP BY l_suppkey")
def vt_balance(spark, d):
    return registers.balance(Registry(spark, d).table("lineitem"), "l_shipdate", ["l_suppkey"], "l_quantity", F.col("l_returnflag") == "R", _ts("1997-01-01 00:00:00"))


@query("vt_turnover", "SELECT l_suppkey, round(coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0), 2) AS l_quantity_receipt, round(coalesce(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity END), 0), 2) AS l_quantity_expense FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1995-01-01 00:00:00' AND TIMESTAMP '1996-12-31 23:59:59' GROUP BY l_suppkey")
def vt_turnover(spark, d):
    return registers.turnover(Registry(spark, d).table("lineitem"), "l_shipdate", ["l_suppkey"], "l_quantity", F.col("l_returnflag") == "R", _ts("1995-01-01 00:00:00"), _ts("1996-12-31 23:59:59"))


@query("derived_table", "SELECT seg, round(avg(total), 2) AS mean_total FROM (SELECT c.c_mktsegment AS seg, o.o_custkey, sum(o.o_totalprice) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2) GROUP BY seg")
def derived_table(spark, d):
    r = Registry(spark, d)
    inner = r.table("orders").join(r.table("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("seg"), "o_custkey").agg(F.sum("o_totalprice").alias("total"))
    return inner.groupBy("seg").agg(F.round(F.avg("total"), 2).alias("mean_total"))


@query("comma_join", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
def comma_join(spark, d):
    r = Registry(spark, d)
    return r.table("nation").crossJoin(r.table("region")).where("n_regionkey = r_regionkey").select("n_name", "r_name")  # an equi-join once optimised


@query("temp_table_batch", "WITH big AS (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY o_custkey HAVING count(*) >= 5) SELECT c.c_mktsegment, count(*) AS customers, CAST(sum(b.orders) AS BIGINT) AS orders FROM big b JOIN customer c ON c.c_custkey = b.o_custkey GROUP BY c.c_mktsegment")
def temp_table_batch(spark, d):
    r = Registry(spark, d)
    big = r.table("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders")).where("orders >= 5")
    return big.join(r.table("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"), F.sum("orders").alias("orders"))


@query("temp_table_drop", "SELECT n_regionkey, count(*) AS nations FROM nation GROUP BY n_regionkey")
def temp_table_drop(spark, d):
    """A named intermediate serves one query and is gone after it."""
    Registry(spark, d).table("nation").createOrReplaceTempView("quarry_step")
    out = spark.sql("SELECT n_regionkey, count(*) AS nations FROM quarry_step GROUP BY n_regionkey")
    spark.catalog.dropTempView("quarry_step")
    return out


# Projections and predicates


@query("project", "SELECT o_orderkey AS number, o_totalprice * 2 AS doubled FROM orders")
def project(spark, d):
    return Registry(spark, d).table("orders").select(F.col("o_orderkey").alias("number"), (F.col("o_totalprice") * 2).alias("doubled"))


@query("project_names", "SELECT c_name, upper(c_mktsegment) AS upper, c_acctbal + 1 AS Expression, c_acctbal * 2 AS Expression1, c_custkey AS code, c_name AS c_name1 FROM customer")
def project_names(spark, d):
    """Columns projected by their text, named by what it says: a field, a function, an alias, or nothing."""
    customer = Registry(spark, d).table("customer").alias("c")
    return repository.project(customer, ["c_name", "upper(c_mktsegment)", "c_acctbal + 1", "c_acctbal * 2", "c_custkey AS code", "c.c_name"])


@query("select_star", "SELECT * FROM supplier")
def select_star(spark, d):
    return Registry(spark, d).table("supplier").select("*")


@query("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(spark, d):
    return Registry(spark, d).table("orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("allowed", "SELECT c_custkey AS code, c_name AS description, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal >= 0")
def allowed(spark, d):
    return Registry(spark, d, {"customer": F.col("c_acctbal") >= 0}).scan("customer", allowed=True)


@query("filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
def filter_rows(spark, d):
    return Registry(spark, d).table("orders").where("o_orderstatus = 'F' AND o_totalprice > 1000").select("o_orderkey", "o_totalprice")


@query("cmp_ops", "SELECT p_partkey, p_size = 10 AS eq, p_size <> 10 AS ne, p_size < 10 AS lt, p_size <= 10 AS le, p_size > 10 AS gt, p_size >= 10 AS ge FROM part")
def cmp_ops(spark, d):
    c = F.col("p_size")
    return Registry(spark, d).table("part").select("p_partkey", (c == 10).alias("eq"), (c != 10).alias("ne"), (c < 10).alias("lt"), (c <= 10).alias("le"), (c > 10).alias("gt"), (c >= 10).alias("ge"))


@query("bool_ops", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 500) AND o_custkey > 10")
def bool_ops(spark, d):
    return Registry(spark, d).table("orders").where(~((F.col("o_orderstatus") == "F") | (F.col("o_totalprice") < 500)) & (F.col("o_custkey") > 10)).select("o_orderkey")


@query("between", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01 00:00:00' AND TIMESTAMP '1995-06-30 00:00:00'")
def between(spark, d):
    return Registry(spark, d).table("orders").where(F.col("o_orderdate").between(_ts("1995-01-01 00:00:00"), _ts("1995-06-30 00:00:00"))).select("o_orderkey")


@query("in_list", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def in_list(spark, d):
    wanted = ["BUILDING", "MACHINERY"]
    return Registry(spark, d).table("customer").where(F.col("c_mktsegment").isin(wanted)).select("c_custkey")


@query("in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def in_subquery(spark, d):
    r = Registry(spark, d)
    return r.table("customer").join(r.table("orders").where("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("not_in", "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (0, 1)")
def not_in(spark, d):
    return Registry(spark, d).table("nation").where(~F.col("n_regionkey").isin(0, 1)).select("n_nationkey")


@query("like", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%' AND p_name NOT LIKE '_a%'")
def like(spark, d):
    return Registry(spark, d).table("part").where(F.col("p_type").like("%A%") & ~F.col("p_name").like("_a%")).select("p_partkey", "p_type")


@query("is_null", "SELECT c_custkey, o_orderkey IS NULL AS without FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1993-01-01 00:00:00') ON c_custkey = o_custkey WHERE o_orderkey IS NULL OR o_totalprice IS NOT NULL")
def is_null(spark, d):
    r = Registry(spark, d)
    early = r.table("orders").where(F.col("o_orderdate") < _ts("1993-01-01 00:00:00"))
    joined = r.table("customer").join(early, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.where(F.col("o_orderkey").isNull() | F.col("o_totalprice").isNotNull()).select("c_custkey", F.col("o_orderkey").isNull().alias("without"))


@query("arith", "SELECT l_orderkey, l_linenumber, round(-l_extendedprice * (1 - l_discount) + l_tax, 4) AS net, round(l_extendedprice / nullif(l_linenumber - 1, 0), 4) AS share FROM lineitem")
def arith(spark, d):
    c = F.col
    net = F.round(-c("l_extendedprice") * (1 - c("l_discount")) + c("l_tax"), 4)
    return Registry(spark, d).table("lineitem").select("l_orderkey", "l_linenumber", net.alias("net"), F.round(scalars.divide(c("l_extendedprice"), c("l_linenumber") - 1), 4).alias("share"))


@query("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 50000 THEN 'middle' ELSE 'small' END AS size FROM orders")
def case_when(spark, d):
    size = F.when(F.col("o_totalprice") > 200000, "large").when(F.col("o_totalprice") > 50000, "middle").otherwise("small")
    return Registry(spark, d).table("orders").select("o_orderkey", size.alias("size"))


@query("cast", "SELECT p_partkey, CAST(p_retailprice AS DECIMAL(12, 1)) AS price, left(CAST(p_size AS VARCHAR), 1) AS first_digit, CAST(p_partkey AS VARCHAR) AS word, p_size > 10 AS flag FROM part")
def cast(spark, d):
    return Registry(spark, d).table("part").select("p_partkey", scalars.number(F.col("p_retailprice"), 12, 1).alias("price"), scalars.limited_text(F.col("p_size"), 1).alias("first_digit"), scalars.text(F.col("p_partkey")).alias("word"), (F.col("p_size") > 10).cast("boolean").alias("flag"))


@query("param", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice >= 1000")
def param(spark, d):
    Registry(spark, d).table("orders").createOrReplaceTempView("quarry_orders")
    return spark.sql("SELECT o_orderkey FROM quarry_orders WHERE o_orderpriority = :priority AND o_totalprice >= :least", args={"priority": "1-URGENT", "least": 1000})


@query("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def scalar_subquery(spark, d):
    orders = Registry(spark, d).table("orders")
    mean = orders.agg(F.avg("o_totalprice").alias("mean"))  # one row, whatever the input
    return orders.join(F.broadcast(mean), F.col("o_totalprice") > F.col("mean")).select("o_orderkey")


@query("ref_navigation", "SELECT o.o_orderkey, c.c_name AS o_custkey_c_name, n.n_name AS o_custkey_c_nationkey_n_name, r.r_name AS o_custkey_c_nationkey_n_regionkey_r_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey")
def ref_navigation(spark, d):
    r = Registry(spark, d)
    out = r.navigate(r.table("orders"), "orders", "o_custkey.c_name", "o_custkey.c_nationkey.n_name", "o_custkey.c_nationkey.n_regionkey.r_name")
    return out.select("o_orderkey", "o_custkey_c_name", "o_custkey_c_nationkey_n_name", "o_custkey_c_nationkey_n_regionkey_r_name")


@query("literals", "SELECT r_regionkey, CAST(7 AS BIGINT) AS whole, CAST(2.5 AS DOUBLE) AS part, 'it''s' AS word, TRUE AS yes, CAST(NULL AS VARCHAR) AS nothing FROM region")
def literals(spark, d):
    return Registry(spark, d).table("region").select("r_regionkey", F.lit(7).cast("long").alias("whole"), F.lit(2.5).alias("part"), F.lit("it's").alias("word"), F.lit(True).alias("yes"), F.lit(None).cast("string").alias("nothing"))


# Joins


def _customers_orders(spark, d, how):
    """Customers without orders are unmatched on the left; orders of no customer, if any, on the right."""
    r = Registry(spark, d)
    c, o = r.table("customer").select("c_custkey", "c_name"), r.table("orders").select("o_orderkey", "o_custkey")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), how).select("c_custkey", "c_name", "o_orderkey")


_JOIN = "SELECT c_custkey, c_name, o_orderkey FROM customer {} JOIN orders ON c_custkey = o_custkey"


@query("join_inner", _JOIN.format("INNER"))
def join_inner(spark, d):
    return _customers_orders(spark, d, "inner")


@query("join_left", _JOIN.format("LEFT"))
def join_left(spark, d):
    return _customers_orders(spark, d, "left")


@query("join_right", _JOIN.format("RIGHT"))
def join_right(spark, d):
    return _customers_orders(spark, d, "right")


@query("join_full", _JOIN.format("FULL"))
def join_full(spark, d):
    return _customers_orders(spark, d, "full")


def _whole_customers_orders(spark, d, how):
    """Whole tables: customers without open orders and orders that aren't open have no match."""
    r = Registry(spark, d)
    c = r.table("customer").select("c_custkey", "c_name")
    o = r.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    on = (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_orderstatus") == "O")
    return c.join(o, on, how).select("c_custkey", "c_name", "o_orderkey")


_WHOLE_JOIN = "SELECT c_custkey, c_name, o_orderkey FROM customer {} JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'O'"


@query("join_inner_whole", _WHOLE_JOIN.format("INNER"))
def join_inner_whole(spark, d):
    return _whole_customers_orders(spark, d, "inner")


@query("join_left_whole", _WHOLE_JOIN.format("LEFT"))
def join_left_whole(spark, d):
    return _whole_customers_orders(spark, d, "left")


@query("join_right_whole", _WHOLE_JOIN.format("RIGHT"))
def join_right_whole(spark, d):
    return _whole_customers_orders(spark, d, "right")


@query("join_full_whole", _WHOLE_JOIN.format("FULL"))
def join_full_whole(spark, d):
    return _whole_customers_orders(spark, d, "full")


@query("join_theta", "SELECT s.s_suppkey, n.n_nationkey FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 100 * n.n_regionkey")
def join_theta(spark, d):
    r = Registry(spark, d)
    return r.table("supplier").join(r.table("nation"), (F.col("s_nationkey") == F.col("n_nationkey")) & (F.col("s_acctbal") > 100 * F.col("n_regionkey"))).select("s_suppkey", "n_nationkey")


@query("join_cross", "SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(spark, d):
    """Two dimension tables of fixed size; no table that grows is joined without a condition."""
    r = Registry(spark, d)
    return r.table("nation").crossJoin(F.broadcast(r.table("region"))).select("n_name", "r_name")


@query("join_nested", "SELECT c.c_custkey, x.n_name, x.r_name FROM customer c LEFT JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA') x ON c.c_nationkey = x.n_nationkey")
def join_nested(spark, d):
    r = Registry(spark, d)
    inner = r.table("nation").join(r.table("region").where("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return r.table("customer").join(inner, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "r_name")


@query("join_chain", "SELECT o.o_orderkey, l.l_linenumber, c.c_name, p.p_brand, s.s_name FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey AND o.o_orderstatus = 'F' JOIN customer c ON o.o_custkey = c.c_custkey JOIN part p ON l.l_partkey = p.p_partkey AND p.p_size > 20 JOIN supplier s ON l.l_suppkey = s.s_suppkey")
def join_chain(spark, d):
    r = Registry(spark, d)
    out = r.table("lineitem").join(r.table("orders").where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = out.join(r.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(r.table("part").where("p_size > 20"), F.col("l_partkey") == F.col("p_partkey"))
    return out.join(r.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("o_orderkey", "l_linenumber", "c_name", "p_brand", "s_name")


@query("join_semi", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)")
def join_semi(spark, d):
    r = Registry(spark, d)
    return r.table("part").join(r.table("lineitem").where("l_quantity >= 45"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@query("join_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 20000)")
def join_anti(spark, d):
    """NOT IN with its three-valued logic, which Spark plans as a null-aware anti-join."""
    r = Registry(spark, d)
    r.table("customer").createOrReplaceTempView("quarry_customer")
    r.table("orders").createOrReplaceTempView("quarry_orders")
    return spark.sql("SELECT c_custkey FROM quarry_customer WHERE c_custkey NOT IN (SELECT o_custkey FROM quarry_orders WHERE o_totalprice > 20000)")


@query("flagship", "SELECT c.c_mktsegment AS seg, round(sum(o.o_totalprice), 2) AS total, count(DISTINCT o.o_custkey) AS custs FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'F' GROUP BY c.c_mktsegment HAVING sum(o.o_totalprice) > 0 ORDER BY total DESC, seg LIMIT 10")
def flagship(spark, d):
    r = Registry(spark, d)
    joined = r.table("orders").where("o_orderstatus = 'F'").join(r.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    summed = joined.groupBy(F.col("c_mktsegment").alias("seg")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.countDistinct("o_custkey").alias("custs"))
    return summed.where("total > 0").orderBy(F.desc("total"), "seg").limit(10)


# Grouping and totals


@query("group_by", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def group_by(spark, d):
    return Registry(spark, d).table("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("agg_sum", "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_returnflag")
def agg_sum(spark, d):
    return Registry(spark, d).table("lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("agg_avg", "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY o_orderpriority")
def agg_avg(spark, d):
    return Registry(spark, d).table("orders").groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("agg_minmax", "SELECT event_type, min(ts) AS first_ts, max(ts) AS last_ts, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def agg_minmax(spark, d):
    return Registry(spark, d).table("events").groupBy("event_type").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("agg_count", "SELECT c_nationkey, count(*) AS n, count(c_acctbal) AS with_balance FROM customer GROUP BY c_nationkey")
def agg_count(spark, d):
    return Registry(spark, d).table("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.count("c_acctbal").alias("with_balance"))


@query("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY l_returnflag")
def agg_distinct(spark, d):
    return Registry(spark, d).table("lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.sum_distinct("l_linenumber").alias("lines"))


@query("agg_global", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_orderdate) AS last_date FROM orders")
def agg_global(spark, d):
    return Registry(spark, d).table("orders").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderdate").alias("last_date"))


@query("having", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 50")
def having(spark, d):
    return Registry(spark, d).table("lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).where("n > 50")


_GROUPED = "(SELECT r_name, n_name, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name)"


def _grouped(spark, d):
    r = Registry(spark, d)
    out = r.table("orders").join(r.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(r.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(r.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return out.groupBy("r_name", "n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("totals_by", f"SELECT r_name, n_name, total, 2 AS _level FROM {_GROUPED} UNION ALL SELECT r_name, NULL, round(sum(total), 2), 1 FROM {_GROUPED} GROUP BY r_name")
def totals_by(spark, d):
    rows = _grouped(spark, d)
    return registers.totals(rows, ["r_name"], ["total"])


@query("totals_overall", f"SELECT r_name, n_name, total, 2 AS _level FROM {_GROUPED} UNION ALL SELECT r_name, NULL, round(sum(total), 2), 1 FROM {_GROUPED} GROUP BY r_name UNION ALL SELECT NULL, NULL, round(sum(total), 2), 0 FROM {_GROUPED}")
def totals_overall(spark, d):
    return registers.totals(_grouped(spark, d), ["r_name"], ["total"], overall=True)


# Order and limits


@query("order_by", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey")
def order_by(spark, d):
    return Registry(spark, d).table("customer").select("c_custkey", "c_acctbal").orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey")


@query("auto_order", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderkey")
def auto_order(spark, d):
    """The wanted order with the source's key as its last term, so it is total."""
    return Registry(spark, d).table("orders").select("o_orderkey", "o_orderpriority").orderBy("o_orderpriority", "o_orderkey")


@query("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_n(spark, d):
    return Registry(spark, d).table("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("distinct_top", "SELECT DISTINCT p_brand FROM part ORDER BY p_brand LIMIT 10")
def distinct_top(spark, d):
    return Registry(spark, d).table("part").select("p_brand").distinct().orderBy("p_brand").limit(10)


# Unions


@query("union_all", "SELECT c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier")
def union_all(spark, d):
    r = Registry(spark, d)
    return r.table("customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")).union(r.table("supplier").select("s_name", "s_acctbal"))


@query("union_distinct", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    r = Registry(spark, d)
    return r.table("customer").select(F.col("c_nationkey").alias("nation")).union(r.table("supplier").select("s_nationkey")).distinct()


@query("union_order", "SELECT 'c' AS kind, c_name AS name FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 's', s_name FROM supplier UNION ALL SELECT 'n', n_name FROM nation ORDER BY 1, 2")
def union_order(spark, d):
    """The order binds to the whole union."""
    r = Registry(spark, d)
    rows = [("c", r.table("customer").where("c_acctbal < 0"), "c_name"), ("s", r.table("supplier"), "s_name"), ("n", r.table("nation"), "n_name")]
    parts = [df.select(F.lit(kind).alias("kind"), F.col(name).alias("name")) for kind, df, name in rows]
    return parts[0].union(parts[1]).union(parts[2]).orderBy("kind", "name")


# Scalar functions

_WHEN = "o_orderdate"


@query("fn_string", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS word FROM part")
def fn_string(spark, d):
    return Registry(spark, d).table("part").select("p_partkey", scalars.text(F.col("p_size")).alias("word"))


@query("fn_datetime", "SELECT r_regionkey, make_timestamp(2024, 2, CAST(1 + r_regionkey AS BIGINT), 10, 20, 30) AS made FROM region")
def fn_datetime(spark, d):
    return Registry(spark, d).table("region").select("r_regionkey", scalars.moment(2024, 2, 1 + F.col("r_regionkey"), 10, 20, 30).alias("made"))


for _name, _part in (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("hour", F.hour), ("minute", F.minute), ("second", F.second)):

    @query(f"fn_{_name}", f"SELECT event_id, CAST({_name}(ts) AS INTEGER) AS part FROM events")
    def fn_part(spark, d, part=_part):
        return Registry(spark, d).table("events").select("event_id", part("ts").alias("part"))


@query("fn_begin_period", "SELECT event_id, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month_start, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week_start, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour_start FROM events")
def fn_begin_period(spark, d):
    return Registry(spark, d).table("events").select("event_id", *[scalars.begin_of_period(F.col("ts"), u).alias(f"{u}_start") for u in ("month", "week", "hour")])


@query("fn_end_period", "SELECT event_id, CAST(date_trunc('month', ts) + INTERVAL 1 MONTH - INTERVAL 1 SECOND AS TIMESTAMP) AS month_end, CAST(date_trunc('quarter', ts) + INTERVAL 3 MONTH - INTERVAL 1 SECOND AS TIMESTAMP) AS quarter_end FROM events")
def fn_end_period(spark, d):
    return Registry(spark, d).table("events").select("event_id", *[scalars.end_of_period(F.col("ts"), u).alias(f"{u}_end") for u in ("month", "quarter")])


@query("fn_isnull", "SELECT c_custkey, coalesce(o_totalprice, 0) AS price FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1993-01-01 00:00:00') ON c_custkey = o_custkey")
def fn_isnull(spark, d):
    r = Registry(spark, d)
    early = r.table("orders").where(F.col("o_orderdate") < _ts("1993-01-01 00:00:00"))
    return r.table("customer").join(early, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", scalars.if_null(F.col("o_totalprice"), F.lit(0.0)).alias("price"))
