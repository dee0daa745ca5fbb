"""Aggregates, windows and cleaning of batch jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import Registry, table
from plumbline.operators import etl, stats

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


@query(
    "SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F' OR o_orderpriority IN ('1-URGENT', '2-HIGH')) AS pressing,"
    " count(*) FILTER (NOT contains(o_orderpriority, 'LOW')) AS not_low, coalesce(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice::DECIMAL(18,2) END), 0)::DOUBLE AS open_value FROM orders GROUP BY 1"
)
def conditional_counts(spark, sf):
    pressing = (F.col("o_orderstatus") == "F") | F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"),
        etl.count_where(pressing).alias("pressing"),
        etl.count_where(~F.col("o_orderpriority").contains("LOW")).alias("not_low"),
        F.coalesce(etl.sum_where(F.col("o_orderstatus") == "O", F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), F.lit(0.0)).alias("open_value"),
    )


@query(
    "SELECT l_suppkey, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS returned_parts, count(DISTINCT CASE WHEN l_linestatus = 'O' THEN l_orderkey END) AS open_orders,"
    " count(DISTINCT l_linenumber) AS executors FROM lineitem GROUP BY 1"
)
def multi_count_distinct(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        etl.distinct_where(F.col("l_returnflag") == "R", F.col("l_partkey")).alias("returned_parts"),
        etl.distinct_where(F.col("l_linestatus") == "O", F.col("l_orderkey")).alias("open_orders"),
        F.countDistinct("l_linenumber").alias("executors"),
    )


@query("SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN max(l_returnflag) END AS only_flag, count(*) AS n FROM lineitem GROUP BY 1")
def unique_or_null(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(etl.only_value("l_returnflag").alias("only_flag"), F.count("*").alias("n"))


@query(
    "SELECT l_orderkey, l_shipdate::VARCHAR AS l_shipdate, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey"
    " ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1"
)
def min_struct_row(spark, sf):
    out = etl.least_row(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"])
    return out.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))


@query(
    "SELECT o_custkey, arg_max(o_orderstatus, strftime(o_orderdate, '%Y%m%d') || lpad(o_orderkey::VARCHAR, 12, '0')) AS last_status, max(CASE WHEN o_orderstatus = 'F'"
    " THEN o_orderdate ELSE TIMESTAMP '1800-01-01' END)::DATE::VARCHAR AS last_finished FROM orders GROUP BY 1"
)
def max_by_status(spark, sf):
    finished = F.max(F.when(F.col("o_orderstatus") == "F", F.to_date("o_orderdate")).otherwise(F.lit("1800-01-01").cast("date")))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("last_status"), finished.cast("string").alias("last_finished")
    )


@query(
    "SELECT l_orderkey, max(CASE WHEN l_discount = 0 OR l_discount IS NULL THEN 1 ELSE 0 END) = 1 AS undiscounted, max(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS a,"
    " max(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS n, max(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS r FROM lineitem GROUP BY 1"
)
def flag_and_pivot(spark, sf):
    lines = table(spark, sf, "lineitem")
    pivot = [F.max(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))).alias(f.lower()) for f in ("A", "N", "R")]
    return lines.groupBy("l_orderkey").agg(F.bool_or(F.coalesce(F.col("l_discount") == 0, F.lit(True))).alias("undiscounted"), *pivot)


@query(
    "SELECT o_custkey, o_orderstatus, o_orderpriority, year(o_orderdate)::BIGINT AS y, month(o_orderdate)::BIGINT AS m, l_returnflag, l_linestatus, l_linenumber, (l_quantity > 25) AS big, count(*) AS n,"
    " sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL"
)
def wide_groupby(spark, sf):
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    keys = ["o_custkey", "o_orderstatus", "o_orderpriority", F.year("o_orderdate").cast("long").alias("y"), F.month("o_orderdate").cast("long").alias("m")]
    keys += ["l_returnflag", "l_linestatus", "l_linenumber", (F.col("l_quantity") > 25).alias("big")]
    return joined.groupBy(*keys).agg(F.count("*").alias("n"), stats.exact_sum(F.col("l_quantity")).alias("quantity"))


@query(
    "SELECT o_custkey, year(o_orderdate)::BIGINT AS y, month(o_orderdate)::BIGINT AS m, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate), month(o_orderdate)"
    " ORDER BY o_orderdate, o_orderkey) = 1"
)
def top1_per_month(spark, sf):
    orders = table(spark, sf, "orders").withColumns({"y": F.year("o_orderdate").cast("long"), "m": F.month("o_orderdate").cast("long")})
    return etl.first_rows(orders, ["o_custkey", "y", "m"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "y", "m", "o_orderkey")


@query(
    "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'O' THEN 2 WHEN 'P' THEN 1 ELSE 0 END DESC,"
    " o_totalprice DESC, o_orderkey) = 1"
)
def top1_conditional(spark, sf):
    rank = etl.rule_case([(F.col("o_orderstatus") == "O", 2), (F.col("o_orderstatus") == "P", 1)], 0)
    return etl.first_rows(table(spark, sf, "orders"), ["o_custkey"], [rank.desc(), F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query(
    "SELECT nation, sum(customers)::BIGINT AS customers, sum(suppliers)::BIGINT AS suppliers, sum(orders)::BIGINT AS orders FROM (SELECT c_nationkey AS nation, 1 AS customers, 0 AS suppliers, 0 AS orders FROM customer"
    " UNION ALL SELECT s_nationkey, 0, 1, 0 FROM supplier UNION ALL SELECT c_nationkey, 0, 0, 1 FROM orders JOIN customer ON c_custkey = o_custkey) GROUP BY 1"
)
def union_fill(spark, sf):
    customers = table(spark, sf, "customer")
    parts = [
        customers.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers")),
        table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers")),
        table(spark, sf, "orders").join(customers, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("orders")),
    ]
    metrics = ["customers", "suppliers", "orders"]
    return etl.summed(etl.filled_union(parts, ["nation"], metrics), ["nation"], metrics)


@query(
    "SELECT event_id, coalesce(try_cast(nullif(trim(regexp_extract(props, '[0-9]+')), '') AS INTEGER), 0) AS k, CASE WHEN value < 1 THEN 'N/D' ELSE event_type END AS kind,"
    " coalesce(try_cast(CASE WHEN value > 300 THEN 'N/A' ELSE value::DECIMAL(18,2)::VARCHAR END AS DOUBLE), -1) AS amount FROM events"
)
def null_standardize(spark, sf):
    raw = table(spark, sf, "events").select(
        "event_id",
        F.regexp_extract("props", "[0-9]+", 0).alias("k"),
        F.when(F.col("value") < 1, " ").otherwise(F.col("event_type")).alias("kind"),
        F.when(F.col("value") > 300, "N/A").otherwise(F.col("value").cast("decimal(18,2)").cast("string")).alias("amount"),
    )
    return etl.cleaned(raw, {"k": ("int", 0), "kind": ("string", "N/D"), "amount": ("double", -1.0)})


TYPES = [("LARGE", "bulk"), ("SMALL", "light"), ("PROMO", "offer")]


@query(
    "SELECT p_partkey, CASE WHEN p_type = 'LARGE' AND p_size > 30 THEN 'bulk XL' WHEN p_type = 'LARGE' THEN 'bulk' WHEN p_type = 'SMALL' THEN 'light' WHEN p_type = 'PROMO' THEN CASE WHEN p_size > 40 THEN 'offer XL' END"
    " WHEN p_name LIKE '%widget%' OR contains(p_name, 'ring') THEN 'small goods' ELSE 'other' END AS class, CASE WHEN p_retailprice > 1500 THEN CASE WHEN p_size > 25 THEN p_retailprice * 0.5 ELSE p_retailprice * 0.25 END"
    " WHEN p_retailprice > 1000 THEN 100.0 ELSE 0.0 END AS deductible FROM part"
)
def taxonomy(spark, sf):
    t, size, price = F.col("p_type"), F.col("p_size"), F.col("p_retailprice")
    kind = etl.rule_case(
        [
            ((t == "LARGE") & (size > 30), "bulk XL"),
            (t == "LARGE", "bulk"),
            (t == "SMALL", "light"),
            (t == "PROMO", F.when(size > 40, "offer XL")),  # null otherwise, not the outer default
            (F.col("p_name").like("%widget%") | F.col("p_name").contains("ring"), "small goods"),
        ],
        "other",
    )
    deductible = etl.rule_case([(price > 1500, F.when(size > 25, price * 0.5).otherwise(price * 0.25)), (price > 1000, F.lit(100.0))], F.lit(0.0))
    return table(spark, sf, "part").select("p_partkey", kind.alias("class"), deductible.alias("deductible"))


@query(
    "SELECT o_orderkey, year(o_orderdate)::BIGINT AS y, month(o_orderdate)::BIGINT AS m, date_trunc('month', o_orderdate)::DATE::VARCHAR AS month, (o_orderdate + INTERVAL 140 MINUTE)::VARCHAR AS later,"
    " date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS days, strftime(o_orderdate, '%d/%m/%Y') AS text, o_orderdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AS in_year FROM orders"
)
def date_functions(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.year(d).cast("long").alias("y"),
        F.month(d).cast("long").alias("m"),
        F.trunc(d, "month").cast("string").alias("month"),
        F.date_format(d + F.expr("INTERVAL 140 MINUTES"), "yyyy-MM-dd HH:mm:ss").alias("later"),
        F.datediff(F.to_date(d), F.lit("1990-01-01").cast("date")).cast("long").alias("days"),
        F.date_format(d, "dd/MM/yyyy").alias("text"),
        F.to_date(d).between("1996-01-01", "1996-12-31").alias("in_year"),
    )


@query("SELECT event_id, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 140 MINUTE")
def recent_window(spark, sf):
    events = table(spark, sf, "events")
    latest = events.agg((F.max("ts") - F.expr("INTERVAL 140 MINUTES")).alias("_from"))  # one row
    return events.join(F.broadcast(latest), F.col("ts") >= F.col("_from")).select("event_id", "user_id")


@query("SELECT DISTINCT p_brand, p_type FROM part WHERE p_size NOT IN (1, 2, 3) AND p_name IS NOT NULL AND trim(p_name) <> '' AND p_type <> 'ECONOMY'")
def distinct_filters(spark, sf):
    p = table(spark, sf, "part")
    return p.where(~F.col("p_size").isin(1, 2, 3) & F.col("p_name").isNotNull() & (F.trim("p_name") != "") & (F.col("p_type") != "ECONOMY")).select("p_brand", "p_type").distinct()


@query(
    "SELECT o_orderkey, 'open' AS branch, o_totalprice AS amount FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 'closed', o_totalprice - 1 FROM orders WHERE o_orderstatus <> 'O'"
)
def branch_union(spark, sf):
    return etl.by_two_branches(
        table(spark, sf, "orders"),
        F.col("o_orderstatus") == "O",
        lambda d: d.select("o_orderkey", F.lit("open").alias("branch"), F.col("o_totalprice").alias("amount")),
        lambda d: d.select("o_orderkey", F.lit("closed").alias("branch"), (F.col("o_totalprice") - 1).alias("amount")),
    )


@query("SELECT c_custkey, upper(c_mktsegment) AS segment, c_acctbal + 10 - 5 AS balance FROM customer")
def all_but_some(spark, sf):
    out = etl.without(table(spark, sf, "customer"), "c_name", "c_nationkey", "c_mktsegment", "c_acctbal", segment=F.upper("c_mktsegment"), balance=F.col("c_acctbal") + 10 - 5)
    return out.select("c_custkey", "segment", "balance")
