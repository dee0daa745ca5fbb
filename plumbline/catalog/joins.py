"""Joins of every kind, set operations and matching."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.catalog.base import Registry, table
from plumbline.operators import etl, stats

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


@query(
    "SELECT 'customer' AS kind, c_custkey AS key FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"
    " UNION ALL SELECT 'part', p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)"
)
def uncited_antijoin(spark, sf):
    customers = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    parts = table(spark, sf, "part").join(table(spark, sf, "lineitem").where("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti")
    return customers.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key")).union(parts.select(F.lit("part"), "p_partkey"))


@query(
    "WITH a AS (SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F')"
    " SELECT 'union' AS op, count(*) AS n, sum(k)::BIGINT AS total FROM (SELECT * FROM a UNION SELECT * FROM b)"
    " UNION ALL SELECT 'intersect', count(*), sum(k)::BIGINT FROM (SELECT * FROM a INTERSECT SELECT * FROM b)"
    " UNION ALL SELECT 'except', count(*), sum(k)::BIGINT FROM (SELECT * FROM a EXCEPT SELECT * FROM b)"
)
def set_ops(spark, sf):
    orders = table(spark, sf, "orders")
    a = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))
    b = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    out = None
    for op, df in (("union", a.union(b).distinct()), ("intersect", a.intersect(b)), ("except", a.subtract(b))):
        part = df.agg(F.count("*").alias("n"), F.sum("k").alias("total")).select(F.lit(op).alias("op"), "n", "total")
        out = part if out is None else out.union(part)
    return out


@query("WITH n AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_suppkey, n FROM n WHERE n IN (SELECT n FROM n GROUP BY n HAVING count(*) = 1)")
def multiplicity_match(spark, sf):
    return stats.unique_multiplicity(table(spark, sf, "lineitem"), "l_suppkey")


@query(
    "WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT s_nationkey AS nation, count(*) AS n, min(s_name) AS name FROM supplier GROUP BY 1)"
    " SELECT o_custkey, nation, o.n AS n FROM o JOIN s ON o.n = s.n WHERE NOT starts_with(name, 'Supplier#00000000')"
)
def value_match(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.min("s_name").alias("name"))
    return o.join(s.where(~F.col("name").startswith("Supplier#00000000")), "n").select("o_custkey", "nation", "n")


@query(
    "WITH f AS (SELECT conv_id, turn FROM conversations WHERE role = 'system' OR length(text) < 60)"
    " SELECT DISTINCT c.conv_id, c.turn, c.role FROM conversations c JOIN f ON f.conv_id = c.conv_id AND c.turn BETWEEN f.turn - 3 AND f.turn + 3"
)
def line_window_join(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    flagged = turns.where((F.col("role") == "system") | (F.length("text") < 60))
    return stats.neighbours(turns, flagged, ["conv_id"], "turn", 3).select("conv_id", "turn", "role").distinct()


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def contains_join(spark, sf):
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("needle"))
    return stats.contains_join(table(spark, sf, "documents").select("doc_id", "text"), items, "text", "needle", "doc_id", "item_id")


@query(
    "WITH d AS (SELECT unnest(generate_series(DATE '1995-01-01', DATE '1995-12-31', INTERVAL 1 DAY))::DATE AS day), m AS (SELECT l_shipdate::DATE AS day,"
    " count(*) AS n, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity FROM lineitem GROUP BY 1) SELECT d.day::VARCHAR AS day, coalesce(n, 0) AS n, coalesce(quantity, 0) AS quantity FROM d LEFT JOIN m ON d.day = m.day"
)
def calendar_left_join(spark, sf):
    daily = table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("n"), stats.exact_sum(F.col("l_quantity")).alias("quantity"))
    out = etl.calendar(spark, "1995-01-01", "1995-12-31").join(daily, "day", "left")
    return out.select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("quantity", F.lit(0.0)).alias("quantity"))


@query(
    "WITH m(status, code, label) AS (VALUES ('F', '1-URGENT', 'done first'), ('F', '5-LOW', 'done last'), ('O', '1-URGENT', 'open first'))"
    " SELECT o_orderkey, coalesce(label, 'N/D') AS label FROM orders LEFT JOIN m ON status = o_orderstatus AND code = trim(o_orderpriority) AND o_totalprice > 1000"
)
def broadcast_lookup(spark, sf):
    codes = etl.flattened(spark, {"F": {"1-URGENT": "done first", "5-LOW": "done last"}, "O": {"1-URGENT": "open first"}}, ["status", "code", "label"])
    on = (F.col("status") == F.col("o_orderstatus")) & (F.col("code") == F.trim("o_orderpriority")) & (F.col("o_totalprice") > 1000)
    return etl.looked_up(table(spark, sf, "orders"), codes, on, {"label": "N/D"}).select("o_orderkey", "label")


@query(
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderpriority = '1-URGENT')"
    " AND EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 25)"
)
def semi_filter(spark, sf):
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    large = table(spark, sf, "part").where("p_size > 25")
    lines = table(spark, sf, "lineitem").join(urgent, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return lines.join(large, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "SELECT cn.n_name AS customer_nation, sn.n_name AS supplier_nation, r_name AS region, count(*) AS n, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS revenue"
    " FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation cn ON cn.n_nationkey = c_nationkey"
    " LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation sn ON sn.n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = cn.n_regionkey GROUP BY ALL"
)
def snowflake_star(spark, sf):
    nation = table(spark, sf, "nation")
    cn = nation.select(F.col("n_nationkey").alias("cn_key"), F.col("n_name").alias("customer_nation"), F.col("n_regionkey").alias("cn_region"))
    sn = nation.select(F.col("n_nationkey").alias("sn_key"), F.col("n_name").alias("supplier_nation"))
    out = (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(cn, F.col("cn_key") == F.col("c_nationkey"), "left")
        .join(table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"), "left")
        .join(sn, F.col("sn_key") == F.col("s_nationkey"), "left")
        .join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("cn_region"), "left")
    )
    return out.groupBy("customer_nation", "supplier_nation", F.col("r_name").alias("region")).agg(
        F.count("*").alias("n"), stats.exact_sum(F.col("l_extendedprice")).alias("revenue")
    )


@query(
    "WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, round(o_totalprice, 0) AS price, count(*) AS n FROM orders GROUP BY ALL)"
    " SELECT o_orderkey, n FROM orders JOIN m ON month = date_trunc('month', o_orderdate)::DATE AND price = round(o_totalprice, 0) WHERE n > 0"
)
def expr_key_join(spark, sf):
    orders = table(spark, sf, "orders").withColumns({"month": F.trunc("o_orderdate", "month"), "price": F.round("o_totalprice", 0)})
    m = orders.groupBy("month", "price").agg(F.count("*").alias("n"))
    return orders.join(m, ["month", "price"]).select("o_orderkey", "n")


@query(
    "SELECT o_orderkey, o_totalprice, l.n, l.most FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_extendedprice) AS most FROM lineitem GROUP BY 1) l"
    " ON l_orderkey = o_orderkey LEFT JOIN (SELECT o_custkey AS k, max(o_totalprice) AS top FROM orders GROUP BY 1) t ON k = o_custkey WHERE o_totalprice = top"
)
def agg_self_join(spark, sf):
    orders = table(spark, sf, "orders")
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_extendedprice").alias("most"))
    # the greatest order of each customer by a window: the table isn't read twice for it
    top = F.max("o_totalprice").over(W.partitionBy("o_custkey"))
    out = orders.withColumn("top", top).where("o_totalprice = top").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return out.select("o_orderkey", "o_totalprice", "n", "most")


STRATEGIES = ("merge", "broadcast", "shuffle_hash", "shuffle_replicate_nl")
_ONE = "SELECT n_name AS nation, count(*) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1"


@query(" UNION ALL ".join(f"SELECT '{h}' AS strategy, * FROM ({_ONE})" for h in STRATEGIES))
def join_strategies(spark, sf):
    """One equi join under each strategy that can be asked for; the broadcast and the cartesian one are with a table of 25 rows."""
    suppliers, nation = table(spark, sf, "supplier"), table(spark, sf, "nation")
    out = None
    for hint in STRATEGIES:
        part = suppliers.join(nation.hint(hint), F.col("n_nationkey") == F.col("s_nationkey")).groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("n"))
        part = part.select(F.lit(hint).alias("strategy"), "nation", "n")
        out = part if out is None else out.union(part)
    return out


@query(
    "SELECT coalesce(s_nationkey, c_nationkey) AS nation, coalesce(s, 0) AS suppliers, coalesce(c, 0) AS customers FROM (SELECT s_nationkey, count(*) AS s FROM supplier"
    " WHERE s_acctbal > 5000 GROUP BY 1) FULL JOIN (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_acctbal > 9900 GROUP BY 1) ON s_nationkey = c_nationkey"
)
def full_outer_rollup(spark, sf):
    s = table(spark, sf, "supplier").where("s_acctbal > 5000").groupBy("s_nationkey").agg(F.count("*").alias("s"))
    c = table(spark, sf, "customer").where("c_acctbal > 9900").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    out = s.join(c, F.col("s_nationkey") == F.col("c_nationkey"), "full_outer")
    return out.select(F.coalesce("s_nationkey", "c_nationkey").alias("nation"), F.coalesce("s", F.lit(0)).alias("suppliers"), F.coalesce("c", F.lit(0)).alias("customers"))


@query(
    "WITH k AS (SELECT s_suppkey, regexp_extract(s_name, '[0-9]+$')::BIGINT AS id FROM supplier), p AS (SELECT p_partkey, p_name FROM part)"
    " SELECT s_suppkey, p_name FROM k JOIN p ON p_partkey = id"
)
def name_pairing(spark, sf):
    s = table(spark, sf, "supplier").withColumn("id", F.regexp_extract("s_name", "[0-9]+$", 0).cast("long"))
    return s.join(table(spark, sf, "part"), F.col("p_partkey") == F.col("id")).select("s_suppkey", "p_name")
