"""Run analytics on the star schema: a supplier stands for a stage, a line for a task, a line number for an executor, an
order for a job, a priority for a call site, an event for a log record and a user for a log."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import Registry, table
from plumbline.operators import etl, stats

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql

STAGES = """
SELECT l_suppkey, count(l_quantity) AS n, min(l_quantity) AS min, max(l_quantity) AS max,
  sum(l_quantity::DECIMAL(18,2))::DOUBLE AS total, median(l_quantity) AS median, quantile_disc(l_quantity, 0.95) AS p95
FROM lineitem GROUP BY l_suppkey"""
STAGE_STATS = f"""
SELECT *, round(total / n, 1) AS mean, CASE WHEN median > 0 THEN round(max / median, 2) END AS skew FROM ({STAGES})"""


@query(STAGE_STATS)
def stage_stats(spark, sf):
    return stats.duration_stats(table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity")


@query(
    "SELECT l_suppkey, l_linenumber, count(*) AS n, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS total,"
    " round(sum(l_quantity::DECIMAL(18,2))::DOUBLE / count(*), 1) AS mean FROM lineitem GROUP BY ALL"
)
def executor_stats(spark, sf):
    out = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"), stats.exact_sum(F.col("l_quantity")).alias("total"))
    return out.withColumn("mean", F.round(F.col("total") / F.col("n"), 1))


@query(f"SELECT l_suppkey, skew, max, n FROM ({STAGE_STATS}) WHERE skew >= 1.8 AND n >= 8 AND max >= 40")
def skewed_stages(spark, sf):
    return stage_stats(spark, sf).where("skew >= 1.8 AND n >= 8 AND max >= 40").select("l_suppkey", "skew", "max", "n")


@query(f"SELECT l_suppkey, n, median FROM ({STAGES}) WHERE n >= 500 AND median < 26")
def exploded_stages(spark, sf):
    return stage_stats(spark, sf).where("n >= 500 AND median < 26").select("l_suppkey", "n", "median")


@query(
    "SELECT count(*) FILTER (n = 1) AS single, count(*) AS stages, 100.0 * count(*) FILTER (n = 1) / count(*) AS pct"
    " FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)"
)
def single_task_share(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    out = n.agg(F.count_if(F.col("n") == 1).alias("single"), F.count("*").alias("stages"))
    return out.withColumn("pct", 100.0 * F.col("single") / F.col("stages"))


@query(
    "SELECT o_orderpriority AS action, count(*) AS num_jobs, round(sum(o_totalprice::DECIMAL(18,2))::DOUBLE, 2) AS total_s,"
    " round(sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*), 3) AS mean_s, min(o_orderkey) AS first_job, max(o_orderkey) AS last_job"
    " FROM orders GROUP BY 1"
)
def call_site_rollup(spark, sf):
    out = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("action")).agg(
        F.count("*").alias("num_jobs"), F.round(stats.exact_sum(F.col("o_totalprice")), 2).alias("total_s"), F.min("o_orderkey").alias("first_job"), F.max("o_orderkey").alias("last_job")
    )
    return out.withColumn("mean_s", F.round(F.col("total_s") / F.col("num_jobs"), 3)).orderBy(F.desc("total_s"), "first_job")


@query(
    "SELECT o_custkey, count(*) AS num_jobs, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'LOW' ELSE 'MEDIUM' END AS severity"
    " FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey, c_mktsegment HAVING count(*) >= 12"
)
def repeated_actions(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("num_jobs")).where("num_jobs >= 12")
    out = n.join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return out.select("o_custkey", "num_jobs", F.when(F.col("c_mktsegment") == "MACHINERY", "LOW").otherwise("MEDIUM").alias("severity"))


@query(
    "SELECT user_id, arg_max(value, event_id) FILTER (event_type = 'view') AS started, arg_max(value, event_id) FILTER (event_type = 'purchase') AS finished,"
    " bool_or(event_type = 'error') AS failed, arg_max(props, event_id) FILTER (event_type = 'error') AS reason FROM events GROUP BY user_id"
)
def task_merge(spark, sf):
    kind = F.col("event_type")
    return stats.merged_by_key(
        table(spark, sf, "events"),
        ["user_id"],
        "event_id",
        {"started": F.when(kind == "view", F.col("value")), "finished": F.when(kind == "purchase", F.col("value")), "reason": F.when(kind == "error", F.col("props"))},
        {"failed": kind == "error"},
    )


@query(
    "SELECT * FROM (SELECT event_id, user_id, event_type, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS)"
    " OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS origin_id FROM events) WHERE event_type IN ('click', 'purchase')"
)
def origin_asof(spark, sf):
    events = stats.asof_last(table(spark, sf, "events"), ["user_id"], ["event_id"], {"origin_id": F.when(F.col("event_type") == "signup", F.col("event_id"))})
    return events.where(F.col("event_type").isin("click", "purchase")).select("event_id", "user_id", "event_type", "origin_id")


@query(
    "WITH v AS (SELECT user_id, event_id AS view_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events WHERE event_type = 'view'),"
    " p AS (SELECT user_id, event_id AS purchase_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events WHERE event_type = 'purchase')"
    " SELECT v.user_id, v.pos, view_id, purchase_id FROM v LEFT JOIN p ON v.user_id = p.user_id AND v.pos = p.pos"
)
def positional_join(spark, sf):
    events = table(spark, sf, "events")
    views = events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"))
    purchases = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"))
    out = stats.positional_join(views, purchases, ["user_id"], ["view_id"], ["purchase_id"])
    return out.select("user_id", F.col("pos").cast("long").alias("pos"), "view_id", "purchase_id")


@query(
    "WITH t AS (SELECT DISTINCT l_suppkey, l_partkey, date_trunc('month', l_shipdate) AS m FROM lineitem),"
    " f AS (SELECT l_suppkey, l_partkey, min(m) AS first FROM t GROUP BY ALL)"
    " SELECT t.l_suppkey, count(*) AS reexecuted FROM t JOIN f USING (l_suppkey, l_partkey) WHERE m > first GROUP BY 1"
)
def reexecuted_partitions(spark, sf):
    attempts = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", F.trunc("l_shipdate", "month").alias("m")).distinct()
    n = attempts.groupBy("l_suppkey", "l_partkey").agg((F.count("*") - 1).alias("again")).where("again > 0")
    return n.groupBy("l_suppkey").agg(F.sum("again").alias("reexecuted"))


SESSIONS = (
    "SELECT *, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM events"
)


@query(f"SELECT user_id, session, count(*) AS n, min(event_id) AS first_id FROM ({SESSIONS}) GROUP BY ALL")
def sessionize_records(spark, sf):
    out = stats.sessions(table(spark, sf, "events"), ["user_id"], ["event_id"], F.col("event_type") == "error")
    return out.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query(
    "SELECT event_id, user_id, coalesce(max((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id"
    " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS after_error FROM events"
)
def stack_flag(spark, sf):
    return stats.ever_before(table(spark, sf, "events"), ["user_id"], ["event_id"], F.col("event_type") == "error", "after_error").select("event_id", "user_id", "after_error")


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1")
def event_counts(spark, sf):
    out = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))
    return out.orderBy(F.desc("n"), "first_id")


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


@query("SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS duration_s, count(*) AS n FROM events")
def total_duration(spark, sf):
    return table(spark, sf, "events").agg(((micros_max("ts") - micros_min("ts")) / 1000000.0).alias("duration_s"), F.count("*").alias("n"))


def micros_max(column: str):
    return F.max(micros(column))


def micros_min(column: str):
    return F.min(micros(column))


@query(
    "SELECT slots, work, span_s, round(100 * work / (slots * span_s), 4) AS occupancy_pct FROM (SELECT count(DISTINCT user_id) AS slots,"
    " sum(value::DECIMAL(18,2))::DOUBLE AS work, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS span_s FROM events)"
)
def capacity_occupancy(spark, sf):
    out = table(spark, sf, "events").agg(
        F.countDistinct("user_id").alias("slots"), stats.exact_sum(F.col("value")).alias("work"), ((micros_max("ts") - micros_min("ts")) / 1000000.0).alias("span_s")
    )
    return out.withColumn("occupancy_pct", F.round(100 * F.col("work") / (F.col("slots") * F.col("span_s")), 4))


@query(
    "WITH top AS (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10), cited AS (SELECT o_orderkey FROM orders JOIN customer"
    " ON c_custkey = o_custkey WHERE c_acctbal < -900), chosen AS (SELECT * FROM top UNION SELECT * FROM cited)"
    " SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) - (SELECT count(*) FROM chosen) AS omitted FROM orders WHERE o_orderkey IN (SELECT * FROM chosen)"
)
def top_k_plus_cited(spark, sf):
    orders = table(spark, sf, "orders")
    cited = orders.join(table(spark, sf, "customer").where("c_acctbal < -900"), F.col("c_custkey") == F.col("o_custkey"))
    chosen = stats.top_k_and_cited(orders, "o_orderkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 10, cited)
    omitted = orders.agg(F.count("*").alias("_all")).crossJoin(chosen.agg(F.count("*").alias("_kept")))  # one row each
    return chosen.crossJoin(F.broadcast(omitted)).select("o_orderkey", "o_totalprice", (F.col("_all") - F.col("_kept")).alias("omitted"))


@query(
    "WITH m AS (SELECT event_id, ts FROM events WHERE event_type = 'signup')"
    " SELECT event_id, epoch_us(ts) AS t0, epoch_us(lead(ts) OVER (ORDER BY ts, event_id)) AS t1 FROM m"
)
def phase_intervals(spark, sf):
    marks = table(spark, sf, "events").where("event_type = 'signup'").select("event_id", micros("ts").alias("t0"), F.lit(0).alias("log"))
    return stats.intervals(marks, ["log"], "t0", ["t0", "event_id"], ["event_id"]).select("event_id", "t0", F.col("to").alias("t1"))


@query(
    "WITH m AS (SELECT user_id, ts AS t0, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t1 FROM events WHERE event_type = 'signup')"
    " SELECT m.user_id, epoch_us(t0) AS t0, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS work, arg_max(event_id, value * 1000000 + event_id) AS biggest"
    " FROM m JOIN events e ON e.user_id = m.user_id AND e.ts >= t0 AND (t1 IS NULL OR e.ts < t1) GROUP BY ALL"
)
def phase_metrics(spark, sf):
    events = table(spark, sf, "events").withColumn("t", micros("ts"))
    marks = events.where("event_type = 'signup'")
    spans = stats.intervals(marks, ["user_id"], "t", ["t", "event_id"]).select("user_id", F.col("t").alias("t0"), F.col("to").alias("t1"))
    held = stats.interval_of(events.select("user_id", "event_id", "value", "t"), spans, ["user_id"], "t", "t0", "t1", [])
    return held.groupBy("user_id", "t0").agg(
        F.count("*").alias("n"), stats.exact_sum(F.col("value")).alias("work"), F.max_by("event_id", F.col("value") * 1000000 + F.col("event_id")).alias("biggest")
    )


@query(
    "WITH w AS (SELECT min(ts) AS a, max(ts) AS b FROM events WHERE event_type = 'purchase'), c AS (SELECT count(*) AS markers,"
    " count(*) FILTER (ts BETWEEN a - INTERVAL 600 SECOND AND b + INTERVAL 600 SECOND) AS inside FROM events, w WHERE event_type = 'signup')"
    " SELECT markers, inside, CASE WHEN markers = 0 THEN 'not verifiable' WHEN inside > 0 THEN 'ok' ELSE 'divergent' END AS coherence FROM c"
)
def coherence(spark, sf):
    events = table(spark, sf, "events")
    window = events.where("event_type = 'purchase'").agg(micros_min("ts").alias("a"), micros_max("ts").alias("b"))
    near = micros("ts").between(F.col("a") - 600_000_000, F.col("b") + 600_000_000)
    out = events.where("event_type = 'signup'").crossJoin(F.broadcast(window)).agg(F.count("*").alias("markers"), F.count_if(near).alias("inside"))
    return out.withColumn("coherence", etl.rule_case([(F.col("markers") == 0, "not verifiable"), (F.col("inside") > 0, "ok")], "divergent"))


@query(
    """
WITH RECURSIVE e AS (
  SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r,
    CASE event_type WHEN 'view' THEN floor(value / 20)::BIGINT WHEN 'click' THEN floor(value / 20)::BIGINT END AS size
  FROM events WHERE event_type IN ('view', 'click')),
q AS (
  SELECT user_id, 0::BIGINT AS r, []::STRUCT(s BIGINT, z BIGINT)[] AS waiting, NULL::BIGINT AS open_seq, NULL::BIGINT AS close_seq FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT user_id, r, CASE
      WHEN event_type = 'view' THEN list_append(waiting, {'s': event_id, 'z': size})
      WHEN hit > 0 THEN CASE WHEN len(waiting) > 7 THEN list_concat(waiting[1:hit - 1], waiting[hit + 1:])[2:] ELSE list_concat(waiting[1:hit - 1], waiting[hit + 1:]) END
      WHEN len(waiting) > 6 THEN waiting[2:] ELSE waiting END,
    CASE WHEN event_type = 'click' AND hit > 0 THEN waiting[hit].s END, CASE WHEN event_type = 'click' AND hit > 0 THEN event_id END
  FROM (SELECT q.user_id, e.r, q.waiting, e.event_type, e.event_id, e.size, coalesce(list_position(list_transform(q.waiting, lambda x: x.z), e.size), 0) AS hit
    FROM q JOIN e ON e.user_id = q.user_id AND e.r = q.r + 1))
SELECT user_id, open_seq, close_seq FROM q WHERE open_seq IS NOT NULL"""
)
def scan_stage_match(spark, sf):
    events = table(spark, sf, "events").withColumn("size", F.floor(F.col("value") / 20))
    kind = F.when(F.col("event_type") == "view", "open").when(F.col("event_type") == "click", "close")
    return stats.queue_join(events, ["user_id"], kind, "event_id", "size")


CHECKS = """
WITH c AS (SELECT
    (SELECT count(*) FROM orders) AS started, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS finished,
    (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS failed, (SELECT count(*) FROM lineitem) AS tasks,
    (SELECT count(*) FROM lineitem WHERE l_linestatus = 'F') AS ended, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS seen)
SELECT code, severity, expected, observed FROM (
  SELECT CASE WHEN started > finished + failed THEN 'JOBS_WITHOUT_END' WHEN started < finished + failed THEN 'JOBS_WITHOUT_START' END AS code,
    CASE WHEN started > finished + failed THEN 'warning' ELSE 'error' END AS severity, started AS expected, finished + failed AS observed FROM c
  UNION ALL SELECT CASE WHEN tasks > ended THEN 'TASKS_WITHOUT_END' WHEN tasks < ended THEN 'TASKS_WITHOUT_START' END,
    CASE WHEN tasks > ended THEN 'warning' ELSE 'error' END, tasks, ended FROM c
  UNION ALL SELECT CASE WHEN seen <> started THEN 'SUBMISSIONS_NOT_RECOGNISED' END, 'error', started, seen FROM c) WHERE code IS NOT NULL"""


@query(CHECKS)
def consistency_alerts(spark, sf):
    from plumbline.operators.checks import balance, difference, reconciled

    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    jobs = orders.agg(F.count("*").alias("started"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_orderstatus") == "P").alias("failed"))
    tasks = lines.agg(F.count("*").alias("tasks"), F.count_if(F.col("l_linestatus") == "F").alias("ended"), F.countDistinct("l_orderkey").alias("seen"))
    counts = jobs.crossJoin(tasks)  # a row each
    return reconciled(
        counts,
        [
            balance(F.col("started"), F.col("finished") + F.col("failed"), "JOBS_WITHOUT_END", "JOBS_WITHOUT_START"),
            balance(F.col("tasks"), F.col("ended"), "TASKS_WITHOUT_END", "TASKS_WITHOUT_START"),
            difference(F.col("started"), F.col("seen"), "SUBMISSIONS_NOT_RECOGNISED", "error"),
        ],
    ).select("code", "severity", "expected", "observed")


@query(
    "WITH d AS (SELECT c_mktsegment, count(*) FILTER (c_acctbal < 0) AS lost, count(*) FILTER (c_acctbal < -500) AS failed, count(*) FILTER (c_acctbal > 9000) // 10 AS retries"
    " FROM customer GROUP BY 1), p AS (SELECT *, least(5 * lost, 20) AS p_lost, least(5 * failed, 20) AS p_failed, least(retries, 10) AS p_retries FROM d)"
    " SELECT c_mktsegment, greatest(0, 100 - p_lost - p_failed - p_retries)::BIGINT AS score, CASE WHEN greatest(0, 100 - p_lost - p_failed - p_retries) >= 80 THEN 'good'"
    " WHEN greatest(0, 100 - p_lost - p_failed - p_retries) >= 50 THEN 'attention' ELSE 'critical' END AS band FROM p"
)
def quality_score(spark, sf):
    from plumbline.operators.score import band, capped

    b = F.col("c_acctbal")
    d = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count_if(b < 0).alias("lost"), F.count_if(b < -500).alias("failed"), F.count_if(b > 9000).alias("retries"))
    score = F.greatest(F.lit(0), 100 - capped(5 * F.col("lost"), 20) - capped(5 * F.col("failed"), 20) - capped(F.floor(F.col("retries") / 10), 10)).cast("long")
    return d.select("c_mktsegment", score.alias("score")).withColumn("band", band(F.col("score")))


@query(
    f"WITH s AS ({STAGE_STATS}), f AS (SELECT 'skew_task' AS rule, 'MEDIUM' AS severity, l_suppkey AS subject, skew AS measure FROM s WHERE skew >= 1.9 AND n >= 8"
    " UNION ALL SELECT 'exploded_stage', 'HIGH', l_suppkey, n::DOUBLE FROM s WHERE n >= 600 UNION ALL SELECT 'repeated_action', 'LOW', o_custkey, count(*)::DOUBLE"
    " FROM orders GROUP BY o_custkey HAVING count(*) >= 18) SELECT rule, severity, subject, measure, row_number() OVER (ORDER BY CASE severity WHEN 'HIGH' THEN 0 WHEN"
    " 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 3 END, rule, subject) AS rank FROM f"
)
def findings_union(spark, sf):
    from plumbline.operators.findings import ranked

    s = stage_stats(spark, sf)
    row = lambda rule, severity, subject, measure: [F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col(subject).alias("subject"), F.col(measure).cast("double").alias("measure")]
    n = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 18")
    parts = [
        s.where("skew >= 1.9 AND n >= 8").select(*row("skew_task", "MEDIUM", "l_suppkey", "skew")),
        s.where("n >= 600").select(*row("exploded_stage", "HIGH", "l_suppkey", "n")),
        n.select(*row("repeated_action", "LOW", "o_custkey", "n")),
    ]
    return ranked(parts, ["rule", "subject"]).withColumn("rank", F.col("rank").cast("long"))


@query(
    "WITH n AS (SELECT c_nationkey, count(*) FILTER (c_acctbal < -900) AS errors, count(*) FILTER (c_acctbal > 9900) AS failures, count(*) FILTER (c_acctbal > 9000) AS findings"
    " FROM customer GROUP BY 1) SELECT c_nationkey, CASE WHEN errors > 1 THEN 'inconclusive' WHEN failures > 0 THEN 'failed' WHEN findings > 4 THEN 'degraded' ELSE 'healthy' END AS class FROM n"
)
def expected_class(spark, sf):
    from plumbline.operators.evidence import expected_class as ladder

    b = F.col("c_acctbal")
    n = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count_if(b < -900).alias("e"), F.count_if(b > 9900).alias("f"), F.count_if(b > 9000).alias("d"))
    return n.select("c_nationkey", ladder(F.col("e") > 1, F.col("f") > 0, F.col("d") > 4).alias("class"))
