"""Queries of the log engine. Their logs are written from the tables, so that the whole way from lines of text to stage
statistics can be held against SQL over the tables; their plans are those of this session."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.catalog.base import Registry, table
from plumbline.operators import checks, findings, records, runs, score
from plumbline.plans import explain, signals
from plumbline.sources.sinks import stored

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


def log_of_lines(spark, sf, takes: str = "l_quantity * 100") -> DataFrame:
    """A log for each return flag and status, in which each line of an order is a task that starts and ends: its supplier
    is the stage, its number the executor, and a hundred times its quantity, or what else is said, the milliseconds it takes."""
    held = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    log = F.concat("l_returnflag", "l_linestatus")
    # tasks are numbered by stage, so that no log goes through one task
    n = F.row_number().over(W.partitionBy("l_returnflag", "l_linestatus", "l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"))
    held = held.withColumn("_n", n - 1).withColumn("_tid", F.col("l_suppkey") * 10_000_000 + F.col("_n"))
    who = F.format_string("task %d.0 in stage %d.0 (TID %d)", "_n", "l_suppkey", "_tid")
    head = F.lit("24/01/01 10:00:00 INFO TaskSetManager: ")
    start = F.concat(head, F.lit("Starting "), who, F.format_string(" (10.0.0.%d, executor %d, partition %d, PROCESS_LOCAL, 9771 bytes)", "l_linenumber", "l_linenumber", "_n"))
    ms = F.round(F.expr(takes)).cast("long")
    end = F.concat(head, F.lit("Finished "), who, F.format_string(" in %d ms on 10.0.0.%d (executor %d) (1/8)", ms, F.col("l_linenumber"), F.col("l_linenumber")))
    both = held.select(log.alias("log_id"), "_tid", F.posexplode(F.array(start, end)).alias("_half", "value"))
    return both.select("log_id", (F.col("_tid") * 2 + F.col("_half")).alias("line_no"), "value")


@query(
    "SELECT l_returnflag || l_linestatus AS log_id, e AS event_type, count(*) AS n FROM lineitem, (VALUES ('task_start'), ('task_finish')) AS v(e) GROUP BY ALL"
)
def log_event_counts(spark, sf):
    events, _ = records.parsed(log_of_lines(spark, sf))
    return runs.event_counts(events).select("log_id", "event_type", "n")


@query(
    "WITH t AS (SELECT l_returnflag || l_linestatus AS log_id, l_suppkey::VARCHAR AS stage_id, round(l_quantity * 100)::BIGINT AS d FROM lineitem)"
    " SELECT log_id, stage_id, count(*) AS num_tasks, min(d) AS min_ms, max(d) AS max_ms, median(d) AS median_ms, quantile_disc(d, 0.95) AS p95_ms, sum(d)::BIGINT AS total_ms,"
    " CASE WHEN median(d) > 0 THEN round(max(d) / median(d), 2) END AS skew_ratio, 0::BIGINT AS num_failed, 'unknown' AS status FROM t GROUP BY ALL"
)
def log_stage_attempts(spark, sf):
    events = stored(records.parsed(log_of_lines(spark, sf))[0], "events")
    out = runs.stage_attempts(events)
    return out.select("log_id", "stage_id", "num_tasks", "min_ms", "max_ms", "median_ms", "p95_ms", "total_ms", "skew_ratio", "num_failed", "status")


@query(
    "SELECT l_returnflag || l_linestatus AS log_id, count(*) * 2 AS lines, count(*) * 2 AS header_lines, 0::BIGINT AS stack_lines, 0::BIGINT AS stray_lines FROM lineitem GROUP BY 1"
)
def log_read_statistics(spark, sf):
    return records.parsed(log_of_lines(spark, sf))[1].select("log_id", "lines", "header_lines", "stack_lines", "stray_lines")


def log_of_orders(spark, sf) -> DataFrame:
    """A log for each status, in which each order is a job started by a line of a script, by its customer. Every 11th job has no
    end, every 13th of the others no duration, and urgent ones leave a warning that reads like an event but is none."""
    held = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", (F.col("o_custkey") % 20).cast("int").alias("site"), (F.col("o_orderkey") % 4 + 1).alias("parts"))
    head = lambda level, who: F.lit(f"24/01/01 10:00:00 {level} {who}: ")
    site = F.format_string("count at jobs.py:%d", "site")
    ended = F.col("o_orderkey") % 11 != 0
    lines = [
        (F.lit(True), F.concat(head("INFO", "DAGScheduler"), F.lit("Got job "), "o_orderkey", F.lit(" ("), site, F.lit(") with "), "parts", F.lit(" output partitions"))),
        (ended, F.concat(head("INFO", "DAGScheduler"), F.lit("Job "), "o_orderkey", F.lit(" is finished. Cancelling potential speculative or zombie tasks for this job"))),
        (ended & (F.col("o_orderkey") % 13 != 0), F.concat(head("INFO", "DAGScheduler"), F.lit("Job "), "o_orderkey", F.lit(" finished: "), site, F.lit(", took "), F.format_string("%.2f", F.col("parts") / 4), F.lit(" s"))),
        (F.col("o_orderpriority") == "1-URGENT", F.concat(head("WARN", "TaskSetManager"), F.lit("Lost task of order "), "o_orderkey")),
    ]
    each = F.filter(F.array(*(F.when(c, x) for c, x in lines)), lambda x: x.isNotNull())
    both = held.select(F.col("o_orderstatus").alias("log_id"), "o_orderkey", F.posexplode(each).alias("_n", "value"))
    return both.select("log_id", (F.col("o_orderkey") * 4 + F.col("_n")).alias("line_no"), "value")


@query(
    "WITH j AS (SELECT *, (o_custkey % 20)::INT AS site, o_orderkey % 4 + 1 AS parts, o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AS timed FROM orders)"
    " SELECT o_orderstatus AS log_id, 'count at jobs.py:' || site AS action, site AS line, count(*) AS num_jobs, round(coalesce(sum(CASE WHEN timed THEN parts / 4 END), 0), 2)::DOUBLE AS total_s,"
    " sum(parts)::BIGINT AS output_partitions, min(o_orderkey)::VARCHAR AS first_job FROM j GROUP BY ALL"
)
def log_call_sites(spark, sf):
    sites = runs.call_sites(records.parsed(log_of_orders(spark, sf))[0])
    return sites.select("log_id", "action", F.col("call_site.line").alias("line"), "num_jobs", "total_s", "output_partitions", F.col("job_ids")[0].alias("first_job"))


def checked(spark, sf):
    """(events, reading, attempts, durations, alerts) of the orders' log."""
    events, reading = (stored(x, "orders-log") for x in records.parsed(log_of_orders(spark, sf)))
    attempts, spans = runs.stage_attempts(events), runs.duration(events)
    return events, reading, attempts, spans, checks.consistency(events, reading, attempts, spans)


@query(
    "WITH c AS (SELECT o_orderstatus AS log_id, count(*) AS js, count(*) FILTER (o_orderkey % 11 <> 0) AS je, count(*) FILTER (o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0) AS jf,"
    " count(*) FILTER (o_orderpriority = '1-URGENT') AS w FROM orders GROUP BY 1), a AS ("
    " SELECT log_id, 'NO_FINAL_STATUS' AS code, 'warning' AS severity, NULL::BIGINT AS expected, NULL::BIGINT AS observed FROM c"
    " UNION ALL SELECT log_id, 'JOBS_WITHOUT_END', 'warning', js, je FROM c WHERE js > je"
    " UNION ALL SELECT log_id, 'JOBS_WITHOUT_DURATION', 'info', je, jf FROM c WHERE je > jf"
    " UNION ALL SELECT log_id, 'KNOWN_EVENT_NOT_RECOGNISED', 'error', 0, w FROM c WHERE w > 0) SELECT * FROM a"
)
def log_alerts(spark, sf):
    return checked(spark, sf)[-1].select("log_id", "code", "severity", "expected", "observed")


@query(
    "SELECT o_orderstatus AS log_id, count(*) FILTER (o_orderpriority = '1-URGENT') = 0 AS ok, (count(*) FILTER (o_orderpriority = '1-URGENT') > 0)::BIGINT AS errors,"
    " 1 + (count(*) FILTER (o_orderkey % 11 = 0) > 0)::BIGINT AS warnings, (count(*) FILTER (o_orderkey % 11 <> 0 AND o_orderkey % 13 = 0) > 0)::BIGINT AS infos FROM orders GROUP BY 1"
)
def log_verdicts(spark, sf):
    _, reading, _, _, alerts = checked(spark, sf)
    return checks.verdict(alerts, reading).select("log_id", "ok", "errors", "warnings", "infos")


_SKEWED = (
    "WITH s AS (SELECT l_returnflag || l_linestatus AS log_id, l_suppkey, count(*) AS n, median(round(l_extendedprice)::BIGINT) AS mid, max(round(l_extendedprice)::BIGINT) AS most FROM lineitem GROUP BY ALL),"
    " f AS (SELECT log_id, l_suppkey, round(most / mid, 2) AS ratio, n FROM s WHERE mid > 0 AND round(most / mid, 2) >= 3.0 AND n >= 8 AND most >= 5000)"
)


def found(spark, sf):
    """(events, attempts, context, findings) of the lines' log, where a task takes as long as its line costs."""
    events, _ = records.parsed(log_of_lines(spark, sf, "l_extendedprice"))
    events = stored(events, "lines-log")
    attempts = stored(runs.stage_attempts(events), "lines-attempts")
    capacity = runs.capacity(events, attempts, runs.duration(events))
    return events, attempts, runs.context(events), findings.findings(events, attempts, runs.call_sites(events), capacity)


@query(
    _SKEWED + " SELECT log_id, 'skew_task' AS rule, 'MEDIUM' AS severity, l_suppkey || '.0' AS stage_key, row_number() OVER (PARTITION BY log_id ORDER BY l_suppkey)::INT AS rank,"
    " ratio AS skew_ratio, n AS num_tasks FROM f"
)
def log_findings(spark, sf):
    out = found(spark, sf)[-1]
    return out.select("log_id", "rule", "severity", "stage_key", "rank", F.col("evidence")["skew_ratio"].cast("double").alias("skew_ratio"), F.col("evidence")["num_tasks"].cast("long").alias("num_tasks"))


@query(
    _SKEWED + ", p AS (SELECT DISTINCT l_returnflag || l_linestatus AS log_id FROM lineitem) SELECT log_id, 40 AS unsuccessful, CASE WHEN log_id IN (SELECT log_id FROM f) THEN 5 ELSE 0 END AS by_findings,"
    " 60 - CASE WHEN log_id IN (SELECT log_id FROM f) THEN 5 ELSE 0 END AS score, 'attention' AS band FROM p"
)
def log_scores(spark, sf):
    events, attempts, context, rows = found(spark, sf)
    costs = score.deductions(events, attempts, rows, context)
    reading = events.select("log_id").distinct()
    verdicts = checks.verdict(checks.consistency(events, reading.withColumns({"lines": F.lit(2), "header_lines": F.lit(2)}), attempts, runs.duration(events)), reading)
    points = lambda name: F.coalesce(F.sum(F.when(F.col("criterion") == name, F.col("points"))), F.lit(0))
    by = costs.groupBy("log_id").agg(points("unsuccessful_run").cast("int").alias("unsuccessful"), points("findings").cast("int").alias("by_findings"))
    return score.scores(costs, verdicts).join(by, "log_id").select("log_id", "unsuccessful", "by_findings", F.col("score").cast("int").alias("score"), "band")


def printed_plan(df: DataFrame) -> str:
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        df.explain(True)
    return said.getvalue()


def plans(spark, sf) -> DataFrame:
    """Output of three queries with explain() text."""
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    joined = lines.hint("merge").join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    twice = lines.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q")).join(lines.groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("a"), F.countDistinct("l_orderkey").alias("b")), "l_suppkey")
    window = orders.withColumn("n", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))).where("n = 1")
    text = "".join(f"2024-01-01 10:00:0{i},000 - INFO - step {i}\n{printed_plan(df)}\n" for i, df in enumerate((joined, twice, window)))
    return spark.createDataFrame([("session", text)], "source string, text string")


@query()
def plan_operators(spark, sf):
    return explain.histogram(explain.plan_nodes(plans(spark, sf)))


@query()
def plan_signals(spark, sf):
    out = signals.signals(explain.plan_nodes(plans(spark, sf)))
    return out.select("source", "plan_no", "id", "rule", "subject", "n", "nodes", "names")
