"""Reconciliation of counts: what one source of a figure says must agree with another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import config
from plumbline.operators.runs import field, of_type, stage_order

SEVERITY = ("error", "warning", "info")


def alert(condition: Column, code: str, severity: str, expected: Column | None = None, observed: Column | None = None, message: str = "") -> Column:
    """An alert, or null if the condition doesn't hold."""
    null = F.lit(None).cast("long")
    return F.when(
        condition,
        F.struct(
            F.lit(code).alias("code"), F.lit(severity).alias("severity"), (null if expected is None else expected.cast("long")).alias("expected"),
            (null if observed is None else observed.cast("long")).alias("observed"), F.lit(message).alias("message"),
        ),
    )


def balance(begun: Column, ended: Column, open_code: str, extra_code: str) -> Column:
    """More begun than ended is a warning, more ended than begun an error."""
    return F.coalesce(alert(begun > ended, open_code, "warning", begun, ended, "begun without an end"), alert(begun < ended, extra_code, "error", begun, ended, "ended without a beginning"))


def difference(expected: Column, observed: Column, code: str, severity: str, message: str = "two counts of one thing differ") -> Column:
    return alert(expected != observed, code, severity, expected, observed, message)


def reconciled(counts: DataFrame, alerts: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """Alerts of rows of counts, as rows."""
    held = counts.select(*keys, F.explode(F.filter(F.array(*alerts), lambda a: a.isNotNull())).alias("_a"))
    return held.select(*keys, "_a.*")


def consistency(events: DataFrame, reading: DataFrame, attempts: DataFrame, spans: DataFrame, t: config.Thresholds = config.Thresholds()) -> DataFrame:
    """(log_id, code, severity, expected, observed, message) of the checks of each log that failed."""
    kinds = {
        "job_start": "js", "job_end_marker": "je", "job_failed": "jx", "job_finish": "jf", "stage_submit": "ss", "stage_finish": "sf", "stage_failed": "sx",
        "stage_tasks_submitted": "st", "task_start": "ts", "task_finish": "tf", "task_failed": "tx", "app_final_status": "end",
    }
    counts = events.groupBy(F.col("log_id").alias("_l")).agg(*(F.count_if(F.col("event_type") == k).alias(v) for k, v in kinds.items()))
    longest = attempts.join(spans.select("log_id", F.col("duration_s").alias("_total")), "log_id").where(F.col("duration_s") > F.col("_total") + t.duration_slack_s)
    keys = lambda df, out: df.groupBy(F.col("log_id").alias("_l")).agg(F.count("*").alias(out), F.slice(F.transform(F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(stage_order())], "stage_key"))), lambda x: x["stage_key"]), 1, 10).alias(f"{out}_keys"))
    per_log = attempts.groupBy(F.col("log_id").alias("_l")).agg(F.sum("num_tasks").alias("tasks_done"), F.sum("num_failed").alias("tasks_failed"), F.count_if(F.col("status") == "failed").alias("attempts_failed"))
    held = reading.select("log_id", "lines", "header_lines")
    for other in (counts, per_log, keys(longest, "too_long"), keys(attempts.where("origin IS NULL"), "no_origin")):
        held = held.join(other, F.col("log_id") == F.col("_l"), "left").drop("_l")
    held = held.join(spans.select("log_id", "duration_s"), "log_id", "left").fillna(0, [*kinds.values(), "tasks_done", "tasks_failed", "attempts_failed", "too_long", "no_origin"])
    c = F.col
    out = reconciled(
        held,
        [
            F.coalesce(alert(c("lines") == 0, "EMPTY_LOG", "error"), alert(c("header_lines") / c("lines") < t.header_share, "UNEXPECTED_FORMAT", "error", c("lines"), c("header_lines"), "few lines have a header")),
            alert(c("duration_s").isNull(), "NO_DURATION", "error", message="no time could be read"),
            alert(c("end") == 0, "NO_FINAL_STATUS", "warning", message="the log has no final status"),
            balance(c("js"), c("je") + c("jx"), "JOBS_WITHOUT_END", "JOBS_WITHOUT_START"),
            alert(c("je") - c("jf") - c("jx") > 0, "JOBS_WITHOUT_DURATION", "info", c("je"), c("jf") + c("jx")),
            balance(c("ss"), c("sf") + c("sx"), "STAGES_WITHOUT_END", "STAGES_WITHOUT_START"),
            difference(c("ss"), c("st"), "SUBMISSIONS_NOT_RECOGNISED", "error"),
            difference(c("sx"), c("attempts_failed"), "STAGE_FAILURES_DIFFER", "error"),
            alert(c("too_long") > 0, "STAGE_LONGER_THAN_RUN", "error", F.lit(0), c("too_long")),
            alert(c("no_origin") > 0, "STAGES_WITHOUT_ORIGIN", "warning", F.lit(0), c("no_origin")),
            balance(c("ts"), c("tf") + c("tx"), "TASKS_WITHOUT_END", "TASKS_WITHOUT_START"),
            difference(c("tf"), c("tasks_done"), "TASKS_OUTSIDE_STAGES", "error"),
            difference(c("tx"), c("tasks_failed"), "TASK_FAILURES_OUTSIDE_STAGES", "error"),
        ],
        ["log_id"],
    )
    msg, kind = field("msg"), None
    for prefix, name in config.KNOWN_PREFIXES:
        kind = F.when(msg.startswith(prefix), name) if kind is None else kind.when(msg.startswith(prefix), name)
    unread = of_type(events, config.UNMATCHED).withColumn("_kind", kind).where("_kind IS NOT NULL").groupBy("log_id", "_kind").agg(F.count("*").alias("n"))
    unread = unread.select("log_id", F.lit("KNOWN_EVENT_NOT_RECOGNISED").alias("code"), F.lit("error").alias("severity"), F.lit(0).cast("long").alias("expected"), F.col("n").alias("observed"), F.col("_kind").alias("message"))
    return out.unionByName(unread)


def verdict(alerts: DataFrame, logs: DataFrame) -> DataFrame:
    """(log_id, ok, errors, warnings, infos) for each log."""
    n = alerts.groupBy("log_id").agg(*(F.count_if(F.col("severity") == s).alias(f"{s}s") for s in SEVERITY))
    out = logs.select("log_id").distinct().join(n, "log_id", "left").fillna(0, [f"{s}s" for s in SEVERITY])
    return out.withColumn("ok", F.col("errors") == 0)
