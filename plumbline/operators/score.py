"""A score from 0 to 100: what is deducted for failures, losses, retries and findings, each up to a cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import config
from plumbline.operators.runs import field, of_type


def capped(points: Column, most: int) -> Column:
    return F.least(points, F.lit(most))


def band(score: Column, w: config.Weights = config.Weights()) -> Column:
    return F.when(score >= w.good, "good").when(score >= w.attention, "attention").when(score.isNotNull(), "critical")


def deductions(events: DataFrame, attempts: DataFrame, found: DataFrame, context: DataFrame, w: config.Weights = config.Weights()) -> DataFrame:
    """(log_id, criterion, points, capped) of what is deducted; what costs nothing isn't listed."""
    weight = F.create_map(*[x for s, n in w.findings for x in (F.lit(s), F.lit(n))])[F.col("severity")]
    each = found.groupBy("log_id", "rule").agg(F.max(weight).alias("_w")).groupBy(F.col("log_id").alias("_l")).agg(F.sum("_w").alias("findings"))
    lost = of_type(events, "executor_lost", "stage_failed").groupBy(F.col("log_id").alias("_l")).agg(F.count_if(F.col("event_type") == "executor_lost").alias("lost"), F.count_if(F.col("event_type") == "stage_failed").alias("failed"))
    retries = attempts.groupBy(F.col("log_id").alias("_l")).agg(F.sum("task_retries").alias("retries"))
    held = context.select("log_id", "exit_code")
    for other in (each, lost, retries):
        held = held.join(other, F.col("log_id") == F.col("_l"), "left").drop("_l")
    held = held.fillna(0, ["findings", "lost", "failed", "retries"])
    rows = [
        ("unsuccessful_run", F.when(F.coalesce("exit_code", F.lit("")) != "0", w.unsuccessful).otherwise(0), None),
        ("lost_executors", w.lost_executor * F.col("lost"), w.lost_executors_cap),
        ("stage_failures", w.stage_failure * F.col("failed"), w.stage_failures_cap),
        ("task_retries", F.floor(F.col("retries") / w.retries_per_point), w.retries_cap),
        ("findings", F.col("findings"), w.findings_cap),
    ]
    parts = [
        F.struct(F.lit(n).alias("criterion"), (p if cap is None else capped(p, cap)).cast("long").alias("points"), (F.lit(False) if cap is None else p > cap).alias("capped")) for n, p, cap in rows
    ]
    return held.select("log_id", F.explode(F.array(*parts)).alias("_d")).select("log_id", "_d.*").where("points > 0")


def scores(costs: DataFrame, verdicts: DataFrame, w: config.Weights = config.Weights()) -> DataFrame:
    """(log_id, score, band): none for a log whose counts don't agree."""
    out = verdicts.join(costs.groupBy("log_id").agg(F.sum("points").alias("_p")), "log_id", "left")
    score = F.when(F.col("ok"), F.greatest(F.lit(0), 100 - F.coalesce("_p", F.lit(0))).cast("long"))
    return out.select("log_id", score.alias("score")).withColumn("band", band(F.col("score"), w))


def statuses(events: DataFrame) -> DataFrame:
    return of_type(events, "app_final_status").select("log_id", "seq", "ts", field("exit_code").alias("exit_code"))
