"""Tables of a run, from its events: tasks, stage attempts, jobs, call sites, capacity, duration, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline import config
from plumbline.functions.text import split_id
from plumbline.operators import stats

LOG = ["log_id"]


def of_type(events: DataFrame, *kinds: str) -> DataFrame:
    return events.where(F.col("event_type").isin(*kinds))


def field(name: str, kind: str = "string") -> Column:
    value = F.col("data")[name]
    return value if kind == "string" else value.try_cast(kind)


def origins(events: DataFrame) -> DataFrame:
    """(log_id, stage_id, origin): the job that was last started before the stage's first submission, in log order."""
    job = F.struct(
        field("job_id").alias("job_id"), F.when(F.col("event_type") == "map_stage_job_start", "map_stage").otherwise("job").alias("job_kind"), field("action").alias("action"), "call_site"
    )
    started = F.when(F.col("event_type").isin("job_start", "map_stage_job_start"), job)
    held = of_type(events, "job_start", "map_stage_job_start", "stage_submit")
    held = stats.asof_last(held, LOG, ["seq"], {"origin": started}).where("event_type = 'stage_submit' AND origin IS NOT NULL")
    return held.groupBy("log_id", field("stage_id").alias("stage_id")).agg(F.min_by("origin", "seq").alias("origin"))


def tasks(events: DataFrame) -> DataFrame:
    """One row for each task id: starts and ends overwrite each other in log order, a failure fills what is missing."""
    held = of_type(events, "task_start", "task_finish", "task_failed")
    usual, failed = F.col("event_type") != "task_failed", F.col("event_type") == "task_failed"

    def last(name: str) -> Column:
        """The last value of a start or end, else the first of a failure."""
        own, other = F.when(usual, field(name)), F.when(failed, field(name))
        return F.coalesce(F.max_by(own, F.when(own.isNotNull(), F.col("seq"))), F.min_by(other, F.when(other.isNotNull(), F.col("seq")))).alias(name)

    reason = field("reason")
    return held.groupBy("log_id", field("tid").alias("tid")).agg(
        *(last(n) for n in ("task_id", "stage_id", "executor")),
        *(F.max_by(F.when(usual, field(n)), F.when(usual & field(n).isNotNull(), F.col("seq"))).alias(n) for n in ("partition", "host", "duration_ms")),
        F.bool_or(failed).alias("failed"),
        F.max_by(reason, F.when(failed, F.col("seq"))).alias("failure_reason"),
    ).withColumn("duration_ms", F.col("duration_ms").try_cast("long"))


def attempt_facts(events: DataFrame, attempts: DataFrame) -> DataFrame:
    """What the scheduler's lines, which name no attempt, say of each attempt: the k-th submission and the k-th failure of
    a stage belong to its k-th attempt, its end to the last one."""
    keys = ["log_id", "stage_id"]
    pos = stats.numbered(attempts, keys, ["stage_attempt"], "pos")
    pos = pos.withColumn("_last", F.col("pos") == F.count("*").over(W.partitionBy(*keys)))
    nth = lambda kind, columns: stats.numbered(of_type(events, kind).select("log_id", field("stage_id").alias("stage_id"), "seq", *columns), keys, ["seq"], "pos").drop("seq")
    subs = nth("stage_tasks_submitted", [field("num_tasks", "long").alias("submitted_tasks"), field("rdd_desc").alias("rdd_desc"), field("stage").alias("_sub_kind")])
    fails = nth("stage_failed", [field("duration_s", "double").alias("_fail_s"), field("stage").alias("_fail_kind"), field("reason").alias("stage_failure_reason"), F.lit(True).alias("_failed")])
    ends = of_type(events, "stage_finish").groupBy("log_id", field("stage_id").alias("stage_id")).agg(F.max_by(field("duration_s", "double"), "seq").alias("_end_s"), F.lit(True).alias("_ended"))
    gone = of_type(events, "taskset_removed").select("log_id", field("stage_id").alias("stage_id"), field("attempt", "int").alias("stage_attempt"), F.lit(True).alias("_gone")).distinct()
    out = pos.join(subs, [*keys, "pos"], "left").join(fails, [*keys, "pos"], "left").join(ends, keys, "left").join(gone, [*keys, "stage_attempt"], "left")
    failed, ended, removed = (F.coalesce(F.col(c), F.lit(False)) for c in ("_failed", "_ended", "_gone"))
    ended = ended & F.col("_last")
    return out.select(
        "log_id",
        "stage_id",
        "stage_attempt",
        "submitted_tasks",
        "rdd_desc",
        F.coalesce("_sub_kind", "_fail_kind").alias("stage_kind"),
        F.when(failed, F.col("_fail_s")).when(ended, F.col("_end_s")).alias("duration_s"),
        F.when(failed & F.col("_fail_s").isNotNull(), "stage_failed")
        .when(failed, "stage_failed (no duration)")
        .when(ended, "stage_finish")
        .when(removed, "taskset_removed (no exact duration)")
        .alias("duration_source"),
        F.when(failed, "failed").when(ended | removed, "finished").otherwise("unknown").alias("status"),
        "stage_failure_reason",
    )


def stage_attempts(events: DataFrame) -> DataFrame:
    """One row for each attempt of a stage that has tasks."""
    stage, attempt = split_id(F.col("stage_id"))
    held = tasks(events).where("stage_id IS NOT NULL").withColumns({"_s": stage, "stage_attempt": attempt})
    held = held.drop("stage_id").withColumnRenamed("_s", "stage_id")
    keys = ["log_id", "stage_id", "stage_attempt"]
    done = F.col("duration_ms").isNotNull()
    suffix = split_id(F.col("task_id"))[1]
    out = held.groupBy(*keys).agg(
        F.count_if(done).alias("num_tasks"),
        F.count_if("failed").alias("num_failed"),
        F.count_if(F.col("task_id").isNotNull() & (suffix > 0)).alias("retries_same_attempt"),
        F.count("partition").alias("_partitions"),
        F.min("duration_ms").alias("min_ms"),
        F.max("duration_ms").alias("max_ms"),
        F.round(F.avg("duration_ms"), 1).alias("mean_ms"),
        F.median("duration_ms").alias("median_ms"),
        stats.nearest_rank("duration_ms", 0.95).cast("long").alias("p95_ms"),
        F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("total_ms"),
    )
    out = out.withColumn("skew_ratio", stats.skew(F.col("max_ms"), F.col("median_ms")))
    # partitions that an earlier attempt of the stage had too
    first = W.partitionBy("log_id", "stage_id", "partition").orderBy("stage_attempt")
    again = held.where("partition IS NOT NULL").select(*keys, "partition").distinct()
    again = again.withColumn("_seen", F.row_number().over(first) > 1).groupBy(*keys).agg(F.count_if("_seen").alias("_again"))
    reasons = held.where("failed").groupBy(*keys, F.coalesce("failure_reason", F.lit("?")).alias("r")).agg(F.count("*").alias("n"))
    reasons = reasons.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("r", "n")))).alias("failures_by_reason"))
    by_executor = held.where(done).groupBy(*keys, F.coalesce("executor", F.lit("?")).alias("e")).agg(F.count("*").alias("n"), F.round(F.avg("duration_ms"), 1).alias("mean"), F.sum("duration_ms").alias("total"))
    by_executor = by_executor.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("e", "n")))).alias("tasks_per_executor"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("e", F.struct("mean", "total").alias("d"))))).alias("executor_duration_ms"),
    )
    out = out.join(again, keys, "left").join(reasons, keys, "left").join(by_executor, keys, "left")
    out = out.join(attempt_facts(events, out.select(*keys)), keys, "left").join(origins(events), ["log_id", "stage_id"], "left")
    reexecuted = F.when(F.col("stage_attempt") == 0, 0).when(F.col("_partitions") > 0, F.coalesce("_again", F.lit(0)))
    out = out.withColumns(
        {
            "stage_key": F.concat_ws(".", F.col("stage_id"), F.col("stage_attempt").cast("string")),
            "attempts_of_stage": F.count("*").over(W.partitionBy("log_id", "stage_id")),
            "tasks_reexecuted": reexecuted,
            "task_retries": F.col("retries_same_attempt") + F.coalesce(reexecuted, F.lit(0)),
        }
    )
    return out.drop("_partitions", "_again")


def stage_order() -> list[Column]:
    return [F.col("stage_id").try_cast("long"), F.col("stage_attempt")]


def call_sites(events: DataFrame) -> DataFrame:
    """Jobs by what started them. Jobs that only write a shuffle don't count; failed ones have no duration."""
    held = of_type(events, "job_start", "job_finish")
    start = F.col("event_type") == "job_start"
    jobs = held.groupBy("log_id", field("job_id").alias("job_id")).agg(
        F.min("seq").alias("seq"),
        F.max_by(F.when(start, field("action")), F.when(start, F.col("seq"))).alias("action"),
        F.max_by(F.when(start, F.col("call_site")), F.when(start, F.col("seq"))).alias("call_site"),
        F.max_by(F.when(start, field("partitions", "long")), F.when(start, F.col("seq"))).alias("partitions"),
        F.max_by(field("duration_s", "double"), F.when(~start, F.col("seq"))).alias("duration_s"),
    )
    out = jobs.groupBy("log_id", F.coalesce("action", F.lit("(no call site)")).alias("action")).agg(
        F.min("seq").alias("first_seq"),
        F.min_by("call_site", "seq").alias("call_site"),
        F.count("*").alias("num_jobs"),
        F.round(F.coalesce(F.sum("duration_s"), F.lit(0.0)), 2).alias("total_s"),
        F.coalesce(F.sum("partitions"), F.lit(0)).alias("output_partitions"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "job_id"))), lambda x: x["job_id"]).alias("job_ids"),
    )
    return out.withColumn("mean_s", F.round(F.col("total_s") / F.col("num_jobs"), 3))


def duration(events: DataFrame) -> DataFrame:
    """First and last time of a log's events; what can't be read as a time doesn't count."""
    out = events.groupBy("log_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return out.withColumn("duration_s", F.expr("timestampdiff(SECOND, first_ts, last_ts)").cast("double"))


def capacity(events: DataFrame, attempts: DataFrame, spans: DataFrame) -> DataFrame:
    """Slots (executors by cores), task time and the share of the slots' time that it fills."""
    cores = F.nullif(F.regexp_extract(field("resources"), config.CORES, 1), F.lit("")).cast("int")
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("seq")))
    held = events.groupBy("log_id").agg(last(field("max_executors", "int")).alias("max_executors"), last(cores).alias("cores_per_executor"))
    work = attempts.groupBy("log_id").agg(F.sum("total_ms").alias("_ms"))
    seen = attempts.select("log_id", F.explode(F.map_keys("tasks_per_executor")).alias("e")).where("e <> '?'").distinct()
    seen = seen.groupBy("log_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("e").try_cast("int"), F.lit(0)).alias("n"), "e"))), lambda x: x["e"]).alias("executors_with_tasks"))
    out = held.join(spans.select("log_id", "duration_s"), "log_id", "left").join(work, "log_id", "left").join(seen, "log_id", "left")
    out = out.withColumn("slots", F.when((F.col("max_executors") > 0) & (F.col("cores_per_executor") > 0), F.col("max_executors") * F.col("cores_per_executor")))
    total = F.coalesce("_ms", F.lit(0)) / 1000
    full = F.when(F.col("duration_s") > 0, F.col("slots") * F.col("duration_s"))
    return out.select(
        "log_id",
        "max_executors",
        "cores_per_executor",
        "slots",
        F.coalesce("executors_with_tasks", F.array().cast("array<string>")).alias("executors_with_tasks"),
        F.round(total, 1).alias("task_time_s"),
        F.round(full, 1).alias("capacity_s"),
        F.round(100 * total / full, 1).alias("occupancy_pct"),
    )


def context(events: DataFrame) -> DataFrame:
    """Last names of the application and version, last exit code, and the tables' snapshots in order."""
    last = lambda name: F.max_by(field(name), F.when(field(name).isNotNull(), F.col("seq"))).alias(name)
    snap = F.when(F.col("event_type") == "delta_snapshot", F.struct("seq", field("version", "long").alias("version"), field("checkpoint", "long").alias("checkpoint")))
    return events.groupBy("log_id").agg(last("app_name"), last("spark_version"), last("exit_code"), F.count(snap).alias("num_snapshots"), F.array_sort(F.collect_list(snap)).alias("snapshots"))


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("log_id", "event_type").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def failures(events: DataFrame) -> DataFrame:
    """Events of lost executors, failed stages and failed tasks."""
    return of_type(events, "executor_lost", "stage_failed", "task_failed").select("log_id", "seq", "ts", "event_type", field("executor").alias("executor"), field("stage_id").alias("stage_id"), field("reason").alias("reason"))


def failures_by_reason(attempts: DataFrame) -> DataFrame:
    return attempts.select("log_id", F.explode("failures_by_reason").alias("reason", "n")).groupBy("log_id", "reason").agg(F.sum("n").alias("n"))
