"""Detection rules: one expression for each, united and ranked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline import config
from plumbline.operators.runs import field, of_type


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, config.SEVERITIES)), severity) - 1


def ranked(parts: Sequence[DataFrame], order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The parts as one table with a rank: by severity, then by the order."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = W.partitionBy(*by).orderBy(severity_rank(F.col("severity")), *order) if by else W.orderBy(severity_rank(F.col("severity")), *order)
    return out.withColumn("rank", F.row_number().over(w))


#: What a finding may mean, where to look, and what could be done once it is confirmed.
TEXTS: dict[str, tuple[list[str], str, list[str]]] = {
    "unpartitioned_window": (
        ["A window may lack a partition in the code, so all rows went through one task.", "The window may be meant to be global; its cost depends on volume."],
        "Windows without a partition in the script, near the times given.",
        ["Partition the window by a business key.", "Number rows in two levels if the numbers must be global."],
    ),
    "exploded_stage": (
        ["There may be far more partitions than the data needs: scheduling is then most of the cost.", "The stage may read or write without a shuffle, where adaptive execution merges nothing."],
        "Partitions of the table before the action that started the stage.",
        ["Fewer partitions before writing.", "Let adaptive execution merge shuffle partitions."],
    ),
    "aqe_target_reduced": (
        ["Shuffles may be small for the least parallelism that adaptive execution keeps."],
        "Worth a look only beside stages with many short tasks.",
        ["Let adaptive execution prefer partition size to parallelism."],
    ),
    "repeated_action": (
        ["An action may run inside a loop of the driver.", "One table may be computed again for each action."],
        "The line that the call site names.",
        ["Join the iterations into one query.", "Keep the base table in memory if it is used again."],
    ),
    "skew_task": (
        ["One key may hold most rows of a join or aggregation.", "One input file may be larger than the rest.", "One executor may be slow."],
        "Rows for each key before the stage, sizes of its files, times of its executors.",
        ["Salt the key, or let adaptive execution split skewed joins.", "Compact the source."],
    ),
    "fragmented_stages": (["Many small actions may each have become a job."], "Call sites with most jobs.", ["Join transformations before running actions."]),
    "small_files": (["The source may consist of many small files."], "Number and size of the source's files.", ["Compact the source."]),
    "low_occupancy": (
        ["The driver may have worked between jobs.", "There may be more executors than the volume needs.", "Capacity counts the most executors, so real occupancy may be higher."],
        "Sum of the jobs' durations against the whole duration; executors that came up.",
        ["Fewer actions on the driver.", "Fewer executors at most."],
    ),
}


def findings(events: DataFrame, attempts: DataFrame, sites: DataFrame, capacity: DataFrame, t: config.Thresholds = config.Thresholds()) -> DataFrame:
    """(log_id, rule, severity, title, evidence, thresholds, hypotheses, investigate, options, stage_key, rank)."""

    def row(df: DataFrame, rule: str, severity: Column | str, title: Column, evidence: dict[str, Column], limits: dict[str, float], seq: Column, stage: Column | None = None, internal: Column | None = None) -> DataFrame:
        hypotheses, look, options = TEXTS[rule]
        said = F.array(*map(F.lit, hypotheses))
        if internal is not None:
            said = F.when(internal, F.concat(said, F.array(F.lit("The engine's own upkeep of tables may have started it, not the script.")))).otherwise(said)
        pairs = [x for k, v in evidence.items() for x in (F.lit(k), v.cast("string"))]
        return df.select(
            "log_id",
            F.lit(rule).alias("rule"),
            (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
            title.alias("title"),
            F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("evidence"),
            F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(float(v)))]).alias("thresholds"),
            said.alias("hypotheses"),
            F.lit(look).alias("investigate"),
            F.array(*map(F.lit, options)).alias("options"),
            (stage if stage is not None else F.lit(None).cast("string")).alias("stage_key"),
            F.lit(list(TEXTS).index(rule)).alias("_rule"),
            seq.cast("long").alias("_seq"),
        )

    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    windows = of_type(events, "unpartitioned_window").groupBy("log_id").agg(F.count("*").alias("n"), F.min_by("ts_raw", "seq").alias("a"), F.max_by("ts_raw", "seq").alias("b"))
    n = F.coalesce("submitted_tasks", "num_tasks")
    stage_seq = F.col("stage_id").try_cast("long") * 1000 + F.col("stage_attempt")
    internal = F.coalesce(F.col("origin.call_site.internal"), F.lit(False))
    origin = {"origin_action": F.col("origin.action"), "origin_internal": F.col("origin.call_site.internal"), "origin_line": F.col("origin.call_site.line")}
    exploded = attempts.withColumn("_tasks", n).where((F.col("_tasks") >= t.exploded_tasks) & (F.col("median_ms") < t.exploded_median_ms))
    ratio = field("advisory_bytes", "double") / field("actual_bytes", "double")
    low = (field("actual_bytes", "long") > 0) & (ratio >= t.aqe_ratio)
    aqe = of_type(events, "aqe_coalesce_target").withColumns({"_low": low, "_ratio": ratio})
    aqe = aqe.groupBy("log_id").agg(
        F.count_if("_low").alias("n"),
        F.count("*").alias("all"),
        F.count_if(F.col("_low") & (field("actual_bytes") == field("min_bytes"))).alias("at_least"),
        F.min_by(F.struct(field("advisory_bytes").alias("advisory"), field("min_bytes").alias("least")), F.when(F.col("_low"), F.col("seq"))).alias("x"),
        F.round(F.min(F.when(F.col("_low"), F.col("_ratio"))), 1).alias("lo"),
        F.round(F.max(F.when(F.col("_low"), F.col("_ratio"))), 1).alias("hi"),
    )
    site_internal = F.coalesce(F.col("call_site.internal"), F.lit(False))
    skewed = attempts.where((F.col("skew_ratio") >= t.skew_ratio) & (F.col("num_tasks") >= t.skew_tasks) & (F.col("max_ms") >= t.skew_max_ms))
    single = attempts.groupBy("log_id").agg(F.count_if(F.col("num_tasks") == 1).alias("one"), F.count("*").alias("all")).withColumn("pct", 100 * F.col("one") / F.col("all"))
    scans = of_type(events, "scan_bin_packing").where((field("num_files", "long") >= t.small_files) & (field("max_split_bytes", "long") <= field("open_cost_bytes", "long")))
    scans = scans.groupBy("log_id").agg(F.count("*").alias("n"), F.max(field("num_files", "long")).alias("files"), F.min_by(F.struct(field("max_split_bytes").alias("split"), field("open_cost_bytes").alias("open")), "seq").alias("x"))
    zero = F.lit(0)
    parts = [
        row(windows, "unpartitioned_window", "HIGH", F.lit("A window without a partition moved all rows to one task"), {"occurrences": F.col("n"), "first_ts": F.col("a"), "last_ts": F.col("b")}, {"occurrences": 1}, zero),
        row(
            exploded, "exploded_stage", "HIGH", text("Stage ", F.col("stage_key"), ": ", F.col("_tasks"), " tasks with a median of ", F.col("median_ms"), " ms"),
            {"stage_key": F.col("stage_key"), "stage_kind": F.col("stage_kind"), "num_tasks": F.col("_tasks"), "median_ms": F.col("median_ms"), "task_time_s": F.round(F.col("total_ms") / 1000, 1), "duration_s": F.col("duration_s"), "rdd_desc": F.col("rdd_desc"), **origin},
            {"tasks": t.exploded_tasks, "median_ms": t.exploded_median_ms}, stage_seq, F.col("stage_key"), internal,
        ),
        row(
            aqe.where("n > 0"), "aqe_target_reduced", "INFO", text(F.col("n"), " shuffles too small for the parallelism kept"),
            {"occurrences": F.col("n"), "coalesced_shuffles": F.col("all"), "at_minimum": F.col("at_least"), "advisory_bytes": F.col("x.advisory"), "min_bytes": F.col("x.least"), "ratio_min": F.col("lo"), "ratio_max": F.col("hi")},
            {"ratio": t.aqe_ratio}, zero,
        ),
        row(
            sites.where(F.col("num_jobs") >= t.repeated_jobs), "repeated_action", F.when(site_internal, "LOW").otherwise("MEDIUM"), text(F.col("num_jobs"), " jobs started by ", F.substring("action", 1, 70)),
            {"action": F.col("action"), "num_jobs": F.col("num_jobs"), "total_s": F.col("total_s"), "internal": site_internal, "file": F.col("call_site.file"), "line": F.col("call_site.line")},
            {"jobs": t.repeated_jobs}, F.col("first_seq"), None, site_internal,
        ),
        row(
            skewed, "skew_task", "MEDIUM", text("Stage ", F.col("stage_key"), ": slowest task ", F.col("skew_ratio"), " times the median"),
            {"stage_key": F.col("stage_key"), "stage_kind": F.col("stage_kind"), "skew_ratio": F.col("skew_ratio"), "max_ms": F.col("max_ms"), "p95_ms": F.col("p95_ms"), "median_ms": F.col("median_ms"), "num_tasks": F.col("num_tasks"), "duration_s": F.col("duration_s"), **origin},
            {"ratio": t.skew_ratio, "tasks": t.skew_tasks, "max_ms": t.skew_max_ms}, stage_seq, F.col("stage_key"),
        ),
        row(
            single.where(F.col("pct") >= t.single_task_pct), "fragmented_stages", "LOW", text(F.round("pct").cast("int"), "% of the stages had a single task"),
            {"single_task_stages": F.col("one"), "stages": F.col("all"), "pct": F.round("pct", 1)}, {"pct": t.single_task_pct}, zero,
        ),
        row(
            scans, "small_files", "MEDIUM", F.lit("A scan of many files with splits no larger than the cost of opening one"),
            {"occurrences": F.col("n"), "most_files": F.col("files"), "max_split_bytes": F.col("x.split"), "open_cost_bytes": F.col("x.open")}, {"files": t.small_files}, zero,
        ),
        row(
            capacity.where(F.col("occupancy_pct") < t.occupancy_pct), "low_occupancy", "MEDIUM", text("Tasks filled ", F.col("occupancy_pct"), "% of the estimated capacity"),
            {"slots": F.col("slots"), "task_time_s": F.col("task_time_s"), "capacity_s": F.col("capacity_s"), "occupancy_pct": F.col("occupancy_pct")}, {"pct": t.occupancy_pct}, zero,
        ),
    ]
    return ranked(parts, ["_rule", "_seq"], ["log_id"]).drop("_rule", "_seq")
