"""Event catalogue, thresholds, weights and profiles. Rules take them as arguments."""

from __future__ import annotations

from dataclasses import dataclass

# Formats of the log lines that are read, in the order in which they are tried. (type, pattern, fields)
HEADER = r"^(\d{2}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}) (TRACE|DEBUG|INFO|WARN|ERROR|FATAL) ([\w$.]+): (.*)$"
STACK = (
    r"^(?:\s*at\s|\s*\.\.\. \d+ more|\s*Caused by:|\s*Suppressed:|Traceback \(most recent call last\)|\s*File \"[^\"]+\", line \d+"
    r"|During handling of the above exception|[\w$.]+(?:Exception|Error|Throwable)\b)"
)
PLAN_LINE = r"^\s*(?:[+:|]\s*)*[+:]-\s"
EVENTS: list[tuple[str, str, tuple[str, ...]]] = [
    ("job_start", r"^Got job (\d+) \((.*?)\) with (\d+) output partitions$", ("job_id", "action", "partitions")),
    ("map_stage_job_start", r"^Got map stage job (\d+) \((.*?)\) with (\d+) output partitions$", ("job_id", "action", "partitions")),
    ("job_finish", r"^Job (\d+) finished: .*?, took ([\d.]+) s$", ("job_id", "duration_s")),
    ("job_end_marker", r"^Job (\d+) is finished\. Cancelling", ("job_id",)),
    ("job_failed", r"^Job (\d+) failed: .*?, took ([\d.]+) s$", ("job_id", "duration_s")),
    ("stage_submit", r"^Submitting (ResultStage|ShuffleMapStage) (\d+)", ("stage", "stage_id")),
    ("stage_finish", r"^(ResultStage|ShuffleMapStage) (\d+) \(.*?\) finished in ([\d.]+) s$", ("stage", "stage_id", "duration_s")),
    ("taskset_removed", r"^Removed TaskSet (\d+)\.(\d+), whose tasks have all completed", ("stage_id", "attempt")),
    ("stage_failed", r"^(ResultStage|ShuffleMapStage) (\d+) \(.*?\) failed(?: in ([\d.]+) s)?(?: due to (.+))?", ("stage", "stage_id", "duration_s", "reason")),
    ("task_failed", r"^Lost task ([\d.]+) in stage ([\d.]+) \(TID (\d+)\) \((\S+) executor (\w+)\): ([\w.$]+)", ("task_id", "stage_id", "tid", "host", "executor", "reason")),
    ("task_start", r"^Starting task ([\d.]+) in stage ([\d.]+) \(TID (\d+)\) \(([^,]+), executor (\d+)(?:, partition (\d+))?", ("task_id", "stage_id", "tid", "host", "executor", "partition")),
    ("task_finish", r"^Finished task ([\d.]+) in stage ([\d.]+) \(TID (\d+)\) in (\d+) ms on ([^\s(]+) \(executor (\d+)\)", ("task_id", "stage_id", "tid", "duration_ms", "host", "executor")),
    ("broadcast_stored", r"^Block broadcast_(\d+)(?:_piece\d+)? stored as (?:values|bytes) in memory \(estimated size ([\d.]+) (\w+),(?: actual size: [\d.]+ \w+,)? free ([\d.]+) (\w+)\)$", ("broadcast_id", "size_val", "size_unit", "free_val", "free_unit")),
    ("block_added", r"^Added broadcast_(\d+)_piece\d+ in memory on (\[[0-9a-fA-F:\.]+\]:\d+) \(size: ([\d.]+) (\w+), free: ([\d.]+) (\w+)\)$", ("broadcast_id", "host", "size_val", "size_unit", "free_val", "free_unit")),
    ("shuffle_map_output_request", r"^Asked to send map output locations for shuffle (\d+)$", ("shuffle_id",)),
    ("unpartitioned_window", r"^No Partition Defined for Window operation", ()),
    ("stage_tasks_submitted", r"^Submitting (\d+) missing tasks from (ShuffleMapStage|ResultStage) (\d+) \((.*?)\)", ("num_tasks", "stage", "stage_id", "rdd_desc")),
    ("aqe_coalesce_target", r"^For shuffle\(([\d,\s]+)\), advisory target size: (\d+), actual target size (\d+), minimum partition size: (\d+)$", ("shuffle_id", "advisory_bytes", "actual_bytes", "min_bytes")),
    ("scan_bin_packing", r"^Planning scan with bin packing, max size: (\d+) bytes, open cost is considered as scanning (\d+) bytes, number of split files: (\d+), prefetch: (\w+)$", ("max_split_bytes", "open_cost_bytes", "num_files", "prefetch")),
    ("max_executors", r"^Using effectiveMaxExecutors = (\d+)", ("max_executors",)),
    ("resource_profile", r"^Default ResourceProfile created, executor resources: (.*)$", ("resources",)),
    ("delta_snapshot", r"^Loading version (\d+) starting from checkpoint version (\d+)\.?$", ("version", "checkpoint")),
    ("app_name", r"^Submitted application: (.+)$", ("app_name",)),
    ("spark_version", r"^Running Spark version (\S+)$", ("spark_version",)),
    ("codegen", r"^Code generated in ([\d.]+) ms$", ("duration_ms",)),
    ("executor_backlog_request", r"^Requesting (\d+) new executors because tasks are backlogged", ("num_requested",)),
    ("executor_registered", r"^New executor (\d+) has registered \(new total is (\d+)\)$", ("executor", "total")),
    ("executor_not_found", r"^No executor found for ([0-9a-fA-F:\.]+)$", ("host",)),
    ("executor_lost", r"^Lost executor (\d+) on (\[[^\]]+\]|[^\s:]+): (.+)$", ("executor", "host", "reason")),
    ("app_final_status", r"^SparkContext is stopping with exitCode (\d+)\.?$", ("exit_code",)),
]
CALL_SITE = r"^(\S+) at ([^:]+):(\d+)$"
TEMP_DIR = r"/tmp/spark-[0-9a-f\-]{8,}/"
CORES = r"cores\s*->\s*name:\s*cores,\s*amount:\s*(\d+)"
ENGINE_METHODS = ("getHistory", "$anonfun$recordDeltaOperationInternal$1", "$anonfun$withThreadLocalCaptured$1")
TIME_FORMAT = "yy/MM/dd HH:mm:ss"
ALERT_LEVELS = ("WARN", "ERROR", "FATAL")
UNMATCHED = "raw_warn_error"
#: Beginnings of messages whose event types should have been recognised.
KNOWN_PREFIXES = (("Lost task", "task_failed"), ("Lost executor", "executor_lost"), ("No Partition Defined", "unpartitioned_window"))

# Limits, thresholds, weights and severities.
STACK_LINES, CONTINUATION_CHARS, RDD_CHARS, STRAY_EXAMPLES, STRAY_CHARS = 50, 20_000, 300, 3, 200
SEVERITIES = ("HIGH", "MEDIUM", "LOW", "INFO")


@dataclass(frozen=True)
class Thresholds:
    exploded_tasks: int = 500
    exploded_median_ms: float = 100
    aqe_ratio: float = 8
    repeated_jobs: int = 5
    skew_ratio: float = 3.0
    skew_tasks: int = 8
    skew_max_ms: float = 5000
    single_task_pct: float = 40
    small_files: int = 50
    occupancy_pct: float = 60
    header_share: float = 0.5
    duration_slack_s: float = 2.0
    clock_slack_s: int = 600


@dataclass(frozen=True)
class Weights:
    unsuccessful: int = 40
    lost_executor: int = 5
    lost_executors_cap: int = 20
    stage_failure: int = 5
    stage_failures_cap: int = 20
    retries_per_point: int = 10
    retries_cap: int = 10
    findings: tuple[tuple[str, int], ...] = (("HIGH", 10), ("MEDIUM", 5), ("LOW", 2), ("INFO", 0))
    findings_cap: int = 30
    good: int = 80
    attention: int = 50


@dataclass(frozen=True)
class Profile:
    """Sizes of a summary."""

    name: str
    stages: int
    call_sites: int
    warnings: int
    failures: int
    chars: int
    stack_lines: int
    texts: bool = True


PROFILES = (
    Profile("standard", 10, 10, 20, 20, 200, 3),
    Profile("compact", 5, 5, 8, 5, 120, 0, False),
    Profile("minimal", 0, 0, 5, 3, 100, 0, False),
)
VERSIONS = {"parser": "0.4.0", "report": "2.0", "summary": "1.2", "plan": "1.1", "script": "1.0", "score": "1.0"}
#: Measures that a driver log doesn't hold.
UNAVAILABLE = ("gc_time_share", "shuffle_bytes", "spill_bytes", "result_bytes")
