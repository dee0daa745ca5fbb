"""From log lines to the report, on logs with known contents."""

from __future__ import annotations

import json

import pytest
from sample_logs import Log, whole

from plumbline import config, report
from plumbline.operators import records
from plumbline.sources import logs


def other_rules() -> Log:
    log = Log().begin()
    log.say("No Partition Defined for Window operation! Moving all data to a single partition", "WARN", "WindowExec")
    log.say("Planning scan with bin packing, max size: 4194304 bytes, open cost is considered as scanning 4194304 bytes, number of split files: 54, prefetch: false")
    log.say("For shuffle(0), advisory target size: 67108864, actual target size 1048576, minimum partition size: 1048576")
    for n in range(5):
        log.job(n, n, [100, 100], action="$anonfun$recordDeltaOperationInternal$1 at Log.scala:7").end_stage(n).end_job(n)
    return log.end()


def retries() -> Log:
    log = Log().begin().job(0, 3, [100, 100, 100], fail=(1,), kind="ShuffleMapStage")
    log.say("ShuffleMapStage 3 (count at job.py:12) failed in 1.0 s due to fetch failure", "ERROR")
    return log.job(0, 3, [100, 100], attempt=1, kind="ShuffleMapStage", open_job=False).end_stage(3, kind="ShuffleMapStage").end_job(0).end()


def truncated() -> Log:
    log = Log().begin().job(0, 0, [100, 100])
    log.lines = log.lines[:-1]
    return log


#: Many logs in one run of the engine, which keeps them apart.
LOGS = {
    "clean": whole([2000] * 8, executors=1, cores=2),
    "skew": whole([1000] * 7 + [6000], executors=1, cores=4),
    "exploded": whole([50] * 3, submitted=500),
    "single": whole([10], executors=1, cores=1),
    "idle": whole([10] * 4, executors=4, cores=4),
    "others": other_rules(),
    "retries": retries(),
    "truncated": truncated(),
    "malformed": Log().raw("{}", "{}", "{}").say("Submitted application: x"),
}


@pytest.fixture(scope="module")
def run(spark):
    rows = [(name, i, line) for name, log in LOGS.items() for i, line in enumerate(log.lines, 1)]
    held = report.Run(spark.createDataFrame(rows, "log_id string, line_no long, value string"))
    return held


@pytest.fixture(scope="module")
def tables(run):
    names = ("findings", "alerts", "scores", "classes", "attempts", "sites", "deductions")
    out = {}
    for name in names:
        by_log: dict[str, list] = {}
        for r in getattr(run, name).collect():
            by_log.setdefault(r["log_id"], []).append(r)
        out[name] = by_log
    return out


def test_clean_run(tables):
    assert "clean" not in tables["alerts"] and "clean" not in tables["findings"]
    s = tables["scores"]["clean"][0]
    assert (s["score"], s["band"]) == (100, "good")
    assert tables["classes"]["clean"][0]["class"] == "healthy"
    a = tables["attempts"]["clean"][0]
    assert (a["num_tasks"], a["median_ms"], a["p95_ms"], a["total_ms"], a["skew_ratio"]) == (8, 2000.0, 2000, 16000, 1.0)
    assert (a["origin"]["job_id"], a["origin"]["call_site"]["line"], a["duration_s"], a["status"]) == ("0", 12, 2.5, "finished")


@pytest.mark.parametrize(
    ("log", "rule", "severity"),
    [
        ("skew", "skew_task", "MEDIUM"),
        ("exploded", "exploded_stage", "HIGH"),
        ("single", "fragmented_stages", "LOW"),
        ("idle", "low_occupancy", "MEDIUM"),
        ("others", "unpartitioned_window", "HIGH"),
        ("others", "small_files", "MEDIUM"),
        ("others", "aqe_target_reduced", "INFO"),
        ("others", "repeated_action", "LOW"),  # the engine's own code
    ],
)
def test_rules(tables, log, rule, severity):
    assert {r["rule"]: r["severity"] for r in tables["findings"][log]}[rule] == severity


def test_order_and_call_sites(tables):
    assert min(tables["findings"]["others"], key=lambda r: r["rank"])["severity"] == "HIGH"
    site = tables["sites"]["others"][0]
    assert (site["num_jobs"], site["job_ids"]) == (5, ["0", "1", "2", "3", "4"])


def test_retries(tables):
    first, second = sorted(tables["attempts"]["retries"], key=lambda r: r["stage_attempt"])
    assert (first["status"], first["num_failed"], first["failures_by_reason"]) == ("failed", 1, {"java.io.IOException": 1})
    assert (second["status"], second["tasks_reexecuted"], second["task_retries"], second["attempts_of_stage"]) == ("finished", 2, 2, 2)
    assert tables["classes"]["retries"][0]["class"] == "degraded"
    assert {d["criterion"]: d["points"] for d in tables["deductions"]["retries"]}["stage_failures"] == 5


def test_truncated_and_malformed(tables):
    assert {"NO_FINAL_STATUS", "JOBS_WITHOUT_END", "STAGES_WITHOUT_END", "TASKS_WITHOUT_END"} <= {r["code"] for r in tables["alerts"]["truncated"]}
    assert {r["code"]: r["severity"] for r in tables["alerts"]["malformed"]}["UNEXPECTED_FORMAT"] == "error"
    assert tables["scores"]["malformed"][0]["score"] is None
    assert tables["classes"]["malformed"][0]["class"] == "inconclusive"


def test_multiline_records(spark):
    log = Log().raw("Traceback (most recent call last)", "  File \"x.py\", line 3", "    boom()", "stray before")
    log.say("Starting up").raw("   +- Exchange", "   :- Scan", "nothing known")
    log.say("Something odd", "WARN", "Odd").raw("java.io.IOException: gone", "\tat a.b.C", "  indented")
    log.say("quiet").raw("ValueError: no", "    at x")
    log.say("Submitting 8 missing tasks from ResultStage 1 (" + "x" * 400 + ") (first)")
    log.raw("java.lang.Error: many", *["\tat a.b"] * 59)
    events, reading = records.parsed(logs.lines_of(spark, log.text))
    r = reading.first()
    assert (r["header_lines"], r["continuation_lines"], r["stack_lines"], r["stray_lines"]) == (4, 2, 3 + 3 + 2 + 60, 2)
    assert r["stray_examples"] == ["stray before", "nothing known"]
    found = events.orderBy("seq").collect()
    kinds = [(e["event_type"], e["level"], len(e["stack"]), e["n_stack"]) for e in found]
    assert kinds == [("raw_warn_error", "ERROR", 2, 2), ("raw_warn_error", "WARN", 3, 3), ("raw_warn_error", "ERROR", 1, 1), ("stage_tasks_submitted", "INFO", 0, 0), ("raw_warn_error", "ERROR", config.STACK_LINES - 1, 59)]
    assert len(found[3]["data"]["rdd_desc"]) == config.RDD_CHARS


def test_masking(spark):
    from plumbline.functions import masking

    rows = [
        (1, "read s3://bucket/a,then 10.0.0.1:7077 at 10:00:00", "10.0.0.1"),
        (2, "host ip-10-0-0-1.ec2.internal and [2001:db8::1]:5 and 127.0.0.1 v1.2.3.4.5", "[2001:db8::1]:7337"),
        (3, "arn:aws:iam::1:role/x s3://bucket/a", "Node-B:99"),
        (4, None, None),
    ]
    df = spark.createDataFrame(rows, "seq int, msg string, host string")
    out, names = masking.masked(df, ["seq"], ["msg"], ["host"])
    got = {r["seq"]: (r["msg"], r["host"]) for r in out.collect()}
    assert got[1][0] == "read path_001,then [host_001] at 10:00:00" and got[1][1] == "host_001"
    assert "[host_001]" in got[2][0] and "127.0.0.1" in got[2][0] and "1.2.3.4.5" in got[2][0]
    assert got[2][1] != "host_001" and got[2][1] in got[2][0]
    assert "s3://" not in got[3][0] and "arn:" not in got[3][0] and "path_001" in got[3][0]
    assert got[4] == (None, None)
    keys = [(r["kind"], r["raw_key"]) for r in names.collect()]
    assert len(keys) == len(set(keys)) == len({r["pseudonym"] for r in names.collect()})


def test_documents(spark, run):
    document = report.report(run, "skew")
    small = report.summary(run, document, config.PROFILES[2])
    assert small["stages"][0]["stage_key"] == "0.0"  # cited by a finding, though no stage is asked for
    fitted, name = report.fitted(run, document, "p", report.tokens(report.message("p", small)))
    assert name == "minimal" and len(json.dumps(fitted)) <= len(json.dumps(document))
    text = report.markdown(document)
    assert "skew_task" in text and "| 0.0 |" in text
    answer = {
        "classification": "healthy", "reason": "stage took 987654 s", "evidence": [{"path": "run.jobs", "value": "1.0"}, {"path": "run.nothing", "value": "1"}],
        "bottlenecks": [{"id": "G1", "title": "skew", "finding": "A9", "statement": "it is skewed", "candidate": None, "evidence": [{"path": "stages[0.0].num_tasks", "value": "9"}]}],
        "recommendations": [{"id": "R1", "kind": "optimise", "text": "use salting", "supported_by": ["G2"], "script_lines": [3]}], "missing": [],
    }
    said = "Here: " + json.dumps(answer).replace('"', "“", 2)
    assert report.asked(lambda _: said, "m")[0]["classification"] == "healthy"
    checked, totals, objections = report.verified(spark, answer, document["class"] and report.summary(run, document), "degraded")
    assert {c["path"]: c["status"] for c in checked} == {"run.jobs": "match", "run.nothing": "missing", "stages[0.0].num_tasks": "differs"}
    assert totals["pct_match"] == 33.3
    kinds = {o["kind"] for o in objections}
    assert {"CLASS", "EVIDENCE", "NUMBER_WITHOUT_BASIS", "STATED_AS_FACT", "TERM_WITHOUT_BASIS", "NO_LIMITS"} <= kinds
    assert "CLASS" in report.draft(objections, "log")
    held = report.stored_answer(answer, "m")
    assert report.fresh(held, "m") and not report.fresh(held, "n")


def test_files(spark, tmp_path):
    log = whole([100] * 4)
    path = tmp_path / "demo_stderr.log"
    path.write_text(log.text + "\r\n", encoding="utf-8")
    lines = logs.raw_lines(spark, str(path)).orderBy("line_no").collect()
    assert [r["line_no"] for r in lines] == list(range(1, len(log.lines) + 1)) and lines[0]["value"] == log.lines[0]
    (tmp_path / "demo_stdout.txt").write_text("x")
    (tmp_path / "demo.py").write_text("x = 1\n")
    assert logs.scripts_in(spark, str(tmp_path)).count() == 1
    pairs = logs.paired_outputs(logs.logs_in(spark, str(tmp_path)).where("path LIKE '%stderr%'"), logs.logs_in(spark, str(tmp_path)).where("path LIKE '%stdout%'"))
    assert pairs.first()["output"].endswith("demo_stdout.txt")
    named = spark.createDataFrame([("my_demo_run",)], "name string")
    assert logs.paired_scripts(named, logs.scripts_in(spark, str(tmp_path))).first()["path"].endswith("demo.py")
    from plumbline.__main__ import guarded, arguments

    with pytest.raises(SystemExit):
        guarded(arguments(["--log", str(tmp_path / "none"), "--out", str(tmp_path / "o")]))
    from plumbline.__main__ import main

    (tmp_path / "prompt.md").write_text("<!-- note -->\nSay {schema}")
    (tmp_path / "answer.json").write_text(json.dumps({"classification": "healthy", "evidence": [{"path": "run.stages", "value": "1"}], "bottlenecks": [], "recommendations": [], "missing": []}))
    out = tmp_path / "out"
    assert main(["--log", str(path), "--prompt", str(tmp_path / "prompt.md"), "--answer", str(tmp_path / "answer.json"), "--out", str(out)]) == 0
    document = json.loads((out / "report.json").read_text())
    assert document["meta"]["log_sha256"] and document["summary"]["run"]["stages"] == 1
    assert (out / "prompt_log.md").read_text().startswith('Say {"type":"struct"')
    assert json.loads((out / "answer_checks.json").read_text())["totals"]["match"] == 1
