"""Maintenance of tables, masking of documents, prompts, the menu, and facts of scripts as tables."""

from __future__ import annotations

import json
import os
import time

import pytest
from pyspark.sql import functions as F
from sample_logs import whole

from plumbline import menu, report
from plumbline.functions import masking
from plumbline.functions import text as tx
from plumbline.plans import explain, links, script
from plumbline.sources import logs, sinks


def test_human_bytes(spark):
    held = spark.createDataFrame([(0,), (1023,), (1024,), (1536,), (5 << 20,), (3 << 30,), (7 << 40,), (None,)], "n long")
    assert [r[0] for r in held.select(tx.human_bytes(F.col("n"))).collect()] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "5.0 MB", "3.0 GB", "7.0 TB", "null B"]


def test_maintenance(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.overwrite(spark.range(10).repartition(2), path)
    left = tmp_path / "t" / "_temporary"
    left.mkdir()
    (left / "x").write_text("x")
    old = time.time() - 7200
    os.utime(left, (old, old))
    assert sinks.vacuumed(spark, path, 3) == 0 and left.exists()
    assert sinks.vacuumed(spark, path, 1) == 1 and not left.exists()
    files = {r["file"] for r in sinks.manifest(spark, path).collect()}
    assert len(files) == 2 and {r["value"] for r in spark.read.text(f"{path}/_manifest").collect()} == files
    assert spark.read.parquet(path).count() == 10  # neither touches the rows


def test_masked_documents(spark):
    inner = {"host": "ip-10-0-0-7.ec2.internal", "10.0.0.7": [1, None, {"path": "s3://bucket/a/b", "ok": True}], "text": "from 10.0.0.7 to 10.0.0.8"}
    rows = [(1, json.dumps(inner)), (2, "plain 10.0.0.8"), (3, None), (4, "[]"), (5, json.dumps("10.0.0.7"))]
    out, names = masking.masked_documents(spark.createDataFrame(rows, "id long, doc string"), "id", "doc")
    got = {r["id"]: r["doc"] for r in out.collect()}
    held = json.loads(got[1])
    assert list(held) == list(inner) and held["10.0.0.7"][:2] == [1, None] and held["10.0.0.7"][2] == {"path": "path_001", "ok": True}
    assert "10.0.0" not in held["host"] + held["text"] and held["text"] == f"from {held['host']} to {got[2].removeprefix('plain ')}"
    assert got[3] is None and got[4] == "[]" and json.loads(got[5]) == held["host"]
    assert names.count() == 3


@pytest.mark.parametrize("name", ["log", "PLAN", "script.md"])
def test_prompts(name, tmp_path):
    assert report.contract_gaps(report.prompt_template(name)) == []
    assert not report.prompt_text(name).startswith("<!--") and "{schema}" not in report.prompt_text(name)
    (tmp_path / "Own.MD").write_text("say something")
    assert report.prompt_text("own", str(tmp_path)) == "say something"
    assert "evidence has a path and a value" in report.contract_gaps("say something")
    with pytest.raises(FileNotFoundError):
        report.prompt_text("other", str(tmp_path))


def test_smaller_summaries():
    extras = {"plan": {"nodes": [1], "n": 2}, "script": {"log": [{"line": 3}], "lines": {"2": "a", "3": "b"}}}
    steps = report.smaller(extras)
    assert steps[0] == extras and steps[-1] == {} and steps[1]["plan"] == {"n": 2} and steps[2]["script"]["lines"] == {"3": "b"} and "script" not in steps[3]


def test_menu(spark, tmp_path):
    (tmp_path / "demo_stderr.log").write_text(whole([100] * 4).text + "\n")
    (tmp_path / "demo_stdout.txt").write_text("== Physical Plan ==\nUnion\n")
    (tmp_path / "demo.py").write_text("x = 1\n")
    said = iter(["9", "1", "1", "", ""])
    assert menu.main(["--logs", str(tmp_path), "--scripts", str(tmp_path), "--out", str(tmp_path / "out")], lambda _: next(said)) == 0
    document = json.loads((tmp_path / "out" / "report.json").read_text())
    assert document["script"]["name"] == "demo.py" and document["plan"]["operators"]
    sinks.write_text("x", f"file://{tmp_path}/stored.txt", spark)
    assert logs.text_of(spark, f"file://{tmp_path}/stored.txt") == "x"


def test_script_tables(spark):
    source = '''
df = spark.read.load("/data/complaints_all")
base = df.select("k").cache()
n = base.groupBy("k").count()
base.count()
w = Window.partitionBy("k").orderBy("t")
'''
    found = script.script_facts(spark.createDataFrame([("s", source), ("t", "def (")], "source string, text string"))
    done = {(r["source"], r["method"], r["line"], r["grp"]) for r in script.operations(found).collect()}
    assert done == {("s", "load", 2, "read"), ("s", "count", 5, "driver_action")}  # counting groups is no action
    assert script.call_lines(found, ["partitionBy"], on="Window").first()["lines"] == [6]
    assert script.call_lines(found, ["groupBy"], arg="k").first()["lines"] == [4]
    assert found.where("source = 't'").first()["kind"] == "unreadable"
    usage = script.Usage(script.facts(source))
    assert usage.read_of("complaints_all") == (2, "df", 2) and usage.read_of("complaint...") == (2, "df", 2) and usage.read_of("other_table") == (None, None, None)
    assert usage.reuse_of("df") == {"chain": ["base", "n"]} and usage.cached("base") == [3]


def test_message_lines():
    constants = [(3, "start"), (5, "loading the table"), (9, "start"), (12, "table")]
    assert links.message_line(constants, "start", 0) == 3 and links.message_line(constants, "start", 3) == 9 and links.message_line(constants, " start ", 20) == 3
    assert links.message_line(constants, "now loading the table x", 7) == 5 and links.message_line(constants, "a table", 0) is None


@pytest.mark.parametrize(
    ("op", "text", "want"),
    [
        ("Exchange", "Exchange SinglePartition, ENSURE_REQUIREMENTS, [plan_id=1]", {"partitioning": "single"}),
        ("Exchange", "Exchange rangepartitioning(a#1 ASC NULLS FIRST, 8), [plan_id=1]", {"partitioning": "range", "partitions": 8}),
        ("Exchange", "Exchange RoundRobinPartitioning(4), REPARTITION_BY_NUM, [plan_id=1]", {"partitioning": "RoundRobin", "partitions": 4, "keys": []}),
        ("SortMergeJoin", "SortMergeJoin(skew=true) [a#1, upper(b#2)], [a#3, c#4], Inner", {"left_keys": ["a", "expr(b)"], "right_keys": ["a", "c"], "join_type": "Inner", "build_side": None, "residual": False, "function_in_key": True}),
        ("BroadcastHashJoin", "BroadcastHashJoin [k#1], [k#1], LeftSemi, BuildLeft, false", {"left_keys": ["k"], "right_keys": ["k"], "join_type": "LeftSemi", "build_side": "left", "residual": False}),
        ("BroadcastNestedLoopJoin", "BroadcastNestedLoopJoin BuildRight, Cross", {"join_type": "Cross"}),
        ("Expand", "Expand [[a#1, null, 1], [null, b#2, 2]], [a#3, b#4, gid#5]", {"projections": 2}),
        ("Window", "Window [row_number() windowspecdefinition(k#1, t#2 ASC NULLS FIRST, f()) AS n#3], [k#1], [t#2 ASC NULLS FIRST]", {"partition_by": ["k"], "functions": ["row_number"], "unpartitioned": False}),
        ("SortAggregate", "SortAggregate(key=[a#1], functions=[partial_first(b#2, false)])", {"keys": ["a"], "functions": ["first"], "partial": True, "distinct": False}),
        ("BroadcastExchange", "BroadcastExchange IdentityBroadcastMode, [plan_id=1]", {"mode": "identity"}),
        ("WindowGroupLimit", "WindowGroupLimit [k#1], [t#2], row_number(), 1, Final", {"phase": "Final"}),
        ("Sort", "Sort [a#1 ASC]", {}),
    ],
)
def test_node_fields(op, text, want):
    assert explain.operator_of("*(2) " + text) == op
    got = explain.attributes(op, text)
    assert {k: got.get(k) for k in want} == want


def test_pseudonyms_of_many(spark):
    hosts = spark.range(1200).select(F.format_string("h%d.example.com", 1199 - F.col("id")).alias("host"), F.col("id").alias("seq"))
    names = masking.pseudonyms(hosts.union(hosts), "host", "seq", "host").collect()
    assert {r["pseudonym"] for r in names} == {f"host_{i:03d}" for i in range(1, 1201)}
    assert {r["first_seq"]: r["pseudonym"] for r in names}[999] == "host_1000"
    assert masking.pseudonyms(hosts.limit(0), "host", "seq", "host").count() == 0


def test_digest_of_a_stream(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"x" * 3_000_000)
    (tmp_path / "b.log").write_bytes(b"y")
    read = lambda large: sorted((r["path"], r["bytes"], r["sha256"]) for r in logs.digests(spark, str(tmp_path), large).collect())
    assert read(1 << 30) == read(0) == read(1000) and len(read(0)) == 2
