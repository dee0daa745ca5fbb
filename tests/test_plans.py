"""Plans, scripts, links, phases and candidates, with plan text of this session."""

from __future__ import annotations

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from sample_logs import Log

from plumbline import report
from plumbline.engine import printed_plan
from plumbline.plans import explain, links, script, signals
from plumbline.sources import logs

PLAN = """== Physical Plan ==
AdaptiveSparkPlan isFinalPlan=false
+- BroadcastHashJoin [k#1], [k#9], LeftOuter, BuildRight, (v#2 > 3), false
   :- HashAggregate(keys=[k#1], functions=[sum(v#2), count(distinct w#3)])
   :  +- Exchange hashpartitioning(k#1, 200), ENSURE_REQUIREMENTS, [plan_id=11]
   :     +- Project [k#1, v#2]
   :        +- FileScan parquet [k#1,v#2,w#3] Batched: true, DataFilters: [isnotnull(k#1)], Format: Parquet, Location: InMemoryFileIndex(1 paths)[file:/data/complaints_all], PartitionFilters: [], PushedFilters: [IsNotNull(k), GreaterThan(v,3)], ReadSchema: struct<k:int>
   +- BroadcastExchange HashedRelationBroadcastMode(List(cast(input[0, int, false] as bigint)),false), [plan_id=15]
      +- HashAggregate(keys=[k#9], functions=[max(v#8)])
         +- Exchange hashpartitioning(k#9, 200), ENSURE_REQUIREMENTS, [plan_id=12]
            +- Project [k#9, v#8]
               +- FileScan parquet [k#9,v#8] Batched: true, DataFilters: [], Format: Parquet, Location: InMemoryFileIndex(1 paths)[file:/data/complaints_all], PartitionFilters: [], PushedFilters: [], ReadSchema: struct<k:int>
"""
SOURCE = '''from pyspark.sql import functions as F
path = "file:/data/complaints_all"
df = spark.read.load(path)  # password = "hidden"
base = df.select("k", "v")
a = base.groupBy("k").agg(F.sum("v"))
b = base.groupBy("k").agg(F.max("v"))
print("joining the two")
out = a.join(b, "k", "left")
n = out.count()
out.write.format("delta").save("x")
print("table is written")
DeltaTable.forPath(spark, "x").vacuum(168)
token = "abcdef"
'''


def test_tree():
    block = explain.sections("2024-01-01 10:00:00,1 - INFO - start\n" + PLAN + "\ndone\n")
    assert block[1] == ["2024-01-01 10:00:00,1 - INFO - start", "done"]
    nodes = list(explain.nodes(block[0][0]))
    assert [n["op"] for n in nodes][:4] == ["AdaptiveSparkPlan", "BroadcastHashJoin", "HashAggregate", "Exchange"]
    join, scan = nodes[1], nodes[5]
    assert (join["left_keys"], join["join_type"], join["build_side"], join["residual"]) == (["k"], "LeftOuter", "right", True)
    assert (scan["table"], scan["columns"], scan["pushed_filters"], scan["partition_filters"], scan["data_filters"]) == ("complaints_all", 3, 2, 0, True)
    assert nodes[2]["distinct"] and nodes[2]["functions"] == ["count", "sum"]
    assert nodes[3]["partitions"] == 200 and nodes[3]["parent_id"] == nodes[2]["node_id"]


def test_final_tree_and_formatted():
    text = "== Physical Plan ==\nAdaptiveSparkPlan isFinalPlan=true\n+- == Final Plan ==\n   Union\n   :- Scan a\n+- == Initial Plan ==\n   Union\n   :- Scan a\n"
    plans, _, _ = explain.sections(text)
    assert [n["op"] for n in explain.nodes(plans[0])] == ["AdaptiveSparkPlan", "Union", "Scan"]
    assert explain.sections("== Physical Plan ==\nAdaptiveSparkPlan (5)\n+- Sort (4)\n")[2]
    assert explain.sections("== Parsed Logical Plan ==\nx\n\n== Physical Plan ==\nUnion\n")[0] == [["Union"]]


def test_signals(spark):
    nodes = explain.plan_nodes(spark.createDataFrame([("s", PLAN)], "source string, text string"))
    found = {r["rule"]: r for r in signals.signals(nodes).collect()}
    read = found["repeated_read"]
    # the reads carry different columns, which doesn't matter: the chain goes on to the aggregations
    assert (read["subject"], read["n"], read["names"], read["keys"]) == ("complaints_all", 2, ["FileScan", "Exchange", "HashAggregate"], [["k"]])
    assert found["joins"]["flags"]["BroadcastHashJoin"] == "1"
    assert found["shuffles"]["numbers"] == [200]
    assert found["unfiltered_read"]["names"] == ["complaints_all"]


@pytest.mark.parametrize(("hint", "op"), [("merge", "SortMergeJoin"), ("broadcast", "BroadcastHashJoin"), ("shuffle_hash", "ShuffledHashJoin"), ("shuffle_replicate_nl", "CartesianProduct")])
def test_own_plans(spark, hint, op):
    a, b = spark.range(100).withColumn("x", F.col("id") % 7), spark.range(50).withColumnRenamed("id", "y")
    text = printed_plan(a.join(b.hint(hint), F.col("id") == F.col("y")).withColumn("n", F.row_number().over(W.partitionBy("x").orderBy("id"))))
    nodes = explain.plan_nodes(spark.createDataFrame([("s", text)], "source string, text string"))
    found = {r["op"]: r for r in nodes.collect()}
    assert op in found and found["Window"]["partition_by"] == ["x"]


def test_script():
    found = script.facts("​" + SOURCE)
    usage = script.Usage(found)
    assert usage.read_of("complaints_all") == (2, "df", 3)
    reuse = usage.reuse_of("df")
    assert (reuse["reused"], reuse["defined"], reuse["used_by"], reuse["cached"]) == ("base", 4, [("a", 5), ("b", 6)], [])
    lines, counts = script.cleaned(SOURCE)
    assert "password" not in lines[3] and "<secret>" in lines[13] and counts["secrets"] == 1
    assert [o["method"] for o in links.operations_between(found, 7, 11)] == ["count", "save"]
    assert script.facts("def (") is None


def test_whole_block(spark):
    log = Log().begin(4, 4)
    for _ in range(2):
        log.say("Planning scan with bin packing, max size: 1 bytes, open cost is considered as scanning 2 bytes, number of split files: 3, prefetch: false")
    log.job(0, 0, [100] * 3, action="count at script.py:9").end_stage(0, action="count at script.py:9")
    log.job(1, 1, [100] * 3, action="count at script.py:9").end_stage(1, action="count at script.py:9").end_job(0).end_job(1).end(step=60)
    output = f"2024-01-01 10:00:02,000 - INFO - joining the two\n{PLAN}\n2024-01-01 10:00:20,000 - INFO - table is written\n2024-01-01 10:00:21+00:00 other clock\n"
    run = report.Run(logs.lines_of(spark, log.text))
    document = report.report(run, "log")
    block = report.plan_block(spark, run, document, "log", output, SOURCE)
    link = next(x for x in block["links"] if x["rule"] == "repeated_read")
    assert link["log"]["log_grade"] == "multiplicity" and link["log"]["stages"] == ["0.0", "1.0"] and link["script"]["reused"] == "base"
    assert block["coherence"]["status"] == "ok"
    assert [p.get("from_line") for p in block["phases"]] == [None, 7, 11]
    kinds = {c["type"] for c in block["candidates"]}
    assert {"reread_without_cache", "maintenance_in_job", "driver_action", "idle_phase"} <= kinds
    costs = [c["cost_s"] for c in block["candidates"]]
    assert costs == sorted(costs, reverse=True)
    held = report.script_block(SOURCE, "script.py", run, "log")
    assert held["log"] == [{"line": 9, "jobs": 2, "total_s": 5.22, "stages": 2}]
    assert "reread_without_cache" not in report.markdown(document) and "What to do" in report.markdown(document, block)
