"""What a plan shows: repeated reads, expansions, sorts, joins, windows, shuffles. One row for each signal of a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.plans.explain import JOINS, SHUFFLES

PLAN = ["source", "plan_no"]
RULES = ("repeated_read", "expand", "sort_aggregate", "in_memory_table", "unfiltered_read", "joins", "windows", "shuffles")
PLAIN = ("Project", "Filter", "ColumnarToRow")


def ids(condition) -> F.Column:
    """Ids of the nodes for which the condition holds, in the plan's order."""
    return F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("idx", "node_id")))), lambda x: x["node_id"])


def common_chain(plan: DataFrame) -> DataFrame:
    """(source, plan_no, table, steps): from the scans of a table that is read several times upwards, as long as their
    ancestors look alike and are different nodes. steps: (position, op, keys), of the first scan."""
    scans = plan.where("op = 'FileScan' AND table IS NOT NULL").withColumn("_reads", F.count("*").over(W.partitionBy(*PLAN, "table"))).where("_reads > 1")
    up = scans.select(*PLAN, "table", "_reads", F.col("idx").alias("scan"), F.posexplode(F.concat(F.array("idx"), "ancestors")).alias("pos", "at"))
    facts = plan.select(*PLAN, F.col("idx").alias("at"), "signature", "op", "keys")
    level = up.join(facts, [*PLAN, "at"]).groupBy(*PLAN, "table", "_reads", "pos").agg(
        F.countDistinct("signature").alias("_looks"), F.countDistinct("at").alias("_nodes"), F.count("*").alias("_n"), F.min_by(F.struct("op", "keys"), "scan").alias("step")
    )
    alike = (F.col("_looks") == 1) & (F.col("_nodes") == F.col("_n")) & (F.col("_n") == F.col("_reads"))
    broken = F.max(F.when(~alike & (F.col("pos") > 0), 1).otherwise(0)).over(W.partitionBy(*PLAN, "table").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    held = level.withColumn("_broken", broken).where("_broken = 0")
    return held.groupBy(*PLAN, "table").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "step"))), lambda x: x["step"]).alias("steps"))


def signals(plan: DataFrame) -> DataFrame:
    """(source, plan_no, id, rule, subject, n, nodes, names, keys, numbers, flags)."""
    op = F.col("op")
    strings = F.array().cast("array<string>")
    none = {"subject": F.lit(None).cast("string"), "nodes": strings, "names": strings, "keys": F.array().cast("array<array<string>>"), "numbers": F.array().cast("array<int>"), "flags": F.create_map().cast("map<string,string>")}

    def row(df: DataFrame, rule: str, n, **values) -> DataFrame:
        found = none | values
        return df.select(*PLAN, F.lit(RULES.index(rule)).alias("_rule"), F.lit(rule).alias("rule"), n.cast("long").alias("n"), *(found[k].alias(k) for k in none))

    scan = op == "FileScan"
    reads = plan.where(scan & F.col("table").isNotNull()).groupBy(*PLAN, "table").agg(F.count("*").alias("n"), ids(F.lit(True)).alias("nodes"), F.bool_or("table_cut").alias("cut")).where("n > 1")
    reads = reads.join(common_chain(plan), [*PLAN, "table"], "left")
    steps = F.col("steps")
    shuffled = F.filter(steps, lambda s: s["op"].isin(*SHUFFLES))
    by_plan = plan.groupBy(*PLAN).agg(
        F.count_if(op == "Expand").alias("expand"),
        ids(op == "Expand").alias("expand_nodes"),
        F.transform(F.array_sort(F.collect_list(F.when(op == "Expand", F.struct("idx", "projections")))), lambda x: x["projections"]).alias("expand_numbers"),
        F.count_if(op == "SortAggregate").alias("sorts"),
        ids(op == "SortAggregate").alias("sort_nodes"),
        F.sort_array(F.collect_set(F.when((op == "SortAggregate") & (F.size("keys") > 0), F.col("keys")))).alias("sort_keys"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(op == "SortAggregate", F.col("functions")))))).alias("sort_functions"),
        F.count_if(op == "ScanExistingRDD").alias("rdd"),
        ids(op == "ScanExistingRDD").alias("rdd_nodes"),
        F.count_if(scan & (F.col("partition_filters") == 0)).alias("unfiltered"),
        F.sort_array(F.collect_set(F.when(scan & (F.col("partition_filters") == 0), F.coalesce("table", F.lit("?"))))).alias("unfiltered_tables"),
        F.sort_array(F.collect_set(F.when(scan & (F.col("partition_filters") == 0) & F.col("data_filters"), F.coalesce("table", F.lit("?"))))).alias("filtered_tables"),
        F.count_if(op.isin(*JOINS)).alias("joins"),
        ids(op == "SortMergeJoin").alias("merge_nodes"),
        F.transform(F.array_sort(F.collect_list(F.when(op == "SortMergeJoin", F.struct("idx", "left_keys")))), lambda x: x["left_keys"]).alias("merge_keys"),
        F.create_map(*[x for j in JOINS for x in (F.lit(j), F.count_if(op == j).cast("string"))]).alias("strategies"),
        F.concat_ws(",", ids(F.coalesce(F.col("function_in_key"), F.lit(False)))).alias("function_nodes"),
        F.concat_ws(",", ids(op.isin("BroadcastNestedLoopJoin", "CartesianProduct"))).alias("loop_nodes"),
        F.count_if(op == "Window").alias("windows"),
        ids((op == "Window") & F.col("unpartitioned")).alias("bare_nodes"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.when(op == "Window", F.struct("idx", "partition_by")))), lambda x: x["partition_by"]), 1, 4).alias("window_keys"),
        F.bool_or(op == "WindowGroupLimit").cast("string").alias("group_limit"),
        F.count_if(op.isin(*SHUFFLES)).alias("shuffles"),
        F.sort_array(F.collect_set("partitions")).alias("shuffle_numbers"),
        F.count_if(op.isin(*SHUFFLES) & (F.col("partitioning") == "single")).cast("string").alias("single"),
    )
    c = F.col
    parts = [
        row(
            reads, "repeated_read", c("n"), subject=c("table"), nodes=c("nodes"), names=F.transform(F.filter(steps, lambda s: ~s["op"].isin(*PLAIN)), lambda s: s["op"]),
            keys=F.slice(F.transform(shuffled, lambda s: F.coalesce(s["keys"], strings)), 1, 2),
            flags=F.create_map(F.lit("repeated_shuffles"), F.size(shuffled).cast("string"), F.lit("table_cut"), c("cut").cast("string")),
        ),
        row(by_plan.where("expand > 0"), "expand", c("expand"), nodes=c("expand_nodes"), numbers=c("expand_numbers")),
        row(by_plan.where("sorts > 0"), "sort_aggregate", c("sorts"), nodes=F.slice("sort_nodes", 1, 12), names=c("sort_functions"), keys=F.slice("sort_keys", 1, 6)),
        row(by_plan.where("rdd > 0"), "in_memory_table", c("rdd"), nodes=c("rdd_nodes")),
        row(by_plan.where("unfiltered > 0"), "unfiltered_read", c("unfiltered"), names=c("unfiltered_tables"), keys=F.array("filtered_tables")),
        row(
            by_plan.where("joins > 0"), "joins", c("joins"), nodes=c("merge_nodes"), keys=c("merge_keys"),
            flags=F.map_concat(F.map_filter("strategies", lambda _, v: v != "0"), F.create_map(F.lit("function_in_key"), c("function_nodes"), F.lit("nested_loop"), c("loop_nodes"))),
        ),
        row(by_plan.where("windows > 0"), "windows", c("windows"), nodes=c("bare_nodes"), keys=c("window_keys"), flags=F.create_map(F.lit("group_limit"), c("group_limit"))),
        row(by_plan.where("shuffles > 0"), "shuffles", c("shuffles"), numbers=c("shuffle_numbers"), flags=F.create_map(F.lit("single_partition"), c("single"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    n = F.row_number().over(W.partitionBy(*PLAN).orderBy("_rule", "subject"))
    return out.withColumn("id", F.format_string("S%d.%d", F.col("plan_no"), n)).drop("_rule")
