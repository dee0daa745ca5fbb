"""Building blocks of batch jobs and matching, on tiny tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import etl, evidence, stats
from plumbline.sources import sinks


def test_cleaning(spark):
    df = spark.createDataFrame([(" 7 ", None, "2024-01-31"), ("x", "", "31/01"), (None, "N/A", None)], "a string, b string, c string")
    got = etl.cleaned(df, {"a": ("int", 0), "b": ("string", "N/D"), "c": ("date", "1800-01-01")}).collect()
    assert [tuple(map(str, r)) for r in got] == [("7", "N/D", "2024-01-31"), ("0", "N/D", "1800-01-01"), ("0", "N/D", "1800-01-01")]


def test_branches_and_only_value(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "a"), (2, "b"), (3, None)], "k int, x string")
    got = {r["k"]: r["v"] for r in df.groupBy("k").agg(etl.only_value("x").alias("v")).collect()}
    assert got == {1: "a", 2: None, 3: None}  # nulls don't count
    both = etl.by_two_branches(df, F.col("x") == "a", lambda d: d.withColumn("s", F.lit("yes")), lambda d: d.withColumn("s", F.lit("no")))
    assert sorted((r["k"], r["s"]) for r in both.collect()) == [(1, "no"), (1, "yes"), (2, "no"), (2, "yes"), (3, "no")]


def test_queue():
    import pandas as pd

    rows = [("open", 1, 5), ("open", 2, 5), ("close", 3, 5), ("close", 4, 9), *(("open", 10 + i, i) for i in range(7)), ("close", 20, 99), ("close", 21, 5), ("close", 22, 0)]
    got = stats.queue_match(pd.DataFrame(rows, columns=["kind", "seq", "size"]))
    assert got == [(1, 3), (15, 21), (10, 22)]  # the opening at 2 went when too many waited


def test_intervals(spark):
    spans = spark.createDataFrame([(1, 0, 10), (1, 10, None), (2, 5, 7)], "k int, a int, b int")
    facts = spark.createDataFrame([(1, 0, "x"), (1, 9, "y"), (1, 10, "z"), (1, -1, "n"), (2, 7, "n"), (2, 5, "w"), (3, 1, "n")], "k int, t int, v string")
    got = stats.interval_of(facts, spans, ["k"], "t", "a", "b", [])
    assert sorted((r["v"], r["a"]) for r in got.collect()) == [("w", 5), ("x", 0), ("y", 0), ("z", 10)]


def test_running_count_and_contains(spark):
    df = spark.createDataFrame([("l", i, i % 3 == 0) for i in range(50)], "log string, n int, f boolean")
    got = {r["n"]: r["c"] for r in stats.running_count(df, ["log"], "n", F.col("f"), "c", block=7).collect()}
    assert got == {i: i // 3 + 1 for i in range(50)}
    texts = spark.createDataFrame([(1, "one two three four"), (2, "xone two threex"), (3, "ab")], "t int, text string")
    needles = spark.createDataFrame([("A", "one two three"), ("B", "ab"), ("C", "two four six")], "n string, needle string")
    assert sorted(map(tuple, stats.contains_join(texts, needles, "text", "needle", "t", "n").collect())) == [(1, "A"), (2, "A"), (3, "B")]


def test_text(spark):
    df = spark.createDataFrame([("249.1", 75.0, "0", "0.0"), ("7", 3.26, " a ", "a")], "id string, s double, a string, b string")
    stage, attempt = tx.split_id(F.col("id"))
    got = df.select(stage, attempt, tx.human_duration(F.col("s")), tx.tolerant_equal(F.col("a"), F.col("b")), tx.ellipsis(F.lit("abcdefgh"), 6)).collect()
    assert [tuple(r) for r in got] == [("249", 1, "1 min 15 s", True, "abc..."), ("7", 0, "3.3 s", True, "abc...")]


def test_paths():
    flat = dict(evidence.paths({"stages": [{"stage_key": "3.1", "n": 5}, {"n": 6}], "a": {"b.c": None}}))
    assert flat["stages[3.1].n"] == 5 and flat["stages[1].n"] == 6 and flat["stages[0].n"] == 5


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    sinks.overwrite(df, str(tmp_path / "t"))
    sinks.overwrite(df.limit(1), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    sinks.json_lines(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert {r["document"] for r in sinks.as_json(df).collect()} == {'{"a":1}', '{"a":2,"b":"x"}'}
    assert sinks.stored(df, "t").count() == 2
