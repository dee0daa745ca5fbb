"""Checking what is claimed of a run against the tables of the run."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import tolerant_equal

#: Fields by which an item of a list can be named in a path, besides its position.
NAMES = ("stage_key", "id", "action", "code", "template", "rule")


def checked(cited: Column, actual: Column, exists: Column | None = None) -> Column:
    """match, differs, or missing for what isn't there (or isn't cited)."""
    there = actual.isNotNull() if exists is None else exists
    return F.when(cited.isNull() | ~there, "missing").when(tolerant_equal(cited, actual), "match").otherwise("differs")


def expected_class(inconsistent: Column, failed: Column, degraded: Column) -> Column:
    return F.when(inconsistent, "inconclusive").when(failed, "failed").when(degraded, "degraded").otherwise("healthy")


def paths(document, prefix: str = ""):
    """(path, value) of everything in a document; items of lists by position and by each of their names."""
    yield prefix, document
    if isinstance(document, dict):
        for key, value in document.items():
            yield from paths(value, f"{prefix}.{key}" if prefix else str(key))
    elif isinstance(document, list):
        taken = set()
        for i, item in enumerate(document):
            names = [str(item[n]) for n in NAMES if isinstance(item, dict) and item.get(n) is not None]
            for name in dict.fromkeys([*names, str(i)]):
                if name not in taken:  # the first item of a name has it, and names come before positions
                    taken.add(name)
                    yield from paths(item, f"{prefix}[{name}]")


def as_text(value) -> str:
    if value is None or isinstance(value, bool):
        return {None: "None", True: "True", False: "False"}[value]
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True) if isinstance(value, (dict, list)) else repr(value)


def flattened(spark, document: dict) -> DataFrame:
    """(path, actual) of a document of bounded size."""
    return spark.createDataFrame([(p, as_text(v)) for p, v in paths(document) if p], "path string, actual string")


def evidence_checks(claims: DataFrame, flat: DataFrame) -> DataFrame:
    """claims (where, path, cited) with actual and status, by an equi join on the path."""
    held = claims.withColumn("path", F.regexp_replace(F.trim("path"), r"\[\s*([^\]]*?)\s*\]", "[$1]"))
    found = flat.select(F.col("path").alias("_p"), "actual", F.lit(True).alias("_there"))
    out = held.join(found, F.col("path") == F.col("_p"), "left").drop("_p")
    return out.withColumn("status", checked(F.col("cited"), F.col("actual"), F.coalesce("_there", F.lit(False)))).drop("_there")


def totals(checks: DataFrame) -> DataFrame:
    n = {s: F.count_if(F.col("status") == s) for s in ("match", "differs", "missing")}
    out = checks.agg(*(c.alias(s) for s, c in n.items()), F.count("*").alias("all"))
    return out.withColumn("pct_match", F.when(F.col("all") > 0, F.round(100 * F.col("match") / F.col("all"), 1)))


def class_of_runs(verdicts: DataFrame, context: DataFrame, failures: DataFrame, attempts: DataFrame, found: DataFrame) -> DataFrame:
    """(log_id, class): the first rung of the ladder that holds."""
    bad = failures.where("event_type IN ('executor_lost', 'stage_failed')").groupBy("log_id").agg(F.lit(True).alias("_bad"))
    again = attempts.groupBy("log_id").agg((F.sum("task_retries") > 0).alias("_again"))
    serious = found.groupBy("log_id").agg(F.bool_or(F.col("severity").isin("HIGH", "MEDIUM")).alias("_serious"))
    held = verdicts.join(context.select("log_id", "exit_code"), "log_id", "left").join(bad, "log_id", "left").join(again, "log_id", "left").join(serious, "log_id", "left")
    degraded = F.coalesce("_bad", F.lit(False)) | F.coalesce("_again", F.lit(False)) | F.coalesce("_serious", F.lit(False))
    return held.select("log_id", expected_class(~F.col("ok"), F.coalesce("exit_code", F.lit("")) != "0", degraded).alias("class"))
