"""From log lines to records (a header with what continues it) and from records to typed events."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline import config
from plumbline.functions.text import basename
from plumbline.operators.stats import running_count


def classified(lines: DataFrame) -> DataFrame:
    """Lines with the record they belong to and their kind: header, stack, continuation, stray or blank.

    Records are numbered from 1 in each log; record 0 is what stands before the first header."""
    out = lines.withColumn("_blank", F.btrim("value", F.lit(" \t\r\n\x0b\x0c")) == "")
    out = out.withColumn("_header", ~F.col("_blank") & F.btrim("value", F.lit(" \t\r\n\x0b\x0c")).rlike(config.HEADER))
    out = running_count(out, ["log_id"], "line_no", F.col("_header"), "rec_id")
    out = out.withColumn("_trace", ~F.col("_blank") & ~F.col("_header") & F.col("value").rlike(config.STACK))
    earlier = W.partitionBy("log_id", "rec_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    begun = F.coalesce(F.max("_trace").over(earlier), F.lit(False))
    kind = (
        F.when(F.col("_blank"), "blank")
        .when(F.col("_header"), "header")
        .when(F.col("_trace") | (begun & F.col("value").rlike(r"^\s")), "stack")
        .when(~begun & (F.col("rec_id") > 0) & F.col("value").rlike(config.PLAN_LINE), "continuation")
        .otherwise("stray")
    )
    return out.withColumn("kind", kind).select("log_id", "line_no", "value", "rec_id", "kind")


def read_statistics(lines: DataFrame) -> DataFrame:
    """How many lines of each kind each log has, and its first stray lines."""
    kind = F.col("kind")
    counts = lines.groupBy("log_id").agg(
        F.count("*").alias("lines"),
        *(F.count_if(kind == k).alias(f"{k}_lines") for k in ("header", "continuation", "stack", "stray")),
    )
    first = lines.where("kind = 'stray'").withColumn("_n", F.row_number().over(W.partitionBy("log_id").orderBy("line_no"))).where(F.col("_n") <= config.STRAY_EXAMPLES)
    examples = first.groupBy("log_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.substring(F.trim("value"), 1, config.STRAY_CHARS).alias("text")))), lambda x: x["text"]).alias("stray_examples"))
    return counts.join(examples, "log_id", "left").withColumn("stray_examples", F.coalesce("stray_examples", F.array().cast("array<string>")))


def records(lines: DataFrame) -> DataFrame:
    """One row for each header, and for record 0 where it has a stack, with capped continuation and stack."""
    ordered = W.partitionBy("log_id", "rec_id", "kind").orderBy("line_no")
    held = lines.where("kind IN ('header', 'continuation', 'stack')")
    held = held.withColumn("_n", F.row_number().over(ordered))
    held = held.withColumn("_before", F.coalesce(F.sum(F.length("value")).over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    kind = F.col("kind")
    kept = F.when((kind == "stack") & (F.col("_n") <= config.STACK_LINES), F.struct("line_no", F.rtrim("value").alias("text")))
    more = F.when((kind == "continuation") & (F.col("_before") < config.CONTINUATION_CHARS), F.struct("line_no", F.trim("value").alias("text")))
    texts = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["text"])
    out = held.groupBy("log_id", "rec_id").agg(
        F.min("line_no").alias("line_no"),
        F.max(F.when(kind == "header", F.trim("value"))).alias("_head"),
        texts(more).alias("continuation"),
        texts(kept).alias("stack"),
        F.count_if(kind == "continuation").cast("int").alias("n_continuation"),
        F.count_if(kind == "stack").cast("int").alias("n_stack"),
    )
    part = lambda i, other: F.coalesce(F.regexp_extract("_head", config.HEADER, i), F.lit(other))
    out = out.withColumns({"ts_raw": part(1, ""), "level": part(2, "INFO"), "component": part(3, "stderr"), "msg": part(4, "")})
    return out.drop("_head")


#: Separates the fields that one pass of a pattern leaves.
MARK = "\x01"


def first_words(pattern: str) -> list[str]:
    """The words with which a text that matches begins: one, or those of the group at the beginning."""
    found = re.match(r"\^(?:\(([A-Za-z|]+)\)|([A-Za-z]+)) ", pattern)
    if not found:
        raise ValueError(f"a pattern has to begin with words: {pattern}")
    return (found[1] or found[2]).split("|")


def event(text: str, first: str) -> Column:
    """Kind and fields of the text in a column by the first pattern of the catalogue that it matches; null if there is none.

    first: the column of the text's first word. Only the few patterns that begin with it are tried, and one pass of the
    pattern that matches leaves all fields; those that are empty are left out. One expression of SQL: building it call by
    call would take seconds."""
    by_word: dict[str, list[str]] = {}
    for name, pattern, fields in config.EVENTS:
        marks = "".join(f"${i}{MARK}" for i in range(1, len(fields) + 1))
        names = ", ".join(f"'{f}'" for f in fields)
        held = f"slice(split(regexp_replace({text}, r'{pattern}', '{marks}'), '{MARK}'), 1, {len(fields)})"
        data = f"map_filter(map_from_arrays(array({names}), {held}), (k, v) -> v <> '')" if fields else "CAST(map() AS map<string,string>)"
        for word in first_words(pattern):
            by_word.setdefault(word, []).append(f"WHEN {text} RLIKE r'{pattern}' THEN named_struct('kind', '{name}', 'data', {data})")
    tries = " ".join(f"WHEN '{word}' THEN CASE {' '.join(whens)} END" for word, whens in by_word.items())
    return F.expr(f"CASE {first} {tries} END")


def call_site(action: Column) -> Column:
    """`method at file:line` in its parts; null if the text isn't one."""
    part = lambda i: F.regexp_extract(action, config.CALL_SITE, i)
    found = F.struct(part(1).alias("method"), part(2).alias("file"), part(3).cast("int").alias("line"), part(1).isin(*config.ENGINE_METHODS).alias("internal"))
    return F.when(action.rlike(config.CALL_SITE), found)


def normalized_action(action: Column) -> Column:
    return F.regexp_replace(F.trim(action), config.TEMP_DIR, "")


def events(recs: DataFrame) -> DataFrame:
    """Events in log order: (log_id, seq, ts_raw, ts, level, component, event_type, data, call_site, stack, n_stack, msg).

    A record is matched with all its lines first, then by its first line. What matches nothing stays if its level is WARN
    or above. A stack under a lower level becomes an event of its own, after its record's."""
    full = F.concat_ws(" ", F.col("msg"), F.array_join("continuation", " "))
    held = recs.withColumn("_full", F.when(F.size("continuation") > 0, full))
    word = lambda c: F.substring_index(c, " ", 1)
    held = held.withColumns({"_first": word("msg"), "_first_full": word("_full")})
    held = held.withColumns({"_by_full": event("_full", "_first_full"), "_by_msg": event("msg", "_first")})
    held = held.withColumn("_event", F.coalesce("_by_full", "_by_msg"))
    kind, data = F.col("_event.kind"), F.col("_event.data")
    alert = F.col("level").isin(*config.ALERT_LEVELS)
    action = F.when(kind.isin("job_start", "map_stage_job_start"), normalized_action(data["action"]))
    rdd = F.when(kind == "stage_tasks_submitted", F.substring(normalized_action(data["rdd_desc"]), 1, config.RDD_CHARS))
    fixed = F.map_filter(F.create_map(F.lit("action"), action, F.lit("rdd_desc"), rdd), lambda _, v: v.isNotNull())
    fixed = F.when(fixed_kinds(kind), F.map_concat(F.map_filter(data, lambda k, _: ~F.map_contains_key(fixed, k)), fixed)).otherwise(data)
    site = call_site(action)
    none = F.array().cast("array<string>")
    main = F.struct(
        F.lit(0).alias("sub"),
        "level",
        "component",
        F.coalesce(kind, F.lit(config.UNMATCHED)).alias("event_type"),
        F.when(kind.isNull(), F.create_map(F.lit("msg"), F.col("msg"))).otherwise(fixed).alias("data"),
        site.alias("call_site"),
        F.when(alert, F.col("stack")).otherwise(none).alias("stack"),
        F.when(alert, F.col("n_stack")).otherwise(0).alias("n_stack"),
        "n_continuation",
    )
    said = F.concat(F.lit("exception without a header, after "), "level", F.lit(" "), "component")
    own = F.struct(
        F.lit(1).alias("sub"),
        F.lit("ERROR").alias("level"),
        F.lit("stderr").alias("component"),
        F.lit(config.UNMATCHED).alias("event_type"),
        F.create_map(F.lit("msg"), F.trim(F.try_element_at("stack", F.lit(1))), F.lit("origin"), said).alias("data"),
        F.when(F.lit(False), site).alias("call_site"),
        F.slice("stack", F.lit(2), F.greatest(F.size("stack") - 1, F.lit(0))).alias("stack"),
        (F.col("n_stack") - 1).alias("n_stack"),
        F.lit(0).alias("n_continuation"),
    )
    # one pass: a record gives none, one or two events; a filter after it would try all patterns once more
    each = F.filter(F.array(F.when(kind.isNotNull() | alert, main), F.when(~alert & (F.size("stack") > 0), own)), lambda x: x.isNotNull())
    ts = F.try_to_timestamp(F.nullif("ts_raw", F.lit("")), F.lit(config.TIME_FORMAT)).cast("timestamp_ntz").alias("ts")
    out = held.select("log_id", "rec_id", "ts_raw", ts, F.inline(each))
    return out.withColumn("seq", F.col("rec_id") * 2 + F.col("sub")).drop("rec_id", "sub")


def fixed_kinds(kind: Column) -> Column:
    """Events of which a field is written anew."""
    return kind.isin("job_start", "map_stage_job_start", "stage_tasks_submitted")


def parsed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events and read statistics of logs."""
    kinds = classified(lines)
    return events(records(kinds)), read_statistics(kinds)


def script_name(path: Column) -> Column:
    return F.lower(basename(path))
