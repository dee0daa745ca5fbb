"""Rules that criticise an answer about a run: what it claims, cites, recommends and leaves out."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that mark a hypothesis, and technical terms that need a basis.
HEDGES = ["may", "might", "could", "suggests", "hint", "possible", "possibly", "investigate", "hypothesis", "probable", "probably", "pode", "sugere", "investigar"]
TECHNICAL = [
    "broadcast", "cache", "persist", "repartition", "coalesce", "salting", "skewjoin", "spark.sql.", "spark.executor", "spark.driver", "spark.dynamicallocation",
    "memory", "overhead", "parallelismfirst", "minpartitionsize", "advisorypartition", "optimize", "z-order", "zorder", "garbage", "kryo", "speculation",
]
MOST_BOTTLENECKS = 5


def has_term(text: Column, terms: Sequence[str]) -> Column:
    """Whether one of the terms stands in the text as a word."""
    return text.rlike("(^|[^A-Za-z])(" + "|".join(terms) + ")([^A-Za-z]|$)")


def numbers(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, number) of the runs of digits in a text, each once."""
    return df.select(*keys, F.explode(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))).alias("number")).distinct()


NUMBER = r"(?<![\w.])\d+(?:[.,]\d+)?(?!\w)"


def spelt(number: Column) -> Column:
    """Spellings under which a number counts as the same."""
    plain = F.replace(number, F.lit(","), F.lit("."))
    short = F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.array_distinct(F.array(number, plain, short))


def numbers_without_basis(texts: DataFrame, document: DataFrame, least: float = 10) -> DataFrame:
    """(where, number): numbers above least in texts (where, text) that a document (text) doesn't have."""
    cited = texts.select("where", F.explode(F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0))).alias("number")).distinct()
    cited = cited.where(F.replace("number", F.lit(","), F.lit(".")).try_cast("double") > least)
    base = document.select(F.explode(F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0))).alias("_n")).select(F.explode(spelt(F.col("_n"))).alias("_b")).distinct()
    found = cited.select("where", "number", F.explode(spelt(F.col("number"))).alias("_s")).join(base, F.col("_s") == F.col("_b"), "left_semi").select("where", "number")
    return cited.join(found, ["where", "number"], "left_anti")


ANSWER = (
    "classification string, reason string, evidence array<struct<path:string,value:string>>, bottlenecks array<struct<id:string,title:string,finding:string,statement:string,"
    "candidate:string,evidence:array<struct<path:string,value:string>>>>, recommendations array<struct<id:string,kind:string,text:string,supported_by:array<string>,script_lines:array<int>>>, missing array<string>"
)


def answer_table(spark, answer: dict | str) -> DataFrame:
    """One row with the answer as typed columns; what doesn't fit is null."""
    text = answer if isinstance(answer, str) else json.dumps(answer, ensure_ascii=False)
    return spark.createDataFrame([(text,)], "j string").select(F.from_json("j", ANSWER).alias("a")).select("a.*")


def repaired_json(text: str) -> dict:
    """The first JSON object in a text, with typographic quotes made plain if it can't be read otherwise."""
    start = text.find("{")
    if start < 0:
        raise ValueError("no JSON object in the answer")
    held = text[start:]
    try:
        return json.JSONDecoder().raw_decode(held)[0]
    except ValueError:
        return json.JSONDecoder().raw_decode(held.translate(str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'"})))[0]


def problems(answer: DataFrame) -> DataFrame:
    """(problem, subject): repeated ids and references to bottlenecks that aren't there."""
    b = answer.select(F.explode("bottlenecks.id").alias("id"))
    r = answer.select(F.explode("recommendations").alias("r")).select("r.*")
    every = b.union(r.select("id")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated id").alias("problem"), F.col("id").alias("subject"))
    cited = r.select(F.explode("supported_by").alias("id")).join(b, "id", "left_anti").select(F.lit("unknown bottleneck"), "id")
    return every.union(cited)


def review(spark, answer: DataFrame, document: dict, checks: DataFrame, expected: str, script_lines: Sequence[int] = (), candidates: Sequence[str] = ()) -> DataFrame:
    """(kind, where, said, detail) of everything in an answer that one of the rules objects to.

    document: the summary that the answer speaks of; checks: its cited evidence, checked (where, path, cited, status)."""
    text = spark.createDataFrame([(json.dumps(document, ensure_ascii=False),)], "text string")
    b = answer.select(F.explode("bottlenecks").alias("b")).select("b.*")
    r = answer.select(F.explode("recommendations").alias("r")).select("r.*")
    found = spark.createDataFrame([(f.get("id"), f.get("severity"), f.get("rule")) for f in document.get("findings", [])], "fid string, severity string, rule string")
    row = lambda df, kind, where, said, detail: df.select(F.lit(kind).alias("kind"), where.alias("where"), said.alias("said"), detail.alias("detail"))
    c, lit = F.col, F.lit
    texts = answer.select(lit("classification").alias("where"), c("reason").alias("text")).union(b.select("id", F.concat_ws(" ", "title", "statement"))).union(r.select("id", "text"))
    lower = F.lower("text")
    terms = F.filter(F.array(*map(lit, TECHNICAL)), lambda t: F.contains(lower, t) & ~F.contains(lit(json.dumps(document, ensure_ascii=False).lower()), t))
    own = F.concat(lit("findings["), c("finding"), lit("]"))
    info = b.join(found, c("finding") == c("fid")).where(c("severity") == "INFO").where(~F.exists(F.coalesce("evidence", F.array().cast("array<struct<path:string,value:string>>")), lambda e: ~F.startswith(e["path"], own)))
    whole = answer.select(F.to_json(F.struct("*")).alias("_all"))
    high = found.where("severity = 'HIGH'").join(b.select(c("finding").alias("fid")), "fid", "left_anti").crossJoin(F.broadcast(whole)).where(~F.contains("_all", F.concat(lit("["), "fid", lit("]"))))
    lines = spark.createDataFrame([(int(x),) for x in script_lines], "line int")
    gone = r.select("id", F.explode("script_lines").alias("line")).join(lines, "line", "left_anti").groupBy("id").agg(F.sort_array(F.collect_set("line")).alias("lines"))
    named = spark.createDataFrame([(x,) for x in candidates], "cand string").join(b.select(c("candidate").alias("cand")).where("cand IS NOT NULL"), "cand", "left_anti")
    dropped = answer.select(F.concat_ws(" ", "missing").alias("_m"))
    ignored = named.crossJoin(F.broadcast(dropped)).where(~F.contains("_m", "cand"))
    parts = [
        row(answer.where(c("classification") != expected), "CLASS", lit("classification"), c("classification"), lit(f"the criteria give {expected}")),
        row(checks.where("status <> 'match'"), "EVIDENCE", c("where"), F.concat_ws(" = ", "path", "cited"), c("status")),
        row(numbers_without_basis(texts, text).groupBy("where").agg(F.concat_ws(", ", F.sort_array(F.collect_set("number"))).alias("n")), "NUMBER_WITHOUT_BASIS", c("where"), c("n"), lit("not in the summary")),
        row(b.where(~has_term(F.lower("statement"), HEDGES)), "STATED_AS_FACT", c("id"), c("statement"), lit("no word marks a hypothesis")),
        row(r.where("kind = 'optimise'").withColumn("_t", terms).where(F.size("_t") > 0), "TERM_WITHOUT_BASIS", c("id"), c("text"), F.concat_ws(", ", "_t")),
        row(info, "ONLY_INFO", c("id"), c("title"), c("finding")),
        row(high, "HIGH_LEFT_OUT", c("fid"), lit("(not mentioned)"), c("rule")),
        row(ignored, "CANDIDATE_IGNORED", c("cand"), lit("(not mentioned)"), lit("neither used nor dropped with a reason")),
    ]
    if script_lines:
        parts.append(row(gone, "LINE_NOT_THERE", c("id"), c("lines").cast("string"), lit("not in the script")))
    if document.get("plan"):
        parts.append(row(r.where(c("kind").eqNullSafe("optimise") & (F.size(F.coalesce("script_lines", F.array().cast("array<int>"))) == 0)), "OPTIMISE_WITHOUT_PLACE", c("id"), c("text"), lit("no script lines")))
    if candidates:
        parts.append(row(answer.where(F.size("bottlenecks") > MOST_BOTTLENECKS), "LONG_ANSWER", lit("bottlenecks"), F.size("bottlenecks").cast("string"), lit(f"more than {MOST_BOTTLENECKS}")))
    if document.get("unavailable"):
        parts.append(row(answer.where(F.coalesce(F.size("missing"), lit(0)) <= 0), "NO_LIMITS", lit("missing"), lit("[]"), lit("measures are unavailable, no limit is named")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
