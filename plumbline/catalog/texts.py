"""Parsing, classification, masking and checking of text."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import Registry, table
from plumbline.functions import text as tx
from plumbline.operators import etl, stats

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql

PATTERNS = [("licence", "Licensed under"), ("table", r"\|"), ("noise", r"[#*$%&]{3}"), ("digits", "[0-9]{4}"), ("dialogue", r"[!?]")]
CASES = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in PATTERNS)


@query(f"SELECT doc_id, CASE {CASES} ELSE 'plain' END AS class FROM documents")
def classify_first_match(spark, sf):
    return table(spark, sf, "documents").select("doc_id", stats.first_match(F.col("text"), PATTERNS, "plain").alias("class"))


@query(
    "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_replace(url, '[?#].*$', '') AS clean, regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/\\\\]*$') AS base,"
    " CASE WHEN length(url) <= 30 THEN url ELSE substring(url, 1, 27) || '...' END AS cut, regexp_extract(url, '^[a-z]+://([^/]+)', 1) LIKE '%.example.com' AS internal FROM pages"
)
def action_normalize(spark, sf):
    url = F.col("url")
    clean, host = F.regexp_replace(url, "[?#].*$", ""), F.regexp_extract(url, "^[a-z]+://([^/]+)", 1)
    return table(spark, sf, "pages").select(
        "page_id", host.alias("host"), clean.alias("clean"), tx.basename(clean).alias("base"), tx.ellipsis(url, 30).alias("cut"), host.like("%.example.com").alias("internal")
    )


@query(
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT count(*) AS lines, count(*) FILTER (regexp_matches(line, '^[A-Z]')) AS headers,"
    " count(*) FILTER (regexp_matches(line, '^[ \\t]')) AS indented, count(*) FILTER (trim(line) = '') AS blank, max(length(line))::BIGINT AS longest FROM l"
)
def read_stats(spark, sf):
    lines = table(spark, sf, "documents").select(F.explode(F.split("text", "\n", -1)).alias("line"))
    c = F.col("line")
    return lines.agg(
        F.count("*").alias("lines"),
        F.count_if(c.rlike("^[A-Z]")).alias("headers"),
        F.count_if(c.rlike(r"^[ \t]")).alias("indented"),
        F.count_if(F.trim(c) == "").alias("blank"),
        F.max(F.length(c)).cast("long").alias("longest"),
    )


@query(
    "WITH t AS (SELECT substring(regexp_replace(props, '[0-9]+', 'N', 'g'), 1, 120) AS template, event_type, event_id, props FROM events)"
    " SELECT event_type, template, count(*) AS n, min(event_id) AS first_seq, arg_min(props, event_id) AS example FROM t GROUP BY ALL ORDER BY n DESC, first_seq LIMIT 4"
)
def warning_templates(spark, sf):
    """The commonest templates (a top-k report)."""
    groups = stats.template_groups(table(spark, sf, "events"), "props", "event_id", ["event_type"])
    return stats.top_k(groups, [F.desc("n"), F.asc("first_seq")], 4)


@query(
    "WITH c AS (SELECT conv_id, turn, regexp_extract(text, '[0-9]+') AS cited, length(text)::VARCHAR AS actual FROM conversations)"
    " SELECT conv_id, turn, CASE WHEN cited = '' THEN 'missing' WHEN coalesce(try_cast(cited AS DOUBLE) = try_cast(actual AS DOUBLE), trim(cited) = trim(actual)) THEN 'match' ELSE 'differs' END AS status FROM c"
)
def evidence_check(spark, sf):
    from plumbline.operators.evidence import checked

    cited, actual = F.regexp_extract("text", "[0-9]+", 0), F.length("text").cast("string")
    return table(spark, sf, "conversations").select("conv_id", "turn", checked(F.nullif(cited, F.lit("")), actual).alias("status"))


@query(
    "WITH d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS number FROM documents), b AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9]+')) AS number FROM benchmark)"
    " SELECT doc_id, number FROM d WHERE length(number) > 1 AND NOT EXISTS (SELECT 1 FROM b WHERE b.number = d.number)"
)
def numbers_without_base(spark, sf):
    from plumbline.operators.review import numbers

    cited = numbers(table(spark, sf, "documents"), ["doc_id"], "text").where(F.length("number") > 1)
    return cited.join(numbers(table(spark, sf, "benchmark"), [], "text"), "number", "left_anti").select("doc_id", "number")


HEDGES = ["that", "with", "mit", "para", "avec"]


@query("SELECT doc_id, length(text) AS n_chars FROM documents WHERE NOT regexp_matches(text, '(^|[^A-Za-z])(that|with|mit|para|avec)([^A-Za-z]|$)')")
def lexicon_hits(spark, sf):
    from plumbline.operators.review import has_term

    return table(spark, sf, "documents").where(~has_term(F.col("text"), HEDGES)).select("doc_id", F.length("text").cast("long").alias("n_chars"))


_MASKED = (
    "regexp_replace(regexp_replace(regexp_replace(text, 'arn:aws[A-Za-z0-9_-]*:[^\\s,)\"'']+', '<arn>', 'g'), 's3[an]?://[^\\s,)\"'']+', '<path>', 'g'),"
    " '\\b[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\b', '<ip>', 'g')"
)


@query(f"SELECT doc_id, sha256({_MASKED}) AS masked_sha, len(regexp_extract_all({_MASKED}, '<ip>'))::BIGINT AS ips FROM documents")
def mask_paths_ips(spark, sf):
    masked = tx.masked_paths(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(masked, 256).alias("masked_sha"), tx.occurrences(masked, "<ip>").cast("long").alias("ips"))


_SECRET = r"""(?i)\b(password|passwd|pwd|secret|token|api_key|apikey|access_key)(\s*[=:]\s*)("[^"]+"|''[^'']+''|[^\s,;"'']+)"""
_HIDDEN = (
    f"regexp_replace(regexp_replace(regexp_replace(text, '{_SECRET}', '\\1\\2<secret>', 'g'), '\\b(AKIA|ASIA)[0-9A-Z]{{16}}\\b', '<key>', 'g'),"
    " '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '<email>', 'g')"
)


@query(
    f"SELECT doc_id, sha256(h) AS masked_sha, len(regexp_extract_all(h, '<secret>'))::BIGINT AS secrets, len(regexp_extract_all(h, '<email>'))::BIGINT AS emails FROM (SELECT doc_id, {_HIDDEN} AS h FROM documents)"
)
def mask_secrets(spark, sf):
    held = table(spark, sf, "documents").select("doc_id", tx.masked_secrets(F.col("text")).alias("h"))
    return held.select("doc_id", F.sha2("h", 256).alias("masked_sha"), tx.occurrences(F.col("h"), "<secret>").cast("long").alias("secrets"), tx.occurrences(F.col("h"), "<email>").cast("long").alias("emails"))


@query(
    "WITH h AS (SELECT regexp_extract(url, '://([^/]+)', 1) AS host, min(page_id) AS first_seq FROM pages GROUP BY 1)"
    " SELECT host, first_seq, 'host_' || lpad(n, greatest(3, length(n))::INT, '0') AS pseudonym FROM (SELECT *, row_number() OVER (ORDER BY first_seq, host)::VARCHAR AS n FROM h)"
)
def pseudonym_numbers(spark, sf):
    from plumbline.functions.masking import pseudonyms

    hosts = table(spark, sf, "pages").select(F.regexp_extract("url", "://([^/]+)", 1).alias("host"), F.col("page_id").alias("seq"))
    return pseudonyms(hosts, "host", "seq", "host").select(F.col("raw_key").alias("host"), "first_seq", "pseudonym")


@query(
    "WITH v AS (SELECT doc_id, length(text) AS full_size, length(text) // 2 AS short_size, length(text) // 8 AS tiny_size FROM documents)"
    " SELECT doc_id, CASE WHEN (full_size / 3.5)::DOUBLE <= 300 THEN 'full' WHEN (short_size / 3.5)::DOUBLE <= 300 THEN 'short' WHEN (tiny_size / 3.5)::DOUBLE <= 300 THEN 'tiny' END AS variant FROM v"
)
def profile_budget(spark, sf):
    """The first of some variants of a document, from the largest down, that a budget holds."""
    n = F.length("text")
    sizes = [("full", n), ("short", F.floor(n / 2)), ("tiny", F.floor(n / 8))]
    return table(spark, sf, "documents").select("doc_id", etl.rule_case([(size / 3.5 <= 300, name) for name, size in sizes]).alias("variant"))


@query("SELECT doc_id, sha256(text) AS digest, octet_length(encode(text)) AS bytes FROM documents")
def sha_digest(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


@query(
    "SELECT p_partkey, translate(p_name, 'aeiou', 'AEIOU') AS folded, substring(p_brand, 7, 2) AS brand_no, p_brand || '/' || p_type AS joined, string_split(p_name, ' ')[1] AS first_word, p_name LIKE 'small%' AS small,"
    " regexp_extract(p_brand, '#([0-9]+)', 1) AS digits, regexp_replace(p_name, '[aeiou]', '', 'g') AS consonants, starts_with(p_type, 'S') AS s, upper(trim(p_type)) AS type, lpad(p_size::VARCHAR, 4, '0') AS padded FROM part"
)
def string_functions(spark, sf):
    name, brand = F.col("p_name"), F.col("p_brand")
    return table(spark, sf, "part").select(
        "p_partkey",
        F.translate(name, "aeiou", "AEIOU").alias("folded"),
        F.substring(brand, 7, 2).alias("brand_no"),
        F.concat(brand, F.lit("/"), "p_type").alias("joined"),
        F.split(name, " ")[0].alias("first_word"),
        name.like("small%").alias("small"),
        F.regexp_extract(brand, "#([0-9]+)", 1).alias("digits"),
        F.regexp_replace(name, "[aeiou]", "").alias("consonants"),
        F.col("p_type").startswith("S").alias("s"),
        F.upper(F.trim("p_type")).alias("type"),
        F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"),
    )


@query(
    "SELECT conv_id, turn, json_object('conv', conv_id, 'role', role)::VARCHAR AS doc, split_part(conv_id::VARCHAR || '.' || turn::VARCHAR, '.', 1) AS stage, coalesce(try_cast(split_part(conv_id::VARCHAR || '.' || turn::VARCHAR, '.', 2) AS INT), 0)::BIGINT AS attempt FROM conversations"
)
def json_and_ids(spark, sf):
    stage, attempt = tx.split_id(F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.to_json(F.struct(F.col("conv_id").alias("conv"), "role")).alias("doc"), stage.alias("stage"), attempt.cast("long").alias("attempt")
    )
