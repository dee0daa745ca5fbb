"""Pseudonyms for hosts, addresses and paths. Equal things have one pseudonym and different ones have different ones;
they are numbered by first appearance."""

from __future__ import annotations

import ipaddress
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F

from plumbline.functions.text import ARN, OBJECT_PATH
from plumbline.operators.stats import ranked

# Shapes of candidates. An address is confirmed before it is masked.
EC2_HOST = r"\bip-(\d{1,3}(?:-\d{1,3}){3})(?:\.[\w-]+)*(?::\d+)?"
IN_BRACKETS = r"\[([0-9a-fA-F:.]+)\](?::\d+)?"
PLAIN_IPV4 = r"(?<![\w.])(\d{1,3}(?:\.\d{1,3}){3})(?::\d+)?(?![\w.])"
PLAIN_IPV6 = r"(?<![\w:.\[])((?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4})(?![\w:.\]])"


def canonical_ip(text: str | None) -> str | None:
    """An address in its usual spelling; none for what is no address, unspecified or a loopback."""
    try:
        ip = ipaddress.ip_address(text or "")
    except ValueError:
        return None
    return None if ip.is_unspecified or ip.is_loopback else str(ip)


@F.arrow_udf(T.StringType())
def normalized_ip(candidates: pa.Array) -> pa.Array:
    return pa.array([canonical_ip(x.as_py()) for x in candidates], pa.string())


def pseudonyms(df: DataFrame, key: str, seq: str, prefix: str) -> DataFrame:
    """(kind, raw_key, first_seq, pseudonym) of each key, numbered by first appearance."""
    first = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("raw_key")).agg(F.min(seq).alias("first_seq"))
    first = ranked(first, ["first_seq", "raw_key"], "_n")
    n = F.col("_n").cast("string")
    number = F.lpad(n, F.greatest(F.length(n), F.lit(3)), F.lit("0"))
    return first.select(F.lit(prefix).alias("kind"), "raw_key", "first_seq", F.concat(F.lit(f"{prefix}_"), number).alias("pseudonym"))


def host_key(host: Column) -> Column:
    """What names a host: brackets and port gone, names that spell an address as that address, else lower case."""
    h = F.trim(host)
    inner = F.regexp_extract(h, r"^\[(.+)\](?::\d+)?$", 1)
    h = F.when(inner != "", inner).when(normalized_ip(h).isNull(), F.regexp_replace(h, r":\d+$", "")).otherwise(h)
    named = F.regexp_extract(h, f"^{EC2_HOST[2:]}$", 1)
    h = F.when(named != "", F.translate(named, "-", ".")).otherwise(h)
    return F.coalesce(normalized_ip(h), F.lower(h))


def _candidates(text: Column) -> Column:
    """Array of (found, key, kind) of what may have to be masked, in the order in which it is replaced."""

    def of(pattern: str, group: int, kind: str) -> Column:
        whole, inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        return F.transform(F.arrays_zip(whole.alias("found"), inner.alias("key")), lambda z: F.struct(z["found"].alias("found"), z["key"].alias("key"), F.lit(kind).alias("kind")))

    return F.array_distinct(
        F.concat(of(ARN, 0, "path"), of(OBJECT_PATH, 0, "path"), of(EC2_HOST, 1, "ec2"), of(IN_BRACKETS, 1, "host"), of(PLAIN_IPV4, 1, "host"), of(PLAIN_IPV6, 1, "host"))
    )


def masked_documents(df: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """df with every text inside the JSON document of a column masked, whatever its depth; keys, numbers and the order of
    elements stay. A document that can't be read is masked as one text, a null stays. Also the table of pseudonyms.

    key: a column that orders rows and tells them apart. Texts are taken apart by place, masked as rows, and put back."""
    parts = df.select(F.col(key).alias("_doc"), F.explode(F.from_json(_taken_apart(F.col(column)), "array<struct<at:int,text:string>>")).alias("_p")).select("_doc", "_p.at", "_p.text")
    swapped, names = masked(parts, ["_doc", "at"], ["text"])
    each = swapped.groupBy("_doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]).alias("_texts"))
    out = df.join(each, df[key].eqNullSafe(F.col("_doc")), "left")
    return out.withColumn(column, _put_together(F.col(column), F.coalesce("_texts", F.array().cast("array<string>")))).select(*df.columns), names


def _texts_of(value, change):
    """The value with each text in it, but for keys, as change says."""
    if isinstance(value, str):
        return change(value)
    if isinstance(value, list):
        return [_texts_of(x, change) for x in value]
    return {k: _texts_of(x, change) for k, x in value.items()} if isinstance(value, dict) else value


def _document(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


@F.arrow_udf(T.StringType())
def _taken_apart(documents: pa.Array) -> pa.Array:
    out = []
    for held in documents.to_pylist():
        found: list[str] = []
        if held is not None:
            _texts_of(_document(held), found.append)
        out.append(json.dumps([{"at": i, "text": t} for i, t in enumerate(found)]))
    return pa.array(out, pa.string())


@F.arrow_udf(T.StringType())
def _put_together(documents: pa.Array, texts: pa.Array) -> pa.Array:
    out = []
    for held, by in zip(documents.to_pylist(), texts.to_pylist()):
        if held is not None:
            rest, value = iter(by), _document(held)
            new = _texts_of(value, lambda _: next(rest))
            held = new if value is held else json.dumps(new, ensure_ascii=False)
        out.append(held)
    return pa.array(out, pa.string())


def masked(df: DataFrame, seq: list[str], texts: list[str], hosts: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """df with its texts and host columns masked, and the table of pseudonyms.

    seq: columns that order rows and tell them apart. Candidates are gathered once and their distinct keys confirmed and
    numbered; the replacements come back by a join, for rows that have any."""
    place = F.struct(*seq)
    found = None
    for i, c in enumerate(texts):
        part = df.select(place.alias("_at"), F.lit(i).alias("_col"), F.posexplode(_candidates(F.col(c))).alias("_pos", "_f"))
        part = part.select("_at", "_col", "_pos", F.col("_f.found").alias("found"), F.col("_f.kind").alias("kind"), F.when(F.col("_f.kind") == "ec2", F.translate("_f.key", "-", ".")).otherwise(F.col("_f.key")).alias("key"))
        found = part if found is None else found.unionByName(part)
    for i, c in enumerate(hosts, len(texts)):
        part = df.where(F.col(c).isNotNull()).select(place.alias("_at"), F.lit(i).alias("_col"), F.lit(0).alias("_pos"), F.col(c).alias("found"), F.lit("name").alias("kind"), host_key(F.col(c)).alias("key"))
        found = part if found is None else found.unionByName(part)
    key = F.when(F.col("kind").isin("path", "name"), F.col("key")).otherwise(normalized_ip("key"))
    found = found.withColumn("key", key).where("key IS NOT NULL").withColumn("kind", F.when(F.col("kind") == "path", "path").otherwise("host"))
    ordered = found.withColumn("_seq", F.struct("_at", "_col", "_pos"))
    names = pseudonyms(ordered.where("kind = 'host'"), "key", "_seq", "host").unionByName(pseudonyms(ordered.where("kind = 'path'"), "key", "_seq", "path"))
    named = found.join(names, (found["key"] == names["raw_key"]) & (found["kind"] == names["kind"])).select("_at", "_col", "found", "pseudonym", names["kind"].alias("kind"))
    # longer finds first: none is replaced inside another
    each = F.struct((-F.length("found")).alias("n"), "found", F.when(F.col("kind") == "host", F.concat(F.lit("["), "pseudonym", F.lit("]"))).otherwise(F.col("pseudonym")).alias("by"), F.col("pseudonym").alias("plain"))
    swaps = named.groupBy("_at").pivot("_col", list(range(len(texts) + len(hosts)))).agg(F.sort_array(F.collect_set(each)))
    out = df.withColumn("_at", place).join(swaps, "_at", "left")
    for i, c in enumerate(texts):
        none = F.array().cast(swaps.schema[str(i)].dataType)
        out = out.withColumn(c, F.aggregate(F.coalesce(F.col(str(i)), none), F.col(c), lambda t, s: F.replace(t, s["found"], s["by"])))
    for i, c in enumerate(hosts, len(texts)):
        out = out.withColumn(c, F.try_element_at(F.col(str(i)), F.lit(1))["plain"])
    return out.select(*df.columns), names
