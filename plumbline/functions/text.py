"""Scalar expressions over text: call sites, masks, truncation, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of what is masked.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IPV4 = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"
ARN = r"arn:aws[A-Za-z0-9_-]*:[^\s,)\"']+"
OBJECT_PATH = r"s3[an]?://[^\s,)\"']+"
ACCESS_KEY = r"\b(AKIA|ASIA)[0-9A-Z]{16}\b"
SECRET = r"(?i)\b(password|passwd|pwd|secret|token|api_key|apikey|access_key)(\s*[=:]\s*)(\"[^\"]+\"|'[^']+'|[^\s,;\"']+)"


def ellipsis(text: Column, width: int) -> Column:
    """At most width characters, the last three dots if any are cut."""
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.substring(text, 1, width - 3), F.lit("...")))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def masked_paths(text: Column) -> Column:
    """Resource names and object paths, then IPv4 addresses, as tokens."""
    out = F.regexp_replace(F.regexp_replace(text, ARN, "<arn>"), OBJECT_PATH, "<path>")
    return F.regexp_replace(out, IPV4, "<ip>")


def masked_secrets(text: Column) -> Column:
    out = F.regexp_replace(text, SECRET, "$1$2<secret>")
    return F.regexp_replace(F.regexp_replace(out, ACCESS_KEY, "<key>"), EMAIL, "<email>")


def occurrences(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def split_id(value: Column) -> tuple[Column, Column]:
    """The two parts of an id like 249.1; the second is 0 if there is none."""
    return F.split_part(value, F.lit("."), F.lit(1)), F.coalesce(F.split_part(value, F.lit("."), F.lit(2)).try_cast("int"), F.lit(0))


def human_duration(seconds: Column) -> Column:
    """`m min ss s`, or `s.d s` below a minute."""
    whole = F.floor(seconds).cast("long")
    long = F.format_string("%d min %02d s", (whole / 60).cast("long"), whole % 60)
    return F.when(seconds < 60, F.format_string("%.1f s", seconds)).otherwise(long)


def human_bytes(size: Column) -> Column:
    """Bytes below 1024, else with one digit in the largest unit that leaves 1 or more, up to TB."""
    out = F.format_string("%d B", size.cast("long"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(size >= 1024**power, F.format_string(f"%.1f {unit}", size.cast("double") / F.lit(float(1024**power)))).otherwise(out)
    return out


def tolerant_equal(a: Column, b: Column) -> Column:
    """Equal as numbers if both are numbers, else equal as trimmed text."""
    return F.coalesce(a.try_cast("double") == b.try_cast("double"), F.trim(a) == F.trim(b), F.lit(False))


def budget_tokens(text: Column, per_token: float = 3.5) -> Column:
    """How many tokens a text is reckoned to have."""
    return (F.length(text) / F.lit(per_token)).cast("long")
