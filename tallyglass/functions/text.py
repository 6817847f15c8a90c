"""Text functions: timestamps, tags, folding of typographic variants, style votes, versions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..llm.common import small_batches

# Typographic variants and what they are folded to.
SINGLE_QUOTES = "´`’‘‚′ʼʻ‹›‛"
DOUBLE_QUOTES = "„“”«»″‟＂〝〞"
DASHES = "‐‑‒–—―−⁃﹘﹣－"
SEVERAL = {"…": "...", "․": ".", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
SPACES = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
DROPPED = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
STYLES = "biu"


def fmt_ts(ms: Column) -> Column:
    """HH:MM:SS,mmm of whole milliseconds; negative ones count as 0."""
    ms = F.greatest(ms.cast("long"), F.lit(0))
    part = lambda by: F.lpad((F.floor(ms / by) % 60).cast("string"), 2, "0")
    hours = F.floor(ms / 3_600_000).cast("string")
    hours = F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours)
    return F.concat(hours, F.lit(":"), part(60_000), F.lit(":"), part(1000), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))


def strip_tags(text: Column) -> Column:
    """Text without the style tags b, i, u."""
    return F.regexp_replace(text, r"(?i)</?[biu]>", "")


def fold(text: Column) -> Column:
    """Typographic variants to plain ones, for text in composed form."""
    plain = F.translate(text, SINGLE_QUOTES + DOUBLE_QUOTES + DASHES + SPACES + DROPPED, "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + "-" * len(DASHES) + " " * len(SPACES))
    for char, several in SEVERAL.items():
        plain = F.replace(plain, F.lit(char), F.lit(several))
    return plain


@F.pandas_udf(T.StringType())
def compose(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Canonical composition (NFC), which no built-in function gives."""
    for s in parts:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t), na_action="ignore")


def simplify(text: Column) -> Column:
    """Compose, then fold. Text goes to Python in batches of bounded rows and bytes."""
    if session := SparkSession.getActiveSession():
        small_batches(session)
    return fold(compose(text))


def majority_style(styles: Column) -> Column:
    """The flags of more than half of an array of styles, in their order."""
    def often(flag: str) -> Column:
        return F.when(2 * F.size(F.filter(styles, lambda s: s.contains(flag))) > F.size(styles), flag).otherwise("")

    return F.concat(*map(often, STYLES))


def version_tuple(version: Column) -> Column:
    """Comparable (major, minor, patch) of a version; missing parts are 0."""
    found = F.regexp_extract_all(version, F.lit(r"(\d+)"), F.lit(1))
    return F.struct(*[F.coalesce(F.get(found, F.lit(i)).cast("int"), F.lit(0)).alias(x) for i, x in enumerate(("major", "minor", "patch"))])


def count_cues(index: Column) -> Column:
    """How many cues an index text lists: its timestamp lines."""
    return F.regexp_count(index, F.lit(r"(?im)^timestamp:"))


def superseded(name: Column) -> Column:
    """(name, version) of a set's file that a newer one replaced, as in ``calm-sable.0.2.2.json``; null for any other name."""
    pattern = r"^(.+?)\.(\d+(?:\.\d+)*)\.json$"
    found = F.struct(F.regexp_extract(name, pattern, 1).alias("name"), F.regexp_extract(name, pattern, 2).alias("version"))
    return F.when(name.rlike(pattern), found)


def report_number(report: Column, field: str) -> Column:
    """A whole number out of a JSON report; null where it isn't there."""
    return F.get_json_object(report, f"$.{field}").cast("long")


def user_hash(user: Column) -> Column:
    """24 hex digits of SHA-256, in place of a user's name."""
    return F.substring(F.sha2(user.cast("binary"), 256), 1, 24)
