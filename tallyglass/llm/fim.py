"""Fill-in-the-middle: cut texts into prefix, middle and suffix, and write the middle last.

A text is an array of code points. A unit is a run of ASCII letters or one other character, so a new unit starts
wherever two neighbours aren't both letters; those places are found by comparing the array with itself one place on.
Two of the places, drawn from a hash of the document's id, bound the middle. Every choice follows from the
id and the seed alone, so a document is cut alike wherever and however often it is computed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

SEED = 1
#: Of 100 documents, so many stay plain, and of the others so many bring the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


def borders(points: np.ndarray) -> np.ndarray:
    """Where units begin in an array of code points, and its length at the end: one place more than there are units."""
    letter = (points | 32) - 97 < 26  # unsigned: what lies below 'a' wraps to large numbers
    return np.append(np.flatnonzero(np.append(points.size > 0, ~(letter[1:] & letter[:-1]))), points.size)


def draws(ident: str, seed: int = SEED) -> list[int]:
    """Four numbers below 2**32 of a document."""
    digest = hashlib.sha256(f"{seed}:{ident}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def rearrange(text: str, ident: str, seed: int = SEED, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """Units, form (plain, psm or spm), code points of prefix and of middle (None if plain), and the text as it is to be learnt."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    places = borders(points)
    n = places.size - 1
    a, b, c, d = draws(ident, seed)
    if not text or c % 100 >= 100 - plain or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    start, stop = (int(places[k]) for k in sorted((a % (n + 1), b % (n + 1))))
    prefix, middle, suffix = (p.tobytes().decode("utf-32-le") for p in (points[:start], points[start:stop], points[stop:]))
    if d % 100 < suffix_first:
        return n, "spm", start, stop - start, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", start, stop - start, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, ident: str = "doc_id", text: str = "text", seed: int = SEED, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if None) with n, form, prefix_chars, middle_chars and output; columns of those names are replaced.

    One pass, without a shuffle. A null or empty text is plain with an empty output, and so is any text that holds one
    of the three marks, as it couldn't be told from them. A null id draws as the empty string does; rows of one id draw alike.
    Texts of any length are taken whole.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    rows = docs.select(
        F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(kept))).alias("row"),
        F.coalesce(F.col(f"`{ident}`").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [rearrange(t, i, seed, plain, suffix_first) for i, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = zip(*made, strict=True) if made else [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["row", *ADDED])

    schema = T.StructType([rows.schema["row"], *(T.StructField(c, T.LongType() if t == pa.int64() else T.StringType()) for c, t in zip(ADDED, types, strict=True))])
    return rows.mapInArrow(run, schema).select(*(F.col(f"row._{i}").alias(c) for i, c in enumerate(kept)), *ADDED)


def restored(output: str = "output", form: str = "form") -> Column:
    """The exact text again, from output and form alone: what stands between the marks, put back in order.

    No part holds a mark, and none can arise where a part meets one, so the first of each is the mark itself.
    """
    out, width = F.col(output), len(PREFIX)
    at = {m: F.locate(m, out) for m in (PREFIX, SUFFIX, MIDDLE)}
    part = lambda mark, end: F.substring(out, at[mark] + width, at[end] - at[mark] - width)
    middle = F.substring(out, at[MIDDLE] + width, F.length(out))
    psm = F.concat(part(PREFIX, SUFFIX), middle, part(SUFFIX, MIDDLE))
    spm = F.concat(part(PREFIX, MIDDLE), middle, part(SUFFIX, PREFIX))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)


#: The contract's rows; n + 1 places, two of which a document draws.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2,
  CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM d),
p AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
s AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS x, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS y FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || y || '<M>' || m ELSE '<S>' || y || '<P>' || x || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM s
"""
