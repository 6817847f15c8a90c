"""Line deduplication by content-defined chunks, in DataFrame operations alone.

Every line is hashed, and a rolling hash over each two neighbouring lines marks a chunk's end where it
is a local minimum; so where chunks end depends on four lines around, and inserted or removed lines shift
nothing further on. Chunks of several lines that occur again anywhere are found by hash, compared byte
for byte, and removed everywhere but at their first place.

Only hashes are exchanged until a chunk is known to repeat; then the texts are exchanged by document to
cut out the bytes to compare, and once more to remove what repeats. Counts and first places are partial
aggregates, so a chunk that a third of all documents share reaches a task as one row per map task. What they
say is joined back by place, never by chunk: places that aren't the only one, and those that aren't the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import barrier, discard, materialize

_MOD = (1 << 31) - 1
_BASE = 1_000_003
NEW = ("n_lines", "n_removed", "kept_text")

#: The same over DuckDB.
SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents
), hashed AS (
  SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS h FROM lines
), rolled AS (
  SELECT *, (coalesce(lag(h) OVER d, 0) * 1000003 + h) % 2147483647 AS r FROM hashed WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), cut AS (
  SELECT *, CASE WHEN r < lag(r) OVER d AND r <= lead(r) OVER d THEN 1 ELSE 0 END AS ends FROM rolled WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM cut
), chunks AS (
  SELECT doc_id, c, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM numbered GROUP BY doc_id, c
), placed AS (
  SELECT *, n > 1 AND row_number() OVER (PARTITION BY n > 1, chunk ORDER BY doc_id, c) > 1 AS again FROM chunks
), done AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN again THEN n ELSE 0 END) AS BIGINT) AS n_removed,
    coalesce(string_agg(chunk, chr(10) ORDER BY c) FILTER (NOT again), '') AS kept_text
  FROM placed GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN kept_text END AS kept_text
FROM documents d LEFT JOIN done USING (doc_id)
"""


def with_chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append _chunks: the chunks of each text in order, as structs of n (lines) and s (their text); null for a null text."""
    docs = docs.withColumn("_lines", F.split(F.col(text), "\n", -1))
    # Seven hex digits of MD5 are 28 bits, so the rolling hash of two lines stays far below 63.
    docs = docs.withColumn("_h", F.transform("_lines", lambda line: F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")))
    docs = docs.withColumn("_r", F.transform("_h", lambda h, i: (F.coalesce(F.get("_h", i - 1), F.lit(0)) * _BASE + h) % _MOD))
    lowest = lambda end: (F.get("_r", end - 2) > F.get("_r", end - 1)) & (F.get("_r", end - 1) <= F.get("_r", end))
    docs = docs.withColumn("_ends", F.filter(F.sequence(F.lit(1), F.size("_lines")), lambda end: (end == F.size("_lines")) | F.coalesce(lowest(end), F.lit(False))))

    def chunk(end, i):
        begin = F.coalesce(F.get("_ends", i - 1), F.lit(0))
        return F.struct((end - begin).alias("n"), F.array_join(F.slice("_lines", begin + 1, end - begin), "\n").alias("s"))

    return docs.withColumn("_chunks", F.transform("_ends", chunk)).drop("_lines", "_h", "_r", "_ends")


def _joined(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Join per-document lists (_k, _d, ...) to documents; a null id meets a null id.

    Such lists grow with the corpus, so both sides are sorted and merged whatever their size.
    """
    other = lists.withColumnRenamed("_k", "_k2").hint("merge")
    return docs.join(other, (docs["_k"] == other["_k2"]) & docs["doc_id"].eqNullSafe(other["_d"]), how).drop("_k2", "_d")


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append n_lines, n_removed (lines) and kept_text to ``docs``, in place of columns of those names.

    The first place of a chunk is in the smallest doc_id (a null one before all), and there the first
    chunk. A text of one chunk that repeats is removed wholly: kept_text is empty. A null text has no
    lines and kept_text null. A single line is never a chunk to remove. Rows that repeat both id and text
    are one document and treated alike. Other columns pass through, whatever their names.
    """
    columns = [c for c in docs.columns if c not in NEW]
    column = lambda c: F.col(f"`{c}`")
    keyed = docs.select(F.struct(*[column(c) for c in columns if c != text] or [F.lit(0)]).alias("_row"), "doc_id", F.xxhash64("doc_id", column(text)).alias("_k"), column(text).alias("_text"))
    bare = keyed.select("doc_id", "_k", "_text")
    several = F.transform("_chunks", lambda c: F.when(c["n"] > 1, F.xxhash64(c["s"])))
    index = with_chunks(bare, "_text").select("doc_id", "_k", F.posexplode(several).alias("c", "h"))
    index = materialize(index.where("h is not null"), "line-chunks")
    place = F.struct("doc_id", "_k", "c")
    only = index.groupBy("h").agg(F.min(place).alias("at"), F.count("*").alias("n")).where("n = 1").select("at")
    flagged = _by_document(_other_places(index, only), "_c")
    held = with_chunks(_joined(bare, flagged, "inner"), "_text")
    held = held.select("doc_id", "_k", F.explode("_c").alias("c"), "_chunks").select("doc_id", "_k", "c", F.get("_chunks", F.col("c"))["s"].alias("s"))
    held = materialize(held, "line-candidates")
    first = held.groupBy("s").agg(F.min(place).alias("at")).select("at")
    again = materialize(_by_document(_other_places(held, first), "_gone"), "line-repeats")
    discard(index, held)
    out = with_chunks(_joined(keyed, again, "left"), "_text")
    gone = F.coalesce("_gone", F.array().cast("array<int>"))
    kept = F.filter("_chunks", lambda c, i: ~F.array_contains(gone, i))
    lines = lambda chunks: F.coalesce(F.aggregate(chunks, F.lit(0).cast("long"), lambda n, c: n + c["n"]), F.lit(0))
    out = barrier(
        out.withColumn("_kept", kept)
        .withColumn("n_lines", lines(F.col("_chunks")))
        .withColumn("n_removed", F.col("n_lines") - lines(F.col("_kept")))
        .withColumn("kept_text", F.array_join(F.transform("_kept", lambda c: c["s"]), "\n"))
    )
    return out.select(*[F.col("_text").alias(c) if c == text else F.col("_row")[c].alias(c) for c in columns], *NEW)


def _other_places(rows: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, _k and c of the rows that are at none of ``places`` (at)."""
    other = places.select(F.col("at.doc_id").alias("_d"), F.col("at._k").alias("_k2"), F.col("at.c").alias("_c2"))
    met = rows["doc_id"].eqNullSafe(other["_d"]) & (rows["_k"] == other["_k2"]) & (rows["c"] == other["_c2"])
    return rows.join(other, met, "left_anti").select("doc_id", "_k", "c")


def _by_document(places: DataFrame, name: str) -> DataFrame:
    """The chunks of each document, in a list of at most its own."""
    return places.groupBy("_k", F.col("doc_id").alias("_d")).agg(F.collect_set("c").alias(name))
