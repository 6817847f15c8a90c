"""SubRip text: rendering entries and scanning files, with built-in functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fmt_ts


def render_srt(entries: DataFrame) -> DataFrame:
    """One text a file from rows (file, start_ms, end_ms, text); blank texts are skipped and numbers stay dense."""
    kept = entries.where(F.trim(F.translate("text", "\n\t\r", "   ")) != "")
    number = F.row_number().over(Window.partitionBy("file").orderBy("start_ms", "end_ms", "text"))
    block = F.concat(number.cast("string"), F.lit("\n"), fmt_ts(F.col("start_ms")), F.lit(" --> "), fmt_ts(F.col("end_ms")), F.lit("\n"), F.col("text"), F.lit("\n"))
    rows = kept.select("file", number.alias("n"), block.alias("block"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("n", "block"))), lambda x: x["block"])  # one file's entries
    return rows.groupBy("file").agg(F.array_join(ordered, "\n").alias("srt"))


def parse_srt(files: DataFrame) -> DataFrame:
    """Rows (file, stamp, text) from (file, srt): blocks part at blank lines; of equal start stamps the last one wins."""
    blocks = files.select("file", F.posexplode(F.split(F.regexp_replace("srt", "\r\n", "\n"), r"\n\s*\n")).alias("pos", "block"))
    lines = F.filter(F.split("block", "\n"), lambda s: F.trim(s) != "")
    at = F.array_position(F.transform(lines, lambda s: s.contains("-->")), True)
    rows = blocks.withColumns({"lines": lines, "at": at}).where("at > 0")
    rows = rows.select(
        "file", "pos", F.trim(F.substring_index(F.element_at("lines", F.col("at").cast("int")), "-->", 1)).alias("stamp"),
        F.array_join(F.slice("lines", F.col("at") + 1, F.size("lines")), "\n").alias("text"),
    )
    return rows.groupBy("file", "stamp").agg(F.max_by("text", "pos").alias("text"))
