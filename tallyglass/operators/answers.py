"""Answers of a teacher as a table: choosing, cleaning, splitting and applying them in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .align import split_over_cues
from .votes import trusted_label, verdict

# Fixed value: a number that leads a part, as "1.", "(2)", "3:" or "4 -".
NUMBER = r"^\s*(\(?\d{1,2}[.):]|\d{1,2}\s*[-–])\s+"


def cached_answers(images: DataFrame, answers: DataFrame) -> DataFrame:
    """Append text and via to images (image_key, context_key): the answer for image and context, else the one without context.

    ``answers`` (image_key, context_key, text); a null context_key is an answer without context. Several answers of a
    key are settled by the first text in order.
    """
    best = answers.groupBy("image_key", "context_key").agg(F.min("text").alias("text"))
    exact = best.where("context_key is not null").select("image_key", "context_key", F.col("text").alias("_exact"))
    plain = best.where("context_key is null").select("image_key", F.col("text").alias("_plain"))
    met = images.join(exact, ["image_key", "context_key"], "left").join(plain, "image_key", "left")
    via = F.when(F.col("_exact").isNotNull(), "context").when(F.col("_plain").isNotNull(), "image")
    return met.withColumns({"text": F.coalesce("_exact", "_plain"), "via": via}).drop("_exact", "_plain")


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda s: F.regexp_replace(s, r"\s+$", "")), lambda s: F.trim(s) != "")


def clean(text: Column) -> Column:
    """Without code fences, blank lines and white space at line ends."""
    kept = F.filter(_lines(text), lambda s: ~F.trim(s).rlike(r"^```\w*$"))
    return F.array_join(kept, "\n")


def transcript(message: Column, tool: str = "submit_transcript") -> Column:
    """The cleaned text of a model's message (JSON): the lines that its first call of ``tool`` with a list of lines gives, or else its content; empty without either."""
    said = F.from_json(message, "content string, tool_calls array<struct<function: struct<name: string, arguments: string>>>")
    calls = F.filter(said["tool_calls"], lambda c: c["function"]["name"] == tool)
    given = F.transform(calls, lambda c: F.from_json(c["function"]["arguments"], "lines array<string>")["lines"])
    lines = F.get(F.filter(given, lambda x: x.isNotNull()), F.lit(0))
    return clean(F.coalesce(F.array_join(lines, "\n"), said["content"], F.lit("")))


def unrepeated(text: Column, n_lines: Column) -> Column:
    """A cleaned answer that is ``n_lines`` lines over and over becomes those lines once."""
    lines = _lines(text)
    block = F.slice(lines, 1, F.greatest(n_lines, F.lit(1)))
    times = F.floor(F.size(lines) / F.greatest(n_lines, F.lit(1))).cast("int")
    again = (n_lines > 0) & (F.size(lines) > n_lines) & (F.size(lines) % F.greatest(n_lines, F.lit(1)) == 0) & (F.flatten(F.array_repeat(block, times)) == lines)
    return F.array_join(F.when(again, block).otherwise(lines), "\n")


def split_sheet(text: Column, n: Column) -> Column:
    """The ``n`` parts of an answer to a sheet, parted by blank lines and without leading numbers; null for another number of parts."""
    parts = F.filter(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\n\s*\n"), lambda p: F.trim(p) != "")
    parts = F.transform(parts, lambda p: F.regexp_replace(F.trim(p), NUMBER, ""))
    return F.when(F.size(parts) == n, parts)


def sheet_texts(lines: DataFrame, answers: DataFrame, threshold: float, widths: dict[str, float] | None = None) -> DataFrame:
    """A text for each cue of the sheets that a teacher was asked: (sheet, cue, text, via), from lines (sheet, cue, line, glyphs) and answers (sheet, text).

    An answer with as many parts as cues is parted there (via parts), or else where its alignment with the glyphs of all lines costs least (via glyphs).
    Lines of a text are those of the cue's glyphs, and styles go on over a break; a part that doesn't align with its cue becomes one line. Without an
    answer, or where neither works, text and via are null: such cues are asked one by one. Of several answers of a sheet the first in order counts.
    """
    cues = lines.groupBy("sheet", "cue").agg(F.sort_array(F.collect_list(F.struct("line", "glyphs"))).alias("lines"))  # a cue's few lines
    sheets = cues.groupBy("sheet").agg(F.sort_array(F.collect_list(F.struct("cue", "lines"))).alias("cues"))  # as few as fit an image
    met = sheets.join(answers.groupBy("sheet").agg(F.min("text").alias("text")), "sheet", "left").withColumn("parts", split_sheet(F.col("text"), F.size("cues")))

    def split(r) -> list[tuple]:
        cues = [[list(line["glyphs"]) for line in c["lines"]] for c in r.cues]
        if r.parts is not None:
            whole = [split_over_cues([c], t, threshold, widths) for c, t in zip(cues, r.parts, strict=True)]
            texts, via = [w[0] if w else " ".join(t.split()) for w, t in zip(whole, r.parts, strict=True)], "parts"
        else:
            texts = split_over_cues(cues, r.text, threshold, widths) if r.text else None
            via = "glyphs" if texts else None
        return [(r.sheet, c["cue"], t, via) for c, t in zip(r.cues, texts or [None] * len(cues), strict=True)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([x for r in frame.itertuples() for x in split(r)], columns=["sheet", "cue", "text", "via"])

    kind = {f.name: f.dataType.simpleString() for f in lines.schema.fields}
    return met.mapInPandas(run, f"sheet {kind['sheet']}, cue {kind['cue']}, text string, via string")


def apply_in_order(batches: DataFrame, batch: str = "batch_no", status: str = "status") -> DataFrame:
    """Append applied and failed: how many batches up to this one have been applied in order, whenever they arrived, and how many failed."""
    w = Window.partitionBy("file").orderBy(batch).rowsBetween(Window.unboundedPreceding, 0)
    ok = (F.col(status) == "ok").cast("int")
    return batches.withColumns({"applied": F.sum(ok).over(w), "failed": F.sum(1 - ok).over(w)})


def sample(rows: DataFrame, key: str, risky: Column, exclude: DataFrame, n_risky: int, n_other: int, seed: int = 0) -> DataFrame:
    """A sample for checking: so many risky rows and so many others, by a hash of seed and key, without those checked before."""
    left = rows.join(exclude.select(key).distinct(), key, "left_anti").withColumns({"_r": F.coalesce(risky, F.lit(False)), "_h": F.xxhash64(F.lit(seed), F.col(key))})
    take = lambda c, n: left.where(c).orderBy("_h", key).limit(n)
    return take("_r", n_risky).union(take("not _r", n_other)).drop("_r", "_h")


def alike_font(votes: DataFrame, shapes: DataFrame, a: str = "I", b: str = "l") -> DataFrame:
    """Per set whether its font draws two letters alike: a variant read twice as each, or trusted shapes of both within a pixel.

    ``votes`` (set, cluster, top_rel, label, n), ``shapes`` (set, cluster, h, w).
    """
    keys = ["set", "cluster", "top_rel"]
    n = lambda label: F.coalesce(F.sum(F.when(F.col("label") == label, F.col("n"))), F.lit(0))
    both = votes.groupBy(*keys).agg(((n(a) >= 2) & (n(b) >= 2)).alias("both"))
    read = trusted_label(votes, keys).where(F.col("label").isin(a, b)).join(shapes, ["set", "cluster"])
    return _alike(both.unionByName(read.select("set", "label", "h", "w"), allowMissingColumns=True), a, b)


def alike_font_counted(counts: DataFrame, a: str = "I", b: str = "l") -> DataFrame:
    """:func:`alike_font` of variants whose observations are counted: ``counts`` (set, cluster, total, n_a, n_b, h, w), of all labels and of the two.

    A row a variant in place of one a label: two thirds of all are the majority whatever the other labels are.
    """
    sure = lambda n: verdict(F.col("total"), F.col(n), F.when(F.col(n) < F.col("total"), 2).otherwise(1)) == ""
    label = F.when(F.col("set").isNotNull() & F.col("cluster").isNotNull(), F.when(sure("n_a"), a).when(sure("n_b"), b))
    return _alike(counts.select("set", ((F.col("n_a") >= 2) & (F.col("n_b") >= 2)).alias("both"), label.alias("label"), "h", "w"), a, b)


def _alike(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(set, alike) of rows (set, both, label, h, w); label, h and w are null where nothing is trusted.

    Shapes of ``a`` are put under the nine sizes around their own, so that a size with both letters is a pair: no join.
    """
    known = F.col("label").isNotNull() & F.col("h").isNotNull() & F.col("w").isNotNull()
    rows = rows.select("set", F.coalesce("both", F.lit(False)).alias("both"), *[F.when(known, F.col(c)).alias(c) for c in ("label", "h", "w")])
    once = rows.groupBy("set", "label", "h", "w").agg(F.bool_or("both").alias("both"))
    around = F.when(F.col("label") == a, F.array(*[F.lit(d) for d in (-1, 0, 1)])).otherwise(F.array(F.lit(0)))
    put = once.withColumn("_dh", F.explode(around)).withColumn("_dw", F.explode(around))
    sizes = put.groupBy("set", (F.col("h") + F.col("_dh")).alias("h"), (F.col("w") + F.col("_dw")).alias("w")).agg(
        F.bool_or("both").alias("both"), *[F.coalesce(F.bool_or(F.col("label") == x), F.lit(False)).alias(c) for x, c in ((a, "_a"), (b, "_b"))]
    )
    return sizes.groupBy("set").agg(F.bool_or(F.col("both") | (F.col("_a") & F.col("_b"))).alias("alike"))
