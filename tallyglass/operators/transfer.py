"""Learning from another set: scale between fonts, matches of rescaled shapes, lineage, and audits of a set."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.limits import follow_neighbours
from . import bitmaps

ENOUGH, LEAD = 0.80, 0.12


def modal_heights(shapes: DataFrame, most: int = 3) -> list[int]:
    """The most frequent glyph heights, ties to smaller ones."""
    counts = shapes.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(most)
    return [r["h"] for r in counts.collect()]  # at most ``most`` rows


def match_rescaled(shapes: DataFrame, teacher: DataFrame, scale: float) -> DataFrame:
    """For each shape (key, h, w, ink, bits) the teacher's label (label, h, w, bits, top_rel) of best overlap once rescaled.

    A match needs an overlap of 0.80 and a lead of 0.12 over every other label; a label whose teacher shapes
    are fragments ('') never matches. Returns key, label, overlap.
    """

    def rescaled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples():
                mask = bitmaps.resize(bitmaps.unpack(r.bits, r.h, r.w), max(1, round(r.h * scale)), max(1, round(r.w * scale)))
                out.append((r.label, mask.shape[0], mask.shape[1], bitmaps.pack(mask)))
            yield pd.DataFrame(out, columns=["label", "th", "tw", "t_bits"])

    grown = teacher.where("label is not null and label <> ''").select("label", "h", "w", "bits").mapInPandas(rescaled, "label string, th int, tw int, t_bits binary")
    around = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    grown = grown.withColumn("_dh", F.explode(around)).withColumn("_dw", F.explode(around))
    grown = grown.select("label", "th", "tw", "t_bits", (F.col("th") + F.col("_dh")).alias("h"), (F.col("tw") + F.col("_dw")).alias("w"))

    def overlaps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            best = [bitmaps.overlap(bitmaps.unpack(r.bits, r.h, r.w), bitmaps.unpack(r.t_bits, r.th, r.tw)) for r in f.itertuples()]
            yield pd.DataFrame({"key": f["key"], "label": f["label"], "overlap": best})

    met = shapes.select("key", "h", "w", "bits").join(grown, ["h", "w"]).mapInPandas(overlaps, "key string, label string, overlap double")
    by_label = met.groupBy("key", "label").agg(F.max("overlap").alias("overlap"))
    ranked = by_label.groupBy("key").agg(F.max(F.struct("overlap", "label")).alias("b"), F.sort_array(F.collect_list("overlap"), asc=False).alias("all"))  # a figure a label
    won = (F.col("b.overlap") >= ENOUGH) & (F.col("b.overlap") - F.coalesce(F.get("all", F.lit(1)), F.lit(0.0)) >= LEAD)
    return ranked.where(won).select("key", "b.label", "b.overlap")


def find_scale(shapes: DataFrame, teacher: DataFrame, low: float = 0.3, high: float = 3.5) -> float | None:
    """The scale at which most of the 80 most frequent shapes match: ratios of modal heights, then 3 % around the best in seven steps."""
    top = shapes.orderBy(F.desc("n"), "key").limit(80)
    tried: dict[float, int] = {}

    def hits(scale: float) -> int:
        scale = round(scale, 4)
        if scale not in tried:
            tried[scale] = match_rescaled(top, teacher, scale).count()
        return tried[scale]

    ratios = {a / b for a in modal_heights(shapes) for b in modal_heights(teacher) if low <= a / b <= high}
    if not ratios:
        return None
    best = max(sorted(ratios), key=hits)
    return max((best * (1 + d / 100) for d in (0, -1, 1, -2, 2, -3, 3)), key=hits) if hits(best) else None


def lineage(matches: DataFrame) -> DataFrame:
    """Pairs (old, new) that are one to one; a shape with two partners carries nothing over."""
    one = lambda c: matches.distinct().groupBy(c).count().where("count = 1").select(c)
    return matches.distinct().join(one("old"), "old").join(one("new"), "new").select("old", "new")


def carry(rows: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """``rows`` with a key column mapped from old to new; rows without a partner are left out."""
    return rows.join(mapping, rows[column] == mapping["old"]).drop(column, "old").withColumnRenamed("new", column)


def audit(shapes: DataFrame, labels: DataFrame, ratio: float = bitmaps.NEAR) -> DataFrame:
    """Pairs of near shapes of one set with different labels: what an import would have to refuse."""
    near = bitmaps.near_bitmaps(shapes, shapes, ratio)
    a, b = labels.select(F.col("key"), F.col("label")), labels.select(F.col("key").alias("ref_key"), F.col("label").alias("ref_label"))
    return near.where("key < ref_key").join(a, "key").join(b, "ref_key").where(~F.col("label").eqNullSafe(F.col("ref_label"))).select("key", "ref_key", "label", "ref_label", "ratio")


def slant(mask: np.ndarray) -> float:
    """Shear (columns a row) under which the ink stands most upright: the sum of squared column counts is largest."""
    ys, xs = np.nonzero(mask)
    if ys.size < 2:
        return 0.0
    best, at = -1.0, 0.0
    for shear in np.arange(-0.1, 0.51, 0.05):
        columns = np.round(xs + shear * ys).astype(int)
        score = float((np.bincount(columns - columns.min()) ** 2).sum())
        if score > best + 1e-9 or (math.isclose(score, best) and abs(shear) < abs(at)):
            best, at = score, float(shear)
    return at


def ridge(mask: np.ndarray) -> np.ndarray:
    """Widths of the strokes along their middle: twice the distance to the ground, where no neighbour is farther from it."""
    h, w = mask.shape[0] + 2, mask.shape[1] + 2
    padded = np.pad(mask, 1)
    ink, ground = np.argwhere(padded), np.argwhere(~padded)
    far = np.zeros((h, w))
    for at in range(0, len(ink), 512):
        part = ink[at : at + 512]
        far[part[:, 0], part[:, 1]] = np.sqrt(((part[:, None] - ground[None]) ** 2).sum(2).min(1))
    around = np.pad(far, 1)
    most = np.maximum.reduce([around[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)])
    return 2 * far[(far == most) & (far > 0)]


def stroke(mask: np.ndarray) -> float:
    """Mean width of a shape's strokes, in pixels."""
    widths = ridge(mask)
    return float(widths.mean()) if widths.size else 0.0


def bold_votes(words: DataFrame, shapes: DataFrame, bold: float = 1.25, regular: float = 1.1) -> DataFrame:
    """Votes (file, key, regular, bold) of the words (file, word, height, keys) whose strokes are near their file's median, or well above it.

    ``shapes`` (key, h, w, ink, bits) are measured once each. A word's width is the mean over all its ridges; words with ink below a tenth of their
    line's height squared say nothing, and neither do those between ``regular`` and ``bold`` times the median. A glyph votes as often as it occurs.
    """

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            widths = [ridge(bitmaps.unpack(r.bits, r.h, r.w)) for r in f.itertuples()]
            yield pd.DataFrame({"key": f["key"], "ink": f["ink"], "wide": [float(x.sum()) for x in widths], "ridge": [x.size for x in widths]})

    measured = shapes.dropDuplicates(["key"]).select("key", "h", "w", "ink", "bits").mapInPandas(measure, "key string, ink int, wide double, ridge long")
    parts = words.select("file", "word", "height", F.explode("keys").alias("key")).join(measured, "key")
    told = parts.groupBy("file", "word", "height").agg(F.sum("ink").alias("ink"), (F.sum("wide") / F.sum("ridge")).alias("stroke")).where(10 * F.col("ink") >= F.col("height") * F.col("height"))
    by = F.col("stroke") / F.col("median")
    judged = told.join(told.groupBy("file").agg(F.median("stroke").alias("median")), "file").select("file", "word", F.when(by >= bold, True).when(by <= regular, False).alias("bold"))
    return _votes(words, judged, "bold", "regular", "bold")


#: Shears a word is tried at, by place: a clear italic is sharpest from the 6th to the 12th, a clear upright up to the 2nd; the 10th is a typical italic.
SHEARS = np.arange(15) * 0.025
ITALIC, UPRIGHT, TYPICAL, CLEARER = range(6, 13), range(3), 10, 1.08


def sharpness(ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """How sharply ink falls into columns under each shear: the sum of squared column counts, all shears counted at once."""
    columns = np.rint(xs + SHEARS[:, None] * (ys - ys.max())).astype(np.int64)
    columns -= columns.min()
    width = int(columns.max()) + 1
    counts = np.bincount((columns + width * np.arange(len(SHEARS))[:, None]).ravel(), minlength=width * len(SHEARS))
    return (counts.reshape(len(SHEARS), width).astype(np.float64) ** 2).sum(1)


def slanted(ys: np.ndarray, xs: np.ndarray) -> bool | None:
    """Whether the ink of a word (its rows and columns) slants: yes or no where one is clearly sharper than the other, else None."""
    if not ys.size:
        return None
    score = sharpness(ys, xs)
    best = int(score.argmax())
    if best in ITALIC and score[best] >= CLEARER * score[0]:
        return True
    return False if best in UPRIGHT and score[0] >= CLEARER * score[TYPICAL] else None


def word_slants(glyphs: DataFrame, threshold: float, small: float = 0.4) -> DataFrame:
    """Words (file, line: cue and line, word, slanted, keys: array of key, small) of segmented glyphs, for :func:`italic_votes`.

    A word ends at a gap over ``threshold``. All of its ink is measured together. A key is small that is anywhere in its file lower than ``small`` of its line.
    """
    line = ["file", "cue", "line"]
    order = Window.partitionBy(*line).orderBy("pos")
    begins = F.coalesce(F.lag("gap_after").over(order) > threshold, F.lit(False)).cast("int")
    tall = F.max(F.col("y") + F.col("h")).over(Window.partitionBy(*line)) - F.min("y").over(Window.partitionBy(*line))
    laid = glyphs.withColumns({"_b": begins, "_low": F.col("h") < small * tall})
    lows = laid.groupBy("file", "key").agg(F.bool_or("_low").alias("small"))  # a partial aggregate, so a common key is a row a task
    laid = laid.withColumn("word", F.sum("_b").over(order).cast("int")).join(lows, ["file", "key"])
    words = laid.groupBy(*line, "word").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "small", "x", "y", "h", "w", "bits"))).alias("g"))  # a word's glyphs

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            seen: dict[tuple, bool | None] = {}
            for g in f["g"]:
                drawn = tuple((x["key"], x["x"] - g[0]["x"], x["y"] - g[0]["y"]) for x in g)
                if drawn not in seen:
                    points = [np.argwhere(bitmaps.unpack(x["bits"], x["h"], x["w"])) + (x["y"], x["x"]) for x in g]
                    seen[drawn] = slanted(*np.concatenate(points).T)
                out.append(seen[drawn])
            yield f.drop(columns="g").assign(slanted=pd.array(out, dtype="boolean"), keys=[[{"key": x["key"], "small": x["small"]} for x in g] for g in f["g"]])

    kinds = "file string, cue int, line int, word int, slanted boolean, keys array<struct<key:string,small:boolean>>"
    return words.mapInPandas(measure, kinds).select("file", F.struct("cue", "line").alias("line"), "word", "slanted", "keys")


def slant_votes(glyphs: DataFrame, threshold: float) -> DataFrame:
    """Votes (file, key, upright, italic) straight from segmented glyphs: see :func:`word_slants` and :func:`italic_votes`."""
    return italic_votes(word_slants(glyphs, threshold))


def italic_votes(words: DataFrame) -> DataFrame:
    """Votes (file, key, upright, italic) of words (file, line, word, slanted: true, false or null, keys: array of key, small).

    First only words that slant clearly vote, with their glyphs that aren't small. Then a word is what most of its decided glyphs say (two votes and three
    quarters of all), else what it was, else what its neighbours agree on, from left to right; and every glyph of it votes.
    """
    one = words.select("file", "line", "word", "slanted", F.explode("keys").alias("g")).select("file", "line", "word", "slanted", "g.*")
    seen = one.where("slanted is not null and not small").groupBy("file", "key").agg(F.count_if("slanted").alias("i"), F.count_if(~F.col("slanted")).alias("u"))
    sure = seen.where((F.col("i") + F.col("u") >= 2) & (4 * F.greatest("i", "u") >= 3 * (F.col("i") + F.col("u")))).select("file", "key", (F.col("i") > F.col("u")).alias("says"))
    most = one.join(sure, ["file", "key"]).groupBy("file", "line", "word").agg((2 * F.count_if("says") > F.count("*")).alias("says"))
    known = words.select("file", "line", "word", "slanted").join(most, ["file", "line", "word"], "left").withColumn("own", F.coalesce("says", "slanted"))
    place = F.to_json(F.struct("file", "line"))
    final = follow_neighbours(known.select("file", "line", "word", place.alias("place"), "own"), "place", ["word"], "own")
    named = words.withColumn("keys", F.transform("keys", lambda g: g["key"])).withColumn("word", F.struct("line", "word"))
    return _votes(named, final.select("file", F.struct("line", "word").alias("word"), F.col("resolved").alias("italic")), "italic", "upright", "italic")


def _votes(words: DataFrame, judged: DataFrame, flag: str, no: str, yes: str) -> DataFrame:
    """How often each key occurs in words judged to have a flag, and not to have it."""
    met = words.select("file", "word", F.explode("keys").alias("key")).join(judged.where(F.col(flag).isNotNull()), ["file", "word"])
    return met.groupBy("file", "key").agg(F.count_if(~F.col(flag)).alias(no), F.count_if(flag).alias(yes))


def word_styles(words: DataFrame, italic: float = 0.15, bold: float = 1.25, regular: float = 1.1) -> DataFrame:
    """Append italic and bold to words (file, word, glyphs: array of h, w, bits): by mean slant, and by stroke over the file's median.

    Between ``regular`` and ``bold`` times the median a word's weight stays open (null).
    """

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples():
                masks = [bitmaps.unpack(g["bits"], g["h"], g["w"]) for g in r.glyphs]
                out.append((r.file, r.word, float(np.mean([slant(m) for m in masks])) if masks else 0.0, float(np.mean([stroke(m) for m in masks])) if masks else 0.0))
            yield pd.DataFrame(out, columns=["file", "word", "slant", "stroke"])

    kind = words.schema["word"].dataType.simpleString()
    rows = words.select("file", "word", "glyphs").mapInPandas(measure, f"file string, word {kind}, slant double, stroke double")
    middle = rows.groupBy("file").agg(F.median("stroke").alias("median"))
    by = F.col("stroke") / F.col("median")
    return rows.join(middle, "file").select("file", "word", (F.col("slant") >= italic).alias("italic"), F.when(by >= bold, True).when(by <= regular, False).alias("bold"))
