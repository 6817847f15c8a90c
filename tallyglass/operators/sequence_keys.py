"""Glyphs that are one character together: canonical keys of sequences, and the matches of stored ones in lines.

A sequence is known by the clusters of its parts, by whether they stand one above the other, and by whether all stand clear of the baseline, so
that two dots of a colon are no ellipsis and a high pair of ticks isn't a low one. Small parts scatter over clusters on rescaled tracks; a part whose own
cluster forms no sequence is looked up among the shapes of clusters that do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bitmaps import near_bitmaps
from .votes import trusted_label

#: How far a part may be from a shape that forms sequences (for the key alone), and from its height over the baseline.
PART_NEAR, PART_TOLERANCE = 0.2, 1
MARKS = ("stacked", "high")


def is_high(top_rel: Column, h: Column) -> Column:
    """Whether a glyph ends above the baseline by more than its own height."""
    return F.coalesce(top_rel + 2 * h < 0, F.lit(False))


def apart(y: Column, h: Column, next_y: Column, next_h: Column) -> Column:
    """Whether one of two glyphs ends above the other's top."""
    return F.coalesce((y + h <= next_y) | (next_y + next_h <= y), F.lit(False))


def snapped(glyphs: DataFrame, sequences: DataFrame, members: DataFrame) -> DataFrame:
    """Rows (key, top_rel, high, part): for glyphs whose cluster forms no sequence of that height, the nearest cluster that does.

    ``glyphs`` (key, top_rel, h, w, ink, bits), ``sequences`` (parts of clusters, and high where that is told), ``members`` (key, cluster, top_rel, h, w,
    ink, bits): known shapes and where they were seen. A member must be within a fifth of the ink, and its cluster known at the glyph's height over the baseline. Ties go to the
    smaller key. Pixels are compared for distinct shapes of a member's size only.
    """
    high = F.col("high") if "high" in sequences.columns else F.explode(F.array(F.lit(False), F.lit(True)))
    wanted = sequences.select(F.explode("parts").alias("part"), high.alias("high")).distinct()
    useful = members.join(wanted.select(F.col("part").alias("cluster")).distinct(), "cluster", "left_semi")
    own = members.groupBy("key").agg(F.min("cluster").alias("part"))
    shapes = glyphs.select("key", "top_rel", "h", "w", "ink", "bits").dropDuplicates(["key", "top_rel"]).join(own, "key", "left").withColumn("part", F.coalesce("part", "key"))
    open_ = shapes.withColumn("high", F.explode(F.array(F.lit(False), F.lit(True)))).join(wanted, ["part", "high"], "left_anti")
    near = near_bitmaps(open_.select("key", "h", "w", "ink", "bits").dropDuplicates(["key"]), useful.select("key", "h", "w", "ink", "bits").dropDuplicates(["key"]), PART_NEAR)
    places = members.select(F.col("cluster").alias("part"), F.col("top_rel").alias("_top")).distinct()
    met = near.join(useful.select(F.col("key").alias("ref_key"), F.col("cluster").alias("part")).distinct(), "ref_key").join(wanted, "part").join(places, "part")
    met = open_.select("key", "top_rel", "high").join(met, ["key", "high"]).where(F.abs(F.col("top_rel") - F.col("_top")) <= PART_TOLERANCE)
    return met.groupBy("key", "top_rel", "high").agg(F.min(F.struct("ratio", "ref_key", "part")).alias("b")).select("key", "top_rel", "high", "b.part")


def with_parts(glyphs: DataFrame, sequences: DataFrame, members: DataFrame | None) -> DataFrame:
    """Append _low and _high: what a glyph's part of a key is in a sequence on the baseline, and in a high one. Without ``members`` both are its key."""
    if members is None:
        return glyphs.withColumns({"_low": F.col("key"), "_high": F.col("key")})
    own = members.groupBy("key").agg(F.min("cluster").alias("_own"))
    near = snapped(glyphs, sequences, members).groupBy("key", "top_rel").agg(*(F.max(F.when(F.col("high") == h, F.col("part"))).alias(c) for h, c in ((False, "_low"), (True, "_high"))))
    met = glyphs.join(own, "key", "left").join(near, ["key", "top_rel"], "left")
    return met.withColumns({c: F.coalesce(c, "_own", "key") for c in ("_low", "_high")}).drop("_own")


def drops(labels: Column, label: Column) -> Column:
    """Whether a reading only loses glyphs: each is confirmed by itself, and the label is one of theirs, or fewer copies of the one they share."""
    copies = (F.size(F.array_distinct(labels)) == 1) & (F.replace(label, F.get(labels, F.lit(0)), F.lit("")) == "")
    return F.forall(labels, lambda x: x.isNotNull()) & (F.length(label) < F.size(labels)) & (F.array_contains(labels, label) | copies)


def sequence_matches(glyphs: DataFrame, sequences: DataFrame, order: list[str], members: DataFrame | None = None) -> DataFrame:
    """Glyphs read together: rows (file, cue, line, pos, length, label) of the trusted sequences that start at a glyph.

    ``sequences`` (parts, label, n) are votes for three or two glyphs drawn as one; columns stacked and high, where they are there, must be as the glyphs stand
    (top_rel, h, y). ``members`` lets parts be those of their cluster, or of the nearest (:func:`snapped`). Where ``glyphs`` has their own confirmed
    labels (own), a sequence that only drops some is no match. Where two fit, the longer is
    taken. A match that overlaps one further left is left out: within runs of overlapping matches every
    choice depends on the one before, so they are folded in order, line by line.
    """
    marks = [c for c in MARKS if c in sequences.columns]
    trusted = trusted_label(sequences, ["parts", *marks]).where("label is not null").select("parts", *marks, "label")
    w = Window.partitionBy("file", "cue", "line").orderBy(*order)
    has = glyphs.columns
    bare = lambda c, kind: F.col(c) if c in has else F.lit(None).cast(kind)
    raised = is_high(bare("top_rel", "int"), bare("h", "int"))
    glyph = F.struct("_low", "_high", raised.alias("raised"), bare("y", "int").alias("y"), bare("h", "int").alias("h"), bare("own", "string").alias("own"))
    keyed = with_parts(glyphs, sequences, members).select("file", "cue", "line", "pos", F.array(glyph, F.lead(glyph, 1).over(w), F.lead(glyph, 2).over(w)).alias("_g"))
    runs = keyed.select("file", "cue", "line", "pos", F.explode(F.array(F.slice("_g", 1, 3), F.slice("_g", 1, 2))).alias("_g")).where(F.forall("_g", lambda g: g.isNotNull()))
    at = lambda k: F.get("_g", F.lit(k))
    split = lambda a, b: apart(a["y"], a["h"], b["y"], b["h"])
    runs = runs.withColumns({"high": F.forall("_g", lambda g: g["raised"]), "stacked": split(at(0), at(1)) | split(at(1), at(2))})
    runs = runs.withColumn("parts", F.when(F.col("high"), F.transform("_g", lambda g: g["_high"])).otherwise(F.transform("_g", lambda g: g["_low"])))
    met = runs.join(trusted, ["parts", *marks]).where(~drops(F.transform("_g", lambda g: g["own"]), F.col("label"))).withColumn("length", F.size("parts"))
    best = met.groupBy("file", "cue", "line", "pos").agg(F.max(F.struct("length", "label")).alias("b")).select("file", "cue", "line", "pos", "b.length", "b.label")
    starts = F.sort_array(F.collect_list(F.struct("pos", "length", "label")))  # one line's matches
    taken = F.aggregate(
        "m", F.struct(F.lit(-1).alias("end"), F.array().cast("array<struct<pos:int,length:int,label:string>>").alias("out")),
        lambda s, x: F.when(x["pos"] >= s["end"], F.struct((x["pos"] + x["length"]).alias("end"), F.array_append(s["out"], x).alias("out"))).otherwise(s),
        lambda s: s["out"],
    )
    lines = best.groupBy("file", "cue", "line").agg(starts.alias("m"))
    return lines.select("file", "cue", "line", F.explode(taken).alias("x")).select("file", "cue", "line", "x.*")
