"""Reading cues from what is known of their glyphs: near matches that may be trusted, clusters, and lines of text.

Joins and rules are DataFrame operations; the last step walks one line's items in an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.styles import render, word_styles
from .bitmaps import EDGE_NEAR, NEAR, local_difference, near_bitmaps, prototype_join, topology, unpack
from .recognition import classify_gaps, read_glyphs, word_memory
from .sequence_keys import sequence_matches
from .votes import options, read_decision, summary
from .words import settle

# Letters whose identity hangs on a row of pixels, and how near a match must be.
STRICT = "Il|i1!jíìïî035689g"
SAME_HEIGHT = "Il|i1!jíìïî"
LOOK_ALIKES = ("I", "l", "|")
CLASSES = ("Il1|!iíìïîj", "035689gq")
STRICT_NEAR, STRICT_EDGE_NEAR, MARGIN, EDGE_MARGIN, RIVAL_MARGIN, JOIN_NEAR = 0.05, 0.02, 0.06, 0.03, 0.05, 0.35
LEAST_HEIGHT, LEAST_INK = 8, 25
PROTO_NEAR, PROTO_STRICT_NEAR, PROTO_MARGIN, PROTO_PIXELS, SURE_PIXELS = 0.04, 0.02, 0.03, 3, 1
WORD_BREAKS = "-–—/"
PLACEHOLDER = "�"


def _has(label: Column, chars: str) -> Column:
    return F.coalesce(label.rlike("[" + "".join("\\" + c if c in "|!" else c for c in chars) + "]"), F.lit(False))


@F.pandas_udf(T.StringType())
def _topology(bits: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
    return pd.Series([",".join(map(str, topology(unpack(*x)))) for x in zip(bits, h, w, strict=True)])


@F.pandas_udf(T.DoubleType())
def _local(bits: pd.Series, h: pd.Series, w: pd.Series, r_bits: pd.Series, rh: pd.Series, rw: pd.Series) -> pd.Series:
    return pd.Series([local_difference(unpack(*x[:3]), unpack(*x[3:])) for x in zip(bits, h, w, r_bits, rh, rw, strict=True)])


def _candidates(shapes: DataFrame, known: DataFrame, ratio: float, tolerant: bool) -> DataFrame:
    """Near pairs with the sizes and pixels of both, and label and voted of the known one."""
    reference = known.select("key", "h", "w", "ink", "bits").distinct()
    other = known.select(F.col("key").alias("ref_key"), F.col("h").alias("rh"), F.col("w").alias("rw"), F.col("bits").alias("r_bits"), "label", "voted")
    met = near_bitmaps(shapes, reference, ratio, tolerant).join(other, "ref_key").join(shapes.select("key", "h", "w", "ink", "bits"), "key")
    return met.withColumn("dh", F.col("h") - F.col("rh"))


def has_slant(label: Column) -> Column:
    """Whether a label has a slant and a weight of its own: it holds a letter or digit."""
    return F.coalesce(label.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def _against(no: str, yes: str) -> Column:
    """Whether a shape's word geometry in its file (f_...) and the known shape's (g_...) both say something, and not the same."""
    mine, theirs = F.col(f"f_{yes}") - F.col(f"f_{no}"), F.col(f"g_{yes}") - F.col(f"g_{no}")
    return F.coalesce(F.signum(mine) * F.signum(theirs) < 0, F.lit(False))


#: Votes on slant and weight, as (no, yes).
GEOMETRY = (("upright", "italic"), ("regular", "bold"))


def _with_geometry(pairs: DataFrame, geometry: DataFrame | None, known: DataFrame) -> DataFrame:
    """Pairs (key, ref_key) with disagree, and measured: whether the word of the unknown shape was measured for slant at all."""
    names = [c for two in GEOMETRY for c in two]
    if geometry is None:
        return pairs.withColumns({"disagree": F.lit(False), "measured": F.lit(True)})
    told = geometry.groupBy("key").agg(*(F.sum(c).alias(f"f_{c}") for c in names))
    theirs = known.groupBy(F.col("key").alias("ref_key")).agg(*(F.max(F.col(c) if c in known.columns else F.lit(None).cast("long")).alias(f"g_{c}") for c in names))
    met = pairs.join(told, "key", "left").join(theirs, "ref_key", "left")
    met = met.withColumns({"disagree": _against(*GEOMETRY[0]) | _against(*GEOMETRY[1]), "measured": F.col("f_upright").isNotNull()})
    return met.drop(*(f"{x}_{c}" for x in "fg" for c in names))


def near_match(shapes: DataFrame, known: DataFrame, rescaled: bool = False, protos: DataFrame | None = None, geometry: DataFrame | None = None) -> DataFrame:
    """Rows (key, ref_key, ratio, stage): the known shape that an unknown one may be read as.

    ``shapes`` (key, h, w, ink, bits); ``known`` the same with label (null where unconfirmed) and voted (labels it was read as).
    First by differing pixels: within 0.12 of the ink, 0.05 for strict letters, which may differ a row in height only where nothing that
    reads differently lies near; several letters must agree in the columns where they differ; another label within 0.06 makes it abstain.
    Shapes without a candidate meet ``protos`` (:func:`bitmaps.prototypes`) next: the nearest with as many pieces and holes decides, within 0.04 of its stable ink (0.02 for strict and
    unconfirmed ones) or three pixels; a pair of look-alikes is joined, an unconfirmed one makes it abstain, and so do another label within 0.03, and word geometry: ``geometry`` (key, upright,
    italic, regular, bold) are votes of the unknown shapes' words, and ``known`` may have such columns. One pixel at most outweighs a vote against. On
    rescaled tracks shapes without a candidate meet once more with a pixel of tolerance, by pieces and holes: the nearest decides or
    abstains. An unconfirmed twin of a confirmed shape as near is passed over; look-alikes join their pair; a strict letter must be all but
    identical, without a rival, and have a learned look-alike. Ties go to the smaller ref_key.
    """
    found = _candidates(shapes, known, NEAR, False).where("label <> ''")
    strict = _has(F.col("label"), STRICT)
    per = Window.partitionBy("key")
    of_label = F.min("ratio").over(Window.partitionBy("key", "label"))
    found = found.withColumn("_own", of_label).withColumn("_all", F.sort_array(F.collect_set(F.struct("_own", "label")).over(per)))  # the labels near a shape
    rival = F.exists("_all", lambda x: (x["label"] != F.col("label")) & (x["_own"] < F.col("ratio") + RIVAL_MARGIN))
    letters = F.length(F.regexp_replace("label", r"[^\p{L}\p{N}]", ""))
    tolerance = F.when(strict, STRICT_NEAR).otherwise(NEAR)
    found = found.where((F.col("ratio") <= tolerance) & ~(strict & (F.col("dh") != 0) & rival))
    found = found.where(F.when(letters >= 2, _local("bits", "h", "w", "r_bits", "rh", "rw") <= tolerance).otherwise(True))
    best = found.groupBy("key").agg(F.min(F.struct("ratio", "ref_key", "label")).alias("b"))
    other = found.join(best, "key").where("label <> b.label").groupBy("key").agg(F.min("ratio").alias("o"))
    decided = best.join(other, "key", "left").withColumn("ok", F.col("o").isNull() | (F.col("o") - F.col("b.ratio") >= MARGIN))
    first = decided.select("key", F.when(F.col("ok"), F.col("b.ref_key")).alias("ref_key"), F.col("b.ratio").alias("ratio"), F.lit("pixels").alias("stage"))
    if protos is not None:
        first = first.union(_prototype_match(shapes.join(first, "key", "left_anti"), known, protos, geometry))
    if not rescaled:
        return first.where("ref_key is not null")
    rest = shapes.where((F.col("h") >= LEAST_HEIGHT) & (F.col("ink") >= LEAST_INK)).join(first, "key", "left_anti")
    return first.union(_edge_match(rest, known, geometry)).where("ref_key is not null")


def _prototype_match(shapes: DataFrame, known: DataFrame, protos: DataFrame, geometry: DataFrame | None) -> DataFrame:
    """Decisions by prototypes; a null ref_key abstains, and a shape that is near to none has no row."""
    heads = known.select(F.col("key").alias("cluster"), F.col("h").alias("rh"), F.col("w").alias("rw"), F.col("bits").alias("r_bits"), "label", "voted").dropDuplicates(["cluster"])
    met = prototype_join(shapes, protos).join(heads, "cluster").join(shapes.select("key", "h", "w", "bits"), "key")
    met = met.where(_topology("bits", "h", "w") == _topology("r_bits", "rh", "rw")).select("key", F.col("cluster").alias("ref_key"), "ratio", "pixels", "label", "voted")
    best = met.groupBy("key").agg(F.min(F.struct("ratio", "ref_key", "pixels", "label", "voted")).alias("b")).select("key", "b.*")
    label = F.col("label")
    tolerance = F.when(label.isNull() | _has(label, STRICT), PROTO_STRICT_NEAR).otherwise(PROTO_NEAR)
    best = _with_geometry(best.where((F.col("ratio") <= tolerance) | (F.col("pixels") <= PROTO_PIXELS)), geometry, known)
    others = met.select("key", F.col("label").alias("_l"), F.col("ratio").alias("_r"))
    alike = lambda c: F.coalesce(c.isin(*LOOK_ALIKES), F.lit(False))
    rival = best.select("key", "label").join(others, "key").where(~F.col("_l").eqNullSafe(label) & ~(alike(F.col("_l")) & alike(label))).groupBy("key").agg(F.min("_r").alias("o"))
    pair = (F.size("voted") > 1) & F.forall("voted", lambda x: x.isin(*LOOK_ALIKES))
    clear = F.col("o").isNull() | (F.col("o") - F.col("ratio") >= PROTO_MARGIN)
    veto = (F.col("pixels") > SURE_PIXELS) & has_slant(label) & F.col("disagree")
    ok = F.when(label.isNull(), F.coalesce(pair, F.lit(False))).otherwise(clear & ~veto)
    return best.join(rival, "key", "left").select("key", F.when(ok, F.col("ref_key")).alias("ref_key"), "ratio", F.lit("prototypes").alias("stage"))


def _edge_match(shapes: DataFrame, known: DataFrame, geometry: DataFrame | None = None) -> DataFrame:
    met = _candidates(shapes, known, EDGE_NEAR, True)
    met = met.withColumn("alike", _topology("bits", "h", "w") == _topology("r_bits", "rh", "rw"))
    pair = (F.size("voted") > 1) & F.forall("voted", lambda x: x.isin(*LOOK_ALIKES))
    met = met.withColumn("pair", F.col("label").isNull() & F.coalesce(pair, F.lit(False)))
    sure = met.where("alike and label is not null").groupBy("key").agg(F.min(F.struct("ratio", "label")).alias("s"))
    met = met.join(sure, "key", "left")
    agrees = (F.size("voted") == 0) | ((F.size("voted") == 1) & (F.get("voted", F.lit(0)) == F.col("s.label")))
    twin = F.col("label").isNull() & ~F.col("pair") & F.coalesce((F.col("s.ratio") - F.col("ratio") < EDGE_MARGIN) & agrees, F.lit(False))
    row = F.struct("ratio", "ref_key", "label", "dh", "pair")
    best = met.where(F.col("alike") & ~twin).groupBy("key").agg(F.min(row).alias("b"))
    met = met.join(best, "key")
    differs = F.when(F.col("label").isNull(), F.exists("voted", lambda x: x != F.col("b.label"))).otherwise(F.col("label") != F.col("b.label"))
    rivals = met.where(F.coalesce(differs, F.lit(False))).groupBy("key").agg(F.min("ratio").alias("any"), F.min(F.when(F.col("alike"), F.col("ratio"))).alias("o"))
    label = F.col("b.label")
    seen = known.where("label is not null").agg(F.collect_set("label").alias("seen"))  # the labels of a set
    best = _with_geometry(best.withColumn("ref_key", F.col("b.ref_key")), geometry, known)
    row = best.join(rivals, "key", "left").crossJoin(F.broadcast(seen))  # a row
    veto = has_slant(label) & (F.col("disagree") | (_has(label, STRICT) & ~F.col("measured")))
    learned = F.lit(False)
    for letters in CLASSES:
        learned = learned | (_has(label, letters) & F.exists("seen", partial(_other_of, letters, label)))
    strict_ok = (F.col("b.ratio") <= STRICT_EDGE_NEAR) & F.col("any").isNull() & ~((F.col("b.dh") != 0) & _has(label, SAME_HEIGHT)) & (learned | (label == "j"))
    ok = F.when(F.col("b.pair"), F.col("b.dh") == 0).when(label.isNull(), False).when(_has(label, STRICT), strict_ok).otherwise(F.col("o").isNull() | (F.col("o") - F.col("b.ratio") >= EDGE_MARGIN))
    ok = ok & (F.col("b.pair") | ~F.coalesce(veto, F.lit(False)))
    return row.select("key", F.when(ok, F.col("b.ref_key")).alias("ref_key"), F.col("b.ratio").alias("ratio"), F.lit("edges").alias("stage"))


def _other_of(letters: str, label: Column, x: Column) -> Column:
    return (x != label) & _has(x, letters)


def assign_clusters(new: DataFrame, pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Append cluster to new shapes (key, label or null): that of the nearest member, or the shape's own key.

    ``pairs`` (key, ref_key, ratio, dh) are near shapes, ``members`` (ref_key, cluster, label). Strict letters join only within 0.05 and at their
    height. A shape stays apart where the nearest cluster reads differently, or another with another label is within 0.06.
    """
    met = pairs.join(members.withColumnRenamed("label", "known"), "ref_key").join(new.select("key", F.col("label").alias("own")), "key")
    strict = _has(F.col("known"), STRICT) | _has(F.col("own"), STRICT)
    met = met.where((F.col("ratio") <= F.when(strict, STRICT_NEAR).otherwise(NEAR)) & ~(strict & (F.col("dh") != 0)))
    best = met.groupBy("key").agg(F.min(F.struct("ratio", "ref_key", "cluster", "known", "own")).alias("b"))
    apart = (F.col("cluster") != F.col("b.cluster")) & ~F.col("known").eqNullSafe(F.col("b.known"))
    other = met.join(best, "key").where(apart).groupBy("key").agg(F.min("ratio").alias("o"))
    ok = ~F.coalesce(F.col("b.own") != F.col("b.known"), F.lit(False)) & (F.col("o").isNull() | (F.col("o") - F.col("b.ratio") >= MARGIN))
    joined = best.join(other, "key", "left").where(ok).select("key", F.col("b.cluster").alias("cluster"))
    return new.join(joined, "key", "left").withColumn("cluster", F.coalesce("cluster", "key"))


def words_of(items: Sequence[dict]) -> list[list[dict]]:
    """Items of a line parted where the next is not surely in the same word."""
    out: list[list[dict]] = []
    for k, item in enumerate(items):
        if not k or items[k - 1]["space_after"] is not False:
            out.append([])
        out[-1].append(item)
    return out


def render_line(items: Sequence[dict], placeholder: str = PLACEHOLDER) -> str:
    """The styled text of a line's items (text or None, style, space_after)."""
    words = [[(c, x.get("style") or "") for x in word for c in (x["text"] if x["text"] is not None else placeholder)] for word in words_of(items)]
    chars: list[tuple[str, str]] = []
    for word, style in zip(words, word_styles(words), strict=True):
        chars += ([(" ", "")] if chars else []) + [(c, style) for c, _ in word]
    return render(chars)


def problems(items: Sequence[dict]) -> list[tuple[int, str]]:
    """Where a line isn't read: items without text, and breaks that nothing decides."""
    unread = [(k, x.get("reason") or "unknown glyph") for k, x in enumerate(items) if x["text"] is None]
    return unread + [(k, "uncertain space") for k, x in enumerate(items[:-1]) if x["space_after"] is None]


def fill_spaces(items: Sequence[dict], reference: str) -> list[dict] | None:
    """The items with breaks that nothing decides taken from a reference of the same characters; None for others, or where a character is missing."""
    plain = "".join(reference.split())
    if any(x["text"] is None for x in items) or "".join(x["text"] for x in items) != plain:
        return None
    breaks, n = set(), 0
    for word in reference.split():
        n += len(word)
        breaks.add(n)
    out, n = [], 0
    for x in items:
        n += len(x["text"])
        out.append({**x, "space_after": n in breaks if x["space_after"] is None else x["space_after"]})
    return out


def quotes_joined(items: Sequence[dict]) -> list[dict]:
    """Two apostrophes or two commas surely in one word are one double quote."""
    out: list[dict] = []
    for x in items:
        last = out[-1] if out else None
        two = last is not None and last["space_after"] is False and (last["text"], x["text"])
        if two and (set(two) <= {"'", "’"} or two == (",", ",")):
            out[-1] = {**last, "text": '"', "via": "seq", "space_after": x["space_after"], "reason": ""}
        else:
            out.append(dict(x))
    return out


LINES = "file string, cue int, line int, text string, letters_ok boolean, ok boolean, problems array<string>, low array<string>, settled array<string>"


def _plain(x):
    if hasattr(x, "asDict"):
        x = x.asDict()
    return {k: _plain(v) for k, v in x.items()} if isinstance(x, dict) else [_plain(v) for v in x] if isinstance(x, (list, tuple)) or hasattr(x, "tolist") and getattr(x, "ndim", 0) else x


def recognize(
    glyphs: DataFrame, votes: DataFrame, sequences: DataFrame, near: DataFrame, pairs: DataFrame, histogram: DataFrame, memory: DataFrame, reference: DataFrame | None = None, tentative: bool = False,
    bearings: DataFrame | None = None, lexicon: DataFrame | None = None, members: DataFrame | None = None, priors: DataFrame | None = None, alike: bool = False,
) -> DataFrame:
    """Lines of text (file, cue, line, text, letters_ok, ok, problems, low, settled) of segmented glyphs.

    ``votes`` (key, top_rel, label, n) decide what a glyph is read as; ``near`` (key, ref_key) lends unknown keys another's votes; ``sequences`` (parts, label, n)
    are read first, by the clusters of ``members`` where those are given; ``pairs`` (ka, kb, gap, letter, space), ``bearings`` (side, key, value) and ``histogram`` (gap, letter, space) tell spaces; ``memory`` (keys, text, n) settles look-alikes;
    ``lexicon`` (word, zipf, valid) settles those that memory doesn't, and repairs words read with the wrong one of I and l; ``alike`` says that the font draws both the same.
    ``priors`` (key, top_rel, label) are guesses from another set. settled lists what a word's memory, the lexicon or a repair read, as text and source.
    ``reference`` (file, cue, line, text) fills breaks that nothing decides. With ``tentative`` a label seen once is read, and listed in low. A line that isn't
    wholly read has placeholders, and its problems.
    """
    same = F.lit(True) if alike else None
    decided = read_decision(votes, ["key", "top_rel"], list(LOOK_ALIKES), priors, F.col("label").isin("I", "l") if alike else None)
    decided = decided.join(options(votes, ["key", "top_rel"], same), ["key", "top_rel"], "left")
    once = summary(votes, ["key", "top_rel"]).select("key", "top_rel", F.col("label").alias("_top"))
    decided = decided.join(once, ["key", "top_rel"], "left").withColumn("_low", F.lit(tentative) & (F.col("reason") == "unconfirmed") & F.col("_top").isNotNull())
    exact = decided.select("key", "top_rel", F.to_json(F.struct(F.when(F.col("_low"), F.col("_top")).otherwise(F.col("label")).alias("text"), "reason", F.col("_low").alias("low"), "options")).alias("label"), F.xxhash64("key", "top_rel").alias("insert_no"))
    read = read_glyphs(glyphs, exact, near)  # all that is known of a position travels as its label
    told = F.from_json("text", "text string, reason string, low boolean, options array<string>")
    read = read.withColumn("_t", told).withColumns({"text": F.col("_t.text"), "low": F.coalesce("_t.low", F.lit(False)), "options": F.col("_t.options"), "reason": F.when(F.col("_t").isNull(), "unknown glyph").when(F.col("_t.text").isNull(), F.col("_t.reason")).otherwise("")})
    read = read.withColumn("via", F.when(F.col("reason") == "ambiguous", "ambig").when(F.col("low"), "tentative").otherwise(F.col("via")))
    line = ["file", "cue", "line"]
    confirmed = read.withColumn("own", F.when((F.col("via") == "exact") & (F.col("reason") == ""), F.col("text")))
    matched = sequence_matches(confirmed, sequences, ["pos"], members).select(*line, "pos", "length", F.col("label").alias("_label"))
    inside = matched.where("length > 1").select(*line, F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + F.col("length") - 1)).alias("pos"))
    after = F.lead("key").over(Window.partitionBy(*line).orderBy("pos"))
    keyed = glyphs.select(*line, "pos", F.col("key").alias("ka"), after.alias("kb"), F.col("gap_after").alias("gap"))
    spaces = classify_gaps(keyed.where("gap is not null"), pairs, histogram, bearings).select(*line, "pos", F.col("is_space").alias("space_after"))
    items = read.join(matched, [*line, "pos"], "left").join(inside, [*line, "pos"], "left_anti")
    ends = items.withColumn("_end", F.col("pos") + F.coalesce("length", F.lit(1)) - 1).join(spaces.withColumnRenamed("pos", "_end"), [*line, "_end"], "left")
    style = F.when(F.col("underlined"), "u").otherwise("")
    item = F.struct(
        "pos", F.coalesce("_label", "text").alias("text"), style.alias("style"), F.when(F.col("_label").isNotNull(), "").otherwise(F.col("reason")).alias("reason"),
        F.when(F.col("_label").isNotNull(), "seq").otherwise(F.col("via")).alias("via"), (F.col("low") & F.col("_label").isNull()).alias("low"), "space_after", F.col("key"), F.col("_end"), F.when(F.col("_label").isNull(), F.col("options")).alias("options"),
    ).alias("x")
    broken = F.lag(F.when(F.coalesce(F.col("x.space_after"), F.lit(True)) | F.col("x.text").isin(*WORD_BREAKS), 1).otherwise(0)).over(Window.partitionBy(*line).orderBy("x.pos"))
    laid = ends.select(*line, item).withColumn("_b", F.coalesce(broken, F.lit(0)) + F.when(F.col("x.text").isin(*WORD_BREAKS), 1).otherwise(0))
    laid = laid.withColumn("word", F.sum("_b").over(Window.partitionBy(*line).orderBy("x.pos")))
    spelled = glyphs.select(*line, "pos", "key").join(laid.select(*line, "word", F.explode(F.sequence(F.col("x.pos"), F.col("x._end"))).alias("pos")), [*line, "pos"])
    keys = spelled.groupBy(*line, "word").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "key"))), lambda x: x["key"]).alias("keys"))  # a word's glyphs
    words = laid.groupBy(*line, "word").agg(F.sort_array(F.collect_list("x")).alias("items")).join(word_memory(keys, memory), [*line, "word"])
    words = settle(words, lexicon)
    lines = words.groupBy(*line).agg(F.sort_array(F.collect_list(F.struct("word", "items"))).alias("words"))  # a line's words
    told = reference.select(*line, F.col("text").alias("reference")) if reference is not None else None
    lines = lines.join(told, line, "left") if told is not None else lines.withColumn("reference", F.lit(None).cast("string"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                read = quotes_joined([x for word in _plain(r.words) for x in word["items"]])
                if isinstance(r.reference, str):
                    read = fill_spaces(read, r.reference) or read
                wrong = problems(read)
                out.append((r.file, r.cue, r.line, render_line(read), all(x["text"] is not None for x in read), not wrong, [f"{k}: {why}" for k, why in wrong], [x["text"] for x in read if x["low"]], [f"{x['text']}:{x['via']}" for x in read if x["via"] in ("word", "lexicon", "repair")]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LINES.split(", ")])

    return lines.mapInPandas(run, LINES)
