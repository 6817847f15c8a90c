"""Reading cues from evidence: word memory, keys, gaps, and the choice between sources of text."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

BATCH = 16
#: Tracks of a frame that have a key; so many pairs a track of such a key are counted, at most.
FEW = 64


def word_memory(words: DataFrame, memory: DataFrame) -> DataFrame:
    """Append memory: the text that two thirds of a word's earlier readings (keys, text, n) agree on."""
    found = memory.groupBy("keys").agg(F.sum("n").alias("total"), F.max(F.struct("n", "text")).alias("b"))
    return words.join(found.where(3 * F.col("b.n") >= 2 * F.col("total")).select("keys", F.col("b.text").alias("memory")), "keys", "left")


def read_glyphs(glyphs: DataFrame, exact: DataFrame, near: DataFrame, tolerance: int = 1) -> DataFrame:
    """Append text and via to glyphs (key, top_rel): the label of the nearest known position of its key, else of its near key.

    ``exact`` (key, top_rel, label, insert_no) are known positions, a null label a refusal; ``near`` (key, ref_key) maps
    unknown keys. Ties go to the position known first.
    """
    def lookup(rows: DataFrame, by: str, via: str) -> DataFrame:
        known = exact.select(F.col("key").alias("_k"), F.col("top_rel").alias("_t"), "label", "insert_no")
        off = F.abs(F.col("top_rel") - F.col("_t"))
        met = rows.join(known, (F.col(by) == F.col("_k")) & (off <= tolerance))
        best = F.min_by(F.struct(F.col("label").alias("text"), F.lit(via).alias("via")), F.struct(off.alias("o"), "insert_no"))
        return met.groupBy("key", "top_rel").agg(best.alias("r")).select("key", "top_rel", "r.*")

    wanted = glyphs.select("key", "top_rel").distinct()
    first = lookup(wanted, "key", "exact")
    rest = wanted.join(exact.select("key").distinct(), "key", "left_anti").join(near, "key")
    return glyphs.join(first.union(lookup(rest, "ref_key", "near")), ["key", "top_rel"], "left")


def unknown_share(read: DataFrame, cue: list[str]) -> DataFrame:
    """Per cue its glyphs without text, and the phase: training where over a hundredth is unknown."""
    found = read.groupBy(*cue).agg(F.count_if(F.col("text").isNull()).alias("unknown"), F.count("*").alias("n"))
    return found.withColumn("phase", F.when(100 * F.col("unknown") > F.col("n"), "training").otherwise("inference"))


def arbitrate(own: Column, own_ok: Column, teacher: Column, teacher_fits: Column, own_filled: Column | None = None, repaired: Column | None = None) -> Column:
    """(text, source) of a cue by precedence.

    ``own`` is its own reading (tags and all), ``own_ok`` whether that is complete, ``own_filled`` the reading with only its unsure breaks taken from the
    teacher. Without a teacher a complete reading stands. Where both have the same characters the own one decides styles; where they have the same letters,
    the own one decides breaks; a teacher whose text misfits the glyphs (``teacher_fits`` false) gives way to a complete reading; else the teacher is
    taken, its letters being arbitrated one by one. Then a repair, then a placeholder.
    """
    pick = lambda text, source: F.struct(text.alias("text"), F.lit(source).alias("source"))
    bare = lambda c: F.regexp_replace(c, r"(?i)</?[biu]>", "")
    letters = lambda c: F.regexp_replace(bare(c), r"\s", "")
    done = own.isNotNull() & F.coalesce(own_ok, F.lit(False))
    choice = F.when(done & (teacher.isNull() | (bare(own) == bare(teacher))), pick(own, "own"))
    choice = choice.when(done & (letters(own) == letters(teacher)), pick(own, "spaces from geometry"))
    if own_filled is not None:
        choice = choice.when(own_filled.isNotNull() & (letters(own_filled) == letters(teacher)), pick(own_filled, "spaces filled"))
    choice = choice.when(done & ~F.coalesce(teacher_fits, F.lit(True)), pick(own, "own against teacher"))
    choice = choice.when(teacher.isNotNull(), pick(teacher, "teacher"))
    if repaired is not None:
        choice = choice.when(repaired.isNotNull(), pick(repaired, "repaired"))
    return choice.otherwise(pick(F.lit("[?]"), "placeholder"))


def classify_gaps(rows: DataFrame, pairs: DataFrame, histogram: DataFrame, bearings: DataFrame | None = None) -> DataFrame:
    """Append is_space: true, false, or null where unsure.

    A pair (ka, kb, gap) seen twice and always alike decides; else, where a space is known to add over four pixels, the gap beyond the pair's
    ``bearings`` (side, key, value): clear of half a space by a fifth of one, three tenths where a bearing is a default, and two pixels at least; else
    how often its gap was inside and between words, ten to one; else the ranges of both.
    """
    pair = pairs.select("ka", "kb", "gap", F.when((F.col("letter") + F.col("space") >= 2) & (F.least("letter", "space") == 0), F.col("space") > 0).alias("by_pair"))
    gap = histogram.select("gap", F.col("letter").alias("l"), F.col("space").alias("s"))
    ends = histogram.agg(F.max(F.when(F.col("letter") > 0, F.col("gap"))).alias("max_l"), F.min(F.when(F.col("space") > 0, F.col("gap"))).alias("min_s"))
    met = rows.join(pair, ["ka", "kb", "gap"], "left").join(gap, "gap", "left").crossJoin(F.broadcast(ends))  # a row
    seen = F.coalesce(F.col("l") + F.col("s"), F.lit(0)) > 0
    counted = F.when(F.col("l") >= 10 * F.col("s"), False).when(F.col("s") >= 10 * F.col("l"), True)
    below = (F.col("gap") <= F.col("max_l")) & (F.col("min_s").isNull() | (F.col("gap") < F.col("min_s")))
    above = (F.col("gap") >= F.col("min_s")) & (F.col("max_l").isNull() | (F.col("gap") > F.col("max_l")))
    by_range = F.when(F.coalesce(below, F.lit(False)), False).when(F.coalesce(above, F.lit(False)), True)
    result = F.when(F.col("by_pair").isNotNull(), F.col("by_pair"))
    if bearings is not None:
        side = lambda x, key, name: bearings.where(F.col("side") == x).select(F.col("key").alias(key), F.col("value").alias(name))
        one = lambda x: F.max(F.when(F.col("side") == x, F.col("value"))).alias(f"_{x}")
        met = met.join(side("right", "ka", "_r"), "ka", "left").join(side("left", "kb", "_l"), "kb", "left")
        met = met.crossJoin(F.broadcast(bearings.agg(one("right_default"), one("left_default"), one("space"))))  # a row
        beyond = F.col("gap") - F.coalesce("_r", "_right_default") - F.coalesce("_l", "_left_default") - F.col("_space") / 2
        margin = F.greatest(F.lit(2.0), F.when(F.col("_r").isNotNull() & F.col("_l").isNotNull(), 0.2).otherwise(0.3) * F.col("_space"))
        result = result.when(F.col("_space") > 4, F.when(beyond < -margin, False).when(beyond > margin, True))
    result = result.when(seen, counted).otherwise(by_range)
    return met.withColumn("is_space", result).drop("by_pair", "l", "s", "max_l", "min_s", "_r", "_l", "_right_default", "_left_default", "_space")


def greedy_batches(cues: DataFrame, size: int = BATCH) -> DataFrame:
    """The first ``size`` cues to ask about per file: each adds most unknown key occurrences for its length.

    Rows (file, cue, n_glyphs, keys: array of the cue's unknown keys, one for each occurrence). A key weighs as much as it
    occurs in the file. A file's cues are chosen one after the other, so a file is one group; the number of rounds is
    bounded by ``size``.
    """
    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        weight, left = Counter(k for ks in frame["keys"] for k in ks), {r.cue: (set(r.keys), r.n_glyphs) for r in frame.itertuples()}
        covered: set = set()
        score = lambda c: -sum(weight[k] for k in left[c][0] - covered) / (1 + 0.02 * left[c][1])
        heap, out = [(score(c), c) for c in left], []
        heapq.heapify(heap)
        while heap and len(out) < size:  # a score only falls, so one that is still best after a second look is best
            _, cue = heapq.heappop(heap)
            now = (score(cue), cue)
            if heap and now > heap[0]:
                heapq.heappush(heap, now)
                continue
            covered |= left[cue][0]
            out.append((frame["file"].iloc[0], cue, len(out)))
        return pd.DataFrame(out, columns=["file", "cue", "batch_no"])

    return cues.select("file", "cue", "n_glyphs", "keys").groupBy("file").applyInPandas(choose, "file string, cue long, batch_no int")


def census_groups(tracks: DataFrame, keys: DataFrame, frame: str, least_permille: int = 500) -> DataFrame:
    """Tracks that share most of their glyphs: rows (track, leader), largest track first within a frame size.

    A track joins the first leader that covers ``least_permille`` of its keys; else it leads. A leader has one of the rarest few keys of such a track, so
    tracks meet on those (prefix filtering) and on keys that few tracks have, and what a pair shares of them is counted. A track's other keys, common ones, make
    no group; they are compared only for pairs that they could decide. The ordered choice folds over a frame's tracks alone.
    """
    framed = keys.select("track", "key").distinct().join(tracks.select("track", frame).distinct(), "track")
    order = F.row_number().over(Window.partitionBy("track", frame).orderBy(F.col("key").isNull(), "_f", "key"))
    placed = cut(framed.withColumn("_f", F.count("*").over(Window.partitionBy(frame, "key"))).withColumns({"_o": order, "_n": F.count("key").over(Window.partitionBy("track", frame))}))
    needed = F.greatest(F.ceil(F.col("_n") * least_permille / 1000), F.lit(1))
    meets = (F.col("_o") <= F.col("_n") - needed + 1) | (F.col("_f") <= FEW)
    common = F.sort_array(F.collect_list(F.when(F.col("_f") > FEW, F.col("key"))))  # of a track's keys
    own = placed.groupBy("track", frame).agg(F.count("*").alias("n"), F.max("_n").alias("_n"), common.alias("_common"), F.collect_list(F.when(~meets, F.col("key"))).alias("_rest"))
    own = cut(own.withColumn("_needed", needed))
    held = placed.where(F.col("key").isNotNull() & (F.col("_f") > 1)).select(frame, "key", "track", meets.alias("_meets"))
    a, b = held.where("_meets").select(frame, "key", F.col("track").alias("a")), held.select(frame, "key", F.col("track").alias("b"))
    shared = a.join(b, [frame, "key"]).where("a <> b").groupBy(frame, "a", "b").agg(F.count("*").alias("_c"))
    met = shared.join(own.select(frame, F.col("track").alias("a"), "_needed", F.size("_rest").alias("_left")), [frame, "a"]).where("_c + _left >= _needed")
    sure = met.where("_c >= _needed").select(frame, "a", "b")
    unsure = met.where("_c < _needed").join(own.select(frame, F.col("track").alias("a"), "_rest"), [frame, "a"]).join(own.select(frame, F.col("track").alias("b"), "_common"), [frame, "b"])
    found = sure.unionByName(unsure.where(F.col("_c") + F.size(F.array_intersect("_rest", "_common")) >= F.col("_needed")).select(frame, "a", "b"))
    covering = found.groupBy(F.col("a").alias("track"), frame).agg(F.collect_set("b").alias("by"))
    rows = own.select("track", frame, "n").join(covering, ["track", frame], "left").select(frame, "track", "n", "by")

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        leaders, out = {}, []  # leaders by their turn
        for r in part.sort_values(["n", "track"], ascending=[False, True]).itertuples():
            leader = min((x for x in (() if r.by is None else r.by) if x in leaders), key=leaders.__getitem__, default=None)
            if leader is None:
                leaders[r.track] = len(leaders)
            out.append((r.track, r.track if leader is None else leader))
        return pd.DataFrame(out, columns=["track", "leader"])

    kind = own.schema["track"].dataType.simpleString()
    return rows.groupBy(frame).applyInPandas(fold, f"track {kind}, leader {kind}")


def reline(texts: DataFrame, most_lines: int = 8) -> DataFrame:
    """Split texts (id, text, widths: expected characters of each line) at blanks so that lines fit their widths best.

    Least sum of squared differences, by dynamic programming over words; more lines than words leave text null.
    """
    def split(words: list[str], widths: list[float]) -> list[str] | None:
        n, k = len(words), len(widths)
        if not 0 < k <= min(n, most_lines):
            return None
        ends = [0]
        for w in words:
            ends.append(ends[-1] + len(w) + 1)
        best = {(0, 0): (0.0, None)}
        for line in range(1, k + 1):
            for j in range(line, n - (k - line) + 1):
                options = [(best[line - 1, i][0] + (ends[j] - ends[i] - 1 - widths[line - 1]) ** 2, i) for i in range(line - 1, j) if (line - 1, i) in best]
                best[line, j] = min(options)
        out, j = [], n
        for line in range(k, 0, -1):
            i = best[line, j][1]
            out.append(" ".join(words[i:j]))
            j = i
        return out[::-1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "lines": [None if t is None else split(t.split(), [float(x) for x in w]) for t, w in zip(f["text"], f["widths"], strict=True)]})

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text", "widths").mapInPandas(run, f"id {kind}, lines array<string>")


def until_stable(step: Callable[[DataFrame], DataFrame], state: DataFrame, most: int = 4) -> tuple[DataFrame, int]:
    """``state`` after ``step`` was applied until it changes nothing, ``most`` times at most; and how often it was.

    For reading a file again with what reading it taught. Lineage is cut after each pass (:func:`lineage.cut`).
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in df.columns])), F.sum(F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in df.columns]) % (1 << 32))).first())

    before = mark(state)
    for n in range(1, most + 1):
        state = cut(step(state))
        after = mark(state)
        if after == before:
            return state, n
        before = after
    return state, most


def index_with_notes(scanned: DataFrame, old: DataFrame, keys: list[str], manual: list[str]) -> DataFrame:
    """A corpus index made anew, with the hand-written columns of the old one kept by key; missing ones are empty."""
    return scanned.drop(*manual).join(old.select(*keys, *manual).dropDuplicates(keys), keys, "left").fillna("", manual)


def report(rows: DataFrame, file: str) -> DataFrame:
    """One JSON text a file with its cues by source, and shares."""
    found = rows.groupBy(file, "source").agg(F.count("*").alias("n"))
    by = F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "n"))))
    return found.groupBy(file).agg(F.to_json(F.struct(by.alias("by_source"), F.sum("n").alias("cues"))).alias("report"))
