"""Importing glyph sets: what each offered set would do to the shipped ones, and the evidence it then adds.

All offered sets are planned at once. A set of a shipped name updates it, or adds what it learned since the version it was seeded from; a set
of another name is merged into the shipped set that knows most of its occurrences, or is new. Labels are followed through
joined clusters, so a shape that moved into another cluster isn't lost. What speaks against an import is listed with counts; nothing is changed here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import version_tuple
from .reading import LOOK_ALIKES
from .votes import MIN_VOTES, trusted_label

#: Share of a set's occurrences that a shipped set must know to be its target, and how far positions may differ.
MERGE_SHARE, TOLERANCE = 0.5, 1


@dataclass
class Sets:
    """Sets as tables: ``sets`` (set, learned_with, charset, seeded_from, merged_from array), ``shapes`` (set, key, cluster, n), ``votes`` (set, cluster, top_rel, label, n).

    Columns of ``sets`` that are missing are null.
    """

    sets: DataFrame
    shapes: DataFrame
    votes: DataFrame

    def info(self) -> DataFrame:
        column = lambda c, kind: (F.col(c) if c in self.sets.columns else F.lit(None)).cast(kind).alias(c)
        return self.sets.select("set", *(column(c, "string") for c in ("learned_with", "charset", "seeded_from")), column("merged_from", "array<string>"))


def confirmed(of: Sets) -> DataFrame:
    """Rows (set, key, label, top_rel, n, votes) of clusters whose position with most votes has a trusted label; n counts all members' occurrences."""
    place = ["set", "cluster", "top_rel"]
    found = trusted_label(of.votes, place)
    best = F.row_number().over(Window.partitionBy("set", "cluster").orderBy(F.desc("total"), "top_rel"))
    kept = found.withColumn("_i", best).where("_i = 1 and label <> ''").drop("_i", "reason", "total")
    told = of.votes.where("n > 0").groupBy(*place).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("votes"))  # labels of a position
    seen = of.shapes.groupBy("set", "cluster").agg(F.sum("n").alias("n"))
    heads = of.shapes.where("key = cluster").select("set", "cluster")
    return kept.join(heads, ["set", "cluster"], "left_semi").join(told, place).join(seen, ["set", "cluster"]).withColumnRenamed("cluster", "key")


def targets(offered: Sets, shipped: Sets, mine: DataFrame) -> DataFrame:
    """Rows (set, target, share): for offered sets of no shipped name, the shipped set of their charset that knows the largest share of their confirmed occurrences, if that is half.

    A set and a shipped one meet on the keys they share; the sums are made before anything else is joined. Ties go to the smaller name.
    """
    named = shipped.info().select("set")
    apart = mine.join(named, "set", "left_anti")
    total = apart.groupBy("set").agg(F.sum("n").alias("_total"))
    theirs = shipped.shapes.select(F.col("set").alias("target"), "key").distinct()
    shared = apart.join(theirs, "key").groupBy("set", "target").agg(F.sum("n").alias("_known")).join(total, "set")
    charset = lambda of, name: of.info().select(F.col("set").alias(name), F.col("charset").alias(f"_{name}"))
    met = shared.join(charset(offered, "set"), "set").join(charset(shipped, "target"), "target").where(F.col("_set").eqNullSafe(F.col("_target")))
    met = met.withColumn("share", F.col("_known") / F.col("_total")).where(F.col("share") >= MERGE_SHARE)
    return met.groupBy("set").agg(F.min_by("target", F.struct(-F.col("share"), F.col("target"))).alias("target"), F.max("share").alias("share"))


def actions(offered: Sets, shipped: Sets, seeds: Sets | None, mine: DataFrame) -> DataFrame:
    """Rows (set, learned_with, charset, action, target, share, seed): update, delta, merge, skip or new."""
    info = offered.info()
    s = shipped.info().select(F.col("set").alias("target"), F.col("charset").alias("target_charset"), F.col("merged_from").alias("_merged"), F.lit(True).alias("_shipped"))
    aimed = info.join(targets(offered, shipped, mine), "set", "left").withColumnRenamed("target", "_other")
    same = s.select(F.col("target").alias("set"), F.lit(True).alias("_named"))
    aimed = aimed.join(same, "set", "left").withColumn("target", F.when(F.col("_named"), F.col("set")).otherwise(F.col("_other"))).join(s, "target", "left")
    if seeds is not None:
        known = seeds.sets.select("set", F.col("version").alias("seeded_from"), F.lit(True).alias("_seed")).distinct()
        aimed = aimed.join(known, ["set", "seeded_from"], "left")
    else:
        aimed = aimed.withColumn("_seed", F.lit(None).cast("boolean"))
    action = (
        F.when(F.col("_named") & F.col("_seed"), "delta").when(F.col("_named"), "update").when(F.col("target").isNull(), "new")
        .when(F.array_contains("_merged", F.col("set")), "skip").otherwise("merge")
    )
    return aimed.select("set", "learned_with", "charset", "target_charset", action.alias("action"), "target", "share", F.when(F.col("_seed"), F.col("seeded_from")).alias("seed"))


def differences(offered: Sets, shipped: Sets, seeds: Sets | None, aimed: DataFrame, mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Rows (set, key, what, have, get, n): what an import would do to each label: new, changed, lost or ambiguous.

    For updates a shipped label is followed to the cluster that its shape is in now. Where that has no trusted label, but only look-alikes that were read twice, the shipped one among
    them, words decide from now on: ambiguous, not lost. A delta brings clusters whose votes aren't those of its seed.
    """
    goal = aimed.select("set", "action", "target")
    was = goal.where("target is not null").join(theirs.select(F.col("set").alias("target"), "key", F.col("label").alias("have"), F.col("top_rel").alias("_top")), "target")
    now = mine.select("set", "key", F.col("label").alias("get"), "n", "votes", "top_rel")
    fresh = now.join(goal, "set").join(was.select("set", "key", "have"), ["set", "key"], "left")
    changed = fresh.where("action = 'merge' and have is not null and have <> get").select("set", "key", F.lit("changed").alias("what"), "have", "get", "n")
    added = fresh.where("action <> 'skip' and have is null")
    if seeds is not None:
        seed = aimed.where("seed is not null").select("set", F.col("seed").alias("version")).join(seeds.shapes, ["set", "version"]).select("set", "version", "key", F.col("cluster").alias("_c"))
        before = seeds.votes.where("n > 0").groupBy("set", "version", F.col("cluster").alias("_c"), F.col("top_rel").alias("_t")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("_votes"))
        met = added.where("action = 'delta'").join(seed, ["set", "key"]).join(before, ["set", "version", "_c"]).where(F.abs(F.col("_t") - F.col("top_rel")) <= TOLERANCE)
        nearest = met.groupBy("set", "key").agg(F.min_by("_votes", F.struct(F.abs(F.col("_t") - F.col("top_rel")), F.col("_t"))).alias("_votes"))
        entries = lambda c: F.sort_array(F.map_entries(c))
        unchanged = nearest.join(now.select("set", "key", "votes"), ["set", "key"]).where(entries("votes") == entries("_votes"))
        added = added.join(unchanged.select("set", "key"), ["set", "key"], "left_anti")
    added = added.select("set", "key", F.lit("new").alias("what"), F.lit(None).cast("string").alias("have"), "get", "n")
    place = offered.shapes.select("set", "key", "cluster")
    follow = was.where("action = 'update'").join(place, ["set", "key"], "left")
    own = now.select("set", "key", F.col("get").alias("_own"), F.col("n").alias("_own_n"))
    moved = now.select("set", F.col("key").alias("cluster"), F.col("get").alias("_moved"), F.col("n").alias("_moved_n"))
    follow = follow.join(own, ["set", "key"], "left").join(moved, ["set", "cluster"], "left").withColumns({"get": F.coalesce("_own", "_moved"), "n": F.coalesce("_own_n", "_moved_n")})
    open_ = follow.where("get is null and cluster is not null").select("set", "key", "cluster", "have", "_top")
    near = open_.join(offered.votes.where(F.col("n") >= MIN_VOTES), ["set", "cluster"]).withColumn("_o", F.abs(F.col("top_rel") - F.col("_top"))).where(F.col("_o") <= TOLERANCE)
    position = F.min(F.struct("_o", "top_rel")).over(Window.partitionBy("set", "key"))
    voted = near.withColumn("_p", position).where("top_rel = _p.top_rel").groupBy("set", "key", "have").agg(F.collect_set("label").alias("_v"))
    doubtful = voted.where(F.array_contains("_v", F.col("have")) & F.forall("_v", lambda x: x.isin(*LOOK_ALIKES))).select("set", "key", F.lit(True).alias("_doubt"))
    followed = follow.join(doubtful, ["set", "key"], "left")
    what = F.when(F.col("get").isNull(), F.when(F.col("_doubt"), "ambiguous").otherwise("lost")).when(F.col("get") != F.col("have"), "changed")
    kept = followed.withColumn("what", what).where("what is not null").select("set", "key", "what", "have", "get", "n")
    return added.unionByName(changed).unionByName(kept)


def plan(offered: Sets, shipped: Sets, seeds: Sets | None = None, min_version: str = "0.0.0", allow_unversioned: bool = False, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(plans, labels): a row for each offered set (set, action, target, seed, learned_with, new, changed, lost, ambiguous, refused), and what it does to each label.

    ``seeds`` are shipped sets of earlier versions (a column version in each table). refused lists why a set should not be imported: learned with no version or one
    before ``min_version``, another charset than its target, labels that change, disagree or get lost, merged before, or nothing confirmed. ``cut`` writes an intermediate table and reads it again (a store's ``staged``, or a checkpoint), so that steps
    aren't planned and run once for each of their uses.
    """
    mine, theirs = cut(confirmed(offered)), cut(confirmed(shipped))
    aimed = cut(actions(offered, shipped, seeds, mine))
    labels = cut(differences(offered, shipped, seeds, aimed, mine, theirs))
    kinds = ("new", "changed", "lost", "ambiguous")
    counts = labels.groupBy("set").agg(*(F.count_if(F.col("what") == k).alias(k) for k in kinds))
    met = aimed.join(counts, "set", "left").fillna(0, list(kinds))
    version = F.when(F.col("learned_with").rlike(r"^\d+\.\d+\.\d+"), version_tuple(F.col("learned_with")))
    said = lambda test, text: F.when(F.coalesce(test, F.lit(False)), text if isinstance(text, Column) else F.lit(text))
    count = lambda c, text: F.format_string(text, F.col(c))
    is_ = lambda a: F.col("action") == a
    why = F.array_compact(
        F.array(
            said(version.isNull() & ~F.lit(allow_unversioned), "no version"), said(version < version_tuple(F.lit(min_version)), F.concat(F.lit("learned with "), "learned_with", F.lit(f", before {min_version}"))),
            said(is_("update") & ~F.col("charset").eqNullSafe(F.col("target_charset")), "another charset"),
            said((is_("update") | is_("merge")) & (F.col("changed") > 0), F.when(is_("merge"), count("changed", "%d labels disagree")).otherwise(count("changed", "%d labels change"))),
            said(is_("update") & (F.col("lost") > 0), count("lost", "%d labels lost")), said(is_("skip"), F.concat(F.lit("merged before into "), "target")), said(is_("new") & (F.col("new") == 0), "nothing confirmed"),
        )
    )
    return cut(met.select("set", "action", "target", "seed", "learned_with", *kinds, why.alias("refused"))), labels


def accepted(plans: DataFrame, labels: DataFrame, flagged: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Plans to carry out: without refusals, without a new label among ``flagged`` (set, key), and deltas only where they bring something; with ``force`` all but those to skip."""
    open_ = plans.where("action <> 'skip'")
    if force:
        return open_
    open_ = open_.where((F.size("refused") == 0) & ~((F.col("action") == "delta") & (F.col("new") == 0)))
    return open_ if flagged is None else open_.join(labels.where("what = 'new'").join(flagged.select("set", "key"), ["set", "key"], "left_semi").select("set"), "set", "left_anti")


def additions(chosen: DataFrame, offered: Sets, seeds: Sets | None = None) -> DataFrame:
    """Votes (set, target, cluster, top_rel, label, n) that merges and deltas of ``chosen`` plans add to their targets.

    A delta leaves out what its seed had for the cluster, whichever of the cluster's shapes carried it then.
    """
    gained = offered.votes.where("n > 0").join(chosen.where("action in ('merge', 'delta')").select("set", "target", "seed"), "set")
    if seeds is not None:
        members = offered.shapes.select("set", F.col("key").alias("_member"), "cluster")
        heads = seeds.shapes.where("key = cluster").select("set", F.col("version").alias("seed"), F.col("key").alias("_member"))
        had = seeds.votes.where("n > 0").select("set", F.col("version").alias("seed"), F.col("cluster").alias("_member"), F.col("top_rel").alias("_t"), "label", F.col("n").alias("_n")).join(heads, ["set", "seed", "_member"], "left_semi")
        carried = had.join(members, ["set", "_member"]).groupBy("set", "seed", "cluster", F.col("_t").alias("top_rel"), "label").agg(F.sum("_n").alias("_had"))
        gained = gained.join(carried, ["set", "seed", "cluster", "top_rel", "label"], "left").withColumn("n", F.col("n") - F.coalesce("_had", F.lit(0)))
    return gained.where("n > 0").select("set", "target", "cluster", "top_rel", "label", "n")
