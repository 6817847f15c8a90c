"""Mergeable state: additive merges, deltas against a seed, import plans, replay of journals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def additive_merge(parts: list[DataFrame], keys: list[str], n: str = "n") -> DataFrame:
    """The sum of counters by key; a merge in any order and grouping gives the same."""
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum(n).alias(n))


def delta(now: DataFrame, seed: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """What ``now`` has beyond ``seed``: positive differences alone."""
    left = now.join(seed.withColumnRenamed(n, "_seed"), keys, "left")
    return left.withColumn(n, F.col(n) - F.coalesce("_seed", F.lit(0))).where(F.col(n) > 0).select(*keys, n)


def import_plan(target: DataFrame, offered: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Per key what an import does: new, same, changed, lost (offered nothing), or ambiguous (offered no trusted label)."""
    t, o = target.select(key, F.col(label).alias("have"), F.lit(True).alias("_t")), offered.select(key, F.col(label).alias("get"), F.lit(True).alias("_o"))
    met = t.join(o, key, "full")
    action = (
        F.when(F.col("_o").isNull(), "lost").when(F.col("_t").isNull(), F.when(F.col("get").isNull(), "ambiguous").otherwise("new"))
        .when(F.col("get").isNull(), "ambiguous").when(F.col("have").eqNullSafe(F.col("get")), "same").otherwise("changed")
    )
    return met.select(key, action.alias("action"), "have", "get")


def seed_actions(shipped: DataFrame, present: DataFrame, name: str, version: str) -> DataFrame:
    """Per set what seeding does: add what is missing, replace older, keep the rest, retire what is no longer shipped."""
    s, p = shipped.select(name, F.col(version).alias("_s")), present.select(name, F.col(version).alias("_p"))
    action = F.when(F.col("_p").isNull(), "add").when(F.col("_s").isNull(), "retire").when(F.col("_s") > F.col("_p"), "replace").otherwise("keep")
    return s.join(p, name, "full").select(name, action.alias("action"))


def replay(journal: DataFrame, seen: DataFrame, run: str = "run") -> DataFrame:
    """Votes of a journal (run, key, label, n) of runs that the state hasn't seen, added up; replaying twice adds nothing."""
    return journal.join(seen.select(run).distinct(), run, "left_anti").groupBy("key", "label").agg(F.sum("n").alias("n"))


def replay_in_order(journal: DataFrame, seen: DataFrame, keys: list[str], run: str = "run", order: str = "seq_no") -> DataFrame:
    """Votes of a journal (run, seq_no, op, n and keys) of unseen runs, in their order: 'vote' adds n, 'clear' takes back all before it.

    What comes before a key's last clear cancels out, so a window finds that and the rest is a sum. Keys cleared last have n 0.
    """
    new = journal.join(seen.select(run).distinct(), run, "left_anti")
    last = new.where("op = 'clear'").groupBy(*keys).agg(F.max(F.struct(run, order)).alias("_c"))  # a partial aggregate, so a hot key is a row a task
    counts = F.when((F.col("op") == "vote") & (F.col("_c").isNull() | (F.struct(run, order) > F.col("_c"))), F.col("n")).otherwise(0)
    return new.join(last, keys, "left").groupBy(*keys).agg(F.sum(counts).alias("n"))


def credit_occurrences(shapes: DataFrame, counts: DataFrame, key: str, file: str) -> DataFrame:
    """Shapes (key, n) with the occurrences of one run's files (file, key, n) added: a shape starts at one, and a key is credited once a run, from its first file."""
    first = counts.groupBy(key).agg(F.min_by("n", file).alias("_n"))
    return shapes.join(first, key, "left").withColumn("n", F.col("n") + F.greatest(F.coalesce(F.col("_n") - 1, F.lit(0)), F.lit(0))).drop("_n")


def target_conflicts(offered: DataFrame, near: DataFrame, target: DataFrame) -> DataFrame:
    """Offered labels (key, label) that contradict the target: the nearest target shape with another label, where no nearer or equal one agrees.

    ``near`` (key, ref_key, ratio) pairs them, ``target`` (ref_key, label). Returns key, label, ref_key, ref_label, ratio.
    """
    known = target.where("label is not null").select("ref_key", F.col("label").alias("ref_label"))
    met = near.join(offered.where("label is not null").select("key", "label"), "key").join(known, "ref_key")
    agrees = F.min(F.when(F.col("label") == F.col("ref_label"), F.col("ratio"))).alias("_a")
    other = F.min(F.when(F.col("label") != F.col("ref_label"), F.struct("ratio", "ref_key", "ref_label"))).alias("_o")
    found = met.groupBy("key", "label").agg(agrees, other).where("_o is not null and (_a is null or _a > _o.ratio)")
    return found.select("key", "label", "_o.ref_key", "_o.ref_label", "_o.ratio")


def members_missing(candidate: DataFrame, current: DataFrame, group: str, member: str) -> DataFrame:
    """Members of each group that the candidate has and the current state lacks, once each."""
    return candidate.select(group, member).distinct().join(current.select(group, member).distinct(), [group, member], "left_anti")


def publishable(table: DataFrame, private: tuple[str, ...] = ("words", "learned_sources", "acc")) -> DataFrame:
    """A set without the columns that stay with its owner."""
    return table.drop(*private)


def redacted(payload: Column, private: tuple[str, ...] = ("srt", "db")) -> Column:
    """A JSON object's text without some of its fields; null stays null."""
    fields = F.from_json(payload, "map<string,string>")  # a field that is no text keeps its JSON text
    kept = F.map_filter(fields, lambda k, v: ~k.isin(*private))
    return F.to_json(kept)
