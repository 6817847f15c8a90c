"""Votes: independent observations of a label per key, and the rules that make them evidence.

A table of votes has one row per key and label with a count. Every rule is two partial aggregates, so a
hot key reaches a task as one row per map task and label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_VOTES = 2
DISSENT_VOTES = 3
OVERRIDE_VOTES = 3
STRAY_TOTAL = 10


def count_votes(observations: DataFrame, keys: list[str], label: str) -> DataFrame:
    """One row per key and label with how often it was observed, n."""
    return observations.groupBy(*keys, F.col(label).alias("label")).agg(F.count("*").alias("n"))


def one_vote_per_unit(observations: DataFrame, unit: str, keys: list[str], label: str) -> DataFrame:
    """Votes where a unit (a cue, an order) says a label of a key once however often it repeats it."""
    return count_votes(observations.select(unit, *keys, label).distinct(), keys, label)


def summary(votes: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: total (of all counts), top (largest), label (of the largest, first by name), labels (with a positive count)."""
    return votes.groupBy(*keys).agg(
        F.sum("n").alias("total"),
        F.max("n").alias("top"),
        F.min_by("label", F.struct((-F.col("n")).alias("n"), F.col("label").alias("label"))).alias("label"),
        F.count_if(F.col("n") > 0).alias("labels"),
    )


def verdict(total: Column, top: Column, labels: Column) -> Column:
    """Why a majority isn't trusted yet, or an empty text.

    Two agreeing votes and two thirds of all suffice; once a vote dissents, the majority needs a third.
    Shares are compared as whole numbers.
    """
    short = (3 * top < 2 * total) | ((labels > 1) & (top < DISSENT_VOTES))
    return F.when(total < MIN_VOTES, "unconfirmed").when(short, "conflict").otherwise("")


def trusted_label(votes: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: label (null unless trusted), reason, total. Cleared votes (0 or less) are no dissent, but count in total."""
    found = summary(votes, keys).withColumn("reason", verdict(F.col("total"), F.col("top"), F.col("labels")))
    return found.select(*keys, F.when(F.col("reason") == "", F.col("label")).alias("label"), "reason", "total")


def override_label(votes: DataFrame, keys: list[str], confusable: list[str] = ()) -> DataFrame:
    """Keys whose label may overrule a contradicting read: three votes and three quarters of all, and no look-alikes among the labels."""
    found = summary(votes, keys)
    if confusable:
        alike = votes.where(F.col("n") > 0).groupBy(*keys).agg((F.count_if(F.col("label").isin(*confusable)) > 1).alias("alike"))
        found = found.join(alike, keys, "left").where(~F.coalesce("alike", F.lit(False)))
    return found.where((F.col("top") >= OVERRIDE_VOTES) & (4 * F.col("top") >= 3 * F.col("total"))).select(*keys, "label", "top", "total")


def without_strays(votes: DataFrame, keys: list[str]) -> DataFrame:
    """Votes without lone ones among at least ten of their key: those are stray readings, not labels."""
    total = F.sum(F.greatest("n", F.lit(0))).over(Window.partitionBy(*keys))
    return votes.withColumn("_total", total).where((F.col("n") > 0) & ~((F.col("n") == 1) & (F.col("_total") >= STRAY_TOTAL))).drop("_total")


def with_priors(votes: DataFrame, keys: list[str], priors: DataFrame | None) -> DataFrame:
    """Votes with a prior (keys, label) as one vote more, for keys that have votes."""
    if priors is None:
        return votes
    seen = votes.where(F.col("n") > 0).select(*keys).distinct()
    added = priors.where("label is not null").join(seen, keys, "left_semi").select(*keys, "label", F.lit(1).cast("long").alias("n"))
    return votes.select(*keys, "label", "n").unionByName(added).groupBy(*keys, "label").agg(F.sum("n").alias("n"))


def read_decision(votes: DataFrame, keys: list[str], confusable: list[str] = (), priors: DataFrame | None = None, alike: Column | None = None) -> DataFrame:
    """How to read a key: 'ambiguous' if its labels are the look-alikes alone, leaving strays aside; else its trusted label.

    ``priors`` (keys, label) are guesses from another set: one vote beside others, and the label itself (reason 'prior') where there are none. Where ``alike`` holds of a label, its
    font draws that look-alike as another, and a key read as it alone is ambiguous too.
    """
    votes = with_priors(votes, keys, priors)
    labels = without_strays(votes, keys).groupBy(*keys).agg(F.sort_array(F.collect_set("label")).alias("voted"))
    ambiguous = (F.size("voted") > 1) & F.forall("voted", lambda x: x.isin(*confusable)) if confusable else F.lit(False)
    found = trusted_label(votes, keys).join(labels, keys, "left").withColumn("_a", F.coalesce(ambiguous, F.lit(False)))
    if alike is not None:
        found = found.withColumn("_a", F.col("_a") | F.coalesce(alike & F.col("label").isNotNull(), F.lit(False)))
    found = found.select(
        *keys, F.when(~F.col("_a"), F.col("label")).alias("label"), F.when(F.col("_a"), "ambiguous").otherwise(F.col("reason")).alias("reason"), F.coalesce(F.size("voted"), F.lit(0)).alias("n_labels")
    )
    if priors is None:
        return found
    guess = priors.where("label is not null").groupBy(*keys).agg(F.min("label").alias("_p"))
    met = found.join(guess, keys, "full").withColumn("_g", F.coalesce("n_labels", F.lit(0)) == 0)
    label = F.when(F.col("_g") & F.col("_p").isNotNull(), F.col("_p")).otherwise(F.col("label"))
    return met.select(*keys, label.alias("label"), F.when(F.col("_g") & F.col("_p").isNotNull(), "prior").otherwise(F.col("reason")).alias("reason"), F.coalesce("n_labels", F.lit(0)).alias("n_labels"))


def options(votes: DataFrame, keys: list[str], alike: Column | None = None) -> DataFrame:
    """Per key the texts it may stand for (options, sorted): labels with two votes, those of several letters only as the majority; else the majority alone.

    Where ``alike`` holds of every label, I and l are both possible.
    """
    top = F.max(F.struct("n", "label")).over(Window.partitionBy(*keys))["label"]
    marked = votes.where((F.col("n") > 0) & (F.col("label") != "")).withColumn("_top", top)
    backed = (F.col("n") >= MIN_VOTES) & ((F.length("label") == 1) | (F.col("label") == F.col("_top")))
    found = marked.groupBy(*keys).agg(F.sort_array(F.collect_set(F.when(backed, F.col("label")))).alias("options"), F.max("_top").alias("_top"))
    found = found.withColumn("options", F.when(F.size("options") == 0, F.array("_top")).otherwise(F.col("options")))
    if alike is not None:
        both = F.forall("options", lambda x: x.isin("I", "l")) & alike
        found = found.withColumn("options", F.when(both, F.array(F.lit("I"), F.lit("l"))).otherwise(F.col("options")))
    return found.select(*keys, "options")


def settled(votes: DataFrame, keys: list[str], kept: DataFrame | None = None, confusable: list[str] = (), parts: DataFrame | None = None) -> DataFrame:
    """Split keys into settled and interim evidence.

    Settled: trusted; marked to keep (``kept``, or a prior from another set given there); look-alikes read twice, as a word decides them; and keys without votes that are ``parts`` of a settled
    sequence.
    """
    found = trusted_label(votes, keys).withColumn("settled", F.col("reason") == "")
    if confusable:
        doubtful = read_decision(votes, keys, confusable).where("reason = 'ambiguous'").select(*keys, F.lit(True).alias("_alike"))
        found = found.join(doubtful, keys, "left").withColumn("settled", F.col("settled") | (F.coalesce("_alike", F.lit(False)) & (F.col("total") >= MIN_VOTES))).drop("_alike")
    for more in (kept, parts):
        if more is not None:
            marked = more.select(*[c for c in keys if c in more.columns]).distinct().withColumn("_kept", F.lit(True))
            found = found.join(marked, [c for c in marked.columns if c != "_kept"], "left")
            found = found.withColumn("settled", F.col("settled") | (F.coalesce("_kept", F.lit(False)) & (F.lit(more is kept) | (F.col("total") <= 0)))).drop("_kept")
    return found.select(*keys, F.when(F.col("settled"), "settled").otherwise("interim").alias("part"), "label", "total")


def key_frequency(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row: distinct keys, keys seen once, rows, and whether the source looks rescaled (200 keys, half of them seen once)."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    found = counts.agg(F.count("*").alias("n_keys"), F.count_if(F.col("n") == 1).alias("n_once"), F.sum("n").alias("n_rows"))
    return found.withColumn("rescaled", (F.col("n_keys") >= 200) & (2 * F.col("n_once") >= F.col("n_keys")))


def prune_members(members: DataFrame, group: str, member: str, most: int = 24) -> DataFrame:
    """Members seen at least twice, per group the ``most`` seen most often; ties to smaller members."""
    counts = members.groupBy(group, member).agg(F.count("*").alias("n")).where("n >= 2")
    order = Window.partitionBy(group).orderBy(F.desc("n"), member)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def style_counts(rows: DataFrame, keys: list[str], flag: Column) -> DataFrame:
    """Evidence for and against a style flag, and the decision where one side has more; a tie decides nothing."""
    found = rows.groupBy(*keys).agg(F.count_if(~flag).alias("no"), F.count_if(flag).alias("yes"))
    return found.withColumn("styled", F.when(F.col("yes") > F.col("no"), True).when(F.col("yes") < F.col("no"), False))


def guess_language(texts: DataFrame, key: str, text: str, stopwords: DataFrame, least: int = 20) -> DataFrame:
    """Per text the language with the most stopword hits: at least ``least``, and half as many again as the runner-up; else null.

    ``stopwords`` (lang, word) is a fixed list of a few hundred rows.
    """
    words = texts.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}]+)"), F.lit(1))).alias("word"))
    hits = words.join(F.broadcast(stopwords), "word").groupBy(key, "lang").agg(F.count("*").alias("n"))
    first = F.max(F.struct("n", F.col("lang").alias("lang")))
    best = hits.groupBy(key).agg(first.alias("b"), F.sort_array(F.collect_list("n"), asc=False).alias("all"))  # a count a language
    second = F.coalesce(F.get("all", F.lit(1)), F.lit(0))
    won = (F.col("b.n") >= least) & (2 * F.col("b.n") >= 3 * second)
    return texts.select(key).join(best.select(key, F.when(won, F.col("b.lang")).alias("language"), F.col("b.n").alias("hits")), key, "left").select(key, "language", F.coalesce("hits", F.lit(0)).alias("hits"))


def first_samples(rows: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Per key how often it occurs, n, and the fields of its first row."""
    first = F.min_by(F.struct(*fields), F.struct(*order)).alias("_f")
    return rows.groupBy(key).agg(F.count("*").alias("n"), first).select(key, "n", *[F.col("_f")[f].alias(f) for f in fields])


def combined_style(geometry_no: Column, geometry_yes: Column, tags_no: Column, tags_yes: Column) -> Column:
    """Whether a style holds: by geometry where that has an opinion, else by tags."""
    return F.when(geometry_no != geometry_yes, geometry_yes > geometry_no).otherwise(tags_yes > tags_no)


def track_fingerprint(glyphs: DataFrame, track: str, key: str, height: str) -> DataFrame:
    """Per track: glyphs, unique keys, the thousandths of them seen once, the most frequent height (ties to the smaller), and how many keys repeat."""
    counts = glyphs.groupBy(track, key).agg(F.count("*").alias("n"))
    totals = counts.groupBy(track).agg(F.sum("n").alias("glyphs"), F.count("*").alias("unique"), F.count_if(F.col("n") == 1).alias("_once"))
    tall = glyphs.groupBy(track, height).agg(F.count("*").alias("n"))
    modal = tall.groupBy(track).agg(F.min_by(height, F.struct((-F.col("n")).alias("n"), F.col(height).alias("h"))).alias("modal_height"))
    share = F.floor((1000 * F.col("_once") + F.floor(F.col("unique") / 2)) / F.col("unique")).cast("long")
    return totals.join(modal, track).select(track, "glyphs", "unique", share.alias("once_permille"), "modal_height", (F.col("unique") - F.col("_once")).alias("repeated"))
