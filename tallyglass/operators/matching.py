"""Lookups and similarity joins: nearest within a tolerance, near token sets with margins, coverage, comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut, drop, table

#: A token is hot that makes more than one in so many of all; there are as many at most, and each task holds them.
HOT = 200_000
#: Sets of a token's group that meet at once, at most about; longs of a parity map.
BLOCK, LANES = 4096, 4


def nearest_lookup(facts: DataFrame, reference: DataFrame, key: str, fact_id: str, value: str, ref_id: str, ref_value: str, tolerance: float) -> DataFrame:
    """For each fact the reference row of its key nearest in value, within ``tolerance``; ties to the smaller ref_id. Facts without one are left out."""
    met = facts.join(reference, key).withColumn("_off", F.abs(F.col(value) - F.col(ref_value))).where(F.col("_off") <= tolerance)
    best = met.groupBy(fact_id).agg(F.min(F.struct("_off", F.col(ref_id).alias("ref"))).alias("b"))
    return best.select(fact_id, F.col("b.ref").alias("ref_id"), F.col("b._off").alias("distance"))


def token_sets(docs: DataFrame, key: str, text: str, carry: str) -> DataFrame:
    """Distinct token sets: class_id (the smallest key), tokens (sorted), size, copies, and ``carry`` of the class row.

    The texts are read once, into a table of their tokens. Equal sets are found by SHA-256, so that no tokens are exchanged for it.
    """
    words = F.sort_array(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}]+)"), F.lit(1))))
    read = docs.select(key, carry, words.alias("tokens"))  # not filtered here, as a filter would find the words once more
    read = table(read.select(key, carry, "tokens", F.size("tokens").alias("size"), F.unhex(F.sha2(F.array_join("tokens", " "), 256)).alias("_same"), F.monotonically_increasing_id().alias("_row")))
    found = read.where("size > 0").groupBy("_same").agg(F.min(F.struct(key, carry, "size", "_row")).alias("r"), F.count("*").alias("copies"))
    classes = table(found.select(F.col(f"r.{key}").alias("class_id"), "r.size", "copies", F.col(f"r.{carry}").alias(carry), "r._row"))
    sets = classes.join(read.select("_row", "tokens"), "_row").select("class_id", "tokens", "size", "copies", carry)
    sets._tallyglass_parts = (read, classes)  # type: ignore[attr-defined]
    return sets


def _parts(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tokens by _row, of classes and maybe of their copies, and the classes with their _row: the tables of :func:`token_sets`, or else made here."""
    known = getattr(sets, "_tallyglass_parts", None)
    if known is None:
        read = table(sets.withColumn("_row", F.monotonically_increasing_id()))
        known = sets._tallyglass_parts = (read, read.drop("tokens"))  # type: ignore[attr-defined]
    return known


def ranked_sets(sets: DataFrame) -> tuple[DataFrame, int, int]:
    """Sets with their tokens as numbers: class_id, size, ranks (rising; rare tokens have small numbers) and bits (of which hashed tokens the set has an odd number).

    Also the first number of a token that several sets have, and that of one that over BLOCK sets have (copies count as sets in both).
    """
    read, classes = _parts(sets)
    tokens = read.select("_row", F.explode("tokens").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("f"))
    number = table(often.orderBy("f", "token").select("token", "f", F.monotonically_increasing_id().alias("rank")))  # a table, as a number must stay what it is
    first = lambda c: F.min(F.when(c, F.col("rank")))
    total, shared, many = number.agg(F.sum("f"), first(F.col("f") > 1), first(F.col("f") > BLOCK)).first()
    least = (total or 0) // HOT
    hot, rest = number.where(F.col("f") > least).drop("f"), number.where(F.col("f") <= least).drop("f")  # hot ones are broadcast: most of all places, which so stay where they are, and no token is a task
    known = tokens.join(F.broadcast(hot), "token", "left")
    placed = known.where("rank is not null").drop("token").unionByName(known.where("rank is null").drop("rank").join(rest, "token").drop("token"))
    bit = F.pmod(F.xxhash64("rank"), F.lit(64 * LANES)).cast("int")
    lanes = [F.bit_xor(F.when(F.expr(f"_bit div 64 = {i}"), F.expr("shiftleft(1L, _bit % 64)")).otherwise(F.lit(0))) for i in range(LANES)]
    whole = placed.withColumn("_bit", bit).groupBy("_row").agg(F.sort_array(F.collect_list("rank")).alias("ranks"), F.array(*lanes).alias("bits"))
    last = 1 << 62
    out = table(whole.join(classes.select("_row", "class_id"), "_row").select("class_id", F.size("ranks").alias("size"), "ranks", "bits"))  # copies go; the numbers are dealt by _row already
    drop(number)
    return out, last if shared is None else shared, last if many is None else many


def near_join(sets: DataFrame, carry: str, permille: int = 120) -> DataFrame:
    """Pairs a < b of classes whose symmetric difference is at most ``permille`` / 1000 of their mean size.

    Two such sets share so many tokens that the rarest few of each have one in common: sets meet on those (prefix filtering),
    if from the token on both have enough left to share (the first common one shows that), and if their parity maps, which differ in no more bits than the
    sets in tokens, don't rule them out. A token that ends many prefixes is dealt in blocks that meet two by two. Only pairs that are left bring their numbers
    together. Ratios are compared in whole numbers. Steps are tables that go once nothing reads them.
    """
    known, shared, hot = ranked_sets(sets)
    # overlap o >= (1 - r/2) * mean size, and the other set has at least (1 - r/2) / (1 + r/2) of this one's size
    share = (2000 - permille) / (2000 + permille)
    first = F.slice("ranks", 1, (F.col("size") - F.ceil(F.col("size") * share - 1e-9) + 1).cast("int"))
    places = known.select("class_id", "size", "bits", F.posexplode(first).alias("pos", "rank")).where(F.col("rank") >= shared)
    many = places.where(F.col("rank") >= hot).groupBy("rank").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_k")).where("_k > 1")  # few: each ends over BLOCK prefixes
    dealt = places.join(F.broadcast(many), "rank", "left").withColumn("_k", F.coalesce("_k", F.lit(1))).withColumn("_own", F.pmod(F.xxhash64("class_id"), F.col("_k")).cast("int"))
    side = lambda c, to: dealt.select("rank", F.col("class_id").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("size", "pos", "bits")), *to)
    a = side("x", [F.col("_own").alias("_i"), F.explode(F.sequence("_own", F.col("_k") - 1)).alias("_j")])
    b = side("y", [F.col("_own").alias("_j"), F.explode(F.sequence(F.lit(0), F.col("_own"))).alias("_i")])
    total, left = F.col("x_size") + F.col("y_size"), F.least(F.col("x_size") - F.col("x_pos"), F.col("y_size") - F.col("y_pos"))
    apart = sum((F.bit_count(F.col("x_bits")[i].bitwiseXOR(F.col("y_bits")[i])) for i in range(LANES)), F.lit(0))
    once = F.when(F.col("_i") == F.col("_j"), F.col("x") < F.col("y")).otherwise(F.col("x") != F.col("y"))
    met = a.join(b, ["rank", "_i", "_j"]).where(once & (4000 * left >= (2000 - permille) * total) & (2000 * apart <= permille * total))
    pairs = table(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    named = pairs.select(F.col("a").alias("class_id")).union(pairs.select("b")).distinct()
    some = table(known.select("class_id", "ranks").join(named, "class_id", "left_semi"))  # other sets' numbers aren't exchanged for the pairs
    drop(known)
    held = lambda c: some.select(F.col("class_id").alias(c), F.col("ranks").alias(f"{c}_ranks"))
    total = F.size("a_ranks") + F.size("b_ranks")
    found = pairs.join(held("a"), "a").join(held("b"), "b").select("a", "b", (total - 2 * F.size(F.array_intersect("a_ranks", "b_ranks"))).alias("differing"), total.alias("total"))
    near = table(found.where(2000 * F.col("differing") <= permille * F.col("total")))
    drop(pairs, some)
    own = _parts(sets)[1].select("class_id", carry)
    label = lambda c: own.select(F.col("class_id").alias(c), F.col(carry).alias(f"{c}_{carry}"))
    out = table(near.join(label("a"), "a").join(label("b"), "b").select("a", "b", f"a_{carry}", f"b_{carry}", "differing", "total"))  # read several times by what follows
    drop(near)
    return out


def both_ways(pairs: DataFrame, carry: str) -> DataFrame:
    """Near pairs from either side: id, other, label, other_label, differing, total."""
    there = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), F.col(f"a_{carry}").alias("label"), F.col(f"b_{carry}").alias("other_label"), "differing", "total")
    back = pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), F.col(f"b_{carry}").alias("label"), F.col(f"a_{carry}").alias("other_label"), "differing", "total")
    return there.union(back)


def nearest_with_margin(pairs: DataFrame, carry: str, margin_permille: int = 60) -> DataFrame:
    """Per id its nearest other, refused when another label (a missing one counts as another) is nearer than a margin behind.

    Ratios are whole thousandths of the mean size, rounded up; ties to the smaller other.
    """
    rows = both_ways(pairs, carry).withColumn("ratio", F.ceil(2000 * F.col("differing") / F.col("total")))
    best = rows.groupBy("id").agg(F.min(F.struct("ratio", "other", "other_label")).alias("b"))
    met = rows.join(best, "id").where(~F.col("other_label").eqNullSafe(F.col("b.other_label")))
    rival = met.groupBy("id").agg(F.min("ratio").alias("rival"))
    found = best.join(rival, "id", "left")
    ok = F.col("rival").isNull() | (F.col("rival") - F.col("b.ratio") >= margin_permille)
    return found.select("id", F.when(ok, F.col("b.other")).alias("match"), F.col("b.ratio").alias("ratio"), "rival")


def without_rivals(sets: DataFrame, pairs: DataFrame, carry: str) -> DataFrame:
    """Classes with no differently labelled near class."""
    rivals = both_ways(pairs, carry).where(~F.col("label").eqNullSafe(F.col("other_label"))).select(F.col("id").alias("class_id"))
    return _parts(sets)[1].join(rivals, "class_id", "left_anti").select("class_id", "size", "copies")


def coverage(keys: DataFrame, group: str, sets: DataFrame, set_name: str, key: str) -> DataFrame:
    """Per group the set that covers the largest share of its key occurrences, ties to the smaller name; below a twentieth none.

    ``sets`` (set_name, key) lists what each set knows.
    """
    counts = keys.groupBy(group, key).agg(F.count("*").alias("n"))
    total = counts.groupBy(group).agg(F.sum("n").alias("total"))
    met = counts.join(sets.select(set_name, key).distinct(), key).groupBy(group, set_name).agg(F.sum("n").alias("covered"))
    best = met.groupBy(group).agg(F.min(F.struct((-F.col("covered")).alias("c"), F.col(set_name).alias("s"))).alias("b"))
    joined = total.join(best, group, "left").withColumn("covered", F.coalesce(-F.col("b.c"), F.lit(0)))
    return joined.select(group, F.when(20 * F.col("covered") >= F.col("total"), F.col("b.s")).alias("best"), "covered", "total")


#: Keys are tried in steps, those first that make more than so many in a million of their group.
STEPS = (2000, 200, 0)


def probe(counts: DataFrame, sets: DataFrame, group: str, set_name: str, key: str, near: Callable[[DataFrame, DataFrame], DataFrame], least: int = 500, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """Per group the set that knows most of its key occurrences, exactly or nearly: best, covered, readable, exact (of that set), total; best is null below ``least`` / 1000.

    ``counts`` (group, key, n) has a row a key, ``sets`` (set_name, key, readable) what each set knows and can read. ``near(keys, sets)`` gives rows (key, set_name, readable) for keys near to
    something in a set. Ties go to the set that reads more, then to the larger exact share, then to the smaller name.

    The near search is the dear part, so frequent keys go first. After each step a set is given up for a group once all that is left untried couldn't bring it to ``least`` or to
    what another has already; groups without a set to hope for aren't searched further. The choice is the same as without.
    """
    total = counts.groupBy(group).agg(F.sum("n").alias("total"))
    step = F.coalesce(*(F.when(1_000_000 * F.col("n") >= s * F.col("total"), i) for i, s in enumerate(steps)), F.lit(len(steps) - 1))
    tried = cut(counts.join(total, group).withColumn("_step", step))
    known = sets.groupBy(set_name, key).agg(F.bool_or("readable").alias("readable"))
    parts = range(len(steps))
    sums = [F.sum(F.when(F.col("_step") == i, F.col("n")).otherwise(0)).alias(f"_e{i}") for i in parts]
    exact = tried.join(known, key).groupBy(group, set_name).agg(F.sum("n").alias("exact"), F.sum(F.when(F.col("readable"), F.col("n")).otherwise(0)).alias("readable"), *sums)
    left = tried.groupBy(group, "total").agg(*(F.sum(F.when(F.col("_step") > i, F.col("n")).otherwise(0)).alias(f"_left{i}") for i in parts))
    pair, counted = [group, set_name], ["exact", "readable", *(f"_e{i}" for i in parts), "near"]
    state = cut(exact.withColumn("near", F.lit(0).cast("long")).withColumn("alive", F.lit(True)))
    open_ = left.select(group, F.lit(True).alias("_open"))
    for i in parts:
        hopeful = open_.where("_open").select(group).union(state.where("alive").select(group)).distinct()
        wanted = tried.where(F.col("_step") == i).join(hopeful, group, "left_semi").select(group, key, "n")
        hits = near(wanted.select(key).distinct(), known).groupBy(key, set_name).agg(F.bool_or("readable").alias("readable")).join(known.select(set_name, key), [set_name, key], "left_anti")
        new = wanted.join(hits, key).groupBy(*pair).agg(F.sum("n").alias("_n"), F.sum(F.when(F.col("readable"), F.col("n")).otherwise(0)).alias("_r"))
        met = state.join(new, pair, "full").join(open_, group).where(F.col("alive").isNotNull() | F.col("_open"))
        met = met.withColumns({c: F.coalesce(c, F.lit(0)) for c in counted}).withColumn("alive", F.coalesce("alive", F.lit(True)))
        met = met.withColumns({"near": F.col("near") + F.when(F.col("alive"), F.coalesce("_n", F.lit(0))).otherwise(0), "readable": F.col("readable") + F.when(F.col("alive"), F.coalesce("_r", F.lit(0))).otherwise(0)})
        met = cut(met.select(*pair, *counted, "alive"))
        most = met.groupBy(group).agg(F.max(F.col("exact") + F.col("near")).alias("_most"))
        bar = left.join(most, group, "left").select(group, "total", F.col(f"_left{i}").alias("_rest"), F.greatest(F.ceil(least * F.col("total") / 1000), F.coalesce("_most", F.lit(0))).alias("_need"))
        untried = F.col("_rest") - sum((F.col(f"_e{k}") for k in parts if k > i), F.lit(0))
        state = cut(met.join(bar, group).withColumn("alive", F.col("alive") & (F.col("exact") + F.col("near") + untried >= F.col("_need"))).select(*pair, *counted, "alive"))
        open_ = cut(bar.select(group, (F.col("_rest") >= F.col("_need")).alias("_open")))
    covered = F.col("exact") + F.col("near")
    order = F.struct(-covered, -F.col("readable"), -F.col("exact"), F.col(set_name))
    best = state.where("alive").groupBy(group).agg(F.min_by(F.struct(F.col(set_name).alias("best"), covered.alias("covered"), "readable", "exact"), order).alias("b")).select(group, "b.*")
    return total.join(best, group, "left").select(group, "best", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("covered", "readable", "exact")), "total")


def compare(a: DataFrame, b: DataFrame, key: str, text: str) -> DataFrame:
    """Full comparison of two transcripts by key: edits, reference characters, and equality; a missing side is empty."""
    met = a.select(key, F.col(text).alias("ref")).join(b.select(key, F.col(text).alias("got")), key, "full")
    met = met.select(key, F.coalesce("ref", F.lit("")).alias("ref"), F.coalesce("got", F.lit("")).alias("got"))
    return met.select(key, F.levenshtein("ref", "got").alias("edits"), F.length("ref").alias("chars"), (F.col("ref") == F.col("got")).alias("exact"))


def error_rate(compared: DataFrame) -> DataFrame:
    """One row: edits per thousand reference characters, exact pairs, pairs."""
    found = compared.agg(F.sum("edits").alias("edits"), F.sum("chars").alias("chars"), F.count_if("exact").alias("n_exact"), F.count("*").alias("n"))
    return found.withColumn("cer_permille", F.round(1000 * F.col("edits") / F.greatest("chars", F.lit(1)), 3))
