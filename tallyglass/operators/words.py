"""Words settled by a lexicon while cues are read.

A word is a lattice: for each of its places the texts it may stand for. Distinct lattices are spelled out and met with the lexicon once, however often
their word occurs; one row a lattice comes back and is joined to the words. A lexicon is a table (word, zipf, valid): words in lower case,
ten's power of their frequency a billion words, and whether a dictionary has them; either of the last two may be missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Marks around a word, signs that part words, how many spellings a lattice may have, and what a reading needs on the Zipf scale.
MARKS = "\"'.,;:!?()[]{}-–—…«»„“”‚‘’¿¡"
BREAKS = "-–—/"
MOST = 64
MIN_ZIPF, MIN_LEAD, REPAIR_LEAD = 1.0, 1.5, 2.0
UNKNOWN = "�"


def core(word: Column) -> Column:
    """A word without the marks around it."""
    return F.btrim(word, F.lit(MARKS))


def case_regular(word: Column) -> Column:
    """Whether every run of letters is small, capital, or begins with its only capital; false for a word without letters."""
    return word.rlike(r"^\P{L}*(?:(?:\p{Lu}+|\p{Lu}?\p{Ll}+)(?:\P{L}+|$))+$")


def spellings(options: Column) -> Column:
    """All texts of a lattice; the caller bounds :func:`n_spellings`."""
    grow = lambda done, c: F.flatten(F.transform(done, lambda d: F.transform(c, lambda x: F.concat(d, x))))
    return F.array_distinct(F.aggregate(options, F.array(F.lit("")), grow))


def n_spellings(options: Column) -> Column:
    """How many texts a lattice has, up to about a thousand times ``MOST``; so that the product of a long word doesn't overflow."""
    return F.aggregate(options, F.lit(1).cast("long"), lambda n, c: F.least(n * F.greatest(F.size(c), F.lit(1)), F.lit(1000 * MOST).cast("long")))


def _full(lexicon: DataFrame) -> DataFrame:
    """word, zipf (0 where unknown) and valid, once a word."""
    value = lambda c, kind: F.col(c).cast(kind) if c in lexicon.columns else F.lit(None).cast(kind)
    return lexicon.groupBy(F.col("word").alias("_word")).agg(F.coalesce(F.max(value("zipf", "double")), F.lit(0.0)).alias("_zipf"), F.coalesce(F.bool_or(value("valid", "boolean")), F.lit(False)).alias("_valid"))


def resolve(lattices: DataFrame, lexicon: DataFrame, use_case: bool = True) -> DataFrame:
    """Rows (options, resolved, by) of the distinct lattices that have one spelling to prefer.

    Lattices of one spelling, or of more than ``MOST``, have none. First case: the only spelling written as words are. Then frequency: a known word
    that leads the next by 1.5 (30 times as frequent), or the only one that occurs at all. Then the only spelling that the dictionary has.
    """
    distinct = lattices.select("options").distinct().withColumn("_s", F.when(n_spellings(F.col("options")) <= MOST, spellings(F.col("options")))).where(F.size("_s") > 1)
    spelled = distinct.select("options", F.explode("_s").alias("spelling")).withColumn("_word", F.lower(core(F.col("spelling"))))
    known = spelled.join(_full(lexicon), "_word", "left").withColumns({"_zipf": F.coalesce("_zipf", F.lit(0.0)), "_valid": F.coalesce("_valid", F.lit(False)) & (F.col("_word") != "")})
    only = lambda test, name: [F.count_if(test).alias(f"_n_{name}"), F.max(F.when(test, F.col("spelling"))).alias(f"_{name}")]
    best = F.sort_array(F.collect_list(F.struct("_zipf", "spelling")), asc=False).alias("_best")  # MOST at most
    found = known.groupBy("options").agg(*only(case_regular(core(F.col("spelling"))), "regular"), *only(F.col("_valid"), "known"), best)
    first, second = F.get("_best", F.lit(0)), F.get("_best", F.lit(1))
    leads = (first["_zipf"] >= MIN_ZIPF) & ((first["_zipf"] - second["_zipf"] >= MIN_LEAD) | (second["_zipf"] == 0))
    say = lambda text, by: F.struct(text.alias("resolved"), F.lit(by).alias("by"))
    choice = F.when(F.lit(use_case) & (F.col("_n_regular") == 1), say(F.col("_regular"), "case")).when(leads, say(first["spelling"], "frequency")).when(F.col("_n_known") == 1, say(F.col("_known"), "dictionary"))
    return found.select("options", choice.alias("_c")).where("_c is not null").select("options", "_c.resolved", "_c.by")


def at_breaks(candidates: Column) -> Column:
    """A lattice cut at dashes and slashes: an array of lattices, the signs between them being lattices of their own."""
    sign = lambda c: (F.size(c) == 1) & F.get(c, F.lit(0)).isin(*BREAKS)
    start = F.struct(F.array().cast("array<array<array<string>>>").alias("done"), F.array().cast("array<array<string>>").alias("open"))
    closed = lambda s: F.when(F.size(s["open"]) > 0, F.array_append(s["done"], s["open"])).otherwise(s["done"])
    step = lambda s, c: F.when(sign(c), F.struct(F.array_append(closed(s), F.array(c)).alias("done"), F.array().cast("array<array<string>>").alias("open"))).otherwise(F.struct(s["done"].alias("done"), F.array_append(s["open"], c).alias("open")))
    return F.aggregate(candidates, start, step, closed)


def resolve_words(words: DataFrame, lexicon: DataFrame, use_case: bool = True) -> DataFrame:
    """Append resolved to words (id, candidates: arrays of texts, one a place): the spelling to prefer, null where a part of the word has none.

    A word is cut at dashes and slashes first, and each part that leaves a choice is settled by itself (:func:`resolve`). A word without a choice has none
    either.
    """
    parts = words.select("id", F.posexplode(at_breaks(F.col("candidates"))).alias("_at", "options"))
    choice = n_spellings(F.col("options")) > 1
    settled = resolve(parts.where(choice), lexicon, use_case)
    told = parts.join(settled, "options", "left").withColumn("_open", choice).withColumn("_text", F.when(F.col("_open"), F.col("resolved")).otherwise(F.array_join(F.transform("options", lambda c: F.get(c, F.lit(0))), "")))
    whole = told.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("_at", "_text"))).alias("_p"), F.bool_or("_open").alias("_any"), F.bool_and(F.col("_text").isNotNull()).alias("_all"))  # a word's parts
    text = F.array_join(F.transform("_p", lambda p: p["_text"]), "")
    return words.join(whole.select("id", F.when(F.col("_any") & F.col("_all"), text).alias("resolved")), "id", "left")


def repair(parts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Rows (parts, repaired) of the distinct words, given by the text of each glyph, that the lexicon would rather spell with I and l exchanged.

    Only parts of I and l alone are exchanged. A word that the dictionary has stays; another spelling must be known, be a hundred times as frequent as the
    word as read, and 30 times as the next. Where the lexicon has no frequency for any spelling, the only one that the dictionary has is taken.
    """
    swaps = F.expr("transform(parts, p -> if(p rlike '^[Il]+$', aggregate(split(p, ''), array(''), (done, c) -> if(c = '', done, flatten(transform(done, d -> array(concat(d, 'I'), concat(d, 'l')))))), array(p)))")
    opened = parts.select("parts").where(F.exists("parts", lambda p: p.rlike("^[Il]{1,6}$")) & ~F.exists("parts", lambda p: p.rlike("^[Il]{7,}$") | p.isNull())).distinct().withColumn("options", swaps)
    small = opened.where(n_spellings(F.col("options")).between(2, MOST)).withColumn("_read", F.array_join("parts", ""))
    spelled = small.select("parts", "_read", F.explode(spellings(F.col("options"))).alias("spelling")).withColumn("_word", F.lower(core(F.col("spelling"))))
    known = spelled.join(_full(lexicon), "_word", "left").withColumns({"_zipf": F.coalesce("_zipf", F.lit(0.0)), "_valid": F.coalesce("_valid", F.lit(False))})
    own = F.max(F.when(F.col("spelling") == F.col("_read"), F.struct("_zipf", "_valid"))).alias("_own")
    others = F.sort_array(F.collect_list(F.when(F.col("spelling") != F.col("_read"), F.struct("_zipf", "spelling", "_valid"))), asc=False).alias("_others")  # MOST at most
    found = known.groupBy("parts").agg(own, others)
    first, second = F.get("_others", F.lit(0)), F.coalesce(F.get("_others", F.lit(1))["_zipf"], F.lit(0.0))
    often = (first["_zipf"] >= MIN_ZIPF) & (first["_zipf"] - F.col("_own._zipf") >= REPAIR_LEAD) & (first["_zipf"] - second >= MIN_LEAD)
    valid = F.filter("_others", lambda x: x["_valid"])
    uncounted = (first["_zipf"] == 0) & (F.col("_own._zipf") == 0) & (F.size(valid) == 1)
    chosen = F.when(F.col("_own._valid"), None).when(often, first["spelling"]).when(uncounted, F.get(valid, F.lit(0))["spelling"])
    return found.select("parts", chosen.alias("repaired")).where("repaired is not null")


def repair_words(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Append repaired to words (id, parts): see :func:`repair`; null where the word stays."""
    return words.join(repair(words, lexicon), "parts", "left")


def _sizes(items: Column) -> Column:
    """How many characters each item of a word stands for: those of its text, else of the first text it may have."""
    return F.transform(items, lambda x: F.length(F.coalesce(x["text"], F.get(x["options"], F.lit(0)), F.lit(UNKNOWN))))


def spread(items: Column, word: Column, via: Column, ambiguous_only: bool) -> Column:
    """A word's items (text, reason, via, options, ...) with the characters of ``word``; as they are where it is null or of another length.

    With ``ambiguous_only`` only items read as look-alikes change; else all whose text differs.
    """
    sizes = _sizes(items)
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, k: n + k)
    fits = F.coalesce(F.length(word) == total(sizes), F.lit(False))

    def one(x: Column, i: Column) -> Column:
        part = F.substring(word, total(F.slice(sizes, 1, i)) + 1, F.get(sizes, i))
        change = x["via"] == "ambig" if ambiguous_only else ~x["text"].eqNullSafe(part)
        return F.when(F.coalesce(change, F.lit(False)), x.withField("text", part).withField("reason", F.lit("")).withField("via", via)).otherwise(x)

    return F.when(fits, F.transform(items, one)).otherwise(items)


def settle(words: DataFrame, lexicon: DataFrame | None) -> DataFrame:
    """Words (items, memory) with their look-alikes read: by the word's memory, else by the lexicon, which then repairs what was read too surely.

    A memory that doesn't fit the glyphs leaves its word open. A part of a word with an unread glyph isn't repaired.
    """
    remembered = words.withColumn("items", spread(F.col("items"), F.col("memory"), F.lit("word"), True))
    if lexicon is None:
        return remembered
    ambiguous = F.exists("items", lambda x: F.coalesce(x["via"] == "ambig", F.lit(False)))
    texts = F.transform("items", lambda x: F.when((x["via"] == "ambig") & (F.size(x["options"]) > 0), x["options"]).otherwise(F.array(F.coalesce(x["text"], F.lit(UNKNOWN)))))
    lattice = remembered.withColumn("options", F.when(ambiguous & F.col("memory").isNull(), texts))
    settled = resolve(lattice.where("options is not null"), lexicon)
    read = lattice.join(settled, "options", "left").withColumn("items", spread(F.col("items"), F.col("resolved"), F.lit("lexicon"), True)).drop("options", "resolved", "by")
    whole = read.withColumn("parts", F.transform("items", lambda x: x["text"]))
    return whole.join(repair(whole, lexicon), "parts", "left").withColumn("items", spread(F.col("items"), F.col("repaired"), F.lit("repair"), False)).drop("parts", "repaired")
