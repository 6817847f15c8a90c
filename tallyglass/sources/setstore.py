"""A shared folder of glyph sets that several writers learn into at once.

Each commit writes the sets it touches beside the others and then publishes a list of where each set now lies, by one rename that fails where another
writer was first. Such a writer reads what the other wrote, applies its own journal to that, and tries again; as evidence of a cue counts once, and
counts only add up, nothing is lost or counted twice whoever comes first. Readers see whole commits alone.

A set has a public part (settled evidence) and a private one (what was learned but isn't settled, and the cues it came from); the two lie in different folders, and without
a private one only what is settled is kept.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import imports
from ..operators.reading import LOOK_ALIKES
from ..operators.votes import settled, trusted_label

TABLES = {
    "shapes": "set string, key string, h int, w int, ink int, bits binary, cluster string, n long",
    "votes": "set string, cluster string, top_rel int, label string, n long",
    "priors": "set string, cluster string, top_rel int, label string",
    "sequences": "set string, parts array<string>, stacked boolean, high boolean, label string, n long",
    "kept": "set string, cluster string, top_rel int",
    "info": "set string, learned_with string, charset string, seeded_from string",
    "sources": "set string, source string",
}
#: What a writer learned: op is shape, vote, prior, sequence, count or source. Votes and sequences of a source that the set knows already are left out.
JOURNAL = (
    "set string, source string, op string, key string, cluster string, h int, w int, ink int, bits binary, top_rel int, label string, n long, parts array<string>, stacked boolean, high boolean"
)
MOST_MEMBERS, TRIES = 24, 20


@dataclass
class Store:
    """A folder of sets, on any file system that executors and driver share; ``private`` is the folder of what isn't published, if any."""

    spark: SparkSession
    path: str
    private: str | None = None

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def staged(self, df: DataFrame) -> DataFrame:
        """``df`` written to the folder's staging area and read again; a later :meth:`save` or :meth:`clear` of this store deletes it."""
        place = f"{self.private or self.path}/_staging/{uuid.uuid4().hex}"
        df.write.parquet(place)
        self._placed().append(place)
        return self.spark.read.schema(df.schema).parquet(place)

    def _placed(self) -> list[str]:
        return self.__dict__.setdefault("_staged", [])

    def clear(self) -> None:
        """Delete what this store has staged."""
        for place in self._placed():
            files, p = self._fs(place)
            files.delete(p, True)
        self._placed().clear()

    def latest(self) -> tuple[int, dict[str, str]]:
        """(version, where each set lies): 0 and nothing for a new folder."""
        files, folder = self._fs(f"{self.path}/_commits")
        if not files.exists(folder):
            return 0, {}
        numbers = [int(s.getPath().getName()[:-5]) for s in files.listStatus(folder) if s.getPath().getName()[:-5].isdigit()]
        if not numbers:
            return 0, {}
        text = self.spark.read.text(f"{self.path}/_commits/{max(numbers):010d}.json", wholetext=True).first()[0]
        return max(numbers), json.loads(text)

    def vacuum(self, versions: int = 2) -> int:
        """Delete what only commits before the last ``versions`` refer to; what a writer hasn't published yet stays. Returns how many folders went."""
        files, folder = self._fs(f"{self.path}/_commits")
        numbers = sorted(int(s.getPath().getName()[:-5]) for s in files.listStatus(folder) if s.getPath().getName()[:-5].isdigit()) if files.exists(folder) else []
        named = lambda ns: {f for n in ns for f in json.loads(self.spark.read.text(f"{self.path}/_commits/{n:010d}.json", wholetext=True).first()[0]).values()}
        old = named(numbers[:-versions]) - named(numbers[-versions:])
        for root in filter(None, (self.path, self.private)):
            for f in old:
                files, p = self._fs(f"{root}/{f}")
                files.delete(p, True)
        for n in numbers[:-versions]:
            files, p = self._fs(f"{self.path}/_commits/{n:010d}.json")
            files.delete(p, False)
        return len(old)

    def publish(self, version: int, where: dict[str, str]) -> bool:
        """Make ``where`` the commit ``version``; false if that is there already."""
        jvm = self.spark.sparkContext._jvm
        beside = f"{self.path}/_commits/.{uuid.uuid4().hex}"
        files, p = self._fs(beside)
        p = files.makeQualified(p)
        out = files.create(p, True)
        out.write(bytearray(json.dumps(where, sort_keys=True).encode()))
        out.close()
        target = files.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{self.path}/_commits/{version:010d}.json"))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").valueOf("NONE")
        try:
            context.rename(p, target, options)
            return True
        except Exception as e:
            files.delete(p, False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise

    def read(self, where: dict[str, str] | None = None, sets: list[str] | None = None) -> dict[str, DataFrame]:
        """The tables of some sets (all, if None) as of a commit (the latest, if None), public and private parts together."""
        where = self.latest()[1] if where is None else where
        chosen = {s: f for s, f in where.items() if sets is None or s in sets}
        return {t: self._table(t, chosen) for t in TABLES}

    def _table(self, table: str, chosen: dict[str, str]) -> DataFrame:
        schema = T.StructType.fromDDL(TABLES[table])
        parts = []
        for root in [self.path, *([self.private] if self.private else [])]:
            for folder in sorted(set(chosen.values())):
                place = f"{root}/{folder}/{table}"
                files, p = self._fs(place)
                if files.exists(p):
                    names = sorted(s for s, f in chosen.items() if f == folder)
                    parts.append(self.spark.read.schema(schema).parquet(place).where(F.col("set").isin(names)))
        out = self.spark.createDataFrame([], schema)
        for p in parts:
            out = out.unionByName(p)
        return merged(table, out)

    def save(self, journal: DataFrame, final: bool = False, replaced: dict[str, DataFrame] | None = None) -> int:
        """Add a journal to the sets it names and return the commit's number; with ``final`` shapes seen once are dropped.

        ``replaced`` are tables of sets to put in the place of what is there (or that aren't there yet), before the journal is added. Both are staged first, as each try reads them anew.
        """
        journal = self.staged(journal)
        if replaced is not None:
            with ThreadPoolExecutor(4) as pool:
                replaced = dict(zip(replaced, pool.map(self.staged, replaced.values()), strict=True))
        new = [] if replaced is None else [r[0] for r in replaced["shapes"].select("set").union(replaced["votes"].select("set")).distinct().collect()]
        touched = sorted({r[0] for r in journal.select("set").distinct().collect()} | set(new))  # a row a set
        done: dict[str, str] = {}
        base: dict[str, str | None] = {}
        for _ in range(TRIES):
            version, where = self.latest()
            if not done or {s: where.get(s) for s in touched} != base:  # another writer touched the same sets: add to what it wrote
                base = {s: where.get(s) for s in touched}
                state = self.read(where, [s for s in touched if s not in new])
                if replaced is not None:
                    state = {t: state[t].unionByName(replaced[t].select(state[t].columns)) if t in replaced else state[t] for t in TABLES}
                folder = f"sets-{uuid.uuid4().hex}"
                self._write(replay(state, journal, final), folder)
                done = dict.fromkeys(touched, folder)
            if self.publish(version + 1, where | done):
                self.clear()
                return version + 1
        raise RuntimeError(f"another writer came first {TRIES} times")

    def _write(self, state: dict[str, DataFrame], folder: str) -> None:
        deep = ("shapes", "votes", "sequences")
        with ThreadPoolExecutor(4) as pool:  # small jobs side by side
            public, private = split(state | dict(zip(deep, pool.map(self.staged, [state[t] for t in deep]), strict=True)))
            places = [(f"{root}/{folder}/{t}", rows) for root, tables in ((self.path, public), (self.private, private)) if root for t, rows in tables.items()]
            list(pool.map(lambda x: x[1].write.parquet(x[0]), places))


def merged(table: str, rows: DataFrame) -> DataFrame:
    """Rows of a table's parts as one: counts of a key add up."""
    if table in ("votes", "sequences"):
        keys = [c for c in rows.columns if c != "n"]
        return rows.groupBy(*keys).agg(F.sum("n").alias("n")).select(rows.columns)
    return rows.dropDuplicates({"shapes": ["set", "key"], "info": ["set"]}.get(table, rows.columns))


def replay(state: dict[str, DataFrame], journal: DataFrame, final: bool = False) -> dict[str, DataFrame]:
    """Tables of sets with a journal's evidence added; see :data:`JOURNAL`.

    A vote goes to the cluster of its key, as the set has it, else as the journal says, else to the key itself. Occurrences of a shape start at one and add what
    a file had beyond the first.
    """
    known = state["sources"]
    new = journal.join(known.select("set", "source"), ["set", "source"], "left_anti") if "source" in journal.columns else journal
    fresh = journal.where("op not in ('vote', 'sequence', 'source')").unionByName(new.where("op in ('vote', 'sequence', 'source')").select(journal.columns))
    shapes = state["shapes"]
    drawn = fresh.where("op = 'shape' or (op = 'vote' and bits is not null)").groupBy("set", "key").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("h", "w", "ink", "bits")), F.min("cluster").alias("cluster"))
    drawn = drawn.join(shapes.select("set", "key"), ["set", "key"], "left_anti")
    shapes = shapes.unionByName(drawn.select("set", "key", "h", "w", "ink", "bits", F.coalesce("cluster", "key").alias("cluster"), F.lit(1).cast("long").alias("n")))
    counts = fresh.where("op = 'count'").groupBy("set", "key").agg(F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("_more"))
    shapes = shapes.join(counts, ["set", "key"], "left").withColumn("n", F.col("n") + F.coalesce("_more", F.lit(0))).drop("_more")
    place = shapes.select("set", "key", F.col("cluster").alias("_c"))
    located = fresh.where("op in ('vote', 'prior')").join(place, ["set", "key"], "left").withColumn("cluster", F.coalesce("_c", "cluster", "key"))
    votes = state["votes"].unionByName(located.where("op = 'vote'").select("set", "cluster", "top_rel", "label", F.coalesce("n", F.lit(1)).alias("n")))
    priors = state["priors"].unionByName(located.where("op = 'prior'").select("set", "cluster", "top_rel", "label"))
    sequences = state["sequences"].unionByName(fresh.where("op = 'sequence'").select("set", "parts", F.coalesce("stacked", F.lit(False)).alias("stacked"), F.coalesce("high", F.lit(False)).alias("high"), "label", F.coalesce("n", F.lit(1)).alias("n")))
    sources = known.unionByName(fresh.where("source is not null").select("set", "source"))
    out = state | {t: merged(t, rows) for t, rows in {"shapes": shapes, "votes": votes, "priors": priors, "sequences": sequences, "sources": sources}.items()}
    return pruned(out) if final else out


def pruned(state: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Without members of clusters that were seen once, and those beyond a cluster's 24 most frequent; heads of clusters and shapes with votes or in sequences of their own stay."""
    shapes = state["shapes"]
    parts = state["sequences"].select("set", F.explode("parts").alias("key"))
    held = shapes.where("key = cluster").select("set", "key").union(state["votes"].select("set", "cluster")).union(parts).distinct()
    members = shapes.join(held, ["set", "key"], "left_anti")
    kept = shapes.join(held, ["set", "key"], "left_semi").unionByName(top_members(members, MOST_MEMBERS))
    return state | {"shapes": kept}


def top_members(members: DataFrame, most: int) -> DataFrame:
    """The members of each cluster (set, cluster, key, n) seen most often, twice at least; ties to the smaller key."""
    order = F.row_number().over(Window.partitionBy("set", "cluster").orderBy(F.desc("n"), "key"))
    return members.where("n >= 2").withColumn("_i", order).where(F.col("_i") <= most).drop("_i")


def split(state: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(public, private) tables: settled positions, the shapes of their clusters, and settled sequences with their parts are public.

    A position, shape or sequence lies in one of the two. What was public once stays public, whatever is read later.
    """
    keys, rule = ["set", "cluster", "top_rel"], ["set", "parts", "stacked", "high"]
    firm = trusted_label(state["sequences"], rule).where("reason = ''").select(*rule)
    marked = state["kept"].unionByName(state["priors"].select(*keys))
    found = settled(state["votes"], keys, marked, list(LOOK_ALIKES)).where("part = 'settled'").select(*keys)
    heads = found.unionByName(state["priors"].select(*keys)).select("set", "cluster").union(firm.select("set", F.explode("parts").alias("cluster"))).distinct()
    both = lambda t, by, on: (state[t].join(by, on, "left_semi"), state[t].join(by, on, "left_anti"))
    shapes, votes, sequences = both("shapes", heads, ["set", "cluster"]), both("votes", found, keys), both("sequences", firm, rule)
    public = {"shapes": shapes[0], "votes": votes[0], "priors": state["priors"], "sequences": sequences[0], "kept": found, "info": state["info"]}
    return public, {"shapes": shapes[1], "votes": votes[1], "sequences": sequences[1], "sources": state["sources"]}


def as_sets(tables: dict[str, DataFrame]) -> imports.Sets:
    """A store's tables for :func:`imports.plan`; which sets were merged into one is told by its sources."""
    names = tables["shapes"].select("set").union(tables["info"].select("set")).distinct()
    merges = tables["sources"].where("source like 'merge:%'").groupBy("set").agg(F.collect_set(F.substr("source", F.lit(7))).alias("merged_from"))  # sets merged into one
    return imports.Sets(names.join(tables["info"], "set", "left").join(merges, "set", "left"), tables["shapes"].select("set", "key", "cluster", "n"), tables["votes"])


def finish(store: Store, plans: DataFrame, offered: dict[str, DataFrame], seeds: imports.Sets | None = None, final: bool = True) -> int:
    """Carry out accepted plans in one commit: updates and new sets take the place of what is there, merges and deltas add their votes to their target.

    A set is merged into a target once, and a delta taken from a seed once: their votes are sources of their own, which the target remembers. Sequences stay behind, as their keys
    depend on the offered set's clusters. An update without a version keeps the one of the set it replaces.
    """
    plans, mine = store.staged(plans), as_sets(offered)
    gained = imports.additions(plans, mine, seeds).join(plans.select("set", "action", F.coalesce("seed", F.lit("")).alias("_seed")), "set")
    source = F.when(F.col("action") == "merge", F.concat(F.lit("merge:"), "set")).otherwise(F.concat_ws(":", F.lit("delta"), "set", "_seed"))
    drawn = offered["shapes"].select(F.col("set"), F.col("key").alias("cluster"), "h", "w", "ink", "bits")
    votes = gained.join(drawn, ["set", "cluster"], "left").select(F.col("target").alias("_target"), "cluster", "h", "w", "ink", "bits", "top_rel", "label", "n", source.alias("source"))
    schema = T.StructType.fromDDL(JOURNAL)
    given = {"set": "_target", "key": "cluster", "source": "source", "h": "h", "w": "w", "ink": "ink", "bits": "bits", "top_rel": "top_rel", "label": "label", "n": "n"}
    journal = votes.select(*(F.lit("vote").alias("op") if f.name == "op" else (F.col(given[f.name]) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))
    whole = plans.where("action in ('update', 'new')").select("set")
    replaced = {t: rows.join(whole, "set", "left_semi") for t, rows in offered.items()}
    before = store.read()["info"].select("set", F.col("learned_with").alias("_before"))
    replaced["info"] = replaced["info"].join(before, "set", "left").withColumn("learned_with", F.coalesce("learned_with", "_before")).drop("_before")
    return store.save(journal, final, replaced)
