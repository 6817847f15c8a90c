"""Glyph sets: nested JSON files as flat evidence tables, and back as partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merging import additive_merge

SCHEMA = (
    "name string, shapes array<struct<key:string,h:int,w:int,bits:string,cluster:string,n:bigint,"
    "variants:array<struct<top_rel:int,votes:map<string,bigint>>>>>, sequences array<struct<parts:array<string>,label:string,n:bigint>>"
)


PRIVATE = "learned_sources array<string>, words map<string,map<string,bigint>>, interim struct<shapes:array<struct<key:string,variants:array<struct<top_rel:int,votes:map<string,bigint>>>>>>"


def read_private(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, words, votes) of the private files beside sets, each named as its set: (set, source), (set, keys, text, n), (set, key, top_rel, label, n).

    Keys of a word are parted by bars. Each file counts once however often its path is given; what a file lacks gives no rows.
    """
    rows = spark.read.schema(PRIVATE).json(path, multiLine=True).withColumn("_p", F.col("_metadata.file_path")).dropDuplicates(["_p"])
    rows = rows.withColumn("set", F.regexp_extract("_p", r"([^/]+)\.json$", 1))
    sources = rows.select("set", F.explode("learned_sources").alias("source")).distinct()
    words = rows.select("set", F.explode("words").alias("k", "texts")).select("set", F.split("k", r"\|").alias("keys"), F.explode("texts").alias("text", "n"))
    shapes = rows.select("set", F.explode("interim.shapes").alias("s")).select("set", "s.key", F.explode("s.variants").alias("v"))
    return sources, words, shapes.select("set", "key", "v.top_rel", F.explode("v.votes").alias("label", "n"))


def with_interim(votes: DataFrame, interim: DataFrame) -> DataFrame:
    """A set's votes with those of its private file added."""
    keys = ["set", "cluster", "top_rel", "label"]
    return additive_merge([votes.select(*keys, "n"), interim.withColumnRenamed("key", "cluster").select(*keys, "n")], keys)


def read_sets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(shapes, votes, sequences) of set files; a member whose cluster is missing stands for itself, a missing count is 2."""
    sets = spark.read.schema(SCHEMA).json(path, multiLine=True)
    shapes = sets.select(F.col("name").alias("set"), F.posexplode("shapes").alias("insert_no", "s")).select("set", "insert_no", "s.*")
    known = shapes.select(F.col("set").alias("_s"), F.col("key").alias("_k")).distinct()
    fixed = shapes.join(known, (F.col("set") == F.col("_s")) & (F.col("cluster") == F.col("_k")), "left")
    cluster = F.when(F.col("_k").isNull(), F.col("key")).otherwise(F.col("cluster"))
    shapes = fixed.select("set", "insert_no", "key", "h", "w", F.unbase64("bits").alias("bits"), cluster.alias("cluster"), F.coalesce("n", F.lit(2)).alias("n"), "variants")
    votes = shapes.select("set", "cluster", F.explode("variants").alias("v")).select("set", "cluster", "v.top_rel", F.explode("v.votes").alias("label", "n"))
    votes = votes.groupBy("set", "cluster", "top_rel", "label").agg(F.sum("n").alias("n"))
    sequences = sets.select(F.col("name").alias("set"), F.explode("sequences").alias("q")).select("set", "q.*")
    return shapes.drop("variants"), votes, sequences


def write_sets(rows: DataFrame, path: str) -> None:
    """Write evidence rows by set; each set has a single writer, and a rewrite replaces whole partitions."""
    rows.repartition("set").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("set").parquet(path)
