"""Distinct users a day, without keeping who they were: salted hashes while a day is open, a count once it is over."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HASH = 24


def daily_users(rows: DataFrame, day: str, user: str) -> DataFrame:
    """Rows (day, users, n): distinct users and all rows of each day; rows without a user count in n alone."""
    once = rows.groupBy(day, user).agg(F.count("*").alias("n"))  # a user's rows meet first, so a busy day isn't one task
    return once.groupBy(day).agg(F.count(user).alias("users"), F.sum("n").alias("n"))


def with_salts(spark: SparkSession, salts: DataFrame | None, days: list[str]) -> DataFrame:
    """Salts (day, salt) of the open ``days``: those that are there, and new random ones for the others."""
    known = {} if salts is None else {r["day"]: r["salt"] for r in salts.where(F.col("day").isin(days)).collect()}  # a row an open day
    return spark.createDataFrame([(d, known.get(d) or secrets.token_hex(16)) for d in days], "day string, salt string")


def hashed(rows: DataFrame, salts: DataFrame, day: str, user: str) -> DataFrame:
    """Distinct rows (day, who): users by a salted hash; days without a salt, which are over, give none. ``salts`` has a row an open day."""
    met = rows.where(F.col(user).isNotNull()).join(F.broadcast(salts.withColumnRenamed("day", day)), day)
    return met.select(F.col(day).alias("day"), F.substring(F.sha2(F.concat("salt", F.col(user).cast("string")), 256), 1, HASH).alias("who")).distinct()


def roll(seen: DataFrame, counts: DataFrame, salts: DataFrame, today: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(seen, counts, salts) once all days before ``today`` are closed: their hashes (day, who) become counts (day, users), and their salts are gone, so that nobody can be told afterwards.

    A day that is counted already keeps its count; rolling twice changes nothing.
    """
    over = F.col("day") < today
    closed = seen.where(over).distinct().groupBy("day").agg(F.count("*").alias("users")).join(counts.select("day"), "day", "left_anti")
    return seen.where(~over), counts.unionByName(closed), salts.where(~over)


def daily_users_stream(rows: DataFrame, event_time: str, user: str, secret: str, delay: str = "1 hour") -> DataFrame:
    """Rows (day, users) over a stream, once each day is over by the watermark; hashes and counts of a day leave the state then.

    ``secret`` salts the hashes together with their day; it is made for a run and never written, as the state is.
    """
    marked = rows.where(F.col(user).isNotNull()).withWatermark(event_time, delay)
    salt = F.concat_ws(":", F.lit(secret), F.date_format(event_time, "yyyy-MM-dd"), F.col(user).cast("string"))
    who = marked.select(F.window(event_time, "1 day").alias("span"), F.substring(F.sha2(salt, 256), 1, HASH).alias("who")).dropDuplicates(["span", "who"])
    return who.groupBy("span").agg(F.count("*").alias("users")).select(F.date_format("span.start", "yyyy-MM-dd").alias("day"), "users")
