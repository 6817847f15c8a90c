"""Streaming twins of batch rules: changed rows by key, expiry of finished jobs, counters by upsert."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def change_feed_stream(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows (key, order, value) whose value differs from the last one of their key; state is that one value."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, order, value)}

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known, last = (True, state.get[0]) if state.exists else (False, None)
        whole = pd.concat([f[[order, value]] for f in frames]).sort_values(order, kind="stable")  # a key's rows of one micro-batch
        out = []
        for at, now in zip(whole[order].tolist(), whole[value].tolist(), strict=True):
            if not known or now != last:
                out.append((keys[0], at, now))
            known, last = True, now
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, order, value])

    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items())
    return rows.select(key, order, value).groupBy(key).applyInPandasWithState(step, schema, f"last {kinds[value]}", "append", "NoTimeout")


def expired(jobs: DataFrame, now: int, status: str = "status", seconds: str = "finished", after: int = 600) -> DataFrame:
    """Jobs done or failed for longer than ``after`` seconds."""
    return jobs.where(F.col(status).isin("done", "error") & (F.col(seconds) < now - after))


def evictions(jobs: DataFrame, job: str, status: str, event_time: str, after: int = 600, delay: str = "0 seconds") -> DataFrame:
    """Rows (job, status, evicted) of jobs that were done or failed for ``after`` seconds: a timer a job, over a stream of its states.

    A job that goes on before its timer runs out stays. evicted is when the timer was due, however late the watermark comes. State is a job's last word, and
    goes with the job; a job that never ends keeps its own.
    """
    kind = jobs.schema[job].dataType.simpleString()

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, due = state.get
            state.remove()
            yield pd.DataFrame({job: [keys[0]], status: [last], "evicted": pd.to_datetime([due], unit="ms")})
            return
        whole = pd.concat(list(frames)).sort_values("_ms", kind="stable")  # a job's states of one micro-batch
        now, at = whole[status].iloc[-1], int(whole["_ms"].iloc[-1])
        if state.exists and state.get[1] - 1000 * after > at:
            now, at = state.get[0], state.get[1] - 1000 * after  # an older state that came late
        due = at + 1000 * after
        state.update((now, due))
        if now in ("done", "error"):
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    rows = jobs.withWatermark(event_time, delay).select(job, status, event_time, F.unix_millis(event_time).alias("_ms"))
    return rows.groupBy(job).applyInPandasWithState(step, f"`{job}` {kind}, `{status}` string, evicted timestamp", "last string, due long", "append", "EventTimeTimeout")


def _versions(spark, path: str) -> list[int]:
    """Batches whose whole table of counters is there."""
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder = path_of(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(folder):
        return []
    names = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("v")]
    return sorted(int(p.getName()[1:]) for p in names if fs.exists(path_of(p, "_SUCCESS")))


def upsert_counters(batch: DataFrame, batch_id: int, path: str, keys: list[str]) -> None:
    """Add a micro-batch's counters to a table, once: for ``foreachBatch``.

    A batch writes a folder named by its id: the newest one before it, and its own counts. Only one with its success mark
    counts, so a batch that failed is written again, and one that is repeated after its write is skipped.
    """
    from ..operators.merging import additive_merge

    spark = batch.sparkSession
    done = _versions(spark, path)
    if batch_id in done:
        return
    parts = [batch.groupBy(*keys).agg(F.sum("n").alias("n"))]
    if earlier := [v for v in done if v < batch_id]:
        parts.append(spark.read.parquet(f"{path}/v{earlier[-1]}"))
    additive_merge(parts, keys).write.mode("overwrite").parquet(f"{path}/v{batch_id}")


def read_counters(spark, path: str) -> DataFrame:
    """The newest whole version of a table of counters."""
    return spark.read.parquet(f"{path}/v{_versions(spark, path)[-1]}")


def replay_and_follow(spark, path: str, schema: str, job: str | None = None) -> DataFrame:
    """A stream of the events (JSON lines) that a folder holds and of those that come, of one job or all: a new reader gets what was missed first."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).json(path)
    return rows if job is None else rows.where(F.col("job_id") == job)


def every(stream: DataFrame, seconds: float, action, checkpoint: str):
    """Start a query that calls ``action`` (batch, batch_id) with what came, so many seconds apart: the ticker of a queue."""
    return stream.writeStream.trigger(processingTime=f"{seconds} seconds").option("checkpointLocation", checkpoint).foreachBatch(action).start()
