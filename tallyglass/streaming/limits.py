"""Rules over time with state: accepted-only rate limits, adaptive limits, cooldowns; batch folds and streaming twins.

A fold goes through one key's rows in order and keeps a bounded state, so it streams: rows are dealt by
key, sorted, and read batch by batch, never a key as a whole.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold(rows: DataFrame, key: str, order: list[str], inputs: list[str], fresh: Callable[[], object], step: Callable, outputs: list[tuple[str, T.DataType]]) -> DataFrame:
    """Append columns made by folding each key's rows in order: ``step(state, *inputs)`` returns their values."""
    names, schema = rows.columns, T.StructType([*rows.schema.fields, *(T.StructField(a, b) for a, b in outputs)])
    places = [names.index(c) for c in (key, *inputs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for batch in batches:
            out = []
            for k, *values in zip(*(batch.column(i).to_pylist() for i in places), strict=True):
                if state is None or k != last:
                    last, state = k, fresh()
                out.append(step(state, *values))
            arrays = [pa.array([o[i] for o in out], T_arrow(t)) for i, (_, t) in enumerate(outputs)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*names, *(a for a, _ in outputs)])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def T_arrow(kind: T.DataType) -> pa.DataType:
    return {"boolean": pa.bool_(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}[kind.simpleString()]


def rate_limit(rows: DataFrame, key: str, seconds: str, order: list[str], cap: int, window: int) -> DataFrame:
    """Append accepted and wait: at most ``cap`` accepted rows within ``window`` seconds; refused rows don't count.

    A row exactly ``window`` old still counts. wait is how many seconds until the next place, 0 if accepted.
    """

    def step(held: deque, now: int):
        while held and held[0] < now - window:
            held.popleft()
        if len(held) >= cap:
            return False, held[0] + window - now + 1
        held.append(now)
        return True, 0

    return fold(rows, key, order, [seconds], deque, step, [("accepted", T.BooleanType()), ("wait", T.LongType())])


def adaptive_limit(rows: DataFrame, key: str, throttled: str, order: list[str], most: int, grow: int = 20) -> DataFrame:
    """Append limit: one less (1 at least) after a throttled row, one more after ``grow`` others in a row."""

    def step(s: list, hit: bool):
        if hit:
            s[0], s[1] = max(1, s[0] - 1), 0
        else:
            s[1] += 1
            if s[1] >= grow and s[0] < most:
                s[0], s[1] = s[0] + 1, 0
        return (s[0],)

    return fold(rows, key, order, [throttled], lambda: [most, 0], step, [("limit", T.IntegerType())])


def cooldown(rows: DataFrame, key: str, seconds: str, throttled: str, order: list[str], retry_after: int = 0, least: int = 5, most: int = 120) -> DataFrame:
    """Append pause: the cooldown set by a throttled row; null for others and for those within a pause.

    It starts at the server's wait and doubles if nothing succeeded since the last pause.
    """

    def step(s: dict, now: int, hit: bool):
        if not hit:
            s["ok"] = True
            return (None,)
        if now < s["until"]:
            return (None,)
        s["pause"] = max(retry_after, least) if s["ok"] or not s["pause"] else min(most, 2 * s["pause"])
        s["ok"], s["until"] = False, now + s["pause"]
        return (s["pause"],)

    return fold(rows, key, order, [seconds, throttled], lambda: {"ok": False, "pause": 0, "until": -(1 << 62)}, step, [("pause", T.IntegerType())])


def follow_neighbours(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Append resolved: a missing value becomes its neighbours' where all that are known agree, from left to right.

    The neighbour before counts as already resolved, the one after as it was; so a run of missing values fills from
    its left end as long as nothing after contradicts.
    """
    after = F.lead(value).over(Window.partitionBy(key).orderBy(*order))

    def step(s: list, own, following):
        near = {x for x in (s[0], following) if x is not None}
        s[0] = own if own is not None else near.pop() if len(near) == 1 else None
        return (s[0],)

    out = fold(rows.withColumn("_after", after), key, order, [value, "_after"], lambda: [None], step, [("resolved", rows.schema[value].dataType)])
    return out.drop("_after")


def rate_limit_stream(rows: DataFrame, key: str, seconds: str, cap: int, window: int, event_time: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """:func:`rate_limit` over a stream: key, seconds, accepted. Rows of a key are judged in the order of their seconds
    within a micro-batch, and after those of earlier ones. State is the accepted times, ``cap`` at most.

    With ``event_time`` (the timestamp of those seconds) a key's state goes once the watermark, ``delay`` behind the latest row, is past the window of all that it holds, so
    state is bounded by the keys of a window; without it state stays for ever.
    """
    kind = rows.schema[key].dataType.simpleString()

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, out = list(state.get[0]) if state.exists else [], []
        times = sorted(t for frame in frames for t in frame[seconds].tolist())  # a key's rows of one micro-batch
        for now in times:
            held = [t for t in held if t >= now - window]
            out.append(len(held) < cap)
            if out[-1]:
                held.append(now)
        state.update((held,))
        if event_time:
            state.setTimeoutTimestamp(max(1000 * (max(held, default=times[-1]) + window) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [keys[0]] * len(times), seconds: times, "accepted": out})

    if event_time:
        rows = rows.withWatermark(event_time, delay)
    grouped = rows.select(key, F.col(seconds).cast("long").alias(seconds), *([event_time] if event_time else [])).groupBy(key)
    return grouped.applyInPandasWithState(step, f"`{key}` {kind}, `{seconds}` long, accepted boolean", "held array<long>", "append", "EventTimeTimeout" if event_time else "NoTimeout")


def latest_progress(events: DataFrame, job: str, order: str, fields: list[str]) -> DataFrame:
    """Per job the last known value of each field; works over a stream too, as an update-mode aggregate."""
    return events.groupBy(job).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields])
