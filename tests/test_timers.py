"""Streams whose state has timers: jobs are evicted, and a user's window leaves the state."""

import datetime

from tallyglass.streaming import feeds, limits


def at(s):
    return datetime.datetime.fromtimestamp(1_700_000_000 + s, datetime.UTC).replace(tzinfo=None)


def run(spark, tmp_path, name, schema, batches, plan):
    """The rows that a stream gives for files that come one after the other, and its last progress."""
    folder = tmp_path / "in"
    folder.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    spark.createDataFrame(batches[0], schema).coalesce(1).write.mode("append").parquet(str(folder))
    q = plan(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        for b in batches[1:]:
            spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(folder))
            q.processAllAvailable()
        held = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        q.stop()
    return spark.table(name).collect(), held


def test_jobs_are_evicted_when_their_timer_is_due(spark, tmp_path):
    batches = [
        [("a", "run", at(0)), ("a", "done", at(10)), ("b", "error", at(20)), ("c", "run", at(20)), ("d", "done", at(30))],
        [("d", "run", at(100)), ("e", "run", at(615))],  # d goes on; the clock is past a's timer, not b's
        [("e", "run", at(640))],
        [("e", "run", at(5000))],
    ]
    plan = lambda s: feeds.evictions(s, "job", "status", "t")
    rows, held = run(spark, tmp_path, "evicted", "job string, status string, t timestamp", batches, plan)
    assert {(r["job"], r["status"], r["evicted"].timestamp() - at(0).replace(tzinfo=datetime.UTC).timestamp()) for r in rows} == {("a", "done", 610), ("b", "error", 620)}
    assert held == 3  # c, d and e haven't ended


def test_windows_leave_the_state(spark, tmp_path):
    stamp = lambda u, s: (u, 1_700_000_000 + s, at(s))
    batches = [[stamp("u", s) for s in (0, 1, 2)] + [stamp("v", 5)], [stamp("u", 3000), stamp("w", 3590)], [stamp("w", 9000)], [stamp("u", 9001)]]
    plan = lambda s: limits.rate_limit_stream(s, "u", "sec", 2, 3600, "t", "1 second")
    rows, held = run(spark, tmp_path, "windows", "u string, sec long, t timestamp", batches, plan)
    got = {(r["u"], r["sec"] - 1_700_000_000): r["accepted"] for r in rows}
    assert got == {("u", 0): True, ("u", 1): True, ("u", 2): False, ("v", 5): True, ("u", 3000): False, ("w", 3590): True, ("w", 9000): True, ("u", 9001): True}
    assert held == 2  # v's window has gone, and u's first one too


def test_daily_users_batch_roll_and_stream_agree(spark, tmp_path):
    from tallyglass.streaming import users

    hour = 3600
    start = -(1_700_000_000 % 86_400)
    seen = [(u, at(start + s)) for u, s in [("a", 10), ("b", 20), ("a", 30), ("a", 20 * hour), ("b", 25 * hour), ("c", 26 * hour), ("b", 27 * hour), ("d", 49 * hour)]]
    rows = spark.createDataFrame(seen, "u string, t timestamp").selectExpr("u", "t", "date_format(t, 'yyyy-MM-dd') as day")
    want = {r["day"]: r["users"] for r in users.daily_users(rows, "day", "u").collect()}
    days = sorted(want)
    assert [want[d] for d in days] == [2, 2, 1]

    salts = users.with_salts(spark, None, days[:2])
    assert {r["day"]: r["salt"] for r in users.with_salts(spark, salts, days[:2]).collect()} == {r["day"]: r["salt"] for r in salts.collect()}
    found = users.hashed(rows, salts, "day", "u")
    kept = found.collect()
    assert len(kept) == 4 and len({r["who"] for r in kept}) == 4 and all(len(r["who"]) == 24 for r in kept)  # b has another hash the next day
    counts = spark.createDataFrame([], "day string, users long")
    open_, counts, salts = users.roll(spark.createDataFrame(kept), counts, salts, days[1])
    assert {tuple(r) for r in counts.collect()} == {(days[0], 2)} and {r["day"] for r in open_.collect()} == {days[1]} == {r["day"] for r in salts.collect()}
    assert users.roll(spark.createDataFrame(kept), counts, salts, days[1])[1].count() == 1

    batches = [seen[:3], seen[3:6], seen[6:], [("z", at(start + 80 * hour))]]
    got, held = run(spark, tmp_path, "users", "u string, t timestamp", batches, lambda s: users.daily_users_stream(s, "t", "u", "secret"))
    assert {r["day"]: r["users"] for r in got} == {d: want[d] for d in days} and held == 1  # the last day is still open
