import numpy as np

from tallyglass.operators import bitmaps, transfer
from tallyglass.streaming import feeds


def shape(label, mask, n=5):
    return (label, label, mask.shape[0], mask.shape[1], int(mask.sum()), bytearray(bitmaps.pack(mask)), n)


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, label string, h int, w int, ink int, bits binary, n long")


def masks(seed=1, count=5):
    rng = np.random.default_rng(seed)
    return [np.kron(rng.random((6, 4)) < 0.5, np.ones((3, 3))).astype(bool) | (np.indices((18, 12))[0] % 17 == 0) for _ in range(count)]


def test_scale_and_labels_of_a_larger_font(spark):
    old = masks()
    teacher = frame(spark, [shape(c, m) for c, m in zip("abcde", old, strict=True)])
    new = frame(spark, [(f"k{c}", None, 36, 24, int(m.sum()) * 4, bytearray(bitmaps.pack(np.kron(m, np.ones((2, 2))).astype(bool))), 3) for c, m in zip("abcde", old, strict=True)])
    assert transfer.find_scale(new, teacher) == 2.0
    assert {(r["key"], r["label"]) for r in transfer.match_rescaled(new, teacher, 2.0).collect()} == {(f"k{c}", c) for c in "abcde"}
    assert transfer.find_scale(new.where("h < 0"), teacher) is None


def test_no_match_without_a_lead(spark):
    m = masks()[0]
    teacher = frame(spark, [shape("a", m), shape("b", m), shape("", m)])
    assert transfer.match_rescaled(frame(spark, [shape("k", m)]), teacher, 1.0).count() == 0


def test_lineage_is_one_to_one(spark):
    matches = spark.createDataFrame([("o1", "n1"), ("o2", "n2"), ("o3", "n2"), ("o4", "n4"), ("o4", "n5")], "old string, new string")
    mapping = transfer.lineage(matches)
    assert [tuple(r) for r in mapping.collect()] == [("o1", "n1")]
    rows = spark.createDataFrame([("o1", 1), ("o2", 2)], "key string, n int")
    assert [(r["key"], r["n"]) for r in transfer.carry(rows, "key", mapping).collect()] == [("n1", 1)]


def test_audit_finds_look_alikes(spark):
    a, b = masks()[:2]
    near = a.copy()
    near[5, 5] ^= True
    rows = frame(spark, [shape("a", a), shape("x", near), shape("b", b)])
    found = transfer.audit(rows, rows.select("key", "label")).collect()
    assert [(r["key"], r["ref_key"]) for r in found] == [("a", "x")]


def test_word_styles(spark):
    upright = np.zeros((20, 12), bool)
    upright[:, 4:6] = True
    leaning = np.zeros((20, 12), bool)
    for y in range(20):
        leaning[y, 9 - int(0.3 * y) : 11 - int(0.3 * y)] = True
    heavy = np.zeros((20, 12), bool)
    heavy[:, 4:8] = True
    glyph = lambda m: (m.shape[0], m.shape[1], bytearray(bitmaps.pack(m)))
    rows = spark.createDataFrame([("f", 0, [glyph(upright)] * 3), ("f", 1, [glyph(leaning)] * 2), ("f", 2, [glyph(heavy)]), ("f", 3, [glyph(upright)]), ("f", 4, [])], "file string, word int, glyphs array<struct<h:int,w:int,bits:binary>>")
    got = {r["word"]: (r["italic"], r["bold"]) for r in transfer.word_styles(rows).collect()}
    assert got[0] == (False, False) and got[1][0] and got[2] == (False, True)


def test_change_feed_stream_and_counters(spark, tmp_path):
    spark.createDataFrame([("k", i, v) for i, v in enumerate("aabba")], "k string, i long, v string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, i long, v string").parquet(str(tmp_path / "in"))
    q = feeds.change_feed_stream(stream, "k", "i", "v").writeStream.format("memory").queryName("changed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["i"] for r in spark.table("changed").collect()) == [0, 2, 4]
    counts = lambda n: spark.createDataFrame([("a", n), ("b", 1)], "k string, n long")
    for batch_id, n in ((0, 2), (1, 3), (1, 3), (0, 2)):  # a batch that comes again counts once
        feeds.upsert_counters(counts(n), batch_id, str(tmp_path / "counters"), ["k"])
    assert {tuple(r) for r in feeds.read_counters(spark, str(tmp_path / "counters")).collect()} == {("a", 5), ("b", 2)}
    jobs = spark.createDataFrame([("done", 0), ("done", 900), ("run", 0)], "status string, finished long")
    assert feeds.expired(jobs, 1000).count() == 1
