"""Rules of mergeable state and of text that have no query of their own, and styled text against a naive version."""

import json
import re

from pyspark.sql import functions as F

from tallyglass.functions import styles, text
from tallyglass.operators import merging, sequences


def test_target_conflicts(spark):
    offered = spark.createDataFrame([("a", "e"), ("b", "o"), ("c", None), ("d", "x")], "key string, label string")
    near = spark.createDataFrame([("a", "t1", 0.05), ("a", "t2", 0.02), ("b", "t1", 0.1), ("b", "t3", 0.1), ("c", "t1", 0.0), ("d", "t4", 0.0)], "key string, ref_key string, ratio double")
    target = spark.createDataFrame([("t1", "e"), ("t2", "c"), ("t3", "o"), ("t4", None)], "ref_key string, label string")
    assert [tuple(r) for r in merging.target_conflicts(offered, near, target).collect()] == [("a", "e", "t2", "c", 0.02)]


def test_journals_are_replayed_once_and_in_order(spark):
    rows = [("r1", 1, "k", "vote", 5), ("r1", 2, "k", "clear", 0), ("r1", 3, "k", "vote", 2), ("r2", 1, "k", "vote", 1), ("r0", 9, "k", "vote", 7), ("r1", 4, "j", "vote", 1), ("r2", 2, "j", "clear", 0)]
    journal = spark.createDataFrame(rows, "run string, seq_no long, key string, op string, n long")
    seen = spark.createDataFrame([("r0",)], "run string")
    assert {r["key"]: r["n"] for r in merging.replay_in_order(journal, seen, ["key"]).collect()} == {"k": 3, "j": 0}
    assert merging.replay_in_order(journal, journal.select("run"), ["key"]).count() == 0


def test_credit_and_publishing(spark):
    shapes = spark.createDataFrame([("a", 1), ("b", 4), ("c", 1)], "key string, n long")
    counts = spark.createDataFrame([("f2", "a", 9), ("f1", "a", 3), ("f1", "b", 1)], "file string, key string, n long")
    assert {r["key"]: r["n"] for r in merging.credit_occurrences(shapes, counts, "key", "file").collect()} == {"a": 3, "b": 4, "c": 1}
    assert merging.publishable(shapes.withColumn("words", F.lit(1))).columns == ["key", "n"]
    payload = spark.createDataFrame([(json.dumps({"n": 1, "srt": "secret", "db": {"a": 1}, "t": "x"}),), (None,)], "p string")
    got = [r[0] for r in payload.select(merging.redacted(F.col("p"))).collect()]
    assert json.loads(got[0]) == {"n": "1", "t": "x"} and got[1] is None


def test_text_rules(spark):
    index = "# a\nid: en\ntimestamp: 00:00:01:000, filepos: 0\nTimestamp: 00:00:02:000, filepos: 1\n x timestamp: no\n"
    rows = spark.createDataFrame([(index, "calm-sable.0.2.2.json"), ("", "calm-sable.json")], "t string, n string")
    got = [(r[0], tuple(r[1]) if r[1] else None) for r in rows.select(text.count_cues(F.col("t")), text.superseded(F.col("n"))).collect()]
    assert got == [(2, ("calm-sable", "0.2.2")), (0, None)]


def test_context_passes_over_empty_texts(spark):
    rows = spark.createDataFrame([("f", i, t) for i, t in enumerate(["a", "", None, "b", "c", "", "d"])], "f string, i int, t string")
    got = [r["context"] for r in sequences.context(rows, "f", ["i"], "t", 2).orderBy("i").collect()]
    assert got == [[], ["a"], ["a"], ["a"], ["a", "b"], ["b", "c"], ["b", "c"]]


def naive_normalized(source):
    """Character by character: flags by a table of open tags, tags written anew wherever the flags change."""
    lines = []
    for line in source.split("\n"):
        if not line.strip():
            continue
        on, chars = set(), []
        for part in re.split(r"(</?[A-Za-z]+[^>]*>)", line):
            if m := re.fullmatch(r"<(/?)([A-Za-z]+)[^>]*>", part):
                (on.discard if m[1] else on.add)(m[2].lower())
                continue
            for c in part:
                if not c.isspace():
                    chars.append((c, [f for f in "biu" if f in on]))
                elif chars and chars[-1][0] != " ":
                    chars.append((" ", [f for f in "biu" if f in on]))
        while chars and chars[-1][0] == " ":
            chars.pop()
        out, stack = "", []
        for i, (c, flags) in enumerate(chars):
            if c == " ":
                flags = [f for f in before if f in chars[i + 1][1]]  # noqa: F821
            while any(f not in flags for f in stack):
                out += f"</{stack.pop()}>"
            for f in flags:
                if f not in stack:
                    stack.append(f)
                    out += f"<{f}>"
            out, before = out + c, flags  # noqa: F841
        lines.append(out + "".join(f"</{f}>" for f in reversed(stack)))
    return "\n".join(lines)


def test_normalized_equals_a_naive_version():
    import random

    r = random.Random(5)
    for _ in range(3000):
        t = "".join(r.choice(["a", "b ", " ", "\n", "<i>", "</i>", "<b>", "</b>", "<u>", "</u>", "<font x>", "c"]) for _ in range(r.randrange(16)))
        assert styles.normalized(t) == naive_normalized(t), repr(t)
