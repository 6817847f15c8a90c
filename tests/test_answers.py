import json
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallyglass.operators import answers as A
from tallyglass.operators import bitmaps
from tallyglass.operators.align import align, reline_by_glyphs, split_over_cues


def test_context_answers_come_first(spark):
    images = spark.createDataFrame([("i", "c"), ("i", "d"), ("j", "c")], "image_key string, context_key string")
    table = spark.createDataFrame([("i", "c", "one"), ("i", None, "two")], "image_key string, context_key string, text string")
    assert {tuple(r) for r in A.cached_answers(images, table).select("image_key", "context_key", "text", "via").collect()} == {("i", "c", "one", "context"), ("i", "d", "two", "image"), ("j", "c", None, None)}


def test_cleaning_and_sheets(spark):
    row = spark.createDataFrame([("```text\na  \n\nb\n```", "a\nb\na\nb", "1. one\n\n(2) two\nmore\n\n 3 - three ", "a")], "t string, r string, s string, o string")
    got = row.select(A.clean(F.col("t")), A.unrepeated(F.col("r"), F.lit(2)), A.unrepeated(F.col("r"), F.lit(3)), A.split_sheet(F.col("s"), F.lit(3)), A.split_sheet(F.col("s"), F.lit(2))).first()
    assert tuple(got) == ("a\nb", "a\nb", "a\nb\na\nb", ["one", "two\nmore", "three"], None)


def test_transcripts_of_messages(spark):
    call = lambda name, arguments: {"function": {"name": name, "arguments": arguments}}
    given = json.dumps({"lines": ["one ", "", "two"]})
    cases = [
        ({"content": "x", "tool_calls": [call("other", given), call("submit_transcript", given)]}, "one\ntwo"),
        ({"content": "```\nx\n```", "tool_calls": [call("submit_transcript", "{}")]}, "x"),
        ({"content": "x", "tool_calls": [call("submit_transcript", '{"lines": "no list"}'), call("submit_transcript", given)]}, "one\ntwo"),
        ({"content": "x", "tool_calls": [call("submit_transcript", "no json")]}, "x"), ({"content": None, "tool_calls": []}, ""), ({"content": "a\nb"}, "a\nb"),
        ({"tool_calls": [call("submit_transcript", '{"lines": []}')], "content": "x"}, ""),
    ]
    rows = spark.createDataFrame([(i, json.dumps(m)) for i, (m, _) in enumerate(cases)] + [(90, "no json"), (91, None)], "i int, m string")
    got = {r["i"]: r["t"] for r in rows.select("i", A.transcript(F.col("m")).alias("t")).collect()}
    assert got == {**{i: t for i, (_, t) in enumerate(cases)}, 90: "", 91: ""}


def _drawn(text):
    """Lines of glyphs that draw the lines of a text, each letter known."""
    out = []
    for line in text.split("\n"):
        after = [line[i + 1 : i + 2] == " " for i in range(len(line))]
        out.append([{"key": c, "w": 9, "gap_after": 18 if a else 2, "label": c} for c, a in zip(line, after, strict=True) if c != " "])
    return out


def test_one_answer_is_split_over_cues_by_their_glyphs():
    cues = [_drawn("Winter came"), _drawn("over the hills\nlast night"), _drawn("so early")]
    whole = ["Winter came", "over the hills\nlast night", "so early"]
    for text in ("Winter came over the hills last night so early", "Winter<br>came over\nthe hills last<BR />night so early", " Winter  came\n\nover the hills last night so early "):
        assert split_over_cues(cues, text, 12) == whole
    assert split_over_cues(cues[:2], "Winter came over the hillslast night", 12) == whole[:2]  # words that ran together over a break
    assert split_over_cues(cues[:1], "Winter\ncame", 12) == whole[:1]
    assert split_over_cues(cues, "Winter", 12) is None and split_over_cues(cues, "", 12) is None and split_over_cues([], "x", 12) is None and split_over_cues([cues[0], []], "Winter came", 12) is None


def test_styles_go_on_over_the_breaks_of_cues():
    cues = [_drawn("Winter came"), _drawn("over the\nhills")]
    assert split_over_cues(cues, "<i>Winter came over the hills</i>", 12) == ["<i>Winter came</i>", "<i>over the</i>\n<i>hills</i>"]
    assert split_over_cues(cues, "Winter <i>came over</i> <b>the hills</b>", 12) == ["Winter <i>came</i>", "<i>over</i> <b>the</b>\n<b>hills</b>"]


def test_splits_cost_least_of_all():
    """Against every way to cut a text at its blanks."""
    rng = np.random.default_rng(3)
    for _ in range(40):
        words = ["".join(rng.choice(list("abcde"), rng.integers(2, 6))) for _ in range(6)]
        at = sorted(rng.choice(np.arange(1, 6), 2, replace=False).tolist())
        lines = [" ".join(words[a:b]) for a, b in zip([0, *at], [*at, 6], strict=True)]
        drawn = [_drawn(t)[0] for t in lines]
        for line in drawn:
            line[int(rng.integers(len(line)))]["label"] = "z"
        cost = lambda parts: sum(found["cost"] if (found := align(g, t, 12)) else float("inf") for g, t in zip(drawn, parts, strict=True))
        best = min(cost([" ".join(words[:i]), " ".join(words[i:j]), " ".join(words[j:])]) for i in range(1, 5) for j in range(i + 1, 6))
        got, parts = reline_by_glyphs(drawn, " ".join(words), 12)
        assert got == best == cost(parts)


def test_sheets_of_cues(spark):
    glyphs = "array<struct<key: string, w: int, gap_after: int, label: string>>"
    rows = [(s, c, k, g) for s in "pqrst" for c, text in enumerate(["Winter came", "over the\nhills"]) for k, g in enumerate(_drawn(text))]
    lines = spark.createDataFrame(rows, f"sheet string, cue int, line int, glyphs {glyphs}")
    texts = [("p", "1. Winter\ncame\n\n2. over the hills"), ("q", "<i>Winter came over the hills</i>"), ("r", "snow"), ("s", "x\n\nover the\nhills"), ("s", "y"), ("u", "no such sheet")]
    got = {(r["sheet"], r["cue"]): (r["text"], r["via"]) for r in A.sheet_texts(lines, spark.createDataFrame(texts, "sheet string, text string"), 12.0).collect()}
    assert got == {
        ("p", 0): ("Winter came", "parts"), ("p", 1): ("over the\nhills", "parts"), ("q", 0): ("<i>Winter came</i>", "glyphs"), ("q", 1): ("<i>over the</i>\n<i>hills</i>", "glyphs"),
        ("r", 0): (None, None), ("r", 1): (None, None), ("s", 0): ("x", "parts"), ("s", 1): ("over the\nhills", "parts"), ("t", 0): (None, None), ("t", 1): (None, None),
    }
    empty = A.sheet_texts(lines.limit(0), spark.createDataFrame(texts, "sheet string, text string"), 12.0)
    assert empty.count() == 0 and empty.columns == ["sheet", "cue", "text", "via"]


def test_batches_apply_in_order(spark):
    rows = spark.createDataFrame([("f", 2, "ok"), ("f", 0, "ok"), ("f", 1, "failed")], "file string, batch_no int, status string")
    assert [(r["applied"], r["failed"]) for r in A.apply_in_order(rows).orderBy("batch_no").collect()] == [(1, 0), (1, 1), (2, 1)]


def test_sample_excludes_and_repeats(spark):
    rows = spark.range(100)
    done = spark.range(10)
    pick = lambda: sorted(r["id"] for r in A.sample(rows, "id", F.col("id") < 30, done, 5, 7).collect())
    got = pick()
    assert len(got) == 12 and min(got) >= 10 and sum(i < 30 for i in got) == 5 and got == pick()


def test_alike_fonts(spark):
    votes = spark.createDataFrame([("s", "k", 0, "I", 2), ("s", "k", 0, "l", 2), ("t", "a", 0, "I", 3), ("t", "b", 0, "l", 3), ("u", "a", 0, "I", 3), ("u", "b", 0, "l", 3)], "set string, cluster string, top_rel int, label string, n long")
    shapes = spark.createDataFrame([("s", "k", 20, 3), ("t", "a", 20, 3), ("t", "b", 21, 4), ("u", "a", 20, 3), ("u", "b", 24, 3)], "set string, cluster string, h int, w int")
    assert {r["set"]: r["alike"] for r in A.alike_font(votes, shapes).collect()} == {"s": True, "t": True, "u": False}


def test_alike_fonts_from_counts(spark):
    rng = random.Random(5)
    pick = lambda *xs: rng.choice(xs)
    places = [(s, c, pick(*"IIllx")) for s in [*"abcdefghjkmnopqrstuvw", None] for c in [*"cdef", None]]
    seen = [(s, c, x if rng.random() < 0.8 else pick("I", "l", "y", None)) for s, c, x in (rng.choice(places) for _ in range(600))]
    shapes = {(s, c): (pick(*range(20, 26), None), pick(*range(3, 7), None)) for s, c, _ in seen}
    votes, known = Counter(seen), {}
    for s, c in shapes:
        of = {x: n for (s2, c2, x), n in votes.items() if (s2, c2) == (s, c)}
        top = max(of.values())
        sure = sum(of.values()) >= 2 and 3 * top >= 2 * sum(of.values()) and (len(of) == 1 or top >= 3)
        known[s, c] = (of.get("I", 0) >= 2 and of.get("l", 0) >= 2, max(of, key=of.get) if sure else None)
    read = [(s, label, *shapes[s, c]) for (s, c), (_, label) in known.items() if None not in (s, c, label, *shapes[s, c])]
    near = {s for s, x, h, w in read for s2, x2, h2, w2 in read if (s, x, x2) == (s2, "I", "l") and abs(h - h2) <= 1 and abs(w - w2) <= 1}
    want = {s: s in near or any(both for (s2, _), (both, _) in known.items() if s2 == s) for s, _, _ in seen}
    assert 0 < len(near) < sum(want.values()) < len(want)
    rows = spark.createDataFrame([(s, c, x, *shapes[s, c]) for s, c, x in seen], "set string, cluster string, label string, h int, w int").withColumn("top_rel", F.lit(0))
    counts = rows.groupBy("set", "cluster").agg(F.count("*").alias("total"), F.count_if(F.col("label") == "I").alias("n_a"), F.count_if(F.col("label") == "l").alias("n_b"), F.first("h").alias("h"), F.first("w").alias("w"))
    plain = A.alike_font(rows.groupBy("set", "cluster", "top_rel", "label").agg(F.count("*").alias("n")), rows.select("set", "cluster", "h", "w").distinct())
    for got in (A.alike_font_counted(counts), plain):
        assert {r["set"]: r["alike"] for r in got.collect()} == want and got.count() == len(want)


def test_local_and_prototype_difference():
    rng = np.random.default_rng(2)
    a = rng.random((14, 30)) < 0.5
    b = a.copy()
    b[:, 20:30] = rng.random((14, 10)) < 0.5
    assert bitmaps.local_difference(a, a) == 0 and bitmaps.local_difference(a, b) > 1.5 * bitmaps.difference(a, b)
    median, stable = bitmaps.prototype([a, a, a], [1, 1, 1])
    assert bitmaps.prototype_difference(a, median, stable) == 0 < bitmaps.prototype_difference(b, median, stable)


def test_stacked_lines():
    upper = [(10 * i, 0, 10 * i + 8, 20) for i in range(4)]
    lower = [(10 * i, 18, 10 * i + 8, 38) for i in range(4)]
    dot = (3, 15, 5, 17)
    assert [len(line) for line in bitmaps.stacked_lines([*upper, *lower, dot])] == [5, 4]
    assert bitmaps.stacked_lines(upper) == [upper] and bitmaps.stacked_lines([]) == []


def test_png():
    data = bitmaps.png(np.eye(3, dtype=bool))
    at = data.index(b"IDAT")
    assert zlib.decompress(data[at + 4 : data.index(b"IEND") - 8]) == bytes([0, 0, 255, 255, 0, 255, 0, 255, 0, 255, 255, 0])
