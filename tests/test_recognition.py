import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyglass.operators import recognition as R
from tallyglass.operators import sequence_keys, words


def test_longer_sequences_win_and_do_not_overlap(spark):
    glyphs = spark.createDataFrame([("f", 0, 0, i, k) for i, k in enumerate("abcabab")], "file string, cue int, line int, pos int, key string")
    votes = spark.createDataFrame([(["a", "b"], "x", 2), (["a", "b", "c"], "y", 2), (["b", "a"], "z", 2), (["c", "a"], "q", 1)], "parts array<string>, label string, n long")
    got = sorted((r["pos"], r["length"], r["label"]) for r in sequence_keys.sequence_matches(glyphs, votes, ["pos"]).collect())
    assert got == [(0, 3, "y"), (3, 2, "x"), (5, 2, "x")]


def test_exact_reading_before_near(spark):
    glyphs = spark.createDataFrame([("a", 0), ("a", 5), ("b", 0), ("z", 0)], "key string, top_rel int")
    exact = spark.createDataFrame([("a", 1, "A", 2), ("a", -1, "X", 3), ("c", 0, "C", 1)], "key string, top_rel int, label string, insert_no long")
    near = spark.createDataFrame([("b", "c")], "key string, ref_key string")
    read = R.read_glyphs(glyphs, exact, near)
    assert {(r["key"], r["top_rel"]): (r["text"], r["via"]) for r in read.collect()} == {("a", 0): ("A", "exact"), ("a", 5): (None, None), ("b", 0): ("C", "near"), ("z", 0): (None, None)}
    row = R.unknown_share(read.withColumn("cue", F.lit(1)), ["cue"]).first()
    assert (row["unknown"], row["phase"]) == (2, "training")


def test_word_memory_needs_two_thirds(spark):
    memory = spark.createDataFrame([(["a"], "x", 2), (["a"], "y", 1), (["b"], "x", 1), (["b"], "y", 1)], "keys array<string>, text string, n long")
    words = spark.createDataFrame([(["a"],), (["b"],), (["c"],)], "keys array<string>")
    assert {r["keys"][0]: r["memory"] for r in R.word_memory(words, memory).collect()} == {"a": "x", "b": None, "c": None}


def test_arbitration(spark):
    rows = spark.createDataFrame(
        [
            ("a b", True, None, None, None), ("<i>ab</i>", True, "ab", True, None), ("ab", True, "a b", True, None), (None, False, "a b", True, "a b"), ("ac", True, "a b", True, None),
            ("ac", True, "a b", False, None), (None, False, None, None, None), ("x?", False, "xy", False, None),
        ],
        "own string, ok boolean, teacher string, fits boolean, filled string",
    )
    got = [tuple(r[0]) for r in rows.select(R.arbitrate(*map(F.col, ("own", "ok", "teacher", "fits", "filled")))).collect()]
    assert got == [
        ("a b", "own"), ("<i>ab</i>", "own"), ("ab", "spaces from geometry"), ("a b", "spaces filled"), ("a b", "teacher"), ("ac", "own against teacher"), ("[?]", "placeholder"), ("xy", "teacher"),
    ]


def test_gaps_beyond_bearings(spark):
    rows = spark.createDataFrame([(0, "a", "b", 3), (1, "a", "b", 13), (2, "a", "b", 8), (3, "x", "y", 1), (4, "x", "y", 20), (5, "p", "q", 13)], "i int, ka string, kb string, gap int")
    pairs = spark.createDataFrame([("p", "q", 13, 2, 0)], "ka string, kb string, gap int, letter long, space long")
    histogram = spark.createDataFrame([(8, 50, 0), (3, 0, 9)], "gap int, letter long, space long")
    bearings = [("right", "a", 2.0), ("left", "b", 1.0), ("right_default", None, 1.0), ("left_default", None, 0.0), ("space", None, 10.0)]
    read = lambda b: [r["is_space"] for r in R.classify_gaps(rows, pairs, histogram, spark.createDataFrame(b, "side string, key string, value double")).orderBy("i").collect()]
    assert read(bearings) == [False, True, None, False, True, False]
    assert read([*bearings[:4], ("space", None, 3.0)])[:3] == [True, True, False]  # a space too narrow to tell: the counts decide


def test_gaps(spark):
    pairs = spark.createDataFrame([("a", "b", 5, 0, 2), ("a", "c", 5, 1, 1)], "ka string, kb string, gap int, letter long, space long")
    histogram = spark.createDataFrame([(2, 50, 0), (5, 20, 1), (6, 3, 3), (12, 0, 9)], "gap int, letter long, space long")
    rows = spark.createDataFrame([(1, "a", "b", 5), (2, "a", "c", 5), (3, "x", "y", 6), (4, "x", "y", 12), (5, "x", "y", 20), (6, "x", "y", 1)], "id int, ka string, kb string, gap int")
    assert {r["id"]: r["is_space"] for r in R.classify_gaps(rows, pairs, histogram).collect()} == {1: True, 2: False, 3: None, 4: True, 5: True, 6: False}


def test_resolve(spark):
    rows = spark.createDataFrame([(1, [["I", "l"], ["t"]]), (2, [["I", "l"], ["I", "l"]]), (3, [["c"], ["a", "o"], ["t"]]), (4, [["a", "b", "c", "d"]] * 4)], "id int, candidates array<array<string>>")
    lexicon = spark.createDataFrame([("it", 6.0), ("ill", 5.0), ("cat", 5.0), ("cot", 2.5)], "word string, zipf double")
    got = {r["id"]: r["resolved"] for r in words.resolve_words(rows, lexicon).collect()}
    assert got[1] == "It" and got[3] == "cat" and got[4] is None


def test_batches_cover_the_most_frequent(spark):
    rows = spark.createDataFrame([("f", 0, 2, ["a"]), ("f", 1, 2, ["a", "b"]), ("f", 2, 2, ["c"]), ("f", 3, 2, ["b"])], "file string, cue long, n_glyphs long, keys array<string>")
    assert [(r["cue"], r["batch_no"]) for r in R.greedy_batches(rows, 2).orderBy("batch_no").collect()] == [(1, 0), (2, 1)]


def test_census(spark):
    tracks = spark.createDataFrame([("t1", "a"), ("t2", "a"), ("t3", "b"), ("t4", "a")], "track string, frame string")
    sets = {"t1": range(10), "t2": range(5, 12), "t3": range(10), "t4": range(20, 23)}
    keys = spark.createDataFrame([(t, str(k)) for t, ks in sets.items() for k in ks], "track string, key string")
    assert {r["track"]: r["leader"] for r in R.census_groups(tracks, keys, "frame").collect()} == {"t1": "t1", "t2": "t1", "t3": "t3", "t4": "t4"}


def test_reline_equals_brute_force(spark):
    words = "hold the door for me now".split()
    rows = spark.createDataFrame([(1, " ".join(words), [9.0, 7.0, 8.0]), (2, "one", [1.0, 1.0]), (3, None, [1.0])], "id int, text string, widths array<double>")
    got = {r["id"]: r["lines"] for r in R.reline(rows).collect()}
    cost = lambda cut: sum((len(" ".join(words[a:b])) - w) ** 2 for (a, b), w in zip(itertools.pairwise((0, *cut, 6)), (9, 7, 8), strict=True))
    best = min(itertools.combinations(range(1, 6), 2), key=cost)
    assert got == {1: [" ".join(words[a:b]) for a, b in itertools.pairwise((0, *best, 6))], 2: None, 3: None}


def test_index_and_report(spark):
    scanned = spark.createDataFrame([("r", 5), ("s", 6)], "release string, cues int")
    old = spark.createDataFrame([("r", 1, "mine")], "release string, cues int, notes string")
    assert {tuple(r) for r in R.index_with_notes(scanned, old, ["release"], ["notes"]).collect()} == {("r", 5, "mine"), ("s", 6, "")}
    rows = spark.createDataFrame([("f", "own"), ("f", "own"), ("f", "teacher")], "file string, source string")
    assert json.loads(R.report(rows, "file").first()["report"]) == {"by_source": {"own": 2, "teacher": 1}, "cues": 3}


def test_repair_needs_a_non_word_and_a_clear_lead(spark):
    lexicon = spark.createDataFrame([("idee", 5.0, True), ("ldee", 1.5, False), ("ill", 4.5, True), ("lll", 0.5, False), ("ali", 4.0, False), ("all", 4.5, False)], "word string, zipf double, valid boolean")
    rows = spark.createDataFrame([(1, ["l", "d", "e", "e"]), (2, ["I", "l", "l"]), (3, ["a", "I", "i"]), (4, ["x", "y"]), (5, ["(", "l", "d", "e", "e", ")"]), (6, ["l"] * 9), (7, ["lll"]), (8, ["a", "I", "I"])], "id long, parts array<string>")
    got = {r["id"]: r["repaired"] for r in words.repair_words(rows, lexicon).collect()}
    # 2 is a word; 6 has too many spellings; 8 has two, 'all' and 'alI', nearly as frequent
    assert got == {1: "Idee", 2: None, 3: "ali", 4: None, 5: "(Idee)", 6: None, 7: "Ill", 8: None}


def naive_batches(cues, size):
    weight, covered, left, out = {}, set(), dict(cues), []
    for _, keys in cues.values():
        for k in keys:
            weight[k] = weight.get(k, 0) + 1
    while left and len(out) < size:
        best = min(left, key=lambda c: (-sum(weight[k] for k in set(left[c][1]) - covered) / (1 + 0.02 * left[c][0]), c))
        covered |= set(left.pop(best)[1])
        out.append(best)
    return out


def test_batches_equal_a_naive_choice_and_weigh_occurrences(spark):
    import random

    r = random.Random(3)
    cues = {f: {c: (r.randrange(1, 40), [r.choice("abcdefghij") for _ in range(r.randrange(6))]) for c in range(12)} for f in ("f", "g")}
    rows = spark.createDataFrame([(f, c, n, k) for f, x in cues.items() for c, (n, k) in x.items()], "file string, cue long, n_glyphs int, keys array<string>")
    got = {}
    for x in R.greedy_batches(rows, 7).orderBy("batch_no").collect():
        got.setdefault(x["file"], []).append(x["cue"])
    assert got == {f: naive_batches(x, 7) for f, x in cues.items()}


def test_census_equals_a_naive_fold(spark):
    import random

    r = random.Random(4)
    pool = {f: [f"{f}{i}" for i in range(14)] for f in "xy"}
    tracks = {t: ("xy"[t % 2], set(r.sample(pool["xy"[t % 2]], r.randrange(2, 9)))) for t in range(24)}
    want = {}
    for f in "xy":
        leaders = []
        for t in sorted((t for t in tracks if tracks[t][0] == f), key=lambda t: (-len(tracks[t][1]), t)):
            lead = next((x for x in leaders if 2 * len(tracks[x][1] & tracks[t][1]) >= len(tracks[t][1])), None)
            want[t] = t if lead is None else lead
            leaders += [t] if lead is None else []
    rows = spark.createDataFrame([(t, f) for t, (f, _) in tracks.items()], "track long, frame string")
    keys = spark.createDataFrame([(t, k) for t, (_, ks) in tracks.items() for k in ks], "track long, key string")
    assert {x["track"]: x["leader"] for x in R.census_groups(rows, keys, "frame").collect()} == want and len(set(want.values())) < 24


@pytest.mark.parametrize("few", [0, 1, 3, 64])
def test_census_counts_what_pairs_share(spark, monkeypatch, few):
    monkeypatch.setattr(R, "FEW", few)
    r = random.Random(8)
    glyphs = {(f, t): set(r.sample(range(30), r.randint(1, 12))) | set(r.sample(range(100, 104), r.randint(0, 4))) for f in ("p", "q") for t in range(f == "q", 40, 2)}
    tracks = spark.createDataFrame([(t, f) for f, t in glyphs], "track long, frame string")
    keys = spark.createDataFrame([(t, k) for (_, t), ks in glyphs.items() for k in [*ks, *ks, None]], "track long, key long")
    for least in (1, 300, 600, 1000):
        want, leaders = {}, {"p": [], "q": []}
        for (f, t), ks in sorted(glyphs.items(), key=lambda x: (-len(x[1]), x[0][1])):
            lead = next((x for x in leaders[f] if 1000 * len(ks & glyphs[f, x]) >= least * len(ks)), t)
            leaders[f] += [t] * (lead == t)
            want[t] = lead
        found = R.census_groups(tracks, keys, "frame", least)
        assert {x["track"]: x["leader"] for x in found.collect()} == want
        # only the rows of one track have an array of its keys when tracks are met: pairs are counted
        assert "array_intersect(a_keys" not in found._jdf.queryExecution().analyzed().toString()
