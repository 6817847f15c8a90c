import pytest

from tallyglass.operators import votes


def frame(spark, counts):
    return spark.createDataFrame([(0, k, n) for k, n in counts.items()], "k int, label string, n long")


@pytest.mark.parametrize(
    "counts, label",
    [({"a": 1}, None), ({"a": 2}, "a"), ({"a": 2, "e": 1}, None), ({"a": 3, "e": 1}, "a"), ({"6": 3, "8": 2}, None), ({"a": 2, "e": 2}, None), ({"a": 2, "e": 0}, "a"), ({"I": 4, "1": 1}, "I")],
)
def test_trusted_label(spark, counts, label):
    assert votes.trusted_label(frame(spark, counts), ["k"]).first()["label"] == label


def test_override_needs_three_quarters(spark):
    assert votes.override_label(frame(spark, {"a": 3, "e": 1}), ["k"]).first()["label"] == "a"
    assert votes.override_label(frame(spark, {"a": 2}), ["k"]).count() == 0
    assert votes.override_label(frame(spark, {"I": 6, "l": 1}), ["k"], ["I", "l"]).count() == 0


def test_stray_vote_leaves_look_alikes_ambiguous(spark):
    row = votes.read_decision(frame(spark, {"I": 112, "l": 197, "L": 1}), ["k"], ["I", "l", "|"]).first()
    assert (row["label"], row["reason"]) == (None, "ambiguous")


def test_repeated_label_in_one_unit_votes_once(spark):
    rows = spark.createDataFrame([(1, "k", "a"), (1, "k", "a"), (2, "k", "a")], "unit int, k string, label string")
    assert votes.one_vote_per_unit(rows, "unit", ["k"], "label").first()["n"] == 2


def test_settled_keeps_marked_keys(spark):
    rows = spark.createDataFrame([(0, "a", 1), (1, "a", 2), (2, "a", 1)], "k int, label string, n long")
    kept = spark.createDataFrame([(2,)], "k int")
    assert {r["k"]: r["part"] for r in votes.settled(rows, ["k"], kept).collect()} == {0: "interim", 1: "settled", 2: "settled"}


def test_rescaled_flag(spark):
    one = spark.range(300).select("id")
    assert votes.key_frequency(one, ["id"]).first()["rescaled"]
    assert not votes.key_frequency(one.union(one), ["id"]).first()["rescaled"]


def test_language_guess(spark):
    texts = spark.createDataFrame([(1, "the you and to of it that is in what " * 4), (2, "der die und ich nicht das ist du sie es " * 3), (3, "the der"), (4, None)], "id int, text string")
    stop = spark.createDataFrame([(lang, w) for lang, ws in {"en": "the you and to of it that is in what", "de": "der die und ich nicht das ist du sie es"}.items() for w in ws.split()], "lang string, word string")
    assert {r["id"]: r["language"] for r in votes.guess_language(texts, "id", "text", stop).collect()} == {1: "en", 2: "de", 3: None, 4: None}
