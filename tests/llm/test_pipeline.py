import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyglass.llm import langid, packing, queries


def test_stages_on_small_documents(spark, tmp_path):
    english = ["the cat sat on the mat and " + x for x in ("slept all day", "ran far away", "ate some fish", "was not seen")]
    rows = [(i, f"{t}\nsecond line of {i} here\nmail me at a{i}@b.example.com", "en", "s", 0) for i, t in enumerate(english * 3)]
    rows += [(50, None, "en", "s", 0), (51, "", "en", "s", 0), (52, "12345 678", "en", "s", 0), (53, "alpha beta gamma\ndelta epsilon", "en", "s", 0), (54, "alpha beta gamma\ndelta epsilon", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs)
    assert {r["doc_id"] for r in seen[0].collect()} == {*range(12), 53, 54}
    assert 53 in (ids := {r["doc_id"] for r in seen[1].collect()}) and 54 not in ids
    assert all("@" not in r["text"] and r["n_chars"] == len(r["text"]) for r in seen[3].collect())
    assert {r["doc_id"] for r in seen[4].collect()} == {r["doc_id"] for r in seen[3].collect()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[4].count()


def test_language_stage_rejects_unlearned_scripts(spark):
    r = random.Random(1)
    junk = lambda a, b: " ".join("".join(chr(r.randrange(a, b)) for _ in range(6)) for _ in range(80))
    english = "the cat sat on the mat and slept all day while the dog ran far away and ate some fish"
    rows = [(i, f"{english} {i}", "en", "s", 0) for i in range(20)] + [(50, "cat", "en", "s", 0)]
    rows += [(100 + i, junk(*s), None, "s", 0) for i, s in enumerate([(0x430, 0x450), (0x3B1, 0x3CA), (0x4E00, 0x9000)] * 20)]
    out = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert {x["doc_id"] for x in out.collect()} == {*range(20), 50}


def test_language_stage_has_one_rule_for_short_and_long_texts(spark):
    """Junk of scripts that weren't learned goes the surer the longer it is; parts of known texts stay at every length."""
    r = random.Random(2)
    english = "the cat sat on the mat and slept all day while the dog ran far away and ate some fish".split()
    lengths, many = (1, 2, 3, 5, 8, 12, 20, 40), 150
    rows = [(i, " ".join(english), "en", "s", 0) for i in range(20)]
    for n in lengths:
        for i in range(many):
            junk = "".join(chr(r.randrange(*((0x430, 0x450), (0x3B1, 0x3CA), (0x4E00, 0x9000))[i % 3])) for _ in range(n))
            rows.append((n * 1000 + i, " ".join(junk[k : k + 5] for k in range(0, n, 5)), None, "junk", 0))
        for i in range(len(english)):
            part, k = [], i
            while sum(map(len, part)) < n:
                part.append(english[k % len(english)])
                k += 1
            rows.append((100_000 + n * 1000 + i, " ".join(part), None, "right", 0))
    out = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()
    stay = {(s, n): sum(x["source"] == s and x["doc_id"] % 100_000 // 1000 == n for x in out) for s in ("junk", "right") for n in lengths}
    assert all(stay["right", n] == len(english) for n in lengths)
    assert stay["junk", 1] < many / 2 and stay["junk", 5] < many / 4 and stay["junk", 12] < many / 10 and stay["junk", 40] < many / 25


def test_stages_take_odd_rows_and_clashing_columns(spark, tmp_path):
    english = "the cat sat on the mat and slept all day while the dog ran far away and ate some fish near token = 'abcdefabcdefabcdefabcdef'"
    rows = [(i, f"{english} number {i}\nand line {i} of it\nthird {i}", "en", "s", 0) for i in range(20)]
    rows += [rows[3]] * 2 + [(None, rows[3][1], "en", None, None), (4, "the dog ran over the hill and far away to the mat of the cat", None, "s", 1), (50, None, None, None, None), (51, "", "en", "s", 0), (52, " ".join([english] * 3000), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ["kept_text", "n_lines", "lang_pred", "score", "masked", "spans", "fp", "_k", "_k2", "h", "rest", "set", "root", "a.b"]
    for c in names:
        docs = docs.withColumn(c, F.lit(c))
    columns, counts = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, "")
        assert docs.columns == columns
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        found = docs.collect()
        counts.append(len(found))
        assert all(x[c] == c for x in found for c in names)
    assert counts[0] == len(rows) - 2 and counts[3] == counts[2] <= counts[1] <= counts[0]
    texts = {x["doc_id"]: x["text"] for x in found}
    assert "<SECRET>" in texts[0] and texts[52].count("<SECRET>") == 3000
    packed = corpus_pipeline.pack(spark, docs, "").groupBy("doc_id").count().collect()
    assert {x["doc_id"] for x in packed} == set(texts)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_names():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.STAGES[-1][1] is corpus_pipeline.pack
    assert packing.CAPACITY == 4096 and langid.UNKNOWN == "und"
    with pytest.raises(KeyError):
        queries.queries()["op14"]
