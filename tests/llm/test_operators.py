"""The ten operators against brute force on small fixtures, and on the odd cases their docstrings define."""

import base64
import hashlib
import itertools
import math
import os
import pathlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

import corpus_pipeline
from tallyglass.llm import bpe, common, importance, langid, linechunks, lsh, multi_index, neardup, packing, pii, queries, simhash, suffixes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "a", None, None, 1), (4, "same text\nof two lines\n", "en", "a", 23), (5, "same text\nof two lines\n", "en", "a", 23),
    (5, "same text\nof two lines\n", "en", "a", 23), (None, "same text\nof two lines\n", "en", "a", 23), (6, "x" * 300_000, "en", "a", 300_000), (7, "word " * 40_000, "en", "a", 200_000),
    (8, "日本語のテキスト😀 naïve Straße", "ja", "b", 20), (9, "12345 !!! \x00\x1c", None, "b", 13), (6, "another text of six", "en", "a", 19), (-3, " \n\t ", "en", "a", 4),
]


def docs(spark, rows=ODD):
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """Extra columns whose names the operators use inside or give out."""
    for c in ("h", "n", "fp", "a", "b", "lang_pred", "score", "kept", "piece", "length", "v", "x"):
        df = df.withColumn(c, F.lit(c))
    return df


def texts(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 6)))
    out = []
    for _ in range(n):
        if out and r.random() < 0.4:
            w = r.choice(out).split(" ")
            for _ in range(r.randrange(3)):
                w[r.randrange(len(w))] = word()
            out.append(" ".join(w))
        else:
            out.append("".join(word() + r.choice([" ", " ", " ", "\n"]) for _ in range(r.randrange(0, 120))))
    return out


# 1

def test_resampling_prefers_the_target(spark):
    r = random.Random(1)
    make = lambda words: " ".join(r.choice(words) for _ in range(80))
    rows = [(i, make("red green blue".split() if i % 2 else "## !! $$".split()), None, None, 0) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    out = importance.resample(docs(spark, rows), labels, 0.5).collect()
    assert len(out) == 200 and sum(x["kept"] for x in out) == 100
    assert all(x["kept"] == (x["doc_id"] % 2 == 1) for x in out)


def test_resampling_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1, 0), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    out = importance.resample(clashing(docs(spark)), labels).collect()
    assert len(out) == len(ODD) and all(x["log_weight"] == 0 for x in out if x["doc_id"] in (1, 2, -3))
    assert importance.resample(docs(spark, []), labels).count() == 0


def test_models_weights_and_kept_equal_brute_force(spark):
    written = [(i, t, None, None, 0) for i, t in enumerate(texts(17, 50))]
    labels = spark.createDataFrame([(i, i % 3 % 2, int(i % 5 == 0)) for i in range(0, 50, 2)], "doc_id long, quality int, toxic int")
    good = {r[0] for r in labels.collect() if r[1] == 1 and r[2] == 0}

    def grams(text):
        words = re.findall(r"\w+|[^\w\s]+", text.lower())
        h = [xxhash.xxh64_intdigest(w, importance.SEED) for w in words]
        full = 2**64 - 1
        pairs = []
        for a, b in itertools.pairwise(h):
            x = (a * 0x9E3779B97F4A7C15 & full) ^ (b + (b << 7 & full) & full)
            pairs.append(((x ^ x >> 31) * 0x9E3779B97F4A7C15 & full) >> 20)
        return [x % importance.BUCKETS for x in h + pairs]

    raw, target, keys = {}, {}, {}
    for i, t, *_ in written:
        for g in grams(t):
            raw[g] = raw.get(g, 0) + 1
            target[g] = target.get(g, 0) + (i in good)
    share = sum(target.values()) / sum(raw.values())
    ratio = {g: math.log((target[g] + importance.SMOOTH) / (n * share + importance.SMOOTH)) for g, n in raw.items()}
    weight = {i: sum(ratio[g] for g in grams(t)) for i, t, *_ in written}
    for i in weight:
        u = (xxhash.xxh64_intdigest(i.to_bytes(8, "little"), importance.SEED) + 0.5) / 2**64
        keys[i] = weight[i] - math.log(-math.log(u))
    want = set(sorted(keys, key=lambda i: (-keys[i], i))[:20])
    out = importance.resample(docs(spark, written).repartition(3), labels, 0.4).collect()
    assert {x["doc_id"] for x in out if x["kept"]} == want
    for x in out:
        assert math.isclose(x["log_weight"], weight[x["doc_id"]], abs_tol=1e-9) and math.isclose(x["key"], keys[x["doc_id"]], abs_tol=1e-9) and x["n_grams"] == len(grams(written[x["doc_id"]][1]))


def test_resampling_takes_ids_of_text(spark):
    rows = docs(spark, [(i, t, None, None, 0) for i, t in enumerate(texts(18, 10))]).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    labels = spark.createDataFrame([("d1", 1, 0)], "doc_id string, quality int, toxic int")
    assert importance.resample(rows.withColumn("t", F.lit(1)), labels, 0.5).where("kept").count() == 5


def test_gumbel_top_k_draws_in_proportion():
    hits = np.zeros(3)
    logs = np.log([1, 2, 7])
    for seed in range(4000):
        hits[np.argmax([logs[i] + importance.gumbel(i, seed) for i in range(3)])] += 1
    assert np.allclose(hits / 4000, [0.1, 0.2, 0.7], atol=0.03)


@pytest.mark.parametrize("k", [0, 1, 17, 99, 100, 200])
def test_top_is_exact(spark, k):
    r = random.Random(k)
    rows = [(i, r.choice([0.0, -0.0, -3.5, 1e300, 5e-324, 1 + 2**-50, 1.0, -1 - 2**-50, r.gauss(0, 100)])) for i in range(100)]
    got = {x["doc_id"] for x in importance.top(spark.createDataFrame(rows, "doc_id long, key double"), k).where("kept").collect()}
    assert got == {i for i, _ in sorted(rows, key=lambda x: (-x[1], x[0]))[:k]}


# 2

def chunked(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(s.encode()).hexdigest()[:7], 16) for s in lines]
    r = [((h[i - 1] if i else 0) * 1_000_003 + h[i]) % (2**31 - 1) for i in range(len(h))]
    out, begin = [], 0
    for i in range(len(lines)):
        if i == len(lines) - 1 or (i and r[i] < r[i - 1] and r[i] <= r[i + 1]):
            out.append(lines[begin : i + 1])
            begin = i + 1
    return out


def test_line_chunks_equal_brute_force(spark):
    r = random.Random(3)
    lines = [f"line {i}" for i in range(60)]
    blocks = [[r.choice(lines) for _ in range(12)] for _ in range(4)]
    rows = []
    for i in range(40):
        parts = [r.choice(lines) for _ in range(r.randrange(6))] + r.choice(blocks) + [r.choice(lines) for _ in range(r.randrange(6))]
        rows.append((i, "\n".join(parts), None, None, 0))
    seen, want = set(), {}
    for i, t, *_ in rows:
        kept = []
        for c in chunked(t):
            again = len(c) > 1 and tuple(c) in seen
            if len(c) > 1:
                seen.add(tuple(c))
            if not again:
                kept.append("\n".join(c))
        want[i] = "\n".join(kept)
    out = linechunks.remove_repeats(docs(spark, rows)).collect()
    assert {x["doc_id"]: x["kept_text"] for x in out} == want and sum(x["n_removed"] for x in out) > 40


def test_line_chunks_odd_rows(spark):
    out = linechunks.remove_repeats(clashing(docs(spark))).select("doc_id", "text", "n_lines", "n_removed", "kept_text", "fp").collect()
    assert len(out) == len(ODD)
    by = {(x["doc_id"], x["text"]): x for x in out}
    assert by[1, None]["kept_text"] is None and by[1, None]["n_lines"] == 0
    assert by[2, ""]["kept_text"] == "" and by[2, ""]["n_removed"] == 0
    assert by[None, ODD[3][1]]["n_removed"] == 0 and by[4, ODD[3][1]]["n_removed"] == 3 and by[4, ODD[3][1]]["kept_text"] == ""
    assert by[6, ODD[7][1]]["kept_text"] == ODD[7][1]
    assert linechunks.remove_repeats(docs(spark, [])).count() == 0
    odd = docs(spark)
    for c in ("n_lines", "n_removed", "kept_text", "_k", "_d", "_c", "_chunks", "_row", "_text", "c", "s", "at", "a.b"):
        odd = odd.withColumn(c, F.lit(c))
    again = linechunks.remove_repeats(odd)
    assert again.columns == [c for c in odd.columns if c not in linechunks.NEW] + list(linechunks.NEW)
    rows = again.collect()
    assert {(x["doc_id"], x["text"], x["kept_text"]) for x in rows} == {(x["doc_id"], x["text"], x["kept_text"]) for x in out} and {x["_k"] + x["a.b"] for x in rows} == {"_ka.b"}


def test_line_chunks_run_no_python(spark):
    plan = linechunks.remove_repeats(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan.replace("LocalTableScan", "")


# 3

def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base, base[:30] + 0.05 * rng.standard_normal((30, 16)), base[:20] * 2, base[:5], base[:1] + 0.02 * rng.standard_normal((40, 16))]).astype(np.float32)
    rows = [(int(i) * 3 + 1, v.tolist(), i % 3) for i, v in enumerate(x)]
    d = x.astype(float)
    cos = d @ d.T / np.outer(np.linalg.norm(d, axis=1), np.linalg.norm(d, axis=1))
    near = cos >= 0.95
    np.fill_diagonal(near, False)
    root = common.local_roots(len(x), *np.nonzero(near))
    out = {r["vec_id"]: r for r in lsh.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), recall=0.99999).collect()}
    for i in range(len(x)):
        r = out[3 * i + 1]
        assert (r["n_links"], r["component_id"], r["kept"]) == (near[i].sum(), 3 * root[i] + 1, root[i] == i)


def test_vectors_in_blocks_count_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(lsh, "_BLOCK", 8)
    rng = np.random.default_rng(4)
    x = rng.standard_normal(8) + 0.01 * rng.standard_normal((50, 8))
    out = lsh.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), recall=0.999999).collect()
    assert all(r["n_links"] == 49 and r["component_id"] == 0 for r in out)


def test_codes_do_not_depend_on_the_matrix():
    x = lsh._unit(np.random.default_rng(5).standard_normal((4000, 64)))
    k, many = lsh.tables(10**6)
    whole = lsh.codes(x, k, many)
    assert (np.concatenate([lsh.codes(x[i : i + 7], k, many) for i in range(0, 4000, 7)]) == whole).all()
    assert all((lsh.codes(lsh._unit(x[i : i + 1]), k, many) == lsh.codes(lsh._unit(x), k, many)[i]).all() for i in range(0, 4000, 401))


def test_vectors_right_above_the_threshold_meet(spark):
    """Pairs planted at cosine 0.951, at the default recall."""
    rng = np.random.default_rng(6)
    a = lsh._unit(rng.standard_normal((1000, 64)))
    b = rng.standard_normal((1000, 64))
    b = lsh._unit(b - (b * a).sum(1, keepdims=True) * a)
    x = np.concatenate([a, 0.951 * a + np.sqrt(1 - 0.951**2) * b])
    out = lsh.near_duplicates(clashing(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))).collect()
    assert len(out) == 2000 and {r["n_links"] for r in out} <= {0, 1}
    assert sum(r["n_links"] for r in out) / 2000 >= 0.98


def test_vectors_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [-1.0, 0.0])]
    out = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in lsh.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert out == sorted([(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 9, 10)] + [(7, 3, 7, True), (8, 3, 7, False), (8, 3, 7, False), (0, 3, 7, False)])
    assert lsh.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# 4

def spans_by_force(rows):
    seen, out = set(), {}
    for i, t in rows:
        data = (t or "").encode()
        hit = bytearray(len(data))
        for s in range(len(data) - 99):
            w = data[s : s + 100]
            if w in seen:
                hit[s : s + 100] = b"\1" * 100
            seen.add(w)
        left = bytes(b for b, c in zip(data, hit, strict=True) if not c)
        out[i] = (len(data), len(data) - len(left), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("block", [suffixes._BLOCK, 40, 7, 2])
def test_repeated_strings_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(suffixes, "_BLOCK", block)
    r = random.Random(4)
    passages = ["".join(r.choice("abcde é") for _ in range(r.randrange(60, 400))) for _ in range(5)]
    rows = []
    for i in range(30):
        t = "".join(r.choice([r.choice(passages), r.choice(passages)[r.randrange(50) :], "".join(r.choice("abcdefg ") for _ in range(r.randrange(90)))]) for _ in range(r.randrange(5)))
        rows.append((i, t))
    rows += [(30, "ab" * 700), (31, "a" * 500), (32, None), (33, rows[3][1])]
    common_part, scrap = "".join(r.choice("xyz") for _ in range(70)), lambda n: "".join(r.choice("pq") for _ in range(n))
    rows += [(40 + i, scrap(80) + common_part[:32] + scrap(80)) for i in range(40)]  # one hot string, surroundings that differ
    rows += [(90 + i, scrap(3) + common_part + passages[i % 3][:29] + scrap(r.randrange(20))) for i in range(40)]
    out = suffixes.remove_repeats(docs(spark, [(i, t, None, None, 0) for i, t in rows])).collect()
    assert {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in out} == spans_by_force(rows)


def test_repeated_strings_odd_rows(spark):
    out = suffixes.remove_repeats(clashing(docs(spark)), with_kept=True).collect()
    assert len(out) == len(ODD)
    by = {(x["doc_id"], x["n_bytes"]): x for x in out}
    assert by[1, 0]["n_removed"] == 0 and by[6, 300_000]["n_removed"] == 300_000 - 1 and by[6, 300_000]["n_spans"] == 1
    assert bytes(by[7, 200_000]["kept"]) == b"word "
    assert suffixes.remove_repeats(docs(spark, [])).count() == 0


def test_repeated_rows_are_one_document(spark):
    r = random.Random(5)
    t = "".join(r.choice("abcdefgh ") for _ in range(400))
    rows = [(3, t, None, None, 0)] * 3 + [(4, t, None, None, 0)] * 2 + [(None, "x" + t[:200], None, None, 0)] * 2
    out = suffixes.remove_repeats(docs(spark, rows).repartition(5)).collect()
    assert sorted((x["doc_id"] or 0, x["n_removed"]) for x in out) == [(0, 0), (0, 0), (3, 200), (3, 200), (3, 200), (4, 400), (4, 400)]


def test_suffix_sort_survives_hash_collisions(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (40, 12)).astype(np.uint8)
    size, group = np.full(40, 12), np.repeat([0, 1], 20)
    monkeypatch.setattr(suffixes, "_BASE", 0)  # every hash is that of one byte
    order, lcp = suffixes.suffix_sort(x, size, group)
    for g in (0, 1):
        part = [bytes(x[i]) for i in order[20 * g : 20 * g + 20]]
        assert part == sorted(part)
        assert [lcp[20 * g + i] for i in range(1, 20)] == [next((k for k in range(12) if a[k] != b[k]), 12) for a, b in itertools.pairwise(part)]


# 5

def nearest_by_force(ids, x, q, own, k=20):
    def product(v):
        total = 0.0
        for a, b in zip(v, q, strict=True):  # sum() would compensate for rounding
            total += a * b
        return total

    s = [(-product(v), i) for i, v in zip(ids, x, strict=True) if i != own]
    return [(i, -v) for v, i in sorted(s)[:k]]


@pytest.mark.parametrize("shard, cell", [(multi_index._SHARD, multi_index.CELL), (40, 2)])
def test_search_without_a_margin_is_exact(spark, monkeypatch, shard, cell):
    monkeypatch.setattr(multi_index, "_SHARD", shard)
    monkeypatch.setattr(multi_index, "CELL", cell)
    monkeypatch.setattr(multi_index, "FIRST", 30)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 8)).astype(np.float32)
    x[40:300] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    out = multi_index.search(df, df.where("vec_id % 20 = 0"), margin=None).collect()
    assert len(out) == 30 * 20
    for q in range(0, 600, 20):
        got = [(r["vec_id"], r["score"]) for r in sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])]
        assert got == nearest_by_force(range(600), x.astype(float).tolist(), x[q].astype(float).tolist(), q)


def vectors_of(kind, rng, n=3000):
    x = rng.standard_normal((n, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "uneven":
        return x * np.exp(0.7 * rng.standard_normal((n, 1)))
    if kind == "hot":
        x[: n // 3] = x[0]
    if kind == "clustered":
        return x[rng.integers(0, 100, n)] + 0.05 * rng.standard_normal((n, 32))
    return x


@pytest.mark.parametrize("kind", ["plain", "uneven", "hot", "clustered"])
def test_search_recall(spark, monkeypatch, kind):
    """By score, as equal vectors may stand for each other."""
    monkeypatch.setattr(multi_index, "_SHARD", 700)
    x = vectors_of(kind, np.random.default_rng(6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = multi_index.search(df, df.where("vec_id % 20 = 0")).groupBy("query_id").agg(F.collect_list("score").alias("s")).collect()
    hits = 0
    for r in out:
        scores = np.delete(x @ x[r["query_id"]], r["query_id"])
        hits += sum(s >= np.sort(scores)[-20] - 1e-9 for s in r["s"])
    assert len(out) == 150 and hits / (150 * 20) >= 0.9


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_registered_search_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    got = {}
    for r in queries.queries()["op5_inverted_multi_index"](spark, sf).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hits = sum(len(found & {i for i, _ in nearest_by_force(ids.tolist(), x.tolist(), x[ids == q][0].tolist(), q)}) for q, found in got.items())
    assert hits / (20 * len(got)) >= 0.9


def test_search_reads_a_small_share_of_clusters():
    x = vectors_of("clustered", np.random.default_rng(8), 20_000)
    index = multi_index.Index.fit(x[:5000], 32, len(x), multi_index.CENTROIDS)
    cells, far = index.place(x)
    found, at = np.unique(cells, return_inverse=True)
    sums = [np.stack([np.bincount(at, weights=w[:, h]) for h in (0, 1)], axis=1) for w in (far, far**2)]
    index.settle(found, np.bincount(at), *sums, sums[0], multi_index.MARGIN, 0)
    read = []
    for q in x[:200:10]:
        first = np.isin(cells, index.walk(q[None], np.array([np.inf]))[0])
        best = np.sort((x @ q)[first])[-20]
        read.append(np.isin(cells, index.walk(q[None], np.array([best]))[0]).mean())
    assert np.mean(read) < 0.1


def test_traversal_falls():
    rng = np.random.default_rng(7)
    a, b = rng.standard_normal(9), rng.standard_normal(7)
    sum_of = lambda c: a[c // 7] + b[c % 7]
    cells = multi_index.traverse(a, b, [1] * 63, 63, np.inf)
    assert sorted(cells) == list(range(63)) and [sum_of(c) for c in cells] == sorted(map(sum_of, range(63)), reverse=True)
    assert multi_index.traverse(a, b, [1] * 63, 5, 0.3) == [c for i, c in enumerate(cells) if i < 5 or sum_of(c) >= 0.3]
    assert multi_index.traverse(a, b, [0] * 63, 5, 0.0) == []


def test_search_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [0.0, 0.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (20, [0.5, 0.0]), (6, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = [tuple(r) for r in multi_index.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert out == [(0, 1, 1, 1.0), (0, 2, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5)]
    out = [tuple(r) for r in multi_index.search(clashing(df), df.where("vec_id = 6"), k=2).collect()]
    assert out == []  # the only vector of its length
    two = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [2.0, 2.0, 2.0]), (4, [1.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    out = sorted(tuple(r) for r in multi_index.search(two, two).collect())
    assert out == [(1, 1, 2, 1.0), (1, 1, 2, 1.0), (2, 1, 1, 1.0), (2, 2, 1, 1.0), (3, 1, 4, 2.0), (4, 1, 3, 2.0)]
    none = spark.createDataFrame([], df.schema)
    assert multi_index.search(none, none).count() == 0


# 6

def test_word_ids_equal_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    mine = packing.WordTokenizer(path)
    r = random.Random(6)
    for t in [*texts(1, 20), *(x[1] or "" for x in ODD if len(x[1] or "") < 1000), *("".join(r.choice("aAbe.,.,' !_-1é́ \x1c\n\tßÄİΣ日😀</w>") for _ in range(r.randrange(15))) for _ in range(2000))]:
        w = mine.words(t)
        mine.learn([w])
        assert np.frombuffer(b"".join(mine.memo[x] for x in w), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_small_latin_words_need_no_normaliser():
    mine = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(9)
    letters = [c for c in map(chr, range(0x61, 0x250)) if c.islower() and c.isalpha() and not packing._BEYOND.search(c)]
    words = [*letters, *("".join(r.choice(letters[:26] * 9 + letters) for _ in range(r.randrange(1, 30))) for _ in range(3000)), "\u0131", "ab" * 49 + "c"]
    whole = mine.library
    mine.library = Tokenizer(models.BPE())  # gives no ids
    mine.learn([words])
    assert [np.frombuffer(mine.memo[w], "<u4").tolist() for w in words] == [e.ids for e in whole.encode_batch(words, add_special_tokens=False)]


def test_latin_texts_are_cut_as_the_tokenizer_cuts():
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole.encode_special_tokens = True
    mine = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(10)
    parts = [*map(chr, [*range(9, 14), *range(32, 127), *range(0xC0, 0x250)]), *"''''''''....,,,,    ", *("s", "t", "re", "VE", "m", "LL", "d"), "<|endoftext|>", "</w>", "word", "Two"]
    for t in [*parts, *("".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(5000))]:
        w = mine.words(t)
        mine.learn([w])
        assert np.frombuffer(b"".join(mine.memo[x] for x in w), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)
    assert mine.words("Erndnton&&&, it'S 12") == ["erndnton", "&&&,", "it", "'s", "1", "2"]


def test_fullest_equals_brute_force():
    r = random.Random(7)
    for _ in range(200):
        counts = {r.randrange(1, 30): r.randrange(1, 4) for _ in range(5)}
        room = r.randrange(0, 60)
        use = packing.fullest(sorted(counts, reverse=True), counts, room)
        best = max(s for c in itertools.product(*[range(n + 1) for n in counts.values()]) if (s := sum(k * n for k, n in zip(c, counts, strict=True))) <= room)
        assert sum(n * k for n, k in use.items()) == best and all(k <= counts[n] for n, k in use.items())


@pytest.mark.parametrize("ranked", [packing._RANKED, 3])
def test_packing_is_whole_gapless_and_full(spark, monkeypatch, ranked):
    monkeypatch.setattr(packing, "_RANKED", ranked)
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [*ODD, *((100 + i, t, None, None, 0) for i, t in enumerate(texts(8, 80)))]
    out = packing.pack_documents(clashing(docs(spark, rows)), path, capacity=300).collect()
    library = Tokenizer.from_file(path)
    want = {}
    for i, t, *_ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 300)):
            want.setdefault((i, k, s, len(ids[s : s + 300]), zlib.crc32(np.array(ids[s : s + 300], "<u4").tobytes())), []).append(1)
    got = {}
    for x in out:
        got.setdefault((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]), []).append(1)
    assert got == want
    bins = {}
    for x in out:
        bins.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(p + n == q for (p, n), (q, _) in itertools.pairwise(b)) and sum(n for _, n in b) <= 300
    first_fit: list[int] = []
    for n in sorted((x["length"] for x in out), reverse=True):
        i = next((i for i, room in enumerate(first_fit) if room >= n), None)
        if i is None:
            first_fit.append(300 - n)
        else:
            first_fit[i] -= n
    assert len(bins) <= 1.01 * len(first_fit) + 1


def test_packing_nothing(spark):
    assert packing.pack_documents(docs(spark, []), public_tokenizers.path("word_bpe_49k.json")).count() == 0


# 7

def test_codec_equals_the_library():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine, r = bpe.codec(path, public_tokenizers.PATTERN), random.Random(9)
    for t in [*texts(2, 20), *(x[1] or "" for x in ODD if len(x[1] or "") < 1000), "a" * 3000, *("".join(r.choice("aabcdehinorst ETAÄß日😀\x00\n\t019.-$#'") for _ in range(r.randrange(30))) for _ in range(4000))]:
        ids = mine.encode(t)
        assert ids == library.encode_ordinary(t) and mine.decode(ids) == t.encode()


def test_long_pieces_take_linear_time():
    c, r = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), random.Random(10)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(160_000))

    def took(n):
        began = time.process_time()
        c.encode(text[:n])
        return time.process_time() - began

    took(20_000)
    assert min(took(160_000) for _ in range(2)) <= 16 * min(took(20_000) for _ in range(3))  # about 8; quadratic would be 64


def test_encode_decode_odd_rows(spark):
    out = bpe.encode_decode(clashing(docs(spark)), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True).collect()
    assert sorted(x["decoded_sha256"] for x in out) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in ODD)
    for x in out:
        assert x["n_tokens"] == len(x["ids"]) and x["ids_sha256"] == hashlib.sha256(" ".join(map(str, x["ids"])).encode()).hexdigest()
    assert bpe.encode_decode(docs(spark, []), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


# 8

def print_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups_equal_brute_force(spark):
    rows = [*((i, t, None, None, 0) for i, t in enumerate(texts(10, 200), 10)), *(x for x in ODD if len(x[1] or "") < 1000)]
    prints = [print_of(t) for _, t, *_ in rows]
    near = np.bitwise_count(np.array(prints, np.uint64)[:, None] ^ np.array(prints, np.uint64)) <= 4
    root = common.local_roots(len(rows), *np.nonzero(near))
    want = {}
    for k, r in enumerate(root):
        want[k] = min((rows[i][0] for i in np.flatnonzero(root == r) if rows[i][0] is not None), default=None)
    out = simhash.groups(clashing(docs(spark, rows))).collect()
    key = lambda rows: sorted(rows, key=str)
    assert key((x["doc_id"], x["fp"] % 2**64, x["component_id"]) for x in out) == key((rows[k][0], prints[k], want[k]) for k in range(len(rows)))


@pytest.mark.parametrize("n, block", [(10**3, 16_384), (10**9, 16_384), (10**3, 5)])
def test_trie_links_find_all_pairs(spark, monkeypatch, n, block):
    monkeypatch.setattr(simhash, "_BLOCK", block)
    r = random.Random(11)
    base = [r.getrandbits(64) for _ in range(100)] + [0, 1, 3, 7, 15, 31, 2**64 - 1]
    keys = list({*base, *(b ^ sum(1 << r.randrange(64) for _ in range(r.randrange(6))) & (2**64 - 1) for b in base * 3)})
    near = np.bitwise_count(np.array(keys, np.uint64)[:, None] ^ np.array(keys, np.uint64)) <= 4
    root = common.local_roots(len(keys), *np.nonzero(near))
    signed = np.array(keys, np.uint64).view(np.int64).tolist()
    found = common.components(simhash.links(spark.createDataFrame([(k,) for k in signed], "fp long"), n), "test").collect()
    place, up = {k: i for i, k in enumerate(signed)}, {x["node"]: x["root"] for x in found}
    mine = [place[up.get(k, k)] for k in signed]
    assert len({(a, b) for a, b in zip(mine, root.tolist(), strict=True)}) == len(set(root.tolist())) == len(set(mine))


def test_deduplicate_keeps_one(spark):
    rows = [(4, "a b c d e", None, None, 0), (2, "a b c d e", None, None, 0), (2, "a b c d e", None, None, 0), (None, "a b c d e", None, None, 0), (None, "q r s t", None, None, 0), (None, "q r s t", None, None, 0), (7, None, None, None, 0), (8, "", None, None, 0), (9, "quite another text here", None, None, 0)]
    out = simhash.deduplicate(docs(spark, rows))
    assert out.columns == docs(spark, []).columns
    assert sorted((x["doc_id"] or 0, x["text"]) for x in out.collect()) == [(0, "q r s t"), (2, "a b c d e"), (7, None), (9, "quite another text here")]
    assert simhash.deduplicate(docs(spark, [])).count() == 0


def planted(seed, n=60):
    """Texts of 120 words, each with a copy that has words replaced; and of each pair its Jaccard similarity."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, alike = [], {}
    for i in range(n):
        a = [word() for _ in range(120)]
        b = list(a)
        for _ in range(r.randrange(1, 6)):
            b[r.randrange(len(b))] = word()
        x, y = grams(a), grams(b)
        alike[i] = len(x & y) / len(x | y)
        rows += [(i, " ".join(a), None, None, 0), (i + 1000, " ".join(b), None, None, 0)]
    return rows, alike


@pytest.mark.parametrize("small", [neardup._SMALL, 1])
def test_near_dedup_stage_removes_planted_near_copies(spark, monkeypatch, small):
    monkeypatch.setattr(neardup, "_SMALL", small)
    rows, alike = planted(20)
    rows += [(2000 + i, rows[0][1] + f" tail{i}", None, None, 0) for i in range(40)] + [(3000, None, None, None, 0), (3001, " ", None, None, 0), (3002, "one two", None, None, 0)]
    out = {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, docs(spark, rows), "").collect()}
    assert {i for i in alike if i + 1000 not in out} == {i for i, s in alike.items() if s >= 0.8}
    assert sum(0.8 <= s < 0.95 for s in alike.values()) > 10 and sum(0.6 < s < 0.8 for s in alike.values()) > 10
    assert out - set(range(2000)) == {3000, 3002} and set(range(60)) <= out


def test_near_dedup_stage_joins_pairs_that_no_band_shares(spark):
    r = random.Random(31)
    rows = []
    for i in range(6000):
        a = [f"{r.randrange(10**6)}" for _ in range(94)]
        b = [*a[:43], "x", *a[44:49], "y", *a[50:]]  # 90 shingles, 80 of them shared: 0.8
        x, y = (neardup.distinct_shingles(" ".join(t)) for t in (a, b))
        bands = [(neardup.minhashes(z) * (neardup._DRAWN[2] | np.uint64(1))).reshape(neardup.BANDS, -1).sum(1, dtype=np.uint64) for z in (x, y)]
        if not (bands[0] == bands[1]).any() and (simhash.majority([x]) ^ simhash.majority([y])).bit_count() > simhash.BUDGET:
            rows += [(i, " ".join(a), None, None, 0), (i + 10_000, " ".join(b), None, None, 0)]
    assert len(rows) >= 4
    out = {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, docs(spark, rows), "").collect()}
    assert out == {x[0] for x in rows if x[0] < 10_000}


@pytest.mark.parametrize("small, block, often", [(neardup._SMALL, neardup._BLOCK, neardup._OFTEN), (1, neardup._BLOCK, 10**9), (1, 5, 2)])
def test_near_dedup_equals_brute_force(spark, monkeypatch, small, block, often):
    for name, value in (("_SMALL", small), ("_BLOCK", block), ("_OFTEN", often)):
        monkeypatch.setattr(neardup, name, value)
    r = random.Random(32)
    rows, cores = [], [[r.choice("abcdefgh") * r.randrange(1, 9) for _ in range(90)] for _ in range(3)]
    for i in range(240):  # families around one core, at similarities on both sides of 0.8
        w = list(cores[i % 3])
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = r.choice("stuvw") * r.randrange(1, 9)
        rows.append((i, " ".join(w[: r.randrange(60, 91)]), None, None, 0))
    rows += [(1000 + i, " ".join("pqrst"[: 1 + i % 5] * (1 + i % 4)), None, None, 0) for i in range(20)]
    held = [set(neardup.distinct_shingles(t).tolist()) for _, t, *_ in rows]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (same := len(held[i] & held[j])) * 10 >= 8 * (len(held[i]) + len(held[j]) - same)]
    root = common.local_roots(len(rows), *np.array(pairs).T)
    out = {x["doc_id"] for x in neardup.deduplicate(docs(spark, rows)).collect()}
    assert out == {rows[i][0] for i in np.flatnonzero(root == np.arange(len(rows)))}


def test_near_dedup_exchanges_what_may_be_alike(spark, monkeypatch):
    rows, alike = planted(33)
    rows += [(5000 + i, f"{rows[2 * i][1]} " + " ".join(f"w{i}x{j}" for j in range(400)), None, None, 0) for i in range(20)]
    rows += [(6000 + i, rows[0][1] + f" tail{i}", None, None, 0) for i in range(30)]
    keyed = docs(spark, rows).withColumn("_k", F.xxhash64("doc_id", "text")).withColumn("_k2", F.xxhash64("text", "doc_id"))
    nodes = neardup.sketches(keyed, neardup.WORDS, ("doc_id", "_k", "_k2"), 0.8).cache()
    sets = {x["doc_id"]: x["set"] for x in nodes.collect()}
    none = spark.createDataFrame([], "node long, root long")
    found = [x for part in range(3) for x in neardup.shared_places(nodes, none, 0.8, 3, part).collect()]
    held = {}
    for x in found:
        held.setdefault(x["w"], set()).add(x["set"])
    assert all(x["_n"] >= len(held[x["w"]]) > 1 for x in found)
    met = lambda a, b: any(sets[a] in h and sets[b] in h for h in held.values())
    assert all(met(i, i + 1000) for i, s in alike.items() if s >= 0.8) and sum(s >= 0.8 for s in alike.values()) > 20
    assert not {sets[5000 + i] for i in range(20)} & {x["set"] for x in found}  # share shingles, but are of another size
    some = keyed.where("doc_id % 10 = 3").select("_k", "_k2")
    assert {x["doc_id"] for x in neardup.among(keyed, some).collect()} == {x[0] for x in rows if x[0] % 10 == 3}

    one = {x["doc_id"] for x in neardup.deduplicate(docs(spark, rows)).collect()}
    monkeypatch.setattr(neardup, "_PLACES", 100)
    held = {}  # the tables that lie there when another is made
    folder = pathlib.Path(common.shared_dir(spark).removeprefix("file:"), "tallyglass")
    before = set(folder.glob("*"))
    there = lambda: {x.name.rsplit("-", 1)[0] for x in set(folder.glob("*")) - before}

    def made(df, label):
        held.setdefault(label, []).append(there())
        return common.materialize(df, label)

    monkeypatch.setattr(neardup, "materialize", made)
    out = neardup.deduplicate(docs(spark, rows))
    assert there() == {"neardup-stay"}
    assert {x["doc_id"] for x in out.collect()} == one == {x[0] for x in rows if x[0] < 1000 or 5000 <= x[0] < 6000} | {i + 1000 for i, s in alike.items() if s < 0.8}
    assert len(held["neardup-shared"]) == neardup._PARTS
    assert set.union(*held["neardup-shared"]) == {"neardup-sets", "neardup-members", "neardup-links", "neardup-met"}


def test_near_dedup_odd_rows(spark):
    rows = [(4, "a b c d e", None, None, 0), (2, "A b c d e", None, None, 0), (2, "a b c d e", None, None, 0), (2, "a b c d e", None, None, 0), (None, "a b c d e", None, None, 0), (None, "q r s t", None, None, 0), (None, "q r s t", None, None, 0)]
    out = neardup.deduplicate(docs(spark, rows))
    assert out.columns == docs(spark, []).columns
    assert sorted((x["doc_id"] or 0, x["text"].lower()) for x in out.collect()) == [(0, "q r s t"), (2, "a b c d e")]
    assert neardup.deduplicate(docs(spark, [])).count() == 0


# 9

def test_language_id_held_out(spark):
    r = random.Random(12)
    parts = {"aa": "ka lo mi tu".split(), "bb": "sch ung eit ver".split(), "cc": "ción que los ñe".split()}
    rows = [(i, " ".join("".join(r.choice(parts[lang]) for _ in range(2)) for _ in range(20)), lang, "s", 0) for i in range(300) for lang in [sorted(parts)[i % 3]]]
    out = langid.identify(docs(spark, rows))
    right = out.where(langid.held_out()).select((F.col("lang") == F.col("lang_pred")).alias("ok")).collect()
    assert len(right) > 40 and sum(x["ok"] for x in right) / len(right) > 0.98
    assert {zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2 for x in out.where(langid.held_out()).collect()} == {True}


def test_language_id_odd_rows(spark):
    out = langid.identify(clashing(docs(spark))).collect()
    assert len(out) == len(ODD)
    for x in out:
        assert 0 <= x["score"] <= 1
        assert (x["lang_pred"] == "und") == (not any(c.isalpha() for c in x["text"] or ""))
    assert {x["lang_pred"] for x in langid.identify(docs(spark, [(1, "text", None, None, 0)])).collect()} == {"und"}
    assert langid.identify(docs(spark, [])).count() == 0


@pytest.mark.parametrize("together", [langid.TOGETHER, 1])
def test_predictions_equal_brute_force(spark, monkeypatch, together):
    monkeypatch.setattr(langid, "TOGETHER", together)
    letters = langid.Encoder()
    vector = lambda c: letters._random(ord(c) if c.isalpha() else 0).astype(np.int64)

    def bundle(text):
        t = re.sub(r" +", " ", "".join(c if c.isalpha() else " " for c in f" {text.lower()} "))
        return sum((np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c) for a, b, c in zip(t, t[1:], t[2:], strict=False)), np.zeros(langid.DIM, dtype=np.int64))

    r = random.Random(19)
    words = {"aa": "kalo mitu".split(), "bb": "sch Ung, eit".split(), "cc": "ción que ñe".split()}
    rows = [(i, " ".join(r.choice(words[x]) for _ in range(8)), x, "s", 0) for i in range(30) for x in [sorted(words)[i % 3]]] + [(40, "Ünlike 12", "bb", "s", 0), (41, None, "aa", "s", 0), (42, "12 !", None, "s", 0), (43, "sch", None, "s", 0)]
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    known = {x: sum((bundle(t) for i, t, y, *_ in rows if y == x and t and i not in held), np.zeros(langid.DIM, dtype=np.int64)).astype(float) for x in words}
    got = {x["doc_id"]: x for x in langid.identify(docs(spark, rows).repartition(3)).collect()}
    for i, t, *_ in rows:
        if not t or not any(c.isalpha() for c in t):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        b = bundle(t).astype(float)
        cos = {x: float(b @ v / np.linalg.norm(b) / np.linalg.norm(v)) for x, v in known.items()}
        best = max(sorted(cos), key=cos.get)
        assert got[i]["lang_pred"] == best and math.isclose(got[i]["score"], max(0.0, cos[best]), abs_tol=1e-9)


def test_bundles_are_sums_of_trigrams():
    e = langid.Encoder(64)
    got = e.bundle(["ab c"], np.array([0]), 1)[0]
    v = {c: e.vectors[e.letter[ord(c)]] for c in "abc"} | {" ": e.vectors[0]}
    want = sum(np.roll(v[x], 2) * np.roll(v[y], 1) * v[z] for x, y, z in (" ab", "ab ", "b c", " c "))
    assert np.array_equal(got, want)


# 10

BASE = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(x) <= 255 for x in s.split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 13 <= len(re.sub(r"\D", "", s)) <= 19 and luhn(re.sub(r"\D", "", s))),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 9 <= len(re.sub(r"\D", "", s)) <= 15),
}


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def test_base_spans_equal_patterns():
    r = random.Random(13)
    for _ in range(20_000):
        t = "".join(r.choice("aB1234567890.. --@@+()_%é\n0") for _ in range(r.randrange(45)))
        want = [(k, *m.span()) for k, (rx, ok) in BASE.items() for m in rx.finditer(t) if ok(m[0])]
        assert pii.base_spans(t) == want, repr(t)


def test_field_finds_what_patterns_miss():
    field = pii.train()
    t = 'reheat token = "00112233445566778899aabbccddeeff00112233" was, call (555) 765-4321 or see 4785380592391138 in 1999, version 2.0, at 10.0.0.1 and a.b@c.example.com'
    base, spans = pii.find(field, [t])[0]
    kinds = {(k, t[a:b]) for k, a, b in spans}
    assert {("secret", "00112233445566778899aabbccddeeff00112233"), ("ip", "10.0.0.1"), ("email", "a.b@c.example.com")} <= kinds and set(base) <= set(spans)
    assert ("phone", "(555) 765-4321") in kinds and ("number", "4785380592391138") in kinds
    assert pii.find(field, ["Plain words, of 1984 and 3 or 4.5, stay."])[0] == ([], [])
    held = ('my token = "ffeeddccbbaa99887766554433221100ffeeddcc" here', "the number 1234567812345678 is it", "phone (123) 456-7890 now")
    assert [s[0][0] for _, s in pii.find(field, list(held))] == ["secret", "number", "phone"]


def walked(field, numbers):
    """Labels of one row by a plain walk over the whole of it."""
    emit = lambda t: sum(field.emit_whole[p][numbers[t + place] if 0 <= t + place < len(numbers) else 0] for p, place in enumerate(field.places)).astype(np.int64)
    best, back = field.move_whole[-1] + emit(0), []
    for t in range(1, len(numbers)):
        through = best[:, None] + field.move_whole[:-1]
        back.append(through.argmax(0))
        best = through.max(0) + emit(t)
    out = [int(best.argmax())]
    for step in reversed(back):
        out.append(int(step[out[-1]]))
    return out[::-1]


PERSONAL = (
    'the token = "4f1c9ab07de2468013579bdf2468ace013579bdf" and go', "password = 'correcthorsebattery' or", "secret=abcdefabcdefabcdefabcdef is", "call (555) 123-4567 now",
    "account 0329408264589781 of them", "and plain words, with 1999 numbers", "token:\n\nf00ba4f00ba4f00ba4f00ba4f00ba4f00ba4dead", "Dr. Anna Miller came",
)


@pytest.mark.parametrize("lane", [1, 2, 5, pii._LANE])
@pytest.mark.parametrize("together", [1, 40, pii._TOGETHER])
def test_decoding_equals_a_walk_over_whole_texts(monkeypatch, lane, together):
    monkeypatch.setattr(pii, "_LANE", lane)
    monkeypatch.setattr(pii, "_TOGETHER", together)
    monkeypatch.setattr(pii, "_STRETCH", 37)
    field, r = pii.train(), random.Random(16)
    rows = ["", *PERSONAL, *(" ".join(r.choice(PERSONAL) for _ in range(r.randrange(1, 8))) for _ in range(12))]
    numbers = [field.read(t) for t in rows]
    assert [len(n) for n in numbers] == [len(pii._TOKEN.findall(t)) for t in rows]
    got = field.decode(numbers)
    assert [g.tolist() for g in got] == [walked(field, n.tolist()) if len(n) else [] for n in numbers]
    assert sum(int(g.any()) for g in got) > 12
    assert field.decode([]) == [] and field.decode([numbers[0]])[0].size == 0


def test_walk_equals_every_labelling():
    field = pii.train()
    for text in ("token = ab12cd", "a 1", "Dr. Lee"):
        numbers = field.read(text).tolist()
        n = len(numbers)
        emit = [sum(field.emit_whole[p][numbers[t + q] if 0 <= t + q < n else 0] for p, q in enumerate(field.places)).astype(np.int64) for t in range(n)]
        score = lambda y: emit[0][y[0]] + field.move_whole[-1, y[0]] + sum(emit[t][y[t]] + int(field.move_whole[y[t - 1], y[t]]) for t in range(1, n))  # noqa: B023, E731
        best = max(map(score, itertools.product(range(len(pii.LABELS)), repeat=n)))
        assert score(walked(field, numbers)) == best == score(field.decode([np.array(numbers)])[0].tolist())


def test_field_needs_no_digit_and_crosses_lines():
    found = [[(k, t[a:b]) for k, a, b in pii.find(pii.train(), [t])[0][1]] for t in PERSONAL]
    assert found[1] == [("secret", "correcthorsebattery")] and found[2] == [("secret", "abcdefabcdefabcdefabcdef")]
    assert found[5] == [] and found[6] == [("secret", "f00ba4f00ba4f00ba4f00ba4f00ba4f00ba4dead")] and found[7] == [("name", "Anna Miller")]
    assert [s[0][0] for _, s in pii.find(pii.train(), ["api_key: QWERTYUIOPASDFGHJKL"])] == ["secret"]


def test_detect_equals_patterns_and_walk(spark):
    rows = [*ODD, *((100 + i, t, None, None, 0) for i, t in enumerate(PERSONAL)), (200, "a@b.co 10.0.0.1 4111 1111 1111 1111 +1 (017) 555-7713 " * 3, None, None, 0)]
    field, want = pii.train(), []
    for i, t, *_ in rows:
        t = t or ""
        base = [(k, *m.span()) for k, (rx, ok) in BASE.items() for m in rx.finditer(t) if ok(m[0])] if len(t) < 1000 else []
        tokens = [m.span() for m in re.finditer(pii._TOKEN, t)]
        names = [pii.LABELS[y] for y in walked(field, field.read(t).tolist())] if tokens else []
        spans = list(base)
        for k, name in enumerate(names):
            if name[0] == "B":
                end = next((j for j in range(k + 1, len(names)) if names[j][0] != "I"), len(names))
                a, b = tokens[k][0], tokens[end - 1][1]
                if not any(a < y and x < b for _, x, y in base):
                    spans.append((name[2:], a, b))
        write = lambda s: ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        spans = sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        want.append((i, *(sum(k == s[0] for s in base) for k in BASE), hashlib.sha256(write(base).encode()).hexdigest(), write(spans)))
    got = [tuple(x) for x in pii.detect(clashing(docs(spark, rows))).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(bool(x[-1]) for x in got) > 7


def test_detect_odd_rows(spark):
    rows = [*ODD, (20, "+1 (017) 555-7713, 4111111111111111 4111 1111 1111 1111 x@y.zz 1.2.3.4.5.6.7.8", "en", "a", 1), (21, "1" * 100_000, "en", "a", 1), (22, "😀 a@b.co", "en", "a", 1)]
    out = {(x["doc_id"], x["source"]): x for x in pii.detect(clashing(docs(spark, rows)), keep=("doc_id", "source"), mask=True).collect()}
    x = out[20, "a"]
    assert (x["n_email"], x["n_ip"], x["n_card"], x["n_phone"]) == (1, 2, 0, 1) and x["masked"].count("<IP>") == 2
    assert out[22, "a"]["spans"] == "email:2:8" and out[1, "a"]["masked"] is None and out[1, "a"]["spans"] == ""
    assert out[1, "a"]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.detect(docs(spark, [])).count() == 0


# shared

def test_components_of_chains(spark):
    r = random.Random(14)
    nodes = list(range(120))
    r.shuffle(nodes)
    edges = [*zip(nodes[:60], nodes[1:61], strict=True), *((nodes[70], x) for x in nodes[71:110]), (5, 5)]
    root = common.local_roots(120, *map(np.array, zip(*edges, strict=True)))
    got = {x["node"]: x["root"] for x in common.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert all(got.get(i, i) == root[i] for i in range(120))


def test_whole_groups(spark):
    import pyarrow as pa

    keys = sorted(random.Random(15).choices(range(30), k=500))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 17])], ["k"]) for i in range(0, 500, 17)]
    out = [t["k"].to_pylist() for t in common.whole_groups(iter(batches), ["k"], 40)]
    assert sum(out, []) == keys and all(a[-1] < b[0] for a, b in itertools.pairwise(out))


def test_long_texts_that_share_a_passage_exchange_no_shingles(spark, monkeypatch):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    passage = [word() for _ in range(600)]
    texts = [" ".join([*passage, *(word() for _ in range(2600))]) for _ in range(6)]
    near = texts[0].split()
    near[-1] = "changed"
    keyed = docs(spark, [(i, t, None, None, 0) for i, t in enumerate([*texts, " ".join(near)])]).withColumn("_k", F.xxhash64("doc_id", "text")).withColumn("_k2", F.xxhash64("text", "doc_id"))
    nodes = neardup.sketches(keyed, neardup.WORDS, ("doc_id", "_k", "_k2"), 0.8).cache()
    at = {x["doc_id"]: x["set"] for x in nodes.collect()}
    every = spark.createDataFrame([(at[i], at[j]) for i in at for j in at if i < j], "a long, b long")
    many, real = {}, neardup.materialize

    def made(df, label):
        out = real(df, label)
        many[label] = out.count()
        return out

    monkeypatch.setattr(neardup, "materialize", made)
    found = neardup.links(keyed, nodes, every, neardup.WORDS, 0.8).collect()
    assert {frozenset(x) for x in found} == {frozenset((at[0], at[6]))}
    assert many["neardup-shingles"] == 2


def test_parity_maps_never_differ_in_more_bits_than_sets(spark):
    g = np.random.default_rng(5)
    for n in (1, 900, 1024, 1025, 2040, 2050, 5000):
        x = g.integers(0, 1 << 63, n, dtype=np.uint64)
        for cut in (0, 1, n // 10, n // 2, n):
            y = np.append(x[cut:], g.integers(0, 1 << 63, g.integers(0, cut + 1), dtype=np.uint64))
            maps = [neardup.wide_parity(z) or neardup.parity(z, neardup._BITS) for z in (x, y)]
            assert neardup.apart(*maps) <= len(set(x.tolist()) ^ set(y.tolist()))
    assert neardup.apart(neardup.wide_parity(g.integers(0, 1 << 63, 5000, dtype=np.uint64)), neardup.wide_parity(g.integers(0, 1 << 63, 5000, dtype=np.uint64))) > 10_000 / 9
