"""Operators 11 to 13 against brute force on small fixtures, and on the odd cases their docstrings define."""

import collections
import gc
import hashlib
import itertools
import math
import os
import random
import re
import sys
import time
import zlib
from decimal import Decimal

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import settings as limits
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyglass.llm import fim, queries, whitening, windows

from .test_operators import ODD, clashing, docs, texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def hexdigest(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11

def plain_fim(ident, text):
    """The contract read literally."""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hexdigest(f"1:{'' if ident is None else ident}")
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, m, y = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    return (n, "spm", len(x), len(m), f"<S>{y}<P>{x}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(x), len(m), f"<P>{x}<S>{y}<M>{m}")


def test_fim_equals_the_contract(spark):
    r = random.Random(5)
    rows = [*ODD, *((100 + i, t, "en", "s", 0) for i, t in enumerate(texts(9, 300)))]
    rows += [(1000 + i, "".join(r.choice(["a", "Z", "<", "<P", "S>", "M", ">", "é", "😀", "\n", "[", "`", "@", "{", "<S>"]) for _ in range(r.randrange(40))), None, None, 0) for i in range(300)]
    out = fim.transform(docs(spark, rows).repartition(3)).withColumn("back", fim.restored()).collect()
    assert collections.Counter((repr(x["doc_id"]), x["n"], x["form"], x["prefix_chars"], x["middle_chars"], x["output"]) for x in out) == collections.Counter((repr(i), *plain_fim(i, t or "")) for i, t, *_ in rows)
    assert all(x["back"] == (x["text"] or "") for x in out)
    assert {x["form"] for x in out} == {"plain", "psm", "spm"}


def test_fim_odd_columns_and_tables(spark):
    named = docs(spark)
    for c in ("row", "id", "_", "a.b", "output", "form", "n"):
        named = named.withColumn(c, F.lit(c))
    out = fim.transform(named)
    assert out.columns == [*docs(spark).columns, "row", "id", "_", "a.b", *fim.ADDED]
    assert all(x["row"] == "row" and x["a.b"] == "a.b" and x["n"] == plain_fim(x["doc_id"], x["text"] or "")[0] for x in out.collect())
    assert fim.transform(docs(spark, [])).count() == 0
    assert fim.transform(clashing(docs(spark)), keep=()).columns == list(fim.ADDED)
    ids = docs(spark).select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    assert {x["output"] for x in fim.transform(ids, plain=100).collect()} == {x[1] or "" for x in ODD}


@limits(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aZ<>PSM[`{@ "), st.characters(codec="utf-8")), max_size=60))
def test_borders(text):
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    ends = np.cumsum([0, *(len(u) for u in re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S))])
    assert fim.borders(points).tolist() == ends.tolist()


# 12

@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text, add_special_tokens=False).ids, windows.END_ID]


def check_windows(rows, ids, capacity=windows.CAPACITY):
    """Every id in one piece, windows gapless, full or a power of two. ``rows``: (document, start, length, crc, doc_tokens, window, offset)."""
    pieces, filled = collections.defaultdict(list), collections.defaultdict(list)
    for d, start, length, crc, n, window, offset in rows:
        assert n == len(ids[d]) and crc == zlib.crc32(np.array(ids[d][start : start + length], dtype="<u4").tobytes())
        pieces[d].append((start, length))
        filled[window].append((offset, length))
    assert set(pieces) == set(ids)
    for parts, size in [*((pieces[d], len(ids[d])) for d in ids), *((v, None) for v in filled.values())]:
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == size if size is not None else at == capacity or (at < capacity and at & (at - 1) == 0)
    sizes = [sum(n for _, n in v) for v in filled.values()]
    total = sum(map(len, ids.values()))
    assert sizes.count(capacity) == total // capacity and sum(s for s in sizes if s < capacity) == total % capacity
    return sizes


@pytest.mark.parametrize("capacity", [windows.CAPACITY, 16])
def test_windows_hold_every_id_once(spark, library, capacity):
    made = [(i, t, None, None, 0) for i, t in enumerate(texts(21, 250))] + [(900 + i, "x" * (i * 700), None, None, 0) for i in range(5)] + [(990, None, None, None, 0), (991, "", None, None, 0)]
    out = windows.pack_documents(docs(spark, made).repartition(3), PATH, capacity=capacity).collect()
    check_windows([tuple(x) for x in out], {i: library(t or "") for i, t, *_ in made}, capacity)


def test_windows_where_all_lengths_are_alike(spark, library):
    """No two texts fit into a window together, so most windows are closed by a cut."""
    made = [(i, "one two three four five six seven " * 90, None, None, 0) for i in range(120)]
    assert windows.CAPACITY // 2 < len(library(made[0][1])) < windows.CAPACITY
    with_ids = windows.pack_documents(docs(spark, made).repartition(5), PATH, with_ids=True).collect()
    check_windows([tuple(x)[:-1] for x in with_ids], {i: library(t) for i, t, *_ in made})
    assert all(list(np.frombuffer(x["ids"], dtype="<u2")) == library(made[x["doc_id"]][1])[x["start"] : x["start"] + x["length"]] for x in with_ids)


def test_windows_odd_rows(spark, library):
    out = windows.pack_documents(clashing(docs(spark)).withColumn("row", F.lit(1)).withColumn("ids", F.lit(1)), PATH, keep=("doc_id", "lang_pred", "v")).collect()
    want = collections.Counter((repr(i), len(library(t or ""))) for i, t, *_ in ODD)
    assert collections.Counter((repr(x["doc_id"]), x["doc_tokens"]) for x in out if x["start"] == 0) == want
    assert sum(x["length"] for x in out) == sum(n * c for (_, n), c in want.items())
    assert all(x["lang_pred"] == "lang_pred" and x["v"] == "v" for x in out)
    assert windows.pack_documents(docs(spark, []), PATH).count() == 0


def test_chunks_have_the_librarys_ids(library, monkeypatch):
    r = random.Random(3)
    signs = [*"abzAZ '\".,!?-_0129\n\n\t  \r", "\x1c", "\x85", "\xa0", " ", "　", "é", "ß", "ª", "²", "½", "×", "ÿ", "ɐ", "日", "😀", "́", "'s", "'re", " \n", "  ", "\n\n", "​", "᠎", "﻿", "<|endoftext|>", "\x00", "word", "Straße", "naïve"]
    made = ["".join(r.choice(signs) for _ in range(r.randrange(60))) for _ in range(20_000)]
    monkeypatch.setattr(windows, "MEMO", 500)
    t = windows.ByteTokenizer(PATH)
    for at in range(0, len(made), 200):
        part = made[at : at + 200]
        assert [list(np.frombuffer(x, dtype=t.type)) for x in t.ids(part)] == [library(x)[:-1] for x in part]


#: The tokenizer's own expression, for characters up to U+024F.
UNITS = re.compile(r" ?[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|'(?:s|t|re|ve|m|ll|d)| ?[\d\xb2\xb3\xb9\xbc-\xbe]+| ?(?:[^\w\t-\r \x85\xa0]|_)+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+")


def test_units_are_the_tokenizers():
    r = random.Random(4)
    signs = [*"abzAZ '\".,!?-_0129\n\n\t  \r", "\x1c", "\x85", "\xa0", "é", "ß", "ª", "²", "½", "×", "÷", "ÿ", "ɏ", "'s", "'re", "'ll", "'ve", "'l", "' ", " '", "\x00", "\x7f", "\xad"]
    made = ["".join(r.choice(signs) for _ in range(r.randrange(30))) for _ in range(20_000)]
    units, counts = windows._units(pa.array(made, pa.large_string()).slice(1))
    units = units.to_pylist()
    assert [units[a:b] for a, b in itertools.pairwise([0, *np.cumsum(counts).tolist()])] == [UNITS.findall(t) for t in made[1:]]


def test_units_cost_less_than_an_object_each():
    """Known text takes less time than to split it into Python strings and join what a dictionary has for them, and the memo holds no objects."""
    r = random.Random(6)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(1, 10))) for _ in range(30_000)]
    made = [" ".join(r.choice(words) for _ in range(600)) for _ in range(600)]
    t = windows.ByteTokenizer(PATH)
    t.ids(made[:1])
    gc.collect()
    before = sys.getallocatedblocks()
    want = [len(x) for x in t.ids(made)]
    gc.collect()
    assert sys.getallocatedblocks() - before < 10_000
    parts = re.compile(" ?[a-z]+")
    known = dict.fromkeys((u for x in made for u in parts.findall(x)), b"12")

    def seconds(f):
        times = []
        for _ in range(3):
            at = time.process_time()
            f()
            times.append(time.process_time() - at)
        return min(times)

    assert seconds(lambda: t.ids(made)) < 0.8 * seconds(lambda: [b"".join(map(known.__getitem__, parts.findall(x))) for x in made])
    assert [len(x) for x in t.ids(made)] == want


def test_a_full_memo_keeps_what_is_seen_most(library, monkeypatch):
    monkeypatch.setattr(windows, "MEMO", 100)
    t = windows.ByteTokenizer(PATH)
    for at in range(30):
        part = [" often and again" * 5 + "".join(f" new{chr(97 + k)}{chr(97 + at % 26)}{at}" for k in range(20))]
        assert [list(np.frombuffer(x, dtype=t.type)) for x in t.ids(part)] == [library(x)[:-1] for x in part]
        assert len(t.memo) == len(t.known) == len(t.seen) <= 100 and {" often", " and", " again"} <= set(t.memo.to_pylist())
    monkeypatch.setattr(windows, "_MEMO_BYTES", 10_000)
    assert list(np.frombuffer(t.ids(["x" * 20_000])[0], dtype=t.type)) == library("x" * 20_000)[:-1]
    assert t.memo.nbytes + t.known.nbytes <= 10_000


def test_groups_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(windows, "_GROUP", 50)
    sizes = [[3, 0, 200, 1], [], [10] * 12, [49], [1], [0, 0], [7]]
    rows = iter(range(100))
    batches = [pa.RecordBatch.from_pydict({"row": pa.array([next(rows) for _ in s], pa.int64()), "text": pa.array(["x" * k for k in s], pa.string())}) for s in sizes]
    groups = [g.column(1).to_pylist() for g in windows._groups(iter(batches))]
    assert [len(t) for g in groups for t in g] == [k for s in sizes for k in s]
    assert all(sum(map(len, g[:-1])) < 50 and g for g in groups) and len(groups) == 5
    assert list(windows._groups(iter(batches[1:2]))) == []


@limits(max_examples=150, deadline=None)
@given(st.sampled_from([1, 2, 8, 30, 64, 1024]), st.dictionaries(st.integers(1, 1024), st.integers(0, 300), max_size=50))
def test_plan_leaves_no_padding(capacity, counts):
    counts = {n: c for n, c in counts.items() if n <= capacity}
    made, filled = windows.plan(counts, capacity), collections.defaultdict(list)
    for n, c in counts.items():
        parts = collections.defaultdict(list)
        if c:
            for which, begin, length, window, offset in windows._placed(made[n], np.arange(c)):
                for k, b, m, w, o in zip(*(x.tolist() for x in (which, begin, length, window, offset)), strict=True):
                    parts[k].append((b, m))
                    filled[w].append((o, m))
        assert len(parts) == c
        for p in parts.values():
            assert sum(m for _, m in p) == n and all(a[0] + a[1] == b[0] for a, b in zip(sorted(p), sorted(p)[1:], strict=False))
    sizes = []
    for w in sorted(filled):
        at = 0
        for o, m in sorted(filled[w]):
            assert o == at
            at += m
        sizes.append(at)
    total = sum(n * c for n, c in counts.items())
    rest = [1 << k for k in reversed(range(10)) if total % capacity >> k & 1]
    assert sizes == [capacity] * (total // capacity) + rest


def test_plan_cuts_nothing_that_fits():
    made = windows.plan({1000: 50, 24: 50, 1024: 3, 512: 4, 300: 2, 424: 1})
    assert all(begin == 0 and length == n for n, rows in made.items() for _, _, begin, length, *_ in rows.tolist())


# 13

def brute_whitening(vectors):
    """Rows (vec_id, component) -> (n, deviation, |whitened|, explained) by numpy's own eigenvectors, for vectors of one length."""
    good = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(256 * c) for c in v] for _, v in good]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = (np.array(fit, dtype=object) * n - np.array(sums, dtype=object)).astype(float) / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1], turn[:, ::-1]
    out = {}
    for (i, _), row in zip(good, x, strict=True):
        apart = [n * c - s for c, s in zip(row, sums, strict=True)]
        for k in range(min(4, len(row))):
            w = np.array([a / n for a in apart]) @ turn[:, k] / math.sqrt(values[k])
            out.setdefault((i, k + 1), []).append((n, sum(a * a for a in apart), abs(w), values[k] / values.sum()))
    return out


def test_whitening_equals_brute_force(spark):
    r = np.random.default_rng(4)
    mixed = r.normal(size=(400, 12)) @ r.normal(size=(12, 12))
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(mixed)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)] + [(7, rows[7][1]), (None, rows[3][1]), (None, rows[3][1])]
    odd = [(2000, None), (2001, [None] + [1.0] * 11), (2002, [math.nan] * 12), (2003, [math.inf] + [0.0] * 11), (2004, [-math.inf] * 12)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("key", F.lit("k")).withColumn("n", F.lit(0)).repartition(5)
    got = collections.defaultdict(list)
    for x in whitening.whiten(frame).collect():
        got[x["vec_id"], x["component"]].append((x["n"], int(x["deviation"]), abs(x["whitened"]), x["explained"]))
        assert x["identity_error"] < 1e-12
    want = brute_whitening(rows)
    assert set(got) == set(want)
    for k in want:
        assert len(got[k]) == len(want[k])
        for a, b in zip(sorted(got[k]), sorted(want[k]), strict=True):
            assert a[:2] == b[:2] and math.isclose(a[2], b[2], abs_tol=1e-9) and math.isclose(a[3], b[3], rel_tol=1e-9)


def test_whitening_of_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    got = queries.op13_whitening(spark, sf).collect()
    want = brute_whitening([(x[0], x[1]) for x in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()])
    assert len(got) == sum(map(len, want.values()))
    for x in got:
        n, deviation, white, explained = want[x["vec_id"], x["component"]][0]
        assert (x["n"], x["deviation"]) == (n, deviation) and math.isclose(abs(x["whitened"]), white, abs_tol=1e-8) and math.isclose(x["explained"], explained, rel_tol=1e-6)
        assert x["identity_error"] < 1e-9


def test_whitening_lengths_spread_and_size(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [5.0, 2.0]), (4, [1.0]), (5, []), (6, [2.0, 2.0, 2.0]), (7, [2.0, 2.0, 2.0]), (8, [1e300, -1e300, 1.0, 0.0, 5e16]), (9, [0.0, 1e300, 0.5, 1.0, -5e16])]
    got = {(x["vec_id"], x["component"]): x for x in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert {k[0] for k in got} == {1, 2, 3, 4, 6, 7, 8, 9} and len(got) == 2 * 3 + 1 + 2 * 3 + 2 * 4
    assert math.isclose(abs(got[1, 1]["whitened"]), math.sqrt(1.5)) and got[1, 1]["explained"] == 1 and got[1, 2]["whitened"] is None and got[1, 2]["explained"] == 0
    assert got[1, 1]["deviation"] == Decimal((3 * 256 - 9 * 256) ** 2) and got[1, 1]["identity_error"] < 1e-12  # no spread across
    assert got[4, 1]["whitened"] is None and got[4, 1]["explained"] is None and got[4, 1]["identity_error"] is None and got[4, 1]["n"] == 1 and got[4, 1]["deviation"] == 0
    assert got[6, 1]["n"] == 1 and got[7, 3]["deviation"] == 0
    longs = [[min(max(math.floor(256 * c), -(2**63)), 2**63 - 1) for c in v] for _, v in rows[-2:]]  # what is beyond a long is the nearest one
    exact = sum((2 * a - a - b) ** 2 for a, b in zip(*longs, strict=True))
    assert got[8, 1]["deviation"] == (exact if exact < 10**38 else None)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whiten(empty).count() == 0
    assert whitening.whiten(spark.createDataFrame([("a", None)], "vec_id string, embedding array<float>")).count() == 0


@pytest.mark.parametrize("d", [1, 2, 3, 7, 16, 65])
def test_jacobi(d):
    r = np.random.default_rng(d)
    a = r.normal(size=(d, d))
    values, vectors = whitening.jacobi(a @ a.T)
    assert np.allclose(a @ a.T @ vectors, vectors * values, atol=1e-10) and np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-12) and (np.diff(values) <= 0).all()


def test_jacobi_keeps_small_eigenvalues():
    """A graded matrix D A D with A near the identity: relative precision holds through 16 orders of magnitude."""
    r = np.random.default_rng(2)
    grade = 10.0 ** -np.arange(0, 9)
    a = np.eye(9) + 0.1 * r.uniform(-1, 1, (9, 9))
    a = (a + a.T) / 2
    values, _ = whitening.jacobi(grade[:, None] * a * grade)
    from fractions import Fraction

    exact = [[Fraction(float(x)) for x in row] for row in grade[:, None] * a * grade]
    product = Fraction(1)  # the determinant, by exact elimination
    for k in range(9):
        product *= exact[k][k]
        for i in range(k + 1, 9):
            f = exact[i][k] / exact[k][k]
            exact[i] = [x - f * y for x, y in zip(exact[i], exact[k], strict=True)]
    assert math.isclose(math.prod(values), float(product), rel_tol=1e-12)
    assert whitening.jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]
