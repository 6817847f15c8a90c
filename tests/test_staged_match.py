"""Prototypes between pixels and edges, vetoes by word geometry, and the slant of words from their ink."""

import numpy as np
import pytest

from tallyglass.operators import bitmaps, reading, transfer

SHAPE = "key string, h int, w int, ink int, bits binary"
KNOWN = SHAPE + ", label string, voted array<string>, upright long, italic long, regular long, bold long"


def row(key, m, *more):
    return (key, *m.shape, int(m.sum()), bytearray(bitmaps.pack(m)), *more)


def ring(h=20, w=12, thick=3, gap=0):
    m = np.ones((h, w), bool)
    m[thick:-thick, thick:-thick] = False
    if gap:
        m[h // 2 - gap : h // 2 + gap, w - thick :] = False
    return m


def worn(m, n, seed):
    """A mask with ``n`` of its outline's pixels gone, as jitter does."""
    r = np.random.default_rng(seed)
    edge = np.argwhere(m & ~(np.pad(m, 1)[2:, 1:-1] & np.pad(m, 1)[:-2, 1:-1] & np.pad(m, 1)[1:-1, 2:] & np.pad(m, 1)[1:-1, :-2]))
    edge = edge[(edge[:, 0] > 0) & (edge[:, 0] < m.shape[0] - 1) & (edge[:, 1] > 0) & (edge[:, 1] < m.shape[1] - 1)]
    out = m.copy()
    out[tuple(edge[r.permutation(len(edge))[:n]].T)] = False
    return out


@pytest.fixture(scope="module")
def letters():
    """Two letters that jitter within their own unstable pixels: o (a ring) and c (a ring with a gap)."""
    out = {}
    for label, m in (("o", ring()), ("c", ring(gap=4))):
        samples = [worn(m, 22, s) for s in range(10)]
        out[label] = (m, samples)
    return out


def protos(spark, letters, *labels):
    rows = [row(f"{x}{i}", m, x, 10 - i) for x in labels for i, m in enumerate(letters[x][1])]
    return bitmaps.prototypes(spark.createDataFrame(rows, SHAPE + ", cluster string, n long"))


def found(spark, shapes, known, made, **more):
    frame = spark.createDataFrame(shapes, SHAPE)
    got = reading.near_match(frame, spark.createDataFrame(known, KNOWN), protos=made, **more).collect()
    return {r["key"]: (r["ref_key"], r["stage"]) for r in got}


def test_prototypes_read_what_pixels_miss_and_abstain(spark, letters):
    made = protos(spark, letters, "o", "c")
    none = (None,) * 4
    head = lambda x, label, voted=(), votes=none: row(x, letters[x][0], label, list(voted), *votes)
    jitter = [worn(letters["o"][0], 34, s) for s in (51, 52)] + [worn(letters["c"][0], 34, 53)]
    shapes = [row("j0", jitter[0]), row("j1", jitter[1]), row("j2", jitter[2]), row("filled", np.ones((20, 12), bool))]
    assert all(bitmaps.difference(m, letters["o"][0]) > 0.12 for m in jitter)  # beyond the pixel stage
    assert found(spark, shapes, [head("o", "o"), head("c", "c")], None) == {}
    got = found(spark, shapes, [head("o", "o", ["o"]), head("c", "c", ["c"])], made)
    assert got == {"j0": ("o", "prototypes"), "j1": ("o", "prototypes"), "j2": ("c", "prototypes")}  # the filled one has no hole
    # an unconfirmed cluster waits, a pair of look-alikes is joined, and the word's slant and weight must agree
    votes = spark.createDataFrame([("j0", 0, 3, 0, 0), ("j1", 4, 0, 2, 0)], "key string, upright long, italic long, regular long, bold long")
    assert "j0" not in found(spark, shapes[:2], [head("o", None, ["o"])], made)
    assert found(spark, shapes[:1], [head("o", None, ["I", "l"])], made) == {"j0": ("o", "prototypes")}
    close = found(spark, shapes[:2], [head("o", "o", ["o"], (9, 1, 9, 0))], made, geometry=votes)
    assert close.get("j1") == ("o", "prototypes")


def test_geometry_vetoes(spark, letters):
    base = np.zeros((20, 14), bool)
    base[2:18, 2:12] = True
    base[5:15, 5:9] = False
    rough = base.copy()
    rough[2:18:2, 11] = rough[3:17:2, 2] = False
    known = lambda label, *votes: [row("d", base, label, [label], *votes)]
    told = lambda *v: spark.createDataFrame([("r", *v)], "key string, upright long, italic long, regular long, bold long")
    read = lambda label, votes: found(spark, [row("r", rough)], known(label, 9, 0, 9, 0), None, rescaled=True, geometry=votes)
    assert read("D", told(3, 0, 2, 0)) == {"r": ("d", "edges")} and read("D", told(0, 3, 2, 0)) == {} and read("#", told(0, 3, 2, 0)) == {"r": ("d", "edges")}  # signs have no slant
    names = "key string, upright long, italic long, regular long, bold long"
    mine = spark.createDataFrame([("slant", 0, 3, 2, 0), ("weight", 3, 0, 0, 2), ("same", 3, 0, 2, 0), ("even", 2, 2, 0, 0)], names)
    theirs = spark.createDataFrame([("sure", 9, 0, 9, 0), ("open", 4, 4, 0, 0)], names)
    pairs = spark.createDataFrame([(k, r) for k in ("slant", "weight", "same", "even", "unmeasured") for r in ("sure", "open", "none")], "key string, ref_key string")
    got = {(r["key"], r["ref_key"]): (r["disagree"], r["measured"]) for r in reading._with_geometry(pairs, mine, theirs).collect()}
    assert {k for k, (no, _) in got.items() if no} == {("slant", "sure"), ("weight", "sure")} and {k[0] for k, (_, seen) in got.items() if not seen} == {"unmeasured"}


def bars(shear, n=5, h=30, step=9, thick=3):
    """A word of upright bars, leaning to the right by ``shear``."""
    m = np.zeros((h, n * step + int(h * abs(shear)) + 4), bool)
    for k in range(n):
        for y in range(h):
            x = k * step + round((h - 1 - y) * shear)
            m[y, x : x + thick] = True
    return m


@pytest.mark.parametrize("shear, want", [(0.0, False), (0.025, False), (0.2, True), (0.25, True), (0.1, None)])
def test_slant_of_a_words_ink(shear, want):
    assert transfer.slanted(*np.argwhere(bars(shear)).T) is want
    spectrum = transfer.sharpness(*np.argwhere(bars(shear)).T)
    plain = []
    ys, xs = np.argwhere(bars(shear)).T
    for s in transfer.SHEARS:
        columns = [round(float(x + s * (y - ys.max()))) for y, x in zip(ys, xs, strict=True)]
        plain.append(sum(columns.count(c) ** 2 for c in set(columns)))
    assert spectrum.tolist() == plain
    assert transfer.slanted(*np.argwhere(np.ones((5, 40), bool)).T) is None and transfer.slanted(np.array([]), np.array([])) is None


def test_slant_votes_from_glyphs(spark):
    def line(cue, words):
        out, x, pos = [], 0, 0
        for w, parts in enumerate(words):
            for i, (key, mask) in enumerate(parts):
                last = i + 1 == len(parts)
                gap = None if last and w + 1 == len(words) else 14 if last else 2
                out.append(("f", cue, 0, pos, key, *mask.shape, int(mask.sum()), bitmaps.pack(mask), x, 40 - mask.shape[0], -mask.shape[0], False, gap, None))
                x += mask.shape[1] + (gap or 0)
                pos += 1
        return out

    up, lean, dot = bars(0.0, 2), bars(0.25, 2), np.ones((4, 4), bool)
    rows = line(0, [[("u", up), ("u", up)], [("u", up), (".", dot)]]) + line(1, [[("i", lean), ("i", lean)], [("i", lean), (".", dot)], [("block", np.ones((30, 30), bool))]])
    glyphs = spark.createDataFrame(rows, bitmaps.GLYPHS)
    words = {(r["line"]["cue"], r["word"]): (r["slanted"], [(k["key"], k["small"]) for k in r["keys"]]) for r in transfer.word_slants(glyphs, 8).collect()}
    assert words == {
        (0, 0): (False, [("u", False)] * 2), (0, 1): (False, [("u", False), (".", True)]), (1, 0): (True, [("i", False)] * 2), (1, 1): (True, [("i", False), (".", True)]), (1, 2): (None, [("block", False)]),
    }
    assert {r["key"]: (r["upright"], r["italic"]) for r in transfer.slant_votes(glyphs, 8).collect()} == {"u": (3, 0), "i": (0, 3), ".": (1, 1), "block": (0, 1)}
