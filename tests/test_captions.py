import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyglass.functions import styles, text
from tallyglass.operators import align, bitmaps
from tallyglass.sources import glyphsets, srt, vobsub

INDEX = """# VobSub index file
size: 64x32
palette: 000000, ffffff, ff0000, 00ff00
id: en, index: 0
delay: 00:00:01:000
timestamp: 00:00:01:000, filepos: 000000000
timestamp: 00:00:05:500, filepos: 000000800
timestamp: broken
id: de, index: 1
timestamp: 00:00:02:000, filepos: 000000000
"""


def encode_unit(image, stop=None):
    """A subpicture unit of a 2-bit image."""
    h, w = image.shape

    def field(rows):
        nibbles = []
        for row in rows:
            x = 0
            while x < w:
                n = 1
                while x + n < w and row[x + n] == row[x] and n < 63:
                    n += 1
                code = n << 2 | int(row[x])
                nibbles += [code] if n < 4 else [code >> 4, code & 15] if n < 16 else [0, code >> 4, code & 15]
                x += n
            nibbles += [0] * (len(nibbles) % 2)
        return bytes(a << 4 | b for a, b in zip(nibbles[::2], nibbles[1::2], strict=True))

    top, bottom = field(image[0::2]), field(image[1::2])
    at = 4 + len(top) + len(bottom)
    area = (0 << 12 | (w - 1)).to_bytes(3, "big") + (0 << 12 | (h - 1)).to_bytes(3, "big")
    first = bytes([1, 3, 0x32, 0x10, 4, 0xFF, 0xF0, 5]) + area + bytes([6]) + (4).to_bytes(2, "big") + (4 + len(top)).to_bytes(2, "big") + b"\xff"
    second = at + 4 + len(first)
    blocks = (0).to_bytes(2, "big") + (second if stop else at).to_bytes(2, "big") + first
    if stop:
        blocks += stop.to_bytes(2, "big") + second.to_bytes(2, "big") + b"\x02\xff"
    body = top + bottom + blocks
    return (len(body) + 4).to_bytes(2, "big") + at.to_bytes(2, "big") + body


def packets(unit, stream=0, part=40):
    out = b"\0\0\1\xba" + bytes([0x44]) + bytes(9)
    for i in range(0, len(unit), part):
        body = b"\x80\x00\x00" + bytes([0x20 + stream]) + unit[i : i + part]
        out += b"\0\0\1\xbd" + len(body).to_bytes(2, "big") + body
    return out


@pytest.fixture
def pair(tmp_path):
    rng = np.random.default_rng(0)
    images = [rng.integers(0, 4, (9, 33)).astype(np.uint8), np.repeat(rng.integers(0, 4, (8, 2)), 40, axis=1).astype(np.uint8)]
    data = packets(encode_unit(images[0], stop=90)).ljust(0x800, b"\0") + packets(encode_unit(images[1]))
    (tmp_path / "a.idx").write_text(INDEX)
    (tmp_path / "a.sub").write_bytes(data)
    return tmp_path, images


def test_decode_round_trip(spark, pair):
    folder, images = pair
    rows = vobsub.read_vobsub(spark, str(folder)).orderBy("cue").collect()
    assert [(r["start_ms"], r["end_ms"]) for r in rows] == [(2000, 2000 + 1024), (6500, 10_500)]
    for r, image in zip(rows, images, strict=True):
        assert np.array_equal(np.frombuffer(r["image"]["px"], np.uint8).reshape(r["image"]["h"], r["image"]["w"]), image)


def test_odd_files_give_no_rows(spark, pair):
    folder, _ = pair
    (folder / "lonely.idx").write_text(INDEX)
    (folder / "other.sub").write_bytes(b"\0")
    assert vobsub.read_vobsub(spark, str(folder)).count() == 2 and vobsub.read_vobsub(spark, str(folder), track=7).count() == 0
    assert vobsub.read_vobsub(spark, str(folder / "a.idx")).select("file").distinct().collect()[0][0] == "a.idx"
    assert {(r["base"].rsplit("/", 1)[1], r["idx"] is None, r["sub"] is None) for r in vobsub.pair_files(spark, str(folder)).collect()} == {("a", False, False), ("lonely", False, True), ("other", True, False)}


def test_truncated_unit_and_missing_sub(spark, pair, tmp_path):
    unit = encode_unit(np.zeros((4, 4), np.uint8))
    assert vobsub.demux(packets(unit)[:-3], 0, 0) == unit[:-3]
    assert vobsub.demux(b"junk", 0, 0) is None
    (tmp_path / "b.idx").write_text(INDEX)
    vobsub.register(spark)
    assert spark.read.format("vobsub").load(str(tmp_path / "a.idx")).count() == 2
    with pytest.raises(Exception, match="no index"):
        spark.read.format("vobsub").load(str(tmp_path / "b.idx")).collect()


def test_index_rows_equal_parser(spark):
    files = spark.createDataFrame([("a.idx", INDEX)], "file string, content string")
    rows = [(r["track_no"], r["lang"], r["ms"], r["filepos"]) for r in vobsub.index_rows(files).orderBy("track_no", "entry_no").collect()]
    assert rows == [(0, "en", 2000, 0), (0, "en", 6500, 0x800), (1, "de", 2000, 0)]
    _, palette, tracks = vobsub.parse_index(INDEX)
    assert len(palette) == 16 and [t.entries for t in tracks] == [[(2000, 0), (6500, 0x800)], [(2000, 0)]]


def test_srt_round_trip(spark):
    rows = spark.createDataFrame([("f", 1000, 2000, "one\ntwo"), ("f", 3000, 4000, "  "), ("f", -5, 10, "zero")], "file string, start_ms long, end_ms long, text string")
    out = srt.render_srt(rows)
    assert out.first()["srt"] == "1\n00:00:00,000 --> 00:00:00,010\nzero\n\n2\n00:00:01,000 --> 00:00:02,000\none\ntwo\n"
    assert {(r["stamp"], r["text"]) for r in srt.parse_srt(out).collect()} == {("00:00:00,000", "zero"), ("00:00:01,000", "one\ntwo")}


def test_stamps_and_folding(spark):
    row = spark.createDataFrame([(3_723_004, "“a” – ’b’… ﬁn x​y é", "<i>a</i>b")], "ms long, t string, s string")
    got = row.select(text.fmt_ts(F.col("ms")), text.simplify(F.col("t")), text.strip_tags(F.col("s"))).first()
    assert tuple(got) == ("01:02:03,004", "\"a\" - 'b'... fin xy é", "ab")
    both = spark.range(1).select(text.version_tuple(F.lit("1.10.2")) > text.version_tuple(F.lit("1.9")), text.majority_style(F.array(F.lit("bi"), F.lit("b"), F.lit(""))))
    assert tuple(both.first()) == (True, "b")


@pytest.mark.parametrize(
    "given, want",
    [("<i>Hi </i><i>there</i> you", "<i>Hi there</i> you"), ("<b><i>Hey</i></b> <u>you</u>", "<b><i>Hey</i></b> <u>you</u>"), ("<i>a <b>b</b></i>", "<i>a <b>b</b></i>"), ("<i>open\nnext", "<i>open</i>\nnext"), ("  \n<font>x</font>", "x")],
)
def test_styles(given, want):
    assert styles.normalized(given) == want


def letters():
    rng = np.random.default_rng(4)
    out = {}
    for c in "helowrd":
        m = np.zeros((14, 9), dtype=bool)
        for row in m:
            row[4 - rng.integers(0, 5) : 5 + rng.integers(0, 5)] = True
        m[0] = m[-1] = True
        out[c] = m
    return out


def draw(words, space=14, gap=3):
    shapes, x, parts = letters(), 0, []
    for line, text_ in enumerate(words.split("\n")):
        x = 2
        for c in text_:
            if c == " ":
                x += space - gap
                continue
            parts.append((2 + 30 * line, x, shapes[c]))
            x += shapes[c].shape[1] + gap
    image = np.zeros((30 * (words.count("\n") + 1), 400), dtype=bool)
    for y, x, m in parts:
        image[y : y + 14, x : x + 9] |= m
    return image


def test_segment_align_learn_round_trip(spark):
    lines = bitmaps.segment(draw("hello world\nhold the door".replace("t", "w")))
    assert [len(line) for line in lines] == [10, 11]
    found = align.align(lines[0], "hello world", 8)
    assert align.accepted(found, 10) and "".join(s[4] for s in found["spans"]) == "helloworld" and found["cost"] == 0
    touching = [*lines[0][:2], {**lines[0][2], "w": 21}, *lines[0][4:]]
    merged = align.align(touching, "hello world", 8)
    assert "".join(s[4] for s in merged["spans"]) == "helloworld"
    assert align.align(lines[0], "", 8) is None and align.align([], "", 8)["cost"] == 0
    rows = spark.createDataFrame([("f", 0, 0, lines[0], "hello world")], "file string, cue int, line int, glyphs array<struct<key:string,h:int,w:int,label:string,gap_after:int>>, text string")
    seen = align.learn(rows, 8.0).collect()
    votes = {(r["keys"][0], r["label"]) for r in seen if r["kind"] == "vote"}
    assert len(votes) == 7 and {x for _, x in votes} == set("helowrd")  # one vote a cue
    assert [r["label"] for r in seen if r["kind"] == "word"] == ["hello", "world"]
    assert [r["is_space"] for r in seen if r["kind"] == "gap"] == [False] * 4 + [True] + [False] * 4


def test_conflict_and_look_alike_costs():
    glyph = lambda label: {"key": "k", "w": 5, "label": label, "gap_after": 2}
    assert align.align([glyph("a")], "b", 8)["conflicts"] == 1
    alike = align.align([glyph("I")], "l", 8)
    assert (alike["cost"], alike["conflicts"], alike["soft"], alike["spans"]) == (0.5, 0, 0, [(0, 1, 0, 1, "l")])


def test_segment_cues(spark):
    mask = draw("hello")
    image = np.where(bitmaps.grown(mask), 2, 0)
    image[mask] = 1
    px = bytearray(image.astype(np.uint8).tobytes())
    rows = spark.createDataFrame([("f", 0, (image.shape[0], image.shape[1], px), [0, 15, 15, 0]), ("f", 1, (0, 0, bytearray()), [0, 15, 15, 0])], "file string, cue int, image struct<h:int,w:int,px:binary>, alpha array<int>")
    assert bitmaps.segment_cues(rows).count() == 5


def test_pieces_topology_underline():
    ring = np.ones((7, 7), bool)
    ring[2:5, 2:5] = False
    assert bitmaps.topology(ring) == (1, 1)
    assert bitmaps.pieces(np.eye(5, dtype=bool)).max() == 1
    assert bitmaps.pieces(np.zeros((0, 0), bool)).size == 0 and bitmaps.segment(np.zeros((5, 5), bool)) == []
    mask = draw("hello")[:30]
    mask[22:24, 0:70] = True
    assert [g["underlined"] for g in bitmaps.segment(mask[:26])[0]][:3] == [True] * 3
    assert np.array_equal(bitmaps.resize(ring, 14, 14), np.kron(ring, np.ones((2, 2))) > 0)


def test_near_bitmaps_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    masks = []
    for i in range(30):
        m = rng.random((14 + i % 2, 9)) < 0.5 if i < 15 else masks[i - 15].copy()
        if i >= 15:
            m[tuple(rng.integers(0, 9, 2))] ^= True
        masks.append(m)
    rows = spark.createDataFrame([(f"k{i:02}", m.shape[0], m.shape[1], int(m.sum()), bytearray(bitmaps.pack(m))) for i, m in enumerate(masks)], "key string, h int, w int, ink int, bits binary")
    want = {(f"k{i:02}", f"k{j:02}") for i, a in enumerate(masks) for j, b in enumerate(masks) if i != j and abs(a.shape[0] - b.shape[0]) <= 1 and abs(int(a.sum()) - int(b.sum())) <= 0.12 * (a.sum() + b.sum()) / 2 and bitmaps.difference(a, b) <= 0.12}
    got = {(r["key"], r["ref_key"]) for r in bitmaps.near_bitmaps(rows, rows, block=7).collect()}
    assert got == want and len(want) >= 30
    median, stable = bitmaps.prototype(masks[:1] * 3, [1, 1, 1])
    assert median.sum() == masks[0].sum() and stable.all()
    assert bitmaps.overlap(masks[0], masks[0]) == 1.0


def test_side_bearings():
    import itertools

    right, left = {"a": 1.0, "b": 2.0, "c": 0.5}, {"a": 0.0, "b": 1.5, "c": 2.5}
    rows = [(x, y, right[x] + left[y], False) for x, y in itertools.product("abc", repeat=2)] * 3 + [("a", "b", right["a"] + left["b"] + 9, True)] * 5
    r, l, off = align.side_bearings(rows)
    assert abs(off - 9) < 1e-3 and abs(r["b"] - r["a"] - 1) < 1e-3
    assert align.side_bearings(rows[:5]) is None
    assert align.greedy_cover({"x": {1, 2}, "y": {2}, "z": {3}}, {1: 5, 2: 5, 3: 1}, 2) == ["x", "z"]


def test_glyph_sets(spark, tmp_path):
    import json

    (tmp_path / "s.json").write_text(json.dumps({"name": "s", "shapes": [{"key": "k1", "h": 1, "w": 8, "bits": "/w==", "cluster": "gone", "variants": [{"top_rel": 0, "votes": {"a": 2}}]}], "sequences": [{"parts": ["k1", "k1"], "label": "w", "n": 3}]}))
    shapes, seen, sequences_ = glyphsets.read_sets(spark, str(tmp_path))
    row = shapes.first()
    assert (row["cluster"], row["n"], bytes(row["bits"])) == ("k1", 2, b"\xff")
    assert tuple(seen.first()) == ("s", "k1", 0, "a", 2) and sequences_.first()["parts"] == ["k1", "k1"]
    (tmp_path / "private").mkdir()
    side = {"learned_sources": ["a", "b"], "words": {"k1|k1": {"w": 2}}, "interim": {"shapes": [{"key": "k1", "variants": [{"top_rel": 0, "votes": {"a": 1, "b": 1}}]}]}}
    (tmp_path / "private" / "s.json").write_text(json.dumps(side))
    (tmp_path / "private" / "t.json").write_text("{}")
    sources, words, interim = glyphsets.read_private(spark, str(tmp_path / "private"))
    assert {tuple(r) for r in sources.collect()} == {("s", "a"), ("s", "b")} and [tuple(r) for r in words.collect()] == [("s", ["k1", "k1"], "w", 2)]
    assert {(r["label"], r["n"]) for r in glyphsets.with_interim(seen, interim).collect()} == {("a", 3), ("b", 1)}
    glyphsets.write_sets(seen, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
