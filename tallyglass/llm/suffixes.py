"""Repeated byte strings, found exactly by sorting suffixes with hashed comparisons.

A string of ``LENGTH`` bytes that occurs twice has, at the same place in both, the smallest hash of all
``GRAM``-byte strings in it; those places, one in about 35, are its anchors. Only anchors whose string
occurs again are looked at further, with the bytes around them. The anchors of one string are sorted by
what follows and by what precedes them: a merge sort in which two suffixes are compared by a binary
search for their common extension over prefix polynomial hashes. Neighbours' extensions are then verified
byte for byte. Anchors that agree on d bytes before and LENGTH - d after are the occurrences of one
string, and all but the first of those are covered. Equal surroundings are neighbours that agree throughout.

Everything is distributed by anchor or by document, never by pairs. Map tasks sort the anchors of a batch of
documents, settle those that equal an earlier one throughout, and send the others on. What reaches a group is sorted in
blocks; a block takes along one row of each surroundings seen so far. A group with too many of those, and each
of the few strings that make up a thousandth of all anchors, is dealt anew: the strings around an anchor are
told apart by how far before it they start, and those of a narrow range agree on most of their bytes, so
anchors are grouped by these bytes, range by range. In a range of one start all rows of a group are equal.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import _last_start, discard, materialize, small_batches, starts

LENGTH = 100
GRAM = 32
_BEFORE = LENGTH - GRAM
_BLOCK = 32_768
_SALTS = 1024
_PARTS = 8
_HOT = 1000
_OFTEN = 100_000
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.array([pow(_BASE, i, 1 << 64) for i in range(GRAM)], dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Smallest or largest of each ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: x.size - (width - have)], x[width - have :]) if have < width else x


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of a text and the hashes of their strings; none in less than LENGTH bytes."""
    if len(data) < LENGTH:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    h, have = np.frombuffer(data, dtype=np.uint8).astype(np.uint64), 1
    while have < GRAM:  # GRAM is a power of two
        h = h[:-have] + np.uint64(pow(_BASE, have, 1 << 64)) * h[have:]
        have *= 2
    h = _mixed(h)
    width = LENGTH - GRAM + 1
    low = _slide(h, width, np.minimum)
    pad = np.zeros(width - 1, dtype=np.uint64)
    at = np.flatnonzero(h == _slide(np.concatenate([pad, low, pad]), width, np.maximum))
    return at, h[at]


def around(data: bytes, at: np.ndarray) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """Hash of the string at each place, the bytes before it (nearest first), and those from it on."""
    raw = np.frombuffer(data, dtype=np.uint8)
    h = _mixed((raw[at[:, None] + np.arange(GRAM)].astype(np.uint64) * _POWERS).sum(1, dtype=np.uint64))
    places = at.tolist()
    return h, [data[max(0, p - _BEFORE) : p][::-1] for p in places], [data[p : p + LENGTH] for p in places]


def _common(a: np.ndarray, b: np.ndarray, hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Longest common prefix of rows a and b, by binary search over equal prefix hashes; equal rows need one look."""
    out = np.minimum(size[a], size[b])
    open_ = np.flatnonzero(hashes[out, a] != hashes[out, b])
    a, b, low, high = a[open_], b[open_], np.zeros(open_.size, dtype=np.int64), out[open_] - 1
    while (low < high).any():
        mid = (low + high + 1) >> 1
        same = hashes[mid, a] == hashes[mid, b]
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    out[open_] = low
    return out


def _order(a: np.ndarray, b: np.ndarray, x: np.ndarray, size: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Below, at or above 0 where row a comes before, equals or comes after row b."""
    n = _common(a, b, hashes, size)
    ended = n == np.minimum(size[a], size[b])
    at = np.minimum(n, x.shape[1] - 1)
    return np.where(ended, size[a] - size[b], x[a, at].astype(np.int64) - x[b, at])


def suffix_sort(x: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``x`` (the first ``size`` bytes each) within each group, and common prefixes.

    Rows of a group stand together. Returns the sorted row numbers and, for each place, the common prefix
    with the place before it, -1 where a group starts. Merges runs of 1, 2, 4 ... rows of all groups at
    once: a row's new place is its own within its run and its rank in the other run.
    """
    n = len(x)
    hashes = np.zeros((x.shape[1] + 1, n), dtype=np.uint64)
    for i, column in enumerate(np.ascontiguousarray(x.T)):
        hashes[i + 1] = hashes[i] * np.uint64(_BASE) + column + np.uint64(1)
    new = np.ones(n, dtype=bool)
    new[1:] = group[1:] != group[:-1]
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, n))
    first, last = np.repeat(start, count), np.repeat(start + count, count)
    order, width = np.arange(n), 1
    while width < (count.max() if n else 0):
        heads = np.flatnonzero((last - first > width) & ((np.arange(n) - first) % (2 * width) == 0))  # left runs
        heads = heads[heads + width < last[heads]]
        heads = heads[_order(order[heads + width - 1], order[heads + width], x, size, hashes) > 0]  # others are in order as they are
        length = np.minimum(2 * width, last[heads] - heads)
        live = np.repeat(heads, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        run = (live - first[live]) // width
        own = first[live] + run * width
        other = first[live] + (run ^ 1) * width
        low, high = np.minimum(other, last[live]), np.minimum(other + width, last[live])
        begin, right = low.copy(), run % 2 == 1
        row = order[live]
        while (open_ := low < high).any():
            k = np.flatnonzero(open_)
            mid = (low[k] + high[k]) >> 1
            sign = _order(row[k], order[mid], x, size, hashes)
            up = (sign > 0) | ((sign == 0) & right[k])  # equal rows: those of the left run first
            low[k], high[k] = np.where(up, mid + 1, low[k]), np.where(up, high[k], mid)
        order = order.copy()
        order[np.minimum(own, begin) + (live - own) + (low - begin)] = row
        width *= 2
    lcp = np.full(n, -1, dtype=np.int64)
    k = np.flatnonzero(~new)
    a, b = order[k - 1], order[k]
    differs = x[a] != x[b]
    true = np.minimum(np.where(differs.any(1), differs.argmax(1), x.shape[1]), np.minimum(size[a], size[b]))
    at = np.minimum(true, x.shape[1] - 1)
    ended = true == np.minimum(size[a], size[b])
    wrong = np.where(ended, size[a] > size[b], x[a, at] > x[b, at])
    lcp[k] = true
    for g in np.unique(group[order[k[wrong]]]) if wrong.any() else ():  # a hash collision: order that group by its bytes
        lo, hi = np.searchsorted(np.flatnonzero(group == g), [0, n]) + np.flatnonzero(group == g)[0]
        order[lo:hi] = sorted(range(lo, hi), key=lambda r: x[r, : size[r]].tobytes())
        for p in range(lo + 1, hi):
            a, b = (x[r, : size[r]].tobytes() for r in order[p - 1 : p + 1])
            lcp[p] = next((i for i, (s, t) in enumerate(zip(a, b, strict=False)) if s != t), min(len(a), len(b)))
    return order, lcp


def _rows(column: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(b) for b in column], dtype=np.int64)
    return np.frombuffer(b"".join([b.ljust(width, b"\0") for b in column]), dtype=np.uint8).reshape(-1, width), size


def covered(group: np.ndarray, before: list[bytes], after: list[bytes], least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor, how far before and after it bytes are covered, and whether its surroundings are new.

    Rows of a group stand together, in the order of the texts. Covered is every string that starts ``least`` to
    ``most`` bytes before the anchor and that a row before it has too; as each holds the anchor, they
    make one stretch. (0, 0): nothing.
    """
    n = len(group)
    x, x_size = _rows(before, _BEFORE)
    y, y_size = _rows(after, LENGTH)
    x_size, y_size = np.minimum(x_size, most), np.minimum(y_size, LENGTH - least)
    new = np.append(True, group[1:] != group[:-1])[:n]
    number = np.cumsum(new) - 1
    order_x, lcp_x = suffix_sort(x, x_size, group)
    order_y, lcp_y = suffix_sort(y, y_size, group)
    alike = _equal(order_x, lcp_x, x_size) * (n + 1) + _equal(order_y, lcp_y, y_size)
    _, first, inverse = np.unique(alike, return_index=True, return_inverse=True)
    fresh = first[inverse] == np.arange(n)
    far, near = np.minimum(x_size, most), np.maximum(LENGTH - y_size, least)  # what an earlier row of equal surroundings covers
    hit = ~fresh & (far >= near)
    rest = fresh & (np.bincount(number, weights=fresh, minlength=1) > 1)[number]
    if rest.any():
        far[rest], near[rest] = _partly(rest, (order_x, lcp_x, x_size), (order_y, lcp_y, y_size), least, most)
        hit[rest] = far[rest] >= 0
    return np.where(hit, far, 0), np.where(hit, LENGTH - near, 0), fresh


def _equal(order: np.ndarray, lcp: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers of the rows, alike for sorted neighbours that agree throughout."""
    sorted_size = size[order]
    out = np.empty(order.size, dtype=np.int64)
    out[order] = np.cumsum((lcp != sorted_size) | (np.append(-1, sorted_size[:-1]) != sorted_size)) if order.size else 0
    return out


def _partly(rest: np.ndarray, ahead: tuple, behind: tuple, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest and smallest reach before the anchor, of the rows of ``rest``, of a string seen in an earlier one of them (-1: none)."""
    rows = np.flatnonzero(rest)
    far, near = np.full(rest.size, -1, dtype=np.int64), np.full(rest.size, LENGTH, dtype=np.int64)
    sides = []
    for order, lcp, size in (ahead, behind):  # common prefixes of the rows of rest, which stay in their order
        kept = np.flatnonzero(rest[order])
        sides.append((order[kept], np.minimum.reduceat(lcp[: kept[-1] + 1], np.append(0, kept[:-1] + 1)) if kept.size else lcp[:0], size))

    def number(side: tuple, length: int) -> np.ndarray:
        order, lcp, _ = side
        out = np.empty(rest.size, dtype=np.int64)
        out[order] = np.cumsum(lcp < length)
        return out

    for d in range(int(least[rows].min()), int(most[rows].max()) + 1):
        valid = rows[(sides[0][2][rows] >= d) & (sides[1][2][rows] >= LENGTH - d) & (least[rows] <= d) & (d <= most[rows])]
        key = number(sides[0], d)[valid] * (rest.size + 1) + number(sides[1], LENGTH - d)[valid]
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        again = valid[first[inverse] != np.arange(valid.size)]
        far[again] = d
        near[again] = np.minimum(near[again], d)
    return far[rows], near[rows]


def narrowed(h: int, least: int, most: int, before: bytes, after: bytes) -> Iterator[tuple[int, int, int]]:
    """The parts of a range of starts, with a hash of the bytes that all strings of the part share; none where the text is too short."""
    step = -(-(most - least + 1) // _PARTS)
    for a in range(least, most + 1, step):
        b = min(a + step - 1, most)
        if len(before) >= a and len(after) >= LENGTH - b:
            yield xxhash.xxh64_intdigest(struct.pack("<qhh", h, a, b) + before[:a] + after[: LENGTH - b]) - (1 << 63), a, b


def _judged(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[pa.Table, np.ndarray | None, np.ndarray | None]]:
    """Sorted anchors in blocks of whole groups, and how far before and after each is covered.

    A group beyond a block goes on with one row of each surroundings seen so far, marked as judged. Where these
    would fill half a block, they and the rest of their group come out with None: they are to be narrowed.
    """

    def judge(table: pa.Table):
        h, least, most = (table[c].to_numpy() for c in ("h", "least", "most"))
        left, right, fresh = covered(h, table["before"].to_pylist(), table["after"].to_pylist(), least, most)
        return left, np.where(table["judged"].to_numpy(zero_copy_only=False), 0, right), fresh

    held, n, over = [], 0, None
    for batch in batches:
        if over is not None:
            at = int(np.searchsorted(batch.column("h").to_numpy() != over, True)) if batch.num_rows else 0
            if at:
                yield pa.Table.from_batches([batch.slice(0, at)]), None, None
            batch = batch.slice(at)
            over = None if batch.num_rows else over
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < block:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = _last_start(table, ["h"])
        if cut:
            part, rest = table.slice(0, cut), table.slice(cut)
            yield part, *judge(part)[:2]
        else:
            left, right, fresh = judge(table)
            yield table, left, right
            rest = table.filter(pa.array(fresh))
            seen = rest.schema.get_field_index("judged")
            rest = rest.set_column(seen, rest.schema.field(seen), pa.array(np.ones(rest.num_rows, dtype=bool)))
            if rest.num_rows > block // 2:
                over = table["h"][0].as_py()
                yield rest, None, None
                rest = rest.slice(0, 0)
        held, n = rest.combine_chunks().to_batches(), rest.num_rows
    if n:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, *judge(table)[:2]


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Stretches (doc_id, _k, start, stop) of the texts of ``docs`` (doc_id, _k, text) that occur earlier."""
    small_batches(docs.sparkSession)
    id_field = docs.schema["doc_id"]
    field = lambda name, kind: T.StructField(name, kind())
    block = _BLOCK

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, often, total = ["doc_id", "at", "h", "salt"], {}, 0  # often: strings that repeat within batches of this task
        for batch in batches:
            found = [anchors((t or "").encode()) for t in batch.column(1).to_pylist()]
            row = np.repeat(np.arange(len(found)), [len(a) for a, _ in found])
            at = np.concatenate([a for a, _ in found]) if found else np.zeros(0, np.int64)
            h = (np.concatenate([h for _, h in found]) if found else np.zeros(0, np.uint64)).view(np.int64)
            total += h.size
            some, first, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            known = np.array([x in often for x in some.tolist()], dtype=bool)
            again = (count > 1) | known
            stands = (first[inverse] == np.arange(h.size)) & ~known[inverse]
            salt = np.where(again[inverse], np.where(stands, -1, 1 + at % _SALTS), 0)
            for x, m in zip(some[again].tolist(), count[again].tolist(), strict=True):
                often[x] = often.get(x, 0) + m
            if len(often) > _OFTEN:
                often = dict(sorted(often.items(), key=lambda e: -e[1])[: _OFTEN // 2])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(h), pa.array(salt.astype(np.int32))], names)
        hot = [(x, m) for x, m in often.items() if m > total / _HOT / 2]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(hot), field_type), pa.array([min(m, 2**31 - 1) for _, m in hot], pa.int32()), pa.array([x for x, _ in hot], pa.int64()), pa.array([-2] * len(hot), pa.int32())], names
        )

    # salt: 0 once in its batch, -1 the one of several in its task that stands for them, above 0 the others, which needn't be counted; -2 how many of a string a task has
    field_type = to_arrow_type(id_field.dataType)
    rows = docs.select("doc_id", "text").mapInArrow(find, T.StructType([T.StructField("doc_id", id_field.dataType), field("at", T.IntegerType), field("h", T.LongType), field("salt", T.IntegerType)]))
    together = Window.partitionBy("h", F.greatest("salt", F.lit(0)))
    twice = rows.withColumn("n", F.count("*").over(together)).where("n > 1 or salt <> 0")
    counted = F.when(F.col("salt") == -2, F.col("h"))
    flagged = twice.groupBy(F.col("doc_id").alias("_d"), counted.alias("_h")).agg(F.collect_set("at").alias("at"), F.sum("at").alias("n"))  # the document's anchors
    flagged = materialize(flagged, "suffix-anchors")
    total = flagged.where("_h is null").agg(F.sum(F.size("at"))).first()[0] or 0
    hot = {r[0] for r in flagged.where((F.col("_h").isNotNull()) & (F.col("n") > max(block, total // _HOT))).select("_h").collect()}  # about _HOT at most

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts, places = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            row, place, hashes, before, after = [], [], [], [], []
            last = None
            for i in sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, keys[i])):
                if (ids[i], keys[i]) == last:
                    continue  # a repeated row is no second document
                last, data = (ids[i], keys[i]), (texts[i] or "").encode()
                at = np.array(sorted(p for p in places[i] if p + GRAM <= len(data)), dtype=np.int64)
                h, b, a = around(data, at)
                row += [i] * len(at)
                place.append(at)
                hashes.append(h)
                before += b
                after += a
            at, h, row = np.concatenate(place), np.concatenate(hashes).view(np.int64), np.array(row, dtype=np.int64)
            order = np.argsort(h, kind="stable")  # the texts of a string in their order
            stop, live = np.zeros(at.size, dtype=np.int64), np.ones(at.size, dtype=bool)
            bounds = starts(h[order])
            several = np.flatnonzero(np.diff(bounds) > 1)
            picked = np.concatenate([order[bounds[g] : bounds[g + 1]] for g in several]) if several.size else order[:0]
            for lo in range(0, picked.size, block):  # a group cut in two is only settled less
                some = picked[lo : lo + block]
                left, right, fresh = covered(h[some], [before[k] for k in some], [after[k] for k in some], np.zeros(some.size, dtype=np.int64), np.full(some.size, _BEFORE))
                done = some[~fresh]
                live[done] = False
                stop[done] = at[done] + right[~fresh]
                at[done] -= left[~fresh]
            alive = np.flatnonzero(live)
            split = np.isin(h[alive], list(hot)) if hot else np.zeros(alive.size, dtype=bool)
            done, whole = np.flatnonzero(~live & (stop > at)), alive[~split]
            parts = [(k, *p) for k in alive[split].tolist() for p in narrowed(int(h[k]), 0, _BEFORE, before[k], after[k])]
            yield _laid(batch, row, at, before, after, whole, h[whole], np.zeros(whole.size), np.full(whole.size, _BEFORE))
            yield _laid(batch, row, at, before, after, *(np.array([p[i] for p in parts], dtype=np.int64) for i in range(4)))
            take = pa.array(row[done])
            none = pa.nulls(done.size, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h[done]), pa.array((1 + at[done] % _SALTS).astype(np.int32)), batch.column(0).take(take), batch.column(1).take(take), pa.array(at[done].astype(np.int32)),
                    pa.array(stop[done].astype(np.int32)), *(pa.array(np.zeros(done.size, dtype=np.int32)) for _ in range(2)), pa.array(np.zeros(done.size, dtype=bool)), none, none,
                ],
                _NAMES,
            )

    numbers = [field(c, T.IntegerType) for c in ("at", "stop", "least", "most")]
    schema = T.StructType([field("h", T.LongType), field("salt", T.IntegerType), id_field, field("_k", T.LongType), *numbers, field("judged", T.BooleanType), field("before", T.BinaryType), field("after", T.BinaryType)])
    met = docs.join(flagged.where("_h is null"), docs["doc_id"].eqNullSafe(flagged["_d"])).select("doc_id", "_k", "text", "at").mapInArrow(look, schema)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = [batch.column(c).to_pylist() for c in ("h", "least", "most", "before", "after")]
            parts = [(i, *p) for i, row in enumerate(zip(*fields, strict=True)) for p in narrowed(*row)]
            i, h, least, most = (np.array([p[c] for p in parts], dtype=np.int64) for c in range(4))
            take = pa.array(i)
            new = {"h": pa.array(h), "least": pa.array(least.astype(np.int32)), "most": pa.array(most.astype(np.int32))}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c).take(take) for c in _NAMES], _NAMES)

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settled = []

        def open_() -> Iterator[pa.RecordBatch]:
            last = None
            for batch in batches:
                salt = batch.column("salt").to_numpy()
                settled.append(batch.filter(pa.array(salt > 0)))
                live = batch.filter(pa.array(salt == 0))
                if live.num_rows:  # rows of a repeated document stand together
                    prior = live.slice(0, 1) if last is None else last
                    h, k, at = (np.concatenate([prior.column(c).to_numpy(), live.column(c).to_numpy()]) for c in ("h", "_k", "at"))
                    same = (h[1:] == h[:-1]) & (k[1:] == k[:-1]) & (at[1:] == at[:-1])
                    same[0] &= last is not None
                    for i in np.flatnonzero(same).tolist():
                        same[i] = live.column("doc_id")[i] == (live.column("doc_id")[i - 1] if i else prior.column("doc_id")[0])
                    last = live.slice(live.num_rows - 1)
                    yield live.filter(pa.array(~same))

        for table, left, right in _judged(open_(), block):
            while settled:
                yield settled.pop()
            table = table.combine_chunks()
            if left is None:
                out = table.set_column(table.schema.get_field_index("stop"), "stop", pa.array(np.full(table.num_rows, -1, dtype=np.int32)))
            else:
                hit = np.flatnonzero(right > 0)
                out, none = table.take(pa.array(hit)), pa.nulls(hit.size, pa.binary())
                at = out["at"].to_numpy()
                new = {"at": pa.array((at - left[hit]).astype(np.int32)), "stop": pa.array((at + right[hit]).astype(np.int32)), "before": none, "after": none}
                out = pa.table([new[c] if c in new else out[c] for c in _NAMES], _NAMES)
            yield from out.to_batches()
        yield from settled

    found = []
    while True:
        dealt = met.repartition("h", "salt").sortWithinPartitions("h", "salt", "doc_id", "_k", "at")
        part = materialize(dealt.mapInArrow(cover, schema), "suffix-spans")
        if not found:
            discard(flagged)
        found.append(part.where("stop >= 0").select("doc_id", "_k", F.col("at").alias("start"), "stop"))
        over = part.where("stop < 0")
        if over.isEmpty():
            break
        met = over.mapInArrow(narrow, schema)
    return functools.reduce(DataFrame.union, found)


_NAMES = ["h", "salt", "doc_id", "_k", "at", "stop", "least", "most", "judged", "before", "after"]


def _laid(batch: pa.RecordBatch, row: np.ndarray, at: np.ndarray, before: list[bytes], after: list[bytes], which: np.ndarray, h: np.ndarray, least: np.ndarray, most: np.ndarray) -> pa.RecordBatch:
    """The anchors ``which``, to be grouped by ``h``."""
    take, n = pa.array(row[which]), which.size
    zero = pa.array(np.zeros(n, dtype=np.int32))
    some = which.tolist()
    return pa.RecordBatch.from_arrays(
        [
            pa.array(h), zero, batch.column(0).take(take), batch.column(1).take(take), pa.array(at[which].astype(np.int32)), zero, pa.array(least.astype(np.int32)),
            pa.array(most.astype(np.int32)), pa.array(np.zeros(n, dtype=bool)), pa.array([before[k] for k in some], pa.binary()), pa.array([after[k] for k in some], pa.binary()),
        ],
        _NAMES,
    )


def cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of ``data`` without ``spans``, and the spans united where they meet."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    kept, at = [], 0
    for a, b in out:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]]), [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, with_kept: bool = False) -> DataFrame:
    """Remove each byte covered by a string of ``LENGTH`` bytes that also starts earlier.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_kept`` the bytes left. Earlier
    is a smaller doc_id (a null one before all), or in one document an earlier start. A null text is empty.
    Rows that repeat an id with another text follow each other by a hash of the text; rows that repeat
    both are one document and treated alike.
    """
    small_batches(docs.sparkSession)
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_k"), "text")
    lists = repeated_spans(keyed).groupBy(F.col("doc_id").alias("_d"), F.col("_k").alias("_k2")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))  # within one document
    joined = keyed.join(lists, (keyed["_k"] == lists["_k2"]) & keyed["doc_id"].eqNullSafe(lists["_d"]), "left").select("doc_id", "text", "spans.start", "spans.stop")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, many, sha, kept = [], [], [], [], []
            for text, a, b in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                data = (text or "").encode()
                left, found = cut(data, list(zip(a or (), b or (), strict=True)))
                n.append(len(data))
                removed.append(len(data) - len(left))
                many.append(len(found))
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(many, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(kept, pa.binary())] * with_kept], names)

    types = [T.LongType(), T.LongType(), T.LongType(), T.StringType(), *[T.BinaryType()] * with_kept]
    return joined.mapInArrow(run, T.StructType([docs.schema["doc_id"], *(T.StructField(a, b) for a, b in zip(names[1:], types, strict=True))]))
