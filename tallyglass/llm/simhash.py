"""SimHash near-duplicates: fingerprints, and their links by a self-join of binary tries.

Two fingerprints that differ in at most ``budget`` bits agree on whole blocks of bits, so each is put
under several orders of its blocks, and only those that agree on the leading blocks meet: they are one
subtree of the trie of that order. A subtree is joined with itself by traversing node pairs together
from its root; each level adds a bit where the two sides part, and a pair beyond the budget is pruned.
Equal fingerprints are one leaf. Only a spanning forest of the links found leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, deal_blocks, discard, local_roots, materialize, small_batches, split_join, starts, whole_groups

WORDS = 4
BUDGET = 4
SEED = 42
_BLOCK = 16_384
_LEAF = 64
_FRONTIER = 500_000


def shingles(text: str | None, words: int = WORDS) -> Iterator[np.ndarray]:
    """Hashes of the shingles of ``words`` words (of all words where they are fewer), repeats included, in parts; none for a text without words."""
    found = (text or "").encode().lower().split()  # bytes: lowers A-Z, splits at space and \x09-\x0d
    if not found:
        return
    n = max(1, len(found) - words + 1)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    stops = ends[words - 1 :] if len(found) >= words else ends[-1:]
    h = xxhash.xxh64_intdigest
    begins, stops = begins[:n].tolist(), stops.tolist()
    for at in range(0, n, 65_536):
        yield np.array([h(joined[a:b], SEED) for a, b in zip(begins[at : at + 65_536], stops[at : at + 65_536], strict=True)], dtype="<u8")


def majority(parts: Iterable[np.ndarray]) -> int:
    """Bits set in over half the hashes of ``parts``."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for part in parts:
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += part.size
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist()))


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Bits set in over half the hashes of the shingles, repeats included; 0 for a text without words."""
    return majority(shingles(text, words))


def fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the fingerprint as a signed 64-bit number; one pass over the texts."""
    small_batches(docs.sparkSession)
    kept = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch.column(batch.num_columns - 1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], [*keep, "fp"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{head}, fp long")


def _orders(n: int, budget: int) -> tuple[list[list[tuple[int, int]]], int]:
    """Orders of the bit blocks, as (shift right, width) from the top, and how many lead.

    With budget + e blocks, two fingerprints within the budget agree on e blocks at least; e is as
    large as makes the groups of ``n`` random fingerprints small.
    """
    for extra in range(1, 5):
        m = budget + extra
        cuts = [64 * i // m for i in range(m + 1)]
        blocks = [(64 - cuts[i + 1], cuts[i + 1] - cuts[i]) for i in range(m)]
        lead = extra
        if n / 2 ** min(sum(sorted(w for _, w in blocks)[:lead]), 62) <= _BLOCK:
            break
    return [[*(blocks[i] for i in c), *(blocks[i] for i in range(m) if i not in c)] for c in combinations(range(m), lead)], lead


def _reordered(blocks: list[tuple[int, int]]):
    out, left = F.lit(0).cast("long"), 64
    for shift, width in blocks:
        left -= width
        part = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(part, left))
    return out


def _bit_split(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """First place in each sorted range where the bit is set; above it the range's keys agree."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        on = np.zeros(lo.size, dtype=bool)
        on[open_] = keys[mid[open_]] & bit[open_] != 0
        hi = np.where(open_ & on, mid, hi)
        lo = np.where(open_ & ~on, mid + 1, lo)
    return lo


def trie_links(keys: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, bit: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``keys`` linked between the subtrees at [a, a_end) and [b, b_end), or within one where they are the same.

    Keys are sorted within each subtree and agree above ``bit`` (a power of two) there. Node pairs go
    down a level together, with the bits that differ so far; small pairs are compared key by key.
    """
    todo = [(a, a_end, b, b_end, bit, np.zeros(a.size, dtype=np.int64))]
    while todo:
        a, a_end, b, b_end, bit, off = todo.pop()
        if a.size > _FRONTIER:
            half = a.size // 2
            todo += [tuple(x[half:] for x in (a, a_end, b, b_end, bit, off)), tuple(x[:half] for x in (a, a_end, b, b_end, bit, off))]
            continue
        small = ((a_end - a) * (b_end - b) <= _LEAF) | (bit == 0)
        if small.any():
            yield from _compare(keys, a[small], a_end[small], b[small], b_end[small], budget)
            a, a_end, b, b_end, bit, off = (x[~small] for x in (a, a_end, b, b_end, bit, off))
        if not a.size:
            continue
        same = a == b
        am = _bit_split(keys, a, a_end, bit)
        bm = np.where(same, am, b)
        bm[~same] = _bit_split(keys, b[~same], b_end[~same], bit[~same])
        down = bit >> np.uint64(1)
        sides = [(a, am, b, bm, 0, None), (am, a_end, bm, b_end, 0, None), (a, am, bm, b_end, 1, None), (am, a_end, b, bm, 1, ~same)]
        parts = []
        for p, p_end, q, q_end, more, ok in sides:
            go = (p < p_end) & (q < q_end) & (off + more <= budget)
            if ok is not None:
                go &= ok
            parts.append((p[go], p_end[go], q[go], q_end[go], down[go], off[go] + more))
        todo.append(tuple(np.concatenate(x) for x in zip(*parts, strict=True)))


def _compare(keys: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    width = b_end - b
    total = (a_end - a) * width
    for at in range(0, total.size, 1 << 16):
        n = total[at : at + (1 << 16)]
        row = np.repeat(np.arange(at, at + n.size), n)
        i = np.arange(row.size) - np.repeat(np.cumsum(n) - n, n)
        x, y = a[row] + i // width[row], b[row] + i % width[row]
        keep = x != y
        keep &= (x < y) | (a[row] != b[row])
        keep[keep] = np.bitwise_count(keys[x[keep]] ^ keys[y[keep]]) <= budget
        yield x[keep], y[keep]


def links(fps: DataFrame, n: int, budget: int = BUDGET) -> DataFrame:
    """Spanning links (a, b) of the distinct fingerprints ``fp``: components over them are those over all links."""
    orders, lead = _orders(n, budget)
    leading = [sum(w for _, w in o[:lead]) for o in orders]
    each = F.array(*[F.struct(F.lit(i).alias("o"), _reordered(o).alias("k"), F.lit(leading[i]).alias("w")) for i, o in enumerate(orders)])
    items = fps.select("fp", F.explode(each).alias("x")).select("fp", "x.o", "x.k", F.expr("shiftrightunsigned(x.k, 64 - x.w)").alias("p"))
    dealt = deal_blocks(items, ["o", "p"], "fp", _BLOCK, ["k"]).select("o", "p", "_i", "_j", "_b", "k", "fp")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["o", "p", "_i", "_j"], 200_000):
            o, p, i, j, b, k, fp = (table.column(x).to_numpy() for x in range(7))
            keys = k.view(np.uint64)
            group = starts(o, p, i, j)
            first, end = group[:-1], group[1:]
            cut = end.copy()  # where the second block starts
            two = np.flatnonzero(i[first] != j[first])
            for g in two:
                cut[g] = first[g] + np.searchsorted(b[first[g] : end[g]], j[first[g]])
            other, other_end = np.where(cut < end, cut, first), end.copy()
            one = i[first] == j[first]
            go = one | ((first < cut) & (cut < end))
            bit = np.left_shift(np.uint64(1), np.array([63 - w for w in leading], dtype=np.uint64)[o[first]])
            x, y = [], []
            root = np.arange(keys.size)
            for u, v in trie_links(keys, first[go], np.where(one, end, cut)[go], other[go], other_end[go], bit[go], budget):
                x.append(u)
                y.append(v)
                if sum(map(len, x)) > 4_000_000:  # a dense group: its forest so far stands for its links
                    root = local_roots(keys.size, np.concatenate([*x, np.arange(keys.size)]), np.concatenate([*y, root]))
                    x, y = [], []
            root = local_roots(keys.size, np.concatenate([*x, np.arange(keys.size)]), np.concatenate([*y, root]))
            found = np.flatnonzero(root != np.arange(keys.size))
            yield pa.RecordBatch.from_arrays([pa.array(fp[found]), pa.array(fp[root[found]])], ["a", "b"])

    return dealt.mapInArrow(join, "a long, b long")


def groups(docs: DataFrame, words: int = WORDS, budget: int = BUDGET, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each row of ``docs``: ``keep``, fp, root (a fingerprint that names the component) and component_id.

    ``keep`` has doc_id; component_id is the smallest doc_id of the component. Documents link if their
    fingerprints differ in at most ``budget`` bits. A null or empty text has fingerprint 0 and links like
    any other. A null doc_id is never a smallest id; a component of such documents alone has
    component_id null. Repeated rows have equal fingerprints and so one component.
    """
    prints = materialize(fingerprints(docs, words=words, keep=keep), "simhash")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    forest = components(links(distinct.select("fp"), distinct.count(), budget), "simhash-links")
    rooted = distinct.join(forest, distinct.fp == forest.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "simhash-roots")
    discard(distinct, forest)
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = split_join(rooted, least, "root").select("fp", "root", "component_id")
    return split_join(prints, named, "fp").select(*keep, "fp", "root", "component_id")


def deduplicate(docs: DataFrame, words: int = WORDS, budget: int = BUDGET) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the document with the smallest doc_id.

    A document with a null id stays only where its component has no other; of several, and of different
    texts of one id, the one with the smallest hash stays. Of repeated rows one stays.
    """
    columns = docs.columns
    keyed = docs.withColumn("_k", F.xxhash64("doc_id", "text")).withColumn("_k2", F.xxhash64("text", "doc_id"))
    found = groups(keyed, words, budget, ("doc_id", "_k", "_k2"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k", "_k2")
    stay = materialize(found.groupBy("root").agg(F.min(order).alias("x")).select("x._k", "x._k2"), "simhash-stay")
    return keyed.join(stay, ["_k", "_k2"], "left_semi").dropDuplicates(["_k", "_k2"]).select(*columns)
