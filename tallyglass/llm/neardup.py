"""Near-duplicates by the exact Jaccard similarity of word shingles: the near-dedup stage of the pipeline.

Candidates come from two sources: the trie self-join of SimHash fingerprints, within a few bits, and bands
of MinHash values, since at a similarity of 0.8 fingerprints of 64 bits differ in too many bits for a trie
to prune. A pair of similarity s shares a band with probability 1 - (1 - s**ROWS)**BANDS, and a full group of a
band gives a largest spanning forest by estimated similarity in place of all its pairs. Every candidate is
then checked on the shingles themselves, and only pairs at or above the similarity are links. Parity maps as long as the sets
rule out nearly all other pairs first, so that few shingles are exchanged.

What these sources leave out is found by prefix filtering, which is exact: in one order of all shingles, a pair at
the similarity has a shingle in common among the first of both. Only texts that are not in one component yet meet, so
that a large group of near copies costs no pairs here, and this is done for a part of the shingles at a time.

Texts with equal shingles are one node.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import clean, components, deal_blocks, discard, materialize, small_batches, starts, whole_groups

WORDS = 5
SIMILARITY = 0.8
BANDS = 16
ROWS = 5
#: Share of equal MinHash values below which a pair isn't checked, under the similarity: five standard deviations.
SLACK = 5 * (0.8 * 0.2 / (BANDS * ROWS)) ** 0.5
_DRAWN = np.random.Generator(np.random.Philox(key=17)).integers(0, 1 << 64, (3, BANDS * ROWS), dtype=np.uint64)
_PART = 1_024
_SMALL = 64
_BLOCK = 8_192
#: Documents whose shingles are counted, at most about; in how many of them a shingle is common; how many are listed at most.
_SAMPLE = 10_000
_OFTEN = 3
_LISTED = 200_000
#: Bits of a set's parity map; it tells little of sets that may differ in over half as many shingles. Larger sets have a wide map too.
_BITS = 1_024
_PAIRS = 1 << 17
#: Places of shingles in prefixes that are exchanged at once, at about, and in how many parts at most.
_PLACES = 1 << 23
_PARTS = 16
#: Classes of document keys, a bit each in a broadcast table of a 64th as many rows at most.
_CLASSES = 1 << 23


def distinct_shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(np.concatenate([*simhash.shingles(text, words), np.zeros(0, dtype="<u8")]))


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """The least value of the shingles under each of the drawn hash functions."""
    out = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, shingles.size, _PART):
        mixed = shingles[None, at : at + _PART] * (_DRAWN[0] | np.uint64(1))[:, None] + _DRAWN[1][:, None]
        np.minimum(out, mixed.min(1), out=out)
    return out


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles that many documents of a sample hold, and how many do.

    They decide the order of shingles alone, by which rare ones come first; the links are the same by any order.
    """
    share = max(1, docs.count() // _SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [distinct_shingles(t, words) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, dtype="<u8")]).view(np.int64))], ["h"])

    counted = docs.where(F.pmod("_k2", F.lit(share)) == 0).select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n"))
    with clean(docs.sparkSession):
        listed = counted.where(F.col("n") >= _OFTEN).orderBy(F.desc("n"), "h").limit(_LISTED).toArrow()
    h, n = listed["h"].to_numpy().view(np.uint64), listed["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first of the sorted shingles by (how common, hash): as many as may be missing from an alike set, and one."""
    many = shingles.size - math.ceil(similarity * shingles.size - 1e-6) + 1
    if common[0].size:
        at = np.minimum(np.searchsorted(common[0], shingles), common[0].size - 1)
        often = np.where(common[0][at] == shingles, common[1][at], 0)
        if often.any():
            shingles = shingles[np.lexsort((shingles, often))]
    return shingles[:many]


def parity(shingles: np.ndarray, bits: int) -> bytes:
    """Of which hashes' last bits, ``bits`` (a power of two) values in all, the set has an odd number."""
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def wide_parity(shingles: np.ndarray) -> bytes:
    """The parity map of a set of over ``_BITS`` shingles, with a bit a shingle at least; else nothing."""
    return parity(shingles, 1 << (shingles.size - 1).bit_length()) if shingles.size > _BITS else b""


def apart(a: bytes, b: bytes) -> int:
    """In how many bits two parity maps differ, at the length of the shorter: the sets differ in as many shingles at least."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    size = min(x.size, y.size)
    x, y = (np.bitwise_xor.reduce(m.reshape(-1, size), 0) for m in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def sketches(docs: DataFrame, words: int, keep: tuple[str, ...], similarity: float) -> DataFrame:
    """``keep`` and, of each text: set (a hash of its shingles), fp, sig (a byte a MinHash value), bands (empty for a text without words),
    n (shingles), bits (its parity map), wide (see :func:`wide_parity`) and prefix."""
    small_batches(docs.sparkSession)
    kept = docs.select(*keep, F.col("text").alias("_text"))
    common = common_shingles(docs, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, fps, sigs, bands, sizes, bits, wide, first = [], [], [], [], [], [], [], []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                found = distinct_shingles(t, words)
                least = minhashes(found)
                sets.append(xxhash.xxh64_intdigest(found.tobytes()))
                fps.append(simhash.majority([found]))
                sigs.append((least >> np.uint64(32)).astype(np.uint8).tobytes())
                bands.append((least * (_DRAWN[2] | np.uint64(1))).reshape(BANDS, ROWS).sum(1, dtype=np.uint64).view(np.int64).tolist() if found.size else [])
                sizes.append(found.size)
                bits.append(parity(found, _BITS))
                wide.append(wide_parity(found))
                first.append(prefix(found, common, similarity).view(np.int64))
            whole = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (sets, fps)]
            whole += [pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), pa.array(wide, pa.binary()), pa.array(first, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *whole], [*keep, "set", "fp", "sig", "bands", "n", "bits", "wide", "prefix"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{head}, set long, fp long, sig binary, bands array<long>, n long, bits binary, wide binary, prefix array<long>")


def forest(sig: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of a largest spanning forest by the share of equal bytes, of pairs at ``least`` or more."""
    n = len(sig)
    near, via, open_ = np.full(n, -1.0), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    a, b, at = [], [], 0
    for _ in range(n - 1):
        open_[at] = False
        rest = np.flatnonzero(open_)
        same = (sig[rest] == sig[at]).mean(1)
        more = rest[same > near[rest]]
        near[more], via[more] = same[same > near[rest]], at
        at = rest[near[rest].argmax()]
        if near[at] >= least:
            a.append(via[at])
            b.append(at)
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def band_pairs(nodes: DataFrame, similarity: float) -> DataFrame:
    """Candidate pairs (a, b) of the sets that share a band; not all that are alike, see :func:`missed_pairs`."""
    items = nodes.select("set", "sig", F.posexplode("bands").alias("band", "v"))
    dealt = deal_blocks(items, ["band", "v"], "set", _BLOCK, ["set"]).select("band", "v", "_i", "_j", "set", "sig")
    least = similarity - SLACK

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["band", "v", "_i", "_j"], 20_000):
            band, v, i, j, sets = (table.column(x).to_numpy() for x in range(5))
            sig = np.frombuffer(b"".join(table.column(5).to_pylist()), dtype=np.uint8).reshape(-1, BANDS * ROWS)
            group = starts(band, v, i, j)
            a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for lo, hi in zip(group[:-1].tolist(), group[1:].tolist(), strict=True):
                if hi - lo <= _SMALL:
                    x, y = np.triu_indices(hi - lo, 1)
                    near = (sig[lo + x] == sig[lo + y]).mean(1) >= least
                    x, y = x[near], y[near]
                else:
                    x, y = forest(sig[lo:hi], least)
                a.append(sets[lo + x])
                b.append(sets[lo + y])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return dealt.mapInArrow(pairs, "a long, b long")


def fingerprint_pairs(nodes: DataFrame, least: DataFrame, budget: int) -> DataFrame:
    """Candidate pairs (a, b) of sets whose fingerprints are equal, or linked by the trie join; ``least`` has each fp's smallest set as low."""
    low = lambda c: least.select(F.col("fp").alias(f"_{c}"), F.col("low").alias(c))
    linked = simhash.links(least.select("fp"), least.count(), budget).toDF("_a", "_b")
    return nodes.join(least, "fp").select(F.col("set").alias("a"), F.col("low").alias("b")).union(linked.join(low("a"), "_a").join(low("b"), "_b").select("a", "b"))


def shared_places(nodes: DataFrame, joined: DataFrame, similarity: float, parts: int, part: int) -> DataFrame:
    """Places in prefixes (w, set, n, pos, root, and _n of them a shingle w), of the shingles of one part, where an alike set of another component may meet.

    A set x at place ``pos`` of a shingle is alike none of more shingles than ``(1 + s) / s * (n - pos) - n``, nor of fewer than ``s * n``, so one
    goes where its neighbours by size in the shingle's group are out of these bounds.
    """
    own = F.expr(f"filter(transform(prefix, (w, i) -> struct(i AS pos, w)), x -> pmod(x.w, {parts}) = {part})")
    some = nodes.select("set", "n", own.alias("own")).where(F.size("own") > 0)
    rooted = some.join(joined, some.set == joined.node, "left").select("set", "n", F.coalesce("root", "set").alias("root"), F.inline("own"))
    group = Window.partitionBy("w")
    most = (1 + similarity) / similarity * (F.col("n") - F.col("pos")) - F.col("n") + 1e-3
    sized = rooted.select("*", F.lag("n").over(group.orderBy("n")).alias("less"), F.lead("n").over(group.orderBy("n")).alias("more"))
    sized = sized.where((F.col("more") <= most) | (F.col("less") >= similarity * F.col("n") - 1e-3))
    met = sized.select("w", "set", "n", "pos", "root", F.min("root").over(group).alias("low"), F.max("root").over(group).alias("high"), F.count("*").over(group).alias("_n"))
    return met.where("low <> high").drop("low", "high")


def missed_pairs(nodes: DataFrame, joined: DataFrame, similarity: float) -> list[DataFrame]:
    """Tables of candidate pairs (a, b) of sets in different components: every such pair at ``similarity`` or more is in one of them.

    Sets that share a shingle of their prefixes meet. A pair is left out only where the shingles from there on are too few
    (its first common shingle is shared too, and decides), or where the parity maps differ in more bits than the sets
    may differ in shingles. Each table has the pairs that meet on one part of the shingles.
    """
    places = nodes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    parts = min(max(1, -(-places // _PLACES)), _PARTS)
    return [_missed(nodes, joined, similarity, parts, part) for part in range(parts)]


def _missed(nodes: DataFrame, joined: DataFrame, similarity: float, parts: int, part: int) -> DataFrame:
    shared = materialize(shared_places(nodes, joined, similarity, parts, part), "neardup-shared")
    dealt = deal_blocks(shared.join(nodes.select("set", "bits"), "set"), ["w"], "set", _BLOCK, ["set"]).select("w", "_i", "_j", "_b", "set", "n", "pos", "root", "bits")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["w", "_i", "_j"], 20_000):
            w, i, j, block, sets, n, pos, root = (table.column(x).to_numpy() for x in range(8))
            bits = np.frombuffer(b"".join(table.column(8).to_pylist()), dtype=np.uint64).reshape(-1, _BITS // 64)
            group = starts(w, i, j)
            number = np.repeat(np.arange(group.size - 1), np.diff(group))
            order = np.lexsort((root, number))
            run = starts(number, root[order])
            after = np.repeat(run[1:], np.diff(run))  # where the next root of the group starts
            many = group[1:][number] - after
            ends = np.cumsum(many)
            a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], _PAIRS)), many.size)).tolist()
            for lo, hi in itertools.pairwise(cuts):
                x = np.repeat(np.arange(lo, hi), many[lo:hi])
                y = after[x] + np.arange(x.size) - np.repeat(ends[lo:hi] - many[lo:hi] - (ends[lo] - many[lo]), many[lo:hi])
                x, y = order[x], order[y]
                both = n[x] + n[y]
                need = similarity / (1 + similarity) * both - 1e-6  # shingles that an alike pair shares
                near = ((i[x] == j[x]) | (block[x] != block[y])) & (np.minimum(n[x] - pos[x], n[y] - pos[y]) >= need)
                x, y, most = x[near], y[near], (both - 2 * need)[near]
                near = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64) <= most
                x, y = sets[x[near]], sets[y[near]]
                a.append(np.minimum(x, y))
                b.append(np.maximum(x, y))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    found = materialize(dealt.mapInArrow(pairs, "a long, b long").distinct(), "neardup-met")
    discard(shared)
    return found


def among(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a key _k of ``named``, and few others, picked where they lie: texts that no one asks for aren't exchanged."""
    at = f"pmod(_k, {_CLASSES}L)"
    marks = named.select(F.expr(f"{at} div 64").alias("_w"), F.expr(f"shiftleft(1L, cast({at} % 64 AS int))").alias("_m")).groupBy("_w").agg(F.bit_or("_m").alias("_m"))
    marked = docs.withColumn("_w", F.expr(f"{at} div 64")).join(F.broadcast(marks), "_w")
    return marked.where(F.expr(f"bit_get(_m, cast({at} % 64 AS int)) = 1")).drop("_w", "_m")


def screened(nodes: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) but those whose parity maps differ in more bits than alike sets may differ in shingles."""
    side = lambda c: nodes.select(F.col("set").alias(c), F.col("n").alias(f"n{c}"), F.when(F.length("wide") > 0, F.col("wide")).otherwise(F.col("bits")).alias(f"p{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            most = both - 2 * (similarity / (1 + similarity) * both - 1e-6)
            near = [apart(x, y) <= m for x, y, m in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), most.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a long, b long")


def links(docs: DataFrame, nodes: DataFrame, candidates: DataFrame, words: int, similarity: float) -> DataFrame:
    """A table of the candidate pairs whose shingles have a Jaccard similarity of ``similarity`` or more."""
    both = candidates.where("a <> b")
    both = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = materialize(screened(nodes, both, similarity), "neardup-pairs")
    if pairs.isEmpty():
        return pairs
    named = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
    named = materialize(nodes.join(named, "set", "left_semi").select("set", "_k", "_k2"), "neardup-named")
    texts = among(docs.select("_k", "_k2", "text"), named).join(named, ["_k", "_k2"]).dropDuplicates(["_k", "_k2"]).select("set", "text")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [distinct_shingles(t, words).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["set", "h"])

    held = materialize(texts.mapInArrow(shingled, "set long, h binary"), "neardup-shingles")
    side = lambda c: held.select(F.col("set").alias(c), F.col("h").alias(f"h{c}"))

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
                same = np.intersect1d(x, y, assume_unique=True).size
                near.append(same >= similarity * (x.size + y.size - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    found = materialize(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ha", "hb").mapInArrow(checked, "a long, b long"), "neardup-alike")
    discard(pairs, named, held)
    return found


def deduplicate(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, budget: int = simhash.BUDGET) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component of links the document with the smallest doc_id.

    Texts without words are alike. Null ids, repeated ids and repeated rows are as in :func:`simhash.deduplicate`.
    """
    columns = docs.columns
    keyed = docs.withColumn("_k", F.xxhash64("doc_id", "text")).withColumn("_k2", F.xxhash64("text", "doc_id"))
    prints = materialize(sketches(keyed, words, ("doc_id", "_k", "_k2"), similarity), "neardup")
    nodes = prints.groupBy("set").agg(F.min(F.struct("_k", "_k2", "fp", "sig", "bands", "n", "bits", "wide", "prefix")).alias("x")).select("set", "x.*")
    nodes = materialize(nodes, "neardup-sets")
    members = materialize(prints.select("set", "doc_id", "_k", "_k2"), "neardup-members")
    discard(prints)
    least = materialize(nodes.groupBy("fp").agg(F.min("set").alias("low")), "neardup-prints")
    quick = links(keyed, nodes, band_pairs(nodes, similarity).union(fingerprint_pairs(nodes, least, budget)), words, similarity)
    joined = components(quick, "neardup-links")
    discard(least, quick)
    met = missed_pairs(nodes, joined, similarity)
    missed = links(keyed, nodes, reduce(DataFrame.union, met), words, similarity)
    discard(nodes, *met)
    if not missed.isEmpty():
        first, joined = joined, components(joined.toDF("a", "b").union(missed), "neardup-links")
        discard(first)
    rooted = members.join(joined, members.set == joined.node, "left").withColumn("root", F.coalesce("root", "set"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k", "_k2")
    stay = materialize(rooted.groupBy("root").agg(F.min(order).alias("x")).select("x._k", "x._k2"), "neardup-stay")
    discard(members, missed, joined)
    return keyed.join(stay, ["_k", "_k2"], "left_semi").dropDuplicates(["_k", "_k2"]).select(*columns)
