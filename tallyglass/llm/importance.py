"""Quality selection by importance resampling over hashed n-grams.

Words, runs of marks and pairs of both are hashed into buckets, and two bag-of-n-gram models are
estimated over them: one of the target text, one of all raw text. A document's log weight is the log
ratio of what the two models give it, the sum over its n-grams. A sample without replacement with
probabilities in proportion to the weights is the k documents with the largest log weight plus Gumbel
noise; the noise is a hash of the document's id, so a run can be repeated.

Both models are counted over all documents, in one pass without a shuffle of text; scoring is another.
The target may be taken from a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small_batches

BUCKETS = 1 << 18
#: Labelled rows whose text makes the target model, at most.
TARGETS = 20_000
SHARE = 0.75
#: Occurrences that both models get in every bucket beside those found, after raw counts are scaled to the target.
SMOOTH = 3.0
SEED = 5
_MEMO = 300_000
_UNITS = re.compile(r"\w+|[^\w\s]+")
_PAIR = np.uint64(0x9E3779B97F4A7C15)


class Hasher:
    """Buckets of the units of a text and of its neighbouring pairs."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.memo = np.uint64(buckets), {}

    def __call__(self, text: str) -> np.ndarray:
        words = _UNITS.findall(text.lower())
        memo = self.memo
        if len(memo) > _MEMO:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh64_intdigest(w, SEED)
        one = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
        two = (one[:-1] * _PAIR) ^ (one[1:] + (one[1:] << np.uint64(7)))
        two ^= two >> np.uint64(31)
        return (np.concatenate([one, two * _PAIR >> np.uint64(20)]) % self.buckets).astype(np.int64)


def models(docs: DataFrame, targets: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of the target model to the raw model per bucket, both smoothed.

    ``targets`` holds the ids of target documents, ``TARGETS`` at most (more are refused). Null ids are
    no targets; null texts add nothing.
    """
    small_batches(docs.sparkSession)
    ids = targets.where("doc_id is not null").distinct()
    if ids.count() > TARGETS:
        raise ValueError(f"more than {TARGETS} target documents")
    marked = docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id", F.lit(True).alias("t"))), "doc_id", "left")  # TARGETS bounds it
    rows = marked.where("text is not null").select("text", F.coalesce("t", F.lit(False)).alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(buckets), {t: np.zeros(buckets, dtype=np.int64) for t in (True, False)}
        for batch in batches:
            held = {True: [], False: []}
            for text, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[t].append(hasher(text))
            for t, x in held.items():
                if x:
                    total[t] += np.bincount(np.concatenate(x), minlength=buckets)
        every = total[True] + total[False]
        found = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(every[found]), pa.array(total[True][found])], ["bucket", "raw", "target"])

    summed = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    out = np.zeros((2, buckets))
    for b, *counts in summed.collect():  # a row a bucket
        out[:, b] = counts
    raw, target = out
    return np.log((target + SMOOTH) / (raw * (target.sum() / max(raw.sum(), 1)) + SMOOTH))


def gumbel(doc_id: object, seed: int) -> float:
    """Standard Gumbel noise from a hash of the id, a number or a text."""
    key = b"" if doc_id is None else struct.pack("<q", doc_id) if isinstance(doc_id, int) else b"=" + str(doc_id).encode()
    u = (xxhash.xxh64_intdigest(key, seed) + 0.5) / 2.0**64
    return float(-np.log(-np.log(u)))


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_grams, mean_ratio (per n-gram), log_weight (their sum) and key (log_weight with noise)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(len(ratio))
        for batch in batches:
            ids = batch.column(0).to_pylist()
            n, total = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids))
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = hasher(text or "")
                n[i], total[i] = found.size, ratio[found].sum()
            noise = np.array([gumbel(i, seed) for i in ids])
            columns = [batch.column(0), pa.array(n), pa.array(total / np.maximum(n, 1)), pa.array(total), pa.array(total + noise)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_grams", "mean_ratio", "log_weight", "key"])

    fields = [("n_grams", T.LongType()), ("mean_ratio", T.DoubleType()), ("log_weight", T.DoubleType()), ("key", T.DoubleType())]
    kept = docs.select("doc_id", "text")
    return kept.mapInArrow(run, T.StructType([kept.schema["doc_id"], *(T.StructField(a, b) for a, b in fields)]))


def top(rows: DataFrame, k: int, key: str = "key", tie: str = "doc_id") -> DataFrame:
    """Append ``kept``: whether a row is among the ``k`` largest by ``key``, ties to smaller ``tie``.

    The edge is found by counting, twelve bits of the ordered number at a time, so the driver sees 4096
    counts a round for any number of rows. Rows that tie in both are kept or not together, so more
    than ``k`` may be kept then; a null ``tie`` comes first; texts tie by a hash. A null key comes last.
    """
    if k <= 0:
        return rows.withColumn("kept", F.lit(False))
    whole = isinstance(rows.schema[tie].dataType, T.IntegralType)
    x = F.coalesce(F.col(key).cast("double"), F.lit(float("-inf"))) + F.lit(0.0)  # no negative zero
    y = F.bitwise_not(F.coalesce(F.col(tie).cast("long") if whole else F.xxhash64(tie), F.lit(-(1 << 63)).cast("long")))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column(0).to_numpy().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)), batch.column(1)], ["x", "y"])

    held = rows.select(x.alias("x"), y.alias("y")).mapInArrow(order, "x long, y long")  # doubles as longs in the same order
    edge, k = _edge(held, "x", k)
    if edge is None:
        return rows.withColumn("kept", F.lit(True))
    least, _ = _edge(held.where(F.col("x") == edge), "y", k)
    bits = np.int64(edge)
    edge = float(np.array(bits ^ np.int64(2**63 - 1) if bits < 0 else bits).view(np.float64))
    return rows.withColumn("kept", (x > edge) | ((x == edge) & (y >= least)))


def _edge(rows: DataFrame, column: str, k: int) -> tuple[int | None, int]:
    """The k-th largest of a column of longs, and how many rows equal to it are among those k; None: there are fewer rows."""
    low = 0
    for shift in (52, 40, 28, 16, 4, 0):
        counts = rows.groupBy(F.shiftright(column, shift).alias("p")).agg(F.count("*")).collect()
        for p, n in sorted(counts, reverse=True):
            low = p << shift
            if k <= n:
                break
            k -= n
        else:
            return None, k
        rows = rows.where(F.col(column).between(low, low + (1 << shift) - 1))
    return low, k


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """Weigh all of ``docs`` and keep the share of them that Gumbel top-k draws.

    The target is the text of up to ``TARGETS`` documents labelled quality 1 and toxic 0, taken by a hash
    of their id. Returns doc_id, n_grams, mean_ratio, log_weight, key, kept. A null or empty text has
    weight 0 in the logarithm. A document with a null id is weighed like any other, and on a tie is kept
    first; rows that repeat an id draw the same noise.
    """
    good = labels.where("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct()
    n = good.count()
    if n > TARGETS:
        part = int(0.9 * TARGETS / n * (1 << 20))
        good = good.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < part)
    ratio = models(docs, good)
    rows = materialize(weigh(docs, ratio, seed), "weights")
    return top(rows, int(share * rows.count()))
