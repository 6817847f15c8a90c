"""Near-duplicate vectors by p-stable hashing for Euclidean distance.

Normalised vectors are projected on random directions; projections, shifted and cut into cells of one
width, are joined to a bucket per table. Vectors that share a bucket in some table are compared by
cosine in double precision. Equal vectors are one class throughout; a pair is counted in the first table
that brings it together; a task returns counts and a spanning forest, never its pairs. A bucket of any
size is dealt in blocks that meet two by two.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, deal_blocks, discard, local_roots, materialize, small_batches, split_join, starts, whole_groups

COSINE = 0.95
RECALL = 0.99
WIDTH = 2.0
SEED = 7
_BUCKET = 64
_BLOCK = 2048


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that two vectors at a distance fall into one cell of one projection (Datar et al. 2004)."""
    if distance <= 0:
        return 1.0
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Projections a table and tables, so that unrelated vectors (distance sqrt 2) make buckets of about
    ``_BUCKET`` of ``n``, and a pair right at the threshold meets with probability ``recall``."""
    near, far = collision(math.sqrt(2 * (1 - cosine))), collision(math.sqrt(2))
    k = max(1, math.ceil(math.log(max(n / _BUCKET, 1)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))


def codes(unit: np.ndarray, k: int, many: int) -> np.ndarray:
    """Bucket of each row in each table, as a 64-bit mix of its cells.

    Vectors and directions are rounded so that all sums are exact in double precision; so a row's codes
    are the same in whatever matrix it is.
    """
    rng, d = np.random.default_rng([SEED, unit.shape[1]]), unit.shape[1]
    fine = 2.0 ** min(16, 29 - math.ceil(math.log2(max(d, 2))))
    directions = np.round(rng.standard_normal((d, k * many)).clip(-8, 8) * fine) / fine
    cells = np.floor((np.round(unit * 2.0**20) / 2.0**20 @ directions + rng.uniform(0, WIDTH, k * many)) / WIDTH)
    cells = cells.astype(np.int64).view(np.uint64).reshape(len(unit), many, k)
    out = np.zeros((len(unit), many), dtype=np.uint64)
    for i in range(k):
        out = (out ^ cells[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def usable(vector: str):
    """Whether a vector takes part: not null, no null or non-finite component, not zero."""
    return F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size) if size else np.zeros((len(column), 0))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.add.accumulate(x * x, axis=1)[:, -1:]) if x.shape[1] else x  # added up in one order


def _pairs(x: np.ndarray, a: slice, b: slice, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j, i in ``a`` and j in ``b``, whose cosine is at least ``cosine``."""
    unit, norm = _unit(x), np.sqrt((x * x).sum(1))
    out = []
    for at in range(a.start, a.stop, 256):
        i, j = np.nonzero(unit[at : min(at + 256, a.stop)] @ unit[b].T >= cosine - 1e-9)
        i, j = i + at, j + b.start
        i, j = i[i < j], j[i < j]
        keep = (x[i] * x[j]).sum(1) / (norm[i] * norm[j]) >= cosine
        out.append((i[keep], j[keep]))
    return (np.concatenate([p[0] for p in out]), np.concatenate([p[1] for p in out])) if out else (np.zeros(0, int), np.zeros(0, int))


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept (it is its component's smallest id).

    A vector that :func:`usable` rejects links with nothing and stands for itself; vectors of different
    length never link. Rows that repeat an id are vectors of their own. A null id is never a
    component's; its row links, and is not kept.
    """
    small_batches(vectors.sparkSession)
    cls = F.when(usable(vector), F.md5(F.col(vector).cast("string")))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"), cls.alias("cls"))
    ids = materialize(rows.select("vec_id", "cls"), "vectors-ids")
    classes = rows.where("cls is not null").groupBy("cls", "v").agg(F.count("*").alias("mult"), F.min("vec_id").alias("low"))
    classes = materialize(classes.withColumn("d", F.size("v")), "vectors")
    k, many = tables(classes.count(), cosine, recall)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.column(2).to_numpy()
            for size in np.unique(d):
                part = batch.filter(pa.array(d == size))
                found = codes(_unit(_matrix(part.column(1), int(size))), k, many)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(len(part)), many))),
                        pa.array(np.full(found.size, size, dtype=np.int32)),
                        pa.array(np.tile(np.arange(many, dtype=np.int32), len(part))),
                        pa.array(found.ravel().view(np.int64)),
                    ],
                    ["cls", "d", "t", "code"],
                )

    light = classes.select("cls", "v", "d").mapInArrow(hashed, "cls string, d int, t int, code long")
    key = ["d", "t", "code"]
    dealt = deal_blocks(light, key, "cls", _BLOCK, None)
    full = dealt.join(classes.select("cls", "v", "mult"), "cls").select(*key, "_i", "_j", "_b", "cls", "mult", "v")
    full = full.repartition(*key, "_i", "_j").sortWithinPartitions(*key, "_i", "_j", "_b", "cls")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, [*key, "_i", "_j"], 20_000):
            table = table.combine_chunks()
            d, t, code, bi, bj, b = (table.column(x).to_numpy() for x in range(6))
            mult = table.column("mult").to_numpy()
            names = table.column("cls")
            group = starts(d, t, code, bi, bj)
            add, root = np.zeros(len(d), dtype=np.int64), np.arange(len(d))
            values = table.column("v").chunk(0)
            for lo, hi in zip(group[:-1], group[1:], strict=True):
                x = _matrix(values.slice(lo, hi - lo), int(d[lo]))
                m = hi - lo if bi[lo] == bj[lo] else int(np.searchsorted(b[lo:hi], bj[lo]))
                i, j = _pairs(x, slice(0, m), slice(0, m) if bi[lo] == bj[lo] else slice(m, int(hi - lo)), cosine)
                if not i.size:
                    continue
                if t[lo]:
                    involved, inverse = np.unique(np.concatenate([i, j]), return_inverse=True)
                    before = codes(_unit(x[involved]), k, many)[:, : t[lo]]
                    new = np.ones(i.size, dtype=bool)
                    for column in before.T:
                        new &= column[inverse[: i.size]] != column[inverse[i.size :]]
                    i, j = i[new], j[new]
                np.add.at(add, lo + i, mult[lo + j])
                np.add.at(add, lo + j, mult[lo + i])
                root[lo:hi] = lo + local_roots(hi - lo, i, j)
            found = np.flatnonzero(add > 0)
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(found)).combine_chunks(), pa.array(add[found]), names.take(pa.array(root[found])).combine_chunks()], ["cls", "add", "root"]
            )

    met = materialize(full.mapInArrow(compare, "cls string, add long, root string"), "vectors-met")
    forest = components(met.select(F.col("cls").alias("a"), F.col("root").alias("b")), "vectors-links")
    rooted = classes.select("cls", "mult", "low").join(forest, classes.cls == forest.node, "left").select("cls", "mult", "low", F.coalesce("root", "cls").alias("root"))
    rooted = materialize(rooted, "vectors-roots")
    discard(classes, forest)
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    links = met.groupBy("cls").agg(F.sum("add").alias("add"))
    named = split_join(rooted, least, "root").join(links, "cls", "left").select("cls", (F.col("mult") - 1 + F.coalesce("add", F.lit(0))).alias("n_links"), "component_id")
    named = materialize(named, "vectors-named")
    alone = ids.where("cls is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = split_join(ids.where("cls is not null"), named, "cls").select("vec_id", "n_links", "component_id")
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
