"""Approximate nearest neighbours by inner product with an inverted multi-index.

Each half of a vector is quantised with its own codebook, so a pair of centroids is a cell, and a cell has
the list of its entries. What a query may score in a cell is estimated from above: the inner products with
its two centroids, and for each a margin from how far the entries of the centroid lie from it. A query takes cells by
falling sum of the two estimates with a heap. It first takes the cells that hold ``FIRST`` entries, and
reranks those on the original vectors; then all cells whose estimate reaches the k-th best score found so.
So the share of a table that a query reads follows from the data: little where vectors form clusters, much
where they have no order, and all of a table with fewer rows than asked for.

Cells are dealt to shards of bounded size, a full cell to several; a query goes to the shards that hold its
cells, with the list of those. A shard holds its entries and streams its queries, so neither a cell nor
the queries of one meet in memory, and no entry is sent twice in a round. Each length of vectors has an index of its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches, starts
from .lsh import usable

NEAREST = 20
#: Centroids of a half, at most; there are as many as make cells of about ``CELL`` entries.
CENTROIDS = 512
CELL = 16
SAMPLE = 20_000
#: Entries that give the first k scores of a query.
FIRST = 200
#: Margin of an estimate, in deviations of a centroid's entries (far ones weigh more); None: their largest distance, so that answers are exact.
MARGIN = 1.75
SEED = 11
_SHARD = 8_192
_TOGETHER = 256


def codebook(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k-means centroids of ``x``; a centroid that loses its points stays where it is."""
    rng = np.random.default_rng(SEED)
    centers = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = assign(x, centers)
        count = np.bincount(near, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, near, x)
        centers[count > 0] = total[count > 0] / count[count > 0, None]
    return centers


def assign(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Nearest centroid of each row."""
    return ((centers * centers).sum(1) - 2 * x @ centers.T).argmin(1) if len(x) else np.zeros(0, dtype=np.int64)


def traverse(a: np.ndarray, b: np.ndarray, sizes: list[int], least: int, floor: float) -> list[int]:
    """Cells (i * len(b) + j) that aren't empty by falling a[i] + b[j], until they hold ``least`` entries and the sum is under ``floor``."""
    ia, ib = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
    sa, sb = a[ia].tolist(), b[ib].tolist()
    heap, deep, wide = [(-(sa[0] + sb[0]), 0, 0)], len(sb), len(sa)
    out, have, push, pop = [], 0, heapq.heappush, heapq.heappop
    while heap:
        total, i, j = pop(heap)
        if have >= least and -total < floor:
            break
        cell = ia[i] * deep + ib[j]
        if sizes[cell]:
            out.append(cell)
            have += sizes[cell]
        if j + 1 < deep:
            push(heap, (-(sa[i] + sb[j + 1]), i, j + 1))
        if j == 0 and i + 1 < wide:
            push(heap, (-(sa[i + 1] + sb[0]), i + 1, 0))
    return out


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products added up from the first component on, alike for equal rows wherever they are."""
    return np.add.accumulate(x * q, axis=1)[:, -1]


@dataclass
class Index:
    """The codebooks of one length of vectors, and where the entries of each cell are."""

    books: list[np.ndarray]
    margin: list[np.ndarray] | None = None
    sizes: list[int] | None = None
    shard: np.ndarray | None = None
    pieces: np.ndarray | None = None

    @classmethod
    def fit(cls, sample: np.ndarray, dim: int, n: int, most: int) -> Index:
        half = max(1, dim // 2)
        k = max(1, min(most, int(np.ceil(np.sqrt(n / CELL)))))
        return cls([codebook(x, k) if len(x) else np.zeros((1, x.shape[1])) for x in (sample[:, :half], sample[:, half:])])

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.books[0].shape[1]
        return x[:, :half], x[:, half:]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row, and the squared distances of its halves from their centroids."""
        parts = self.halves(x)
        near = [assign(p, book) for p, book in zip(parts, self.books, strict=True)]
        far = [((p - book[c]) ** 2).sum(1) for p, book, c in zip(parts, self.books, near, strict=True)]
        return near[0] * len(self.books[1]) + near[1], np.stack(far, axis=1)

    def settle(self, cell: np.ndarray, n: np.ndarray, total: np.ndarray, squares: np.ndarray, most: np.ndarray, margin: float | None, shard: int) -> int:
        """Take of each cell its count and the sum, squares' sum and largest of the squared distances of both halves; deal cells to shards from ``shard`` on, and return the next free one."""
        count = np.zeros(len(self.books[0]) * len(self.books[1]), dtype=np.int64)
        count[cell] = n
        self.sizes, self.margin = count.tolist(), []
        for h, (c, book) in enumerate(zip(np.divmod(cell, len(self.books[1])), self.books, strict=True)):
            if margin is None:
                far = np.zeros(len(book))
                np.maximum.at(far, c, most[:, h])
                self.margin.append(np.sqrt(far) * (1 + 1e-9))
            else:
                two, four = (np.bincount(c, weights=x[:, h], minlength=len(book)) for x in (total, squares))
                self.margin.append(margin * np.sqrt(four / np.maximum(two, 1e-300) / max(1, book.shape[1])))
        self.shard, self.pieces = np.zeros(count.size, dtype=np.int32), np.ones(count.size, dtype=np.int32)
        room = _SHARD
        for c in np.flatnonzero(count).tolist():
            if (size := self.sizes[c]) > room:
                shard, room = shard + (room < _SHARD), _SHARD
            self.shard[c] = shard
            if size > room:
                self.pieces[c] = -(-size // _SHARD)
                shard += int(self.pieces[c])
            else:
                room -= size
        return shard + 1

    def walk(self, q: np.ndarray, floor: np.ndarray) -> list[list[int]]:
        """The cells that each query takes."""
        a, b = (p @ book.T + np.sqrt((p * p).sum(1, keepdims=True)) * far for p, book, far in zip(self.halves(q), self.books, self.margin, strict=True))
        floor = np.where(np.isfinite(floor), np.nextafter(floor, -np.inf) - 1e-9 * np.abs(np.where(np.isfinite(floor), floor, 0)), floor)
        return [traverse(x, y, self.sizes, FIRST, f) for x, y, f in zip(a, b, floor, strict=True)]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _best(ids: np.ndarray, x: np.ndarray, rough: np.ndarray, q: np.ndarray, own: int, floor: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest inner products from ``floor`` on over rows whose id isn't ``own``, ties to smaller ids; ``rough`` is -inf for rows not taken."""
    rough[ids == own] = -np.inf
    edge = max(floor, np.partition(rough, rough.size - k)[rough.size - k] if rough.size > k else -np.inf)
    keep = np.flatnonzero((rough >= edge - 1e-9 * max(1.0, abs(edge))) & (rough > -np.inf)) if edge > -np.inf else np.flatnonzero(rough > -np.inf)
    score = inner(x[keep], q)
    keep, score = keep[score >= floor], score[score >= floor]
    order = np.lexsort((ids[keep], -score))[:k]
    return ids[keep][order], score[order]


def _rerank(entries: tuple[np.ndarray, np.ndarray, np.ndarray], queries: pa.RecordBatch, dim: int, k: int) -> pa.RecordBatch:
    """Follow the queries' lists of cells through the entries (ids, vectors, cells; sorted by cell)."""
    ids, x, cells = entries
    ends = starts(cells)
    at = dict(zip(cells[ends[:-1]].tolist(), zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True), strict=True))
    asked, floor = queries.column("id").to_numpy(), queries.column("floor").to_numpy()
    q = _matrix(queries.column("v"), dim)
    lists = queries.column("cells")
    out: list[list] = [[], [], []]
    for lo in range(0, len(asked), _TOGETHER):
        part = q[lo : lo + _TOGETHER]
        some = lists.slice(lo, len(part))
        listed = some.flatten().to_numpy()
        row = np.repeat(np.arange(len(part)), some.value_lengths().to_numpy())
        order = np.argsort(listed, kind="stable")
        listed, row = listed[order], row[order]
        rough = np.full((len(part), len(ids)), -np.inf)
        bounds = starts(listed)
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if here := at.get(int(listed[i])):
                rough[row[i:j], here[0] : here[1]] = part[row[i:j]] @ x[here[0] : here[1]].T
        for i in range(len(part)):
            near, score = _best(ids, x, rough[i], part[i], int(asked[lo + i]), float(floor[lo + i]), k)
            out[0].append(np.full(len(near), lo + i))
            out[1].append(near)
            out[2].append(score)
    who = pa.array(np.concatenate(out[0]).astype(np.int64))
    return pa.RecordBatch.from_arrays([queries.column("id").take(who), queries.column("same").take(who), pa.array(np.concatenate(out[1])), pa.array(np.concatenate(out[2]))], ["query_id", "same", "vec_id", "score"])


def search(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, margin: float | None = MARGIN, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest of ``vectors`` for each of ``queries``: query_id, rank, vec_id, score.

    With ``margin`` None the answer is exact. Vectors that aren't usable and rows with a null id take no
    part. A query meets vectors of its own length, all of them where there are no more than ``k``. Rows that repeat an id and its vector count
    once; a query never gets its own id; rows of one id with different vectors are queries of their own.
    Codebooks are fitted on about ``SAMPLE`` rows at most, taken by a hash of the id; every row is indexed, and the
    margins come from all rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    pick = lambda df: df.where(F.col(vec_id).isNotNull() & usable(vector)).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).distinct()
    rows = materialize(pick(vectors).withColumn("d", F.size("v")), "vectors")
    counts = {r[0]: r[1] for r in rows.groupBy("d").agg(F.count("*")).collect()}  # a row a length
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    each = max(1, SAMPLE // len(counts))
    order, part = F.xxhash64("id", F.lit(SEED)), 1 << 20
    shares = F.create_map(*[F.lit(int(x)) for d, n in counts.items() for x in (d, min(1.0, each / n) * part)])
    taken: dict[int, list] = {d: [] for d in counts}
    for r in rows.where(F.pmod(order, F.lit(part)) < shares[F.col("d")]).orderBy("d", order, "id").select("d", "v").collect():
        taken[r[0]].append(r[1])
    most = max(1, int(CENTROIDS / np.sqrt(len(counts))))
    index = {d: Index.fit(np.array(taken[d][:each], dtype=np.float64).reshape(-1, d), d, n, most) for d, n in counts.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.column(2).to_numpy()
            for dim in np.unique(d).tolist():
                some = batch.filter(pa.array(d == dim))
                cells, far = index[dim].place(_matrix(some.column(1), dim))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cells.astype(np.int32)), pa.array(far[:, 0]), pa.array(far[:, 1])], ["id", "v", "d", "cell", "far1", "far2"])

    entries = materialize(rows.mapInArrow(place, "id long, v array<double>, d int, cell int, far1 double, far2 double"), "index")
    discard(rows)
    held = entries.groupBy("d", "cell").agg(F.count("*").alias("n"), F.sum("far1").alias("s1"), F.sum("far2").alias("s2"), F.sum(F.col("far1") * F.col("far1")).alias("f1"), F.sum(F.col("far2") * F.col("far2")).alias("f2"), F.max("far1").alias("m1"), F.max("far2").alias("m2")).toPandas()  # CENTROIDS ** 2 cells at most
    shards = 0
    for d, some in held.groupby("d"):
        shards = index[int(d)].settle(some["cell"].to_numpy(), some["n"].to_numpy(), some[["s1", "s2"]].to_numpy(), some[["f1", "f2"]].to_numpy(), some[["m1", "m2"]].to_numpy(), margin, shards)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, d, cell = (batch.column(i).to_numpy() for i in (0, 2, 3))
            shard = np.zeros(len(ids), dtype=np.int32)
            for dim in np.unique(d).tolist():
                at = d == dim
                some = index[dim]
                mixed = (ids[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                shard[at] = some.shard[cell[at]] + (mixed % some.pieces[cell[at]].astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), *(batch.column(i) for i in range(4))], ["s", "id", "v", "d", "cell"])

    def ask(asked: DataFrame) -> DataFrame:
        """Best scores of the cells that each of ``asked`` (id, same, v, d, floor) takes."""

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d, floor = batch.column(3).to_numpy(), batch.column(4).to_numpy()
                for dim in np.unique(d).tolist():
                    some = batch.filter(pa.array(d == dim))
                    found = index[dim].walk(_matrix(some.column(2), dim), floor[d == dim])
                    where, pieces = index[dim].shard, index[dim].pieces
                    who, to, lists = [], [], []
                    for i, cells in enumerate(found):
                        by: dict[int, list[int]] = {}
                        for c in cells:
                            for p in range(int(where[c]), int(where[c] + pieces[c])):
                                by.setdefault(p, []).append(c)
                        who += [i] * len(by)
                        to += by.keys()
                        lists += by.values()
                    take = pa.array(who, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *(c.take(take) for c in some.columns), pa.array(lists, pa.list_(pa.int32()))], ["s", "id", "same", "v", "d", "floor", "cells"])

        none = F.lit(None)
        sent = asked.mapInArrow(walk, "s int, id long, same long, v array<double>, d int, floor double, cells array<int>")
        kept = entries.select("id", "v", "d", "cell").mapInArrow(deal, "s int, id long, v array<double>, d int, cell int")
        kept = kept.select("s", F.lit(0).alias("q"), "id", none.cast("long").alias("same"), "v", "d", "cell", none.cast("double").alias("floor"), none.cast("array<int>").alias("cells"))
        both = kept.union(sent.select("s", F.lit(1).alias("q"), "id", "same", "v", "d", none.cast("int").alias("cell"), "floor", "cells"))
        dealt = both.repartition(max(1, min(shards, 1 << 15)), "s").sortWithinPartitions("s", "q")

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, parts, entry = -1, [], None
            for batch in batches:
                s, q, d = (batch.column(c).to_numpy() for c in ("s", "q", "d"))
                bounds = starts(s, q)
                for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    if s[lo] != now:
                        now, parts, entry = s[lo], [], None
                    some, dim = batch.slice(lo, hi - lo), int(d[lo])
                    if not q[lo]:
                        parts.append((some.column("id").to_numpy(), _matrix(some.column("v"), dim), some.column("cell").to_numpy()))
                        continue
                    if entry is None:
                        ids, x, cell = (np.concatenate(c) for c in zip(*parts, strict=True))
                        by = np.lexsort((ids, cell))
                        entry, parts = (ids[by], x[by], cell[by]), []
                    yield _rerank(entry, some, dim, k)

        return dealt.mapInArrow(probe, "query_id long, same long, vec_id long, score double")

    ranked = F.row_number().over(Window.partitionBy("query_id", "same").orderBy(F.desc("score"), "vec_id"))
    asked = pick(queries).select("id", F.xxhash64("v").alias("same"), "v", F.size("v").alias("d")).where(F.col("d").isin(list(counts)))
    lowest = F.lit(float("-inf"))
    first = ask(asked.withColumn("floor", F.lit(float("inf")))).withColumn("rank", ranked).where(F.col("rank") == k)
    first = materialize(first.select(F.col("query_id").alias("id"), "same", F.col("score").alias("floor")), "floors")
    floors = asked.join(first, ["id", "same"], "left").select("id", "same", "v", "d", F.coalesce("floor", lowest).alias("floor"))
    found = ask(floors).withColumn("rank", ranked).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
