"""What the operators of this package share: shared-folder tables, grouped Arrow streams, components.

Lineage is cut only with tables written under ``spark.checkpoint.dir``, which driver and executors
share, so a lost executor costs a task and never a result.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIR: list[str] = []
_HOT = 1000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where the setting is absent (tests, one machine)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append("file://" + tempfile.mkdtemp(prefix="tallyglass-"))
    return _LOCAL_DIR[0]


#: Rows and bytes of an Arrow batch, at most; a single longer text is a batch by itself.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of Arrow batches, where the session has no bounds of its own.

    Results don't depend on them. They stay set, as a plan that is returned reads them when it runs.
    """
    for key, value in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting that holds within the block alone."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def clean(spark: SparkSession):
    """Within the block Spark deletes the shuffle files of an action when it ends."""
    return setting(spark, _CLEAN, "true")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Spark deletes the shuffle files of the write when it ends. The table is deleted by :func:`discard`, or
    else when the session's JVM exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyglass/{label}-{uuid.uuid4().hex}"
    with clean(spark):
        df.write.parquet(path)
    files, p = _files(spark, path)
    files.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._tallyglass_path = path  # type: ignore[attr-defined]
    return out


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop has them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialize` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_tallyglass_path", None)
        if path:
            files, p = _files(df.sparkSession, path)
            files.delete(p, True)


def split_join(big: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Inner join of ``big`` with ``small``, which has a row a key at most, where one key may hold a third of ``big``.

    Keys with over a ``_HOT``-th of the rows of ``big`` are at most ``_HOT``; their rows of ``small`` are broadcast, and
    rows of ``big`` stay where they are. The others are exchanged. ``big`` is read twice and should be a table.
    """
    n = big.count()
    hot = [r[0] for r in big.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > max(n // _HOT, 100)).collect()]
    if not hot:
        return big.join(small, key)
    among = F.col(key).isin(hot)
    return big.where(among).join(F.broadcast(small.where(among)), key).unionByName(big.where(~among).join(small.where(~among), key))


def whole_groups(batches: Iterator[pa.RecordBatch], key: list[str], rows: int) -> Iterator[pa.Table]:
    """Cut a stream sorted by ``key`` into tables of about ``rows`` rows that hold whole groups.

    A group longer than ``rows`` comes alone in one longer table; callers bound the length of groups.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = _last_start(table, key)
        if cut:
            yield table.slice(0, cut)
            rest = table.slice(cut)
            held = rest.combine_chunks().to_batches()
            n = rest.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _last_start(table: pa.Table, key: list[str]) -> int:
    """Row at which the last group of a sorted table starts."""
    n = table.num_rows
    lo, hi = 0, n - 1
    last = [table[k][n - 1] for k in key]
    same = lambda i: all(table[k][i] == v for k, v in zip(key, last, strict=True))
    while lo < hi:
        mid = (lo + hi) // 2
        if same(mid):
            hi = mid
        else:
            lo = mid + 1
    return lo


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` items over the undirected links ``a[i]-b[i]``."""
    root = np.arange(n, dtype=np.int64)
    while a.size:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def components(edges: DataFrame, label: str) -> DataFrame:
    """Connected components of the links ``(a, b)``: rows ``(node, root)`` for every node but the roots.

    ``root`` is the smallest node of its component. Alternates the large-star and small-star steps of
    "Connected Components in MapReduce and Beyond" until nothing changes, in a logarithmic number of
    rounds; each round is two aggregations and two joins over the remaining links.
    """
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label
    )
    before = _mark(now)
    while before[0]:
        both = now.union(now.select("b", "a"))
        low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        big = materialize(
            both.join(low, both.a == low.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), label
        )
        low = big.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        joined = big.join(low, big.a == low.u)
        new = materialize(
            joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("u", "m")).distinct(), label
        )
        after = _mark(new)
        discard(now, big)
        now = new
        if after == before:
            break
        before = after
    found = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found._tallyglass_path = now._tallyglass_path  # type: ignore[attr-defined]
    return found


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return (row[0], row[1])


def barrier(df: DataFrame) -> DataFrame:
    """``df``, with nothing above it moved below: a filter on a deep expression would else repeat it many times over."""
    return df.observe(f"rows-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("n"))


def deal_blocks(items: DataFrame, key: list[str], ident: str, most: int, order: list[str] | None) -> DataFrame:
    """Deal the groups of ``items`` so that tasks see all pairs of a group, at most about 2 * ``most`` rows at once.

    Groups of one row are dropped. ``items`` may bring the rows of each group as _n, over one. A group of up to ``most`` rows is one block; a larger one is cut into
    blocks by a hash of ``ident``, and each two blocks meet once, so that a hot group becomes many tasks.
    Appends _b (the row's block), _i and _j (the blocks that meet); sorted by key, _i, _j, _b, ``order``,
    or not dealt out yet where ``order`` is None.
    """
    if "_n" not in items.columns:
        items = items.join(items.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1"), key)
    blocks = F.ceil(F.col("_n") / most).cast("int")
    dealt = items.withColumn("_k", blocks).withColumn("_b", F.pmod(F.xxhash64(ident), F.col("_k")).cast("int"))
    dealt = dealt.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    dealt = dealt.withColumn("_i", F.least("_b", "_j")).withColumn("_j", F.greatest("_b", "_j")).drop("_n", "_k")
    return dealt if order is None else dealt.repartition(*key, "_i", "_j").sortWithinPartitions(*key, "_i", "_j", "_b", *order)


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new group starts in sorted columns, and their length at the end."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    if n:
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)
