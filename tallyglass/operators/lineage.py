"""Cutting lineage where a step is read several times or a loop grows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; on one machine without that setting, a temporary one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="tallyglass-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder that the cluster names in ``spark.checkpoint.dir``; on one machine without that setting, in a temporary one. What was cut is given back as it is."""
    if getattr(df, "_tallyglass_cut", False):
        return df
    _folder(df.sparkSession)
    out = df.checkpoint()
    out._tallyglass_cut = True  # type: ignore[attr-defined]
    return out


def table(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet beside the checkpoints and read back: smaller than a checkpoint, made in one pass, and Spark deletes the shuffle files of the write when it ends.

    :func:`drop` deletes it, or else the end of the session's JVM. What was cut is given back as it is.
    """
    if getattr(df, "_tallyglass_cut", False):
        return df
    spark = df.sparkSession
    path = f"{_folder(spark)}/tallyglass/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    files, p = _files(spark, path)
    files.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._tallyglass_cut, out._tallyglass_path = True, path  # type: ignore[attr-defined]
    return out


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop has them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`table` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_tallyglass_path", None)
        if path:
            files, p = _files(df.sparkSession, path)
            files.delete(p, True)
