"""The shared folder for materialised intermediate tables."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark removes the shuffle files of an execution at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``, or a folder in the warehouse where none is configured.

    Both are seen by the driver and by every executor. A setting that is there is never changed.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
    if not warehouse:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse.rstrip('/')}/_scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder; it is removed when the program ends, or by ``discard``."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors.

    The shuffle files of the write are given back as soon as the table is there.
    """
    path = scratch_path(df.sparkSession, name)
    _write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(df: DataFrame, name: str = "table") -> Iterator[DataFrame]:
    """A written table that is removed again at the end of the block."""
    path = scratch_path(df.sparkSession, name)
    try:
        _write(df, path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        discard(df.sparkSession, path)


def _write(df: DataFrame, path: str) -> None:
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder that no later read needs."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _MADE[:] = [(s, p) for s, p in _MADE if p != path]


def discard_all() -> None:
    """Remove what this program has written to the shared folder, as far as its sessions still run."""
    for spark, path in list(_MADE):
        if spark.sparkContext._jsc is not None:
            discard(spark, path)


atexit.register(discard_all)
