"""Sinks: term snapshots, plain-text exports and result envelopes."""

from __future__ import annotations

import uuid
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SnapshotConflict(Exception):
    """Another writer has committed since the version that a snapshot was to follow."""


def _in(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def _claim(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a small file if there is none; of several writers one succeeds."""
    fs, jpath = _in(spark, path)
    if jpath.toUri().getScheme() in (None, "file"):
        local = Path(jpath.toUri().getPath())
        local.parent.mkdir(parents=True, exist_ok=True)
        try:
            with open(local, "x", encoding="utf-8") as f:
                f.write(text)
        except FileExistsError:
            return False
        return True
    try:
        out = fs.create(jpath, False)
    except Py4JJavaError as e:
        if fs.exists(jpath):
            return False
        raise e
    out.write(bytearray(text, "utf-8"))
    out.close()
    return True


def _manifests(spark: SparkSession, path: str) -> dict[int, str]:
    """Committed versions and their data folders; a manifest that is still empty is not committed."""
    fs, folder = _in(spark, f"{path}/versions")
    if not fs.exists(folder):
        return {}
    rows = spark.read.text(f"{path}/versions", wholetext=True).select("value", F.col("_metadata.file_name").alias("f")).collect()  # one short row each
    return {int(r["f"].split(".")[0]): r["value"].strip() for r in rows if r["value"].strip()}


def _last_claim(spark: SparkSession, path: str) -> int:
    fs, folder = _in(spark, f"{path}/versions")
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return max((int(n.split(".")[0]) for n in names if n[0].isdigit()), default=0)


def write_snapshot(lex: DataFrame, path: str, expected: int | None = None) -> int:
    """Commits the table as the next version; earlier versions stay as backups.

    The rows are written to a folder of their own first; then the version's manifest is created, which
    succeeds for one writer only. Without ``expected`` a writer that lost takes the next number; with it,
    the version that the table was made from, it gets ``SnapshotConflict`` and nothing is committed.
    """
    spark = lex.sparkSession
    folder = f"data/{uuid.uuid4().hex}"
    lex.withColumn("saved_at", F.current_timestamp()).drop("version").write.parquet(f"{path}/{folder}")
    while True:
        version = _last_claim(spark, path) + 1
        if expected is not None and version != expected + 1:
            raise SnapshotConflict(f"version {version - 1} is there, version {expected} was expected")
        if _claim(spark, f"{path}/versions/{version:010d}.txt", folder):
            return version
        if expected is not None:
            raise SnapshotConflict(f"another writer took version {version}")


def latest_version(spark: SparkSession, path: str) -> int:
    """0 when nothing has been committed yet."""
    return max(_manifests(spark, path), default=0)


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version, by default the latest; only its own files are read."""
    found = _manifests(spark, path)
    version = max(found) if version is None else version
    return spark.read.parquet(f"{path}/{found[version]}").withColumn("version", F.lit(version))


def snapshot_metadata(lex: DataFrame) -> DataFrame:
    return lex.agg(
        F.count_if(F.col("kind") == "word").alias("total_words"),
        F.count_if(F.col("kind") == "phrase").alias("total_phrases"),
    )


def export_lines(lex: DataFrame) -> DataFrame:
    """Sorted plain-text lines, words before phrases."""
    terms = lex.filter(F.col("kind").isin("word", "phrase")).select("kind", "term").distinct()
    rank = F.when(F.col("kind") == "word", 1).otherwise(2)
    return terms.select(rank.alias("section"), F.col("term").alias("line")).orderBy("section", "line")


def export_terms(lex: DataFrame, path: str) -> None:
    spark = lex.sparkSession
    heads = spark.createDataFrame([(1, "", "## Words"), (2, "", "## Phrases")], "section int, k string, line string")
    body = export_lines(lex).select("section", F.col("line").alias("k"), "line")
    lines = heads.unionByName(body).orderBy("section", "k")
    lines.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def result_envelope(results: DataFrame, key: str = "msg_id") -> DataFrame:
    """One JSON document per message."""
    body = F.struct(*[c for c in results.columns if c != key])
    return results.select(key, "severity", F.to_json(F.struct(F.lit(True).alias("success"), body.alias("data"))).alias("value"))


def write_results(results: DataFrame, path: str, fmt: str = "parquet", key: str = "msg_id") -> None:
    """Results partitioned by severity; ``json`` writes the envelopes."""
    if fmt == "json":
        out = result_envelope(results, key).select("severity", "value")
        out.write.mode("overwrite").partitionBy("severity").text(path)
    else:
        results.write.mode("overwrite").partitionBy("severity").format(fmt).save(path)
