"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs twice and the second run is timed, from building the plan to the
last result row (written to the no-op sink, so every column of every row is
computed). The first run loads the JVM; nothing is cached between the two.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "score_documents", "score_multilingual", "score_category", "score_config", "score_legacy", "score_unique",
    "match_words", "match_phrases", "tokenise", "normalise_category", "context_score", "top_terms", "evaluate",
    "conversation_rollup", "batch_assign", "window_metrics",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("civiltext-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # no call-site capture per column expression: plans are built faster
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    from civiltext.plans.queries import QUERIES

    def run(key: str) -> float:
        start = time.perf_counter()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for key in HEADLINE:
        run(key)
        times[key] = round(run(key), 3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n_docs = docs.count()
    words = docs.selectExpr("sum(size(split(text, '\\\\s+')))").first()[0]
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "documents_per_sec": round(n_docs / times["score_documents"], 1),
                "words_per_sec": round(words / times["score_documents"], 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
