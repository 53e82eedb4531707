"""Token counts of whole texts, from distinct pre-tokens: each is counted once and no ids are kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiltext.llm.arrowtext import buffers, slices, tidied
from civiltext.llm.wordtable import cut_for, hot_values, long_salt, look_up, missing_pieces, named, piece_table, split_table, with_long_salts

TOKEN_LIMIT = 1024


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text", limit: int = TOKEN_LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row, without begin, end or added special tokens.

    Every distinct pre-token of all texts is tokenized once for its number of tokens. Documents are
    joined to that table by their pre-token frequencies and the products summed: frequent pre-tokens
    in the task that reads the document, rare ones by a join, in which very long ones, frequent or not,
    are dealt out over several tasks. No list of ids exists at any time.

    A null text is empty and has no tokens. Rows keep their number: repeated rows give repeated
    results, null ids stay. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    cut = cut_for(tokenizer_path)
    table = piece_table(docs, text, tokenizer_path, lengths_only=True)
    common, others = split_table(table)
    hot = spark.sparkContext.broadcast(hot_values(common))
    sizes = spark.sparkContext.broadcast(np.append(common.column("n_tokens").to_numpy(), 0))
    id_type = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, each = hot.value, sizes.value
        for part in slices(batches, "text"):
            seen = look_up(part, cut, values)
            sums = np.concatenate([[0], np.cumsum(each[seen.numbers])])  # a missing piece, -1, adds the last, 0
            _, offsets = buffers(part.column("text"))
            missing = np.concatenate([[0], np.cumsum(seen.numbers < 0)])
            yield pa.record_batch(
                {
                    "id": part.column("id"), "n_bytes": pa.array(np.diff(offsets), pa.int64()),
                    "found": pa.array(np.diff(sums[seen.rows]), pa.int64()),
                    # only documents with missing pieces take part in the join
                    "key": pc.if_else(pa.array(np.diff(missing[seen.rows]) > 0), pa.array(seen.keys, pa.binary()), pa.scalar(None, pa.binary())),
                }
            )

    counted = named(docs, id_col, text).mapInArrow(tidied(count), f"id {id_type}, n_bytes long, found long, key binary")
    rare = (
        missing_pieces(docs, id_col, text, cut, hot).select("key", "k", "times", "piece", long_salt().alias("salt"))
        .join(with_long_salts(others), ["piece", "salt"])
        .groupBy("key").agg(F.sum(F.col("times") * F.col("n_tokens")).alias("rest"), F.max("k").alias("last"), F.count(F.lit(1)).alias("rows"))
        # rows repeated as a whole share a key and each adds the same sum
        .select("key", (F.col("rest") / (F.col("rows") / (F.col("last") + 1))).cast("long").alias("rest"))
    )
    n_tokens = F.col("found") + F.coalesce("rest", F.lit(0))
    return counted.join(rare, "key", "left").select(
        F.col("id").alias(id_col), "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit")
    )
