"""BPE encoding and decoding over a table of distinct words."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiltext.llm.arrowtext import buffers, tidied
from civiltext.llm.wordtable import coded_documents, cut_for, encoded_postings, flat_ids, hot_ids, hot_values, id_type_of, missing_pieces, resolve, unpack, vocabulary_size


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids): the token ids of every whole text as little-endian unsigned 32-bit integers.

    Words are split in Spark and counted; each distinct word is encoded once and its ids are joined back
    by position: frequent words from the table that every task has, the others, which stand in the
    distinct table together with their places, through those places and one join on the document.
    Equal to encoding whole texts.

    A null text is empty. Repeated rows give repeated results and null ids stay; an empty table gives
    an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    cut = cut_for(tokenizer_path)
    common = hot_ids(docs, text, tokenizer_path)
    hot = spark.sparkContext.broadcast(hot_values(common))
    codes = spark.sparkContext.broadcast(flat_ids(common, id_type_of(tokenizer_path)))
    id_type = docs.schema[id_col].dataType.simpleString()
    rare = encoded_postings(missing_pieces(docs, id_col, text, cut, hot).select("key", "k", "piece"), tokenizer_path)
    rare = rare.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("k", "ids"))).alias("own"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, ids_at = codes.value
        for batch in batches:
            out = []
            own = batch.column("own").to_pylist()
            for n, coded, mine in zip(batch.column("n").to_pylist(), batch.column("coded").to_pylist(), own):
                out.append(resolve(unpack(coded, n), ids_of, ids_at, mine or []).astype("<u4").tobytes())
            yield pa.record_batch({"id": batch.column("id"), "ids": pa.array(out, pa.binary())})

    coded = coded_documents(docs, id_col, text, cut, hot)
    joined = coded.join(rare, "key", "left").select("id", "n", "coded", F.col("own.ids").alias("own"))
    return joined.mapInArrow(tidied(place), f"id {id_type}, ids binary").withColumnRenamed("id", id_col)


#: Bytes of ids that are decoded at once; one longer document is decoded alone.
DECODE_BYTES = 4 << 20


def bounded(batch: pa.RecordBatch, ids: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of at most ``DECODE_BYTES`` of ids."""
    ends = np.cumsum([len(x or b"") for x in batch.column(ids).to_pylist()])
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + DECODE_BYTES, "right")))
        yield batch.slice(start, end - start)
        start = end


@functools.lru_cache(maxsize=4)
def _pieces(path: str) -> tuple[pa.Array, bytes]:
    """Each id's piece as text bytes with what stands between two pieces of a decoded text, and that itself."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    decoder, added = spec["decoder"], {t["id"]: t["content"] for t in spec["added_tokens"]}
    by_id = {i: x for x, i in spec["model"]["vocab"].items()} | added
    names = [by_id.get(i, "") for i in range(vocabulary_size(path))]
    if decoder is None:
        return pa.array([x.encode() + b" " for x in names], pa.large_binary()), b" "
    if decoder["type"] != "ByteLevel":
        raise ValueError(f"no id-to-piece table for a decoder of type {decoder['type']}")
    back = byte_of_char()
    table = [x.encode() if i in added else bytes(back[c] for c in x) for i, x in enumerate(names)]
    return pa.array(table, pa.large_binary()), b""


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes stand for
    themselves, the others take the characters from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def decode(encoded: DataFrame, tokenizer_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the decoded text: every id is joined to its piece and the pieces are put together in order.

    The id-to-piece table is as large as the vocabulary, so it is at hand in every task and the join is
    one positional take for a batch. Special tokens stay. Ids without a piece add nothing; bytes that
    are no UTF-8 become U+FFFD; no ids give the empty text.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, between = _pieces(tokenizer_path)
        for batch in batches:
            for part in bounded(batch, ids):
                found = np.frombuffer(b"".join(x or b"" for x in part.column(ids).to_pylist()), "<u4")
                sizes = np.array([len(x or b"") // 4 for x in part.column(ids).to_pylist()], np.int64)
                known = found < len(table)
                taken = table.take(pa.array(found[known].astype(np.int64)))
                data, offsets = buffers(taken)
                count = np.concatenate([[0], np.cumsum(known)])[np.concatenate([[0], np.cumsum(sizes)])]
                raw, texts = data.tobytes(), []
                for a, b in zip(offsets[count[:-1]].tolist(), offsets[count[1:]].tolist()):
                    texts.append(raw[a : max(a, b - len(between))].decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != out)
    return encoded.drop(out).mapInArrow(tidied(join), f"{schema}, `{out}` string")
