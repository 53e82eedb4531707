"""Rows that share a key with many others are met once, not by all of them."""

import public_tokenizers
import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from civiltext.llm import neardup, token_counts, tokenfile, wordtable


def test_texts_with_null_or_repeated_ids_are_fetched_once(spark, monkeypatch):
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(60)]
    rows = [(None if i % 2 else 5, t) for i, t in enumerate(texts)] + [(None if i % 2 else 5, t + " end") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fetched, met = neardup._fetched, []

    def seen(docs, wanted):
        out = fetched(docs, wanted)
        met.append((out.count(), wanted.count()))
        return out

    monkeypatch.setattr(neardup, "_fetched", seen)
    got = neardup.near_duplicates(docs)
    assert got.count() == 120 and met == [(120, 120)]
    assert got.filter("doc_id is null and component_id is null").count() == 60
    assert got.filter("doc_id = 5 and component_id = 5").count() == 60


def long_piece_rows():
    """One piece of more than ``HOT_LENGTH`` bytes in a third of the rows, one of them twice as a whole."""
    dash = "ab" * wordtable.HOT_LENGTH
    rows = [(i, f"word{i} {dash} end {i % 7}" if i % 3 == 0 else f"plain words number {i}") for i in range(120)]
    return [*rows, rows[0], (None, dash), (500, None)]


def test_a_long_frequent_piece_is_dealt_out(spark, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    docs = spark.createDataFrame(long_piece_rows(), "doc_id long, text string")
    met, salts = [], token_counts.with_long_salts

    def seen(table):
        out = salts(table)
        met.append(out.groupBy("piece").count().filter(f"count = {wordtable.SALTS}").count())
        return out

    monkeypatch.setattr(token_counts, "with_long_salts", seen)
    got = sorted(map(tuple, token_counts.count_tokens(docs, path).collect()), key=str)
    size = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted(((i, len(t or ""), size(t), size(t) > 1024) for i, t in long_piece_rows()), key=str)
    assert met == [2]  # with the space before it, and without


def test_token_files_of_a_long_frequent_piece_and_repeated_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = long_piece_rows() + [(7, "the same row")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    files = tokenfile.write_token_files(docs, path, tokenfile.scratch_path(spark, "hot"))
    got = sorted(tokenfile.read_token_files(files).collect(), key=lambda r: r.start)
    assert [r.id for r in got if r.id is not None] == sorted(i for i, _ in rows if i is not None)
    want = sorted((str(i), [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows)
    assert sorted((str(r.id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    assert files.filter("docs > 200").count() == 0  # repeated rows fill several ranges
