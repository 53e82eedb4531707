"""Benchmark decontamination: pigeonhole pieces, exact piece hits, Myers' bit-parallel distance.

A test item that occurs in a text with at most k edits, cut into k + 1 pieces, has a piece without
an edit. So every piece is searched exactly, and only around its hits is the distance computed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from civiltext.llm.arrowtext import slices

#: Edits allowed, as a share of an item's characters.
ERROR_RATE = 0.05
#: Pieces are at least so long, so that a hit says something; short items get a smaller budget.
LEAST_PIECE = 12
#: Characters of test items that are searched in one pass over the texts.
BLOCK_CHARS = 2_000_000

_GAPS = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def normal(text: str) -> str:
    """Lower case, one space for every run of ASCII characters that are no letters or digits."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_GAPS).split()).decode("utf-8")


def budget_of(item: str, rate: float = ERROR_RATE, least: int = LEAST_PIECE) -> int:
    """Edits allowed for a normal item, so that its k + 1 pieces are long enough."""
    return max(0, min(int(rate * len(item)), len(item) // least - 1))


def pieces_of(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of near equal length."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks_of(pattern: str) -> dict[str, int]:
    """For each character the bits of the places where it stands."""
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_end(masks: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best match of a pattern of m characters that ends anywhere in the text, the first
    of equals; None over ``most``. One step of some word operations for each character of the text."""
    full, top = (1 << m) - 1, 1 << m - 1
    up, down, score = full, 0, m
    best, at = most + 1, -1
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        x = eq | down
        d0 = (((x & up) + up) ^ up) | x
        plus = down | ~(d0 | up) & full
        minus = d0 & up
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus <<= 1
        minus <<= 1
        up = (minus | ~(d0 | plus)) & full
        down = plus & d0 & full
        if score < best:
            best, at = score, j
    return (best, at) if best <= most else None


@dataclass
class Item:
    item_id: object
    text: str
    budget: int
    masks: dict[str, int]
    back: dict[str, int]


class Searcher:
    """Finds a block of test items in texts. Built once in every worker process."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        import ahocorasick

        self.items = [Item(i, t, budget_of(t, rate), masks_of(t), masks_of(t[::-1])) for i, t in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(self.items):
            for offset, piece in pieces_of(item.text, item.budget):
                found.setdefault(piece, []).append((n, offset + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, where)
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[object, int, int, int, int]]:
        """(item id, distance, budget, start, end) of the best match of every item within its budget;
        places are code points of the normal text, the leftmost end counts among equal distances."""
        starts: dict[int, set[int]] = {}
        for end, where in self.automaton.iter(text):
            for n, upto in where:
                starts.setdefault(n, set()).add(end + 1 - upto)
        out = []
        for n in sorted(starts):
            item = self.items[n]
            m, k, best = len(item.text), item.budget, None
            if not k:  # a short item is a run of whole words, not a part of longer ones
                at = next((s for s in sorted(starts[n]) if (not s or text[s - 1] == " ") and text[s + m : s + m + 1] in ("", " ")), None)
                if at is not None:
                    out.append((item.item_id, 0, 0, at, at + m))
                continue
            for a, b in _windows(sorted(starts[n]), m, k, len(text)):
                window = text[a:b]
                at = window.find(item.text)
                hit = (0, at + m) if at >= 0 else best_end(item.masks, m, window, k)
                if hit and (best is None or hit[0] < best[0]):
                    best = (hit[0], a + hit[1])
                if best and best[0] == 0:
                    break
            if best:
                distance, end = best
                low = max(0, end - m - k)
                length = m if distance == 0 else best_end(item.back, m, text[low:end][::-1], distance)[1]
                out.append((item.item_id, distance, k, end - length, end))
        return out


def _windows(starts: list[int], m: int, k: int, n: int) -> Iterator[tuple[int, int]]:
    """Ranges of a text where an item can lie that starts near one of these places; ranges that meet are one."""
    low = high = None
    for s in starts:
        a, b = max(0, s - k), min(n, s + m + k)
        if high is None or a > high:
            if high is not None:
                yield low, high
            low = a
        high = max(b, high) if high is not None and a <= high else b
    if high is not None:
        yield low, high


_BUILT: dict[str, Searcher] = {}


def _searcher(name: str, block, rate: float) -> Searcher:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Searcher(block.value, rate)
    return _BUILT[name]


def item_blocks(benchmark: DataFrame, item_col: str, text: str, most: int = BLOCK_CHARS) -> Iterator[list[tuple[object, str]]]:
    """The test items in blocks of bounded size, as normal texts; items without letters or digits are left out,
    as they can't be found. Only one block is held at a time."""
    block, size = [], 0
    for r in benchmark.select(F.col(item_col).alias("i"), F.col(text).cast("string").alias("t")).toLocalIterator():
        t = normal(r["t"] or "")
        if not t:
            continue
        block.append((r["i"], t))
        size += len(t)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminations(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE
) -> DataFrame:
    """(id, item id, distance, budget, match_start, match_end): every item that a whole text contains
    within its error budget, with its best match.

    Row-local over the documents: one pass for each block of test items, nothing is shuffled, so a
    passage in a third of all documents costs no more than elsewhere. Null and empty texts contain
    nothing; null and empty items are found nowhere; repeated rows and items give repeated results. An
    item too short for an error must stand between gaps, so that ``cat`` is not in ``concatenates``.
    """
    spark = docs.sparkSession
    item_type = benchmark.schema[item_col].dataType
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n long, distance long, budget long, match_start long, match_end long"
    plain = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    numbered = StructType([StructField("n", LongType()), StructField("item", item_type)])
    named = lambda found, items: found.join(F.broadcast(spark.createDataFrame([(n, i) for n, (i, _) in enumerate(items)], numbered)), "n")
    columns = ["id", "item", "distance", "budget", "match_start", "match_end"]
    out = named(spark.createDataFrame([], schema), []).select(*columns)
    for items in item_blocks(benchmark, item_col, item_text):
        # inside the tasks an item is its number, so that its id may have any type
        name, block = uuid.uuid4().hex, spark.sparkContext.broadcast([(n, t) for n, (_, t) in enumerate(items)])

        def search(batches: Iterator[pa.RecordBatch], name=name, block=block) -> Iterator[pa.RecordBatch]:
            searcher = _searcher(name, block, rate)
            for part in slices(batches, "text"):
                rows, found = [], []
                for i, t in enumerate(part.column("text").to_pylist()):
                    if t:
                        for hit in searcher.find(normal(t)):
                            rows.append(i)
                            found.append(hit)
                cols = list(zip(*found)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)],
                    names=["id", "n", "distance", "budget", "match_start", "match_end"],
                )

        out = out.union(named(plain.mapInArrow(search, schema), items).select(*columns))
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE
) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose text contains no test item within its budget."""
    spark = docs.sparkSession
    for items in item_blocks(benchmark, item_col, item_text):
        name, block = uuid.uuid4().hex, spark.sparkContext.broadcast(items)

        def clean(batches: Iterator[pa.RecordBatch], name=name, block=block) -> Iterator[pa.RecordBatch]:
            searcher = _searcher(name, block, rate)
            for part in slices(batches, text):
                keep = np.array([not (t and searcher.find(normal(t))) for t in part.column(text).to_pylist()], bool)
                yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
