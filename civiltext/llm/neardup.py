"""Near duplicates: an inverted join over MinHash coordinates, confirmed on full shingle sets.

1. Every text becomes a set of word shingles and a signature of ``COORDINATES`` minima. Texts with
   equal sets are one class; everything after works on classes, so exact copies cost one row each.
2. Classes are posted under every (coordinate, value) pair and the postings counted. A pair of classes
   that agrees in at least ``t`` of ``k`` coordinates must meet in one of the ``k - t + 1`` rarest of
   either (prefix); the ``t - 1`` longest posting lists are skipped and only probed through signatures.
   A class with fewer than ``t`` shared coordinates is done.
3. Stars: in each prefix list every class is compared with the list's hub, the class whose coordinates
   are the most frequent. Candidates with ``t`` collisions are confirmed on the full sets. That joins
   a group of copies with as many comparisons as it has members.
4. Rest: lists that still hold several components are compared across them, block by block, with
   a longer signature, and where both sets are small with the sets' own low halves, so that what
   leaves a block is hardly more than links. Pairs inside a component are never formed. Survivors
   are confirmed as before.

``t`` follows from the similarity: two sets at the threshold reach it except with probability 1e-6.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from civiltext.llm.arrowtext import LOWER, buffers, slices, tidied, words
from civiltext.llm.components import components
from civiltext.sources.storage import materialise

COORDINATES = 48
WIDE = 256
MISS = 1e-6
BLOCK = 384
#: Sets up to this size travel with the blocks as 32-bit halves; larger ones are known there by their signature alone.
SMALL = 2048
U64 = np.uint64


def least_matches(k: int, similarity: float, miss: float = MISS) -> int:
    """The largest t with P(fewer than t of k coordinates agree) <= miss at this similarity."""
    total, t = 0.0, 0
    while t < k:
        total += math.comb(k, t) * similarity**t * (1 - similarity) ** (k - t)
        if total > miss:
            break
        t += 1
    return max(1, t)


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of products become even in all bits."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes (64 bits); fewer words than ``size`` are one shingle."""
    data, offsets = buffers(texts)
    found, rows = words(LOWER[data], offsets)
    coded = found.dictionary_encode()
    own = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], U64)
    hashes = own[coded.indices.to_numpy(zero_copy_only=False)] if len(own) else np.zeros(0, U64)
    factors = _odd(11, size)
    n = max(0, len(hashes) - size + 1)
    rolled = np.zeros(n, U64)
    for j in range(size):
        rolled += hashes[j : j + n] * factors[j]
    rolled = _mixed(rolled)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if b - a >= size:
            yield np.unique(rolled[a : b - size + 1])
        elif b > a:
            yield _mixed(np.array([int(sum(int(h) * int(f) for h, f in zip(hashes[a:b], factors))) + (b - a) & (2**64 - 1)], U64) ^ U64(b - a))
        else:
            yield np.zeros(0, U64)


def class_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def minima(shingles: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The smallest of k keyed hashes of the set, in pieces of bounded memory."""
    a, b = _odd(seed, k), _odd(seed + 1, k)
    out = np.full(k, np.iinfo(U64).max, U64)
    step = max(1, 4_000_000 // k)
    for at in range(0, len(shingles), step):
        part = shingles[at : at + step]
        out = np.minimum(out, (part[None, :] * a[:, None] + b[:, None]).min(axis=1))
    return out


def coordinates(shingles: np.ndarray) -> np.ndarray:
    """Posting keys: each coordinate's minimum mixed with the coordinate's number."""
    return _mixed(minima(shingles, COORDINATES, 21) ^ _odd(23, COORDINATES)).view(np.int64)


def wide_signature(shingles: np.ndarray) -> bytes:
    return (_mixed(minima(shingles, WIDE, 31)) & U64(0xFFFF)).astype("<u2").tobytes()


def halves(shingles: np.ndarray) -> bytes:
    """The low 32 bits of every shingle hash."""
    return shingles.astype("<u4").tobytes()


@dataclass(frozen=True)
class Linking:
    words: int = 5
    percent: int = 80

    @property
    def matches(self) -> int:
        return least_matches(COORDINATES, self.percent / 100)

    @property
    def wide_matches(self) -> int:
        return least_matches(WIDE, self.percent / 100)


def _signed(docs: DataFrame, id_type: str, linking: Linking) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            n, cls, keys = [], [], []
            for s in shingle_sets(part.column("text"), linking.words):
                n.append(len(s))
                cls.append(class_of(s) if len(s) else None)
                keys.append(coordinates(s) if len(s) else None)
            yield pa.record_batch(
                {"id": part.column("id"), "h": part.column("h"), "n_shingles": pa.array(n, pa.int64()), "cls": pa.array(cls, pa.binary()), "keys": pa.array(keys, pa.list_(pa.int64()))}
            )

    return docs.mapInArrow(tidied(sign), f"id {id_type}, h long, n_shingles long, cls binary, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, linking: Linking) -> DataFrame:
    """(cls, shingles, wide, small) of the wanted (cls, id, h): their texts are fetched and hashed again."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            out = [(c, s) for c, s in zip(part.column("cls").to_pylist(), shingle_sets(part.column("text"), linking.words)) if class_of(s) == c]
            yield pa.record_batch(
                {
                    "cls": pa.array([c for c, _ in out], pa.binary()), "shingles": pa.array([s.tobytes() for _, s in out], pa.binary()),
                    "wide": pa.array([wide_signature(s) for _, s in out], pa.binary()),
                    "small": pa.array([halves(s) if len(s) <= SMALL else None for _, s in out], pa.binary()),
                }
            )

    made = _fetched(docs, wanted).mapInArrow(tidied(make), "cls binary, shingles binary, wide binary, small binary")
    return made.dropDuplicates(["cls"])


def _fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, text) of the wanted (cls, id, h). The text's hash is part of the key, so that rows with null or
    repeated ids and other texts do not meet."""
    same = F.col("d.id").eqNullSafe(F.col("w.id")) & (F.col("d.h") == F.col("w.h"))
    return docs.alias("d").join(wanted.alias("w"), same).select("w.cls", "d.text")


def _confirmed(pairs: DataFrame, sets: DataFrame, linking: Linking) -> DataFrame:
    """The (a, b) whose full sets reach the similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                if 100 * min(len(p), len(q)) < linking.percent * max(len(p), len(q)):
                    keep.append(False)
                    continue
                both = np.concatenate([p, q])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= linking.percent * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b")
    both = left.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(tidied(check), "a binary, b binary")


def _across(blocks: DataFrame, linking: Linking) -> DataFrame:
    """(a, b) of different components with enough wide collisions, each in its first shared list only."""
    need = linking.wide_matches

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                p, q = _Block(row["p"], -1), _Block(row["q"], -2) if row["q"] is not None else None
                a, b = _candidates(p, q or p, q is None, row["key"], need)
                near = np.array([_may_link(p, i, q or p, j, linking.percent) for i, j in zip(a.tolist(), b.tolist())], bool)
                a, b = a[near], b[near]
                if len(a):
                    yield pa.record_batch({"a": pa.array([p.cls[i] for i in a], pa.binary()), "b": pa.array([(q or p).cls[i] for i in b], pa.binary())})

    return blocks.mapInArrow(tidied(compare), "a binary, b binary")


class _Block:
    def __init__(self, members: list[dict], pad: int):
        self.cls = [m["cls"] for m in members]
        self.roots = [m["root"] for m in members]
        self.wide = np.stack([np.frombuffer(m["wide"], "<u2") for m in members])
        self.small = [frozenset(np.frombuffer(m["small"], "<u4").tolist()) if m["small"] is not None else None for m in members]
        self.sizes = [len(m["small"] or b"") // 4 for m in members]
        width = max(len(m["prefix"]) for m in members)
        self.prefix = np.full((len(members), width), pad, np.int64)
        for i, m in enumerate(members):
            self.prefix[i, : len(m["prefix"])] = m["prefix"]


def _may_link(p: _Block, i: int, q: _Block, j: int, percent: int) -> bool:
    """False where the halves of two small sets exclude the similarity. Equal halves of different hashes only
    add to what two sets share, and halves that coincide inside a set are added back, so no link is lost."""
    x, y = p.small[i], q.small[j]
    if x is None or y is None:
        return True
    m, n = p.sizes[i], q.sizes[j]
    common = len(x & y) + (m - len(x)) + (n - len(y))
    return 100 * common >= percent * (m + n - common)


def _candidates(p: _Block, q: _Block, same: bool, key: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    hits = np.zeros((len(p.cls), len(q.cls)), np.uint16)
    for c in range(p.wide.shape[1]):
        hits += p.wide[:, c][:, None] == q.wide[:, c][None, :]
    roots = {r: i for i, r in enumerate(dict.fromkeys([*p.roots, *q.roots]))}
    left, right = np.array([roots[r] for r in p.roots]), np.array([roots[r] for r in q.roots])
    keep = (hits >= need) & (left[:, None] != right[None, :])
    if same:
        keep &= np.triu(np.ones(keep.shape, bool), 1)
    a, b = np.nonzero(keep)
    first = np.ones(len(a), bool)
    for at in range(0, len(a), 4096):
        i, j = a[at : at + 4096], b[at : at + 4096]
        shared = (p.prefix[i][:, :, None] == q.prefix[j][:, None, :]).any(2)
        first[at : at + 4096] = p.prefix[i, shared.argmax(1)] == key
    return a[first], b[first]


def link_classes(docs: DataFrame, signed: DataFrame, linking: Linking) -> DataFrame:
    """(node, root) of all classes that are linked with another class; ``docs`` has id, text and h, the text's hash."""
    t = linking.matches
    classes = materialise(
        signed.filter("cls is not null").groupBy("cls").agg(
            F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("row"), F.first("keys").alias("keys")
        ).select("cls", "row.id", "row.h", "keys"),
        "neardup-classes",
    )
    postings = classes.select("cls", F.explode("keys").alias("key"))
    lists = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = postings.join(lists, "key").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("s"), F.sum("n").alias("weight"))
    active = materialise(
        shared.filter(F.size("s") >= t).select("cls", "weight", F.slice(F.col("s.key"), 1, F.size("s") - (t - 1)).alias("prefix")), "neardup-active"
    )
    sets = materialise(_sets(docs, active.select("cls").join(classes.select("cls", "id", "h"), "cls"), linking), "neardup-sets")

    posted = active.select("cls", "weight", F.explode("prefix").alias("key"))
    hubs = posted.groupBy("key").agg(F.max(F.struct("weight", "cls")).alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    stars = posted.join(hubs, "key").select(F.col("hub.cls").alias("a"), F.col("cls").alias("b")).filter("a != b").distinct()
    keys = classes.select("cls", "keys")
    probed = (
        stars.join(keys.select(F.col("cls").alias("b"), F.col("keys").alias("kb")), "b")
        .join(keys.select(F.col("cls").alias("a"), F.col("keys").alias("ka")), "a")
        .filter(F.size(F.array_intersect("ka", "kb")) >= t).select("a", "b")
    )
    star_links = materialise(_confirmed(probed, sets, linking), "neardup-links")
    roots = materialise(components(star_links, "neardup-parts"), "neardup-roots")

    rooted = active.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    placed = materialise(rooted.select("cls", "root", F.explode("prefix").alias("key")), "neardup-posted")
    parts = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    small = F.sum(F.when(F.col("m") < BLOCK, F.col("m")).otherwise(0))
    open_lists = parts.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), small.alias("small")).filter("roots > 1")
    of_block = F.when(F.col("m") >= BLOCK, F.concat(F.lit("r"), F.hex("root"), F.lit(":"), F.pmod(F.xxhash64("cls"), F.ceil(F.col("m") / BLOCK)))).otherwise(
        F.concat(F.lit("s"), F.pmod(F.xxhash64("root"), F.ceil(F.col("small") / BLOCK)))
    )
    members = (
        placed.join(open_lists.join(parts, "key"), ["key", "root"])
        .select("key", "cls", "root", of_block.alias("block"), F.when(F.col("m") >= BLOCK, F.col("root")).alias("alone"))
        .join(sets.select("cls", "wide", "small"), "cls").join(active.select("cls", "prefix"), "cls")
    )
    blocks = materialise(
        members.groupBy("key", "block").agg(
            F.first("alone").alias("alone"), F.count_distinct("root").alias("roots"), F.collect_list(F.struct("cls", "root", "wide", "small", "prefix")).alias("members")
        ),
        "neardup-blocks",
    )
    inside = blocks.filter("roots > 1").select("key", F.col("members").alias("p"), F.lit(None).cast(blocks.schema["members"].dataType).alias("q"))
    x, y = blocks.alias("x"), blocks.alias("y")
    between = x.join(
        y, (F.col("x.key") == F.col("y.key")) & (F.col("x.block") < F.col("y.block")) & ~F.coalesce(F.col("x.alone") == F.col("y.alone"), F.lit(False))
    ).select("x.key", F.col("x.members").alias("p"), F.col("y.members").alias("q"))
    rest = materialise(_across(inside.union(between), linking), "neardup-rest")
    more = _confirmed(rest, sets, linking)
    return components(star_links.union(more), "neardup-all")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", linking: Linking = Linking()) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row.

    ``component_id`` is the smallest id that is reachable over links, the row's own included; ``kept``
    says that it is the row's own. Words are runs without ASCII white space, A-Z lower-cased.

    Texts without words and nulls have no shingles and are linked with nothing. Equal sets are linked.
    Rows with a null id take part; their component is the smallest other id, or null. Repeated rows
    come back as often as they are. An empty table gives an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    plain = plain.withColumn("h", F.xxhash64("text"))
    signed = materialise(_signed(plain, id_type, linking), "neardup-signed")
    roots = link_classes(plain, signed, linking)
    # one row for each class that isn't alone: the smallest id of its component
    least = signed.filter("cls is not null").groupBy("cls").agg(F.min("id").alias("least"))
    rooted = least.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    tops = rooted.groupBy("root").agg(F.min("least").alias("top"))
    named = rooted.join(tops, "root").select("cls", "top")
    out = signed.select("id", "n_shingles", "cls").join(named, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("top"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", linking: Linking = Linking()) -> DataFrame:
    """The rows of ``docs``, columns unchanged, with one document of each group of near duplicates.

    The one with the smallest (id, text hash) stays, a null id counting as the smallest; of rows that are
    repeated with id and text one stays. Texts without words are in no group: all their rows stay.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    # the caller's row is one struct, so none of its names meets one of these
    packed = docs.select(F.struct(*columns).alias("row"), F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(content).alias("h")).alias("key"), content.alias("text"))
    worded = F.rlike("text", F.lit("[^ \\x09-\\x0D]"))
    some = packed.filter(worded)
    kept = near_duplicates(some.select("key", "text"), "key", "text", linking).filter("kept").select(F.col("key").alias("of")).distinct()
    found = some.join(kept, F.col("key").eqNullSafe(F.col("of")))
    # a filter on the first row alone lets every task drop a repeated row's others before they move
    first = found.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.lit(1)))).filter("n = 1")
    return first.select("row.*").unionByName(packed.filter(~worded).select("row.*"))
