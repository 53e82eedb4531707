"""Source divergence audit: how far each source of a language is from the others, and by which terms.

A term is a run of letters, A-Z lower-cased; a language keeps the terms that are in at least
``LEAST_DOCS`` of its documents. Every group (language, source) and every language gives each kept
term the smoothed frequency p = 1 + floor(SCALE * (count + 1) / (all + V)); the distance of p to q is
the sum of floor((p - q)^2 / q) over terms. All arithmetic is on whole numbers.

* **Pairs of sources.** Where a group lacks a term its p is the group's floor value, so the sum over all
  kept terms is put together from three small sums: what each source has alone against the floor of the
  other, by the distinct counts of a source, and a correction over the terms that both have.
* **Top terms by a dominance skyband.** A term of a group that another one beats in all three of group
  count (not lower), language count (not higher) and name (earlier) ranks below it whatever the totals
  are, because its share is then no larger. Partitions of the vocabulary therefore keep, for each
  group, only the terms that fewer than ``TOP`` others dominate; the skybands are merged by shuffle
  and thinned again, and only what is left is valued and ranked exactly.

How it scales. Occurrences are summed for each slice of text before they are shuffled; the rest works on
the vocabulary. Nothing is collected or sent to all tasks, no key holds more than the sources of one
term, and a merging task holds a bounded number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from civiltext.llm.arrowtext import slices, tidied
from civiltext.llm.charruns import LETTERS, lower_runs
from civiltext.operators.joins import lookup_join
from civiltext.sources.storage import materialise

SCALE = 1_000_000_000
LEAST_DOCS = 3
TOP = 200
#: Rows that a task holds before it thins them to their skybands.
HELD = 1 << 19
#: Rows that are compared at once.
BLOCK = 512
#: Parts that the terms of one group are dealt to when skybands are merged.
PARTS = 16


def named(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """lang, source and text as strings, nulls as ''."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])


def occurrences(plain: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term in every group."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = lower_runs(part.column("text"), LETTERS)
            coded = found.strings.dictionary_encode()
            width = len(coded.dictionary) + 1
            langs, sources = (part.column(c).dictionary_encode() for c in ("lang", "source"))
            number = lambda x: x.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            group = number(langs) * len(sources.dictionary) + number(sources)
            by_doc, times = np.unique(found.row_of * width + number(coded), return_counts=True)
            keys, back = np.unique(group[by_doc // width] * width + by_doc % width, return_inverse=True)
            n, docs = np.zeros(len(keys), np.int64), np.bincount(back, minlength=len(keys))
            np.add.at(n, back, times)
            g = keys // width
            yield pa.record_batch(
                {
                    "lang": langs.dictionary.take(pa.array(g // max(1, len(sources.dictionary)))),
                    "source": sources.dictionary.take(pa.array(g % max(1, len(sources.dictionary)))),
                    "term": coded.dictionary.take(pa.array(keys % width)).cast(pa.string()),
                    "n": pa.array(n), "docs": pa.array(docs.astype(np.int64)),
                }
            )

    partial = plain.mapInArrow(tidied(count), "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(found: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, c, by): the kept terms with their count in the language and in each source."""
    terms = found.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("c"), F.collect_list(F.struct("source", "n")).alias("by")
    )
    return terms.filter(F.col("docs") >= least_docs).select("lang", "term", "c", "by")


def share(count: Column, total: Column, size: Column) -> Column:
    """p of a term with this count in a group of ``total`` occurrences and ``size`` kept terms; null without terms."""
    scaled = F.lit(SCALE).cast("decimal(12,0)") * (count + 1).cast("decimal(20,0)")
    return (F.lit(1) + F.call_function("div", scaled, F.nullif(total + size, F.lit(0)).cast("decimal(20,0)"))).cast("long")


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


# -- the skyband ---------------------------------------------------------------------------------


def skyband(n: np.ndarray, c: np.ndarray, item: np.ndarray, k: int) -> np.ndarray:
    """Places of the points that fewer than k others dominate: n not lower, c not higher, item earlier.

    Points are taken by falling n, so that all that can dominate a point come before it. It is
    enough to count those that were kept: whoever has k dominators has k among the kept ones.
    """
    order = np.lexsort((item, c, -n))
    cell = np.flatnonzero(np.concatenate([[True], (np.diff(n[order]) != 0) | (np.diff(c[order]) != 0)]))
    nth = np.arange(len(order)) - np.repeat(cell, np.diff(np.append(cell, len(order))))
    order = order[nth < k]  # of equal counts only the k first names
    cs, items = c[order], item[order]
    band = np.zeros(len(order), bool)
    for at in range(0, len(order), BLOCK):
        left = np.arange(at, min(at + BLOCK, len(order)))
        beaten = np.zeros(len(left), np.int64)
        held = np.flatnonzero(band[:at])
        for i in range(0, len(held), 2 * BLOCK):
            some = held[i : i + 2 * BLOCK]
            beaten += ((cs[some][None, :] <= cs[left][:, None]) & (items[some][None, :] < items[left][:, None])).sum(1)
            left, beaten = left[beaten < k], beaten[beaten < k]
        inside = (cs[left][None, :] <= cs[left][:, None]) & (items[left][None, :] < items[left][:, None])
        inside &= np.tri(len(left), k=-1, dtype=bool)
        # inside a block all count, kept or not: whoever is not kept has k dominators of its own
        band[left[beaten + inside.sum(1) < k]] = True
    return order[band]


def thinned(points: DataFrame, k: int) -> DataFrame:
    """(lang, source, term, n, c) without the points that k others of their group and partition dominate."""

    most = HELD

    def thin(held: list[pa.RecordBatch]) -> pa.Table:
        table = pa.Table.from_batches(held).combine_chunks()
        coded = [table.column(x).combine_chunks().dictionary_encode() for x in ("lang", "source")]
        number = [x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in coded]
        group = number[0] * (len(coded[1].dictionary) + 1) + number[1]
        name = np.empty(table.num_rows, np.int64)
        name[pc.sort_indices(table.column("term").combine_chunks().cast(pa.binary())).to_numpy()] = np.arange(table.num_rows)
        n, c = table.column("n").to_numpy(), table.column("c").to_numpy()
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0, [True]]))
        kept = [of[skyband(n[of], c[of], name[of], k)] for of in (order[a:b] for a, b in zip(cuts[:-1], cuts[1:]))]
        return table.take(pa.array(np.concatenate(kept)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held, rows = [*held, batch], rows + batch.num_rows
            if rows > most:
                table = thin(held)
                held, rows = table.to_batches(), table.num_rows
                if rows > most // 2:  # a table of many groups: what is left goes on, it is thinned again later
                    yield from held
                    held, rows = [], 0
        if rows:
            yield from thin(held).to_batches()

    return points.select("lang", "source", "term", "n", "c").mapInArrow(tidied(run), "lang string, source string, term string, n long, c long")


# -- pairs of sources ------------------------------------------------------------------------------


def shared_terms(priced: DataFrame) -> DataFrame:
    """(lang, source, other, both): the correction over the terms that two sources have, from (lang, by) rows.

    ``by`` lists the sources of a term as (source, p, low); the terms of a batch are paired and
    summed in the task, so that only one row for each pair of sources leaves it.
    """

    most = HELD

    def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // q

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str, str], int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                by = part.column("by")
                size = pc.list_value_length(by).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = by.flatten()
                p, low = flat.field("p").to_numpy(), flat.field("low").to_numpy()
                names = flat.field("source").dictionary_encode()
                langs = part.column("lang").dictionary_encode()
                who, lang = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (names, langs))
                begin = np.cumsum(size) - size
                left = np.repeat(np.arange(len(p)), np.repeat(size, size))
                mates = np.repeat(size, size)
                right = np.arange(len(left)) - np.repeat(np.cumsum(mates) - mates, mates) + np.repeat(np.repeat(begin, size), mates)
                other = left != right
                left, right = left[other], right[other]
                x, y, a, b = p[left], p[right], low[left], low[right]
                value = distance(x, y) - distance(x, b) - distance(a, y) + distance(a, b)
                m = len(names.dictionary) + 1
                key = (np.repeat(lang, size)[left] * m + who[left]) * m + who[right]
                keys, back = np.unique(key, return_inverse=True)
                total = np.zeros(len(keys), np.int64)
                np.add.at(total, back, value)
                spelled, spoken = names.dictionary.to_pylist(), langs.dictionary.to_pylist()
                for k, v in zip(keys.tolist(), total.tolist()):
                    name = spoken[k // m // m], spelled[k // m % m], spelled[k % m]
                    sums[name] = sums.get(name, 0) + v
            if len(sums) > most:
                yield _written(sums)
                sums = {}
        if sums:
            yield _written(sums)

    summed = priced.select("lang", "by").mapInArrow(tidied(pair), "lang string, source string, other string, both long")
    return summed.groupBy("lang", "source", "other").agg(F.sum("both").alias("both"))


def _written(sums: dict[tuple[str, str, str], int]) -> pa.RecordBatch:
    columns = [*zip(*sums), tuple(sums.values())]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=["lang", "source", "other", "both"])


def source_pairs(flat: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of sources of a language.

    ``groups`` has (lang, source, total, size, low) of every group, ``flat`` (lang, source, term, n, p, low).
    """
    priced = flat.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "low")).alias("by"))
    both = shared_terms(priced)
    own = flat.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("k"))
    sides = groups.join(own.groupBy("lang", "source").agg(F.sum("k").alias("terms")), ["lang", "source"], "left").select(
        "lang", "source", "low", "size", F.coalesce("terms", F.lit(0)).alias("terms")
    )
    right = sides.select("lang", F.col("source").alias("other"), F.col("low").alias("low2"), F.col("terms").alias("terms2"))
    pairs = materialise(sides.join(right, "lang").filter("source != other"), "divergence-pairs")  # as many rows as the result
    alone = pairs.join(own, ["lang", "source"]).groupBy("lang", "source", "other").agg(F.sum(F.col("k") * gap(F.col("p"), F.col("low2"))).alias("alone"))
    theirs = own.withColumnRenamed("source", "other")
    lacking = pairs.join(theirs, ["lang", "other"]).groupBy("lang", "source", "other").agg(F.sum(F.col("k") * gap(F.col("low"), F.col("p"))).alias("lacking"))
    key = ["lang", "source", "other"]
    joined = pairs.join(alone, key, "left").join(lacking, key, "left").join(both, key, "left")
    none = (F.col("size") - F.col("terms") - F.col("terms2")) * gap(F.col("low"), F.col("low2"))
    parts = [F.coalesce(c, F.lit(0)) for c in ("alone", "lacking", "both")]
    value = F.when(F.col("size") > 0, parts[0] + parts[1] + parts[2] + none).otherwise(F.lit(0))
    return joined.select("lang", "source", F.col("other").alias("item"), value.cast("long").alias("value"))


def source_divergence(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP
) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group of ``docs``.

    Part ``pair``: every other source of the language with its distance. Part ``term``: the ``top`` terms
    that a group uses more than its language does. Ranks count from 1 in each group and part, by falling
    value, then by the item's bytes.

    Nulls in text, lang and source count as ''. Rows are documents, repeated rows and rows with equal ids
    are several. A group without terms takes part in pairs; a language without kept terms has the
    distance 0. A language with one source has no pairs. An empty table gives an empty result. Other
    columns are not read.
    """
    plain = named(docs, text, lang, source)
    kept = materialise(kept_terms(occurrences(plain), least_docs), "divergence-terms")
    counts = kept.select("lang", "term", "c", F.inline("by"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("size"), F.sum("c").alias("all"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = plain.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "size", "all")])
    groups = materialise(groups.withColumn("low", share(F.lit(0), F.col("total"), F.col("size"))), "divergence-groups")

    priced = lookup_join(counts.select("lang", "source", "term", "n"), groups.select("lang", "source", "total", "size", "low"), ["lang", "source"])
    priced = priced.withColumn("p", share(F.col("n"), F.col("total"), F.col("size")))
    pairs = source_pairs(priced, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    parted = thinned(counts, top).withColumn("part", F.pmod(F.xxhash64("term"), F.lit(PARTS)))
    band = thinned(parted.repartition("lang", "source", "part"), top)
    valued = lookup_join(band, groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("size")), share(F.col("c"), F.col("all"), F.col("size"))
    terms = valued.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    terms = terms.select("lang", "source", "part", "item", gap(F.col("p"), F.col("q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = terms.withColumn("rank", rank).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(ranked).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
