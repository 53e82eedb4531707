"""Phrases with a window for each word, for phrase tables of any size: pairs of near words, joined with the phrases' beginnings.

A word is met by many phrases, a pair of near words by few. So each message is searched for the pairs
that may begin a phrase, and a bitmap of the phrases' first two words, of a fixed size, lets them
through; what is left, gathered by message and pair, is joined with the phrases and rated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiltext.operators.joins import fits, lookup_join
from civiltext.operators.lexicon import phrase_profile
from civiltext.operators.substrings import FILTER_BITS, U64, Windows, _bytes_of
from civiltext.sources.storage import materialise

#: The largest search window of a phrase word; the next word lies at most one place further.
WIDEST_WINDOW = 8
REACH = WIDEST_WINDOW + 1
#: So many phrases of two words travel to every task (some 50 MB); with more, the pairs are joined with them.
IN_TASKS = 1 << 20
#: Words that are looked at together.
SLICE_WORDS = 1 << 16


def _hashes(words: pa.Array) -> np.ndarray:
    data, at = _bytes_of(words)
    w, size = Windows(data), np.diff(at)
    h = (w.sums[at[1:]] - w.sums[at[:-1]]) * w.back[at[:-1]] + size.astype(U64)
    return (h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9)


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    h = first * U64(0x9E3779B97F4A7C15) + second
    return (h ^ (h >> U64(31))) * U64(0x94D049BB133111EB)


def _bit(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _pair(first, second) >> U64(64 - FILTER_BITS)


def _has(bitmap: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (bitmap[(bit >> U64(6)).astype(np.int64)] >> (bit & U64(63))) & U64(1) == 1


def pair_filter(pairs: DataFrame) -> np.ndarray:
    """A bitmap of pairs of words (a, b); its words are put together in Spark."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = _bit(_hashes(batch.column("a")), _hashes(batch.column("b"))).astype(np.int64)
            yield pa.record_batch({"word": pa.array(bit >> 6), "bit": pa.array(bit & 63)})

    found = pairs.select("a", "b").mapInArrow(bits, "word long, bit long")
    words = found.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit AS int))")).alias("bits")).toArrow()  # at most the filter
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return bitmap.view(U64)


#: (importance, windows) of the second word of a phrase of two
RATES = ["importance", "window_short", "window_medium", "window_long"]


def travelling(twos: DataFrame, most: int) -> tuple[np.ndarray, pa.Table] | None:
    """Phrases of two words for every task, by the hash of their words; none when there are more than ``most``."""
    if not fits(twos, most):
        return None

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = _pair(_hashes(batch.column("a")), _hashes(batch.column("b"))).view(np.int64)
            yield pa.record_batch([pa.array(h), *batch.columns[2:]], names=["h", *batch.schema.names[2:]])

    w = F.col("rest")[0]
    slim = twos.select("a", "b", F.concat_ws(" ", "a", "b").alias("pair"), "mean", *[w[c].alias(c) for c in RATES])
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}
    table = slim.mapInArrow(hashed, "h long, " + ", ".join(f"{c} {kinds[c]}" for c in ["pair", "mean", *RATES])).toArrow().combine_chunks()
    h = table.column("h").to_numpy().view(U64)
    order = np.argsort(h)
    if (np.diff(h[order]) == 0).any():  # two phrases of one hash are left to the join
        return None
    return h[order], table.drop_columns("h").take(pa.array(order)).combine_chunks()


def near_pairs(df: DataFrame, key: str, words: str, places: str, begins: np.ndarray, longer: np.ndarray, ahead: int, twos: tuple | None = None) -> DataFrame:
    """(k, n, pair, at, ahead, and mean and RATES of a phrase in ``twos``): the pairs of words of ``begins`` with the second at its nearest place after the first, at most REACH places on.

    ``at`` has the places as 16 * place + gap; ``ahead`` the words behind the second by place, for the pairs of
    ``longer``. With ``twos``, other pairs are left out here. A phrase's word has no space, so a pair in one string is never another pair.
    """
    shared = df.sparkSession.sparkContext.broadcast((begins, longer, twos))
    kind = df.schema[key].dataType.simpleString()
    rate_kinds = [pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]

    def part_of(part: pa.RecordBatch) -> pa.RecordBatch | None:
        lists, where = part.column("w"), part.column("p")
        flat = lists.flatten()
        coded = flat.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(part.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        pos = where.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(code):
            return None
        h = _hashes(coded.dictionary)[code]
        first, second = [], []
        for d in range(1, min(REACH, len(code) - 1) + 1):
            step = pos[d:] - pos[:-d]
            i = np.flatnonzero((row[d:] == row[:-d]) & (step >= 1) & (step <= REACH))
            i = i[_has(shared.value[0], _bit(h[i], h[i + d]))]
            for e in range(1, d):  # not the nearest place
                i = i[(code[i + e] != code[i + d]) | (pos[i + e] == pos[i])]
            first.append(i)
            second.append(i + d)
        a, b = np.concatenate(first or [code[:0]]), np.concatenate(second or [code[:0]])
        if not len(a):
            return None
        order = np.lexsort((a, code[b], code[a], row[a]))
        a, b = a[order], b[order]
        new = np.flatnonzero(np.r_[True, (np.diff(row[a]) != 0) | (np.diff(code[a]) != 0) | (np.diff(code[b]) != 0)])
        long = np.flatnonzero(_has(shared.value[1], _bit(h[a], h[b]))) if ahead else a[:0]
        behind, ends = {}, np.searchsorted(row, row[b[long]], "right")
        for i, j, end in zip(long.tolist(), b[long].tolist(), ends.tolist()):
            line = [None] * ahead
            for x in range(j + 1, min(end, j + 1 + ahead)):
                if 0 <= pos[x] - pos[j] - 1 < ahead:
                    line[pos[x] - pos[j] - 1] = coded.dictionary[code[x]].as_py()
            behind[i] = line
        groups = np.searchsorted(new, long, "right") - 1
        lines: dict[int, list] = {}
        for g, i in zip(groups.tolist(), long.tolist()):
            lines.setdefault(g, []).append(behind[i])
        word = lambda i: coded.dictionary.take(pa.array(code[i])).cast(pa.string())
        pair, bounds = pc.binary_join_element_wise(word(a[new]), word(b[new]), " "), np.r_[new, len(a)]
        kept, rates = np.arange(len(new)), [pa.nulls(len(new), t) for t in rate_kinds]
        if shared.value[2] is not None:
            known, table = shared.value[2]
            mine = _pair(h[a[new]], h[b[new]])
            place = np.minimum(np.searchsorted(known, mine), max(len(known) - 1, 0))
            found = np.zeros(len(new), bool)
            if len(known):
                same = pc.equal(table.column("pair").take(pa.array(place)).combine_chunks().cast(pa.string()), pair)
                found = (known[place] == mine) & same.to_numpy(zero_copy_only=False)
            found_at = pa.array(place, mask=~found)
            extra = np.zeros(len(new), bool)
            extra[list(lines)] = True
            kept = np.flatnonzero(found | extra)
            rates = [table.column(c).take(found_at.take(pa.array(kept))).combine_chunks().cast(t) for c, t in zip(["mean", *RATES], rate_kinds)]
        sizes = np.diff(bounds)[kept]
        offsets = np.r_[0, np.cumsum(sizes)]
        inner = np.repeat(bounds[:-1][kept] - offsets[:-1], sizes) + np.arange(offsets[-1])
        out = [
            part.column("k").take(pa.array(row[a[new[kept]]])), part.column("n").take(pa.array(row[a[new[kept]]])), pair.take(pa.array(kept)),
            pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(pos[a[inner]] * 16 + pos[b[inner]] - pos[a[inner]] - 1)),
            pa.array([lines.get(g) for g in kept.tolist()], pa.list_(pa.list_(pa.string()))), *rates,
        ]
        return pa.record_batch(out, names=["k", "n", "pair", "at", "ahead", "mean", *RATES])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.cumsum(batch.column("w").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:
                before = total[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(total, before + SLICE_WORDS, "right")))
                found = part_of(batch.slice(start, end - start))
                start = end
                if found is not None:
                    yield found

    slim = df.select(F.col(key).alias("k"), F.col("n_tokens").cast("int").alias("n"), F.col(words).alias("w"), F.col(places).alias("p"))
    return slim.mapInArrow(find, f"k {kind}, n int, pair string, at array<long>, ahead array<array<string>>, mean double, importance double, window_short int, window_medium int, window_long int")


def phrase_table(phrases: DataFrame, base_gap: int) -> DataFrame:
    """(term, n, mean, words): a phrase with its words in order and their importance and windows."""
    profile = phrase_profile(phrases.select(F.lower("term").alias("term")).distinct(), base_gap)
    word = F.struct("place", "word", "importance", "window_short", "window_medium", "window_long")
    table = profile.groupBy("term", "n").agg(F.array_sort(F.collect_list(word)).alias("words"))
    total = F.aggregate("words", F.lit(0.0), lambda t, w: t + w["importance"])
    return table.select("term", "n", (total / F.col("n")).alias("mean"), "words")


def adaptive_phrases(df: DataFrame, phrases: DataFrame, base_gap: int = 2, key: str = "msg_id", words: str = "w", places: str | None = None, in_tasks: int = IN_TASKS) -> DataFrame:
    """(key, term, m) with ``m`` the candidate matches (start, end, gaps, strength) by place (M4).

    ``df`` has the words of a message in order and ``n_tokens``; ``places`` their positions where they
    are not 0, 1, 2. A match begins at each place of the first word from which every later word is
    found at its nearest place, inside its window.
    """
    if places is None:
        places = "_places"
        df = df.withColumn(places, F.transform(words, lambda _, i: i))
    table = materialise(phrase_table(phrases, base_gap), "phrase-profiles")
    longest, shortest = table.agg(F.max("n"), F.min("n")).first()
    first, second = (F.get("words", F.lit(i))["word"] for i in (0, 1))
    several = table.filter("n > 1").select(first.alias("a"), second.alias("b"), "term", F.col("n").alias("size"), "mean", F.slice("words", 2, F.greatest(F.lit(1), F.col("n") - 1)).alias("rest"))
    ahead = REACH * max((longest or 0) - 2, 0)
    begun = several.select(F.concat_ws(" ", "a", "b").alias("pair"), "term", "size", "mean", "rest")
    twos = travelling(several.filter("size = 2"), in_tasks)
    pairs = near_pairs(df, key, words, places, pair_filter(several), pair_filter(several.filter("size > 2")), ahead, twos)
    if twos is None:
        # many pairs meet many phrases, so both sides move; a frequent pair is split at run time
        joined = pairs.drop("mean", *RATES).join(F.broadcast(begun) if fits(begun) else begun.hint("shuffle_hash"), "pair")
    else:
        # phrases of two words are found where the texts are, so that no pair moves; the few longer ones are looked up
        more = begun.filter("size > 2").groupBy("pair").agg(F.collect_list(F.struct("term", "size", "mean", "rest")).alias("more"))
        kind = more.schema["more"].dataType
        rest = F.struct(F.lit(1).alias("place"), F.substring_index("pair", " ", -1).alias("word"), *RATES)
        two = F.array(F.struct(F.col("pair").alias("term"), F.lit(2).alias("size"), "mean", F.array(rest).alias("rest"))).cast(kind)
        each = F.concat(F.when(F.col("mean").isNotNull(), two).otherwise(F.array().cast(kind)), F.coalesce("more", F.array().cast(kind)))
        joined = lookup_join(pairs, more, ["pair"], "left").select("k", "n", "pair", "at", "ahead", F.inline(each))

    def window(w: Column) -> Column:
        return F.when(F.col("n") < 10, w["window_short"]).when(F.col("n") < 20, w["window_medium"]).otherwise(w["window_long"])

    def penalty(gap: Column, w: Column) -> Column:
        raw = F.least(gap * F.lit(0.15), F.lit(0.6)) + (F.lit(1.0) - w["importance"]) * 0.3
        return F.when(gap == 0, F.lit(0.0)).otherwise(F.least(raw, F.lit(0.8)))

    def begin(m: Column, i: Column) -> Column:
        w, pos, gap = F.get("rest", F.lit(0)), F.shiftright(m, 4).cast("int"), (m % 16).cast("int")
        return F.struct(
            pos.alias("start"), (pos + gap + 1).alias("end"), gap.alias("gaps"), F.array(penalty(gap, w)).alias("pens"),
            F.lit(0).alias("at"), F.get("ahead", i).alias("ahead"), (gap <= window(w)).alias("ok"),
        )

    def extend(place: int):
        w = F.get("rest", F.lit(place - 1))

        def step(c: Column) -> Column:
            gap = F.array_position(F.slice(c["ahead"], c["at"] + 1, F.lit(REACH)), w["word"]).cast("int") - 1
            linked = F.struct(
                c["start"], (c["end"] + gap + 1).alias("end"), (c["gaps"] + gap).alias("gaps"), F.concat(c["pens"], F.array(penalty(gap, w))).alias("pens"),
                (c["at"] + gap + 1).alias("at"), c["ahead"], (c["ok"] & (gap >= 0) & (gap <= window(w))).alias("ok"),
            )
            return F.when(F.col("size") > place, linked).otherwise(c)

        return step

    chain = joined.withColumn("c", F.filter(F.transform("at", begin), lambda c: c["ok"]))
    for place in range(2, longest or 0):
        chain = chain.withColumn("c", F.filter(F.transform("c", extend(place)), lambda c: c["ok"]))

    def rated(c: Column) -> Column:
        n, size = F.col("size"), F.col("n")
        pen = F.aggregate(F.reverse(c["pens"]), F.lit(0.0), lambda t, p: t + p)
        span = c["end"] - c["start"] + 1
        edge = F.least(c["start"] / size, (size - c["end"]) / size)
        strength = (
            n / span * 0.3 + F.col("mean") * 0.25 + (F.lit(1.0) - pen / n) * 0.25 + (F.lit(1.0) - edge * 0.1) * 0.2
            + F.least(n * F.lit(0.05), F.lit(0.15))
        )
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["gaps"].alias("gaps"), F.greatest(F.lit(0.1), F.least(strength, F.lit(1.0))).alias("strength"))

    out = chain.filter(F.size("c") > 0).select(F.col("k").alias(key), "term", F.transform("c", rated).alias("m"))
    if shortest != 1:
        return out
    alone = table.filter("n = 1").select(F.col("words")[0]["word"].alias("token"), "term", F.col("n").alias("size"), "mean")
    each = df.select(F.col(key).alias("k"), F.col("n_tokens").cast("int").alias("n"), F.explode(F.arrays_zip(F.col(words).alias("w"), F.col(places).alias("p"))).alias("t"))
    hits = lookup_join(each.select("k", "n", F.col("t.w").alias("token"), F.col("t.p").alias("p")), alone, ["token"])
    c = F.struct(F.col("p").alias("start"), F.col("p").alias("end"), F.lit(0).alias("gaps"), F.array().cast("array<double>").alias("pens"))
    return out.unionByName(hits.select(F.col("k").alias(key), "term", F.array(rated(c)).alias("m")))
