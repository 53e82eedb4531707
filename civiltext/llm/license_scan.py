"""License scan: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment.

Everything happens inside the row with built-in functions, so the scan has no exchange at any size:

1. A text becomes its words: runs of letters, digits and characters outside ASCII, A-Z lower-cased.
2. Prefilter: the words are intersected with the rarest keywords of all rules. Texts without any, nearly
   all, are done. For the others the rules remain whose every keyword is among the words.
3. The remaining expressions are matched against the words with one space between them. A match is
   marked in the text, and the marks' places among the words are the detection's interval.
4. Suppression: a detection goes if a rule at least as strong has one that is larger and contains it,
   or a stronger rule has the same interval. Each rule's intervals are written out as one number
   for each word, so that the step is linear in words and detections.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiltext.functions.staging import computed, let
from civiltext.llm import signatures

#: The contract's own phrases.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Their keywords, the rarest first.
BASE_NEEDS = {"gpl": "gnu license general public", "apache": "apache license", "cc-by": "cc by", "mit": "license mit"}
#: How sure a detection of each rank is.
CONFIDENCE = [1.0, 0.95, 0.8, 0.6, 0.3]
BASE_RANK = 2
OPEN, SHUT = "\x01", "\x02"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Signature:
    """``needs``: groups of keywords, one of each group is in every match. A ``base`` rule is never suppressed."""

    label: str
    rank: int
    needs: tuple[tuple[str, ...], ...]
    regex: str
    base: bool = False


def _rules() -> list[Signature]:
    groups = lambda needs: tuple(tuple(g.split("|")) for g in needs.split(" "))
    base = [Signature(label, BASE_RANK, groups(BASE_NEEDS[label]), phrase, True) for phrase, label in BASE_PHRASES.items()]
    own = [
        Signature(label, rank, groups(needs), regex)
        for rank, table in enumerate((signatures.TAGS, signatures.VERSIONED, signatures.NAMED, signatures.SENTENCES, signatures.NOTICES))
        for label, needs, regex in table
    ]
    return base + own


#: The base phrases, then all signatures in their order.
RULES = _rules()


def ascii_lower(text: Column) -> Column:
    """A-Z in small letters. ``lower`` does that and changes letters outside ASCII into others outside it, which no
    rule tells apart; the only two characters that would become ASCII letters take the exact way."""
    odd = F.contains(text, F.lit("İ")) | F.contains(text, F.lit("K"))
    return F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def _strings(values) -> Column:
    return F.array(*map(F.lit, dict.fromkeys(values)))


def _table(rules: list[Signature]) -> Column:
    """The rules as one literal array."""
    entry = lambda i, r: F.struct(
        F.lit(i).alias("i"), F.lit(r.label).alias("label"), F.lit(r.rank).alias("rank"), F.lit(r.base).alias("base"),
        F.array(*[_strings(g) for g in r.needs]).alias("needs"), F.lit(f"(?<![^ ])(?:{r.regex})(?![^ ])").alias("regex"),
    )
    return F.array(*[entry(i, r) for i, r in enumerate(rules)])


def _places(words: Column, hit) -> Column:
    """The numbers of the words for which ``hit`` holds."""
    return F.filter(F.transform(words, lambda w, i: F.when(hit(w), i)), lambda i: i.isNotNull())


def _cover(marked: Column) -> Column:
    """For every word the number of the match that holds it, from 1, or 0."""
    n_words = lambda s: F.size(F.array_remove(F.split(s, " "), ""))

    def part(p: Column, i: Column) -> Column:
        head = F.when(i > 0, F.substring_index(p, SHUT, 1)).otherwise(F.lit(""))
        rest = F.when(i > 0, F.substring_index(p, SHUT, -1)).otherwise(p)
        return F.concat(F.array_repeat(i, n_words(head)), F.array_repeat(F.lit(0), n_words(rest)))

    return F.flatten(F.transform(F.split(marked, OPEN), part))


def _suppressed(all_found: Column, matched: Column) -> Column:
    """The detections that no rule of ``matched`` suppresses."""

    def without(found: Column, rule: Column) -> Column:
        def left(cover: Column) -> Column:
            def stays(d: Column) -> Column:
                here = F.get(cover, d["start"])
                by = F.get(rule["spans"], here - 1)
                inside = (here > 0) & (here == F.get(cover, d["end"]))
                larger = (by["end"] - by["start"]) > (d["end"] - d["start"])
                stronger = (rule["rank"] < d["rank"]) | ((rule["rank"] == d["rank"]) & (rule["i"] < d["i"]))
                return d["base"] | ~F.coalesce(inside & ((larger & (rule["rank"] <= d["rank"])) | stronger & ~larger), F.lit(False))

            return F.filter(found, stays)

        return let(_cover(rule["marked"]), left)

    return F.when(F.size(matched) > 1, F.aggregate(matched, all_found, without)).otherwise(all_found)


_FOUND = "array<struct<start:int,end:int,label:string,rank:int,i:int,base:boolean>>"


def detections(words: Column, rules: list[Signature] = RULES) -> Column:
    """The detections in an array of words: (start, end, label, rank, i, base), words counted from 0, the end inclusive."""
    first = _strings(w for r in rules for w in r.needs[0])
    every = _strings(w for r in rules for g in r.needs for w in g)

    def scan(line: Column, keywords: Column) -> Column:
        able = F.filter(_table(rules), lambda r: F.forall(r["needs"], lambda g: F.arrays_overlap(g, keywords)))
        marked = F.transform(able, lambda r: F.struct(
            r["i"].alias("i"), r["label"].alias("label"), r["rank"].alias("rank"), r["base"].alias("base"),
            F.regexp_replace(line, r["regex"], F.lit(f"{OPEN}$0{SHUT}")).alias("marked"),
        ))
        hit = F.filter(marked, lambda m: F.contains(m["marked"], F.lit(OPEN)))

        def spans(m: Column) -> Column:
            at = lambda hit: lambda w: _places(w, hit)
            split = F.split(m["marked"], " ")
            both = let(split, lambda w: F.arrays_zip(at(lambda x: F.startswith(x, F.lit(OPEN)))(w).alias("start"), at(lambda x: F.endswith(x, F.lit(SHUT)))(w).alias("end")))
            return F.struct(m["i"].alias("i"), m["label"].alias("label"), m["rank"].alias("rank"), m["base"].alias("base"), m["marked"].alias("marked"), both.cast("array<struct<start:int,end:int>>").alias("spans"))

        def resolved(matched: Column) -> Column:
            every_span = F.flatten(F.transform(matched, lambda m: F.transform(m["spans"], lambda s: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), m["label"].alias("label"), m["rank"].alias("rank"), m["i"].alias("i"), m["base"].alias("base"),
            ))))
            return let(every_span.cast(_FOUND), lambda found: _suppressed(found, matched))

        return let(F.transform(hit, spans), resolved)

    none = F.array().cast(_FOUND)
    possible = F.size(F.array_intersect(words, first)) > 0
    return F.when(possible, let(F.array_intersect(words, every), lambda k: scan(F.array_join(words, " "), k))).otherwise(none)


def scan_licenses(docs: DataFrame, text: str = "text", rules: list[Signature] = RULES) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and ``detections``.

    ``base`` counts the places of the contract's phrases, which stay whatever contains them; ``labels``
    adds those of the detections that are left. The score is the confidence of the strongest detection,
    0 without any. A null text is empty. Every row comes back once; columns of ``docs`` with a
    result's name are replaced.
    """
    new = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    rest = docs.drop(*[c for c in docs.columns if c.lower() in new and c != text])
    free = lambda name: name if name not in {c.lower() for c in docs.columns} else free(f"_{name}")
    words, found = free("_words"), free("_found")
    t = ascii_lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    cut = rest.withColumn(words, F.array_remove(F.split(t, BREAK), ""))
    scanned = computed(cut, {found: detections(F.col(words), rules), "n_words": F.size(words).cast("long")}, drop=(words,))
    base = F.filter(found, lambda d: d["base"])
    start = F.transform(base, lambda d: d["start"])
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda d: d["label"]))), ",")
    ranks = F.array_min(F.transform(found, lambda d: d["rank"]))
    kept = [c for c in rest.columns if c not in new]
    return scanned.select(
        *kept, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(start).cast("long").alias("first_word"),
        F.array_max(start).cast("long").alias("last_word"), labels(base).alias("base_labels"), labels(F.col(found)).alias("labels"),
        F.coalesce(F.get(F.array(*map(F.lit, CONFIDENCE)), ranks), F.lit(0.0)).alias("score"), F.col(found).alias("detections"),
    )
