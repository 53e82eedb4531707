"""Relational operators on the term table (set operations, merges and look-ups).

The canonical table is ``term, kind, lang, category, severity, boost, origin, version``
with ``kind`` one of ``word, phrase, pattern, native_phrase, severity``. Rows of kind
``severity`` hold a severity map: they rate a term without making it match.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civiltext.functions.severity import sev_rank
from civiltext.functions.text import strip, whitespace_words
from civiltext.operators.joins import lookup_join
from civiltext.operators.rule_patterns import KINDS, compiles
from civiltext.values import rules, terms

LEXICON_SCHEMA = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("boost", T.DoubleType()),
        T.StructField("origin", T.StringType()),
        T.StructField("version", T.IntegerType()),
    ]
)
MAX_INLINE_TERMS = 20_000


@dataclass
class LanguageRules:
    """The terms of one language, small enough to be written into an expression."""

    words: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    patterns: list[str] = field(default_factory=list)
    severity: dict[str, str] = field(default_factory=dict)
    natives: dict[str, str] = field(default_factory=dict)


def language_rows(languages: dict, origin: str, version: int = 1) -> list[tuple]:
    """Canonical rows of a per-language term dictionary."""
    rows = []
    for lang, data in languages.items():
        severity = data.get("severity", {})
        for key, kind in (("words", "word"), ("phrases", "phrase"), ("patterns", "pattern")):
            for term in data.get(key, []):
                rows.append((term, kind, lang, None, severity.get(term), None, origin, version))
        for term, level in severity.items():
            rows.append((term, "severity", lang, None, level, None, origin, version))
    return rows


def packaged_lexicon(spark: SparkSession, which: str = "shipped") -> DataFrame:
    """One of the packaged term lists: ``default``, ``shipped`` or ``native``."""
    if which == "native":
        rows = [
            (t, "native_phrase", lang, None, s, None, "default", 1)
            for lang, m in terms.NATIVE_PHRASES.items()
            for t, s in m.items()
        ]
    else:
        source = {"default": terms.DEFAULT_LANGUAGES, "shipped": terms.SHIPPED_LANGUAGES}[which]
        rows = language_rows(source, which)
    return spark.createDataFrame(rows, LEXICON_SCHEMA)


def multilingual_lexicon(spark: SparkSession) -> DataFrame:
    """Defaults merged with the shipped list, context-only words left out, native phrases added."""
    merged = merge_lexicons(packaged_lexicon(spark, "default"), packaged_lexicon(spark, "shipped"))
    return exclude_context_terms(merged).unionByName(packaged_lexicon(spark, "native"))


def packaged_rules() -> dict[str, LanguageRules]:
    """The multilingual lexicon as inline rules, without a Spark job."""
    out: dict[str, LanguageRules] = {}
    for source in (terms.DEFAULT_LANGUAGES, terms.SHIPPED_LANGUAGES):
        for lang, data in source.items():
            mine = out.setdefault(lang, LanguageRules())
            for key in ("words", "phrases", "patterns"):
                getattr(mine, key).extend(t for t in data[key] if t not in getattr(mine, key))
            mine.severity.update(data["severity"])
    for lang, words in terms.CONTEXT_ONLY_WORDS.items():
        out[lang].words = [w for w in out[lang].words if w not in words]
    for lang, natives in terms.NATIVE_PHRASES.items():
        out[lang].natives = dict(natives)
    return out


def _kept_term() -> Column:
    """Words and phrases are matched in lower case, patterns and native phrases as they are written."""
    return F.when(F.col("kind").isin("pattern", "native_phrase"), F.col("term")).otherwise(F.lower("term"))


def _usable() -> Column:
    """The rule has a known kind, and a pattern compiles."""
    return F.when(F.col("kind") == "pattern", compiles(F.col("term"))).otherwise(F.coalesce(F.col("kind").isin(KINDS), F.lit(False)))


def inline_rules(lex: DataFrame, max_terms: int = MAX_INLINE_TERMS) -> dict[str, LanguageRules] | None:
    """Inline rules of a term table, or ``None`` when it holds more than ``max_terms`` rows.

    The rules are those of ``rule_table``.
    """
    rank = F.coalesce(sev_rank(F.col("severity")), F.lit(0)).alias("rank")
    blank = (F.size(whitespace_words("term")) == 0).alias("blank")
    rows = lex.select("term", "kind", "lang", "severity", _kept_term().alias("kept"), F.lower("term").alias("low"), rank, blank, _usable().alias("usable"))
    rows = rows.limit(max_terms + 1).collect()
    if len(rows) > max_terms:
        return None
    out: dict[str, LanguageRules] = {}
    rows = [r for r in rows if r.term is not None and not r.blank and r.usable]
    for r in sorted(rows, key=lambda r: (r.lang, r.kind, r.kept, r.term, r.rank, r.severity or "")):
        mine = out.setdefault(r.lang, LanguageRules())
        if r.kind == "native_phrase":
            mine.natives[r.kept] = r.severity
            continue
        if r.kind != "severity" and r.kept not in getattr(mine, r.kind + "s")[-1:]:
            getattr(mine, r.kind + "s").append(r.kept)
        if r.severity is not None:
            mine.severity[r.low] = r.severity
    return out


def rule_table(lex: DataFrame) -> DataFrame:
    """The rules of a term table of any size: (term, kind, lang, severity), each term of a kind and language once.

    A term takes the last severity stated for its spelling in lower case, by kind (pattern, phrase,
    severity, word), then by term, then the strongest. Native phrases are rated by their own rows
    alone. Blank terms and patterns that do not compile are found nowhere.
    """
    rank = F.coalesce(sev_rank(F.col("severity")), F.lit(0)).alias("rank")
    rows = lex.filter(F.size(whitespace_words("term")) > 0).withColumn("_usable", _usable()).filter("_usable").select(
        _kept_term().alias("term"), "kind", "lang", "severity", F.lower("term").alias("low"), F.col("term").alias("as"), rank
    )
    stated = rows.filter("kind <> 'native_phrase' and severity is not null")
    levels = stated.groupBy("lang", "low").agg(F.max(F.struct("kind", "as", "rank", "severity"))["severity"].alias("_level"))
    own = F.max(F.struct("rank", "severity"))["severity"]
    once = rows.filter("kind <> 'severity'").groupBy("lang", "kind", "term", "low").agg(own.alias("_own"))
    level = F.when(F.col("kind") == "native_phrase", F.col("_own")).otherwise(F.col("_level"))
    return once.join(levels, ["lang", "low"], "left").select("term", "kind", "lang", level.alias("severity"))


# -- L1, L2: rules that classify a term ------------------------------------------------


def _contains_any(term: Column, stems: list[str]) -> Column:
    out = F.lit(False)
    for stem in stems:
        out = out | F.contains(term, F.lit(stem))
    return out


def term_category(term: Column, kind: Column) -> Column:
    """Category of a term by its first matching stem group (L1)."""
    word = (
        F.when(_contains_any(term, terms.THREAT_STEMS), "threats")
        .when(_contains_any(term, terms.PROFANITY_STEMS), "profanity")
        .otherwise("insult")
    )
    phrase = (
        F.when(_contains_any(term, terms.THREAT_PHRASES), "threats")
        .when(_contains_any(term, terms.EXCLUSION_PHRASE_STEMS), "social_exclusion")
        .when(~_contains_any(term, terms.NOT_INSULT_PHRASE_STEMS), "direct_insults")
    )
    return F.when(kind == "phrase", phrase).otherwise(word)


def categorise_terms(lex: DataFrame) -> DataFrame:
    term = F.lower(strip("term"))
    return lex.withColumn("term", term).withColumn("category", term_category(F.col("term"), F.col("kind")))


def assign_language(lex: DataFrame) -> DataFrame:
    """Language by romanised markers; words that only count in context are skipped (L2)."""
    term = F.lower(strip("term"))
    skipped = (F.col("kind") == "word") & (F.col("term") == "nobody")
    return (
        lex.withColumn("term", term)
        .filter((F.col("term") != "") & ~skipped)
        .withColumn("lang", F.when(_contains_any(F.col("term"), terms.HINDI_MARKERS), "hindi").otherwise("english"))
    )


# -- L3..L8, L11, L12: set operations ---------------------------------------------------


def merge_lexicons(base: DataFrame, override: DataFrame) -> DataFrame:
    """Union without duplicates; severities of ``override`` win (L3).

    The severity map is part of the result: its winning rows rate every term of
    the same language and spelling, also terms that only one side lists.
    """
    # dealt by the key of the ratings, as ``override`` may be already: then its rows do not move again
    base = base.repartition("lang", "term")
    both = base.withColumn("_prio", F.lit(0)).unionByName(override.withColumn("_prio", F.lit(1)))
    # max_by keeps partial aggregation, so a hot key never gathers in one task; sorted by term first, since a sort
    # compares the beginnings of the first column before it looks at rows
    merged = both.groupBy("term", "lang", "kind").agg(
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_prio"))).alias(c)
            for c in ("category", "severity", "boost")
        ],
        F.min_by("origin", "_prio").alias("origin"),
        F.max("version").alias("version"),
    )
    # a kind comes once for each language and spelling; a term without one of them has no rating but its own
    level = F.max(F.when(F.col("kind") == "severity", F.col("severity"))).over(W.partitionBy("term", "lang"))
    level = F.when(F.col("lang").isNotNull() & F.col("term").isNotNull(), level)
    return merged.withColumn("severity", F.coalesce(level, "severity")).select(*LEXICON_SCHEMA.names)


def clean_terms(new: DataFrame, term: str = "term") -> DataFrame:
    """Trim, lower-case and drop blanks; a term with a space is a phrase."""
    cleaned = F.lower(strip(term))
    return (
        new.withColumn("term", cleaned)
        .filter(F.col("term") != "")
        .withColumn("kind", F.when(F.contains("term", F.lit(" ")), "phrase").otherwise("word"))
    )


def upsert_terms(lex: DataFrame, new: DataFrame, lang: str, severity: str = "medium") -> DataFrame:
    """Append the terms of ``new`` that the lexicon does not yet hold for ``lang`` (L4)."""
    return lex.unionByName(added_terms(lex, new, lang, severity))


def added_terms(lex: DataFrame, new: DataFrame, lang: str, severity: str = "medium") -> DataFrame:
    fresh = clean_terms(new.select("term")).distinct().withColumn("lang", F.lit(lang))
    known = lex.select("term", "kind", "lang")
    added = lookup_join(fresh, known, ["term", "kind", "lang"], "left_anti")
    return added.select(
        "term", "kind", "lang", F.lit(None).cast("string").alias("category"), F.lit(severity).alias("severity"),
        F.lit(None).cast("double").alias("boost"), F.lit("user").alias("origin"), F.lit(1).alias("version"),
    )


def remove_terms(lex: DataFrame, gone: DataFrame) -> DataFrame:
    """Drop terms, and their severities, whatever their case."""
    keys = gone.select(F.lower(strip("term")).alias("_key")).distinct()
    return lookup_join(lex.withColumn("_key", F.lower("term")), keys, ["_key"], "left_anti").drop("_key")


def list_terms(lex: DataFrame, severity: str | None = None) -> DataFrame:
    """Terms, optionally of one severity, sorted."""
    out = lex.filter(F.col("kind").isin("word", "phrase"))
    if severity:
        out = out.filter(F.coalesce("severity", F.lit("medium")) == severity)
    return out.orderBy("kind", "term", "lang")


def lexicon_stats(lex: DataFrame) -> DataFrame:
    """Counts per (lang, kind), per severity and in total."""
    named = lex.filter("kind <> 'severity'").withColumn("severity", F.coalesce("severity", F.lit("medium")))
    return named.groupingSets(
        [["lang", "kind"], ["severity"], []], "lang", "kind", "severity"
    ).agg(F.grouping_id().cast("int").alias("gid"), F.count("*").alias("n"))


def exclude_context_terms(lex: DataFrame) -> DataFrame:
    """Drop words that are too ambiguous alone."""
    drop = F.lit(False)
    for lang, words in terms.CONTEXT_ONLY_WORDS.items():
        drop = drop | ((F.col("lang") == lang) & F.lower("term").isin(words))
    return lex.filter(~(drop & (F.col("kind") == "word")))


def explode_phrase_words(lex: DataFrame) -> DataFrame:
    """Every word of a multi-word keyword also becomes a keyword."""
    words = (
        lex.filter("kind = 'phrase'")
        .withColumn("term", F.explode(F.split("term", r"\s+")))
        .withColumn("kind", F.lit("word"))
    )
    return lex.select("term", "kind", "lang").union(words.select("term", "kind", "lang")).distinct()


def validate_terms(new: DataFrame, max_length: int = rules.MAX_TERM_LENGTH) -> DataFrame:
    """Keep trimmed, lower-cased terms of 1 to ``max_length`` characters."""
    return new.withColumn("term", F.lower(strip("term"))).filter(F.length("term").between(1, max_length))


def resolve_severity(found: DataFrame, lex: DataFrame, default: str = "medium") -> DataFrame:
    """Rate found terms by the severity map."""
    levels = lex.filter("kind = 'severity'").select("lang", "term", F.col("severity").alias("_level"))
    out = lookup_join(found, levels, ["lang", "term"], "left")
    return out.withColumn("severity", F.coalesce("_level", F.lit(default))).drop("_level")


# -- L10, L13: phrase keys and profiles ---------------------------------------------------


def phrase_key(term: Column | str) -> Column:
    """Order-insensitive key: the sorted words of a phrase."""
    return F.array_join(F.array_sort(F.split(F.col(term) if isinstance(term, str) else term, " ")), "|")


def phrase_profile(phrases: DataFrame, base_gap: int = 2) -> DataFrame:
    """Importance and search windows of every phrase word for three text lengths."""
    words = F.split(F.lower("term"), " ")
    out = phrases.withColumn("n", F.size(words)).withColumn("_words", words)
    flexible = F.arrays_overlap("_words", F.array(*map(F.lit, rules.FLEXIBLE_WORDS)))
    out = out.withColumn("_flex", F.when(flexible, 1.3).otherwise(1.0))
    out = out.select("*", F.posexplode("_words").alias("place", "word"))
    edge = F.least(F.col("place"), F.col("n") - 1 - F.col("place"))
    meaning = F.when(F.col("word").isin(rules.STRONG_WORDS), 0.4).when(F.col("word").isin(rules.ADDRESS_WORDS), 0.2)
    place = F.when(edge == 0, 0.2).when(edge == 1, 0.1)
    length = F.when(F.length("word") <= 2, -0.2).when(F.length("word") >= 6, 0.1)
    zero = F.lit(0.0)
    score = F.lit(0.5) + F.coalesce(meaning, zero) + F.coalesce(place, zero) + F.coalesce(length, zero)
    out = out.withColumn("importance", F.least(F.greatest(score, F.lit(0.1)), F.lit(1.0)))
    scale = F.when(F.col("n") <= 2, 1.0).when(F.col("n") <= 4, 1.2).otherwise(1.5)
    for bucket, factor in (("short", 0.8), ("medium", 1.0), ("long", 1.2)):
        limit = F.greatest(F.lit(1), F.least((F.lit(base_gap) * scale * F.lit(factor) * F.col("_flex")).cast("int"), F.lit(5)))
        wide = F.when(edge == 0, 1.3).otherwise(1.0)
        window = (limit * (F.lit(0.5) + F.col("importance")) * wide).cast("int")
        out = out.withColumn(f"window_{bucket}", F.greatest(F.lit(1), F.least(window, F.lit(8))))
    return out.drop("_words", "_flex")


def lexicon_coverage(required: DataFrame, lex: DataFrame) -> DataFrame:
    """Which required terms the lexicon holds (Q11)."""
    known = lex.filter("kind <> 'severity'").select("term").distinct().withColumn("_known", F.lit(True))
    out = lookup_join(required, known, ["term"], "left")
    return out.withColumn("present", F.coalesce("_known", F.lit(False))).drop("_known")
