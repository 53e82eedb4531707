"""Matching messages against the term table with joins (any lexicon size).

The scoring plans match inside the row when the lexicon is small enough to be
inlined; these operators give the same matches as tables and also serve
lexicons of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from civiltext.functions.phrases import keep_strongest
from civiltext.functions.text import NOT_WORD, WORD, WORD_CHARS, count, whitespace_words, word_tokens
from civiltext.operators.joins import lookup_join
from civiltext.operators.lexicon import phrase_key
from civiltext.operators.rule_patterns import match_patterns
from civiltext.operators.substrings import contained_terms
from civiltext.operators.word_pairs import adaptive_phrases
from civiltext.sources.storage import materialise


def tokens(df: DataFrame, key: str = "msg_id", text: str = "text", token_column: Column | None = None) -> DataFrame:
    """One row per token with its position."""
    words = word_tokens(text) if token_column is None else token_column
    return df.select(key, F.posexplode(words).alias("pos", "token"))


def match_words(toks: DataFrame, lex: DataFrame, langs: DataFrame | None = None, key: str = "msg_id") -> DataFrame:
    """Tokens that are single-word terms; every occurrence and every language counts (M1)."""
    words = lex.filter("kind = 'word'").select(F.lower("term").alias("token"), "lang", "severity", "boost")
    found = lookup_join(toks, words, ["token"])
    return found if langs is None else found.join(langs, [key, "lang"], "left_semi")


def match_substrings(
    df: DataFrame, phrases: DataFrame, key: str = "msg_id", text: str = "text", lower: bool = True
) -> DataFrame:
    """Phrases contained in the lower-cased (or the raw) text, once per phrase (M2).

    Windows of the text are joined with the phrase table, whatever its size; texts do not move.
    """
    texts = df.select(key, (F.lower(text) if lower else F.col(text)).alias("_low"))
    found = contained_terms(texts, phrases.select("term", "lang", "severity"), key, "_low")
    return found.select(key, "term", "lang", "severity")


def match_phrases(
    toks: DataFrame, phrases: DataFrame, max_gap: int = 2, key: str = "msg_id"
) -> DataFrame:
    """First gap-tolerant match per (message, phrase): positions, span and gaps (M3).

    Only tokens that are words of some phrase survive the first join. Working
    from the last phrase word back, a window of ``max_gap + 1`` positions finds
    the nearest next word and the end of its chain. All windows share one
    partitioning by (message, phrase) and stream over the positions.
    """
    split = F.split("term", r"\s+")
    words = phrases.select(
        "term", "lang", "severity", F.size(split).alias("n"), F.posexplode(split).alias("place", "token")
    )
    hits = lookup_join(toks, words, ["token"])
    ahead = W.partitionBy(key, "lang", "term").orderBy("pos").rangeBetween(1, max_gap + 1)
    chain = hits.withColumn("end", F.when(F.col("place") == F.col("n") - 1, F.col("pos")))
    longest = phrases.agg(F.max(F.size(split))).first()[0] or 1
    for place in range(longest - 2, -1, -1):
        nearest = F.min(F.when(F.col("place") == place + 1, F.struct("pos", "end"))).over(ahead)
        chain = chain.withColumn("_next", nearest).withColumn(
            "end", F.when((F.col("place") == place) & (F.col("n") > place + 1), F.col("_next.end")).otherwise(F.col("end"))
        ).drop("_next")
    first = (
        chain.filter("place = 0 and end is not null")
        .groupBy(key, "lang", "term")
        .agg(F.min(F.struct(F.col("pos").alias("start"), "end", "n", "severity")).alias("m"))
    )
    span = F.col("m.end") - F.col("m.start") + 1
    return first.select(
        key, "lang", "term", F.col("m.severity").alias("severity"), F.col("m.start").alias("start"),
        F.col("m.end").alias("end"), span.alias("span"), (span - F.col("m.n")).alias("gaps"),
    )


def match_phrases_adaptive(toks: DataFrame, sizes: DataFrame, phrases: DataFrame, base_gap: int = 2, key: str = "msg_id") -> DataFrame:
    """Candidate matches of phrases with a window of their own for each word, for a phrase table of any size (M4).

    ``sizes`` has (key, n_tokens); ``phrases`` the terms. Returns (key, term, start, end, gaps, strength), one row
    for each place of a phrase's first word from which all later words are found at their nearest
    places. The tokens are gathered by message; ``adaptive_phrases`` takes them as they are.
    """
    lines = toks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_t"))
    lines = lines.select(key, F.col("_t.token").alias("_w"), F.col("_t.pos").alias("_p")).join(sizes.select(key, "n_tokens"), key)
    found = adaptive_phrases(lines, phrases, base_gap, key, "_w", "_p")
    return found.select(key, "term", F.inline("m"))


def match_phrase_keys(df: DataFrame, phrases: DataFrame, key: str = "msg_id", words: str = "w") -> DataFrame:
    """Windows that hold the words of a phrase in any order, counted as (key, term, lang, n).

    The windows have every length that occurs in the phrase table.
    """
    table = phrases.select("term", "lang", phrase_key("term").alias("k"), F.size(F.split("term", " ")).alias("size"))
    lengths = sorted(r["size"] for r in table.select("size").distinct().collect())  # a few numbers

    def windows(n: int) -> Column:
        # a slice at the end of the text is shorter: only complete ones are kept
        return F.filter(F.transform(words, lambda t, i: F.slice(words, i + 1, F.lit(n))), lambda g: F.size(g) == n)

    grams = F.concat(F.array().cast("array<array<string>>"), *[windows(n) for n in lengths])
    keys = df.select(key, F.explode(F.transform(grams, lambda g: F.array_join(F.array_sort(g), "|"))).alias("k"))
    found = lookup_join(keys, table.drop("size"), ["k"])
    return found.groupBy(key, "term", "lang").agg(F.count("*").alias("n"))


def match_punctuated_phrases(
    df: DataFrame, toks: DataFrame, phrases: DataFrame, max_gap: int = 2, key: str = "msg_id", text: str = "text"
) -> DataFrame:
    """Spans (key, lang, term, severity, span) of phrases whose words are not all plain tokens (M3).

    Texts holding the longest token of a phrase are compared by the expression of ``gap_regex``.
    """
    table = phrases.withColumn("_parts", F.array_sort(word_tokens("term"), lambda a, b: F.length(b) - F.length(a)))
    table = table.filter(F.size("_parts") > 0).select("term", "lang", "severity", F.get("_parts", F.lit(0)).alias("token"))
    candidates = lookup_join(toks.select(key, "token").distinct(), table, ["token"]).drop("token")
    texts = df.select(key, F.col(text).alias("_line"))

    def whole(word: Column) -> Column:
        literal = F.replace(word, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
        return F.concat(F.lit("\\Q"), literal, F.lit(f"\\E(?!{WORD_CHARS})"))

    def later(word: Column) -> Column:
        gap = F.concat(F.lit(f"{NOT_WORD}+(?:(?!"), whole(word), F.lit(f"){WORD_CHARS}++{NOT_WORD}+){{0,{max_gap}}}"))
        return F.concat(gap, whole(word))

    words = whitespace_words("term")
    rest = F.transform(F.slice(words, F.lit(2), F.size(words)), later)
    regex = F.concat(F.lit(f"(?<!{WORD_CHARS})"), whole(F.get(words, F.lit(0))), F.array_join(rest, ""))
    found = candidates.join(texts, key).withColumn("_regex", regex)
    span = F.nullif(count(F.expr("regexp_extract(_line, _regex, 0)"), WORD), F.lit(0))
    return found.select(key, "lang", "term", "severity", span.alias("span")).filter("span is not null")


def term_matches(
    texts: DataFrame, table: DataFrame, key: str, words: str, line: str, pattern_text: str
) -> DataFrame:
    """Words, phrases and patterns of a ``rule_table`` as (key, kind, lang, value, place, severity, n, span).

    ``words`` are the tokens of the text, ``line`` the lower-cased text that phrases are matched in.
    """
    toks = tokens(texts, key, token_column=F.col(words))
    phrases = table.filter("kind = 'phrase'")
    plain = F.regexp_like("term", F.lit(rf"^{WORD}(?:\s+{WORD})*$"))
    none, cols = F.lit(None).cast("int"), [key, "kind", "lang", "value", "place", "severity", "n", "span"]
    lexicon_words = table.filter("kind = 'word'").withColumn("boost", F.lit(None).cast("double"))
    single = match_words(toks, lexicon_words, key=key).select(
        "*", F.lit("word").alias("kind"), F.col("token").alias("value"), F.col("pos").alias("place"), none.alias("n"), none.alias("span")
    )
    gapped = match_phrases(toks, phrases.filter(plain), key=key).select(key, "lang", "term", "severity", "span")
    odd = match_punctuated_phrases(texts, toks, phrases.filter(~plain), key=key, text=line)
    phrased = gapped.unionByName(odd).select(
        "*", F.lit("phrase").alias("kind"), F.col("term").alias("value"), F.lit(0).alias("place"),
        F.size(whitespace_words("term")).alias("n"),
    )
    patterns = match_patterns(texts, table.filter("kind = 'pattern'"), key, pattern_text).select(
        key, "lang", F.lit("pattern").alias("kind"), F.posexplode("values").alias("place", "value"),
        F.lit("medium").alias("severity"), none.alias("n"), none.alias("span"), "pattern",
    )
    return (
        single.select(*cols, F.lit("").alias("term")).unionByName(phrased.select(*cols, "term"))
        .unionByName(patterns.select(*cols, F.col("pattern").alias("term")))
    )


def resolve_overlaps(matches: DataFrame, key: str = "msg_id", threshold: float = 0.5) -> DataFrame:
    """Keep the strongest matches per (message, phrase); drop those overlapping one by over half (M5).

    Matches are first split into islands that do not touch each other, so the
    ordered fold only ever sees a handful of neighbouring matches.
    """
    w = W.partitionBy(key, "term").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    islands = matches.withColumn("_new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn(
        "_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))
    )
    kept = islands.groupBy(key, "term", "_island").agg(
        keep_strongest(F.collect_list(F.struct("start", "end", "gaps", "strength")), threshold).alias("_kept")
    )
    return kept.select(key, "term", F.inline("_kept"))


def intent_keywords(
    df: DataFrame, indicators: DataFrame, key: str = "msg_id", tokens_col: str = "tokens",
    text: str = "norm", cap: float = 0.5,
) -> DataFrame:
    """Capped intent score: 0.1 per keyword found, times a severity factor (M7)."""
    factor = F.when(F.col("severity") == "low", 0.5).when(F.col("severity") == "high", 1.5).otherwise(1.0)
    table = indicators.select(
        F.col("indicator").alias("_group"), F.lower("keyword").alias("_kw"), (F.lit(0.1) * factor).alias("_w")
    )
    # one rule for every size: a keyword counts once in its group, an empty one never
    table = table.filter("_kw <> ''").groupBy("_group", "_kw").agg(F.max("_w").alias("_w"))
    rows = df.withColumn("_row", F.xxhash64(text, tokens_col))
    terms = table.withColumnRenamed("_kw", "term")
    inside = contained_terms(rows.select(F.struct(key, "_row").alias("_id"), F.col(text).alias("_text")), terms, "_id", "_text")
    equal = lookup_join(rows.select(F.struct(key, "_row").alias("_id"), F.explode(F.array_distinct(tokens_col)).alias("term")), terms, ["term"])
    # a keyword that is both a token and a part of the text counts once
    found = inside.unionByName(equal.select(*inside.columns)).distinct().select(F.col(f"_id.{key}").alias(key), "_w")
    return found.groupBy(key).agg(F.least(F.sum("_w"), F.lit(cap)).alias("intent_score"))


def score_unique(df: DataFrame, scorer, key: str = "msg_id", text: str = "text", hot: int = 100_000) -> DataFrame:
    """Score each distinct text once and join the result back (M9).

    Only the hash travels in the join back. Hashes with more than ``hot`` copies
    (there are at most rows/hot of them) are split over salts on both sides.
    """
    hashed = df.select(key, F.md5(text).alias("h"), text)
    # grouped once; both sides read the written table
    unique = materialise(hashed.groupBy("h").agg(F.first(text).alias(text), F.count("*").alias("_copies")), "unique-texts")
    parts = F.ceil(F.col("_copies") / hot).cast("int")
    scored = scorer(unique).drop(text).withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    heavy = unique.select("h", parts.alias("_parts")).filter("_parts > 1")
    keys = lookup_join(hashed.select(key, "h"), heavy, ["h"], "left")
    keys = keys.withColumn(
        "_salt", F.pmod(F.xxhash64(key), F.coalesce("_parts", F.lit(1)).cast("bigint")).cast("int")
    ).drop("_parts")
    return keys.join(scored.drop("_copies"), ["h", "_salt"]).drop("_salt", "h")


def unmatched(df: DataFrame, detections: DataFrame, key: str = "msg_id") -> DataFrame:
    """Messages without any detection."""
    return df.join(detections.select(key), key, "left_anti")
