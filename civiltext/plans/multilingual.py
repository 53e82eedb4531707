"""The multilingual scoring profile.

With a lexicon that fits into expressions the whole plan is row-local: one scan,
no shuffle, usable on streams. A larger lexicon uses joins on tokens instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiltext.functions.phrases import gap_span
from civiltext.functions.severity import sev_name, sev_rank, severity_of
from civiltext.functions.staging import any_member, computed, members, pattern_found, pattern_hits
from civiltext.functions.text import has, is_blank, word_tokens
from civiltext.operators import matching
from civiltext.operators.lexicon import LanguageRules, inline_rules, packaged_rules, rule_table
from civiltext.sources.storage import materialise
from civiltext.values import rules

DETECTIONS = "array<struct<type:string,value:string,lang:string,severity:string,confidence:double>>"
NATIVE_SCRIPT = {"hindi": r"[\x{0900}-\x{097F}]"}
WORD_CONFIDENCE = {"low": 0.3, "medium": 0.4}


def detection(kind: str, value: Column, lang: str | Column, severity: Column, confidence: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("type"), value.alias("value"), (F.lit(lang) if isinstance(lang, str) else lang).alias("lang"),
        severity.alias("severity"), confidence.cast("double").alias("confidence"),
    )


def word_confidence(severity: Column) -> Column:
    out = F.lit(0.8)
    for level, value in WORD_CONFIDENCE.items():
        out = F.when(severity == level, F.lit(value)).otherwise(out)
    return out


def phrase_confidence(n_words: int | Column, span: Column) -> Column:
    return (F.lit(0.3) + F.lit(0.2) * n_words / span) * F.lit(1.5)


def vocabulary(languages: dict[str, LanguageRules]) -> list[str]:
    return sorted({w for r in languages.values() for w in r.words})


def language_present(lang: str, r: LanguageRules, raw: Column, low: Column) -> Column:
    """A word, phrase or pattern of the language occurs, or its script does."""
    found = F.lit(lang == "english")
    if lang in NATIVE_SCRIPT:
        found = found | has(raw, NATIVE_SCRIPT[lang])
    if r.words:
        found = found | any_member("_hits", r.words)
    for phrase in r.phrases:
        found = found | F.contains(low, F.lit(phrase))
    for pattern in r.patterns:
        found = found | pattern_found(low, pattern)
    return found


def language_detections(lang: str, r: LanguageRules, raw: Column, low: Column) -> Column:
    """All detections of one language, in the order native, words, phrases, patterns."""
    parts = []
    for phrase, level in r.natives.items():
        conf = F.lit(0.4 if level == "medium" else 0.5)
        parts.append(F.when(F.contains(raw, F.lit(phrase)), F.array(detection("native_phrase", F.lit(phrase), lang, F.lit(level), conf))))
    if r.words:
        def word(t: Column) -> Column:
            level = severity_of(t, {k: v for k, v in r.severity.items() if k in r.words}, "medium")
            return detection("single_word", t, lang, level, word_confidence(level))
        parts.append(F.transform(members("_hits", r.words), word))
    for phrase in r.phrases:
        words = phrase.split()
        span = gap_span(low, words)
        level = F.lit(r.severity.get(phrase, "medium"))
        hit = detection("phrase", F.lit(phrase), lang, level, phrase_confidence(len(words), span))
        parts.append(F.when(span.isNotNull(), F.array(hit)))
    for pattern in r.patterns:
        parts.append(
            F.transform(
                pattern_hits(low, pattern),
                lambda v: detection("pattern", v, lang, F.lit("medium"), F.lit(0.4)),
            )
        )
    empty = F.array().cast(DETECTIONS)
    return F.concat(empty, *[F.coalesce(p.cast(DETECTIONS), empty) for p in parts])


def with_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("_low", F.lower(F.coalesce(text, F.lit("")))).withColumn("_tokens", word_tokens("_low", lower=False))


def detect_languages(df: DataFrame, languages: dict[str, LanguageRules] | None = None, text: str = "text") -> DataFrame:
    """Adds ``languages``: the languages whose terms or script occur, English always."""
    languages = languages or packaged_rules()
    df = with_tokens(df, text).withColumn("_hits", members("_tokens", vocabulary(languages)))
    raw = F.coalesce(F.col(text), F.lit(""))
    present = [F.when(language_present(l, r, raw, F.col("_low")), l) for l, r in languages.items()]
    found = F.when(is_blank(text), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*present)))
    return computed(df, {"languages": found}, drop=("_low", "_tokens", "_hits"))


def add_detections(
    df: DataFrame, languages: dict[str, LanguageRules], gate: bool = True, text: str = "text"
) -> DataFrame:
    """Adds ``word_count``, ``languages`` and ``detections`` in one pass over the row."""
    df = with_tokens(df, text).withColumn("_hits", members("_tokens", vocabulary(languages)))
    raw, low = F.coalesce(F.col(text), F.lit("")), F.col("_low")
    empty = F.array().cast(DETECTIONS)
    flags = {l: f"_is_{l}" for l in languages}
    df = df.select(
        *[c for c in df.columns if c not in ("_tokens",)],
        F.size("_tokens").alias("word_count"),
        *[(~is_blank(text) & language_present(l, r, raw, low)).alias(flags[l]) for l, r in languages.items()],
    )
    names = F.array_compact(F.array(*[F.when(F.col(flags[l]), l) for l in languages]))
    open_to = (lambda l: F.col(flags[l])) if gate else (lambda l: ~is_blank(text))
    found = F.concat(
        *[F.when(open_to(l), language_detections(l, r, raw, low)).otherwise(empty) for l, r in languages.items()]
    )
    return computed(
        df, {"word_count": F.col("word_count"), "languages": names, "detections": found},
        drop=("_low", "_hits", *flags.values()),
    )


def total_confidence(detections: Column) -> Column:
    return F.aggregate(detections, F.lit(0.0), lambda acc, d: acc + d["confidence"])


def combine(df: DataFrame, threshold: float, text: str = "text") -> DataFrame:
    """Confidence, severity and flag from the summed detections."""
    total, n, rank = F.col("_total"), F.col("n_detections"), F.col("_rank")
    capped = F.least(total, F.lit(1.0))
    conf = F.when(n > 2, F.least(capped * 1.2, F.lit(1.0))).otherwise(capped)
    df = df.withColumn("confidence", conf)
    df = df.withColumn("is_bullying", ~is_blank(text) & (F.col("confidence") >= threshold))
    return df.withColumn("severity", F.when(F.col("is_bullying"), sev_name(rank)).otherwise("none")).withColumn(
        "detection_method", F.when(is_blank(text), "empty_text").otherwise("multilingual")
    )


def score_multilingual(
    df: DataFrame, lex: DataFrame | None = None, threshold: float = 0.3, gate: bool = True, text: str = "text",
    key: str = "msg_id",
) -> DataFrame:
    """Score messages: adds word_count, languages, detections, n_detections, confidence, is_bullying, severity.

    ``lex`` is a term table; without one the packaged lexicon is used.
    """
    languages = packaged_rules() if lex is None else inline_rules(lex)
    if languages is None:
        return score_multilingual_joined(df, lex, threshold, gate, text, key)
    if lex is not None:  # these are present by themselves, whatever the table holds
        languages = {l: languages.get(l, LanguageRules()) for l in sorted({*languages, "english", *NATIVE_SCRIPT})}
    return summed(add_detections(df, languages, gate, text), threshold, text)


def summed(df: DataFrame, threshold: float, text: str) -> DataFrame:
    """Adds the scores of the detections."""
    ranks = F.array_max(F.transform("detections", lambda d: sev_rank(d["severity"])))
    df = computed(
        df,
        {
            "_total": total_confidence(F.col("detections")),
            "n_detections": F.size("detections"),
            "_rank": F.coalesce(ranks, F.lit(0)),
        },
    )
    return combine(df, threshold, text).drop("_total", "_rank")


def _matches(df: DataFrame, table: DataFrame, text: str, key: str) -> DataFrame:
    """Detections as rows with ``_order``, their place in the array of the inline plan."""
    texts = with_tokens(df.select(key, text), text)
    found = matching.term_matches(texts, table, key, "_tokens", "_low", "_low")
    known = F.when(F.col("severity").isin(rules.SEVERITIES), F.col("severity")).otherwise("medium")
    level = F.when(F.col("kind") == "word", known).otherwise(F.coalesce("severity", F.lit("medium")))
    found = found.withColumn("severity", level)
    confidence = (
        F.when(F.col("kind") == "word", word_confidence(F.col("severity")))
        .when(F.col("kind") == "phrase", phrase_confidence(F.col("n"), F.col("span"))).otherwise(0.4)
    )
    kind = F.when(F.col("kind") == "word", "single_word").otherwise(F.col("kind"))
    number = F.when(F.col("kind") == "word", 1).when(F.col("kind") == "phrase", 2).otherwise(3)
    cols = [key, "type", "value", "lang", "severity", "confidence", "_order"]
    found = found.select(
        "*", kind.alias("type"), confidence.alias("confidence"), F.struct("lang", number.alias("kind"), "term", "place").alias("_order")
    ).select(cols)
    native = matching.match_substrings(texts, table.filter("kind = 'native_phrase'"), key, text, lower=False).select(
        key, F.lit("native_phrase").alias("type"), F.col("term").alias("value"), "lang", "severity",
        F.when(F.col("severity") == "medium", 0.4).otherwise(0.5).alias("confidence"),
        F.struct("lang", F.lit(0).alias("kind"), "term", F.lit(0).alias("place")).alias("_order"),
    )
    return found.unionByName(native)


def all_detections(df: DataFrame, lex: DataFrame, text: str = "text", key: str = "msg_id") -> DataFrame:
    """Detections as a table from the four matching joins (native, words, phrases, patterns)."""
    return _matches(df, materialise(rule_table(lex), "rules"), text, key).drop("_order")


def text_key(key: str, text: str) -> Column:
    """One value for each different (key, text), so that repeated or null keys never mix their rows."""
    return F.md5(F.to_json(F.struct(F.col(key).alias("k"), F.col(text).alias("t"))))


def score_multilingual_joined(
    df: DataFrame, lex: DataFrame, threshold: float = 0.3, gate: bool = True, text: str = "text", key: str = "msg_id"
) -> DataFrame:
    """The same scores from joins, for lexicons of any size; one aggregate per message."""
    table = materialise(rule_table(lex), "rules")
    keyed = df.withColumn("_id", text_key(key, text))
    texts = keyed.filter(~is_blank(text)).select("_id", text).dropDuplicates(["_id"])
    found = _matches(texts, table, text, "_id").select(
        "_id", F.when(F.col("type").isin("single_word", "pattern"), F.col("lang")).alias("_shows"),
        F.struct("_order", F.struct("type", "value", "lang", "severity", "confidence").alias("d")).alias("_d"),
    )
    # the exact text of a phrase shows its language, a gapped one does not
    exact = matching.match_substrings(texts, table.filter("kind = 'phrase'"), "_id", text)
    exact = exact.select("_id", F.col("lang").alias("_shows"), F.lit(None).cast(found.schema["_d"].dataType).alias("_d"))
    # one message's own detections: bounded by its length
    per_text = found.unionByName(exact).groupBy("_id").agg(
        F.collect_set("_shows").alias("_shows"), F.array_sort(F.collect_list("_d")).alias("_found")
    )
    raw = F.coalesce(text, F.lit(""))
    always = F.array_compact(F.array(F.lit("english"), *[F.when(has(raw, s), l) for l, s in NATIVE_SCRIPT.items()]))
    shown = F.array_sort(F.array_union(always, F.coalesce("_shows", F.array().cast("array<string>"))))
    out = keyed.join(per_text, "_id", "left")
    out = computed(
        out,
        {
            "word_count": F.size(word_tokens(raw)),
            "languages": F.when(is_blank(text), F.array().cast("array<string>")).otherwise(shown),
            "_found": F.coalesce(F.transform("_found", lambda f: f["d"]).cast(DETECTIONS), F.array().cast(DETECTIONS)),
        },
        drop=("_id", "_shows"),
    )
    open_to = F.filter("_found", lambda d: F.array_contains("languages", d["lang"])) if gate else F.col("_found")
    return summed(out.withColumn("detections", open_to).drop("_found"), threshold, text)


def language_categories(scored: DataFrame, key: str = "msg_id") -> DataFrame:
    """Detections regrouped by language as categories with a fixed score.

    Works on the detection array of the row, so nothing is shuffled.
    """
    langs = F.array_distinct(F.transform("detections", lambda d: d["lang"]))
    cats = F.transform(
        langs,
        lambda l: F.struct(
            F.when(l == "english", "direct_insults").otherwise(F.concat(l, F.lit("_profanity"))).alias("category"),
            F.transform(F.filter("detections", lambda d: d["lang"] == l), lambda d: d["value"]).alias("items"),
            F.lit(0.5).alias("score"),
        ),
    )
    return scored.select(key, "severity", F.inline(cats))
