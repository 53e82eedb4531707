"""The rule-configured scoring profile: indicator languages, weights per severity, context boost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from civiltext.functions.features import context_config
from civiltext.functions.phrases import gap_span
from civiltext.functions.severity import sev_name, sev_rank, severity_of
from civiltext.functions.staging import computed, members, pattern_hits
from civiltext.functions.text import WORD, bounded_tokens, extract, has, is_blank, normalise, whitespace_words
from civiltext.operators import matching
from civiltext.operators.joins import SALTS
from civiltext.operators.lexicon import MAX_INLINE_TERMS, LanguageRules, inline_rules, rule_table
from civiltext.plans.multilingual import DETECTIONS, detection, total_confidence, vocabulary
from civiltext.sources.storage import materialise
from civiltext.values import rules, terms


CONTEXT_FIELDS = ("aggression", "targeting", "command", "indicators")


def packaged_config_rules() -> dict[str, LanguageRules]:
    """The shipped list alone, nothing left out."""
    return {
        lang: LanguageRules(d["words"], d["phrases"], d["patterns"], d["severity"])
        for lang, d in terms.SHIPPED_LANGUAGES.items()
    }


def indicator_languages(
    df: DataFrame, text: str = "text", indicators: dict | None = None, min_words: int = rules.MIN_INDICATOR_WORDS
) -> DataFrame:
    """Adds ``languages`` by script, by at least ``min_words`` indicator words or by a phrase."""
    indicators = indicators or rules.LANGUAGE_INDICATORS
    raw = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_lowered", F.lower(raw)).withColumn("_spaced", whitespace_words("_lowered"))
    found = []
    for lang, spec in indicators.items():
        hit = F.lit(False)
        if spec.get("script"):
            hit = has(raw, spec["script"])
        hit = hit | (F.size(members("_spaced", spec["words"])) >= min_words)
        for phrase in spec["phrases"]:
            hit = hit | F.contains("_lowered", F.lit(phrase))
        found.append(F.when(hit, lang))
    df = df.withColumn("languages", F.array_compact(F.array(*found)))
    langs = F.when(F.size("languages") > 0, F.col("languages")).otherwise(F.array(F.lit(rules.DEFAULT_LANGUAGE)))
    langs = F.when(is_blank(text), F.array().cast("array<string>")).otherwise(langs)
    return df.withColumn("languages", langs).drop("_lowered", "_spaced")


def gap_score(gaps: Column) -> Column:
    exact, one, more = rules.CONFIG_GAP_SCORES
    return F.when(gaps == 0, F.lit(exact)).when(gaps == 1, F.lit(one)).otherwise(F.lit(more))


def config_detections(lang: str, r: LanguageRules, norm: Column) -> Column:
    weight = rules.CONFIG_WEIGHTS
    empty = F.array().cast(DETECTIONS)
    parts = []
    if r.words:
        parts.append(
            F.transform(
                members("_hits", r.words),
                lambda t: detection(
                    "single_word", t, lang,
                    severity_of(t, {k: v for k, v in r.severity.items() if k in r.words}, "medium"),
                    F.lit(weight["word"]),
                ),
            )
        )
    for phrase in r.phrases:
        split = phrase.split()
        span = gap_span(norm, split)
        conf = gap_score(span - len(split)) * F.lit(weight["phrase"])
        hit = detection("phrase", F.lit(phrase), lang, F.lit(r.severity.get(phrase, "medium")), conf)
        parts.append(F.when(span.isNotNull(), F.array(hit)))
    for pattern in r.patterns:
        parts.append(
            F.transform(
                pattern_hits(norm, pattern),
                lambda v: detection("pattern", v, lang, F.lit("medium"), F.lit(weight["pattern"])),
            )
        )
    return F.concat(empty, *[F.coalesce(p.cast(DETECTIONS), empty) for p in parts])


def joined_detections(base: DataFrame, lex: DataFrame) -> DataFrame:
    """Adds ``_found``: the term detections of all languages, from joins, in the order of the inline plan."""
    weight = rules.CONFIG_WEIGHTS
    keyed = base.withColumn("_id", F.md5(F.to_json(F.struct("_norm"))))  # the terms see the normalised text only
    plain = [f.name for f in base.schema if isinstance(f.dataType, AtomicType)]
    # equal texts are dealt out by their row, so that one common text is not one key
    keyed = keyed.withColumn("_id", F.concat("_id", F.lit("/"), F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("string")))
    texts = keyed.select("_id", "_words", "_line", "_norm").dropDuplicates(["_id"])
    found = matching.term_matches(texts, materialise(rule_table(lex), "rules"), "_id", "_words", "_line", "_norm")
    word, phrase = F.col("kind") == "word", F.col("kind") == "phrase"
    known = F.when(F.col("severity").isin(rules.SEVERITIES), F.col("severity")).otherwise("medium")
    level = F.when(word, known).otherwise(F.coalesce("severity", F.lit("medium")))
    confidence = (
        F.when(word, F.lit(weight["word"])).when(phrase, gap_score(F.col("span") - F.col("n")) * F.lit(weight["phrase"]))
        .otherwise(F.lit(weight["pattern"]))
    )
    order = F.struct("lang", F.when(word, 1).when(phrase, 2).otherwise(3).alias("kind"), "term", "place")
    hit = F.struct(
        F.when(word, "single_word").otherwise(F.col("kind")).alias("type"), "value", "lang", level.alias("severity"),
        confidence.cast("double").alias("confidence"),
    )
    # one message's own detections: bounded by its length
    per_text = found.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), hit.alias("d")))).alias("_found"))
    return keyed.join(per_text, "_id", "left").withColumn("_found", F.transform("_found", lambda f: f["d"])).drop("_id")


def score_config(
    df: DataFrame, lex: DataFrame | None = None, text: str = "text", indicators: dict | None = None,
    max_terms: int = MAX_INLINE_TERMS,
) -> DataFrame:
    """Adds languages, context, detections, n_detections, n_languages, confidence, is_bullying, severity.

    A term table of over ``max_terms`` rows is joined instead of written into the expression.
    """
    languages = packaged_config_rules() if lex is None else inline_rules(lex, max_terms)
    raw = F.coalesce(F.col(text), F.lit(""))
    base = indicator_languages(df, text, indicators).withColumn("_norm", normalise(raw, "config"))
    # length bounds apply before phrases are matched, so phrases see the bounded tokens only
    base = base.withColumn("_words", bounded_tokens(extract(F.col("_norm"), WORD)))
    base = base.withColumn("_line", F.array_join("_words", " "))
    context = context_config(raw, F.col("_words"))
    joined = languages is None
    if joined:
        base, languages = joined_detections(base, lex), {}
    base = computed(
        base,
        {
            "languages": F.col("languages"),
            **{f"_c_{f}": context[f] for f in CONTEXT_FIELDS},
            "_hits": members("_words", vocabulary(languages)),
        },
    )
    empty = F.array().cast(DETECTIONS)
    norm, line = F.col("_norm"), F.col("_line")

    def of(lang: str, r: LanguageRules) -> Column:
        only_text = LanguageRules(patterns=r.patterns)
        only_terms = LanguageRules(r.words, r.phrases, [], r.severity)
        found = F.concat(config_detections(lang, only_terms, line), config_detections(lang, only_text, norm))
        return F.when(F.array_contains("languages", lang), found).otherwise(empty)

    terms_found = [of(l, r) for l, r in languages.items()]
    if joined:
        every = F.coalesce(F.col("_found").cast(DETECTIONS), empty)
        terms_found = [F.filter(every, lambda d: F.array_contains("languages", d["lang"]))]
    aggression = F.col("_c_aggression")
    style = detection("context", F.lit("aggressive_context"), "neutral", F.lit("medium"), aggression)
    found = F.concat(
        *terms_found,
        F.when(~is_blank(text) & (aggression > rules.CONFIG_AGGRESSION_MIN), F.array(style).cast(DETECTIONS)).otherwise(empty),
    )
    base = computed(base, {"detections": found}, drop=("_norm", "_words", "_line", "_hits", "_found"))
    out = computed(
        base,
        {
            "_total": total_confidence(F.col("detections")),
            "n_detections": F.size("detections"),
            "n_languages": F.size(F.array_distinct(F.transform("detections", lambda d: d["lang"]))),
            "_rank": F.coalesce(F.array_max(F.transform("detections", lambda d: sev_rank(d["severity"]))), F.lit(0)),
        },
    )
    n = F.col("n_detections")
    boost = F.lit(1.0)
    for least, factor in rules.CONFIG_COUNT_BOOST.items():
        boost = F.when(n >= least, F.lit(factor)).otherwise(boost)
    ctx = F.least(
        F.col("_c_aggression") + F.col("_c_targeting") + F.col("_c_command"),
        F.lit(rules.CONFIG_CONTEXT_MAX),
    )
    conf = F.when(n > 0, F.least(F.col("_total") * boost + ctx, F.lit(1.0))).otherwise(F.lit(0.0))
    limit = F.lit(0.3)
    for level, threshold in rules.CONFIG_SEVERITY_THRESHOLDS.items():
        limit = F.when(F.col("_rank") == rules.SEVERITIES.index(level), F.lit(threshold)).otherwise(limit)
    out = computed(out, {"confidence": conf})
    out = out.withColumn("is_bullying", (n > 0) & (F.col("confidence") >= limit))
    out = out.withColumn("severity", F.when(F.col("is_bullying"), sev_name(F.col("_rank"))).otherwise("none"))
    out = out.withColumn("context", F.struct(*[F.col(f"_c_{f}").alias(f) for f in CONTEXT_FIELDS]))
    return out.drop("_total", "_rank", *[f"_c_{f}" for f in CONTEXT_FIELDS])
