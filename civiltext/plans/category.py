"""The category scoring profile: categories, context, intent and sentiment combined.

Row-local like the other profiles: normalise once, match per category inside the
row, then derive the confidence from the category scores.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiltext.functions import features as feat
from civiltext.functions.phrases import adaptive_matches, keep_strongest
from civiltext.functions.severity import explain, reduce_short, sev_name, sev_rank
from civiltext.functions.staging import computed, members, pattern_hits
from civiltext.functions.text import category_tokens, is_blank, is_polite, whitespace_words
from civiltext.operators.lexicon import LanguageRules
from civiltext.values import rules, terms

ADDRESSED = ["you", "your", "yourself"]


@dataclass
class Category:
    name: str
    severity: str = "medium"
    boost: float = 0.3
    words: list[str] = field(default_factory=list)
    phrases: list[tuple[str, float]] = field(default_factory=list)  # (phrase, boost)
    patterns: list[str] = field(default_factory=list)


def _has_stem(term: str, stems: list[str]) -> bool:
    return any(s in term for s in stems)


def categories_from_languages(languages: dict[str, LanguageRules]) -> list[Category]:
    """Regroup per-language terms into the four categories."""
    words = [w.lower().strip() for r in languages.values() for w in r.words]
    phrases = [p.lower().strip() for r in languages.values() for p in r.phrases]
    threats = [w for w in words if _has_stem(w, terms.THREAT_STEMS)]
    threat_phrases = [p for p in phrases if _has_stem(p, terms.THREAT_PHRASES)]
    pool = [p for p in phrases if p not in threat_phrases]
    extra = {
        "direct_insults": (
            [w for w in words if w not in threats],
            [p for p in pool if not _has_stem(p, terms.NOT_INSULT_PHRASE_STEMS)],
        ),
        "threats": (threats, threat_phrases),
        "social_exclusion": ([], [p for p in pool if _has_stem(p, terms.EXCLUSION_PHRASE_STEMS)]),
    }
    out = []
    for name, s in terms.CATEGORY_SETTINGS.items():
        more_words, more_phrases = extra.get(name, ([], []))
        out.append(
            Category(
                name, s["severity"], s["boost"], sorted(set(s["words"]) | set(more_words)),
                [(p, s["boost"] * 1.5) for p in dict.fromkeys(more_phrases)], s["patterns"],
            )
        )
    return out


def categories_from_settings(settings: dict | None = None) -> list[Category]:
    """Categories of a category-layout file; missing fields get their defaults (S3)."""
    out = []
    for name, s in (settings or terms.DEFAULT_CATEGORIES).items():
        boost = s.get("confidence_boost", 0.3)
        keywords = [k.lower().strip() for k in s.get("keywords", [])]
        multi = [k for k in keywords if " " in k]
        words = {k for k in keywords if " " not in k} | {w for k in multi for w in k.split()}
        phrases = [(k, boost) for k in multi]
        phrases += [(p.lower().strip(), boost * 1.5) for p in s.get("multi_word_phrases", [])]
        out.append(Category(name, s.get("severity", "medium"), boost, sorted(words), phrases, s.get("patterns", [])))
    return out


def packaged_categories() -> list[Category]:
    return categories_from_languages(
        {l: LanguageRules(d["words"], d["phrases"], d["patterns"]) for l, d in terms.SHIPPED_LANGUAGES.items()}
    )


FEATURES = ("caps", "punct", "targeting", "commands", "emphasis", "structure")


def add_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the six style features, ``context`` and ``intent`` as structs."""
    return with_features(lowered(df, text), text).drop("_low")


def lowered(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the text in lower case, made once for all that reads it."""
    return computed(df, {"_low": F.lower(F.coalesce(F.col(text), F.lit("")))})


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    """``add_features`` on a table that is ``lowered``."""
    raw, low = F.coalesce(F.col(text), F.lit("")), F.col("_low")
    # lower case neither joins words nor cuts them
    df = computed(df, {"_low_words": whitespace_words(low)})
    df = df.withColumn("_n_ws", F.size("_low_words"))
    n = F.col("_n_ws")
    df = df.withColumns(
        {
            "caps": feat.caps_features(raw),
            "punct": feat.punct_features(raw, n),
            "targeting": feat.targeting_features(raw, n, low),
            "commands": feat.command_features(raw, low),
            "emphasis": feat.emphasis_features(raw, F.col("_low_words")),
            "structure": feat.structure_features(raw, n),
            "intent": feat.intent_scores(raw, low),
        }
    )
    return df.withColumn("context", feat.context_score([F.col(n) for n in FEATURES])).drop("_low_words")


def flat_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Context and intent of ``add_features`` as flat columns, computed once; and ``_low``, the text in lower case."""
    out = with_features(lowered(df, text), text)
    flat = {"_n_ws": F.col("_n_ws"), "_ctx": F.col("context.score"), "_names": F.col("context.indicators")}
    flat |= {f"_i_{n}": F.col(f"intent.{n}") for n in rules.INTENT_ORDER}
    return computed(out, flat, drop=(*FEATURES, "context", "intent"))


def intent_struct() -> Column:
    return F.struct(*[F.col(f"_i_{n}").alias(n) for n in rules.INTENT_ORDER])


def category_hits(c: Category, single: Column, n_words: Column, polite: Column, compound: Column, ctx: Column) -> Column:
    """Words of one category that count, as an array (filters of A1)."""
    words = c.words
    hits = members("_hits", words)
    hits = F.when(single, F.filter(hits, lambda w: ~w.isin(rules.NEVER_ALONE))).otherwise(hits)
    if c.name == "social_exclusion":
        harsh = (compound <= -0.2) | (ctx >= 0.2)
        hits = F.when(~polite & harsh, hits).otherwise(F.array().cast("array<string>"))
    if c.name == "threats" and set(words) & set(ADDRESSED):
        harsh = (n_words > 3) | (compound <= -0.3) | (ctx >= 0.3)
        hits = F.when(~polite & harsh, hits).otherwise(F.filter(hits, lambda w: ~w.isin(ADDRESSED)))
    return hits


def _scored_categories(
    df: DataFrame, categories: list[Category] | None = None, compound: Column | None = None, text: str = "text",
) -> DataFrame:
    categories = categories or packaged_categories()
    compound = F.lit(0.0) if compound is None else F.coalesce(compound, F.lit(0.0))
    out = flat_features(df.withColumn("_compound", compound), text)
    out = out.withColumn("_words", category_tokens("_low", lower=False))
    out = out.withColumn("_met", members("_words", sorted({w for c in categories for p, _ in c.phrases for w in p.split()})))
    out = computed(
        out,
        {
            "n_words": F.size("_words"),
            "_polite": is_polite(F.col("_low"), F.col("_words")),
            "_hits": members("_words", sorted({w for c in categories for w in c.words})),
            **{
                f"_p{i}_{j}": keep_strongest(adaptive_matches(F.col("_words"), p, met=F.col("_met")))
                for i, c in enumerate(categories) for j, (p, _) in enumerate(c.phrases)
            },
        },
        drop=("_words", "_met"),
    )
    single = F.col("n_words") == 1
    structs = []
    item_type = "array<struct<category:string,items:array<string>,score:double,severity:string>>"
    out = computed(
        out,
        {
            f"_w{i}": category_hits(
                c, single, F.col("n_words"), F.col("_polite"), F.col("_compound"), F.col("_ctx")
            )
            for i, c in enumerate(categories)
        },
        drop=("_hits", "_polite"),
    )
    out = out.withColumns(
        {
            f"_w_{i}_{j}": pattern_hits(F.col("_low"), p)
            for i, c in enumerate(categories) for j, p in enumerate(c.patterns)
        }
    )
    for i, c in enumerate(categories):
        score = F.size(f"_w{i}") * F.lit(c.boost * 1.5 if c.name == "direct_insults" else c.boost)
        items = [F.col(f"_w{i}")]
        for j, (phrase, boost) in enumerate(c.phrases):
            m = F.col(f"_p{i}_{j}")
            score = score + F.aggregate(m, F.lit(0.0), lambda a, x: a + x["strength"]) * F.lit(boost)
            items.append(F.array_repeat(F.lit(phrase), F.size(m)))
        for j in range(len(c.patterns)):
            found = F.col(f"_w_{i}_{j}")
            score = score + F.when(F.size(found) > 0, F.lit(c.boost * 2.0)).otherwise(F.lit(0.0))
            items.append(found)
        structs.append(
            F.struct(
                F.lit(c.name).alias("category"), F.concat(*items).alias("items"), score.alias("score"),
                F.lit(c.severity).alias("severity"),
            )
        )
    found = F.filter(F.array(*structs).cast(item_type), lambda s: F.size(s["items"]) > 0)
    drop = ("_low",) + tuple(c for c in out.columns if c[:3] in ("_p0", "_p1", "_p2", "_p3") or c[:2] == "_w")
    found = F.when(is_blank(text), F.array().cast(item_type)).otherwise(found)
    return computed(out, {"categories": found}, drop=drop)


def category_scores(
    df: DataFrame, categories: list[Category] | None = None, compound: Column | None = None, text: str = "text",
) -> DataFrame:
    """Adds ``categories``: array of (category, items, score, severity) (A1) and ``n_words``."""
    out = _scored_categories(df, categories, compound, text)
    return out.drop("_compound", "_n_ws", "_ctx", "_names", *[f"_i_{n}" for n in rules.INTENT_ORDER])


def score_category(
    df: DataFrame, categories: list[Category] | None = None, compound: Column | None = None, text: str = "text",
) -> DataFrame:
    """Adds categories, context, intent, risk_indicators, confidence, is_bullying, severity, explanation."""
    return scored(_scored_categories(df, categories, compound, text), text)


def scored(out: DataFrame, text: str = "text") -> DataFrame:
    """Confidence, flag and severity from features and ``categories``, inline or joined."""
    cats, ctx, sent = F.col("categories"), F.col("_ctx"), F.col("_compound")
    out = computed(
        out,
        {
            "max_intent": F.greatest(*[F.col(f"_i_{n}") for n in rules.INTENT_ORDER]),
            "n_categories": F.size("categories"),
            "_sum": F.aggregate(cats, F.lit(0.0), lambda a, c: a + c["score"]),
            "_squares": F.aggregate(cats, F.lit(0.0), lambda a, c: a + c["score"] * c["score"]),
            "_rank": F.coalesce(F.array_max(F.transform(cats, lambda c: sev_rank(c["severity"]))), F.lit(0)),
        },
    )
    n, intent = F.col("n_categories"), F.col("max_intent")
    single = F.col("n_words") == 1
    boost = F.when(n > 1, F.lit(1.0) + F.lit(0.1) * n / (F.lit(1.0) + F.lit(0.05) * n)).otherwise(F.lit(1.0))
    base = F.coalesce(F.try_divide("_squares", "_sum"), F.lit(0.0)) * boost
    add = lambda cond, value: F.when(cond, value).otherwise(F.lit(0.0))
    context = (
        add(sent < -0.3, F.least(F.abs(sent) * 0.3, F.lit(0.2)))
        + add(ctx > 0.2, F.least(ctx * 0.4, F.lit(0.25)))
        + add(intent > 0.2, F.least(intent * 0.5, F.lit(0.3)))
    )
    evidence = (n > 0) | (sent < -0.5) | (ctx > 0.3) | (intent > 0.3)
    penalty = F.when(single & (n > 0), F.lit(0.7)).when(single, F.lit(0.3)).otherwise(F.lit(1.0))
    out = computed(out, {"_raw": F.least((base + context) * penalty, F.lit(1.0))})
    raw = F.col("_raw")
    calibrated = (
        F.when(raw < 0.1, raw)
        .when(raw < 0.3, F.least(raw * F.when((n > 0) & (ctx > 0.3), F.lit(1.1)).otherwise(F.lit(1.0)), F.lit(0.35)))
        .when(raw < 0.7, raw * 0.95)
        .when((n > 1) | ((n > 0) & (ctx > 0.4)), raw)
        .otherwise(F.least(raw * 0.85, F.lit(0.8)))
    )
    blank = is_blank(text)
    out = computed(out, {"_conf": F.when(evidence & ~blank, calibrated).otherwise(F.lit(0.0))})
    flag = ~blank & ((n > 0) | (~single & ((F.col("_conf") >= 0.3) | (intent > 0.3))))
    critical = (F.col("_i_threat") > 0.5) | (F.col("_i_encouragement_of_harm") > 0.5)
    rank = F.when(n == 0, 0).when(critical, rules.SEVERITIES.index("critical")).otherwise(F.col("_rank"))
    out = computed(
        out,
        {
            "is_bullying": flag,
            "severity": F.when(flag, sev_name(rank)).otherwise("none"),
            "confidence": reduce_short(F.col("_conf"), F.col("_n_ws") < 3),
            "confidence_unreduced": F.col("_conf"),
            "is_short": F.col("_n_ws") < 3,
            "detection_method": F.when(blank, "empty_text").otherwise("enhanced_local"),
            "risk_indicators": F.array_compact(
                F.concat(
                    F.array(F.when(sent < -0.5, "negative_sentiment")),
                    F.when(ctx > 0.3, F.col("_names")).otherwise(F.array().cast("array<string>")),
                    F.array(F.when(intent > 0.3, F.concat(F.lit("intent_"), feat.dominant_intent(intent_struct())))),
                )
            ),
        },
    )
    names = F.transform("categories", lambda c: c["category"])
    out = out.withColumn(
        "explanation", explain(F.col("is_bullying"), F.col("severity"), F.col("confidence"), names, F.lit("warn"))
    )
    out = out.withColumns(
        {
            "context": F.struct(F.col("_ctx").alias("score"), F.col("_names").alias("indicators")),
            "intent": intent_struct(),
        }
    )
    hidden = ("_compound", "_n_ws", "_ctx", "_names", "_sum", "_squares", "_rank", "_raw", "_conf")
    return out.drop(*hidden, *[f"_i_{n}" for n in rules.INTENT_ORDER])
