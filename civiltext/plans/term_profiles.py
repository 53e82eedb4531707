"""The category and the legacy profile over a term table of any size: matching joins, one aggregate for each message.

The table has ``term, kind, category, severity, boost`` (kind ``word``, ``phrase`` or ``pattern``); the
legacy profile takes no category and no boost. Rows equal those of the inline profiles with the same
rules. Patterns that do not compile are left out, as ``quarantine`` reports them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civiltext.functions.severity import sev_name, sev_rank
from civiltext.functions.staging import computed, let
from civiltext.functions.text import category_tokens, is_blank, is_polite, normalise, strip, strip_punct_tokens, whitespace_words
from civiltext.operators import matching
from civiltext.operators.joins import lookup_join
from civiltext.operators.substrings import contained_terms
from civiltext.plans import category as cat
from civiltext.plans.legacy import LegacyRules, intent_score
from civiltext.plans.multilingual import text_key
from civiltext.sources.storage import materialise
from civiltext.values import rules, terms

_CATEGORIES = "array<struct<category:string,items:array<string>,score:double,severity:string>>"
CATEGORY_TERMS = "term string, kind string, category string, severity string, boost double"


def category_terms(spark: SparkSession, categories: list[cat.Category] | None = None) -> DataFrame:
    """Categories as a term table; without any the packaged ones."""
    rows = []
    for c in categories or cat.packaged_categories():
        rows += [(w, "word", c.name, c.severity, c.boost) for w in c.words]
        rows += [(p, "phrase", c.name, c.severity, b) for p, b in c.phrases]
        rows += [(p, "pattern", c.name, c.severity, c.boost) for p in c.patterns]
    return spark.createDataFrame(rows, CATEGORY_TERMS)


def _rules(lex: DataFrame) -> DataFrame:
    """Each (kind, term, category) once with its largest boost; the category's strongest severity on every row."""
    term = F.when(F.col("kind") == "pattern", F.col("term")).otherwise(F.lower(strip("term")))
    rows = lex.withColumn("term", term).filter((F.size(whitespace_words("term")) > 0) & F.col("category").isNotNull())
    levels = rows.groupBy("category").agg(F.coalesce(F.max(sev_rank(F.col("severity"))), F.lit(rules.SEVERITIES.index("medium"))).alias("rank"))
    once = rows.groupBy("kind", "term", "category").agg(F.coalesce(F.max("boost"), F.lit(0.3)).alias("boost"))
    return materialise(lookup_join(once, levels, ["category"]), "category-rules")


def _found(texts: DataFrame, table: DataFrame) -> DataFrame:
    """(_id, d) with d = (kind, place, category, rank, word, items, score) of everything that a text holds."""
    toks = matching.tokens(texts, "_id", token_column=F.col("_words"))
    row = lambda kind, place, word, items, score: F.struct(
        F.lit(kind).alias("kind"), place.cast("int").alias("place"), "category", "rank", word.alias("word"), items.alias("items"), score.alias("score")
    ).alias("d")
    of = lambda kind: table.filter(F.col("kind") == kind).drop("kind")
    words = lookup_join(toks, of("word").withColumnRenamed("term", "token"), ["token"])
    weight = F.when(F.col("category") == "direct_insults", F.col("boost") * 1.5).otherwise(F.col("boost"))
    words = words.select("_id", row("word", F.col("pos"), F.col("token"), F.array("token"), weight))
    matches = matching.match_phrases_adaptive(toks, texts.select("_id", F.size("_words").alias("n_tokens")), of("phrase"), key="_id")
    kept = lookup_join(matching.resolve_overlaps(matches, "_id"), of("phrase"), ["term"])
    none = F.lit(None).cast("string")
    phrases = kept.select("_id", row("phrase", F.col("start"), none, F.array("term"), F.col("strength") * F.col("boost")))
    hits = matching.match_patterns(texts, of("pattern").select("term", F.col("category").alias("lang")), "_id", "_low")
    own = of("pattern").select(F.col("term").alias("pattern"), F.col("category").alias("lang"), "category", "rank", "boost")
    patterns = lookup_join(hits, own, ["pattern", "lang"]).select("_id", row("pattern", F.lit(0), none, F.col("values"), F.col("boost") * 2.0))
    return words.unionByName(phrases).unionByName(patterns)


def categories_of(df: DataFrame, lex: DataFrame, compound: Column | None = None, text: str = "text", key: str = "msg_id") -> DataFrame:
    """What the inline plan has after its matching: features, ``n_words`` and ``categories`` (A1)."""
    raw = F.coalesce(F.col(text), F.lit(""))
    table = _rules(lex)
    keyed = df.withColumn("_id", text_key(key, text))
    texts = computed(keyed.filter(~is_blank(text)).select("_id", raw.alias("_raw")), {"_low": F.lower("_raw")}, drop=("_raw",))
    texts = texts.withColumn("_words", category_tokens("_low", lower=False)).dropDuplicates(["_id"])
    # one message's own finds: bounded by its length and the rules
    per_text = _found(materialise(texts, "category-texts"), table).groupBy("_id").agg(F.array_sort(F.collect_list("d")).alias("_found"))
    out = cat.flat_features(keyed.withColumn("_compound", F.lit(0.0) if compound is None else F.coalesce(compound, F.lit(0.0))), text)
    out = out.withColumn("_words", category_tokens("_low", lower=False))
    out = computed(out, {"n_words": F.size("_words"), "_polite": is_polite(F.col("_low"), F.col("_words"))}, drop=("_words", "_low"))
    out = out.join(per_text, "_id", "left")
    single, n_words, polite, compound, ctx = F.col("n_words") == 1, F.col("n_words"), F.col("_polite"), F.col("_compound"), F.col("_ctx")

    def counts(d: Column) -> Column:
        alone = ~(single & d["word"].isin(rules.NEVER_ALONE))
        excluded = ~polite & ((compound <= -0.2) | (ctx >= 0.2))
        addressed = ~polite & ((n_words > 3) | (compound <= -0.3) | (ctx >= 0.3))
        kept = alone & ((d["category"] != "social_exclusion") | excluded) & ((d["category"] != "threats") | ~d["word"].isin(cat.ADDRESSED) | addressed)
        return (d["kind"] != "word") | kept

    order = list(terms.CATEGORY_SETTINGS)
    place = {"word": 0, "phrase": 1, "pattern": 2}

    def gathered(found: Column) -> Column:
        names = F.array_distinct(F.transform(found, lambda d: d["category"]))
        known = [F.filter(names, lambda n: n == c) for c in order]
        names = F.concat(*known, F.array_sort(F.filter(names, lambda n: ~n.isin(order))))

        def one(name: Column) -> Column:
            mine = F.filter(found, lambda d: d["category"] == name)
            items = F.concat(*[F.flatten(F.transform(F.filter(mine, lambda d: d["kind"] == k), lambda d: d["items"])) for k in place])
            score = F.aggregate(mine, F.lit(0.0), lambda a, d: a + d["score"])
            return F.struct(name.alias("category"), items.alias("items"), score.alias("score"), sev_name(F.get(mine, F.lit(0))["rank"]).alias("severity"))

        return F.transform(names, one)

    found = let(F.filter("_found", counts), gathered).cast(_CATEGORIES)
    return computed(out, {"categories": F.coalesce(found, F.array().cast(_CATEGORIES))}, drop=("_id", "_found", "_polite"))


def score_category_table(df: DataFrame, lex: DataFrame, compound: Column | None = None, text: str = "text", key: str = "msg_id") -> DataFrame:
    """``score_category`` with the categories of a term table."""
    return cat.scored(categories_of(df, lex, compound, text, key), text)


def score_legacy_table(
    df: DataFrame, lex: DataFrame, threshold: float = 0.3, intents: list[tuple[list[str], str]] | None = None, text: str = "text", key: str = "msg_id"
) -> DataFrame:
    """``score_legacy`` with a term table; a message is flagged by any find or from ``threshold`` on."""
    lowered = F.when(F.col("kind") == "pattern", F.col("term")).otherwise(F.lower("term"))
    level = F.coalesce("severity", F.when(F.col("kind") == "phrase", "high").otherwise("medium"))
    table = lex.filter(F.size(whitespace_words("term")) > 0).select(lowered.alias("term"), "kind", sev_rank(level).alias("rank"))
    table = materialise(table.groupBy("term", "kind").agg(F.max("rank").alias("rank")), "legacy-rules")
    of = lambda kind: table.filter(F.col("kind") == kind).drop("kind")
    keyed = df.withColumn("_id", text_key(key, text))
    norm = normalise(strip(F.coalesce(text, F.lit(""))), "legacy")
    texts = keyed.filter(~is_blank(text)).select("_id", norm.alias("_norm")).dropDuplicates(["_id"]).withColumn("_words", strip_punct_tokens("_norm"))
    texts = materialise(texts, "legacy-texts")
    row = lambda kind, value, place: F.struct(F.lit(kind).alias("kind"), place.cast("int").alias("place"), value.alias("value"), "rank").alias("d")
    words = lookup_join(matching.tokens(texts, "_id", token_column=F.col("_words")), of("word").withColumnRenamed("term", "token"), ["token"])
    found = words.select("_id", row("word", F.col("token"), F.col("pos")))
    inside = contained_terms(texts, of("phrase"), "_id", "_norm")
    found = found.unionByName(inside.select("_id", row("phrase", F.col("term"), F.lit(0))))
    hits = matching.match_patterns(texts, of("pattern").select("term", F.lit("").alias("lang")), "_id", "_norm")
    hits = lookup_join(hits, of("pattern").withColumnRenamed("term", "pattern"), ["pattern"])
    found = found.unionByName(hits.select("_id", row("pattern", F.col("pattern"), F.lit(0))))
    per_text = found.groupBy("_id").agg(F.array_sort(F.collect_list("d")).alias("_found"))
    out = keyed.join(per_text, "_id", "left").withColumn("_norm", norm).withColumn("_words", strip_punct_tokens("_norm"))
    none = F.array().cast(per_text.schema["_found"].dataType)
    chosen = lambda kind: F.transform(F.filter(F.coalesce("_found", none), lambda d: d["kind"] == kind), lambda d: d["value"])
    out = computed(
        out,
        {
            "found_words": chosen("word"), "found_phrases": chosen("phrase"), "found_patterns": chosen("pattern"),
            "intent_score": intent_score(F.col("_norm"), F.col("_words"), LegacyRules().intents if intents is None else intents),
            "word_count": F.size("_words"), "_rank": F.coalesce(F.array_max(F.transform("_found", lambda d: d["rank"])), F.lit(0)),
        },
        drop=("_norm", "_words", "_found", "_id"),
    )
    n = [F.size(c) for c in ("found_words", "found_phrases", "found_patterns")]
    blank = is_blank(text)
    total = F.least(n[0] * 0.3 + n[1] * 0.5 + n[2] * 0.4 + F.col("intent_score"), F.lit(1.0))
    out = computed(out, {"total_indicators": n[0] + n[1] + n[2], "confidence": F.when(blank, 0.0).otherwise(total), "_rank": F.col("_rank")})
    out = out.withColumn("is_bullying", ~blank & ((F.col("total_indicators") > 0) | (F.col("confidence") >= threshold)))
    out = out.withColumn("severity", F.when(F.col("is_bullying"), sev_name(F.col("_rank"))).otherwise("none"))
    return out.withColumn("detection_method", F.when(blank, "empty_text").otherwise("local_database")).drop("_rank")
