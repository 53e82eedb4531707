"""Test relations derived from the given tables: planted messages, mined terms, verdicts.

The invented prose of ``documents`` holds few abusive words and no phrases, so
example snippets are planted: every document stays whole and is one message;
``append`` snippets follow the whole text, ``bare`` snippets become a message of
their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civiltext.functions.text import word_tokens
from civiltext.operators.word_cuts import counted_terms
from civiltext.sources.readers import read_table

SNIPPETS = [
    (0, "append", "Kill yourself, idiot"), (1, "bare", "STUPID"), (2, "append", "nobody really likes you"),
    (3, "bare", "die"), (4, "append", "you are so stupid"), (5, "bare", "nobody actually really likes you at all"),
    (6, "append", "stupid stupid stupid"), (7, "bare", "thank you"), (8, "append", "kill the process"),
    (9, "bare", "तेरी माँ की"), (10, "append", "GO AWAY!!!! NOBODY WANTS YOU HERE!!!!"),
    (11, "bare", "y0u 4r3 5tup1d"), (12, "append", "you're sooooo dumb"), (13, "bare", "maderchood"),
    (14, "append", "go and die"), (15, "bare", "bokya"), (16, "append", "u r stupid"), (17, "bare", "!!!"),
    (18, "bare", "   "), (19, "append", "teri maa ki, you idiot"),
]
SNIPPET_CYCLE = 24
VERDICTS = [
    '{"is_bullying": true, "confidence": 0.85, "severity": "high", "primary_category": "direct_insults", "risk_factors": ["aggressive_language"], "reasoning": "insults", "recommended_action": "escalate"}',
    '{"is_bullying": true, "confidence": 1.7, "severity": "medium", "primary_category": "threats", "recommended_action": "block"}',
    "this is bullying of medium severity",
    "{}",
]
VALENCE = [("stupid", -2.4), ("idiot", -2.3), ("worthless", -1.9), ("pathetic", -2.7), ("thank", 1.5), ("likes", 1.8)]
INTENTS = [(["hate", "you", "stupid"], "high"), (["nobody", "alone"], "medium"), (["trash", "loser"], "low")]
LANG_NAMES = {"en": "english", "hi": "hindi", "mr": "marathi"}


def planted_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """msg_id, doc_id, ts, user_id, conv_id, lang, text."""
    return plant(read_table(spark, sf_dir, "documents", "doc_id"))


def plant(documents: DataFrame) -> DataFrame:
    """The same from a table or a stream of documents."""
    docs = documents.select("doc_id", "lang", "text")
    snippets = documents.sparkSession.createDataFrame(SNIPPETS, "k int, mode string, snippet string")
    # a fixed table of twenty rows
    both = docs.withColumn("k", (F.col("doc_id") % SNIPPET_CYCLE).cast("int")).join(F.broadcast(snippets), "k", "left")
    whole = F.when(F.col("mode") == "append", F.concat_ws(" ", "text", "snippet")).otherwise(F.col("text"))
    parts = F.array_compact(
        F.array(
            F.struct((F.col("doc_id") * 2).alias("msg_id"), whole.alias("text")),
            F.when(F.col("mode") == "bare", F.struct((F.col("doc_id") * 2 + 1).alias("msg_id"), F.col("snippet").alias("text"))),
        )
    )
    return both.select(
        "doc_id", F.expr("timestampadd(SECOND, doc_id * 37, TIMESTAMP_NTZ '2024-01-01 00:00:00')").alias("ts"),
        (F.col("doc_id") % 97).alias("user_id"), (F.col("doc_id") % 211).alias("conv_id"), "lang", F.inline(parts),
    )


def mined_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, whole: what terms are mined from."""
    return read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")


def mined_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term table mined from all documents: words and adjacent pairs, rated by document count."""
    lang = F.when(F.col("lang") == "en", "english").otherwise(F.col("lang"))
    terms = counted_terms(mined_documents(spark, sf_dir).select(lang.alias("lang"), F.lower("text").alias("low")))
    n = F.sum("n")
    level = F.when(n >= 10, "high").when(n >= 3, "medium").otherwise("low")
    # counted by slices already, so no term gathers; what goes on by language and term finds its rows together
    return terms.repartition("lang", "term").groupBy("lang", "term", "kind").agg(level.alias("severity")).select(
        "term", "kind", "lang", F.lit(None).cast("string").alias("category"), "severity",
        F.lit(None).cast("double").alias("boost"), F.lit("mined").alias("origin"), F.lit(1).alias("version"),
    )


def mined_with_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mined table with its ratings as severity rows too."""
    # both from one row, so that the terms are mined once
    return mined_terms(spark, sf_dir).withColumn("kind", F.explode(F.array("kind", F.lit("severity"))))


def vocabulary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (lang, token) of all documents as a term table."""
    docs = read_table(spark, sf_dir, "documents", "doc_id").select("lang", F.explode(F.array_distinct(word_tokens("text"))).alias("term"))
    lang = F.when(F.col("lang") == "en", "english").otherwise(F.col("lang"))
    words = docs.select(lang.alias("lang"), "term").distinct()
    return words.select(
        "term", F.lit("word").alias("kind"), "lang", F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("string").alias("severity"), F.lit(None).cast("double").alias("boost"),
        F.lit("vocabulary").alias("origin"), F.lit(1).alias("version"),
    )


def raw_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """msg_id and a verdict text: JSON, plain words, an empty object, or the message itself."""
    msgs = planted_messages(spark, sf_dir).select("msg_id", "doc_id", "text")
    raw = F.col("text")
    for i, v in enumerate(VERDICTS):
        raw = F.when(F.col("doc_id") % (len(VERDICTS) + 1) == i, v).otherwise(raw)
    return msgs.select("msg_id", raw.alias("raw"))
