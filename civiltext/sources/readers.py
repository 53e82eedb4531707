"""Sources: messages, term files and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civiltext.operators.lexicon import LEXICON_SCHEMA

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


SPLIT_BYTES = 128 << 20
#: A task of a spread input gets about so much of its files.
TASK_BYTES = 16 << 20


def spread(df: DataFrame, key: str, split_bytes: int = SPLIT_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Hash a small input over all cores before per-message work.

    Files smaller than one split per core leave cores idle, whatever their
    number of row groups. The tasks keep their size as the input grows: their
    number is a multiple of the cores. Larger inputs already come in enough splits and are
    returned unchanged, so big data is never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    waves = max(1, -(-size // (cores * task_bytes)))
    return df.repartition(cores * waves, key) if size < cores * split_bytes else df


def read_table(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    """One parquet table; with ``key`` a small one is spread over the cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df if key is None else spread(df, key)


def read_messages(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """Messages from parquet, JSON lines, CSV, ORC or plain text."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.load(path)


def stream_messages(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", **options) -> DataFrame:
    """The same sources as a stream."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


LANGUAGE = "struct<single_words:array<string>,multi_word_phrases:array<string>,patterns:array<string>,severity_map:map<string,string>>"
CATEGORY = "struct<keywords:array<string>,multi_word_phrases:array<string>,patterns:array<string>,severity:string,confidence_boost:double>"
LEXICON_FILE = f"""
    languages map<string,{LANGUAGE}>,
    bullying_categories map<string,{CATEGORY}>,
    bullying_words array<string>, bullying_phrases array<string>,
    severity_levels map<string,array<string>>,
    contextual_patterns array<struct<pattern:string,severity:string,description:string>>,
    intent_indicators array<struct<keywords:array<string>,severity:string>>
"""


def read_lexicon(spark: SparkSession, path: str, origin: str = "file", version: int = 1) -> DataFrame:
    """A nested term file in any of its three layouts, flattened to the canonical table."""
    return flatten_lexicon(spark.read.schema(LEXICON_FILE).option("multiLine", True).json(path), origin, version)


def flatten_lexicon(raw: DataFrame, origin: str = "file", version: int = 1) -> DataFrame:
    """Every layout found in ``raw`` contributes rows, in one pass; missing category fields get their defaults."""
    null, medium = F.lit(None), F.lit("medium")
    rows_type = "array<struct<term:string,kind:string,lang:string,category:string,severity:string,boost:double>>"

    def row(term: Column, kind: str | Column, lang=null, category=null, severity=null, boost=null) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        names = ("term", "kind", "lang", "category", "severity", "boost")
        return F.struct(*[c.alias(n) for c, n in zip((term, kind, lang, category, severity, boost), names)])

    def each(items: Column, make) -> Column:
        return F.coalesce(F.transform(items, make).cast(rows_type), F.array().cast(rows_type))

    def language(e: Column) -> Column:
        lang, d = e["key"], e["value"]
        rated = lambda kind: lambda t: row(t, kind, lang, severity=F.try_element_at(d["severity_map"], t))
        return F.concat(
            each(d["single_words"], rated("word")),
            each(d["multi_word_phrases"], rated("phrase")),
            each(d["patterns"], rated("pattern")),
            each(F.map_entries(d["severity_map"]), lambda m: row(m["key"], "severity", lang, severity=m["value"])),
        )

    def category(e: Column) -> Column:
        name, d = e["key"], e["value"]
        level, boost = F.coalesce(d["severity"], medium), F.coalesce(d["confidence_boost"], F.lit(0.3))
        tidy = lambda t: F.lower(F.trim(t))
        kind = lambda t: F.when(F.contains(tidy(t), F.lit(" ")), "phrase").otherwise("word")
        return F.concat(
            each(d["keywords"], lambda t: row(tidy(t), kind(t), category=name, severity=level, boost=boost)),
            each(d["multi_word_phrases"], lambda t: row(tidy(t), "phrase", category=name, severity=level, boost=boost * 1.5)),
            each(d["patterns"], lambda t: row(t, "pattern", category=name, severity=level, boost=boost)),
        )

    def legacy(field: str, kind: str, default: str) -> Column:
        def rated(t: Column) -> Column:
            levels = F.map_filter("severity_levels", lambda _, terms: F.array_contains(terms, t))
            return row(F.lower(t), kind, F.lit("english"), severity=F.coalesce(F.get(F.map_keys(levels), F.lit(0)), F.lit(default)))

        return each(F.col(field), rated)

    nested = lambda column, make: F.coalesce(
        F.flatten(F.transform(F.map_entries(column), make)), F.array().cast(rows_type)
    )
    everything = F.concat(
        nested("languages", language),
        nested("bullying_categories", category),
        legacy("bullying_words", "word", "medium"),
        legacy("bullying_phrases", "phrase", "high"),
        each(F.col("contextual_patterns"), lambda p: row(p["pattern"], "pattern", F.lit("english"), severity=p["severity"])),
    )
    out = raw.select(F.inline(everything))
    return out.withColumns({"origin": F.lit(origin), "version": F.lit(version)}).select(*LEXICON_SCHEMA.names)


def read_intents(spark: SparkSession, path: str) -> DataFrame:
    """Intent indicators of a term file as (indicator, keyword, severity)."""
    raw = spark.read.schema(LEXICON_FILE).option("multiLine", True).json(path)
    each = raw.select(F.posexplode("intent_indicators").alias("i", "d"))
    return each.select(
        F.col("i").cast("string").alias("indicator"), F.explode("d.keywords").alias("keyword"),
        F.coalesce("d.severity", F.lit("medium")).alias("severity"),
    )
