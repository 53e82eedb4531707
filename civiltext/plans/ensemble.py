"""Combining local results with externally produced verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiltext.functions.severity import explain, reduce_short, sev_name, sev_rank

VERDICT_SCHEMA = (
    "is_bullying boolean, confidence double, severity string, primary_category string, "
    "detected_patterns array<string>, risk_factors array<string>, reasoning string, recommended_action string, "
    "_corrupt_record string"
)


def _any_of(low: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def parse_verdicts(df: DataFrame, raw_col: str = "raw", fallback: str = "category") -> DataFrame:
    """Parse a JSON verdict column; clamp and default its fields; read plain text by keywords."""
    out = df.withColumn(
        "_v", F.from_json(raw_col, VERDICT_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    )
    bad = F.col("_v").isNull() | F.col("_v._corrupt_record").isNotNull()
    low = F.lower(F.coalesce(raw_col, F.lit("")))
    if fallback == "category":
        flag = _any_of(low, ["bullying", "harassment", "threat"])
        conf = F.when(flag, 0.5).otherwise(0.0)
        level = F.when(flag, "medium").otherwise("none")
    else:
        flag = _any_of(low, ["yes", "bullying", "harassment", "threat"])
        high = _any_of(low, ["high", "severe", "serious"])
        medium = _any_of(low, ["medium", "moderate"])
        mild = _any_of(low, ["low", "mild"])
        conf = F.when(high, 0.8).when(medium, 0.6).when(mild, 0.4).when(flag, 0.6).otherwise(0.0)
        level = F.when(high, "high").when(medium, "medium").when(mild, "low").otherwise("none")
    clamped = F.least(F.greatest(F.coalesce("_v.confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    none = F.array().cast("array<string>")
    pick = lambda field, default: F.coalesce(F.col(f"_v.{field}"), F.lit(default))
    return out.withColumns(
        {
            "parsed": ~bad,
            "v_is_bullying": F.when(bad, flag).otherwise(pick("is_bullying", False)),
            "v_confidence": F.when(bad, conf).otherwise(clamped),
            "v_severity": F.when(bad, level).otherwise(pick("severity", "none")),
            "v_category": F.when(bad, "other").otherwise(pick("primary_category", "other")),
            "v_action": F.when(bad, "ignore").otherwise(pick("recommended_action", "ignore")),
            "v_patterns": F.when(bad, none).otherwise(F.coalesce("_v.detected_patterns", none)),
            "v_risks": F.when(bad, none).otherwise(F.coalesce("_v.risk_factors", none)),
            "v_reasoning": F.when(bad, "").otherwise(pick("reasoning", "")),
        }
    ).drop("_v")


def ensemble(
    local: DataFrame, verdicts: DataFrame, key: str = "msg_id", threshold: float = 0.7, policy: str = "fixed"
) -> DataFrame:
    """Combine local results with verdicts by message (M8, A10).

    ``fixed`` weights 0.4/0.6 and consults the verdict when the local confidence is
    below the threshold. ``adaptive`` weights by whichever side is sure, and also
    needs the local result to be unflagged. The condition is part of the one outer
    join, so the local results are computed once and only narrow verdict columns travel.

    Blank texts keep their local result; no verdict is consulted. Where the local profile lowers the
    confidence of short texts, the weights and the threshold see the value before, and the combined
    value is lowered instead.

    Where the local result has categories, the verdict's own one is appended to them and its risk
    factors to the risk indicators; ``reasoning`` and ``action`` are the verdict's, and the explanation is
    written anew from the combined result.
    """
    narrow = verdicts.select(
        F.col(key).alias("_key"), "v_is_bullying", "v_confidence", "v_severity", "v_action", "v_category", "v_risks", "v_reasoning"
    )
    blank = F.col("detection_method") == "empty_text" if "detection_method" in local.columns else F.lit(False)
    lc = F.col("confidence_unreduced" if "confidence_unreduced" in local.columns else "confidence")
    short = F.col("is_short") if "is_short" in local.columns else F.lit(False)
    uncertain = ~blank & (lc < threshold)
    if policy == "adaptive":
        uncertain = uncertain & ~F.col("is_bullying")
    both = local.join(narrow, (F.col(key) == F.col("_key")) & uncertain, "left")
    vc = F.coalesce("v_confidence", F.lit(0.0))
    v_flag = F.coalesce("v_is_bullying", F.lit(False))
    rank = F.greatest(sev_rank(F.col("severity")), F.coalesce(sev_rank(F.col("v_severity")), F.lit(0)))
    if policy == "fixed":
        used = uncertain
        mixed = lc * 0.4 + vc * 0.6
        flag = (mixed >= threshold) | F.col("is_bullying") | v_flag
        level = F.when(flag, sev_name(rank)).otherwise("none")
        method = "combined"
    else:
        used = uncertain & (vc > 0)
        wl = F.when(lc > 0.8, 0.7).when(vc > 0.8, 0.3).otherwise(0.5)
        wv = F.when(lc > 0.8, 0.3).when(vc > 0.8, 0.7).otherwise(0.5)
        mixed = lc * wl + vc * wv
        flag = F.when(lc >= 0.5, F.col("is_bullying")).otherwise((mixed >= 0.5) | F.col("is_bullying") | v_flag)
        level = sev_name(rank)
        method = "enhanced_combined"
    inner = ("confidence", "is_bullying", "severity", "detection_method", "confidence_unreduced", "is_short")
    cols = [c for c in local.columns if c not in inner]
    out = both.select(
        *cols,
        F.when(used, reduce_short(mixed, short)).otherwise(F.col("confidence")).alias("confidence"),
        F.when(used, flag).otherwise(F.col("is_bullying")).alias("is_bullying"),
        F.when(used, level).otherwise(F.col("severity")).alias("severity"),
        F.when(used, F.lit(method)).otherwise("local").alias("method"),
        F.when(used & F.col("v_action").isNotNull(), F.col("v_action")).otherwise("warn").alias("action"),
        F.when(used, F.coalesce("v_reasoning", F.lit(""))).otherwise("").alias("reasoning"),
        *[F.when(used, F.col(c)).alias(f"_{c}") for c in ("v_category", "v_risks", "v_confidence", "v_severity")],
    )
    if "categories" in local.columns:
        kind = local.schema["categories"].dataType.elementType
        own = F.struct(
            F.col("_v_category").alias("category"), F.array().cast("array<string>").alias("items"), F.col("_v_confidence").alias("score"), F.col("_v_severity").alias("severity")
        ).cast(kind)
        named = F.col("_v_category").isNotNull() & (F.col("_v_category") != "other")
        risks = F.concat("risk_indicators", F.coalesce("_v_risks", F.array().cast("array<string>")))
        out = out.withColumns({"categories": F.when(named, F.array_append("categories", own)).otherwise(F.col("categories")), "risk_indicators": risks})
        names = F.transform("categories", lambda c: c["category"])
        out = out.withColumns({"n_categories": F.size("categories"), "explanation": explain(F.col("is_bullying"), F.col("severity"), F.col("confidence"), names, F.col("action"))})
    return out.drop("_v_category", "_v_risks", "_v_confidence", "_v_severity")


def model_verdicts(df: DataFrame, predict, key: str = "msg_id", text: str = "text") -> DataFrame:
    """Raw verdict texts of a user model: ``predict`` maps a pandas Series of texts to a Series of strings.

    Runs in Arrow batches inside the tasks; the result feeds ``parse_verdicts``.
    """
    model = F.pandas_udf(predict, "string")
    return df.select(key, model(F.col(text)).alias("raw"))
