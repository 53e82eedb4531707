"""Analytics over scored messages: summaries, histograms, evaluation, paging and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiltext.functions.severity import sev_name, sev_rank, severity_band
from civiltext.operators.ordered import ROWS_PER_RANGE, PageIndex, free_name, page_index
from civiltext.values import rules

SWEEP = [0.1, 0.3, 0.5, 0.7, 0.9]


def batch_summary(results: DataFrame) -> DataFrame:
    """Totals, flagged count and rounded mean confidence (Q1)."""
    return results.agg(
        F.count("*").alias("total_processed"),
        F.count_if("is_bullying").alias("bullying_detected"),
        F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 3).alias("average_confidence"),
    )


def confidence_bucket(confidence: Column | str) -> Column:
    """Lower edge of the tenth a confidence falls into, times 100."""
    return (F.floor((F.col(confidence) if isinstance(confidence, str) else confidence) * 10) * 10).cast("int")


def confidence_histogram(results: DataFrame) -> DataFrame:
    return results.groupBy(confidence_bucket("confidence").alias("bucket")).agg(F.count("*").alias("n"))


def breakdowns(results: DataFrame) -> DataFrame:
    """Counts per severity, flag and in total, in one pass over the results (Q3)."""
    return results.groupingSets([["severity"], ["is_bullying"], []], "severity", "is_bullying").agg(
        F.grouping_id().cast("int").alias("gid"),
        F.count("*").alias("n"),
        F.round(F.avg("confidence"), 6).alias("avg_confidence"),
    )


def detection_breakdown(results: DataFrame) -> DataFrame:
    """Counts of detections per language, type and severity, with subtotals (Q3)."""
    found = results.select(F.inline("detections"))
    return found.rollup("lang", "type", "severity").agg(
        F.grouping_id().cast("int").alias("gid"), F.count("*").alias("n")
    )


def language_counts(results: DataFrame) -> DataFrame:
    """Messages per detected language (Q3)."""
    return results.select(F.explode("languages").alias("lang")).groupBy("lang").agg(F.count("*").alias("n"))


def category_breakdown(results: DataFrame) -> DataFrame:
    """Messages per category and category severity (Q3)."""
    found = results.select(F.inline("categories"))
    return found.groupBy("category", "severity").agg(F.count("*").alias("n"))


def top_terms(results: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` terms that matched most often (Q4)."""
    found = results.select(F.explode("detections").alias("d")).filter("d.type <> 'pattern'")
    return (
        found.groupBy(F.col("d.value").alias("term")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(k)
    )


def daily_counts(results: DataFrame, ts: str = "ts") -> DataFrame:
    return results.groupBy(F.date_format(F.date_trunc("day", ts), "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("messages"), F.count_if("is_bullying").alias("flagged")
    )


def evaluate(results: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """Confusion counts and derived rates against expected labels (Q6, Q8)."""
    both = results.select(key, "is_bullying").join(labels.select(key, label), key)
    flag, bad = F.col("is_bullying"), F.col(label) == 1
    out = both.agg(
        F.count("*").alias("total"),
        F.count_if(flag & bad).alias("tp"), F.count_if(flag & ~bad).alias("fp"),
        F.count_if(~flag & bad).alias("fn"), F.count_if(~flag & ~bad).alias("tn"),
    )
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    tp, fp, fn, tn, total = (F.col(c) for c in ("tp", "fp", "fn", "tn", "total"))
    return out.withColumns(
        {
            "accuracy": ratio(tp + tn, total),
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "feedback_accuracy": ratio(total - fp, total),
        }
    )


def eval_errors(results: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """Messages whose flag differs from the label (Q6)."""
    both = results.select(key, "is_bullying", "confidence").join(labels.select(key, label), key)
    wrong = both.filter(F.col("is_bullying") != (F.col(label) == 1))
    return wrong.withColumn("error", F.when(F.col("is_bullying"), "false_positive").otherwise("false_negative"))


def threshold_sweep(
    results: DataFrame, labels: DataFrame | None = None, thresholds: list[float] = SWEEP, key: str = "doc_id"
) -> DataFrame:
    """Flag counts, and accuracy with labels, at several thresholds (Q7).

    All thresholds are computed in one aggregate and then unfolded, so the input
    is not multiplied by their number.
    """
    base = results.select(key, "confidence")
    aggs = [F.count("*").alias("total")]
    if labels is not None:
        base = base.join(labels.select(key, "toxic"), key)
    for i, t in enumerate(thresholds):
        flag = F.col("confidence") >= t
        aggs.append(F.count_if(flag).alias(f"f{i}"))
        if labels is not None:
            aggs.append(F.count_if(flag == (F.col("toxic") == 1)).alias(f"c{i}"))
    def row(i: int, t: float) -> Column:
        fields = [F.lit(t).alias("threshold"), F.col(f"f{i}").alias("flagged")]
        if labels is not None:
            fields.append(F.round(F.coalesce(F.try_divide(f"c{i}", "total"), F.lit(0.0)), 6).alias("accuracy"))
        return F.struct(*fields)
    return base.agg(*aggs).select("total", F.inline(F.array(*[row(i, t) for i, t in enumerate(thresholds)])))


def apply_modes(results: DataFrame) -> DataFrame:
    """Flags under each analysis mode and the severity band of the confidence."""
    out = results.withColumn("band", severity_band(F.col("confidence")))
    for mode, threshold in rules.MODE_THRESHOLDS.items():
        out = out.withColumn(f"flag_{mode}", F.col("confidence") >= threshold)
    return out


#: Rows that a task may hand on for a page; deeper pages are read from an index.
SHALLOW_ROWS = 100_000


def paginate(df: DataFrame, order_by: list[str], page: int, page_size: int, index: PageIndex | None = None) -> DataFrame:
    """One page with paging facts on every row (Q9).

    The first pages are a distributed top-k. A page further down is read from an order-statistic index,
    the given one or a new one: only the ranges that hold it are read, wherever it lies. Rows that are
    equal in ``order_by`` come in any order, nulls first.
    """
    if index is None and page * page_size > SHALLOW_ROWS:
        index = page_index(df, order_by)
    if index is None:
        rows = df.orderBy(*order_by).offset((page - 1) * page_size).limit(page_size)
        total = df.count()
    else:
        number = free_name(df.columns, "_rn")
        rows, total = index.page(page, page_size, number).drop(number), index.total
    pages = -(-total // page_size)
    facts = {"total_items": F.lit(total).cast("long"), "total_pages": F.lit(pages).cast("long"), "page": F.lit(page), "has_next": F.lit(page < pages), "has_prev": F.lit(page > 1)}
    return rows.withColumns(facts)


def global_row_number(df: DataFrame, order_by: str, rows_per_bucket: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds ``rn``, the 1-based rank by a key, without a single-task sort; nulls come first, equal keys in any order."""
    return page_index(df, [order_by], rows_per_bucket).numbered("rn")


def assign_batches(df: DataFrame, order_by: str, size: int = rules.BATCH_SIZE) -> DataFrame:
    """Adds ``batch`` and the ``index`` inside it, at most ``size`` rows each (Q13)."""
    ranked = global_row_number(df, order_by)
    return ranked.withColumns(
        {
            "batch": F.floor((F.col("rn") - 1) / size).cast("bigint"),
            "index": F.pmod(F.col("rn") - 1, F.lit(size)).cast("int"),
        }
    ).drop("rn")


def duplicate_share(df: DataFrame, text: str = "text") -> DataFrame:
    """How many messages repeat an earlier text, exactly (Q10)."""
    groups = df.groupBy(F.md5(text).alias("h")).agg(F.count("*").alias("n"))
    out = groups.agg(F.sum("n").alias("total"), F.count("*").alias("distinct_texts"), F.max("n").alias("largest_group"))
    share = F.try_divide(F.col("total") - F.col("distinct_texts"), F.col("total"))
    return out.withColumn("duplicate_share", F.round(share, 6))


def conversation_rollup(results: DataFrame) -> DataFrame:
    """Flagged turns, worst severity and last flagged turn per conversation (Q12)."""
    return results.groupBy("conv_id").agg(
        F.count("*").alias("turns"),
        F.count_if("is_bullying").alias("flagged_turns"),
        sev_name(F.max(sev_rank(F.col("severity")))).alias("max_severity"),
        F.max(F.when(F.col("is_bullying"), F.col("turn"))).alias("last_flagged_turn"),
        F.round(F.max("confidence"), 6).alias("max_confidence"),
    )
