"""The counters of a run, from one staged row per collected tender."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Columns of a staged row; all but search_number, detail_status and the scores are booleans, of which recent may be null for an unknown date.
STAGES = ("search_number", "duplicate", "recent", "soft_ok", "detail_loaded", "detail_status", "existed", "strict_ok", "region_ok", "criteria_ok", "notified_before", "ai_failed", "score", "min_score", "sent")


def mark_duplicates(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Rows with ``duplicate``: whether an earlier row has the same key."""
    return rows.withColumn("duplicate", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) > 1)


def counters(staged: DataFrame, platform_errors: Column) -> DataFrame:
    """The 17 counters of every search in one aggregate; a row counts as far as it came.

    A repeated tender, an old one and one without a keyword are found and no more.  Details that failed end a row before the
    strict filter.  A tender that its recipient has had already is not analysed again.
    """
    soft = ~F.col("duplicate") & F.coalesce("recent", F.lit(True)) & F.col("soft_ok")
    status = F.lower(F.coalesce(F.nullif(F.col("detail_status"), F.lit("")), F.lit("partial")))
    asked = soft & (status != "failed")
    strict = asked & F.col("strict_ok")
    wanted = strict & F.col("region_ok")
    passed = wanted & F.col("criteria_ok")
    fresh = passed & ~F.col("notified_before")
    analysed = fresh & ~F.col("ai_failed")
    counts = {
        "found": F.lit(True),
        "soft_filtered": soft,
        "filtered": strict,
        "keyword_excluded": asked & ~F.col("strict_ok"),
        "new": soft & ~F.col("existed"),
        "analyzed": analysed,
        "notified": analysed & (F.col("score") >= F.col("min_score")) & F.col("sent"),
        "skipped_duplicate": passed & F.col("notified_before"),
        "excluded_by_criteria": wanted & ~F.col("criteria_ok"),
        "excluded_by_region": strict & ~F.col("region_ok"),
        "details_loaded": soft & (status == "success") & F.col("detail_loaded"),
        "details_partial": soft & (status == "partial"),
        "details_failed": soft & (status == "failed"),
        "saved": soft,
        "ai_failed": fresh & F.col("ai_failed"),
    }
    return staged.groupBy("search_number").agg(*[F.count_if(c).alias(n) for n, c in counts.items()]).withColumn("platform_errors", platform_errors.cast("long"))
