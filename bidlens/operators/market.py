"""Market roll-ups, report rows and run statistics over tenders and their analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NOT_GIVEN = "Не указано"
DIMENSIONS = {"platform": "platform", "region": "region", "customer": "customer", "law": "law_type"}
# Display names.
PLATFORM_NAMES = {"eis": "ЕИС", "b2b_center": "B2B-Center", "fabrikant": "Фабрикант", "fabricant": "Фабрикант", "rts_tender": "РТС-тендер", "tmk": "ТМК", "rosatom": "Росатом"}
RECOMMENDATION_NAMES = {"participate": "Участвовать", "review": "Рассмотреть", "skip": "Не участвовать"}


def with_analyses(tenders: DataFrame, analyses: DataFrame) -> DataFrame:
    """Left join on tender_id; a tender without analysis keeps null columns."""
    return tenders.join(analyses, "tender_id", "left")


def in_scope(joined: DataFrame, *, since: str | None = None, min_score: int = 0) -> DataFrame:
    """Rows first seen since an instant and, with a positive minimum, with at least that score (no analysis counts as 0)."""
    out = joined.where(F.col("first_seen_at") >= F.lit(since).cast("timestamp_ntz")) if since else joined
    return out.where(F.coalesce("relevance_score", F.lit(0)) >= min_score) if min_score > 0 else out


def _measures() -> list:
    return [
        F.count("*").alias("n"),
        F.coalesce(F.sum("price"), F.lit(0.0)).alias("value"),
        F.avg("price").alias("avg_price"),
        F.avg("relevance_score").alias("avg_score"),
        F.count_if(F.coalesce("relevance_score", F.lit(0)) >= 80).alias("high"),
    ]


def totals(joined: DataFrame) -> DataFrame:
    """Count, value, averages (nulls ignored) and number of scores from 80."""
    return joined.agg(*_measures())


def by_dimension(joined: DataFrame, column: str, top: int = 20) -> DataFrame:
    """The largest groups of one column by count, value and name; blank names read "not given"."""
    name = F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit(NOT_GIVEN)).alias("name")
    return joined.groupBy(name).agg(*_measures()).orderBy(F.desc("n"), F.desc("value"), "name").limit(top)


def all_dimensions(joined: DataFrame, top: int = 20) -> DataFrame:
    """All dimensions in one pass: grouping sets, then the largest groups of each."""
    names = [F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(NOT_GIVEN)).alias(d) for d, c in DIMENSIONS.items()]
    flat = joined.select(*names, "price", "relevance_score")
    sets = flat.groupingSets([[F.col(d)] for d in DIMENSIONS], *[F.col(d) for d in DIMENSIONS]).agg(*_measures(), *[F.grouping(d).alias(f"g_{d}") for d in DIMENSIONS])
    dimension = F.coalesce(*[F.when(F.col(f"g_{d}") == 0, F.lit(d)) for d in DIMENSIONS])
    name = F.coalesce(*[F.when(F.col(f"g_{d}") == 0, F.col(d)) for d in DIMENSIONS])
    long = sets.select(dimension.alias("dimension"), name.alias("name"), "n", "value", "avg_price", "avg_score", "high")
    rank = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), F.desc("value"), "name"))
    return long.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)


def label(column: str, names: dict[str, str]) -> Column:
    """Display name of a code; an unknown code stands for itself, null for blank."""
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.coalesce(column, F.lit(""))), F.col(column), F.lit(""))


def report_rows(joined: DataFrame, now: Column, ids: DataFrame | None = None) -> DataFrame:
    """Report columns in rank order: score (none is 0), then latest publication."""
    rows = joined.join(ids, "tender_id", "left_semi") if ids is not None else joined
    days = F.greatest(F.lit(0), F.datediff(F.to_date("deadline"), F.to_date(now)))
    order = [F.coalesce("relevance_score", F.lit(0)).desc(), F.col("published_at").desc_nulls_last(), F.col("tender_id")]
    return rows.orderBy(*order).select(
        "tender_id",
        label("platform", PLATFORM_NAMES).alias("platform"),
        "title",
        "customer",
        "price",
        "region",
        "law_type",
        "published_at",
        "deadline",
        days.alias("days_left"),
        F.coalesce("relevance_score", F.lit(0)).alias("score"),
        label("recommendation", RECOMMENDATION_NAMES).alias("recommendation"),
        "url",
    )


def risk_text(risks: Column) -> Column:
    """A JSON list of risks as one text, blanks left out; anything else as it stands."""
    listed = F.from_json(risks, "array<string>")
    parts = F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.rlike(risks, F.lit(r"^\s*\[")) & listed.isNotNull(), F.array_join(parts, "; ")).otherwise(F.coalesce(risks, F.lit("")))


def full_report(joined: DataFrame, now: Column, ids: DataFrame | None = None) -> DataFrame:
    """The 17 columns of a report in rank order; joined has a tender's columns and its analysis' score, recommendation, summary and risks."""
    rows = joined.join(ids, "tender_id", "left_semi") if ids is not None else joined
    text = lambda c: F.coalesce(c, F.lit(""))
    return rows.orderBy(F.coalesce("relevance_score", F.lit(0)).desc(), F.col("published_at").desc_nulls_last(), F.col("tender_id")).select(
        label("platform", PLATFORM_NAMES).alias("platform"),
        *[text(F.col(c)).alias(c) for c in ("external_id", "title", "customer", "region")],
        "price",
        F.coalesce(F.nullif("currency", F.lit("")), F.lit("RUB")).alias("currency"),
        "published_at",
        "deadline",
        F.greatest(F.lit(0), F.datediff(F.to_date("deadline"), F.to_date(now))).alias("days_left"),
        text(F.col("law_type")).alias("law_type"),
        text(F.get_json_object("raw_data", "$.procurement_method")).alias("procurement_method"),
        F.col("relevance_score").alias("score"),
        label("recommendation", RECOMMENDATION_NAMES).alias("recommendation"),
        text(F.col("summary")).alias("summary"),
        risk_text(F.col("risks")).alias("risks"),
        text(F.col("url")).alias("url"),
    )


def write_report(report: DataFrame, path: str, form: str = "csv") -> None:
    """Write a report as a folder of CSV (with header) or Parquet files, replacing what is there."""
    writer = report.write.mode("overwrite").format(form)
    (writer.option("header", True) if form == "csv" else writer).save(path)


def report_summary(joined: DataFrame) -> DataFrame:
    """Total, analysed, scores from 70, and the three recommendations."""
    return joined.agg(
        F.count("*").alias("total"),
        F.count("relevance_score").alias("analysed"),
        F.count_if(F.col("relevance_score") >= 70).alias("high"),
        *[F.count_if(F.col("recommendation") == r).alias(r) for r in RECOMMENDATION_NAMES],
    )
