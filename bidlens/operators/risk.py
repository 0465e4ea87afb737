"""Deterministic risk factors of a tender and their level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds in days and percent, complete statuses, severities.
HIGH_DAYS, MEDIUM_DAYS = 3.0, 7.0
HIGH_APPLICATION, HIGH_CONTRACT = 5.0, 30.0
COMPLETE = ("success", "ok")
RANK = {"low": 0, "medium": 1, "high": 2}
CRITICAL = 3


def missing_critical() -> Column:
    """Names of missing price, deadline and customer; a blank customer of spaces counts as present."""
    gaps = [F.when(F.col("price").isNull(), "price"), F.when(F.col("deadline").isNull(), "deadline"), F.when(F.coalesce("customer", F.lit("")) == "", "customer")]
    return F.array_compact(F.array(*gaps))


def factors(now: Column) -> Column:
    """Ordered array of (code, severity, evidence, source)."""
    kind = "struct<code:string,severity:string,evidence:string,source:string>"

    def factor(condition: Column, code: str, severity, evidence: Column, source: str) -> Column:
        sev = severity if isinstance(severity, Column) else F.lit(severity)
        return F.when(condition, F.struct(F.lit(code).alias("code"), sev.alias("severity"), evidence.cast("string").alias("evidence"), F.lit(source).alias("source"))).cast(kind)

    missing = missing_critical()
    days = F.timestamp_diff("SECOND", now, F.col("deadline")) / 86400.0
    told = F.concat(F.format_number(days, 1), F.lit(" дн."))
    status = F.lower(F.trim(F.coalesce("detail_status", F.lit(""))))
    found = [
        factor(F.size(missing) > 0, "insufficient_data", F.when(F.size(missing) >= 2, "high").otherwise("medium"), F.array_join(missing, ", "), "tender"),
        factor(days < 0, "deadline_passed", "high", F.date_format("deadline", "yyyy-MM-dd HH:mm:ss"), "deadline"),
        factor(days.between(0, MEDIUM_DAYS), "short_deadline", F.when(days <= HIGH_DAYS, "high").otherwise("medium"), told, "deadline"),
        factor(F.col("application_security_percent") > HIGH_APPLICATION, "high_application_security", "medium", F.concat(F.col("application_security_percent").cast("string"), F.lit("%")), "application_security_percent"),
        factor(F.col("contract_security_percent") > HIGH_CONTRACT, "high_contract_security", "medium", F.concat(F.col("contract_security_percent").cast("string"), F.lit("%")), "contract_security_percent"),
        factor(F.col("advance_required") & F.col("advance_percent").isNull(), "unclear_advance", "low", F.lit("advance_percent"), "advance_percent"),
        factor((status != "") & ~status.isin(*COMPLETE), "incomplete_detail_data", "medium", F.col("detail_status"), "detail_status"),
    ]
    return F.array_compact(F.array(*found))


def level(factors_column: str = "factors") -> Column:
    """UNKNOWN without any critical field, else the worst severity, LOW without factors."""
    ranks = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])
    worst = F.array_max(F.transform(F.col(factors_column), lambda f: ranks[f["severity"]]))
    return F.when(F.size(missing_critical()) >= CRITICAL, "UNKNOWN").when(worst == 2, "HIGH").when(worst == 1, "MEDIUM").otherwise("LOW")


def assess(tenders: DataFrame, now: Column) -> DataFrame:
    return tenders.withColumn("factors", factors(now)).withColumn("level", level())
