"""Rule-based criteria, regions, and validation of profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean_list

# Phrases of finished procedures.
FINISHED = ("определение поставщика завершено", "закупка отменена", "процедура отменена", "определение поставщика отменено", "контракт заключен", "контракт исполнен", "контракт расторгнут")


def _limit(value: str, least: str | None = None, most: str | None = None, positive: bool = False) -> Column:
    """Whether a limit is set and the value, unknown values included, fails it."""
    limit = F.col(least or most)
    active = limit > 0 if positive else limit.isNotNull()
    fails = F.col(value) < limit if least else F.col(value) > limit
    return active & (F.col(value).isNull() | fails)


def reject_reason(now: Column) -> Column:
    """The first rule that a tender fails, in fixed order; null when it passes all."""
    short = F.timestamp_diff("SECOND", now, F.col("deadline")) < F.col("min_submission_days") * 86400
    rules = {
        "min_price": _limit("price", least="min_price"),
        "max_price": _limit("price", most="max_price"),
        "advance_required": F.col("want_advance") & ~F.coalesce("advance_required", F.lit(False)),
        "min_advance_percent": _limit("advance_percent", least="min_advance_percent", positive=True),
        "max_postpayment_days": _limit("postpayment_days", most="max_postpayment_days"),
        "min_application_security_percent": _limit("application_security_percent", least="min_application_security_percent", positive=True),
        "max_application_security_percent": _limit("application_security_percent", most="max_application_security_percent"),
        "min_contract_security_percent": _limit("contract_security_percent", least="min_contract_security_percent", positive=True),
        "max_contract_security_percent": _limit("contract_security_percent", most="max_contract_security_percent"),
        "min_submission_days": (F.col("min_submission_days") > 0) & F.col("deadline").isNotNull() & short,
        "deadline_missing": (F.col("min_submission_days") > 0) & F.col("deadline").isNull(),
    }
    out = F
    for reason, fails in rules.items():
        out = out.when(F.coalesce(fails, F.lit(False)), reason)
    return out


# Administrative abbreviations; those of a town before its name say nothing.
REGION_WORDS = {"обл.": "область", "респ.": "республика"}
TOWN_WORDS = ("г", "г.", "город")


def normal_region(c: Column) -> Column:
    """A region as lower-case words without quotes, dashes and commas, abbreviations written out."""
    words = F.filter(F.split(F.translate(F.lower(c), "ё«»", "е"), r"(?U)[\s,–—-]+"), lambda w: w != "")
    named = F.filter(words, lambda w, i: ~w.isin(*TOWN_WORDS) | (i == F.size(words) - 1))
    spelled = F.transform(named, lambda w: F.coalesce(F.get(F.filter(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in REGION_WORDS.items()]), lambda x: x["a"] == w), 0)["b"], w))
    return F.btrim(F.array_join(spelled, " "), F.lit(" .,:;"))


def wanted_regions(wanted: Column) -> Column:
    """Normal forms of the regions that a profile asks for; null where it names none, so that all pass."""
    asked = F.filter(F.transform(F.filter(wanted, lambda x: F.trim(x) != ""), normal_region), lambda x: x != "")
    return F.when(F.size(wanted) > 0, asked)


def own_regions(region: Column) -> Column:
    """Normal forms of the regions of a tender; none where it is blank."""
    return F.filter(F.transform(F.split(F.coalesce(region, F.lit("")), r"[,;|/]+"), normal_region), lambda x: x != "")


def regions_overlap(region: Column, mine: Column, asked: Column) -> Column:
    """The test on both sides' normal forms; a blank region fails where any region is asked for, even a blank one."""
    return F.when(asked.isNull(), True).when(F.trim(F.coalesce(region, F.lit(""))) == "", False).when(F.size(asked) == 0, True).otherwise(F.arrays_overlap(mine, asked))


def regions_match(region: Column, wanted: Column) -> Column:
    """Equal normal forms; without wanted regions all pass, a blank region fails else."""
    return regions_overlap(region, own_regions(region), wanted_regions(wanted))


def in_lookback(now: Column, days: Column) -> Column:
    """Published within the days before now; an unknown date stays."""
    return F.col("published_at").isNull() | (F.timestamp_diff("SECOND", F.col("published_at"), now) <= days * 86400)


def finished(text: Column) -> Column:
    return F.rlike(F.lower(F.coalesce(text, F.lit(""))), F.lit("|".join(FINISHED)))


def violations() -> Column:
    """Codes of what is wrong with a profile's limits."""
    codes = []
    for low, high in (("min_price", "max_price"), ("min_application_security_percent", "max_application_security_percent"), ("min_contract_security_percent", "max_contract_security_percent")):
        for c in (low, high):
            codes.append(F.when(F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")) | (F.col(c) < 0), f"{c}_negative"))
        codes.append(F.when(F.col(low) > F.col(high), f"{low}_above_max"))
    codes.append(F.when(~F.col("min_advance_percent").between(0, 100), "min_advance_percent_range"))
    codes.append(F.when(F.col("max_postpayment_days") < 0, "max_postpayment_days_negative"))
    codes.append(F.when(F.col("min_submission_days") < 0, "min_submission_days_negative"))
    codes.append(F.when(~F.col("min_ai_score").between(0, 100), "min_ai_score_range"))
    return F.array_compact(F.array(*codes))


def cap(df: DataFrame, by: str, order: list, n: int) -> DataFrame:
    """At most n rows of each source, the first by order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def clamped(columns: tuple[str, ...] = ("regions", "exclusions")) -> dict[str, Column]:
    """Criteria as they are kept: the score limit brought into 0 to 100 where a profile would be refused, lists cleaned of blanks and repeats."""
    return {"min_ai_score": F.greatest(F.lit(0), F.least(F.lit(100), F.col("min_ai_score").cast("int"))), **{c: clean_list(F.col(c)) for c in columns}}
