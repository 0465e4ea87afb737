"""Model answers: parse, normalise, and stand-ins for unusable ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Recommendations, and what an unusable answer is replaced by.
RECOMMENDATIONS = ("participate", "review", "skip")
STUB_SCORE, STUB_RECOMMENDATION = 50, "review"
SCHEMA = "relevance_score string, summary string, recommendation string, risks string, budget_note string, deadline_note string"


def parse(answers: DataFrame, content: str = "content") -> DataFrame:
    """answers with `body`, the JSON object text of the answer, null if there is none.

    Think blocks go first; then the whole text, else its outermost braces, must be an object.
    """
    bare = F.trim(F.regexp_replace(F.coalesce(content, F.lit("")), r"(?is)<think>.*?</think>", ""))
    inner = F.regexp_substr(F.col("_bare"), F.lit(r"(?s)\{.*\}"))
    whole = F.when(F.startswith("_bare", F.lit("{")) & F.try_parse_json("_bare").isNotNull(), F.col("_bare"))
    part = F.when(F.try_parse_json(inner).isNotNull(), inner)
    return answers.withColumn("_bare", bare).withColumn("body", F.coalesce(whole, part)).drop("_bare")


def normalize(parsed: DataFrame, allow_stub: bool = False) -> DataFrame:
    """relevance_score (int, 0 to 100), summary, recommendation, risks (at most three), notes, error and is_stub."""
    fields = {k: F.get_json_object("body", f"$.{k}") for k in ("relevance_score", "summary", "recommendation", "risks", "budget_note", "deadline_note")}
    score = F.trim(fields["relevance_score"]).try_cast("double")
    error = F.when(F.col("body").isNull(), "not_json").when(score.isNull(), "bad_score")
    risks = F.filter(F.transform(F.coalesce(F.from_json(fields["risks"], "array<string>"), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    said = F.lower(F.trim(F.coalesce(fields["recommendation"], F.lit(""))))
    out = parsed.withColumns(
        {
            "error": error,
            "relevance_score": F.when(error.isNull(), F.greatest(F.lit(0), F.least(F.lit(100), score.cast("int")))),
            "recommendation": F.when(error.isNull(), F.when(said.isin(*RECOMMENDATIONS), said).otherwise("review")),
            "risks": F.when(error.isNull(), F.slice(risks, 1, 3)),
            **{c: F.when(error.isNull(), F.trim(F.coalesce(fields[c], F.lit("")))) for c in ("summary", "budget_note", "deadline_note")},
        }
    )
    if not allow_stub:
        return out.withColumn("is_stub", F.lit(False))
    lost = F.col("error").isNotNull()
    return out.withColumns(
        {
            "is_stub": lost,
            "relevance_score": F.when(lost, STUB_SCORE).otherwise(F.col("relevance_score")),
            "recommendation": F.when(lost, STUB_RECOMMENDATION).otherwise(F.col("recommendation")),
        }
    )
