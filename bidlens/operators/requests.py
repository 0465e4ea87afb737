"""Captured requests of a portal, ranked by how likely they carry search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parts of an address with their weights, and what else counts.
URL_WEIGHTS = {"/api/": 8, "graphql": 8, "search": 6, "market-search": 8, "purchase": 5, "feed": 4, "tender": 4, "market/": 3}
POSTED, WITH_BODY, SCRIPTED, SCRIPT_KINDS, MOST = 3, 2, 3, ("xhr", "fetch"), 40


def request_score() -> Column:
    """Score of a request by its address, method, body and kind (columns url, method, post_data, type); a null counts nothing."""
    low = F.lower(F.coalesce("url", F.lit("")))
    out = F.lit(0)
    for part, weight in URL_WEIGHTS.items():
        out = out + F.when(F.contains(low, F.lit(part)), weight).otherwise(0)
    out = out + F.when(F.upper("method") == "POST", POSTED).otherwise(0)
    out = out + F.when(F.coalesce("post_data", F.lit("")) != "", WITH_BODY).otherwise(0)
    return out + F.when(F.coalesce(F.col("type").isin(*SCRIPT_KINDS), F.lit(False)), SCRIPTED).otherwise(0)


def top_requests(log: DataFrame, order: str, most: int = MOST) -> DataFrame:
    """(place, score, method, url, type, post_data): of each method and address the best request, the first by order among equals; the best of all, without those that score nothing.

    The places are those of one ranking over the log, so a repeated request takes no place of its own.
    """
    scored = log.withColumn("score", request_score()).withColumns({"method": F.coalesce("method", F.lit("")), "url": F.coalesce("url", F.lit(""))})
    best = scored.groupBy("method", "url").agg(F.min_by(F.struct("score", order, "type", "post_data"), F.struct(-F.col("score"), F.col(order))).alias("b"))
    first = best.select("method", "url", "b.*").orderBy(F.desc("score"), order).limit(most)
    # forty rows at most are numbered in one task
    numbered = first.groupBy().agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), F.col(order).alias("at"), "score", "method", "url", "type", "post_data"))).alias("r"))
    rows = numbered.select(F.posexplode("r").alias("i", "x")).where("x.score > 0")
    return rows.select((F.col("i") + 1).alias("place"), "x.score", "x.method", "x.url", "x.type", "x.post_data")
