"""Pairs of tenders and search profiles: by keywords where a profile has some, by intervals where it has none.

A profile without keywords takes every tender that its limits let through.  To find these without comparing everything with
everything, prices and days before the deadline are cut into bands; a profile stands in each band that its limits reach, or in the band "any" where
it has no limit, and a tender in its own band and in "any".  Profiles and tenders then meet by equality of region, price band
and deadline band, each pair in one band only, and the rules decide on what has met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import criteria as c
from . import keywords as k

#: Bands double in width: prices to 2^62, days before a deadline to 2^20.
PRICE_BANDS, DAY_BANDS = 62, 20
#: The band and the region of a profile that has no such limit.
ANY, ANY_REGION = -2, "*"
#: The keyword of a profile that has none; no text is matched by a blank one.
ANY_KEYWORD = ""
#: Rows of profiles in bands that may be broadcast.
BROADCAST_BANDS = 500_000


def band(value: Column, last: int) -> Column:
    """The band of a value: 0 up to 1, then one a doubling; not a number counts as largest."""
    v = F.greatest(value.cast("double"), F.lit(0.0))
    return F.when(F.isnan(v), last).otherwise(F.least(F.floor(F.log2(v + 1)), F.lit(last)).cast("int"))


def _range(low: Column, high: Column) -> Column:
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def in_bands(profiles: DataFrame) -> DataFrame:
    """Profiles with region_key, price_key, day_key, a row for each combination that their limits reach."""
    asked = c.wanted_regions(F.col("regions"))
    free = asked.isNull() | (F.size(asked) == 0)
    prices = _range(band(F.coalesce("min_price", F.lit(0)), PRICE_BANDS), F.when(F.col("max_price").isNull(), PRICE_BANDS).otherwise(band(F.col("max_price"), PRICE_BANDS)))
    days = _range(band(F.col("min_submission_days"), DAY_BANDS), F.lit(DAY_BANDS))
    rows = profiles.withColumn("asked", asked).withColumn("region_key", F.explode(F.when(free, F.array(F.lit(ANY_REGION))).otherwise(F.array_distinct("asked"))))
    rows = rows.withColumn("price_key", F.explode(F.when(F.col("min_price").isNull() & F.col("max_price").isNull(), F.array(F.lit(ANY))).otherwise(prices)))
    return rows.withColumn("day_key", F.explode(F.when(F.coalesce(F.col("min_submission_days"), F.lit(0)) <= 0, F.array(F.lit(ANY))).otherwise(days)))


def keywords_in_bands(profiles: DataFrame) -> DataFrame:
    """Profiles with a row for each keyword and region that they ask for, in the bands "any"."""
    asked = c.wanted_regions(F.col("regions"))
    free = asked.isNull() | (F.size(asked) == 0)
    rows = profiles.withColumn("asked", asked).withColumn("region_key", F.explode(F.when(free, F.array(F.lit(ANY_REGION))).otherwise(F.array_distinct("asked"))))
    return rows.withColumns({"keyword_key": F.explode(F.array_distinct("keywords")), "price_key": F.lit(ANY), "day_key": F.lit(ANY)})


def tenders_in_bands(tenders: DataFrame, now: Column, open_to: Column) -> DataFrame:
    """Tenders with mine (normal forms of their regions) and the keys under which profiles may ask for them: those with keywords by ``said``, those without where ``open_to`` holds."""
    left = F.timestamp_diff("SECOND", now, F.col("deadline")) / 86400
    # an unknown price or deadline passes no limit, so it has the band "any" alone
    prices = F.array_compact(F.array(F.lit(ANY), F.when(F.col("price").isNotNull(), band(F.col("price"), PRICE_BANDS))))
    days = F.array_compact(F.array(F.lit(ANY), F.when(F.col("deadline").isNotNull(), band(left, DAY_BANDS))))

    def key(keyword: Column, price: Column, day: Column) -> Column:
        return F.struct(keyword.alias("keyword_key"), price.alias("price_key"), day.alias("day_key"))

    limits = F.flatten(F.transform(prices, lambda p: F.transform(days, lambda d: key(F.lit(ANY_KEYWORD), p, d))))
    named = F.transform("said", lambda x: key(x, F.lit(ANY), F.lit(ANY)))
    rows = tenders.withColumn("mine", c.own_regions(F.col("region")))
    # outer, since of a plain explode Spark takes a filter that makes the array, and so what it comes from, once more
    rows = rows.select("*", F.explode_outer(F.when(open_to, F.concat(limits, named)).otherwise(named)).alias("_key")).select("*", "_key.*").drop("_key")
    return rows.withColumn("region_key", F.explode_outer(F.array_distinct(F.concat(F.array(F.lit(ANY_REGION)), "mine"))))


def match_open(tenders: DataFrame, profiles: DataFrame, now: Column, *, text_col: str, least: int = 10) -> DataFrame:
    """(profile_id, tender_id) of the profiles without keywords and the tenders that pass their regions, limits, exclusions and the gates of texts.

    Profiles have ``exclusions`` and the limits of :func:`criteria.reject_reason`.  A blank region passes only profiles that ask for none.
    """
    return match_all(tenders, profiles.withColumn("keywords", F.array().cast("array<string>")), now, text_col=text_col, least=least)


def match_keywords(tenders: DataFrame, profiles: DataFrame, *, text_col: str) -> DataFrame:
    """Tenders with the profiles that share a keyword and a region with them, a row a pair, with the columns of both."""
    # regions are put in normal form once a tender and once a profile, and a tender's keywords are one row
    said = k.said_keywords(tenders, profiles.select(F.explode("keywords").alias("keyword")), id_col="tender_id", text_col=text_col)
    asking = profiles.withColumn("asked", c.wanted_regions(F.col("regions"))).drop("name")
    with_region = said.withColumn("mine", c.own_regions(F.col("region")))
    rows = with_region.withColumn("keyword", F.explode_outer("said")).join(asking.withColumn("keyword", F.explode("keywords")), "keyword")
    # of the keywords that a profile and a tender share, the first in order makes the pair
    shared = F.array_min(F.array_intersect("keywords", "said")) == F.col("keyword")
    return rows.where(shared & c.regions_overlap(F.col("region"), F.col("mine"), F.col("asked")))


def match_all(tenders: DataFrame, profiles: DataFrame, now: Column, *, text_col: str, least: int = 10) -> DataFrame:
    """(profile_id, tender_id) that pass, whether a profile has keywords or none; each tender is read, and its text parted into words, once for all profiles."""
    blank = F.size(F.filter(F.coalesce("keywords", F.array().cast("array<string>")), lambda x: F.trim(x) != "")) == 0
    asked = profiles.drop("name")
    banded = in_bands(asked.where(blank)).withColumn("keyword_key", F.lit(ANY_KEYWORD)).unionByName(keywords_in_bands(asked.where(~blank)))
    if banded.limit(BROADCAST_BANDS + 1).count() <= BROADCAST_BANDS:
        banded = F.broadcast(banded)
    words = asked.where(~blank).select(F.explode("keywords").alias("keyword")).unionByName(asked.where(blank).select(F.explode("exclusions").alias("keyword")))
    said = k.said_keywords(tenders, words, id_col="tender_id", text_col=text_col)
    keyed = tenders_in_bands(said, now, k.quality_gate() & (F.length(text_col) >= least))
    met = keyed.join(banded, ["keyword_key", "region_key", "price_key", "day_key"])
    # of the regions that both name, and of the keywords, the first in order makes the pair
    once = (F.col("region_key") == ANY_REGION) | (F.array_min(F.array_intersect("mine", "asked")) == F.col("region_key"))
    region = c.regions_overlap(F.col("region"), F.col("mine"), F.col("asked"))
    by_limits = F.coalesce(~F.arrays_overlap("said", "exclusions"), F.lit(True))
    by_words = F.array_min(F.array_intersect("keywords", "said")) == F.col("keyword_key")
    allowed = F.when(F.col("keyword_key") == ANY_KEYWORD, by_limits).otherwise(by_words)
    return met.where(once & region & allowed & c.reject_reason(now).isNull()).select("profile_id", "tender_id")
