"""Settings of a search: cleaned lists, the order in which they are resolved, and profiles for users without one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The known platforms, and other spellings of them.
PLATFORMS = ("eis", "b2b_center", "fabrikant", "rts_tender", "tmk", "rosatom")
ALIASES = {"fabricant": "fabrikant"}
SETTINGS = ("keywords", "platforms", "exclusions", "regions")


def clean_platforms(c: Column) -> Column:
    """A list of platforms with other spellings rewritten, unknown ones dropped and repeats gone, in its order."""
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    spelled = F.transform(c, lambda x: F.coalesce(F.try_element_at(names, x), x))
    return F.array_distinct(F.filter(spelled, lambda x: x.isin(*PLATFORMS)))


def first_given(*choices: Column) -> Column:
    """The first list that is not empty; an empty one if all are."""
    return F.coalesce(*[F.when(F.size(c) > 0, c) for c in choices], F.array().cast("array<string>"))


def resolve(searches: DataFrame, profiles: DataFrame, defaults: dict[str, list[str]], key: str = "profile_id") -> DataFrame:
    """Searches with the lists of SETTINGS: those asked for, else those of the enabled profile, else the defaults.

    searches has ``asked_<setting>`` lists, null where nothing was asked; a search without a profile has no row in profiles.
    """
    own = profiles.where("enabled").select(key, *[F.col(s).alias(f"own_{s}") for s in SETTINGS])
    given = {s: F.array(*[F.lit(x) for x in defaults.get(s, [])]).cast("array<string>") for s in SETTINGS}
    joined = searches.join(own, key, "left")
    kept = [c for c in searches.columns if not c.startswith("asked_")]
    return joined.select(*kept, *[first_given(F.col(f"asked_{s}"), F.col(f"own_{s}"), given[s]).alias(s) for s in SETTINGS])


def default_profiles(users: DataFrame, profiles: DataFrame, criteria: DataFrame, name: str = "Основной") -> DataFrame:
    """A profile of that name for every user who has none, with the user's own criteria (user_id and whatever columns they have)."""
    missing = users.select("user_id").distinct().join(profiles.select("user_id"), "user_id", "left_anti")
    return missing.join(criteria, "user_id", "left").withColumn("name", F.lit(name))
