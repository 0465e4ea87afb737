"""State over time: dedup, upserts, change events, fingerprints and deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fields whose change is an event, and fields that make a delivery's fingerprint.
TRACKED = ("title", "url", "description", "price", "currency", "start_date", "end_date", "deadline", "published_at", "region", "customer", "customer_inn", "law_type", "raw_data")
FINGERPRINT = (
    "title", "description", "url", "price", "currency", "start_date", "end_date", "deadline", "published_at", "region", "customer", "customer_inn", "law_type",
    "advance_required", "advance_percent", "postpayment_days", "application_security_percent", "contract_security_percent",
)
DELIVERY_KEY = ("tender_id", "event_key", "channel", "recipient_key")


def first_wins(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key.  min_by combines on the map side, where a window would not."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def last_wins(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def changed(old: str, new: str, fields) -> Column:
    """Names of the fields whose values differ, null being a value."""
    return F.array_compact(F.array(*[F.when(~F.col(f"{old}.{c}").eqNullSafe(F.col(f"{new}.{c}")), F.lit(c)) for c in fields]))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new over old by key; first_seen_at stays, all else, nulls too, is the new row's."""
    joined = old.alias("o").join(new.withColumn("_fresh", F.lit(True)).alias("n"), key, "full_outer")
    fresh = F.col("n._fresh").isNotNull()
    columns = []
    for c in new.columns:
        if c == key:
            columns.append(F.col(key))
        elif c == "first_seen_at":
            columns.append(F.coalesce("o.first_seen_at", "n.first_seen_at").alias(c))
        else:
            columns.append(F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(*columns)


def change_events(old: DataFrame, new: DataFrame, key: str, fields) -> DataFrame:
    """(key, event_type, changed_fields) for new rows that are unknown or differ; none where equal."""
    joined = new.alias("n").join(old.withColumn("_known", F.lit(True)).alias("o"), key, "left")
    known = F.col("o._known").isNotNull()
    events = joined.select(key, F.when(known, "updated").otherwise("created").alias("event_type"), F.when(known, changed("o", "n", fields)).otherwise(F.array().cast("array<string>")).alias("changed_fields"))
    return events.where("event_type = 'created' or size(changed_fields) > 0")


def version_diff(versions: DataFrame, key: str, order: list[str], fields) -> DataFrame:
    """Each version with the fields that differ from the one before; the first has none to differ from."""
    w = Window.partitionBy(key).orderBy(*order)
    with_last = versions.select(key, order[0], F.struct(*fields).alias("n"), F.lag(F.struct(*fields)).over(w).alias("o"))
    return with_last.where("o is not null").select(key, order[0], changed("o", "n", fields).alias("changed_fields")).where("size(changed_fields) > 0")


def event_key(fields=FINGERPRINT) -> Column:
    """SHA-256 over the fields in fixed order; a null has its own mark."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in fields]), 256)


def undelivered(alerts: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Alerts that this recipient has not had for this state of the tender."""
    return alerts.join(deliveries, list(DELIVERY_KEY), "left_anti")


def mark_delivered(deliveries: DataFrame, sent: DataFrame) -> DataFrame:
    """One row per delivery key with its latest time."""
    return deliveries.unionByName(sent).groupBy(*DELIVERY_KEY).agg(F.max("sent_at").alias("sent_at"))


def rename_recipient(deliveries: DataFrame, current: DataFrame, legacy: str, recipient: str) -> DataFrame:
    """Deliveries of a legacy recipient moved to the one that took over, under the fingerprint that the tender has now (``current``: tender_id, event_key).

    What the new recipient already has under that key stays; of several legacy rows of a key the first by id counts.  Rows of other recipients, and legacy rows of tenders that are gone,
    which keep their key, lose nothing.  ``deliveries`` has the key, delivery_id, sent_at and payload.
    """
    key = list(DELIVERY_KEY)
    kept, old = deliveries.where(F.col("recipient_key") != legacy), deliveries.where(F.col("recipient_key") == legacy)
    renewed = old.join(current.select("tender_id", F.col("event_key").alias("_now")), "tender_id", "left")
    renewed = renewed.withColumns({"event_key": F.coalesce("_now", "event_key"), "recipient_key": F.lit(recipient)}).drop("_now").select(*deliveries.columns)
    return kept.unionByName(first_wins(renewed, key, [F.col("delivery_id")]).join(kept.select(*key), key, "left_anti").select(*deliveries.columns))
