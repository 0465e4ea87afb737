"""Incremental forms of the state operators as Structured Streaming jobs.

Each writes through foreachBatch or a stateful operator and ends, with availableNow, in the
same rows as its batch twin.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import board, criteria, state

#: The status events so far as JSON: [nanoseconds, event_id, value, force], in that order.
BOARD_STATE = "events string"


def source(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    """New Parquet files of a folder, a bounded number a trigger."""
    return spark.readStream.schema(schema).options(**({"maxFilesPerTrigger": "8"} | options)).parquet(path)


#: Parts of an upserted table, by a hash of the key; a batch rewrites those that it touches.
PARTS = 64


def _part(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def _versions(spark: SparkSession, target: str) -> dict[int, list[int]]:
    """Per part of an upserted table its versions in order; at most a few a part are kept."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v=*/part=*")
    found: dict[int, list[int]] = {}
    for status in pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []:
        path = status.getPath()
        found.setdefault(int(path.getName()[5:]), []).append(int(path.getParent().getName()[2:]))
    return {p: sorted(v) for p, v in found.items()}


def read_upserted(spark: SparkSession, target: str, schema, before: int | None = None, parts: set[int] | None = None) -> DataFrame:
    """The table that :func:`upsert_stream` keeps: the last version of every part, or of some, perhaps as it was before a batch."""
    paths = []
    for p, versions in _versions(spark, target).items():
        known = [v for v in versions if before is None or v < before]
        if known and (parts is None or p in parts):
            paths.append(f"{target}/v={known[-1]}/part={p}")
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert_stream(rows: DataFrame, target: str, key: str, fields: list[str], checkpoint: str, order: tuple[str, ...] = ("updated_at",)):
    """Upsert every batch into the parts of a table that hold its keys, and append its change events.

    ``target``/v=N/part=P holds part P as batch N left it and ``target``-events/batch=N the events; a batch that is run again
    overwrites its own parts and events from the versions before it, so the result does not depend on retries.  A row that is older by
    ``order`` than the stored one changes nothing, so it does not depend on the order of arrival either.  Of a part the two last
    versions stay; :func:`read_upserted` reads the table.
    """
    schema = rows.schema

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = state.last_wins(batch, [key], [F.col(c) for c in order]).select(*batch.columns)
        touched = {r[0] for r in new.select(_part(key)).distinct().collect()}  # at most PARTS
        old = read_upserted(spark, target, schema, batch_id, touched)
        new = new.join(old.select(key, F.struct(*order).alias("_stored")), key, "left").where(F.col("_stored").isNull() | (F.struct(*order) >= F.col("_stored"))).select(*batch.columns)
        new.persist()
        state.change_events(old, new, key, fields).write.mode("overwrite").parquet(f"{target}-events/batch={batch_id}")
        state.upsert(old, new, key).withColumn("part", _part(key)).write.mode("overwrite").partitionBy("part").parquet(f"{target}/v={batch_id}")
        new.unpersist()
        for p, versions in _versions(spark, target).items():
            for v in versions[:-2] if p in touched else ():
                gone = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v={v}/part={p}")
                gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def alert_once(alerts: DataFrame, time: str = "sent_at", horizon: str = "90 days", delivered: DataFrame | None = None) -> DataFrame:
    """The first alert for each tender state, channel and recipient; keys are kept for the horizon after their time.

    ``delivered``, the stored deliveries, keeps alerts away that went out before, however long ago.
    """
    if delivered is not None:
        alerts = alerts.join(delivered.select(*state.DELIVERY_KEY), list(state.DELIVERY_KEY), "left_anti")
    return alerts.withWatermark(time, horizon).dropDuplicatesWithinWatermark(list(state.DELIVERY_KEY))


def drop_late(rows: DataFrame, now: Column, days: Column) -> DataFrame:
    """The lookback as a rule for late rows: the days of each platform decide, row by row, so no state is kept; rows of unknown date stay."""
    return rows.where(criteria.in_lookback(now, days))


def split_late(rows: DataFrame, now: Column, days: Column, target: str, checkpoint: str):
    """Two outputs of one stream: ``target``/kept/batch=N as :func:`drop_late` keeps them, ``target``/late/batch=N the others with ``delay_seconds`` beyond the lookback.

    A batch that is run again overwrites its own output.
    """
    fresh = criteria.in_lookback(now, days)
    delay = F.timestamp_diff("SECOND", F.col("published_at"), now) - days * 86400

    def apply(batch: DataFrame, batch_id: int) -> None:
        marked = batch.withColumns({"_fresh": fresh, "delay_seconds": delay}).persist()
        marked.where("_fresh").drop("_fresh", "delay_seconds").write.mode("overwrite").parquet(f"{target}/kept/batch={batch_id}")
        marked.where("not _fresh").drop("_fresh").write.mode("overwrite").parquet(f"{target}/late/batch={batch_id}")
        marked.unpersist()

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _step(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
    events = json.loads(kept.get[0]) if kept.exists else []
    for batch in batches:
        rows = zip(batch["ts"], batch["event_id"], batch["value"], batch["force"], strict=True)
        events += [[ts.value, int(i), value, bool(force)] for ts, i, value, force in rows if value in board.STATUSES]
    events.sort(key=lambda e: e[:2])
    status, at = "new", pd.NaT
    for ts, _, value, force in events:
        if value == status or force or value in board.ALLOWED[status]:
            status, at = value, pd.Timestamp(ts)
    kept.update((json.dumps(events),))
    yield pd.DataFrame({"tender_id": [key[0]], "status": [status], "updated_at": [at]})


def board_stream(events: DataFrame) -> DataFrame:
    """Status per tender after each batch of events, which may arrive in any order: a tender's status events stay in its state."""
    return events.groupBy("tender_id").applyInPandasWithState(_step, "tender_id long, status string, updated_at timestamp", BOARD_STATE, "update", GroupStateTimeout.NoTimeout)
