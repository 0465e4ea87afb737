"""Upserts that write what a batch brings: deltas beside a base, merged when read, and folded into a new base now and then.

``target``/base=N/parts=M/part=P is the table as batch N left it, in M parts by a hash of the key; ``target``/delta=N holds the rows that batch N
changed, whole rows as they are from then on.  A reader takes the last base and the deltas after it, the latest row of a key.  A batch reads the
parts of its keys and writes its own rows; as the deltas after a base come to hold a share of its rows, all becomes a new base, whose number of parts grows with
the table.  So a row is rewritten a bounded number of times on the average.  A batch that is run again writes the same files from the same state before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators import state

#: Rows of a part, and the share of a base's rows that its deltas may come to before it is written anew.
PART_ROWS, SHARE = 1_000_000, 0.5
#: Keys of a batch that may be broadcast to the parts they are looked up in.
BROADCAST_KEYS = 1_000_000


def _folder(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, target: str, kind: str) -> list[int]:
    """Batches whose base or delta is complete, in order."""
    pattern, fs = _folder(spark, f"{target}/{kind}=*/" + ("parts=*/" if kind == "base" else "") + "_SUCCESS")
    paths = [str(s.getPath()) for s in fs.globStatus(pattern) or []]
    return sorted(int(p.split(f"/{kind}=")[-1].split("/")[0]) for p in paths)


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _base(spark: SparkSession, target: str, schema, number: int | None, keys: DataFrame | None, key: str) -> DataFrame:
    """A base, or those of its parts that hold keys."""
    if number is None:
        return spark.createDataFrame([], schema)
    pattern, fs = _folder(spark, f"{target}/base={number}/parts=*")
    path = str(fs.globStatus(pattern)[0].getPath())
    parts = int(path.split("parts=")[-1])
    rows = spark.read.schema(StructType([*schema.fields, StructField("part", IntegerType())])).parquet(path)
    if keys is not None:
        touched = [r[0] for r in keys.select(_part(key, parts)).distinct().collect()]  # as many as the base has parts at most
        rows = rows.where(F.col("part").isin(touched)) if touched else rows.limit(0)
    return rows.drop("part")


def _deltas(spark: SparkSession, target: str, schema, numbers: list[int]) -> DataFrame:
    each = [spark.read.schema(schema).parquet(f"{target}/delta={n}").withColumn("_batch", F.lit(n)) for n in numbers]
    out = each[0]
    for d in each[1:]:
        out = out.unionByName(d)
    return out


def read_merged(spark: SparkSession, target: str, schema, key: str, before: int | None = None, keys: DataFrame | None = None) -> DataFrame:
    """The table, perhaps as it was before a batch, perhaps only the rows of some keys."""
    known = {k: [n for n in _numbers(spark, target, k) if before is None or n < before] for k in ("base", "delta")}
    last = known["base"][-1] if known["base"] else None
    later = [n for n in known["delta"] if last is None or n > last]
    rows = _base(spark, target, schema, last, keys, key).withColumn("_batch", F.lit(-1))
    if later:
        rows = rows.unionByName(_deltas(spark, target, schema, later))
    if keys is not None:
        ids = keys.select(key).distinct()
        rows = rows.join(F.broadcast(ids) if ids.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else ids, key, "left_semi")
    return state.last_wins(rows, [key], [F.col("_batch")]).select(*schema.fieldNames()) if later else rows.drop("_batch")


def merge_batch(batch: DataFrame, batch_id: int, target: str, key: str, fields: list[str], order: tuple[str, ...] = ("updated_at",), part_rows: int = PART_ROWS) -> None:
    """Write a batch's delta and its change events (``target``-events/batch=N), and a new base where the deltas have grown.

    Of a key's rows in a batch the last by order counts; a row older by order than the stored one changes nothing, and null is older than any value.
    """
    spark, schema = batch.sparkSession, batch.schema
    new = state.last_wins(batch, [key], [F.col(c) for c in order]).select(*batch.columns)
    new.persist()
    old = read_merged(spark, target, schema, key, batch_id, new)
    stored = old.select(key, F.lit(True).alias("_known"), F.struct(*order).alias("_stored"))
    fresh = new.join(stored, key, "left").where(F.col("_known").isNull() | (F.struct(*order) >= F.col("_stored"))).select(*batch.columns)
    state.change_events(old, fresh, key, fields).write.mode("overwrite").parquet(f"{target}-events/batch={batch_id}")
    changed = state.upsert(old.join(fresh.select(key), key, "left_semi"), fresh, key).select(*batch.columns)
    changed.write.mode("overwrite").parquet(f"{target}/delta={batch_id}")
    new.unpersist()
    bases = [n for n in _numbers(spark, target, "base") if n < batch_id]
    later = [n for n in _numbers(spark, target, "delta") if n <= batch_id and (not bases or n > bases[-1])]
    held = _base(spark, target, schema, bases[-1] if bases else None, None, key).count()
    if _deltas(spark, target, schema, later).count() > SHARE * held:
        table = read_merged(spark, target, schema, key, batch_id + 1)
        parts = max(1, -(-table.count() // part_rows))
        _written(table, f"{target}/base={batch_id}/parts={parts}", key, parts)
        for n in bases[:-1]:  # the base before this one stays, for a batch that is run again
            path, fs = _folder(spark, f"{target}/base={n}")
            fs.delete(path, True)
        for n in [d for d in _numbers(spark, target, "delta") if bases and d <= bases[-1]]:
            path, fs = _folder(spark, f"{target}/delta={n}")
            fs.delete(path, True)


def _written(table: DataFrame, path: str, key: str, parts: int) -> None:
    table.withColumn("part", _part(key, parts)).repartition(parts, "part").write.mode("overwrite").partitionBy("part").parquet(path)


def merge_stream(rows: DataFrame, target: str, key: str, fields: list[str], checkpoint: str, order: tuple[str, ...] = ("updated_at",)):
    """Upsert every batch of a stream by :func:`merge_batch`; :func:`read_merged` reads the table."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch, batch_id, target, key, fields, order)

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
