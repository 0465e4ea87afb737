"""Streams end in the same rows as their batch twins."""

import datetime as dt
import os

from pyspark.sql import functions as F

from bidlens.operators import board, state
from bidlens.sources.tables import board_events
from bidlens.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_upsert_stream_equals_batch(spark, tmp_path):
    schema = "k long, price double, first_seen_at timestamp, updated_at timestamp"
    batches = [[(1, 5.0), (2, 6.0)], [(1, 7.0), (3, 8.0)], [(2, 6.0)]]
    src = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        at = dt.datetime(2026, 1, i + 1)
        spark.createDataFrame([(*r, at, at) for r in rows], schema).coalesce(1).write.mode("append").parquet(f"{src}/b{i}")
    stream = jobs.source(spark, f"{src}/*", schema, maxFilesPerTrigger="1")
    jobs.upsert_stream(stream, str(tmp_path / "t"), "k", ["price"], str(tmp_path / "cp")).awaitTermination()
    table = jobs.read_upserted(spark, str(tmp_path / "t"), stream.schema)
    assert {(r["k"], r["price"]) for r in table.collect()} == {(1, 7.0), (2, 6.0), (3, 8.0)}
    # a batch writes the parts of its keys only, and a table before a batch can still be read
    assert len(os.listdir(tmp_path / "t" / "v=2")) <= 1 + 1 + 2
    assert {r["k"] for r in jobs.read_upserted(spark, str(tmp_path / "t"), stream.schema, before=1).collect()} == {1, 2}


def test_upserted_parts_keep_two_versions(spark, tmp_path):
    schema = "k long, price double, first_seen_at timestamp, updated_at timestamp"
    src = str(tmp_path / "in")
    for i in range(5):
        at = dt.datetime(2026, 1, i + 1)
        spark.createDataFrame([(1, float(i), at, at), (100 + i, 1.0, at, at)], schema).coalesce(1).write.parquet(f"{src}/b{i}")
    stream = jobs.source(spark, f"{src}/*", schema, maxFilesPerTrigger="1")
    jobs.upsert_stream(stream, str(tmp_path / "t"), "k", ["price"], str(tmp_path / "cp")).awaitTermination()
    assert max(map(len, jobs._versions(spark, str(tmp_path / "t")).values())) == 2
    got = {r["k"]: r["price"] for r in jobs.read_upserted(spark, str(tmp_path / "t"), stream.schema).collect()}
    assert got == {1: 4.0} | {100 + i: 1.0 for i in range(5)}


def test_board_stream_equals_replay(spark, tmp_path):
    events = board_events(spark, SF).where("kind = 'status'")
    src = str(tmp_path / "ev")
    events.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(src)
    out = str(tmp_path / "out")
    stream = jobs.source(spark, src, spark.read.parquet(src).schema)
    q = jobs.board_stream(stream).writeStream.outputMode("update").foreachBatch(lambda df, i: df.write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["tender_id"], r["status"]) for r in spark.read.parquet(out).collect()}
    assert got == {(r["tender_id"], r["status"]) for r in board.replay_status(events).collect()}


def test_upsert_keeps_the_latest_row_whatever_file_comes_last(spark, tmp_path):
    schema = "k long, price double, first_seen_at timestamp, updated_at timestamp"
    src = str(tmp_path / "in")
    for i, (day, rows) in enumerate([(9, [(1, 5.0), (2, 6.0)]), (3, [(1, 7.0), (3, 8.0)])]):
        at = dt.datetime(2026, 1, day)
        spark.createDataFrame([(*r, at, at) for r in rows], schema).coalesce(1).write.parquet(f"{src}/b{i}")
    stream = jobs.source(spark, f"{src}/*", schema, maxFilesPerTrigger="1")
    jobs.upsert_stream(stream, str(tmp_path / "t"), "k", ["price"], str(tmp_path / "cp")).awaitTermination()
    assert {(r["k"], r["price"]) for r in jobs.read_upserted(spark, str(tmp_path / "t"), stream.schema).collect()} == {(1, 5.0), (2, 6.0), (3, 8.0)}
    assert [r["k"] for r in spark.read.parquet(f"{tmp_path}/t-events/batch=1").collect()] == [3]


def test_board_stream_bears_files_out_of_time_order(spark, tmp_path):
    schema = "tender_id long, event_id long, ts timestamp, value string, force boolean"
    src, out = str(tmp_path / "ev"), str(tmp_path / "out")
    for i, (day, value) in enumerate([(3, "docs_preparation"), (2, "participating"), (1, "reviewing")]):
        spark.createDataFrame([(1, day, dt.datetime(2026, 1, day), value, False)], schema).coalesce(1).write.parquet(f"{src}/b{i}")
    stream = jobs.board_stream(jobs.source(spark, f"{src}/*", schema, maxFilesPerTrigger="1"))
    stream.writeStream.outputMode("update").foreachBatch(lambda df, i: df.write.parquet(f"{out}/b={i}")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{out}/b=2").first()
    assert (last["status"], last["updated_at"]) == ("docs_preparation", dt.datetime(2026, 1, 3))


def test_alert_once(spark, tmp_path):
    src = str(tmp_path / "a")
    at = dt.datetime(2026, 1, 1)
    spark.createDataFrame([(1, "e", "t", "r", at), (1, "e", "t", "r", at), (1, "f", "t", "r", at)], "tender_id long, event_key string, channel string, recipient_key string, sent_at timestamp").write.parquet(src)
    q = jobs.alert_once(jobs.source(spark, src, spark.read.parquet(src).schema)).writeStream.format("memory").queryName("alerts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("alerts").count() == 2
    assert len(state.DELIVERY_KEY) == 4
    stored = spark.createDataFrame([(1, "e", "t", "r")], "tender_id long, event_key string, channel string, recipient_key string")
    q = jobs.alert_once(jobs.source(spark, src, spark.read.parquet(src).schema), delivered=stored).writeStream.format("memory").queryName("fresh_alerts").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["event_key"] for r in spark.table("fresh_alerts").collect()] == ["f"]


def test_drop_late(spark, tmp_path):
    src = str(tmp_path / "l")
    spark.createDataFrame([(1, dt.datetime(2026, 1, 1)), (2, dt.datetime(2026, 3, 1))], "k long, published_at timestamp").write.parquet(src)
    stream = jobs.source(spark, src, spark.read.parquet(src).schema)
    q = jobs.drop_late(stream, F.lit(dt.datetime(2026, 3, 10)), F.lit(30)).writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["k"] for r in spark.table("fresh").collect()] == [2]
