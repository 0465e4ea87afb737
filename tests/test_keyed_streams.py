"""Keyed state and merged deltas against their batch twins, with bounded state and bounded writes."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from bidlens.operators import board
from bidlens.sources.tables import board_events
from bidlens.streaming import jobs, keyed, merge

SF = "/root/testdata/sf0.001"
ROW = "k long, price double, first_seen_at timestamp, updated_at timestamp"


def _run(stream, mode, out, checkpoint):
    stream.writeStream.outputMode(mode).foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/b={i}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def test_board_state_equals_batch_with_few_events_waiting(spark, tmp_path):
    events = board_events(spark, SF).withColumn("ts", F.col("ts").cast("timestamp")).select(*keyed.BOARD_EVENTS)
    src, out = str(tmp_path / "ev"), str(tmp_path / "out")
    rows = sorted(events.collect(), key=lambda r: (r["ts"], r["event_id"]))
    rng, step = random.Random(1), -(-len(rows) // 6)
    for i in range(6):  # files in order of time but for neighbours, and mixed inside
        part = rows[i * step : (i + 1) * step]
        rng.shuffle(part)
        spark.createDataFrame(part, events.schema).coalesce(1).write.parquet(f"{src}/b{i}")
    span = rows[-1]["ts"] - rows[0]["ts"]
    stream = keyed.board_state(jobs.source(spark, f"{src}/*", events.schema, maxFilesPerTrigger="1"), f"{int(span.total_seconds() / 3)} seconds")
    _run(stream, "update", out, str(tmp_path / "cp"))
    answers = spark.read.parquet(out).drop("b")
    last = {r["tender_id"]: r for r in answers.groupBy("tender_id").agg(F.max_by(F.struct("status", "assignee", "changes", "labels"), "batch").alias("r")).select("tender_id", "r.*").collect()}
    status = {r["tender_id"]: r["status"] for r in board.replay_status(events.where("kind = 'status'")).collect()}
    who = {r["tender_id"]: (r["assignee"], r["changes"]) for r in board.assignees(events).collect()}
    labels = {}
    for r in board.labels(events).collect():
        labels.setdefault(r["tender_id"], set()).add(r["label"])
    assert len(last) == len({r["tender_id"] for r in rows})
    for k, r in last.items():
        assert (r["status"], (r["assignee"], r["changes"]), set(r["labels"])) == (status.get(k, "new"), who.get(k, ("", 0)), labels.get(k, set())), k
    # what waits are the events of a tender inside the watermark, not its history
    most = {r["tender_id"]: r["n"] for r in events.groupBy("tender_id").agg(F.count("*").alias("n")).collect()}
    waiting = answers.where(F.col("batch") == answers.agg(F.max("batch")).first()[0]).collect()
    assert waiting and sum(r["waiting"] for r in waiting) < 0.8 * sum(most[r["tender_id"]] for r in waiting)


def test_deadlines_come_near_and_go(spark, tmp_path):
    schema = "tender_id long, at timestamp, kind string, deadline timestamp, value string"
    day = lambda n: dt.datetime(2026, 1, n)
    files = [
        [(1, day(1), "tender", day(10), None), (2, day(1), "tender", day(20), None), (3, day(1), "tender", None, None), (1, day(1), "status", None, "reviewing"), (2, day(1), "status", None, "submitted"), (3, day(1), "status", None, "reviewing")],
        [(9, day(5), "clock", None, "new")],
        [(9, day(8), "clock", None, "new")],
        [(2, day(12), "status", None, "won"), (9, day(13), "clock", None, "new")],
        [(2, day(18), "status", None, "reviewing"), (9, day(18), "clock", None, "new")],
        [(9, day(25), "clock", None, "new")],
    ]
    src, out = str(tmp_path / "ch"), str(tmp_path / "out")
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/b{i}")
    _run(keyed.deadlines(jobs.source(spark, f"{src}/*", schema, maxFilesPerTrigger="1"), 3), "update", out, str(tmp_path / "cp"))
    said = [(r["tender_id"], r["action"]) for r in spark.read.parquet(out).orderBy("batch", "tender_id").collect()]
    assert [x for x in said if x[0] == 1] == [(1, "near"), (1, "gone")]
    assert [x for x in said if x[0] == 2] == [(2, "near"), (2, "gone")]
    assert not [x for x in said if x[0] in (3, 9)]


CHANGES = "tender_id long, at timestamp, kind string, deadline timestamp, value string"


def _deadlines(spark, tmp_path, files, horizon="0 seconds"):
    """What is said of files that come one a batch, and the rows of state in the end."""
    src, out = str(tmp_path / "ch"), str(tmp_path / "out")
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.parquet(f"{src}/b{i}")
    stream = keyed.deadlines(jobs.source(spark, f"{src}/*", spark.createDataFrame([], CHANGES).schema, maxFilesPerTrigger="1"), 3, horizon)
    query = stream.writeStream.outputMode("update").foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/b={i}")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    said = [(r["tender_id"], r["action"], r["deadline"]) for r in spark.read.parquet(out).orderBy("batch", "tender_id").collect()]
    return said, max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])


def test_deadlines_of_many_tenders_have_few_rows_of_state(spark, tmp_path):
    """State and timers are kept by parts of tenders; ids of any size, negative and missing ones come back as they were."""
    at, due = dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 10)
    ids = [*range(3_000), -1, -70_000, 2**62 + 5, -(2**63), None]
    said, kept = _deadlines(spark, tmp_path, [[(i, at, "both", due, "reviewing") for i in ids], [(0, dt.datetime(2026, 1, 8), "clock", None, "reviewing")]])
    assert sorted(said, key=str) == sorted([(i, "near", due) for i in ids], key=str)
    assert kept <= 3 * (keyed.LANES + 5)


def test_deadlines_that_are_told_late_change_nothing(spark, tmp_path):
    """Within the horizon an older row may come after a newer one."""
    day = lambda n: dt.datetime(2026, 1, n)
    files = [[(1, day(5), "both", day(10), "reviewing")], [(1, day(4), "both", day(30), "won")], [(1, None, "both", day(31), "won"), (9, day(18), "clock", None, "new")]]
    assert _deadlines(spark, tmp_path, files, "10 days")[0] == [(1, "near", day(10))]


def test_deadlines_come_near_on_the_millisecond_in_any_time_zone(spark, tmp_path):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Vladivostok")
    try:
        at, due = dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 10, 0, 0, 0, 1_500)
        clock = [(due - dt.timedelta(days=3, microseconds=500), []), (due - dt.timedelta(days=3, microseconds=-500), ["near"])]
        for n, (now, want) in enumerate(clock):
            said, _ = _deadlines(spark, tmp_path / str(n), [[(1, at, "both", due, "reviewing")], [(2, now, "clock", None, "new")]])
            assert [x[1] for x in said] == want, (n, said)
            assert all(x[2] == due for x in said)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_late_rows_go_to_an_output_of_their_own(spark, tmp_path):
    src = str(tmp_path / "l")
    rows = [(1, dt.datetime(2026, 1, 1)), (2, dt.datetime(2026, 3, 1)), (3, None)]
    spark.createDataFrame(rows, "k long, published_at timestamp").write.parquet(src)
    stream = jobs.source(spark, src, spark.read.parquet(src).schema)
    jobs.split_late(stream, F.lit(dt.datetime(2026, 3, 10)), F.lit(30), str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(f"{tmp_path}/t/kept").collect()) == [2, 3]
    assert [(r["k"], r["delay_seconds"]) for r in spark.read.parquet(f"{tmp_path}/t/late").collect()] == [(1, (68 - 30) * 86400)]


def _size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_a_batch_writes_its_own_rows_and_retries_change_nothing(spark, tmp_path):
    target, at = str(tmp_path / "t"), dt.datetime(2026, 1, 1)
    rng = random.Random(2)
    want = {}
    first = [(i, rng.random(), at, at) for i in range(20_000)]
    batches = [first] + [[(rng.randrange(30_000), rng.random(), at + dt.timedelta(days=b), at + dt.timedelta(days=b)) for _ in range(50)] for b in range(1, 4)]
    for n, rows in enumerate(batches):
        for r in rows:
            if r[0] not in want or (r[3], r[1]) >= (want[r[0]][3], want[r[0]][1]):
                want[r[0]] = (r[0], r[1], want[r[0]][2] if r[0] in want else r[2], r[3])
        merge.merge_batch(spark.createDataFrame(rows, ROW), n, target, "k", ["price"], ("updated_at", "price"), part_rows=4_000)
    schema = spark.createDataFrame([], ROW).schema
    got = {r["k"]: tuple(r) for r in merge.read_merged(spark, target, schema, "k").collect()}
    assert got == want
    assert os.listdir(f"{target}/base=0") == ["parts=5"]  # parts by the table's size
    assert _size(f"{target}/delta=3") < 0.05 * _size(f"{target}/base=0") and merge._numbers(spark, target, "base") == [0]
    # the last batch again, from the state before it
    merge.merge_batch(spark.createDataFrame(batches[3], ROW), 3, target, "k", ["price"], ("updated_at", "price"), part_rows=4_000)
    assert {r["k"]: tuple(r) for r in merge.read_merged(spark, target, schema, "k").collect()} == want
    # a large batch makes a new base with more parts, and may be run again as well
    large = [(i, 2.0, at, at + dt.timedelta(days=9)) for i in range(15_000, 60_000)]
    for _ in range(2):
        merge.merge_batch(spark.createDataFrame(large, ROW), 4, target, "k", ["price"], ("updated_at", "price"), part_rows=4_000)
        assert merge._numbers(spark, target, "base") == [0, 4] and os.listdir(f"{target}/base=4") == ["parts=15"]
        out = merge.read_merged(spark, target, schema, "k")
        assert out.count() == 60_000 and out.where("price = 2.0").count() == 45_000


def test_merged_rows_of_unknown_time(spark, tmp_path):
    target, at, schema = str(tmp_path / "t"), dt.datetime(2026, 1, 1), spark.createDataFrame([], ROW).schema
    merge.merge_batch(spark.createDataFrame([(1, 1.0, at, None), (2, 2.0, at, at)], ROW), 0, target, "k", ["price"])
    merge.merge_batch(spark.createDataFrame([(1, 3.0, at, at), (2, 9.0, at, None), (3, 4.0, None, None)], ROW), 1, target, "k", ["price"])
    merge.merge_batch(spark.createDataFrame([], ROW), 2, target, "k", ["price"])
    assert {r["k"]: r["price"] for r in merge.read_merged(spark, target, schema, "k").collect()} == {1: 3.0, 2: 2.0, 3: 4.0}
    assert {r["k"] for r in merge.read_merged(spark, target, schema, "k", before=1).collect()} == {1, 2}
