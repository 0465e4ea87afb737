"""Streaming queries over the given tables, run to the end of what is there; each equals its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import state as s
from ..sources.scratch import new_path
from ..sources.tables import NOW_SPARK, NOW_SQL, as_board_events, items, table
from ..streaming import jobs, keyed, merge
from .registry import query
from .state import _FOLD, _LABELS, _status_kinds


def _stream(spark, sf_dir, name):
    """A stream of a table; the bracket makes the path a pattern, which files and folders both match."""
    return jobs.source(spark, f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet", table(spark, sf_dir, name).schema)


def _finish(stream, spark, tag: str, mode: str = "append"):
    """Run to the end of the input and return what was written."""
    out = new_path(spark, tag)

    def write(df, batch_id):
        df.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/b={batch_id}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", new_path(spark, f"{tag}-log")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("stream_upsert", "SELECT o_custkey AS k, arg_max(o_totalprice, (o_orderdate, o_totalprice)) AS price FROM orders GROUP BY 1")
def stream_upsert(spark, sf_dir):
    target = new_path(spark, "upsert")
    at = F.col("o_orderdate").alias("updated_at")
    rows = _stream(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("first_seen_at"), at)
    jobs.upsert_stream(rows, target, "k", ["price"], new_path(spark, "upsert-log"), ("updated_at", "price")).awaitTermination()
    return jobs.read_upserted(spark, target, rows.schema).select("k", "price")


@query("stream_alerts", "SELECT DISTINCT user_id AS tender_id, event_type AS event_key FROM events")
def stream_alerts(spark, sf_dir):
    events = _stream(spark, sf_dir, "events")
    alerts = events.select(F.col("user_id").alias("tender_id"), F.col("event_type").alias("event_key"), F.lit("telegram").alias("channel"), F.lit("r").alias("recipient_key"), F.col("ts").cast("timestamp").alias("sent_at"))
    return _finish(jobs.alert_once(alerts, horizon="3650 days"), spark, "alerts").select("tender_id", "event_key")


_DAYS = "CASE platform WHEN 'tmk' THEN 700 ELSE 60 END"
#: Orders of two platforms; every thirteenth is of unknown date.
_LATE = "o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'tmk' ELSE 'eis' END AS platform, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate END AS published_at"
_LATE_SQL = f"WITH l AS (SELECT {_LATE} FROM orders), d AS (SELECT *, published_at IS NULL OR date_diff('second', published_at, {NOW_SQL}) <= ({_DAYS}) * 86400 AS fresh, date_diff('second', published_at, {NOW_SQL}) - ({_DAYS}) * 86400 AS delay FROM l)"


def _late_rows(spark, sf_dir):
    return _stream(spark, sf_dir, "orders").selectExpr(*items(_LATE)).withColumn("published_at", F.col("published_at").cast("timestamp"))


@query("stream_late_drop", f"{_LATE_SQL} SELECT o_orderkey FROM d WHERE fresh")
def stream_late_drop(spark, sf_dir):
    return _finish(jobs.drop_late(_late_rows(spark, sf_dir), F.expr(NOW_SPARK).cast("timestamp"), F.expr(_DAYS)), spark, "late").select("o_orderkey")


@query("stream_late_split", f"{_LATE_SQL} SELECT platform, count(*) AS n, count(*) FILTER (WHERE fresh) AS kept, count(*) FILTER (WHERE NOT fresh) AS late, max(CASE WHEN NOT fresh THEN delay END) AS longest_delay FROM d GROUP BY 1")
def stream_late_split(spark, sf_dir):
    """Kept and late rows of each platform, from the two outputs of one stream."""
    target = new_path(spark, "late-split")
    jobs.split_late(_late_rows(spark, sf_dir), F.expr(NOW_SPARK).cast("timestamp"), F.expr(_DAYS), target, new_path(spark, "late-split-log")).awaitTermination()
    kept, late = spark.read.parquet(f"{target}/kept").select("platform", F.lit(None).cast("long").alias("delay")), spark.read.parquet(f"{target}/late").select("platform", F.col("delay_seconds").cast("long").alias("delay"))
    both = kept.withColumn("fresh", F.lit(True)).unionByName(late.withColumn("fresh", F.lit(False)))
    return both.groupBy("platform").agg(F.count("*").alias("n"), F.count_if(F.col("fresh")).alias("kept"), F.count_if(~F.col("fresh")).alias("late"), F.max("delay").alias("longest_delay"))


@query("stream_merge", "SELECT o_custkey AS k, arg_max(o_totalprice, (o_orderdate, o_totalprice)) AS price FROM orders GROUP BY 1")
def stream_merge(spark, sf_dir):
    """The same table as stream_upsert, from deltas that are merged when read."""
    target = new_path(spark, "merge")
    rows = _stream(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("first_seen_at"), F.col("o_orderdate").alias("updated_at"))
    merge.merge_stream(rows, target, "k", ["price"], new_path(spark, "merge-log"), ("updated_at", "price")).awaitTermination()
    return merge.read_merged(spark, target, rows.schema, "k").select("k", "price")


@query("stream_board", f"{_FOLD} SELECT tender_id, status FROM cur")
def stream_board(spark, sf_dir):
    events = _status_kinds(_stream(spark, sf_dir, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    written = _finish(jobs.board_stream(events.select("tender_id", "event_id", "ts", "value", "force")), spark, "board", "update")
    return s.last_wins(written, ["tender_id"], [F.col("batch")]).select("tender_id", "status")


#: All events of the tables lie within it, so that files may come in any order.
_HORIZON = "3650 days"


def _board_state(spark, sf_dir, kinds: tuple[str, ...]):
    """The last answer of each tender."""
    events = as_board_events(_stream(spark, sf_dir, "events")).where(F.col("kind").isin(*kinds)).withColumn("ts", F.col("ts").cast("timestamp"))
    written = _finish(keyed.board_state(events, _HORIZON), spark, "board-state", "update")
    return s.last_wins(written, ["tender_id"], [F.col("batch")])


@query(
    "stream_board_state",
    f"""{_FOLD}, {_LABELS}, asg AS (SELECT *, CASE WHEN kind = 'assign' THEN value ELSE '' END AS who FROM ev WHERE kind IN ('assign', 'unassign')),
    was AS (SELECT *, coalesce(lag(who) OVER (PARTITION BY tender_id ORDER BY ts, event_id), '') AS was FROM asg), ag AS (SELECT tender_id, arg_max(who, (ts, event_id)) AS assignee, count(*) FILTER (WHERE who <> was) AS changes FROM was GROUP BY 1)
    SELECT e.tender_id, coalesce(status, 'new') AS status, coalesce(assignee, '') AS assignee, coalesce(changes, 0)::INT AS changes, coalesce(labels, '') AS labels FROM (SELECT DISTINCT tender_id FROM ev) e
    LEFT JOIN cur ON e.tender_id = cur.tender_id LEFT JOIN ag ON e.tender_id = ag.tender_id LEFT JOIN ls ON e.tender_id = ls.tender_id""",
)
def stream_board_state(spark, sf_dir):
    """Status, assignee and labels of a tender as one keyed state."""
    found = _board_state(spark, sf_dir, ("status", "assign", "unassign", "label_add", "label_remove"))
    return found.select("tender_id", "status", "assignee", "changes", F.array_join("labels", ",").alias("labels"))


#: The last order of a customer says its deadline; a third of the customers have left the active statuses.
_NEAR_DAYS = 60
_DUE = "o_custkey AS tender_id, o_orderdate + {seconds} AS told, o_orderdate + {days}(CAST(o_orderkey % 400 AS INT)) AS deadline, CASE WHEN o_custkey % 3 = 0 THEN 'won' ELSE 'reviewing' END AS value"


@query(
    "stream_deadlines",
    f"""WITH d AS (SELECT {_DUE.format(seconds="to_milliseconds(o_orderkey)", days="to_days")} FROM orders), w AS (SELECT max(told) AS now FROM d), t AS (SELECT tender_id, arg_max(deadline, told) AS deadline, arg_max(value, told) AS value FROM d GROUP BY 1)
    SELECT tender_id, deadline FROM t, w WHERE value = 'reviewing' AND deadline >= now AND deadline <= now + INTERVAL {_NEAR_DAYS} DAY""",
)
def stream_deadlines(spark, sf_dir):
    """What has come near by the end of the input, by timers: the rows that upcoming_deadlines would give at that time."""
    orders = jobs.source(spark, f"{sf_dir}/order[s].parquet", table(spark, sf_dir, "orders").schema, maxFilesPerTrigger="1000000")
    rows = orders.selectExpr(*items(_DUE.format(seconds="make_dt_interval(0, 0, 0, CAST(o_orderkey / 1000 AS DECIMAL(18, 6)))", days="make_dt_interval")))
    utc = {"at": F.col("told").cast("timestamp"), "deadline": F.col("deadline").cast("timestamp")}
    said = rows.withColumns(utc).withColumn("kind", F.lit("both"))
    written = _finish(keyed.deadlines(said, _NEAR_DAYS), spark, "deadlines", "update")
    last = s.last_wins(written, ["tender_id"], [F.col("at"), F.col("batch")])
    return last.where("action = 'near'").select("tender_id", F.col("deadline").cast("timestamp_ntz").alias("deadline"))
