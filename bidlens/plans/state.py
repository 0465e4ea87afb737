"""Queries on history, deliveries and the status board."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import board as b
from ..operators import requests as rq
from ..operators import state as s
from ..sources.tables import BOARD_SQL, NOW_SPARK, NOW_SQL, VERSIONS_SQL, WITH, analyses, as_board_events, board_events, items, table, tenders, versions
from .registry import query



@query("dedup_first", "SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1")
def dedup_first(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    return s.first_wins(rows, ["l_partkey"], [F.col("l_orderkey"), F.col("l_linenumber")])


@query("dedup_last", "SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC) = 1")
def dedup_last(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    return s.last_wins(rows, ["l_partkey"], [F.col("l_orderkey"), F.col("l_linenumber")])


_DIFF = " ".join(f"CASE WHEN {c} IS DISTINCT FROM lag({c}) OVER w THEN '{c}' END," for c in ("price", "title", "region")).rstrip(",")


@query(
    "version_diff",
    f"""WITH v AS ({VERSIONS_SQL}), d AS (SELECT tender_id, seq, lag(seq) OVER w AS before, [{_DIFF}] AS f FROM v WINDOW w AS (PARTITION BY tender_id ORDER BY seq, price))
    SELECT tender_id, seq, array_to_string(list_filter(f, lambda x: x IS NOT NULL), ',') AS changed_fields FROM d WHERE before IS NOT NULL AND len(list_filter(f, lambda x: x IS NOT NULL)) > 0""",
)
def version_diff(spark, sf_dir):
    out = s.version_diff(versions(spark, sf_dir), "tender_id", ["seq", "price"], ["price", "title", "region"])
    return out.withColumn("changed_fields", F.array_join("changed_fields", ","))


_OLD = "tender_id % 3 <> 0"
_NEW = "tender_id % 3 <> 1"
_PATCH = "CASE WHEN tender_id % 2 = 0 THEN price + 1 ELSE price END"


def _old_new(spark, sf_dir):
    cols = ["tender_id", "title", "price", "deadline", "first_seen_at", "updated_at"]
    rows = tenders(spark, sf_dir).select(*cols)
    new = rows.where(_NEW).withColumns({"price": F.expr(_PATCH), "first_seen_at": F.expr(NOW_SPARK), "updated_at": F.expr(NOW_SPARK)})
    return rows.where(_OLD), new


@query("new_flag", f"{WITH} SELECT tender_id, tender_id % 3 = 0 AS is_new FROM tenders WHERE {_NEW}")
def new_flag(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return new.join(old.select("tender_id", F.lit(True).alias("known")), "tender_id", "left").select("tender_id", F.col("known").isNull().alias("is_new"))


@query(
    "upsert_tenders",
    f"""{WITH} SELECT tender_id, title, CASE WHEN {_NEW} THEN {_PATCH} ELSE price END AS price, deadline, CASE WHEN {_OLD} THEN first_seen_at ELSE {NOW_SQL} END AS first_seen_at,
    CASE WHEN {_NEW} THEN {NOW_SQL} ELSE updated_at END AS updated_at FROM tenders""",
)
def upsert_tenders(spark, sf_dir):
    return s.upsert(*_old_new(spark, sf_dir), "tender_id")


@query(
    "change_events",
    f"""{WITH} SELECT tender_id, CASE WHEN tender_id % 3 = 0 THEN 'created' ELSE 'updated' END AS event_type, CASE WHEN tender_id % 3 = 0 THEN '' ELSE 'price' END AS changed_fields
    FROM tenders WHERE {_NEW} AND (tender_id % 3 = 0 OR (tender_id % 2 = 0 AND price IS NOT NULL))""",
)
def change_events(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return s.change_events(old, new, "tender_id", ["title", "price", "deadline"]).withColumn("changed_fields", F.array_join("changed_fields", ","))


@query("latest_analysis", "SELECT l_orderkey AS tender_id, l_quantity AS score FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_quantity DESC) = 1")
def latest_analysis(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tender_id"), F.col("l_quantity").alias("score"), "l_shipdate", "l_linenumber", "l_partkey")
    return s.last_wins(rows, ["tender_id"], [F.col(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "score")]).select("tender_id", "score")


_KEY = ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in s.FINGERPRINT)


@query("fingerprint", f"{WITH} SELECT tender_id, sha256(concat_ws(chr(31), {_KEY})) AS event_key FROM tenders")
def fingerprint(spark, sf_dir):
    return tenders(spark, sf_dir).select("tender_id", s.event_key().alias("event_key"))


def _deliveries(spark, sf_dir):
    """Every fourth tender was delivered to one recipient, at its state or at an older price."""
    rows = tenders(spark, sf_dir).where("tender_id % 4 = 0").withColumn("price", F.expr("CASE WHEN tender_id % 8 = 0 THEN price ELSE price + 1 END"))
    return rows.select("tender_id", s.event_key().alias("event_key"), F.lit("telegram").alias("channel"), F.expr("concat('r', CAST(tender_id % 3 AS STRING))").alias("recipient_key"), F.col("first_seen_at").alias("sent_at"))


def _alerts(spark, sf_dir):
    rows = tenders(spark, sf_dir).select("tender_id", s.event_key().alias("event_key"), F.lit("telegram").alias("channel"), F.explode(F.array(F.lit("r0"), F.lit("r1"))).alias("recipient_key"))
    return rows.withColumn("sent_at", F.expr(NOW_SPARK))


_DELIVERED = "(tender_id % 4 = 0 AND concat('r', CAST(tender_id % 3 AS VARCHAR)) = r AND (tender_id % 8 = 0 OR price IS NULL))"


@query("undelivered", f"{WITH} SELECT tender_id, r AS recipient_key FROM tenders, (VALUES ('r0'), ('r1')) v(r) WHERE NOT {_DELIVERED}")
def undelivered(spark, sf_dir):
    return s.undelivered(_alerts(spark, sf_dir), _deliveries(spark, sf_dir)).select("tender_id", "recipient_key")


@query(
    "mark_delivered",
    f"""{WITH} SELECT recipient_key, count(DISTINCT (tender_id, same)) AS n, max(sent_at) AS last FROM (SELECT tender_id, r AS recipient_key, true AS same, {NOW_SQL} AS sent_at FROM tenders, (VALUES ('r0'), ('r1')) v(r)
    UNION ALL SELECT tender_id, 'r' || CAST(tender_id % 3 AS VARCHAR), tender_id % 8 = 0 OR price IS NULL, first_seen_at FROM tenders WHERE tender_id % 4 = 0) GROUP BY 1""",
)
def mark_delivered(spark, sf_dir):
    return s.mark_delivered(_deliveries(spark, sf_dir), _alerts(spark, sf_dir)).groupBy("recipient_key").agg(F.count("*").alias("n"), F.max("sent_at").alias("last"))


@query("backfill_deliveries", f"""{WITH} SELECT count(*) AS n, count(DISTINCT tender_id) AS tenders FROM (SELECT tender_id, 'telegram' AS ch FROM tenders WHERE tender_id % 4 = 0 OR tender_id % 5 = 0)""")
def backfill_deliveries(spark, sf_dir):
    legacy = tenders(spark, sf_dir).where("tender_id % 5 = 0").select("tender_id", s.event_key().alias("event_key"), F.lit("telegram").alias("channel"), F.lit("default").alias("recipient_key"))
    have = tenders(spark, sf_dir).where("tender_id % 4 = 0").select("tender_id", s.event_key().alias("event_key"), F.lit("telegram").alias("channel"), F.lit("default").alias("recipient_key"))
    return legacy.unionByName(have).dropDuplicates(list(s.DELIVERY_KEY)).groupBy().agg(F.count("*").alias("n"), F.count_distinct("tender_id").alias("tenders"))


# --- board ----------------------------------------------------------------------------------
_RANKED = f"""WITH RECURSIVE ev AS ({BOARD_SQL}), st AS (SELECT *, row_number() OVER (PARTITION BY tender_id ORDER BY ts, event_id) AS k FROM ev WHERE kind = 'status')"""
_PAIRS = ", ".join(f"'{a}>{x}'" for a, xs in b.ALLOWED.items() for x in xs)
_MOVES = f"(st.value <> f.status AND (st.force OR concat(f.status, '>', st.value) IN ({_PAIRS})))"
_FOLD = f"""{_RANKED}, f AS (SELECT tender_id, 0::BIGINT AS k, 'new' AS status, NULL::TIMESTAMP AS updated_at, 0 AS moves FROM (SELECT DISTINCT tender_id FROM st)
  UNION ALL SELECT f.tender_id, st.k, CASE WHEN {_MOVES} THEN st.value ELSE f.status END, CASE WHEN {_MOVES} OR st.value = f.status THEN st.ts ELSE f.updated_at END, f.moves + CASE WHEN {_MOVES} THEN 1 ELSE 0 END
  FROM f JOIN st ON st.tender_id = f.tender_id AND st.k = f.k + 1),
  cur AS (SELECT tender_id, arg_max(status, k) AS status, arg_max(coalesce(updated_at, TIMESTAMP '1900-01-01'), k) AS u, max(moves) AS moves FROM f GROUP BY 1)"""


def _status_events(spark, sf_dir):
    return board_events(spark, sf_dir).where("kind = 'status'")


def _status_kinds(events):
    """Status events of a stream of the events table."""
    return as_board_events(events).where("kind = 'status'")


@query("board_replay", f"{_FOLD} SELECT tender_id, status, nullif(u, TIMESTAMP '1900-01-01') AS updated_at, moves::INT AS moves FROM cur")
def board_replay(spark, sf_dir):
    return b.replay_status(_status_events(spark, sf_dir)).select("tender_id", "status", "updated_at", "moves")


@query("board_current", f"{_FOLD} SELECT status, count(*) AS n FROM cur GROUP BY 1")
def board_current(spark, sf_dir):
    return b.replay_status(_status_events(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


@query("board_timeline", f"{_FOLD}, h AS (SELECT tender_id, k, status, lag(status) OVER (PARTITION BY tender_id ORDER BY k) AS old FROM f) SELECT h.tender_id, st.event_id, h.old, h.status AS new FROM h JOIN st ON st.tender_id = h.tender_id AND st.k = h.k WHERE h.old <> h.status")
def board_timeline(spark, sf_dir):
    return b.status_history(_status_events(spark, sf_dir)).select("tender_id", "event_id", "old", "new")


@query("board_by_status", f"{_FOLD} SELECT o_orderkey AS tender_id, coalesce(status, 'new') AS status FROM orders LEFT JOIN cur ON o_orderkey = tender_id")
def board_by_status(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tender_id"))
    return rows.join(b.replay_status(_status_events(spark, sf_dir)), "tender_id", "left").select("tender_id", F.coalesce("status", F.lit("new")).alias("status"))


_LABELS = f"""lb AS (SELECT *, lower(trim(value)) AS key, sum(CASE WHEN kind = 'label_remove' THEN 1 ELSE 0 END) OVER (PARTITION BY tender_id, lower(trim(value)) ORDER BY ts, event_id) AS span
    FROM ({BOARD_SQL}) WHERE kind IN ('label_add', 'label_remove')), lm AS (SELECT tender_id, key, max(span) AS span FROM lb GROUP BY 1, 2),
    ln AS (SELECT lb.tender_id, trim(arg_min(value, (ts, event_id))) AS label FROM lb JOIN lm ON lb.tender_id = lm.tender_id AND lb.key = lm.key AND lb.span = lm.span WHERE kind = 'label_add' GROUP BY lb.tender_id, lb.key),
    ls AS (SELECT tender_id, string_agg(label, ',' ORDER BY lower(label), label) AS labels FROM ln GROUP BY 1)"""
_TENDERS = WITH[len("WITH tenders AS (") : WITH.index("), analyses AS")]


@query(
    "board_view",
    f"""{_FOLD}, {_LABELS}, t AS ({_TENDERS}) SELECT t.tender_id, title, deadline, coalesce(cur.status, 'new') AS status, coalesce(ls.labels, '') AS labels
    FROM t LEFT JOIN cur ON t.tender_id = cur.tender_id LEFT JOIN ls ON t.tender_id = ls.tender_id""",
)
def board_view(spark, sf_dir):
    events = board_events(spark, sf_dir)
    view = b.board(tenders(spark, sf_dir), b.replay_status(events.where("kind = 'status'")), b.labels(events))
    return view.select("tender_id", "title", "deadline", "status", F.array_join("labels", ",").alias("labels"))


@query(
    "board_assignees",
    f"""WITH ev AS ({BOARD_SQL}), a AS (SELECT *, CASE WHEN kind = 'assign' THEN value ELSE '' END AS who FROM ev WHERE kind IN ('assign', 'unassign')),
    d AS (SELECT *, coalesce(lag(who) OVER (PARTITION BY tender_id ORDER BY ts, event_id), '') AS was, row_number() OVER (PARTITION BY tender_id ORDER BY ts DESC, event_id DESC) AS r FROM a)
    SELECT tender_id, max(CASE WHEN r = 1 THEN who END) AS assignee, count(*) FILTER (WHERE who <> was) AS changes FROM d GROUP BY 1""",
)
def board_assignees(spark, sf_dir):
    return b.assignees(board_events(spark, sf_dir))


@query(
    "board_labels",
    f"""WITH ev AS ({BOARD_SQL}), l AS (SELECT *, lower(trim(value)) AS key, sum(CASE WHEN kind = 'label_remove' THEN 1 ELSE 0 END) OVER (PARTITION BY tender_id, lower(trim(value)) ORDER BY ts, event_id) AS span
    FROM ev WHERE kind IN ('label_add', 'label_remove')), m AS (SELECT tender_id, key, max(span) AS span FROM l GROUP BY 1, 2)
    SELECT l.tender_id, trim(arg_min(value, (ts, event_id))) AS label FROM l JOIN m ON l.tender_id = m.tender_id AND l.key = m.key AND l.span = m.span WHERE kind = 'label_add' GROUP BY l.tender_id, l.key""",
)
def board_labels(spark, sf_dir):
    return b.labels(board_events(spark, sf_dir))


@query("label_set", f"WITH ev AS ({BOARD_SQL}) SELECT tender_id, trim(arg_min(value, event_id)) AS label FROM ev WHERE kind = 'label_add' GROUP BY tender_id, lower(trim(value))")
def label_set(spark, sf_dir):
    adds = board_events(spark, sf_dir).where("kind = 'label_add'").select("tender_id", "event_id", F.trim("value").alias("label"), b.label_key(F.col("value")).alias("key"))
    return s.first_wins(adds, ["tender_id", "key"], [F.col("event_id")]).select("tender_id", "label")


@query("board_rejects", f"WITH ev AS ({BOARD_SQL}) SELECT event_id, CASE WHEN event_id % 23 = 0 THEN 'bad_status' ELSE 'unknown_tender' END AS reason FROM ev WHERE kind = 'status' AND (event_id % 23 = 0 OR tender_id NOT IN (SELECT o_orderkey FROM orders))")
def board_rejects(spark, sf_dir):
    events = _status_events(spark, sf_dir).withColumn("value", F.expr("CASE WHEN event_id % 23 = 0 THEN 'archived' ELSE value END"))
    known = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tender_id"))
    bad = events.where(~F.col("value").isin(*b.STATUSES)).select("event_id", F.lit("bad_status").alias("reason"))
    lost = events.where(F.col("value").isin(*b.STATUSES)).join(known, "tender_id", "left_anti").select("event_id", F.lit("unknown_tender").alias("reason"))
    return bad.unionByName(lost)


@query("upcoming_deadlines", f"{_FOLD}, t AS ({WITH[len('WITH tenders AS (') : WITH.index('), analyses AS')]}) SELECT t.tender_id, deadline, status FROM t JOIN cur ON t.tender_id = cur.tender_id WHERE status IN ({', '.join(repr(x) for x in b.ACTIVE)}) AND deadline BETWEEN {NOW_SQL} AND {NOW_SQL} + INTERVAL 300 DAY")
def upcoming_deadlines(spark, sf_dir):
    soon = tenders(spark, sf_dir).where(f"deadline between {NOW_SPARK} and {NOW_SPARK} + INTERVAL 300 DAY").select("tender_id", "deadline")
    live = b.replay_status(_status_events(spark, sf_dir)).where(F.col("status").isin(*b.ACTIVE))
    return soon.join(live, "tender_id").orderBy("deadline", "tender_id").select("tender_id", "deadline", "status")


@query("board_next_statuses", f"{_FOLD} SELECT tender_id, CASE status " + " ".join(f"WHEN '{a}' THEN '{','.join(sorted(xs, key=b.STATUSES.index))}'" for a, xs in b.ALLOWED.items()) + " END AS next FROM cur")
def board_next_statuses(spark, sf_dir):
    return b.replay_status(_status_events(spark, sf_dir)).select("tender_id", F.array_join(b.next_statuses(F.col("status")), ",").alias("next"))


_COMMAND = "CASE event_id % 5 WHEN 0 THEN concat('/status ', CAST(user_id AS STRING), ' won') WHEN 1 THEN concat('/label ', CAST(user_id AS STRING), ' VIP клиент') WHEN 2 THEN '/status abc won' WHEN 3 THEN concat('/assign ', CAST(user_id AS STRING), ' Анна') ELSE 'привет' END"


@query(
    "parse_board_commands",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'status' WHEN 1 THEN 'label' WHEN 3 THEN 'assign' END AS verb, user_id AS tender_id,
    CASE event_id % 5 WHEN 0 THEN 'won' WHEN 1 THEN 'VIP клиент' ELSE 'Анна' END AS value FROM events WHERE event_id % 5 IN (0, 1, 3) AND user_id > 0""",
)
def parse_board_commands(spark, sf_dir):
    said = table(spark, sf_dir, "events").selectExpr("event_id", f"{_COMMAND} AS text")
    part = lambda i: F.regexp_extract("text", r"(?U)^/(status|label|assign)\s+(\d+)\s+(.+)$", i)
    parsed = said.select("event_id", part(1).alias("verb"), part(2).try_cast("bigint").alias("tender_id"), part(3).alias("value"))
    return parsed.where("verb <> '' and tender_id > 0")


_TEXTS = """CASE event_id % 10 WHEN 0 THEN concat('/crm_status ', CAST(event_id AS STRING), ' Победа') WHEN 1 THEN concat(' /Статус_Тендера  ', CAST(event_id AS STRING), ' WAITING_RESULT ') WHEN 2 THEN concat('/assign ', CAST(event_id AS STRING), ' Анна  Ивановна')
  WHEN 3 THEN '/метка 0 VIP' WHEN 4 THEN '/label abc VIP' WHEN 5 THEN concat('/crm_status ', CAST(event_id AS STRING), ' неизвестно') WHEN 6 THEN '/assign 5' WHEN 7 THEN 'привет /assign 5 x' END"""
_PRESSED = """CASE event_id % 20 WHEN 8 THEN concat('crm:participate:eis:', CAST(event_id AS STRING)) WHEN 18 THEN concat('crm:status:', CAST(event_id AS STRING), ':docs_preparation') WHEN 9 THEN 'crm:participate: :5' WHEN 19 THEN concat('crm:participate:tmk:no:', CAST(event_id AS STRING)) END"""
_KNOWN = "EXISTS (SELECT 1 FROM orders WHERE o_orderkey = event_id)"


@query(
    "board_commands",
    f"""SELECT event_id AS message_id, CASE WHEN event_id % 10 IN (2, 6) THEN 'assign' WHEN event_id % 10 IN (3, 4) THEN 'label_add' ELSE 'status' END AS kind,
    CASE WHEN event_id % 10 IN (3, 4) OR event_id % 20 = 19 THEN NULL WHEN event_id % 10 = 6 THEN 5 WHEN event_id % 20 = 8 THEN CASE WHEN {_KNOWN} AND event_id % 6 = 0 THEN event_id END WHEN event_id = 0 THEN NULL ELSE event_id END AS tender_id,
    CASE WHEN event_id % 10 = 0 THEN 'won' WHEN event_id % 10 = 1 THEN 'waiting_result' WHEN event_id % 10 = 2 THEN 'Анна  Ивановна' WHEN event_id % 10 IN (3, 4) THEN 'VIP' WHEN event_id % 20 IN (8, 19) THEN 'participating' WHEN event_id % 20 = 18 THEN 'docs_preparation' END AS value,
    event_id % 20 IN (8, 19) AS force, CASE WHEN event_id % 10 = 6 THEN 'usage' WHEN event_id % 10 IN (3, 4) OR event_id = 0 THEN 'id' WHEN event_id % 10 = 5 THEN 'status' WHEN event_id % 20 = 19 OR (event_id % 20 = 8 AND event_id % 6 <> 0) OR NOT {_KNOWN} THEN 'tender' END AS reject
    FROM events WHERE event_id % 10 < 7 OR event_id % 20 IN (8, 18, 19)""",
)
def board_commands(spark, sf_dir):
    """Commands and buttons of a message log as typed events; what cannot be carried out is kept with its reason."""
    said = table(spark, sf_dir, "events").selectExpr("event_id AS message_id", f"{_TEXTS} AS text", f"{_PRESSED} AS payload")
    return b.commands(said, tenders(spark, sf_dir).select("tender_id", "platform", "external_id"))


@query("tender_timeline", f"{WITH} SELECT tender_id, 'created' AS event, first_seen_at AS at FROM tenders UNION ALL SELECT tender_id, 'analysed', analyzed_at FROM analyses UNION ALL SELECT tender_id, 'updated', updated_at FROM tenders WHERE updated_at > first_seen_at")
def tender_timeline(spark, sf_dir):
    rows = tenders(spark, sf_dir)
    made = rows.select("tender_id", F.lit("created").alias("event"), F.col("first_seen_at").alias("at"))
    seen = analyses(spark, sf_dir).select("tender_id", F.lit("analysed").alias("event"), F.col("analyzed_at").alias("at"))
    late = rows.where("updated_at > first_seen_at").select("tender_id", F.lit("updated").alias("event"), F.col("updated_at").alias("at"))
    return made.unionByName(seen).unionByName(late).orderBy("tender_id", "at", "event")


# --- sources and logs -----------------------------------------------------------------------
@query("union_sources", f"{WITH} SELECT platform, count(*) AS n, count(price) AS priced FROM tenders GROUP BY 1")
def union_sources(spark, sf_dir):
    rows = tenders(spark, sf_dir)
    full, bare = rows.where("platform in ('eis', 'tmk')"), rows.where("platform not in ('eis', 'tmk')").select("tender_id", "platform", "price")
    return full.unionByName(bare, allowMissingColumns=True).groupBy("platform").agg(F.count("*").alias("n"), F.count("price").alias("priced"))


@query("source_priority", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, min(CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END) OVER (PARTITION BY o_custkey) AS best FROM orders) WHERE CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END = best")
def source_priority(spark, sf_dir):
    """Primary rows of a key where there are any, else its secondary rows."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.expr("CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END").alias("p"))
    best = rows.groupBy("o_custkey").agg(F.min("p").alias("p"))
    return rows.join(best, ["o_custkey", "p"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("missing_sources", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def missing_sources(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


_PROBE = "user_id % 50"


@query("probe_summary", f"SELECT {_PROBE} AS source, event_type AS keyword, count(*) AS n, max(value) AS slowest, count(*) FILTER (WHERE event_id % 9 = 0) AS failures, list_slice(list(event_id ORDER BY event_id), 1, 10) AS samples FROM events GROUP BY 1, 2")
def probe_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("source", F.expr(_PROBE))
    # ten smallest ids with bounded state: ranks first, so that no group is collected whole
    top = e.withColumn("k", F.row_number().over(Window.partitionBy("source", "event_type").orderBy("event_id"))).where("k <= 10")
    samples = top.groupBy("source", "event_type").agg(F.sort_array(F.collect_list("event_id")).alias("samples"))
    sums = e.groupBy("source", "event_type").agg(F.count("*").alias("n"), F.max("value").alias("slowest"), F.count_if(F.expr("event_id % 9 = 0")).alias("failures"))
    return sums.join(samples, ["source", "event_type"]).withColumnRenamed("event_type", "keyword")


_HTTP = "CASE event_id % 7 WHEN 0 THEN 403 WHEN 1 THEN 429 WHEN 2 THEN 401 WHEN 3 THEN 500 ELSE 200 END"


@query("classify_fetch", f"SELECT event_id, CASE WHEN {_HTTP} IN (401, 403, 429) THEN 'access_block' WHEN event_id % 11 = 0 THEN 'external_timeout' WHEN {_HTTP} >= 500 THEN 'error' ELSE 'ok' END AS outcome FROM events")
def classify_fetch(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"{_HTTP} AS status", "CASE WHEN event_id % 11 = 0 THEN 'Page.goto: Timeout 30000ms exceeded' ELSE '' END AS message")
    timeout = F.rlike(F.lower("message"), F.lit("timeout|timed out|err_connection"))
    return rows.select("event_id", F.when(F.col("status").isin(401, 403, 429), "access_block").when(timeout, "external_timeout").when(F.col("status") >= 500, "error").otherwise("ok").alias("outcome"))


@query("rank_requests", "SELECT url, score FROM (SELECT url, max((CASE WHEN contains(lower(url), 'en') THEN 5 ELSE 0 END) + (CASE WHEN contains(lower(url), 'feed') THEN 3 ELSE 0 END) + (CASE WHEN contains(lower(url), 'blog') THEN 2 ELSE 0 END))::INT AS score FROM pages GROUP BY url) ORDER BY score DESC, url LIMIT 40")
def rank_requests(spark, sf_dir):
    weights = {"en": 5, "feed": 3, "blog": 2}
    score = sum((F.when(F.contains(F.lower("url"), F.lit(w)), n).otherwise(0) for w, n in weights.items()), F.lit(0))
    return table(spark, sf_dir, "pages").groupBy("url").agg(F.max(score).alias("score")).orderBy(F.desc("score"), "url").limit(40)


_LOG = """event_id, CASE event_id % 3 WHEN 0 THEN 'POST' WHEN 1 THEN 'get' END AS method, concat('https://h.example/', CASE user_id % 6 WHEN 0 THEN 'API/search' WHEN 1 THEN 'market-search' WHEN 2 THEN 'tender-' WHEN 3 THEN 'graphql' WHEN 4 THEN 'feed/purchase' ELSE 'static' END, '?u=', CAST(user_id AS STRING)) AS url,
  CASE event_id % 4 WHEN 0 THEN 'xhr' WHEN 1 THEN 'document' END AS type, CASE WHEN event_id % 5 = 0 THEN event_type ELSE '' END AS post_data"""
_POINTS = " + ".join(f"CASE WHEN contains(lower(url), '{part}') THEN {weight} ELSE 0 END" for part, weight in rq.URL_WEIGHTS.items())


@query(
    "top_requests",
    f"""WITH l AS (SELECT {_LOG} FROM events), s AS (SELECT *, coalesce(method, '') AS mm, {_POINTS} + CASE WHEN upper(method) = 'POST' THEN 3 ELSE 0 END + CASE WHEN post_data <> '' THEN 2 ELSE 0 END + CASE WHEN type = 'xhr' THEN 3 ELSE 0 END AS score FROM l),
    f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY mm, url ORDER BY score DESC, event_id) = 1), p AS (SELECT *, row_number() OVER (ORDER BY score DESC, event_id) AS place FROM f)
    SELECT place::INT AS place, score::INT AS score, mm AS method, url, type, post_data FROM p WHERE place <= 40 AND score > 0""",
)
def top_requests(spark, sf_dir):
    """The forty requests of a log that most likely carry search results, each method and address once."""
    return rq.top_requests(table(spark, sf_dir, "events").selectExpr(*items(_LOG)), "event_id")


@query(
    "rename_recipient",
    f"""{WITH}, c AS (SELECT tender_id, concat('k', title) AS now FROM tenders WHERE tender_id % 11 <> 0),
    d AS (SELECT tender_id, 'old' AS event_key, 'legacy' AS recipient_key, tender_id * 2 AS delivery_id, 'a' AS payload FROM tenders WHERE tender_id % 3 = 0
      UNION ALL SELECT tender_id, 'older', 'legacy', tender_id * 2 + 1, 'b' FROM tenders WHERE tender_id % 6 = 0 UNION ALL SELECT tender_id, concat('k', title), 'default', -tender_id, 'c' FROM tenders WHERE tender_id % 4 = 0),
    n AS (SELECT d.tender_id, coalesce(now, event_key) AS event_key, 'default' AS recipient_key, delivery_id, payload FROM d LEFT JOIN c ON d.tender_id = c.tender_id WHERE recipient_key = 'legacy'),
    o AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY tender_id, event_key ORDER BY delivery_id) = 1)
    SELECT * FROM d WHERE recipient_key <> 'legacy' UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.recipient_key = 'default' AND d.tender_id = o.tender_id AND d.event_key = o.event_key)""",
)
def rename_recipient(spark, sf_dir):
    """Legacy deliveries under the recipient that took over and the tender's present fingerprint, nothing delivered twice or lost."""
    rows = tenders(spark, sf_dir)
    current = rows.where("tender_id % 11 <> 0").selectExpr("tender_id", "concat('k', title) AS event_key")
    made = lambda df, key, who, number, load: df.selectExpr("tender_id", f"{key} AS event_key", "'telegram' AS channel", f"'{who}' AS recipient_key", f"{number} AS delivery_id", f"'{load}' AS payload")
    sent = made(rows.where("tender_id % 3 = 0"), "'old'", "legacy", "tender_id * 2", "a").unionByName(made(rows.where("tender_id % 6 = 0"), "'older'", "legacy", "tender_id * 2 + 1", "b"))
    sent = sent.unionByName(made(rows.where("tender_id % 4 = 0"), "concat('k', title)", "default", "-tender_id", "c"))
    return s.rename_recipient(sent, current, "legacy", "default").drop("channel")
