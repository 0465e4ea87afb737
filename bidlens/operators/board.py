"""The status board as a fold over events: transitions, assignees, labels.

A transition depends on the last accepted status, so it is a fold and not a window.  With
nine statuses a stretch of events is a small function from status to status; stretches are
folded apart by a higher-order function and then chained.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Statuses, the active ones, allowed transitions, display names.
STATUSES = ("new", "reviewing", "participating", "docs_preparation", "submitted", "waiting_result", "won", "lost", "skipped")
ACTIVE = ("reviewing", "participating", "docs_preparation", "submitted", "waiting_result")
ALLOWED = {
    "new": ("reviewing", "skipped"),
    "reviewing": ("participating", "skipped"),
    "participating": ("reviewing", "docs_preparation", "skipped"),
    "docs_preparation": ("participating", "submitted", "skipped"),
    "submitted": ("waiting_result", "skipped"),
    "waiting_result": ("submitted", "won", "lost"),
    "won": (),
    "lost": ("reviewing",),
    "skipped": ("reviewing",),
}
_STATE = "struct<status:string,updated_at:timestamp_ntz,moves:int>"
_ENTRY = "struct<event_id:bigint,ts:timestamp_ntz,old:string,new:string>"


def _allowed(old: Column, new: Column) -> Column:
    pairs = [f"{a}>{b}" for a, bs in ALLOWED.items() for b in bs]
    return F.concat(old, F.lit(">"), new).isin(*pairs)


def _moves(status: Column, e: Column) -> Column:
    return e["value"].isin(*STATUSES) & (e["value"] != status) & (e["force"] | _allowed(status, e["value"]))


def _start(status: Column) -> Column:
    return F.struct(status.alias("status"), F.lit(None).cast("timestamp_ntz").alias("updated_at"), F.lit(0).alias("moves")).cast(_STATE)


def _fold(events: Column, status: Column) -> Column:
    """State after events from a status; updated_at is null while nothing touched it."""

    def step(state: Column, e: Column) -> Column:
        moves = _moves(state["status"], e)
        moved = F.struct(e["value"].alias("status"), e["ts"].alias("updated_at"), (state["moves"] + 1).alias("moves")).cast(_STATE)
        fresh = F.struct(state["status"].alias("status"), e["ts"].alias("updated_at"), state["moves"].alias("moves")).cast(_STATE)
        return F.when(moves, moved).when(e["value"] == state["status"], fresh).otherwise(state)

    return F.aggregate(events, _start(status), step)


def _segments(events: DataFrame, span: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value", "force")))
    return events.groupBy("tender_id", F.date_trunc(span, "ts").cast("timestamp_ntz").alias("segment")).agg(ordered.alias("events"))


def _chained(segments: DataFrame) -> DataFrame:
    """Per tender the state at the end and the status at which each segment starts.

    A segment is a function of the status it starts from, and there are nine: it is folded from each of
    them, and the functions are chained.  So no array holds all events of a tender.
    """
    ends = segments.select("tender_id", "segment", F.array(*[_fold(F.col("events"), F.lit(s)) for s in STATUSES]).alias("ends"))
    names = F.array(*[F.lit(s) for s in STATUSES])
    start = F.struct(_start(F.lit("new")).alias("state"), F.array().cast("array<struct<segment:timestamp_ntz,status:string>>").alias("starts"))

    def link(acc: Column, x: Column) -> Column:
        end = F.element_at(x["ends"], F.array_position(names, acc["state"]["status"]).cast("int"))
        state = F.struct(end["status"].alias("status"), F.coalesce(end["updated_at"], acc["state"]["updated_at"]).alias("updated_at"), (acc["state"]["moves"] + end["moves"]).alias("moves")).cast(_STATE)
        return F.struct(state.alias("state"), F.concat(acc["starts"], F.array(F.struct(x["segment"].alias("segment"), acc["state"]["status"].alias("status")))).alias("starts"))

    chain = ends.groupBy("tender_id").agg(F.array_sort(F.collect_list(F.struct("segment", "ends"))).alias("segments"))
    return chain.select("tender_id", F.aggregate("segments", start, link).alias("a"))


def replay_status(events: DataFrame, span: str = "day") -> DataFrame:
    """Per tender: status, updated_at and the number of accepted moves, from its status events (tender_id, event_id, ts, value, force).

    The same status again only refreshes the time; a transition that is not allowed and not forced is ignored.
    """
    return _chained(_segments(events, span)).select("tender_id", "a.state.*")


def status_history(events: DataFrame, span: str = "day") -> DataFrame:
    """Accepted moves (tender_id, event_id, ts, old, new): each segment is folded again from the status it starts at."""
    segments = _segments(events, span)
    starts = _chained(segments).select("tender_id", F.explode("a.starts").alias("s")).select("tender_id", "s.segment", "s.status")
    none = F.struct(F.col("status").alias("status"), F.array().cast(f"array<{_ENTRY}>").alias("moves"))

    def step(acc: Column, e: Column) -> Column:
        entry = F.array(F.struct(e["event_id"].alias("event_id"), e["ts"].alias("ts"), acc["status"].alias("old"), e["value"].alias("new")).cast(_ENTRY))
        return F.when(_moves(acc["status"], e), F.struct(e["value"].alias("status"), F.concat(acc["moves"], entry).alias("moves"))).otherwise(acc)

    joined = segments.join(starts, ["tender_id", "segment"])
    return joined.select("tender_id", F.explode(F.aggregate("events", none, step)["moves"]).alias("m")).select("tender_id", "m.*")


def assignees(events: DataFrame) -> DataFrame:
    """Per tender its last assignee ('' when unassigned) and the number of changes."""
    who = F.when(F.col("kind") == "assign", F.col("value")).otherwise("")
    w = Window.partitionBy("tender_id").orderBy("ts", "event_id")
    steps = events.where("kind in ('assign', 'unassign')").select("tender_id", "ts", "event_id", who.alias("who"), F.coalesce(F.lag(who).over(w), F.lit("")).alias("was"))
    return steps.groupBy("tender_id").agg(F.max_by("who", F.struct("ts", "event_id")).alias("assignee"), F.count_if(F.col("who") != F.col("was")).alias("changes"))


def label_key(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def labels(events: DataFrame) -> DataFrame:
    """Current labels (tender_id, label): the last event of a label adds it; the spelling is that of the first add since it was gone."""
    rows = events.where("kind in ('label_add', 'label_remove')").select("tender_id", "ts", "event_id", "kind", F.trim("value").alias("label"), label_key(F.col("value")).alias("key"))
    by = Window.partitionBy("tender_id", "key").orderBy("ts", "event_id")
    spans = rows.withColumn("span", F.count_if(F.col("kind") == "label_remove").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    each = spans.groupBy("tender_id", "key", "span").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("kind"), F.min_by("label", F.struct(F.col("kind") == "label_remove", "ts", "event_id")).alias("label"))
    last = each.groupBy("tender_id", "key").agg(F.max_by(F.struct("kind", "label"), "span").alias("x"))
    return last.where("x.kind = 'label_add'").select("tender_id", "x.label")


def board(tenders: DataFrame, current: DataFrame, labels: DataFrame, assignees: DataFrame | None = None) -> DataFrame:
    """Tenders with status ('new' without an entry), assignee and labels, in board order: deadline, unknown ones last, then id.

    The labels of a tender are one array in the order of their lower-case form.
    """
    low = F.array_sort(F.collect_list(F.struct(F.lower("label").alias("low"), "label")))
    by_tender = labels.groupBy("tender_id").agg(F.transform(low, lambda x: x["label"]).alias("labels"))
    rows = tenders.join(current.select("tender_id", "status"), "tender_id", "left").join(by_tender, "tender_id", "left")
    rows = rows.join(assignees.select("tender_id", "assignee"), "tender_id", "left") if assignees is not None else rows.withColumn("assignee", F.lit(""))
    filled = {"status": F.coalesce("status", F.lit("new")), "labels": F.coalesce("labels", F.array().cast("array<string>")), "assignee": F.coalesce("assignee", F.lit(""))}
    return rows.withColumns(filled).orderBy(F.col("deadline").asc_nulls_last(), "tender_id")


def next_statuses(status: Column) -> Column:
    """Allowed next statuses in board order."""
    by = F.create_map(*[x for a, bs in ALLOWED.items() for x in (F.lit(a), F.array(*[F.lit(b) for b in sorted(bs, key=STATUSES.index)]).cast("array<string>"))])
    return by[status]


# Display names of statuses, and the words of commands.
STATUS_NAMES = {
    "new": "Новый", "reviewing": "Проверить", "participating": "Участвуем", "docs_preparation": "Документы", "submitted": "Подано", "waiting_result": "Ожидание результата", "won": "Победа",
    "lost": "Проигрыш", "skipped": "Пропускаем",
}
VERBS = {"/crm_status": "status", "/статус_тендера": "status", "/assign": "assign", "/ответственный": "assign", "/label": "label_add", "/метка": "label_add"}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for item in pairs.items() for x in item])


def status_code(said: Column) -> Column:
    """The status that a code or a display name stands for, in any case; null for anything else."""
    known = {s: s for s in STATUSES} | {name.lower(): s for s, name in STATUS_NAMES.items()}
    return _map(known)[F.lower(F.trim(said))]


def commands(messages: DataFrame, tenders: DataFrame) -> DataFrame:
    """Typed board events out of message texts and button payloads: (message_id, kind, tender_id, value, force, reject).

    ``messages`` has message_id, text and payload, of which one is null.  ``/crm_status``, ``/assign`` and ``/label``, or their other names, take a
    positive id and a value, a status by code or display name.  The payload ``crm:participate:platform:external_id`` finds its tender by natural
    key and forces the move to participating; ``crm:status:id:status`` moves like the command.  What is no command has no row; a command that cannot be carried out has
    ``reject``: usage, id, status, value or tender.
    """
    shape = r"(?sU)^\s*(\S+)(?:\s+(\S+)(?:\s+(.*))?)?$"
    part = lambda i: F.regexp_extract("text", shape, i)
    typed = messages.where("text is not null").select("message_id", _map(VERBS)[F.lower(part(1))].alias("kind"), part(2).alias("id"), F.trim(F.regexp_replace(part(3), r"(?U)^\s+|\s+$", "")).alias("said"))
    typed = typed.where("kind is not null").select("message_id", "kind", "id", "said", F.when((F.col("id") == "") | (F.col("said") == ""), "usage").alias("early"), F.lit(None).cast("string").alias("natural"))
    fields = F.split("payload", ":")
    pressed = messages.where("payload is not null").withColumn("f", fields)
    joins = pressed.where("f[0] = 'crm' and f[1] = 'participate' and size(f) >= 4")
    joins = joins.select("message_id", F.lit("status").alias("kind"), F.lit(None).cast("string").alias("id"), F.lit("participating").alias("said"), F.lit(None).cast("string").alias("early"), F.concat_ws(":", F.trim(F.get("f", 2)), F.trim(F.array_join(F.slice("f", F.lit(4), F.size("f")), ":"))).alias("natural"))
    joins = joins.where(~F.startswith("natural", F.lit(":")) & ~F.endswith("natural", F.lit(":")))
    moves = pressed.where("size(f) = 4 and f[0] = 'crm' and f[1] = 'status'").select("message_id", F.lit("status").alias("kind"), F.get("f", 2).alias("id"), F.get("f", 3).alias("said"), F.lit(None).cast("string").alias("early"), F.lit(None).cast("string").alias("natural"))
    rows = typed.unionByName(joins).unionByName(moves)
    known = tenders.select("tender_id", F.concat_ws(":", "platform", "external_id").alias("natural"))
    by_key = rows.where("natural is not null").join(known, "natural", "left").select("message_id", "kind", "said", "early", "tender_id", F.lit(True).alias("force"), F.col("tender_id").isNotNull().alias("found"), F.lit(True).alias("id_ok"))
    number = F.when(F.rlike("id", F.lit(r"^[1-9]\d*$")), F.col("id").try_cast("bigint"))
    by_id = rows.where("natural is null").withColumn("tender_id", number).join(known.select("tender_id", F.lit(True).alias("found")), "tender_id", "left")
    by_id = by_id.select("message_id", "kind", "said", "early", "tender_id", F.lit(False).alias("force"), F.coalesce("found", F.lit(False)).alias("found"), F.col("tender_id").isNotNull().alias("id_ok"))
    value = F.when(F.col("kind") == "status", status_code(F.col("said"))).otherwise(F.nullif(F.col("said"), F.lit("")))
    reject = F.coalesce("early", F.when(~F.col("id_ok"), "id").when(value.isNull(), F.when(F.col("kind") == "status", "status").otherwise("value")).when(~F.col("found"), "tender"))
    return by_key.unionByName(by_id).select("message_id", "kind", "tender_id", value.alias("value"), "force", reject.alias("reject"))
