"""Keyed state with values, maps and lists: the whole board of a tender, and its deadline, as stateful operators with event time.

A tender's events are folded one after another into its state; only those that the watermark has not passed wait, in order, in a list.
So the state of a tender is its status, assignee and labels and the few events inside the watermark, however long its history, and events may come
in any order within the watermark.  What the waiting events would do is part of every answer, so answers are as fresh as the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import board

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BOARD_ROW = "tender_id long, status string, updated_at timestamp, assignee string, changes int, labels array<string>, waiting int"
BOARD_EVENTS = ("tender_id", "event_id", "ts", "kind", "value", "force")


def use_state_store(spark: SparkSession) -> None:
    """Keyed state with several variables lives in RocksDB; the setting holds for streams that start later."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def fold(state: dict, event: tuple) -> None:
    """One event (microseconds, event_id, kind, value, force) on a tender's state: status, at, assignee, changes, labels by key."""
    at, _, kind, value, force = event
    value = value or ""
    if kind == "status":
        if value == state["status"]:
            state["at"] = at
        elif value in board.STATUSES and (force or value in board.ALLOWED[state["status"]]):
            state["status"], state["at"] = value, at
    elif kind in ("assign", "unassign"):
        who = value if kind == "assign" else ""
        state["changes"] += who != state["assignee"]
        state["assignee"] = who
    elif kind in ("label_add", "label_remove"):
        key = " ".join(value.split()).lower()
        if kind == "label_remove":
            state["labels"].pop(key, None)
        elif key:
            state["labels"].setdefault(key, value.strip())


class BoardProcessor(StatefulProcessor):
    """State of a tender: what its past events made of it (value), its labels (map), and the events inside the watermark (list)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.made = handle.getValueState("made", "status string, at long, assignee string, changes int")
        self.labels = handle.getMapState("labels", "key string", "label string")
        self.waiting = handle.getListState("waiting", "at long, event_id long, kind string, value string, force boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        made = self.made.get() if self.made.exists() else ("new", None, "", 0)
        state = dict(zip(("status", "at", "assignee", "changes"), made, strict=True)) | {"labels": {k[0]: v[0] for k, v in self.labels.iterator()} if self.labels.exists() else {}}
        events = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        for df in rows:
            at = df["ts"].to_numpy().astype("datetime64[us]").astype("int64")
            events += list(zip(at.tolist(), df["event_id"].tolist(), df["kind"].tolist(), df["value"].tolist(), map(bool, df["force"]), strict=True))
        events.sort(key=lambda e: e[:2])
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        before = dict(state["labels"])
        done = next((i for i, e in enumerate(events) if e[0] >= passed), len(events))
        for e in events[:done]:
            fold(state, e)
        if done:
            self.made.update((state["status"], state["at"], state["assignee"], state["changes"]))
            for gone in before.keys() - state["labels"].keys():
                self.labels.removeKey((gone,))
            for k, v in state["labels"].items():
                if before.get(k) != v:
                    self.labels.updateValue((k,), (v,))
        left = events[done:]
        self.waiting.put(left) if left else self.waiting.clear()
        for e in left:
            fold(state, e)
        at = pd.Timestamp(state["at"], unit="us") if state["at"] is not None else pd.NaT
        labels = sorted(state["labels"].values(), key=lambda x: (x.lower(), x))
        yield pd.DataFrame({"tender_id": [key[0]], "status": [state["status"]], "updated_at": pd.Series([at], dtype="datetime64[us]"), "assignee": [state["assignee"]], "changes": [state["changes"]], "labels": [labels], "waiting": [len(left)]})

    def close(self) -> None:
        pass


def board_state(events: DataFrame, horizon: str = "30 days") -> DataFrame:
    """Status, assignee, changes of assignee and labels of each tender that a batch has events of (BOARD_EVENTS), and how many of its events wait.

    An event that is later than the horizon behind the latest one is dropped.  Events of one instant count in the order of their ids.
    """
    use_state_store(events.sparkSession)
    keyed = events.select(*BOARD_EVENTS).withWatermark("ts", horizon).groupBy("tender_id")
    return keyed.transformWithStateInPandas(BoardProcessor(), BOARD_ROW, "Update", "EventTime")


#: Deadlines keep their state by parts of up to 2^SLOT_BITS tenders, so that calls to the state store are one a part and not one a tender.  A block of ids
#: in a row is dealt over 2^LANE_BITS parts, so that new tenders, whose ids follow one another, meet in no single part; the number of parts grows with the ids.
SLOT_BITS, LANE_BITS = 10, 6
SLOTS, LANES = 1 << SLOT_BITS, 1 << LANE_BITS
#: The part of rows without a tender's id: beyond the parts of all ids.
NO_PART = 1 << 60
DAY_US = 86_400_000_000
#: The time of what has not been said: before all times.
NEVER = -(1 << 63)
#: What a row says.
DEADLINE, STATUS = 1, 2
#: What is known of a tender, as arrays of a part: types and values of a new tender, times in microseconds.
KNOWN = {"deadline": ("long", NEVER), "said": ("long", NEVER), "active": ("boolean", "new" in board.ACTIVE), "since": ("long", NEVER), "told": ("boolean", False)}


class DeadlineProcessor(StatefulProcessor):
    """State of a part: deadline and status of its tenders by time; its timer tells when the next deadline comes near or has passed."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "slot array<int>, " + ", ".join(f"{c} array<{t}>" for c, (t, _) in KNOWN.items()))

    def _known(self) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Which slots have a tender, and the columns by slot."""
        used = np.zeros(SLOTS, bool)
        columns = {c: np.full(SLOTS, new, "int64" if t == "long" else bool) for c, (t, new) in KNOWN.items()}
        found = self.known.get() if self.known.exists() else None
        if found is not None:
            slots = np.asarray(found[0], "int64")
            used[slots] = True
            for column, values in zip(columns.values(), found[1:], strict=True):
                column[slots] = values
        return used, columns

    def _answer(self, part: int, used: np.ndarray, known: dict[str, np.ndarray], now_ms: int) -> Iterator[pd.DataFrame]:
        """What has to be said now, and the next timer."""
        now, ahead, deadline = now_ms * 1000, self.days * DAY_US, known["deadline"]
        active = known["active"] & (deadline >= now)
        near = active & (deadline <= now + ahead)
        # the first millisecond after a deadline that is near, or at which one comes near
        due = np.where(near[active], deadline[active] // 1000 + 1, -((ahead - deadline[active]) // 1000))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if due.size:
            self.handle.registerTimer(int(due.min()))
        changed = np.flatnonzero(near != known["told"])
        known["told"] = near
        slots = np.flatnonzero(used)
        self.known.update((slots.tolist(), *(column[slots].tolist() for column in known.values())))
        if changed.size:
            yield pd.DataFrame({"part": part, "slot": changed, "at": now, "action": np.where(near[changed], "near", "gone"), "deadline": deadline[changed]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        used, known = self._known()
        for df in rows:
            used[df["slot"].to_numpy()] = True
            # the last row by time counts, of one instant the largest value; what is older than the known changes nothing
            for says, value, time in ((DEADLINE, "deadline", "said"), (STATUS, "active", "since")):
                last = df[(df["says"].to_numpy() & says) > 0].sort_values(["time", value]).drop_duplicates("slot", keep="last")
                slots, times, values = (last[c].to_numpy() for c in ("slot", "time", value))
                newer = times >= known[time][slots]
                known[value][slots[newer]], known[time][slots[newer]] = values[newer], times[newer]
        yield from self._answer(key[0], used, known, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._answer(key[0], *self._known(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def deadlines(changes: DataFrame, days: int, horizon: str = "0 seconds") -> DataFrame:
    """(tender_id, at, action, deadline): ``near`` as an active tender's deadline is at most so many days away, ``gone`` as it passes or the tender leaves the active statuses.

    ``changes`` has tender_id, at, kind, deadline and value: rows of kind ``tender`` say the deadline, of kind ``both`` deadline and status, others the status.
    The clock is the watermark of ``at``; a row of unknown time says nothing.
    """
    use_state_store(changes.sparkSession)
    ident, block = F.col("tender_id"), SLOT_BITS + LANE_BITS
    part = F.shiftleft(F.shiftright(ident, block), LANE_BITS).bitwiseOR(ident.bitwiseAND(F.lit(LANES - 1)))
    slot = F.shiftright(ident, LANE_BITS).bitwiseAND(F.lit(SLOTS - 1)).cast("int")
    rows = changes.where("at is not null").withWatermark("at", horizon).select(
        F.coalesce(part, F.lit(NO_PART)).alias("part"), F.coalesce(slot, F.lit(0)).alias("slot"), "at", F.unix_micros("at").alias("time"),
        F.when(F.col("kind") == "tender", DEADLINE).when(F.col("kind") == "both", DEADLINE | STATUS).otherwise(STATUS).alias("says"),
        F.coalesce(F.unix_micros("deadline"), F.lit(NEVER)).alias("deadline"), F.coalesce(F.col("value").isin(*board.ACTIVE), F.lit(False)).alias("active"),
    )
    said = rows.groupBy("part").transformWithStateInPandas(DeadlineProcessor(days), "part long, slot long, at long, action string, deadline long", "Update", "EventTime")
    ident = F.shiftleft(F.shiftright("part", LANE_BITS), block).bitwiseOR(F.shiftleft("slot", LANE_BITS)).bitwiseOR(F.col("part").bitwiseAND(F.lit(LANES - 1)))
    return said.select(
        F.when(F.col("part") != NO_PART, ident).alias("tender_id"), F.timestamp_micros("at").alias("at"), "action",
        F.when(F.col("deadline") != NEVER, F.timestamp_micros("deadline")).alias("deadline"),
    )
