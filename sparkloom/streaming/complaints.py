"""Complaints as their events arrive: the transitions of the whole log, kept per complaint in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as t
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import complaints

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BASE = t.StructType([t.StructField("state", t.IntegerType()), t.StructField("who", t.StringType()), t.StructField("due", t.LongType()), t.StructField("n", t.LongType()), t.StructField("seq", t.LongType()), t.StructField("at", t.LongType())])
EVENT = t.StructType([t.StructField("seq", t.LongType()), t.StructField("kind", t.StringType()), t.StructField("severity", t.StringType()), t.StructField("at", t.LongType()), t.StructField("who", t.StringType())])
OUT = "complaint_id long, status string, escalated boolean, severity string, assigned_to string, sla_due_at timestamp, n_events long, overdue boolean"


class Life(StatefulProcessor):
    """Per complaint: ``base``, the outcome of events that the watermark has passed, and the later events, which may still be joined by earlier ones.

    Whenever events arrive, the later ones are applied to the base in order of seq, so the outcome does not depend on the
    order or the batches they came in; an event that comes twice is one. Those within the watermark, as far as none
    before them may come, go into the base. A timer at the deadline tells that a complaint is overdue; one long after
    the last event of a closed complaint clears its state.
    """

    def __init__(self, keep_days: int):
        self.keep = keep_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.base = handle.getValueState("base", BASE)
        self.later = handle.getListState("later", EVENT)

    @staticmethod
    def applied(base: tuple, events: list[tuple]) -> tuple:
        state, who, due, n, seq, last = base
        for number, kind, severity, at, name in events:
            state, names, renews = complaints.steps(kind, severity)[state]
            who, due = name if names and name is not None else who, complaints.due(state, at) if renews else due
            n, seq, last = n + 1, number, max(last, at)
        return state, who, due, n, seq, last

    def row(self, key: tuple, now: tuple, overdue: bool) -> pd.DataFrame:
        status, flag, severity = complaints.STATES[now[0]]
        due = pd.Timestamp(now[2], unit="us", tz="UTC") if now[2] is not None else None
        return pd.DataFrame({"complaint_id": [key[0]], "status": [status], "escalated": [flag], "severity": [severity], "assigned_to": [now[1]], "sla_due_at": pd.Series([due], dtype="datetime64[us, UTC]"), "n_events": [now[3]], "overdue": [overdue]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        base = tuple(self.base.get()) if self.base.exists() else (0, None, None, 0, -1, 0)
        events = {e[0]: tuple(e) for e in self.later.get()} if self.later.exists() else {}
        for pdf in rows:
            for event in zip(pdf["seq"].astype(int), *(pdf[c].astype(object).where(pdf[c].notna(), None) for c in ("kind", "severity", "at", "who"))):
                if event[0] > base[4]:
                    events[event[0]] = (int(event[0]), event[1], event[2], int(event[3]), event[4])
        ordered = [events[seq] for seq in sorted(events)]
        passed, done = timerValues.getCurrentWatermarkInMs() * 1000, 0
        while done < len(ordered) and ordered[done][3] < passed:
            done += 1
        if done:
            base = self.applied(base, ordered[:done])
            self.base.update(base)
        self.later.put(ordered[done:]) if ordered[done:] else self.later.clear()
        now = self.applied(base, ordered[done:])
        over = complaints.STATES[now[0]][0] in (None, "closed")
        at, reached = now[5] // 1000 + self.keep if over else now[2] // 1000, timerValues.getCurrentWatermarkInMs()
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at > reached:
            self.handle.registerTimer(at)
        yield self.row(key, now, not over and at <= reached)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        base = tuple(self.base.get()) if self.base.exists() else (0, None, None, 0, -1, 0)
        now = self.applied(base, [tuple(e) for e in self.later.get()] if self.later.exists() else [])
        if complaints.STATES[now[0]][0] in (None, "closed"):
            self.base.clear()
            self.later.clear()
        else:
            yield self.row(key, now, True)

    def close(self) -> None:
        pass


def complaint_states(events: DataFrame, pool: list[str], late: str = "30 days", keep_days: int = 180) -> DataFrame:
    """(complaint_id, status, escalated, severity, assigned_to, sla_due_at, n_events, overdue) whenever a complaint changes or its deadline passes.

    ``events`` is a stream of (complaint_id, seq, kind, severity, at, actor), seq from 0. Events may come in any order and more
    than once, ``late`` behind the newest at most; older ones are dropped. The state store must be RocksDB.
    """
    stream = events.where("complaint_id IS NOT NULL AND seq IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    rows = stream.select("complaint_id", "seq", "kind", "severity", "at", complaints.assignee(pool).alias("who"))
    rows = rows.selectExpr("complaint_id", "seq", "kind", "severity", "unix_micros(at) AS at", "who", "at AS event_time")
    return rows.groupBy("complaint_id").transformWithStateInPandas(Life(keep_days), OUT, "Update", "EventTime")
