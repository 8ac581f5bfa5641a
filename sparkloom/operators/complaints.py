"""The life of a complaint: one table of transitions for whole logs and for streams.

A complaint is nowhere, open, escalated or closed; it keeps the severity it was opened with, and a closed one may bear the
flag of an escalation, if somebody claimed it after. That makes thirteen states. An event is a function on them that may
also name an assignee and set the deadline anew; functions put together are such functions again. So a log is cut
into ranges, each range is summed up by what it does to each state, and the ranges of a complaint are put together in
order: the events of one complaint spread over as many tasks as there are ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules

SEVERITIES = list(rules.SLA_HOURS)
#: (status, escalated, severity)
STATES = [(None, False, None)] + [(status, flag, severity) for severity in SEVERITIES for status, flag in (("open", False), ("escalated", True), ("closed", False), ("closed", True))]
NUMBER = {state: k for k, state in enumerate(STATES)}
KINDS = ["open", "claim", "escalate", "cancel", "reopen"]


def after(state: int, kind: str, severity: str | None) -> tuple[int, bool, bool]:
    """(next state, whether the event names an assignee, whether the deadline is set anew).

    ``severity`` is that of an opening event; a complaint that exists is not opened again, and one that does not takes no other
    event. To claim raises the flag, and an open complaint is escalated by it. Cancelling closes and clears the flag. Reopening
    works on closed ones only and goes by the severity: a high one is escalated, with a new assignee. Who is not named stays.
    """
    status, flag, own = STATES[state]
    if kind == "open" and status is None or kind == "reopen" and status == "closed":
        own = own or (severity if severity in SEVERITIES else SEVERITIES[-1])
        high = own == "high"
        return NUMBER[("escalated" if high else "open", high, own)], high, True
    if status is None:
        return state, False, False
    if kind == "claim":
        return NUMBER[("escalated" if status == "open" else status, True, own)], True, False
    if kind == "escalate":
        return NUMBER[("escalated", True, own)], True, False
    if kind == "cancel":
        return NUMBER[("closed", False, own)], False, False
    return state, False, False


STEPS = {(kind, severity): [after(s, kind, severity) for s in range(len(STATES))] for kind in KINDS for severity in (*SEVERITIES, None)}
IDLE = [(s, False, False) for s in range(len(STATES))]


def steps(kind: str | None, severity: str | None) -> list[tuple[int, bool, bool]]:
    """The function of an event as a list over states; an unknown kind changes nothing."""
    return STEPS.get((kind, severity)) or STEPS.get((kind, None)) or IDLE


def due(state: int, at: int) -> int:
    """The deadline in microseconds of a complaint whose time starts at ``at``."""
    return at + rules.SLA_HOURS[STATES[state][2]] * 3_600_000_000


def assignee(pool: list[str], id_col: str = "complaint_id", seq: str = "seq", kind: str = "kind", actor: str = "actor") -> Column:
    """Who an event names: the actor of a claim or an escalation, else one of the pool by complaint and event."""
    pick = F.element_at(F.array(*map(F.lit, pool)), (F.pmod(F.col(id_col) + F.col(seq), F.lit(len(pool))) + 1).cast("int"))
    return F.when(F.col(kind) == "claim", F.col(actor)).when(F.col(kind) == "escalate", F.coalesce(F.col(actor), pick)).otherwise(pick)


def ready(events: DataFrame, pool: list[str]) -> DataFrame:
    """(complaint_id, seq, kind, severity, at in microseconds, who) of events (complaint_id, seq, kind, severity, at, actor)."""
    return events.select("complaint_id", "seq", "kind", "severity", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), assignee(pool).alias("who"))


SUMMARY = pa.struct([("to", pa.int32()), ("who", pa.string()), ("due", pa.int64())])


def ranges(events: DataFrame) -> DataFrame:
    """(complaint_id, part, n, does array<struct<to, who, due>>): what the events of a complaint in one range do to each state.

    Only the first complaint of a range can have begun before it; others begin nowhere, so one state is followed for them.
    """
    rows = events.repartitionByRange("complaint_id", "seq", "kind", "severity", "at", "who").sortWithinPartitions("complaint_id", "seq", "kind", "severity", "at", "who")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        of, n, now, kind_of_id = None, 0, None, None

        def out(done: list[tuple]) -> pa.RecordBatch:
            does = [[{"to": s, "who": who, "due": by} for s, who, by in d] for _, _, d in done]
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind_of_id), pa.array([part] * len(done), pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array(does, pa.list_(SUMMARY))], names=["complaint_id", "part", "n", "does"])

        for batch in batches:
            kind_of_id, done = batch.column(0).type, []
            for complaint, kind, severity, at, who in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5))):
                if now is None or complaint != of:
                    first = now is None
                    if not first:
                        done.append((of, n, now))
                    of, n, now = complaint, 0, [(s, None, None) for s in (range(len(STATES)) if first else range(1))]
                n += 1
                table, ended = steps(kind, severity), []
                for state, name, by in now:
                    to, names, renews = table[state]
                    ended.append((to, who if names and who is not None else name, due(to, at) if renews and at is not None else by))
                now = ended
            yield out(done)
        if now is not None:
            yield out([(of, n, now)])

    return rows.mapInArrow(run, f"complaint_id {events.schema['complaint_id'].dataType.simpleString()}, part long, n long, does array<struct<to:int,who:string,due:long>>")


def named(state: Column) -> list[Column]:
    """status, escalated and severity of a state's number."""
    pick = lambda k: F.element_at(F.array(*(F.lit(s[k]) for s in STATES)), state + 1)
    return [pick(0).alias("status"), pick(1).alias("escalated"), pick(2).alias("severity")]


def complaint_fold(events: DataFrame, pool: list[str]) -> DataFrame:
    """(complaint_id, status, escalated, severity, assigned_to, sla_due_at, n_events): the events of each complaint, applied in order of ``seq``.

    ``events`` is (complaint_id, seq, kind, severity, at, actor); see ``after`` for the rules. Events of one seq are taken by
    kind. A complaint that was never opened has a null status. Null ids are one complaint; kinds that are null or
    unknown count, but change nothing.
    """
    parts = ranges(ready(events, pool)).groupBy("complaint_id").agg(F.sum("n").alias("n_events"), F.array_sort(F.collect_list(F.struct("part", "does"))).alias("parts"))
    start = F.struct(F.lit(0).alias("to"), F.lit(None).cast("string").alias("who"), F.lit(None).cast("long").alias("due"))

    def put(state: Column, part: Column) -> Column:
        did = F.element_at(part["does"], state["to"] + 1)
        return F.struct(did["to"].alias("to"), F.coalesce(did["who"], state["who"]).alias("who"), F.coalesce(did["due"], state["due"]).alias("due"))

    ended = parts.select("complaint_id", "n_events", F.aggregate("parts", start, put).alias("x"))
    return ended.select("complaint_id", *named(F.col("x.to")), F.col("x.who").alias("assigned_to"), F.timestamp_micros("x.due").alias("sla_due_at"), "n_events")
