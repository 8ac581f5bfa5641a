"""Complaints: random logs against the rules applied one by one, ranges of one hot complaint, streams cut into batches anyhow."""

import datetime as dt
import random

import pytest

from sparkloom.operators import complaints
from sparkloom.streaming import streams
from sparkloom.streaming.complaints import ROCKS, complaint_states

POOL = ["ann", "bo", "cy"]
SCHEMA = "complaint_id long, seq long, kind string, severity string, at timestamp, actor string"
HOURS = {"high": 1, "medium": 4, "low": 24}
T0 = dt.datetime(2024, 5, 1)


def loop(events):
    """The rules as they are told: create, reopen, claim, escalate, cancel on one row each."""
    rows = {}
    for c, seq, kind, severity, at, actor in sorted(events, key=lambda e: (e[0], e[1])):
        r = rows.setdefault(c, dict(status=None, escalated=False, severity=None, who=None, due=None, n=0))
        r["n"] += 1
        pick = POOL[(c + seq) % 3]
        if kind == "open" and r["status"] is None or kind == "reopen" and r["status"] == "closed":
            r["severity"] = r["severity"] or severity
            high = r["severity"] == "high"
            r.update(status="escalated" if high else "open", escalated=high, due=at + dt.timedelta(hours=HOURS[r["severity"]]))
            if high:
                r["who"] = pick
        elif r["status"] and kind == "claim":
            r.update(who=actor or r["who"], escalated=True, status="escalated" if r["status"] == "open" else r["status"])
        elif r["status"] and kind == "escalate":
            r.update(who=actor or pick, escalated=True, status="escalated")
        elif r["status"] and kind == "cancel":
            r.update(status="closed", escalated=False)
    return {c: (c, r["status"], r["escalated"], r["severity"], r["who"], r["due"], r["n"]) for c, r in rows.items()}


def log(seed, sizes):
    rnd = random.Random(seed)
    out = []
    for c, n in sizes.items():
        for k in range(n):
            kind = "open" if rnd.random() < (0.9 if k == 0 else 0.1) else rnd.choice(["claim", "escalate", "cancel", "reopen", "note"])
            out.append((c, k, kind, rnd.choice(list(HOURS)) if kind == "open" else None, T0 + dt.timedelta(minutes=k), rnd.choice([None, f"agent{k}"])))
    return out


def test_fold_of_random_logs_and_a_hot_complaint(spark):
    events = log(1, {7: 20000, **{c: c % 9 + 1 for c in range(100, 400)}})
    df = spark.createDataFrame(events, SCHEMA).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so small a log is one range
    try:
        ranges = complaints.ranges(complaints.ready(df, POOL)).where("complaint_id = 7").select("part").distinct().count()
        assert ranges > 1  # the hot one is cut into several tasks
        assert {r[0]: tuple(r) for r in complaints.complaint_fold(df, POOL).collect()} == loop(events)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_fold_edges(spark):
    rows = [(1, 0, "reopen", None, T0, None), (2, 0, None, None, T0, None), (3, 0, "open", "odd", T0, None), (3, 1, "open", "high", T0, None), (None, 0, "open", "low", T0, "x")]
    got = {r[0]: tuple(r)[1:5] for r in complaints.complaint_fold(spark.createDataFrame(rows, SCHEMA), POOL).collect()}
    assert got == {1: (None, False, None, None), 2: (None, False, None, None), 3: ("open", False, "low", None), None: ("open", False, "low", None)}
    assert complaints.complaint_fold(spark.createDataFrame([], SCHEMA), POOL).count() == 0


def told(spark, folder, late="30 days"):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    got = []

    def keep(batch, number):
        got.extend((number, tuple(r)) for r in batch.collect())

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    streams.finish(complaint_states(stream, POOL, late).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", streams.scratch(spark, "check")))
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_fold_however_it_is_cut(spark, tmp_path, seed):
    """Batches at random, events out of order within and across them, and some replayed."""
    rnd = random.Random(seed)
    events = log(seed, {c: rnd.randrange(1, 12) for c in range(20)})
    sent = events + rnd.sample(events, 15)
    rnd.shuffle(sent)
    for k in range(3):
        spark.createDataFrame(sent[k::3], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last = {}
    for number, row in told(spark, str(tmp_path / "in")):
        last[row[0]] = max(last.get(row[0], (-1,)), (number, row[6], row[7], row), key=lambda x: x[:3])
    assert {c: x[3][:7] for c, x in last.items()} == loop(events)


def test_deadline_and_compaction(spark, tmp_path):
    """A deadline that the watermark passes is told as overdue; events behind it are applied once and forgotten."""
    at = lambda hours: T0 + dt.timedelta(hours=hours)
    batches = [
        [(1, 0, "open", "high", at(0), None), (2, 0, "open", "low", at(0), None)],
        [(2, 1, "cancel", None, at(3), None), (3, 0, "open", "low", at(9), None)],
        [(1, 0, "open", "high", at(0), None), (1, 1, "escalate", None, at(9), "zoe"), (4, 0, "open", "low", at(50), None)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = told(spark, str(tmp_path / "in"), "1 hour")
    assert any(r[0] == 1 and r[7] for _, r in got) and not any(r[0] == 2 and r[7] for _, r in got)
    assert max((n, r[6], r) for n, r in got if r[0] == 1)[2][4:7] == ("zoe", at(1), 2)  # the replayed opening counts once
