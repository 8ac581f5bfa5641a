"""Support queries over a long conversation, held against plain Python: nothing capped, nothing cut."""

import random

import pytest

from sparkloom.plans import queries

TURNS = 300


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k} " + "long words " * 20) for k in range(TURNS)] + [(2, k, "assistant" if k % 2 else "user", f"short {k}") for k in range(5)]
    path = str(tmp_path_factory.mktemp("sf"))
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4).write.parquet(f"{path}/conversations.parquet")
    return path, sorted(rows)


def test_fold_takes_every_event(spark, made):
    path, rows = made
    got = {r["complaint_id"]: r["n_events"] for r in queries()["complaint_fold"](spark, path).collect()}
    assert got == {1: TURNS, 2: 5}


def test_thread_has_every_reply_whole(spark, made):
    path, rows = made
    got = sorted((r["complaint_id"], r["position"], r["turn"], r["role"], r["text"]) for r in queries()["complaint_thread_replies"](spark, path).collect())
    assert got == [(c, turn, turn, role, text) for c, turn, role, text in rows if turn >= 1]


def test_inbox_has_every_reply_whole(spark, made):
    path, rows = made
    got = sorted((r["user_id"], r["id"], r["position"], r["turn"], r["text"]) for r in queries()["user_inbox_replies"](spark, path).collect())
    assert got == [(c, c, turn // 2, turn, text) for c, turn, role, text in rows if role == "assistant" and turn >= 3]
