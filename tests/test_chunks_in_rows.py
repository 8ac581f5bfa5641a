"""Texts are chunked within their rows, by the rules that the column functions have."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import chunk

PIECES = ["\n", "\n\n", " \n \n", "# H one\n", "## T  two \r\n", "####### no\n", "#x\n", "###\t x y \n", "word ", "end. ", "退货。 ", "。", "! ", "a_b c ", "　", "\x1c", "\u0085", "\r\n", "xxx", " q? "]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    return ["", *("".join(rnd.choices(PIECES, k=rnd.choice([5, 60, 900]))) for _ in range(60))]


def test_nothing_is_shuffled(spark, texts):
    rows = chunk.parent_leaf_chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), parent=40, leaf=15, overlap=4)
    assert "Exchange" not in rows._jdf.queryExecution().toString()
    rows = rows.collect()
    assert all(r["ord"] == k for own in (sorted(r["ord"] for r in rows if r["source_id"] == i) for i in range(len(texts))) for k, r in enumerate({"ord": o} for o in own))
    parents = {r["chunk_id"] for r in rows if r["chunk_role"] == "parent"}
    assert {r["parent_id"] for r in rows if r["chunk_role"] == "leaf"} <= parents and len(rows) > 500


def test_same_as_columns(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sections = [(r["id"], list(r["path"]), r["body"]) for r in chunk.split_sections(df).orderBy("id", "section").collect()]
    assert sections == [(i, path, body) for i, t in enumerate(texts) for path, body in chunk.sections_of(t)]
    rows = df.select("text", chunk.pack_paragraphs(F.col("text"), 15).alias("p"), chunk.tail_overlap(F.col("text"), 9).alias("t"), T.approx_tokens(F.col("text")).alias("n")).collect()
    for r in rows:
        own = chunk.packed(chunk._BLANK.split(r["text"]), 15, "\n\n", 22.5)
        assert [c for c, _ in own] == r["p"] and chunk.tokens_of(r["text"]) == r["n"]
        assert chunk.tail_of(r["text"], r["n"], 9)[0] == r["t"] and all(chunk.tokens_of(c) == n for c, n in own)


def test_kinds_are_searched_where_they_can_be(spark):
    rows = [("mail a@b.io",), ("no sign, 13812345678",), ("plain",), ("1.2.3.4 and x@y.zz 4111111111111111",)]
    got = spark.createDataFrame(rows, "t string").select(T.pii_scan(F.col("t")).alias("s")).select("s.*").collect()
    assert [(len(r["h_email"]), len(r["h_phone"]), len(r["h_ip"]), len(r["h_bankcard"])) for r in got] == [(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 0, 0), (1, 0, 1, 1)]
