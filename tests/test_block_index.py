"""The lexical index in blocks of chunks: exact, repeated ids, groups of CJK characters, and no postings in a shuffle."""

import random

from sparkloom.operators import search


def test_blocks_hold_what_postings_are(spark):
    rnd = random.Random(4)
    rows = [(k, " ".join(rnd.choices(["ab", "abc", "b1", "你好", "ñandú", "x"], k=rnd.randrange(9)))) for k in range(1300)]
    rows += [(5, "again ab"), (5, None), (2000, None), (None, "nobody")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    index = search.build_index(d, "doc_id", "text")
    want = {(r["chunk_id"], r["term"], r["tf"]) for r in search.postings(d.where("doc_id IS NOT NULL"), "doc_id", "text").collect()}
    got = index.post.collect()
    assert {(r["chunk_id"], r["term"], r["tf"]) for r in got} == want and len(got) == len(want)
    assert index.blocks.selectExpr("max(size(ids))").first()[0] <= search.CHUNKS
    assert {r["word"] for r in index.words.collect()} == {t for _, t, _ in want}


def test_groups_and_overlap(spark):
    d = spark.createDataFrame([(1, "你 x"), (2, "你好 abc"), (3, "abc abd"), (4, "好")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "你好"), (2, "ab"), (3, "abc abd 好 ghi"), (4, "!")], "item_id long, text string")
    assert sorted((r["query_id"], r["chunk_id"]) for r in search.bm25_topk(q, d).collect()) == [(1, 2), (2, 2), (2, 3), (3, 2), (3, 3), (3, 4)]
    assert sorted((r["query_id"], r["chunk_id"], r["score"]) for r in search.overlap_topk(q, d).collect()) == [(3, 2, 1.0), (3, 3, 2.0)]


def test_postings_are_not_shuffled(spark):
    """What leaves a task is a query's best chunks: the plan's only exchange of results follows a limit by rank."""
    d = spark.createDataFrame([(k, f"word{k % 7} other") for k in range(3000)], "doc_id long, text string")
    q = spark.createDataFrame([(k, f"word{k}") for k in range(5)], "item_id long, text string")
    seen, real = [], search.stored
    search.stored = lambda df, name: seen.append((name, df._jdf.queryExecution().executedPlan().toString())) or real(df, name)
    try:
        search.bm25_topk(q, d, 3)
    finally:
        search.stored = real
    plans = dict(seen)
    assert "Exchange" not in plans["blocks"] and "WindowGroupLimit" in plans["hits"]
