"""A scorer of pairs that is plugged in decides the order; the default one counts words."""

import numpy as np

from sparkloom.operators import search


def test_plugged_scorer_changes_the_order(spark):
    queries = spark.createDataFrame([(1, "how do I reset"), (2, "release notes")], "query_id long, text string")
    chunks = spark.createDataFrame([(k, f"T{k}", f"text {k}", "https://x/release/v2" if k == 3 else "https://x/a") for k in range(6)], "chunk_id long, title string, text string, source_path string")
    hits = spark.createDataFrame([(q, k) for q in (1, 2) for k in range(6)], "query_id long, chunk_id long")
    priors = spark.createDataFrame([("release", "release", 0.9)], "intent string, source_type string, prior double")

    def model(texts, passages):
        assert len(texts) == len(passages) <= 256 and all(p.startswith("T") and "\n" in p for p in passages)
        return np.array([float(p[-1]) - 3 for p in passages])

    def order(m):
        rows = search.rerank(queries, hits, chunks, priors, 4, m).orderBy("query_id", "rank").collect()
        return {q: [r["chunk_id"] for r in rows if r["query_id"] == q] for q in (1, 2)}, rows

    up, rows = order(model)
    assert up[1] == [5, 4, 3, 2] and up[2][0] == 3  # the prior of a release question lifts the release page
    down, _ = order(lambda texts, passages: -model(texts, passages))
    assert down[1] == [0, 1, 2, 3]
    assert all(abs(r["sigmoid"] - 1 / (1 + np.exp(-r["raw"]))) < 1e-9 and 0 <= r["score"] <= 1 for r in rows)


def test_default_scorer(spark):
    got = search.word_overlap(["alpha beta", "", "你好 x", "A_b"], ["ALPHA gamma", "x", "好 你", "a b"])
    assert got.tolist() == [0.0, -4.0, 8 * 2 / 3 - 4, 4.0]
    empty = spark.createDataFrame([], "query_id long, chunk_id long, query string, passage string")
    assert search.score_pairs(empty).count() == 0 and search.score_pairs(empty).columns == ["query_id", "chunk_id", "raw"]
    assert search.score_pairs(spark.createDataFrame([(1, 2, None, None)], "query_id long, chunk_id long, query string, passage string")).first()["raw"] == -4.0
