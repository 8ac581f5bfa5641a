"""Fusion over variants scores and returns every candidate of its lists; the first of the fusion are those that lists cut at forty would give."""

from pyspark.sql import functions as F

from sparkloom.operators import search
from sparkloom.plans import queries, retrieval


def test_every_candidate_is_scored(spark, tmp_path):
    sf = str(tmp_path)
    docs = [(k, f"topic{k} common{k % 3} " * (1 + k % 4) + "".join(chr(97 + k * j % 26) for j in range(60)), "en", "s", 10) for k in range(150)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, "topic7 words and then common1"), (2, "zz nothing of this is there qq")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = queries()["multi_query_fuse"](spark, sf).collect()

    chunks, index = retrieval.as_chunks(spark, sf), retrieval.indexed(spark, sf)
    vectors = retrieval.vectors_of(chunks.select("chunk_id", "text"), "chunk_id")
    lists, candidates = [], {1: set(), 2: set()}
    for name, text in (("whole", F.col("text")), ("half", F.expr("substr(text, cast(length(text) / 2 as int))"))):
        q = retrieval.asked(spark, sf).select("query_id", text.alias("text"))
        own = search.rrf_fuse([("bm25", search.bm25_topk(q, chunks, query_id="query_id", chunk_id="chunk_id", index=index)), ("vector", retrieval.vector_hits(q, vectors, 40))])
        for r in own.collect():
            candidates[r["query_id"]].add(r["chunk_id"])
        lists.append((name, search.mmr_select(own.join(chunks.select("chunk_id", "text"), "chunk_id"), 40).withColumnRenamed("position", "rank")))
    first = {(r["query_id"], r["rank"]): r["chunk_id"] for r in search.rrf_fuse(lists).collect()}

    for q in (1, 2):
        rows = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert {r["chunk_id"] for r in rows} == candidates[q] and len(rows) == len(candidates[q]) > 40
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) == sorted(r["fused"] for r in rows)
        assert [(-r["score"], r["chunk_id"]) for r in rows] == sorted((-r["score"], r["chunk_id"]) for r in rows)
        own = {r["fused"]: r["chunk_id"] for r in rows}
        assert all(own[k] == chunk for (query, k), chunk in first.items() if query == q)
