"""The lexical index with pruning by bounds against plain BM25; product quantisation against exact search; tables kept by their files."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import search
from sparkloom.sources import shared

SF = "/root/testdata/sf0.1"


def plain(queries, docs, k):
    """BM25 of every query against every text, prefixes as they stand."""
    words = {d: re.findall(r"[a-z0-9]+", t.lower()) for d, t in docs}
    total, out = sum(map(len, words.values())), []
    for q, text in queries:
        terms = sorted({t for t in re.findall("[a-z0-9_]+", text.lower()) if len(t) > 1})
        scores = {}
        for t in terms:
            tf = {d: n for d, ws in words.items() if (n := sum(w.startswith(t) for w in ws))}
            idf = max(1e-6, math.log((len(docs) - len(tf) + 0.5) / (len(tf) + 0.5))) if tf else 0
            for d, n in tf.items():
                scores[d] = scores.get(d, 0) + idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(words[d]) / (total / len(docs))))
        best = sorted(((-round(s, 6), d) for d, s in scores.items()))[:k]
        out += [(q, d, -s, r) for r, (s, d) in enumerate(best, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(6)
    vocabulary = ["".join(rnd.choice("bcdfghkl") for _ in range(rnd.randrange(2, 7))) for _ in range(400)]
    weights = [1 / (k + 1) for k in range(400)]  # a few words are everywhere, most are rare
    docs = [(d, " ".join(rnd.choices(vocabulary, weights, k=rnd.randrange(5, 80)))) for d in range(300)]
    return docs, [(q, " ".join(rnd.choices(vocabulary, weights, k=12))) for q in range(25)]


@pytest.mark.parametrize("k", [3, 40, 1000])
def test_pruned_search_is_exact(spark, corpus, k):
    docs, queries = corpus
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    got = search.bm25_topk(q, d, k)
    assert sorted((r["query_id"], r["chunk_id"], round(r["score"], 6), r["rank"]) for r in got.collect()) == plain(queries, docs, k)


def test_postings_of_terms_that_cannot_matter_propose_nothing(spark, corpus):
    docs, queries = corpus
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    index = search.build_index(d, "doc_id", "text")
    terms = search.query_terms(q, "item_id", "text").select("query_id", "term")
    parts = search.scored_terms(terms, index)
    ranked, _ = search.bounded(terms, parts, 3)
    joined, whole = (t.join(parts, "term").count() for t in (ranked.where("essential"), ranked))
    assert joined < 0.5 * whole


def test_index_of_nothing(spark):
    d, q = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert search.bm25_topk(q, d).count() == 0 and search.bm25_topk(q.limit(0), d).count() == 0


def test_tables_are_kept_by_their_files(spark, tmp_path):
    built, path = [], str(tmp_path / "t.parquet")
    count = lambda df: built.append(1) or df.agg(F.count("*").alias("n"))
    spark.range(5).write.parquet(path)
    assert [shared.kept(spark.read.parquet(path), "counts", count).first()["n"] for _ in range(3)] == [5] * 3 and len(built) == 1
    spark.range(7).write.mode("append").parquet(path)
    assert shared.kept(spark.read.parquet(path), "counts", count).first()["n"] == 12 and len(built) == 2


def test_quantised_search(spark):
    """Of all vectors as one base: recall, with full vectors read for one in twenty pairs; and none of another base."""
    v = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id AS id", "0 AS kb", "embedding AS vector")
    q = v.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    candidates = v.count() // 20
    near = {(r["query_id"], r["id"]): r["score"] for r in search.vector_topk_ann(q, v, candidates=candidates).collect()}
    exact = {(r["query_id"], r["id"]): r["score"] for r in search.vector_topk(q, v).collect()}
    assert len(near.keys() & exact.keys()) / len(exact) >= 0.95
    assert all(abs(near[p] - exact[p]) < 2e-6 for p in near.keys() & exact.keys())


def test_quantised_search_within_bases(spark):
    rnd = random.Random(3)
    rows = [(k, rnd.choice([None, 1, 2]), [rnd.gauss(0, 1) for _ in range(10)]) for k in range(90)]
    v = spark.createDataFrame(rows, "id long, kb long, vector array<float>")
    q = v.where("id % 9 = 0").withColumnRenamed("id", "query_id")
    pairs = lambda df: sorted((r["query_id"], r["id"], r["rank"]) for r in df.collect())
    assert pairs(search.vector_topk_ann(q, v, 4, block=16)) == pairs(search.vector_topk(q, v, 4))
    of = {r[0]: r[1] for r in rows}
    assert all(of[a] == of[b] for a, b, _ in pairs(search.vector_topk_ann(q, v, 4, candidates=6)))
    assert search.vector_topk_ann(q.limit(0), v).count() == 0 and search.vector_topk_ann(q, v.limit(0)).count() == 0
