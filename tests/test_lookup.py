"""Lookups in the lexical index: every block is unpacked once for all terms, odd texts, and passages held word for word."""

import os
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import search
from sparkloom.plans import evaluation


def written(monkeypatch, module=search):
    seen, real = {}, search.stored

    def stored(df, name):
        out = real(df, name)
        seen[name] = out
        return out

    monkeypatch.setattr(module, "stored", stored)
    return seen


def test_a_block_is_unpacked_once_for_thousands_of_terms(spark, monkeypatch):
    seen = written(monkeypatch)
    d = spark.createDataFrame([(k, f"w{k} w{k % 7}x") for k in range(1500)], "doc_id long, text string")
    q = spark.createDataFrame([(k, " ".join(f"w{k * 30 + j}" for j in range(30))) for k in range(50)], "item_id long, text string")
    assert search.bm25_topk(q, d, 3).count() == 150
    assert seen["terms"].count() == 1


def test_blocks_of_odd_texts(spark):
    texts = [None, "", " ", "...", "É ÀÉ éà", "ΣΑΣ Σ", "İx", "a你b好", "你﩮好", "x\n\ty_z-1", "½ ²3 Ⅷ", "🙂a🙂", "你", "\x00a"]
    rows = [(k, t) for k, t in enumerate(texts * 80)]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = search.build_index(d, "doc_id", "text")
    want = {(r["chunk_id"], r["term"], r["tf"]) for r in search.postings(d, "doc_id", "text").collect()}
    assert {(r["chunk_id"], r["term"], r["tf"]) for r in got.post.collect()} == want
    sums = {}
    for chunk, _, tf in want:
        sums[chunk] = sums.get(chunk, 0) + tf
    assert {r["chunk_id"]: r["len"] for r in got.lengths.collect()} == {k: sums.get(k, 0) for k, _ in rows}
    terms = spark.createDataFrame([("a",), ("你",), ("b9",)], "term string")
    assert {(r["term"], r["chunk_id"]) for r in search.holders(terms, got).collect()} == {(t, c) for c, t, _ in want if t in ("a", "你", "b9")}


def test_relevant_documents_as_in_sql(spark, tmp_path):
    """Passages cut within a word, of one word, of none."""
    docs = pd.DataFrame([(1, "xfoo mid longestend"), (2, "foo mid longest"), (3, "only!"), (4, "a 你好吗 b"), (5, None), (6, "... mid Foo")], columns=["doc_id", "text"])
    asked = pd.DataFrame([(0, "oo mid longest"), (1, "nly"), (2, "..."), (3, "mid longestend"), (4, "Foo mid"), (6, "o mid L")], columns=["item_id", "text"])
    docs.to_parquet(tmp_path / "documents.parquet")
    asked.to_parquet(tmp_path / "benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    sql = con.execute(f"WITH {evaluation.EVAL} SELECT query_id, category, scored, first_rank, hit1, hit3, hit5, rr FROM ev ORDER BY query_id").fetchall()
    got = [tuple(r) for r in evaluation.eval_rows(spark, os.fspath(tmp_path)).orderBy("query_id").collect()]
    assert got == sql and sum(r[2] for r in sql) == 4


def greedy(rows, k, weight):
    """Maximal marginal relevance by the letter."""
    grams = [{t[i : i + 5] for i in range(max(1, len(t) - 4))} if (t := (x or "").strip()) else set() for _, x in rows]
    s = np.array([x for x, _ in rows])
    rel = (s - s.min()) / (s.max() - s.min())
    chosen = []
    while len(chosen) < k:
        like = lambda i: max((len(grams[i] & grams[j]) / len(grams[i] | grams[j]) if grams[i] | grams[j] else 0.0 for j in chosen), default=0.0)
        chosen.append(max((i for i in range(len(rows)) if i not in chosen), key=lambda i: (weight * rel[i] - (1 - weight) * like(i), -i)))
    return chosen


@pytest.mark.parametrize("k", [1, 5, 29])
def test_diversity_by_the_letter(spark, k):
    rnd = random.Random(k)
    rows = [(round(rnd.random(), 2), rnd.choice([None, "", "ab", "".join(rnd.choices("abc ", k=40))])) for _ in range(30)]
    df = spark.createDataFrame([(1, i, s, t, i) for i, (s, t) in enumerate(rows)], "query_id long, chunk_id long, score double, text string, rank long")
    got = [r["chunk_id"] for r in search.mmr_select(df, k).orderBy("position").collect()]
    assert got == greedy(rows, k, 0.7)


def test_texts_are_not_shuffled_to_a_few_hits(spark, monkeypatch):
    """Hits that come from a join look large; they are stored first, so texts stay where they are."""
    seen = written(monkeypatch)
    chunks = spark.range(4000).select(F.col("id").alias("chunk_id"), F.lit("t").alias("title"), F.repeat(F.lit("word "), F.lit(50)).alias("text"), F.lit("/faq").alias("source_path"))
    hits = spark.range(4).select(F.col("id").alias("query_id"), (F.col("id") * 7).alias("chunk_id")).join(chunks.select("chunk_id"), "chunk_id")
    priors = spark.createDataFrame([("howto", "faq", 0.1)], "intent string, source_type string, prior double")
    asked = spark.range(4).select(F.col("id").alias("query_id"), F.lit("word").alias("text"))
    assert search.rerank(asked, hits, chunks, priors).count() == 4 and seen["pairs"].count() == 4
