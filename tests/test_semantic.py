"""Semantic chunks of whole texts against the two passes told in plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import chunk, enrich


def two_passes(sentences, tokens, distances, least, most):
    """Cut at spikes, then gather groups in order; indexes of the sentences of each chunk."""
    if len(sentences) < 2:
        return [list(range(len(sentences)))] if sentences else []
    cut = float(np.percentile(distances, 95))
    groups = [[0]]
    for k, d in enumerate(distances, 1):
        groups.append([k]) if d >= cut else groups[-1].append(k)
    out, held, n = [], [], 0
    for g in groups:
        size = sum(tokens[k] for k in g)
        if n < least and n + size <= most:
            held, n = held + g, n + size
            continue
        if held:
            out.append(held)
        held, n = g, size
        if size > most:
            piece, m = [], 0
            for k in g:
                if piece and m + tokens[k] > most:
                    out.append(piece)
                    piece, m = [], 0
                piece, m = piece + [k], m + tokens[k]
            out.append(piece)
            held, n = [], 0
    return out + [held] if held else out


@pytest.mark.parametrize("least,most", [(5, 12), (20, 60), (150, 800)])
def test_chunks_of_random_texts(spark, least, most):
    rnd = random.Random(least)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(1, 7)))
    texts = [". ".join(" ".join(word() for _ in range(rnd.choice([1, 2, 5, 9, 40]))) for _ in range(rnd.choice([1, 2, 3, 10, 60]))) for _ in range(60)]
    texts += [None, "", " \n ", "One.", "同一句。同一句。同一句。", "same. " * 50]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, ord long, tokens string")
    got = {}
    for r in chunk.semantic_split(df, least=least, most=most).orderBy("id", "ord").collect():
        got.setdefault(r["id"], []).append((r["ord"], r["text"], r["n_sentences"], r["token_count"]))
    rows = df.select("doc_id", T.sentences(F.coalesce("text", F.lit(""))).alias("s")).withColumn("n", F.transform("s", T.approx_tokens)).collect()
    for r in rows:
        v = enrich.hashed_ngrams(r["s"]) if r["s"] else np.zeros((0, 64))
        d = np.round(1 - np.clip((v[:-1] * v[1:]).sum(axis=1), -1, 1), 6)
        want = [(k, " ".join(r["s"][i] for i in c), len(c), sum(r["n"][i] for i in c)) for k, c in enumerate(two_passes(r["s"], r["n"], d, least, most))]
        assert got.get(r["doc_id"], []) == want, r["s"]


def test_batches_of_sentences_across_documents(spark):
    """Whatever the batch of the model, each distance is between the same two sentences."""
    df = spark.createDataFrame([(k, f"alpha {k}. beta {k} gamma. delta. " * (k % 5)) for k in range(40)], "doc_id long, text string").coalesce(1)
    wide, narrow = ({r["id"]: (r["distances"], r["cut"]) for r in chunk.sentence_distances(df, batch=b).collect()} for b in (1024, 3))
    assert wide == narrow and len(wide) == 40


def test_split_where_the_topic_shifts(spark):
    """A model of two topics: the only cut is between them, and chunks respect both limits."""
    model = lambda texts: np.array([[1.0, 0.0] if "cat" in t else [0.0, 1.0] for t in texts])
    text = "the cat sat. " * 10 + "a dog ran. " * 10
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [r["text"] for r in chunk.semantic_split(df, model=model, least=5, most=30).orderBy("ord").collect()]
    assert got == [" ".join(["the cat sat."] * 10), " ".join(["a dog ran."] * 10)]
    got = chunk.semantic_split(df, model=model, least=5, most=9).orderBy("ord").collect()
    assert all(r["token_count"] <= 9 for r in got) and sum(r["n_sentences"] for r in got) == 20
