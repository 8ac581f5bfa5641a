"""Operators that SQL cannot express, against plain recomputation on small tables made for their rules."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import rules
from sparkloom.functions import text as T
from sparkloom.operators import chunk, clean, enrich, search
from sparkloom.plans import queries, telemetry
from sparkloom.streaming import streams


def tokens(text):
    return len(re.findall(r"[A-Za-z0-9_]+", text)) + len(re.findall("[一-鿿]", text))


def filled(parts, target, between):
    """Greedy filling by a running total; cut points first, text after."""
    cuts, total = [0], 0
    for k, p in enumerate(parts):
        if k > cuts[-1] and total + tokens(p) > target:
            cuts.append(k)
            total = 0
        total += tokens(p)
    return [between.join(parts[a:b]) for a, b in zip(cuts, [*cuts[1:], len(parts)]) if b > a]


def sentence_chunks(text, target):
    return filled([s.strip() for s in re.split(r"(?<=[.!?。])\s+|\n+", text) if s.strip()], target, " ")


def block_chunks(text, target):
    out, run = [], []
    for p in [*(b.strip() for b in re.split(r"\n\s*\n", text) if b.strip()), None]:
        if p is None or tokens(p) >= 1.5 * target:
            out += filled(run, target, "\n\n")
            run = []
            out += sentence_chunks(p, target) if p else []
        else:
            run.append(p)
    return out


def tail(text, cap):
    if tokens(text) <= cap:
        return text
    words, total = text.split(), 0
    for k in range(len(words) - 1, -1, -1):
        total += max(1, tokens(words[k]))
        if total > cap:
            return " ".join(words[k + 1 :])
    return " ".join(words)


TEXTS = ["a b\nc d\n\ne f", "one. two three; four five. " * 9 + "\n\nz z\n\n" + "G h. i j k l m n o. " * 7 + "\n \n tail", "", "   \n\n ", "中文。分段 测试。\n\n" * 6, "x y z\n\n" * 12, "no stop at all " * 8, "A! B? C. D; E\nF"]


def test_paragraphs_sentences_and_tails(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "id int, text string")
    for target in (4, 8, 20):
        got = df.select("id", chunk.pack_paragraphs(F.col("text"), target).alias("p"), chunk.split_long(F.col("text"), target).alias("s"), chunk.tail_overlap(F.col("text"), target).alias("t")).collect()
        for r in got:
            text = TEXTS[r["id"]]
            assert r["p"] == block_chunks(text, target)
            assert r["s"] == sentence_chunks(text, target)
            assert r["t"] == tail(text, target)


def test_parents_and_leaves(spark):
    body = "alpha beta gamma.\nsame block.\n\n" * 5
    text = f"before\n# H\n{body}\n## Sub\n" + "delta epsilon zeta. eta theta.\n\n" * 30
    rows = chunk.parent_leaf_chunks(spark.createDataFrame([(1, text)], "doc_id int, text string"), parent=60, leaf=20, overlap=5).orderBy("ord").collect()
    want = []
    for path, part in (([], "before"), (["H"], body.strip()), (["H", "Sub"], ("delta epsilon zeta. eta theta.\n\n" * 30).strip())):
        for window in [part] if tokens(part) <= 60 else block_chunks(part, 60):
            leaves = block_chunks(window, 20)
            want.append(("parent", path, window))
            want += [("leaf", path, leaf if not k else f"{tail(leaves[k - 1], 5)}\n\n{leaf}") for k, leaf in enumerate(leaves)]
    assert [(r["chunk_role"], r["section_path"], r["text"]) for r in rows] == want
    assert [r["ord"] for r in rows] == list(range(len(rows))) and all(r["token_count"] == tokens(r["text"]) for r in rows)
    last = None
    for r in rows:
        last = r["chunk_id"] if r["chunk_role"] == "parent" else last
        assert r["parent_id"] == (None if r["chunk_role"] == "parent" else last)


def grams(text):
    t = "".join(text.split())
    return {t[k : k + 5] for k in range(max(1, len(t) - 4))} if t else set()


def test_near_duplicates_keep_case(spark):
    base = "The quick brown fox jumps over the lazy dog again and again, as foxes do"
    texts = [base, base.replace("again,", "again ;"), base.upper(), base + " x", "short", "other words entirely here", base]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    pairs = {(r["x"], r["y"]): r["jaccard"] for r in clean.near_dup_exact(df, "id", "text", 0.85).collect()}
    want = {}
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            x, y = grams(texts[a]), grams(texts[b])
            if len(x & y) / len(x | y) >= 0.85:
                want[a, b] = len(x & y) / len(x | y)
    assert pairs.keys() == want.keys() and all(abs(pairs[k] - want[k]) < 1e-12 for k in want)
    kept = {r["id"]: (r["kept"], r["matched"]) for r in clean.near_dup_minhash(df, "id", "text").collect()}
    assert kept[0] == (True, None) and kept[2] == (True, None) and kept[6] == (False, 0) and kept[4][0] and kept[5][0]


def test_clean_pipeline(spark):
    prose = " ".join(f"word{k} tells something new." for k in range(30))
    files = [("a", ".html", f"<html><nav>menu</nav><article><p>{prose} mail me@example.com</p></article></html>"), ("b", ".md", prose + " mail [x]"), ("c", ".md", "ok"), ("d", ".md", None), ("e", ".md", "phone 13812345678 " + prose[::-1])]
    df = spark.createDataFrame(files, "source_id string, suffix string, text string")
    chunks, counters = clean.clean_pipeline(df)
    rows, c = chunks.collect(), counters.first()
    leaves = {r["source_id"] for r in rows if r["chunk_role"] == "leaf"}
    assert "menu" not in "".join(r["text"] for r in rows) and "me@example.com" not in "".join(r["text"] for r in rows) and "13812345678" not in "".join(r["text"] for r in rows)
    assert "a" in leaves and "e" in leaves and "b" not in leaves and "c" not in leaves
    assert {r["source_id"] for r in rows if r["chunk_role"] == "parent"} == {"a", "b", "c", "e"}
    assert c["pii_redactions"] >= 2 and c["low_info_dropped"] == 1 and c["dedup_dropped"] == 1 and c["chunks"] == len(rows)
    everything, none = clean.clean_pipeline(df, False, False, False, False)
    assert none.first().asDict() == {"pii_redactions": 0, "low_info_dropped": 0, "dedup_dropped": 0, "chunks": everything.count()}
    assert clean.clean_pipeline(df.limit(0))[0].count() == 0


def test_chinese_queries_need_every_character(spark):
    docs = spark.createDataFrame([(1, "退货 运费 说明"), (2, "只说 退 和 费"), (3, "english returns only"), (4, "货 退 费 运 returning")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "退货运费"), (2, "returns"), (3, "return 运费"), (4, "没有")], "item_id int, text string")
    terms = {(r["query_id"], r["term"], r["kind"]) for r in search.query_terms(asked, "item_id", "text").collect()}
    assert {(1, c, "cjk") for c in "退货运费"} | {(2, "returns", "prefix"), (3, "return", "prefix"), (3, "运", "cjk"), (3, "费", "cjk")} <= terms
    got = {}
    for r in search.bm25_topk(asked, docs).collect():
        got.setdefault(r["query_id"], set()).add(r["chunk_id"])
    assert got == {1: {1, 4}, 2: {3}, 3: {1, 3, 4}}


def test_vectors_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 16)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(150, 8))
    rows = [(k, k % 2, [float(x) for x in v[k]]) for k in range(150)]
    df = spark.createDataFrame(rows, "id int, kb int, vector array<float>")
    got = {}
    for r in search.vector_topk(df.where("id % 20 = 0").withColumnRenamed("id", "query_id"), df, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    w = v.astype(np.float32).astype(float)
    for q in range(0, 150, 20):
        own = [k for k in range(150) if k % 2 == q % 2]
        best = sorted(own, key=lambda k: (-round(float(w[q] @ w[k]), 6), k))[:5]
        assert [k for _, k in sorted(got[q])] == best


def test_hybrid_uses_both_lists(spark, tmp_path):
    docs = [(k, f"topic{k} " * 3 + "filler text about nothing", "en" if k % 2 else "es", "s", 10) for k in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "topic7"), (2, "opic41 topi")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = queries()["hybrid_retrieve"](spark, str(tmp_path)).collect()
    found = {q: [r["chunk_id"] for r in rows if r["query_id"] == q] for q in (1, 2)}
    assert found[1][0] == 7 and len(found[1]) == len(found[2]) == 5  # the second has no lexical hit at all
    assert all(k % 2 for own in found.values() for k in own)
    assert {r["query_id"] for r in queries()["multi_query_fuse"](spark, str(tmp_path)).collect()} == {1, 2}


def test_extractive_answers(spark):
    long = "L" * 300 + "."
    texts = ["First one. Second; third! " + "S" * 230 + ". After.", long + " Never.", "   ", "fourth is not used"]
    asked = spark.createDataFrame([(1, "  why? " + "q" * 90), (2, "nothing")], "query_id int, query string")
    hits = spark.createDataFrame([(1, k + 1, f"t{k}", t) for k, t in enumerate(texts)], "query_id int, rank int, title string, text string")
    got = {r["query_id"]: r["answer"] for r in search.extractive_answers(asked, hits).collect()}
    assert got[2] == rules.EXTRACT_NONE
    lines = got[1].split("\n")
    assert lines[0] == rules.EXTRACT_HEAD and lines[2] == rules.EXTRACT_QUERY.format(("why? " + "q" * 90)[:80])
    assert lines[4:] == ["[1] t0", "First one. Second; third!", "", "[2] t1", long, "", "[3] t2", "", "", rules.EXTRACT_TAIL]


def test_rate_limits(spark):
    assert telemetry.limit_of(" 200 / Minutes") == (200, 60_000_000)
    with pytest.raises(ValueError):
        telemetry.limit_of("many/day")
    with pytest.raises(ValueError):
        telemetry.limit_of("3/fortnight")
    rng = np.random.default_rng(4)
    times = sorted({0, 60_000_000, 60_000_001, *map(int, rng.integers(0, 600_000_000, 60))})
    rows = [(key, us, 100 * key + n) for key in (1, 2) for n, us in enumerate(times[key::2] if key == 2 else times)]
    got = {r["event_id"]: r for r in telemetry.limited(spark.createDataFrame(rows, "key long, us long, event_id long"), "3/minute").collect()}
    for key in (1, 2):
        accepted = []
        for k, us, event in rows:
            if k == key:
                window = [a for a in accepted if us - a <= 60_000_000]
                own = got[event]
                assert own["allowed"] == (len(window) < 3)
                assert own["remaining"] == (2 - len(window) if own["allowed"] else 0)
                assert own["retry_after"] == (0 if own["allowed"] else (window[0] + 60_000_000 - us) / 1e6)
                accepted += [us] * own["allowed"]


def test_semantic_cache_against_a_loop(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 8))
    rows = []
    for seq in range(120):
        v = centres[seq % 6] + 0.2 * rng.normal(size=8)
        rows.append((seq % 2, seq, [float(x) for x in (v / np.linalg.norm(v)).astype(np.float32)]))
    got = {r["seq"]: r["hit_seq"] for r in search.semantic_cache(spark.createDataFrame(rows, "kb int, seq long, vector array<float>"), 0.9, 4).collect()}
    held = {0: [], 1: []}
    for kb, seq, v in rows:
        sims = [(float(np.dot(w, v)), -s) for s, w in held[kb]]
        best = max(sims, default=(0.0, 0))
        if best[0] >= 0.9:
            assert got[seq] == -best[1]
        else:
            assert got[seq] is None
            held[kb] = (held[kb] + [(seq, v)])[-4:]


def test_mmr_keeps_case_and_order(spark):
    rows = [(1, k, 1.0 - k / 10, t, k + 1) for k, t in enumerate(("same words here", "same words here", "SAME WORDS HERE", "different text"))]
    df = spark.createDataFrame(rows, "query_id int, chunk_id int, score double, text string, rank int")
    assert [r["chunk_id"] for r in search.mmr_select(df, 3, 0.5).orderBy("position").collect()] == [0, 2, 3]
    assert [r["chunk_id"] for r in search.mmr_select(df, 4, 0.5).orderBy("position").collect()] == [0, 1, 2, 3]


def test_embedding_and_units(spark):
    df = spark.createDataFrame([(1, "some words"), (2, None), (3, "some words")], "doc_id int, text string")
    got = {r["doc_id"]: np.array(r["vector"]) for r in enrich.embed(df, "doc_id", "text").collect()}
    assert (got[1] == got[3]).all() and abs(np.linalg.norm(got[1]) - 1) < 1e-5
    zero = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "vector array<float>").select(search.unit(F.col("vector")).alias("u")).collect()
    assert zero[0]["u"] is None and np.allclose(zero[1]["u"], [0.6, 0.8])


def test_compatibility_form(spark):
    df = spark.createDataFrame([("ＡＢＣ　１２ ﬁ",), (None,), ("  plain  text ",)], "q string")
    assert [r[0] for r in df.select(T.normalize_query(F.col("q"))).collect()] == ["ABC 12 fi", None, "plain text"]


def test_streams_are_whole(spark, tmp_path):
    rows = [(k, k % 7, "click" if k % 3 else "view") for k in range(300)]
    df = spark.createDataFrame(rows, "event_id long, minute long, event_type string").select("event_id", "event_type", F.timestamp_seconds(F.col("minute") * 60).alias("ts"))
    df.write.parquet(f"{tmp_path}/events.parquet")
    e = streams.stream_of(spark, f"{tmp_path}/events.parquet")
    got = streams.latest(spark, streams.windowed_counts(e, "ts", "event_type"), "start", "event_type")
    want = df.groupBy(F.date_trunc("minute", "ts").alias("start"), "event_type").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
