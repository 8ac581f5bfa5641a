"""Operators against brute force, round trips and held-out accuracy; nulls, empty and odd texts, repeated rows, empty tables."""

import hashlib
import json
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import bpe, chat, dartminhash, editcount, exact, langid, licenses, media, packing, queries, toxicity

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a  b", "\n\n  x\n y", "trail ", "<|endoftext|> x", "don't we'll 123 !!!", "日本語 テキスト。　全角", "a" * 20000, "🙂 é̂", "\r\n\t  \t a", "same text", "same text", "same  \ttext"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, with columns whose names the operators use themselves, and a repeated row."""
    rows = [(k, t, "en", "s", 0, True, 1) for k, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[-1], (None, "no id", None, None, None, None, None)], "doc_id long, text string, lang string, source string, kept long, held_out boolean, score int")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_bpe_matches_library(spark, docs, odd, empty, tokenizer):
    for df in (docs.select("doc_id", "text"), odd.select("doc_id", "text")):
        texts = [(r["doc_id"], r["text"]) for r in df.collect()]
        want = sorted(repr((d, len(i := ids_of(tokenizer, t)), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(i, skip_special_tokens=False).encode()).hexdigest())) for d, t in texts)
        assert sorted(repr(tuple(r)) for r in bpe.encode_digests(df).collect()) == want
    assert bpe.encode_decode(odd.where("doc_id = 8")).first()["decoded"] == ODD[8]
    assert bpe.encode_digests(empty).count() == 0


def test_packing_limits_and_cover(odd, docs, empty, tokenizer):
    for df, limits in ((docs, packing.Limits()), (odd, packing.Limits(64, 3, 50, pool=8))):
        rows = packing.pack(df, limits=limits, with_ids=True).collect()
        pieces, sequences = {}, {}
        for r in rows:
            assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
            pieces.setdefault(r["doc_id"], []).append(r)
            sequences.setdefault(r["sequence_id"], []).append(r)
        for d, text in [(r["doc_id"], r["text"]) for r in df.dropDuplicates(["doc_id"]).collect()]:
            joined = sorted(pieces[d], key=lambda r: r["start"])
            if df.where(F.col("doc_id").eqNullSafe(F.lit(d))).count() == 1:
                assert [i for r in joined for i in r["ids"]] == [*ids_of(tokenizer, text), 1]
        for own in sequences.values():
            at = 0
            for r in sorted(own, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= limits.tokens and len(own) <= limits.segments and sum(r["loss_tokens"] for r in own) <= limits.loss_tokens
    assert packing.pack(empty).count() == 0


def test_edits_match_a_fresh_count(spark, odd, docs, empty, tokenizer):
    for df in (odd, docs):
        index = editcount.build_index(df, leaf_chars=64)
        got = editcount.apply_edits(index.withColumn("edits", editcount.sample_edits(F.col("doc_id"), F.col("text")))).collect()
        assert all(r["n_tokens"] == len(ids_of(tokenizer, r["text"])) for r in got)
        assert len(got) == df.count()
    assert editcount.apply_edits(editcount.build_index(odd).withColumn("edits", F.lit(None).cast(editcount.EDITS))).where("tokens_before <> n_tokens").count() == 0
    assert editcount.build_index(empty).count() == 0


def test_matroska_round_trip(odd, empty):
    files = media.write_matroska(odd)
    for r in media.read_matroska(files, payload=True).collect():
        raw = (ODD[r["doc_id"]] or "" if r["doc_id"] is not None else "no id").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert bytes(r["payload"]) == padded and r["error"] is None and r["n_bytes"] == len(raw)
        assert len(r["cues"]) == r["n_clusters"] and {p["lacing"] for p in r["packets"]} <= {0, 1, 2, 3}
        assert [p["time_ns"] for p in r["packets"]] == sorted(p["time_ns"] for p in r["packets"])
    assert media.packet_table(media.read_matroska(files)).count() >= len(ODD)
    assert media.read_matroska(media.write_matroska(empty)).count() == 0


def test_matroska_structures():
    frames = [b"a" * 3, b"b" * 300, b"c" * 7]
    for kind in (1, 3):
        body = b"\x82" + b"\x00\x05" + bytes([kind << 1]) + media.lace([3, 300, 7], kind) + b"".join(frames)
        group = media.element(media.BLOCK_GROUP, media.element(media.BLOCK, body) + media.number(media.REFERENCE, 1))
        cluster = media.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + media.number(media.TIMESTAMP, 10) + group  # of unknown size
        data = media.element(media.EBML, b"") + media.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + media.element(media.INFO, media.number(media.TIMESTAMP_SCALE, 1000)) + cluster + cluster
        m = media.Matroska(data)
        assert m.error is None and m.clusters == 2 and len(m.packets) == 6
        assert [data[p["offset"] : p["offset"] + p["length"]] for p in m.packets[:3]] == frames
        assert {(p["track"], p["time_ns"], p["keyframe"]) for p in m.packets} == {(2, 15_000, False)}
    assert media.Matroska(b"junk").error and media.Matroska(media.write_samples(b"x" * 64)[:-3]).error
    assert all(media.Matroska(b"\x80" * 1).read_vint(0)[0] == 0 and media.Matroska(media.vint(v)).read_vint(0)[0] == v for v in (0, 1, 126, 127, 16382, 1 << 30))


def brute_exact(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append(d)
    out = []
    for d, t in rows:
        known = [x for x in groups[norm(t)] if x is not None]
        keep = min(known) if known else None
        out.append((d, keep, len(groups[norm(t)]), d == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(map(repr, out))


def test_exact_dedup(odd, docs, empty):
    for df in (odd, docs):
        want = brute_exact([(r["doc_id"], r["text"]) for r in df.collect()])
        for bits in (256, 4):  # four bits force collisions, which verification must undo
            assert sorted(repr(tuple(r)) for r in exact.exact_dedup(df, digest_bits=bits).collect()) == want
    assert exact.exact_dedup(empty).count() == 0
    index = exact.build(odd)
    digest = hashlib.sha256(b"same text").hexdigest()
    assert exact.lookup(index, [digest]).first()["n"] == 4
    assert sorted(r["doc_id"] for r in exact.keep_first(odd.where("doc_id IS NOT NULL")).collect()) == [0, *range(2, 13)]


def test_licenses(spark, empty):
    texts = [None, "", "Released under the MIT License.", "cc by nc CC-BY-NC cc by nc", "under the mit license apache license, version 2", "plain words", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "x " * 500 + "This work is licensed under the GNU General Public License, version 3.", "K is no k"]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, labels int")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert (got[0]["n_words"], got[0]["labels"], got[0]["score"], got[0]["first_word"]) == (0, "", 0.0, None)
    assert (got[2]["base_labels"], got[2]["first_word"], got[2]["last_word"], got[2]["score"]) == ("mit", 1, 1, 1.0)
    assert (got[3]["n_base"], got[3]["first_word"], got[3]["last_word"]) == (3, 0, 6)
    assert got[4]["base_labels"] == "apache-2,mit" and got[4]["last_word"] == 4
    assert got[5]["labels"] == "" and got[6]["base_labels"] == "" and got[6]["labels"] == "mit" and got[7]["labels"] == "gpl-3" and got[8]["n_words"] == 4
    assert licenses.scan(empty).count() == 0


def test_chat(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, None, "x"), (2, None, "ann", ""), (None, 1, "cy", "q"), (3, 0, "system", "alone")]
    got = chat.rotate(spark.createDataFrame([(*r, "n") for r in rows], "conv_id long, turn long, role string, text string, position string")).collect()
    assert {(r["conv_id"], r["perspective"]) for r in got} == {(1, "ann"), (1, "bob"), (1, "unknown"), (2, "ann"), (None, "cy")}
    for key in {(r["conv_id"], r["perspective"]) for r in got}:
        own = sorted((r for r in got if (r["conv_id"], r["perspective"]) == key), key=lambda r: r["position"])
        whole = "".join(r["segment"] for r in own)
        assert [r["char_start"] for r in own] == [sum(len(x["segment"]) for x in own[:k]) for k in range(len(own))]
        for r in own:
            learned = whole[r["mask_start"] : r["mask_end"]]
            assert learned.endswith("<|im_end|>") if r["speaker"] == key[1] else learned == ""
    assert next(r for r in got if r["perspective"] == "ann" and r["speaker"] == "bob")["n_rows"] == 2
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def brute_classes(rows):
    words = {d: re.findall(r"[^\W_]+", (t or "").lower()) for d, t in rows}
    sets = {d: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for d, w in words.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            union = len(sets[a] | sets[b])
            if a < b and (len(sets[a] & sets[b]) >= 0.8 * union):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def test_near_duplicates(spark, docs, odd, empty):
    base = "one two three four five six seven eight nine ten".split()
    made = []
    for k in range(30):  # copies with a changed word each, some linked through others only
        words = [f"{w}{j}" for j in range(6) for w in base]
        words[k * 2 % 60] = f"changed{k}"
        made.append((10_000 + k, " ".join(words)))
    extra = spark.createDataFrame([*made, (20_000, ""), (20_001, None), (20_002, "two words"), (20_003, "Two, words!")], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(extra)
    want = brute_classes([(r["doc_id"], r["text"]) for r in df.collect()])
    got = {r["doc_id"]: r["class_id"] for r in dartminhash.near_duplicates(df).collect()}
    assert got == want
    assert dartminhash.near_duplicates(odd).count() == odd.count()
    assert dartminhash.near_duplicates(empty).count() == 0


def test_near_duplicates_of_repeated_passages(spark):
    """A passage once and many times: nearly the same shingles, however often each occurs."""
    rows = []
    for k in range(12):
        passage = " ".join(f"p{k}w{j}" for j in range(40))
        rows += [(2 * k, passage), (2 * k + 1, " ".join([passage] * (16, 64, 1000)[k % 3]))]
    got = {r["doc_id"]: r["class_id"] for r in dartminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows) == {d: d - d % 2 for d, _ in rows}


def test_near_duplicates_that_just_reach_the_similarity(spark):
    """28 shingles within 35, in buckets led by texts that are too far from both; 0.8 / 1.8 as a float would lose them."""
    rows = []
    for k in range(4):
        words = [f"f{k}w{j}" for j in range(39)]
        for at in range(4, 28):
            rows += [(len(rows) + n, " ".join([*words[:at], f"x{k}n{n}at{at}", *words[at + 1 : 32]])) for n in range(4)]
        rows += [(1_000_000 + 2 * k, " ".join(words[:32])), (1_000_001 + 2 * k, " ".join(words))]
    got = {r["doc_id"]: r["class_id"] for r in dartminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)
    assert all(got[1_000_001 + 2 * k] == got[1_000_000 + 2 * k] for k in range(4))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(1, 1 << 62, 400, dtype=np.uint64)
    b = np.concatenate([a[:320], rng.integers(1, 1 << 62, 80, dtype=np.uint64)])
    with np.errstate(over="ignore"):
        x, y = (dartminhash.darts(np.sort(s), np.ones(400), 2000) for s in (a, b))
        w = np.where(np.arange(400) < 200, 1.0, 1.75)
        p, q = dartminhash.darts(a, w, 2000), dartminhash.darts(a[:200], w[:200], 2000)
    assert abs((x == y).mean() - 320 / 480) < 0.05
    assert abs((p == q).mean() - 200 / 550) < 0.05


def test_language(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    rows = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95
    got = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert all(got[k]["lang_pred"] == "und" and not got[k]["accepted"] for k in (0, 1, 2)) and got[9]["lang_pred"] in model.languages
    assert langid.predict(odd, langid.fit(empty)).where("lang_pred <> 'und'").count() == 0


def test_toxicity(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = toxicity.predict(docs, model).join(labels, "doc_id").where("held_out").select("score", "toxic", "predicted").collect()
    bad, good = (np.array([r["score"] for r in rows if r["toxic"] == k]) for k in (1, 0))
    assert (bad[:, None] > good[None, :]).mean() > 0.85
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.9
    got = toxicity.predict(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    blank = toxicity.fit(empty, labels.limit(0))
    assert toxicity.predict(odd, blank).where("predicted = 1").count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns and 0 < kept.count() <= before.count(), name
    assert all(c == d for d, c in brute_classes([(r["doc_id"], r["text"]) for r in kept.collect()]).items())
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in kept.collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    import compare

    assert compare.compare(spark, SF, [name]) == []


def test_no_cross_imports():
    from pathlib import Path

    root = Path(queries.__file__).resolve().parents[1]
    assert not [p for p in root.rglob("*.py") if p.parent.name != "llm" and re.search(r"^\s*(from|import) .*\bllm\b", p.read_text(), re.M)]
    assert json.dumps(sorted(queries.queries()))
