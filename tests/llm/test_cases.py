"""Whole queries against plain recomputation, and cases that each operator names: repeated ids, null ids, faults, limits, clashing names."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import chat, dartminhash, editcount, exact, langid, licenses, media, packing, queries, toxicity

SF = "/root/testdata/sf0.001"
CLASH = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, accepted boolean, whole_text string, dropped_id long, _score int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def plain(text):
    return re.sub(r"[\W\d_]+", " ", text.lower()).encode()


def zstd_size(dictionary, data, hash_log, search_log, window_log):
    import zstandard as z

    params = z.ZstdCompressionParameters(window_log=window_log, hash_log=hash_log, chain_log=hash_log, search_log=search_log, min_match=4, target_length=16, strategy=z.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
    return len(z.ZstdCompressor(compression_params=params, dict_data=z.ZstdCompressionDict(dictionary, dict_type=z.DICT_TYPE_RAWCONTENT)).compress(data))


def test_toxicity_scores_by_hand(spark, docs):
    """Every score again from the dictionaries and weights: windows cut at spaces, sizes, sums, the curve."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels, settings=toxicity.Settings(base_bytes=8192, side_bytes=(1024, 2048)))
    got = {r["doc_id"]: r for r in toxicity.predict(docs, model).collect()}
    lead = bytes(range(128, 224))
    for r in docs.orderBy("n_chars").limit(40).collect():
        text, gains = plain(r["text"]), []
        while True:
            cut = len(text)
            if cut > 64:
                cut = text.rfind(b" ", 32, 64)
                cut = 64 if cut <= 0 else cut
            window, text = lead + text[:cut], text[cut:]
            gains.append(zstd_size(model.ordinary, window, 15, 6, 17) - zstd_size(model.toxic, window, 15, 6, 17))
            if not text:
                break
        n, total = len(gains), sum(max(0, g - 1) for g in gains)
        x = [1, max(gains), sum(sorted(gains)[-3:]), math.log1p(total), total / n, total / math.sqrt(n), math.log(n)]
        want = 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(x, model.weights))))))
        own = got[r["doc_id"]]
        assert abs(own["score"] - want) < 1e-9 and own["predicted"] == int(want >= 0.3)
        assert own["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_toxicity_learns_both_sides(spark):
    """Words that only toxic rows hold are told from the others; the dictionaries come from zstandard's trainer."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    common = [word() for _ in range(300)]
    rows = []
    for k in range(900):
        words = list(rng.choice(common, 80))
        if k % 3 == 0:
            for at in range(5, 80, 9):
                words[at] = ("zzvileword", "qqnastything", "xxhorrid")[at % 3]
        rows.append((k, " ".join(words), int(k % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df, settings=toxicity.Settings(base_bytes=4096, side_bytes=(1024,)))
    got = toxicity.predict(df, model).join(df.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.95
    pieces = (b"vilew", b"nasty", b"xhorr")
    assert any(p in model.toxic for p in pieces) and not any(p in model.ordinary for p in pieces)


def test_language_by_hand(spark, docs):
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    lead = bytes(range(128, 224))
    for r in docs.orderBy("n_chars").limit(40).collect():
        text = plain(r["text"])
        sizes = [sum(zstd_size(d, lead + text[k : k + 1024], 15, 4, 18) for k in range(0, len(text), 1024)) for d in model.dictionaries]
        own = got[r["doc_id"]]
        assert sizes[model.languages.index(own["lang_pred"])] == min(sizes)
        low, second = sorted(sizes)[:2]
        assert abs(own["margin"] - (second - low) / second) < 1e-12 and own["accepted"] == ((second - low) / second >= 0.002)


def test_language_learns_every_language_from_whole_texts(spark):
    rows = [(i, f"w{lang}x " * 200 + f"tail{lang}end " * 200, f"l{lang}") for lang in range(230) for i in (3 * lang, 3 * lang + 1, 3 * lang + 2)]
    rows = [(i, re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], t), lang) for i, t, lang in rows]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 230 and sum(b"tail" in d for d in model.dictionaries) == 230


def test_matroska_query_by_hand(spark, docs):
    got = {r["doc_id"]: r for r in queries.op2_matroska(spark, SF).collect()}
    for r in docs.collect():
        raw, own = (r["text"] or "").encode(), got[r["doc_id"]]
        body = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (own["n_bytes"], own["payload_bytes"], own["payload_sha256"], own["tail_crc32"]) == (len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]))
        data = media.write_samples(body)
        assert (own["media_bytes"], own["media_sha256"]) == (len(data), hashlib.sha256(data).hexdigest())
        assert own["feature"].startswith(f"packets={-(-len(body) // 2048)} mean={np.frombuffer(body, np.uint8).mean():.4f} peak={max(body)} ")
        assert [p["length"] for p in own["packets"]] == [len(body[k : k + 2048]) for k in range(0, len(body), 2048)]
        assert b"".join(data[p["offset"] : p["offset"] + p["length"]] for p in own["packets"]) == body
        assert [p["time_ns"] // 1_000_000 for p in own["packets"] if p["frame"] == 0] == [k * 1000 // 8000 for k in range(0, len(body), 8192)]
        assert {p["track"] for p in own["packets"]} == {1} and own["tracks"][0]["codec"] == "A_PCM/INT/LIT"
        assert len(own["cues"]) == -(-len(body) // 32768) and own["lost_cues"] == 0 and own["error"] is None
        assert {c["offset"] for c in own["cues"]} == {p["cluster_offset"] for p in own["packets"]}


def test_matroska_faults(spark):
    head = media.element(media.EBML, b"") + media.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7
    deep = b""
    for _ in range(3000):
        deep = media.element(media.BLOCK_GROUP, deep)
    far = media.element(media.INFO, media.number(media.TIMESTAMP_SCALE, 1 << 62)) + media.element(media.CLUSTER, media.number(media.TIMESTAMP, 1 << 40) + media.element(media.SIMPLE_BLOCK, b"\x81\0\0\x80abc"))
    lost = media.element(media.CUES, media.element(media.CUE_POINT, media.number(media.CUE_TIME, 1) + media.element(media.CUE_POSITIONS, media.number(media.CUE_CLUSTER, 9))))
    files = [None, b"", b"junk", head + deep, head + far, head + lost, media.write_samples(b"x" * 64)[:-3]]
    df = spark.createDataFrame([(k, 0, f) for k, f in enumerate(files)], "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r for r in media.payload_features(df).collect()}
    assert got[0]["error"] == "null" and got[0]["payload_bytes"] == 0 and "mean=-" in got[0]["feature"]
    assert got[1]["error"] and got[2]["error"] and "deep" in got[3]["error"] and "range" in got[4]["error"] and got[5]["lost_cues"] == 1 and got[6]["error"]
    assert media.read_matroska(df, payload=True).count() == len(files)


def test_packing_of_short_documents(spark):
    """Documents of few tokens fill sequences too; lengths are 2048 or powers of two, and all three limits bind."""
    df = spark.createDataFrame([(k, "a b c d") for k in range(6000)], "doc_id long, text string").coalesce(1)
    rows = packing.pack(df, prompt_share=packing.PROMPT_SHARE, limits=packing.DOCUMENTS).collect()
    sizes = {}
    for r in rows:
        sizes[r["sequence_id"]] = sizes.get(r["sequence_id"], 0) + r["length"]
    assert all(n & (n - 1) == 0 for n in sizes.values())
    assert sum(n for n in sizes.values() if n == 2048) >= 0.95 * sum(sizes.values())


@pytest.mark.parametrize("limits", [packing.DOCUMENTS, packing.Limits(256, 16, 100, pool=32), packing.Limits(256, 512, 256)])
def test_packing_loss_limit(spark, limits):
    rng = np.random.default_rng(5)
    rows = [(k, "word " * int(rng.integers(0, 900)), None if k % 3 else int(rng.integers(0, 400))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, prompt int").coalesce(2)
    got = packing.pack(df, loss_from_col="prompt", prompt_share=0.5, limits=limits).collect()
    own, seqs = {}, {}
    for r in got:
        own.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    for k, _, prompt in rows:
        n, at = own[k][0]["doc_tokens"], 0
        begin = prompt if prompt is not None else max(1, int(0.5 * n))
        for r in sorted(own[k], key=lambda r: r["start"]):
            assert r["start"] == at and r["loss_tokens"] == len(range(max(at, begin), at + r["length"]))
            at += r["length"]
        assert at == n
    for s in seqs.values():
        total = sum(r["length"] for r in s)
        assert total & (total - 1) == 0 and total <= limits.tokens and len(s) <= limits.segments and sum(r["loss_tokens"] for r in s) <= limits.loss_tokens


def test_near_duplicates_of_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (6, a + " more"), (7, b + " more"), (None, a), (None, c), (8, c), (None, "only null"), (9, a), (9, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = dartminhash.near_duplicates(df).collect()
    sizes = {(r["doc_id"], r["class_id"], r["class_hash"]): r["class_size"] for r in got}
    assert len({k[2] for k in sizes if k[1] == 5}) == 2 and {v for k, v in sizes.items() if k[1] == 5} == {5, 2}
    kept = sorted(dartminhash.keep_one(df).collect(), key=repr)
    assert kept == sorted([r for r in df.collect() if (r["doc_id"], r["text"]) in {(5, a), (5, b), (8, c), (None, "only null")}], key=repr)


def test_components_of_chains(spark):
    chain = [(k, k + 1) for k in range(200)] + [(1000 + (k * 7) % 101, 1000 + (k * 7 + 7) % 101) for k in range(100)] + [(3000, 3000 + k) for k in range(1, 50)]
    links = spark.createDataFrame(chain, "a long, b long")
    got = {r["id"]: r["label"] for r in dartminhash.components(links).collect()}
    assert all(v == (0 if k <= 200 else 1000 if k < 2000 else 3000) for k, v in got.items()) and len(got) == 201 + 101 + 50
    more = dartminhash.joined(dartminhash.components(links), spark.createDataFrame([(200, 1050), (3001, 5000)], "a long, b long"))
    assert {(r["id"], r["label"]) for r in more.collect()} == {(k, 0 if k < 2000 else 3000) for k in [*got, 5000]}


def test_later_batches_merge_into_the_level(spark, docs):
    first, later = docs.where("doc_id % 3 > 0"), docs.where("doc_id % 3 = 0")
    index = exact.append(exact.build(first), later)
    assert sorted(map(repr, exact.duplicates(index).collect())) == sorted(map(repr, exact.exact_dedup(docs).collect()))
    digest = exact.build(docs).level.where("n > 1").first()
    assert exact.lookup(index, [digest["digest"]]).first() == digest
    whole = exact.build(docs)
    assert set(map(repr, exact._maybe_hits(whole).collect())) >= set(map(repr, exact._maybe_hits(whole, most_bits=1).collect()))


def test_exact_null_ids(spark):
    df = spark.createDataFrame([(None, "same"), (3, "same"), (3, "same"), (4, "same "), (None, "own")], "doc_id long, text string")
    assert sorted(map(repr, exact.keep_first(df).collect())) == sorted(map(repr, df.where("doc_id = 3 OR text = 'own' OR doc_id = 4").collect()))


def test_licence_templates_and_filters(spark, docs):
    long = [" ".join(licenses.template_words(t)) for t in (licenses.TEMPLATES["bsd"][2], licenses.TEMPLATES["mit"][2], licenses.TEMPLATES["gpl-3"][2])]
    texts = ["filler words here " * 77 + long[0] + " and more", "x " * 31 + long[1], long[2].replace("hope", "wish").upper(), " ".join(long[0].split()[::2]), "y " * 31 + long[1]]
    df = spark.createDataFrame([*((k, t) for k, t in enumerate(texts)), (1, texts[1])], "doc_id long, text string")
    got = [(r["doc_id"], r["labels"]) for r in licenses.scan(df).orderBy("doc_id").collect()]
    assert got[0] == (0, "bsd") and got[1] == got[2] == (1, "mit") and "gpl-3" in got[3][1] and got[4] == (3, "")
    # the positional filter drops pairs that the prefix and length filters leave, and no match
    templates = {"t": ["a b c d e f g h i j"]}
    docs = [(k, "i j " + "z " * 3 + " ".join("abcdefgh"[k % 5 :])) for k in range(5)] + [(9, "c d e f g h i j q r s t a b"), (10, "j i h g f b d c a")]
    rows = licenses.word_rows(spark.createDataFrame(docs, "doc_id long, text string"), templates)
    for containment in (0.5, 0.7, 0.9):
        order, index = licenses.template_index(rows, templates, containment)
        loose, tight = (licenses.block_pairs(rows, order, index, positional=p) for p in (False, True))
        hits = lambda pairs: {(r["doc_id"], r["block"]) for r in pairs.collect() if len(set(r["have"]) & set(r["words"])) >= r["need"]}
        assert hits(loose) == hits(tight)
    sparse = spark.createDataFrame([(k, "a p0 p1 p2 p3") for k in range(3)] + [(k + 5, "b c d e f g h") for k in range(9)], "doc_id long, text string")
    rows = licenses.word_rows(sparse, {"t": ["a b c d e", "p0 p1 p2 p3 g"], "u": ["f g h a"]})
    order, index = licenses.template_index(rows, {"t": ["a b c d e", "p0 p1 p2 p3 g"], "u": ["f g h a"]}, 0.8)
    index = [t | {"need": t["need"]} for t in index]
    assert licenses.block_pairs(rows, order, index, positional=False).count() >= licenses.block_pairs(rows, order, index).count()


def test_edit_query(spark, docs):
    from tokenizers import Tokenizer

    from sparkloom.llm import bpe

    tok = Tokenizer.from_file(bpe.default_vocabulary())
    small = docs.where("n_chars < 3000").limit(30)
    index = editcount.build_index(small)
    edited = index.withColumn("edits", editcount.sample_edits(F.col("doc_id"), F.col("text"))).select("doc_id", F.col("text").alias("old"), "edits")
    want = {}
    for r in edited.collect():
        text = r["old"]
        for e in r["edits"]:
            pos = min(max(0, e["pos"]), len(text))
            text = text[:pos] + e["insert"] + text[pos + e["remove"] :]
        count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
        want[r["doc_id"]] = (count(r["old"]), count(text), hashlib.sha256(text.encode()).hexdigest(), len(editcount.leaf_starts(r["old"])))
    got = {r["doc_id"]: (r["tokens_before"], r["n_tokens"], r["text_sha256"], r["n_leaves"]) for r in queries.op4_edit_counts(spark, SF).collect()}
    assert all(got[k] == v for k, v in want.items())


def test_chat_of_one_hot_conversation(spark):
    """Equal, null and far turn numbers; offsets run on across ranges; markers and line breaks."""
    rows = [(1, None if k % 3 else (k % 2) << 40, ("ann", "b\nob", "system")[k % 3], f"text {k:04d}") for k in range(900)] + [(2, 0, "ann", "x <|im_end|>")]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    own = sorted((r for r in got if r["conv_id"] == 1 and r["perspective"] == "ann"), key=lambda r: r["position"])
    assert [r["position"] for r in own] == list(range(900))
    assert [r["char_start"] for r in own] == np.concatenate([[0], np.cumsum([len(r["segment"]) for r in own])[:-1]]).tolist()
    assert {r["segment"].split("\n")[0] for r in own if r["role"] == "user"} == {"<|im_start|>user name=b ob"}
    assert [r["has_marker"] for r in got if r["conv_id"] == 2] == [True]


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows, clashing names, an empty table, in every stage."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    values = lambda i, t: (i, t, "en", "s", 0, 0.5, 1, True, "x", 7, 1)
    some = [r["text"] for r in docs.limit(20).collect()]
    rows = [values(k, t) for k, t in enumerate(some)]
    rows += [values(100, None), values(None, None), values(101, ""), values(102, "long words " * 30000), values(3, some[3]), values(3, some[3]), values(None, some[4]), values(103, "12345 67")]
    odd = spark.createDataFrame(rows, CLASH)
    for table in (odd, odd.limit(0)):
        kept = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = kept.collect()
            kept = stage(spark, kept, SF)
            assert kept.columns == odd.columns, name
            kept = spark.createDataFrame(kept.collect(), CLASH)
            assert set(map(repr, kept.collect())) <= set(map(repr, before)), name
        packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
        assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in kept.collect()}
    assert odd.count() > 0
