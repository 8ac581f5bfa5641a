"""Syncs of folders and streams: changes only, bad documents beside good ones, replays, and files that are never opened."""

import os
import random

import pytest

from sparkloom.operators import kb
from sparkloom.sources import files
from sparkloom.streaming import streams

ARRIVED = "source_id string, cheap_hash string, title string, extra map<string,string>, gone boolean, content binary"


def write(path, text, mtime=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    if mtime:
        os.utime(path, (mtime, mtime))


def state(store):
    registry = {r["source_id"]: (r["cheap_hash"], r["content_hash"], r["title"], r["chunk_count"], dict(r["extra"])) for r in store.registry().collect()}
    chunks = {}
    for r in store.chunks().orderBy("source_id", "part").collect():
        chunks.setdefault(r["source_id"], []).append(r["text"])
    return registry, chunks


def test_listing_opens_nothing(spark, tmp_path):
    write(tmp_path / "a b.md", "# A\n\none")
    write(tmp_path / "deep" / "er" / "B.HTML", "<p>two")
    write(tmp_path / "c.bin", "three")
    write(tmp_path / "none", "four")
    found = files.listing(spark, str(tmp_path), "kb")
    assert "content" not in found._jdf.queryExecution().executedPlan().toString()
    rows = {r["title"]: r for r in found.collect()}
    assert {(t, r["suffix"], r["bytes"]) for t, r in rows.items()} == {("a b", ".md", 8), ("B", ".html", 6)}
    assert len({r["source_id"] for r in rows.values()}) == 2 and rows["B"]["cheap_hash"].endswith(":6")


def test_contents_of_named_files_only(spark, tmp_path):
    for k in range(7):
        write(tmp_path / f"d {k}.md", f"text {k}")
    found = files.listing(spark, str(tmp_path), "kb").where("title IN ('d 1', 'd 4', 'd 6')")
    for block in (2, 10_000):
        got = files.contents(found, block)
        assert sorted(os.path.basename(f).replace("%20", " ") for f in got.inputFiles()) == ["d 1.md", "d 4.md", "d 6.md"]
        assert sorted(bytes(r["content"]) for r in got.collect()) == [b"text 1", b"text 4", b"text 6"]
    assert files.contents(found.limit(0)).count() == 0


def test_folder_synced_again_and_again(spark, tmp_path, monkeypatch):
    root, store = tmp_path / "src", kb.Store(spark, str(tmp_path / "kb")).create()
    opened, real = [], files.contents
    monkeypatch.setattr(files, "contents", lambda rows, *a: opened.append(sorted(r["title"] for r in rows.collect())) or real(rows, *a))
    write(root / "a.md", "# Alpha\n\nabout cats", 1000)
    write(root / "b.md", "# Bravo\n\nabout dogs", 1000)
    write(root / "bad.md", b"\xff\xfe no text", 1000)
    run = lambda n: tuple(kb.sync_folder(store, n, str(root), "kb").first())  # noqa: E731 added, updated, skipped, deleted, errors
    assert run(0) == (2, 0, 0, 0, 1)
    assert sorted(t for c in state(store)[1].values() for t in c) == ["# Alpha", "# Bravo", "about cats", "about dogs"]
    os.utime(root / "a.md", (2000, 2000))  # touched, same bytes: skipped, and not looked at again
    assert run(1) == (0, 0, 2, 0, 1) and run(2) == (0, 0, 2, 0, 1)
    write(root / "a.md", "# Alpha\n\nNEW\n\nlonger", 3000)
    (root / "b.md").unlink()
    write(root / "bad.md", "mended", 3000)
    assert run(3) == (1, 1, 0, 1, 0)
    assert opened == [["a", "b", "bad"], ["a", "bad"], ["bad"], ["a", "bad"]]
    registry, chunks = state(store)
    assert sorted(t for c in chunks.values() for t in c) == ["# Alpha", "NEW", "longer", "mended"]
    assert sorted((r[2], r[3]) for r in registry.values()) == [("a", 3), ("bad", 1)]
    before = state(store)
    assert run(3) == (1, 1, 0, 1, 0) and state(store) == before  # a batch that runs again changes nothing
    new = store.compact(4)
    assert {s: (*r[:4], c) for (s, r), c in zip(sorted(state(new)[0].items()), [c for _, c in sorted(state(new)[1].items())])} == {s: (*r[:4], chunks[s]) for s, r in registry.items()}


def loop(batches):
    """The sync told document by document; (registry, chunks, errors)."""
    import hashlib

    registry, chunks, errors = {}, {}, []
    for batch in batches:
        rows = {}
        for r in batch:
            rows.setdefault(r[0], r)
        for source, cheap, title, extra, gone, content in rows.values():
            old = registry.get(source)
            if gone:
                registry.pop(source, None), chunks.pop(source, None)
                continue
            if old and cheap and old[0] == cheap:
                continue
            digest = None if content is None else hashlib.sha256(content).hexdigest()
            if content is not None and old and old[1] == digest:
                registry[source] = (cheap, *old[1:4], {**old[4], **(extra or {})})
                continue
            try:
                text = content.decode()
            except (UnicodeDecodeError, AttributeError):
                errors.append(source)
                continue
            parts = [p.strip() for p in text.split("\n\n") if p.strip()]
            registry[source] = (cheap, digest, title or (old[2] if old else None), len(parts), {**(old[4] if old else {}), **(extra or {})})
            chunks[source] = parts
    return registry, {s: c for s, c in chunks.items() if c}, errors


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_of_changes(spark, tmp_path, seed):
    rnd = random.Random(seed)
    batches = []
    for b in range(4):
        rows = []
        for k in rnd.sample(range(25), 12):
            text = rnd.choice([b"one", b"one\n\ntwo", b"\n\n  \n\n", b"", b"\xff bad", None, f"v{b}\n\n{k}".encode()])
            rows.append((f"s{k}", rnd.choice([None, "h1", "h2", f"h{b}"]), rnd.choice([None, f"t{b}"]), rnd.choice([None, {"b": str(b)}, {"x": str(k), "b": "0"}]), rnd.random() < 0.15, text))
        batches.append(rows)
    store = kb.Store(spark, str(tmp_path / "kb")).create()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, ARRIVED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k in (1, 3):  # the stream stops and goes on where it was
            stream = spark.readStream.schema(ARRIVED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            streams.sync_stream(store, stream)
    seen = store.rows("registry").where("batch >= 0").select("batch").distinct().count()
    registry, chunks, errors = loop(batches)
    assert state(store) == (registry, chunks) and seen == 4
    assert sorted(r["source_id"] for r in store.rows("errors").collect()) == sorted(errors)
    kb.sync_batch(store, 3, spark.createDataFrame(batches[3], ARRIVED))  # replayed
    assert state(store) == (registry, chunks)
    assert sorted(r["source_id"] for r in store.rows("errors").collect()) == sorted(errors)
