"""Near-duplicates by SimHash: an inverted index on the bytes of fingerprints, counts of shared bytes, verified bits.

A fingerprint is eight bytes. Two that differ in at most two bits share the bytes of at least six positions: six
is the count that a pair must reach. The index lists fingerprints by the bytes they hold at sets of positions. The
eight positions are four groups of two, and two bits spoil two groups at most, so a pair meets in one of the
six lists of two whole groups. In a list the shared positional bytes of each pair are tallied; pairs with six or
more are verified by their bits.

A list of more than ``LONG`` fingerprints is not tallied. Its fingerprints are listed anew under the 28 sets of six
positions, where whoever meets has reached the count; only two bytes are left to differ, so such a list is short
of 65,537 different fingerprints by construction, and those within two bits of each other are looked up in a table
of these two bytes. So no list is without bound, no pair is left out, and the work grows with the lists.

Texts of one fingerprint are one entry of the index. Each list hands on at most one link for each of its members, by
which the links it found are connected; classes are then joined over the shared folder.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, parts, stored
from .dartminhash import components

SEED, WORDS, DISTANCE, LONG = 42, 3, 2, 256
SPACE = re.compile(rb"[ \t-\r]")
GROUPS = [(0, 1), (2, 3), (4, 5), (6, 7)]
BLOCKS = [a + b for a, b in itertools.combinations(GROUPS, 2)]
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)  # of each byte value
SIXES = list(itertools.combinations(range(8), 8 - DISTANCE))


def mask(positions: tuple[int, ...]) -> int:
    """The bits of some byte positions, as a signed 64-bit integer."""
    bits = sum(0xFF << 8 * p for p in positions)
    return bits - (1 << 64) if bits >> 63 else bits


def word_lists(raw: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, about ``size`` bytes of it at a time."""
    start = 0
    while start < len(raw):
        stop = start + size
        cut = SPACE.search(raw, stop) if stop < len(raw) else None
        stop = cut.start() if cut else len(raw)
        yield raw[start:stop].split()
        start = stop


def fingerprint(raw: bytes) -> int:
    """Bit by bit the majority of the hashes of all runs of three words; a tie is 0, and so is a text without words."""
    import xxhash

    counts, total, before = np.zeros((8, 256), np.int64), 0, []
    at = np.arange(8) * 256
    for words in word_lists(raw.lower()):  # of bytes, lower() turns A to Z only
        words = before + words
        runs = map(b" ".join, zip(*(words[k:] for k in range(WORDS))))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, runs, itertools.repeat(SEED)), np.uint64)
        counts += np.bincount((hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + at).ravel(), minlength=2048).reshape(8, 256)
        total += len(hashes)
        before = words[1 - WORDS :]
    if not total and before:
        return fingerprint_of([xxhash.xxh64_intdigest(b" ".join(before), SEED)])
    return int(np.packbits((counts @ BITS).ravel() * 2 > total, bitorder="little").view("<i8")[0])


def fingerprint_of(hashes: list[int]) -> int:
    """The fingerprint of a single hash is the hash; signed."""
    return int(np.array(hashes, np.uint64).astype("<u8").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) of every whole text; a null text is empty."""
    importable(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            found = [fingerprint(raw) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def settled(label: np.ndarray, lower) -> np.ndarray:
    """Labels taken from neighbours by ``lower`` until nothing changes: the least index that each entry is connected with."""
    while True:
        new = lower(label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def tallied(prints: np.ndarray) -> np.ndarray:
    """For each fingerprint of a list the index of the first it is connected with, by pairs that share six bytes and differ in two bits at most."""
    held = prints.view(np.uint8).reshape(-1, 8)
    shared = sum((held[:, None, p] == held[None, :, p]).astype(np.int8) for p in range(8))
    a, b = np.nonzero(shared >= 8 - DISTANCE)
    near = np.bitwise_count((prints[a] ^ prints[b]).view(np.uint64)) <= DISTANCE
    a, b = a[near], b[near]

    def lower(label: np.ndarray) -> np.ndarray:
        out = label.copy()
        np.minimum.at(out, a, label[b])
        return out

    return settled(np.arange(len(prints)), lower)


FLIPS = [sum(1 << k for k in some) for n in range(1, DISTANCE + 1) for some in itertools.combinations(range(16), n)]


def looked_up(prints: np.ndarray, free: tuple[int, int]) -> np.ndarray:
    """As ``tallied``, for different fingerprints that share all bytes but those at the two ``free`` positions."""
    held = prints.view(np.uint8).reshape(-1, 8)
    rest = held[:, free[0]].astype(np.int64) << 8 | held[:, free[1]]
    place = np.full(1 << 16, -1, np.int64)
    place[rest] = np.arange(len(rest))

    def lower(label: np.ndarray) -> np.ndarray:
        out = label.copy()
        for flip in FLIPS:
            at = place[rest ^ flip]
            out = np.where(at >= 0, np.minimum(out, label[at]), out)
        return out

    return settled(np.arange(len(rest)), lower)


def lists_of(prints: DataFrame, positions: list[tuple[int, ...]]) -> DataFrame:
    """(list_no, key, fp): each fingerprint in the list of each set of positions."""
    held = [F.struct(F.lit(k).cast("int").alias("list_no"), F.col("fp").bitwiseAND(F.lit(mask(p)).cast("long")).alias("key")) for k, p in enumerate(positions)]
    return prints.select(F.explode(F.array(*held)).alias("x"), "fp").select("x.list_no", "x.key", "fp")


def links_in(lists: DataFrame, positions: list[tuple[int, ...]]) -> DataFrame:
    """(a, b) of lists (list_no, key, fp) of bounded length."""
    free = [tuple(sorted(set(range(8)) - set(p))) for p in positions]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for k, prints in zip(batch.column(0).to_pylist(), batch.column(1)):
                prints = np.sort(prints.values.to_numpy().astype("<i8"))
                first = tallied(prints) if len(prints) <= LONG else looked_up(prints, free[k])
                linked = first != np.arange(len(prints))
                a.append(prints[linked])
                b.append(prints[first[linked]])
            a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return lists.groupBy("list_no", "key").agg(F.collect_list("fp").alias("prints")).where("size(prints) > 1").select("list_no", "prints").mapInArrow(run, "a long, b long")


def classes(prints: DataFrame) -> DataFrame:
    """(fp, component_id) of the different fingerprints of ``prints`` (doc_id, fp)."""
    one = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    entries = lists_of(one, BLOCKS)
    sizes = entries.groupBy("list_no", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(entries.join(sizes, ["list_no", "key"]), "lists")
    links = links_in(met.where(F.col("n") <= LONG), BLOCKS)
    crowded = stored(met.where(F.col("n") > LONG).select("fp").distinct(), "crowded")
    links = links.unionByName(links_in(lists_of(crowded, SIXES), SIXES))
    labels = components(links)
    known = one.join(labels.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    return known.join(known.groupBy("label").agg(F.min("first").alias("component_id")), "label").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each of ``docs``.

    ``fingerprint`` is 16 lowercase hex digits; those that differ in two bits at most are linked, and ``component_id`` is
    the smallest doc_id that a row is connected with, itself included. Null and blank texts have fingerprint zero, which
    links as any other. A null id is never the smallest; where all are null, so is the component. Repeated rows
    are repeated.
    """
    prints = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    names = stored(classes(prints), "classes")
    return prints.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
