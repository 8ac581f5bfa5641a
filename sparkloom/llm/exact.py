"""Exact dedup by a log-structured merge index, with DataFrame functions only.

Memtables: each task digests the rows of its partition, and flushes them as one run: a Parquet file sorted
by digest, with a Bloom filter on the digest in the file. Texts stay behind; a run holds digests and ids.
Compaction merges runs, and an older level if there is one, into a sorted level that keeps, per digest, the smallest id
and the number of rows; map-side combining takes the heat out of groups of any size. ``append`` flushes a
later batch as new runs and merges them into the level; ``lookup`` probes a level by digest, where sorted files
and Bloom filters let the scan skip row groups.

A digest with more than one row is a hit, and hits get byte verification: a second pass over the table
keeps the rows whose digest may be a hit, which a bitmap filter tells without a shuffle, and groups them by digest and
text, so that equality is that of bytes. A digest that turns out to hold different texts falls apart into its
texts. The bitmap has sixteen bits per hit, up to 32 MB; beyond that many hits a join by digest takes its place.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, stored, unused

#: Bits of the bitmap filter of hit digests, at least and at most (2^28 bits are 32 MB), and for each hit.
LEAST_BITS, MOST_BITS, BITS_PER_HIT = 1 << 20, 1 << 28, 16
#: A digest with at least this share of all rows is joined by broadcast; there are at most 1 / share of them.
HEAVY_SHARE = 1 / 500


def normalised(text: Column | str) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def _digest(text: Column, bits: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, bits // 4)


def _slot(digest: Column, bits: int) -> Column:
    """A place in a bitmap filter of so many bits, from 1 as the bitmap functions count."""
    return F.pmod(F.xxhash64(digest), F.lit(bits)) + 1


@dataclasses.dataclass
class Index:
    runs: DataFrame  # digest, doc_id: a sorted file per memtable
    level: DataFrame  # digest, keep_id, n: sorted, one row per digest
    docs: DataFrame
    digest_bits: int


def flush(docs: DataFrame, digest_bits: int = 256) -> DataFrame:
    """Sorted runs (digest, doc_id) of ``docs`` (doc_id, text)."""
    runs = docs.select(_digest(normalised("text"), digest_bits).alias("digest"), "doc_id").sortWithinPartitions("digest", "doc_id")
    return stored(runs, "runs", **{"parquet.bloom.filter.enabled#digest": "true"})


def compact(runs: DataFrame, level: DataFrame | None = None) -> DataFrame:
    """One sorted level (digest, keep_id, n) of the runs and an older level."""
    if level is None:
        merged = runs.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    else:
        entries = level.unionByName(runs.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n")))
        merged = entries.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    return stored(merged.sortWithinPartitions("digest"), "level", **{"parquet.bloom.filter.enabled#digest": "true"})


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256) -> Index:
    docs = id_and_text(docs, id_col, text_col)
    runs = flush(docs, digest_bits)
    return Index(runs, compact(runs), docs, digest_bits)


def append(index: Index, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index with a later batch: its memtables are flushed as runs and merged into the level; older runs stay as they are."""
    docs = id_and_text(docs, id_col, text_col)
    runs = flush(docs, index.digest_bits)
    return Index(index.runs.unionByName(runs), compact(runs, index.level), index.docs.unionByName(docs), index.digest_bits)


def lookup(index: Index, digests: list[str]) -> DataFrame:
    """(digest, keep_id, n) of the given digests, at most a few thousand, from the level; filters skip row groups without them."""
    return index.level.where(F.col("digest").isin(digests))


def _maybe_hits(index: Index, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, digest, norm) of the rows whose digest may be a hit; without a shuffle while a bitmap can tell them."""
    hits = index.level.where("n > 1").select("digest")
    norm = normalised("text")
    rows = index.docs.select("doc_id", _digest(norm, index.digest_bits).alias("digest"), norm.alias("norm"))
    bits = max(LEAST_BITS, 1 << (BITS_PER_HIT * hits.count()).bit_length())
    if bits > most_bits:
        return rows.join(hits.hint("merge"), "digest", "left_semi").select("doc_id", "digest", "norm")
    slots = hits.select(_slot(F.col("digest"), bits).alias("slot"))
    bitmap = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    at = F.bitmap_bit_position("slot")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("slot", _slot(F.col("digest"), bits)).join(F.broadcast(bitmap), F.bitmap_bucket_number("slot") == F.col("bucket"))
    return found.where(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1).select("doc_id", "digest", "norm")


def classes(index: Index) -> tuple[DataFrame, bool]:
    """((digest, text_sha256, keep_id, group_size) of the verified hits, whether a digest holds different texts)."""
    by_text = _maybe_hits(index).groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    hits = stored(by_text.select("digest", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"), "hits")
    mixed = hits.groupBy("digest").count().where("count > 1").limit(1).count() > 0
    return hits, mixed


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each of ``docs``.

    Texts are equal when identical after each run of white space is one space; null is empty. The
    smallest id of a group stays; rows that share it are kept alike, so repeated rows stay together. A null id is larger than any; a group
    of null ids keeps them. Other columns are not read. ``digest_bits`` below 256 only weakens the
    digest (tests use it to force collisions); the result stays the same.
    """
    return duplicates(build(docs, id_col, text_col, digest_bits))


def duplicates(index: Index) -> DataFrame:
    """What ``exact_dedup`` gives, for all rows that an index holds."""
    digest_bits = index.digest_bits
    hits, mixed = classes(index)
    if mixed or digest_bits < 256:  # different texts may share a digest: tell rows apart by the full hash of the text
        rows = index.docs.select("doc_id", F.sha2(normalised("text"), 256).alias("key"))
    else:
        rows = index.runs.select("doc_id", F.col("digest").alias("key"))
    rows = rows.withColumn("text_sha256", F.col("key"))
    hits = hits.select(F.col("text_sha256").alias("key"), "keep_id", "group_size")
    hits = hits.where("group_size > 1")
    least = F.greatest(F.lit(2.0), F.lit(max(1, index.runs.count()) * HEAVY_SHARE))
    heavy, light = hits.where(F.col("group_size") >= least), hits.where(F.col("group_size") < least)
    found = rows.join(F.broadcast(heavy), "key")
    rest = rows.join(F.broadcast(heavy.select("key")), "key", "left_anti").join(light, "key", "left")
    out = found.select("doc_id", "keep_id", "group_size", "text_sha256").unionByName(rest.select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "text_sha256"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with their own columns; a row of null id goes where a known id stays.

    Dropped rows are few or many: the join is by key, not by broadcast.
    """
    names = [unused(docs, n) for n in ("dropped_id", "dropped_hash")]
    dropped = exact_dedup(docs, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias(names[0]), F.col("text_sha256").alias(names[1])).distinct()
    own = F.sha2(normalised(F.coalesce(docs[text_col], F.lit(""))), 256)
    return docs.join(dropped, docs[id_col].eqNullSafe(F.col(names[0])) & (own == F.col(names[1])), "left_anti")


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
