"""Incremental sync: a listing against a registry, and what to do with the difference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def diff(listing: DataFrame, registry: DataFrame) -> DataFrame:
    """(source_id, action, refresh): add, skip, update or delete.

    Both have source_id, cheap_hash, content_hash. Equal cheap hashes skip without a look at the content; equal contents
    skip and refresh the cheap hash.
    """
    l, r = listing.alias("l"), registry.alias("r")
    rows = l.join(r, F.col("l.source_id") == F.col("r.source_id"), "full")
    cheap, same = F.col("l.cheap_hash") == F.col("r.cheap_hash"), F.col("l.content_hash") == F.col("r.content_hash")
    action = F.when(F.col("r.source_id").isNull(), "add").when(F.col("l.source_id").isNull(), "delete").when(cheap, "skip").when(same, "skip").otherwise("update")
    refresh = F.col("r.source_id").isNotNull() & F.col("l.source_id").isNotNull() & ~F.coalesce(cheap, F.lit(False)) & F.coalesce(same, F.lit(False))
    return rows.select(F.coalesce("l.source_id", "r.source_id").alias("source_id"), action.alias("action"), refresh.alias("refresh"))


def apply_chunks(chunks: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks after the sync: those of changed and gone sources out, the new ones in."""
    out = changes.where(F.col("action").isin("update", "delete")).select("source_id")
    return chunks.join(out, "source_id", "left_anti").unionByName(fresh)


def upsert_registry(registry: DataFrame, listing: DataFrame, changes: DataFrame, counts: DataFrame) -> DataFrame:
    """The registry after the sync: gone sources out, hashes and leaf counts renewed, an old title kept when the new one is null.

    Both tables have ``extra``, a map: what a listing brings is put over what was there, but for sources that were skipped by their cheap hash.
    """
    rows = changes.where("action <> 'delete'").join(listing.select("source_id", "cheap_hash", "content_hash", F.col("title").alias("new_title"), F.col("extra").alias("new_extra")), "source_id")
    rows = rows.join(registry.select("source_id", F.col("title").alias("old_title"), F.col("chunk_count").alias("old_count"), F.col("extra").alias("old_extra")), "source_id", "left").join(counts, "source_id", "left")
    changed, looked = F.col("action").isin("add", "update"), F.col("action").isin("add", "update") | F.coalesce("refresh", F.lit(False))
    extra = F.when(looked, merged(F.col("old_extra"), F.col("new_extra"))).otherwise(F.col("old_extra"))
    return rows.select("source_id", "cheap_hash", "content_hash", F.coalesce("new_title", "old_title").alias("title"), F.when(changed, F.coalesce("chunk_count", F.lit(0))).otherwise(F.coalesce("old_count", F.lit(0))).alias("chunk_count"), extra.alias("extra"))


def merged(old: Column, new: Column) -> Column:
    """Both maps; of a key that both have, the new value."""
    none = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, none), F.coalesce(new, none)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


CLEANING = ("pii_redactions", "low_info_dropped", "dedup_dropped")


def summary(changes: DataFrame, cleaned: DataFrame) -> DataFrame:
    """One row: added, updated, skipped, deleted, errors, and the sums of what cleaning counted.

    ``cleaned`` (source_id, error, pii_redactions, low_info_dropped, dedup_dropped) tells of the documents that were read; one
    with an error is neither added nor updated, and adds nothing to the sums.
    """
    rows = changes.join(cleaned, "source_id", "left")
    read = F.col("action").isin("add", "update")
    good, bad = read & F.col("error").isNull(), read & F.col("error").isNotNull()
    counts = [F.count_if(c).alias(n) for c, n in ((good & (F.col("action") == "add"), "added"), (good & (F.col("action") == "update"), "updated"), (F.col("action") == "skip", "skipped"), (F.col("action") == "delete", "deleted"), (bad, "errors"))]
    return rows.agg(*counts, *(F.coalesce(F.sum(F.when(good, F.col(c))), F.lit(0)).cast("long").alias(c) for c in CLEANING))


def documents_listing(chunks: DataFrame) -> DataFrame:
    """(source_id, title, file_name, section_count, char_count) of chunks (source_id, ord, source_path, title, text); names come from the first chunk."""
    name = F.when(F.coalesce(F.col("source_path"), F.lit("")) == "", F.col("source_id")).otherwise(F.element_at(F.split("source_path", "/"), -1))
    first = F.min_by(F.struct("title", name.alias("file_name")), "ord").alias("x")
    return chunks.groupBy("source_id").agg(first, F.count("*").alias("section_count"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("char_count")).select("source_id", "x.*", "section_count", "char_count")


def region_chunks(replies: DataFrame, key: str, reply: str) -> DataFrame:
    """(key, region_type, body, ord): the regions of a layout reply as chunks, and with order -1 their parent, all their bodies.

    A table is its Markdown, or its text; a figure its caption and code its text behind a label; a title a heading; anything else its
    text. Regions without a body are left out, but keep their numbers; no regions, no parent.
    """
    kind = "regions array<struct<type:string,text:string,markdown:string,language:string>>"
    rows = replies.select(key, F.posexplode(F.from_json(F.col(reply), kind)["regions"]).alias("ord", "r"))
    of, text = F.lower(F.coalesce("r.type", F.lit("text"))), F.coalesce("r.text", F.lit(""))
    table = F.when(F.coalesce("r.markdown", F.lit("")) != "", F.col("r.markdown")).otherwise(text)
    body = (
        F.when(of == "table", table).when(of == "figure", F.concat(F.lit("[Figure] "), text)).when(of == "code", F.concat(F.lit("[Code:"), F.coalesce("r.language", F.lit("")), F.lit("]\n"), text))
        .when(of == "title", F.concat(F.lit("# "), text)).otherwise(text)
    )
    leaves = rows.select(key, of.alias("region_type"), T.trimmed(body).alias("body"), "ord").where("body <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "body"))), lambda x: x["body"]), "\n\n")
    return leaves.unionByName(leaves.groupBy(key).agg(joined.alias("body")).select(key, F.lit("image_page").alias("region_type"), "body", F.lit(-1).alias("ord")))
