"""A knowledge base that is synced again and again: documents against a registry, in numbered batches.

A batch writes only what it changes, into folders of its own number; what it reads are the batches before it. So a batch that
runs again, after a failure or by a stream's replay, overwrites its own folders with the same rows. The registry is, for each
source, the row of its last batch; its chunks are those that this row's batch wrote. Now and then the batches so far can be
put together (``compact``).
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from . import chunk
from .sync import merged

REGISTRY = "source_id string, cheap_hash string, content_hash string, title string, chunk_count long, extra map<string,string>, chunk_batch long, action string, gone boolean"
TABLES = {"registry": REGISTRY, "chunks": "source_id string, part int, text string", "errors": "source_id string, content_hash string, error string"}
ARRIVED = ("source_id", "cheap_hash", "title", "extra", "gone", "content")


def decoded(content: bytes, suffix: str) -> str:
    """The default parser: UTF-8, or an error."""
    return content.decode("utf-8-sig")


@dataclasses.dataclass(frozen=True)
class Store:
    """The folders of a knowledge base below ``path``, in a file system that driver and executors share."""

    spark: SparkSession
    path: str

    def create(self) -> Store:
        for name, schema in TABLES.items():
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.path}/{name}/batch=-1")
        return self

    def write(self, name: str, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}/batch={batch}")

    def rows(self, name: str, before: int | None = None) -> DataFrame:
        """All rows of a table with their ``batch``, of the batches before one."""
        rows = self.spark.read.schema(TABLES[name] + ", batch long").parquet(f"{self.path}/{name}")
        return rows if before is None else rows.where(F.col("batch") < before)

    def registry(self, before: int | None = None) -> DataFrame:
        """The sources that are there, each by its last row."""
        rows = self.rows("registry", before)
        columns = [c for c in rows.columns if c not in ("source_id", "batch")]
        last = rows.groupBy("source_id").agg(F.max_by(F.struct(*columns), "batch").alias("x")).select("source_id", "x.*")
        return last.where("NOT gone").drop("gone")

    def chunks(self, before: int | None = None) -> DataFrame:
        """(source_id, part, text) of the sources that are there, none that a later batch has replaced."""
        held = self.registry(before).select("source_id", F.col("chunk_batch").alias("batch"))
        return self.rows("chunks", before).join(held, ["source_id", "batch"]).select("source_id", "part", "text")

    def compact(self, batch: int) -> Store:
        """The state before ``batch``, as the one batch -1 of a new store beside this one."""
        new = Store(self.spark, f"{self.path}-{batch}")
        new.write("registry", self.registry(batch).withColumn("chunk_batch", F.lit(-1).cast("long")).withColumn("gone", F.lit(False)), -1)
        new.write("chunks", self.chunks(batch), -1)
        new.write("errors", self.rows("errors", batch).drop("batch"), -1)
        return new


def parsed(rows: DataFrame, parse: Callable[[bytes, str], str]) -> DataFrame:
    """(source_id, text, error) of rows (source_id, suffix, content): one document that a parser refuses does not stop the others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, errors = [], []
            for content, suffix in zip(pdf["content"], pdf["suffix"]):
                try:
                    texts.append(parse(bytes(content), suffix or ""))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 it is recorded with the document
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            yield pd.DataFrame({"source_id": pdf["source_id"], "text": texts, "error": errors})

    return rows.mapInPandas(run, "source_id string, text string, error string")


def sync_batch(store: Store, batch: int, arrived: DataFrame, parse: Callable[[bytes, str], str] = decoded, pieces: Callable[[Column], Column] = chunk.paragraphs) -> None:
    """Bring documents into the store: (source_id, cheap_hash, title, extra, gone, content), one row each.

    Equal cheap hashes skip, whatever the content. Equal contents skip and renew the cheap hash and ``extra``. What
    is new or changed is parsed and cut into chunks that replace the old; what is gone leaves with its chunks. A document without
    content, or that ``parse`` refuses, goes to ``errors`` and leaves the registry as it was, so that the next sync tries it
    again. Of several rows of one source the greatest counts. A batch run twice changes nothing. Sources of null id are left out.
    """
    one = arrived.where("source_id IS NOT NULL").groupBy("source_id").agg(F.max(F.struct(F.coalesce("gone", F.lit(False)).alias("gone"), "cheap_hash", "title", F.sha2("content", 256).alias("content_hash"), F.to_json("extra").alias("extra"), "content")).alias("a"))
    old = store.registry(batch).select("source_id", F.struct("cheap_hash", "content_hash", "title", "chunk_count", "extra", "chunk_batch").alias("r"))
    rows = one.join(old, "source_id", "left").withColumn("extra", F.from_json("a.extra", "map<string,string>"))
    known = F.col("r").isNotNull()
    cheap, same = F.col("a.cheap_hash") == F.col("r.cheap_hash"), F.col("a.content_hash") == F.col("r.content_hash")
    action = F.when(F.col("a.gone") & known, "delete").when(F.col("a.gone"), "none").when(known & cheap, "none").when(F.col("a.content").isNull(), "error").when(known & same, "skip").when(known, "update").otherwise("add")
    rows = rows.withColumn("action", action).where("action <> 'none'")
    store.spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    text = parsed(rows.where("action IN ('add', 'update')").select("source_id", F.element_at("extra", "suffix").alias("suffix"), "a.content"), parse)
    rows = rows.join(text, "source_id", "left").withColumn("error", F.when(F.col("action") == "error", "no content").otherwise(F.col("error")))
    rows = rows.withColumn("parts", F.when(F.col("text").isNotNull(), pieces(F.col("text"))))
    judged = f"{store.path}/judged/batch={batch}"
    rows.select("source_id", "action", "error", "a.cheap_hash", "a.content_hash", F.coalesce("a.title", "r.title").alias("title"), merged(F.col("r.extra"), F.col("extra")).alias("extra"), F.col("r").alias("old"), "parts").write.mode("overwrite").parquet(judged)
    rows = store.spark.read.parquet(judged)
    store.write("errors", rows.where("error IS NOT NULL").select("source_id", "content_hash", "error"), batch)
    good = rows.where("error IS NULL")
    store.write("chunks", good.select("source_id", F.posexplode("parts").alias("part", "text")), batch)
    fresh, gone = F.col("action").isin("add", "update"), F.col("action") == "delete"
    store.write("registry", good.select(
        "source_id", F.when(gone, F.col("old.cheap_hash")).otherwise(F.col("cheap_hash")).alias("cheap_hash"), F.when(gone, F.col("old.content_hash")).otherwise(F.col("content_hash")).alias("content_hash"), F.when(fresh, F.col("title")).otherwise(F.col("old.title")).alias("title"),
        F.when(fresh, F.size("parts")).otherwise(F.col("old.chunk_count")).cast("long").alias("chunk_count"), "extra", F.when(fresh, F.lit(batch)).otherwise(F.col("old.chunk_batch")).cast("long").alias("chunk_batch"), "action", gone.alias("gone"),
    ), batch)


def sync_folder(store: Store, batch: int, root: str, kb: str, parse: Callable[[bytes, str], str] = decoded, suffixes: list[str] = files.SUFFIXES) -> DataFrame:
    """Sync a folder of files and tell what was done: one row of ``summary``. Only files whose cheap hash is new are opened."""
    found = files.listing(store.spark, root, kb, suffixes)
    old = store.registry(batch).select("source_id", F.col("cheap_hash").alias("old_hash"))
    rows = found.join(old, "source_id", "full")
    changed = rows.where("uri IS NOT NULL AND (old_hash IS NULL OR cheap_hash IS NULL OR old_hash <> cheap_hash)").drop("old_hash")
    extra = F.create_map(F.lit("suffix"), F.col("suffix"), F.lit("uri"), F.col("uri"))
    new = changed.join(files.contents(changed), "uri", "left").select("source_id", "cheap_hash", "title", extra.alias("extra"), F.lit(False).alias("gone"), "content")
    lost = rows.where("uri IS NULL").select("source_id", *(F.lit(None).cast(t).alias(c) for c, t in (("cheap_hash", "string"), ("title", "string"), ("extra", "map<string,string>"))), F.lit(True).alias("gone"), F.lit(None).cast("binary").alias("content"))
    sync_batch(store, batch, new.unionByName(lost), parse)
    return summary(store, batch, found)


def summary(store: Store, batch: int, listed: DataFrame) -> DataFrame:
    """One row for a batch over a whole listing (source_id, ...): added, updated, skipped, deleted, errors."""
    done = store.rows("registry").where(F.col("batch") == batch).agg(*(F.count_if(F.col("action") == a).alias(n) for a, n in (("add", "added"), ("update", "updated"), ("delete", "deleted"))))
    failed = store.rows("errors").where(F.col("batch") == batch).agg(F.count("*").alias("errors"))
    total = listed.agg(F.count("*").alias("listed"))
    rows = total.crossJoin(done).crossJoin(failed)  # one row each
    return rows.select("added", "updated", (F.col("listed") - F.col("added") - F.col("updated") - F.col("errors")).alias("skipped"), "deleted", "errors")
