"""Structured Streaming forms: merges by micro-batch, windowed counts with bounded lateness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kb
from ..sources.shared import scratch


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A file stream with the schema that the files have now; ``path`` is a file or a folder, which a pattern covers both."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")


def finish(writer) -> None:
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def sync_stream(store: kb.Store, arrived: DataFrame, **options) -> None:
    """Bring all that has arrived into a store, one batch of it for each micro-batch, by ``kb.sync_batch``.

    ``arrived`` is a stream of (source_id, cheap_hash, title, extra, gone, content). A micro-batch that is replayed overwrites
    its own folders; documents that cannot be parsed are recorded and do not stop the stream.
    """
    finish(arrived.writeStream.foreachBatch(lambda batch, number: kb.sync_batch(store, number, batch, **options)).option("checkpointLocation", f"{store.path}/checkpoint"))


def windowed_counts(events: DataFrame, ts: str, *keys: str, size: str = "1 minute", late: str = "10 minutes", more: list[Column] = []) -> DataFrame:
    """Counts by window and keys; state is dropped once the watermark has passed a window."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), *keys).agg(F.count("*").alias("n"), *more).select(F.col("window.start").alias("start"), "*").drop("window")


def histogram(seconds: Column, bounds: list[float]) -> list[Column]:
    """``buckets``, how many are within each bound and at last how many in all, and ``seconds``, their sum: aggregates that windows can merge."""
    return [F.array(*(F.count_if(seconds <= b) for b in bounds), F.count(seconds)).alias("buckets"), F.sum(seconds).alias("seconds")]


def collected(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, into Parquet in the shared folder."""
    out = scratch(spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch(spark, "stream-check"))
    finish(writer.format("parquet").option("path", out))
    return spark.read.schema(stream.schema).parquet(out)


def latest(spark: SparkSession, stream: DataFrame, *keys: str) -> DataFrame:
    """Run a stream of updates over what is there: the last row of each key, windows that are still open too."""
    out = scratch(spark, "updates")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    finish(stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", scratch(spark, "updates-check")))
    rest = [c for c in stream.columns if c not in keys]
    rows = spark.read.parquet(out).groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x"))
    return rows.select(*keys, "x.*")
