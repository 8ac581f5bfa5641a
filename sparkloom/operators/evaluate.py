"""Evaluation of retrieval and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def retrieval_rows(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, category, scored, first_rank, hit1, hit3, hit5, rr) per query.

    ``hits`` has query_id, source_id, rank; a source counts at its best rank among distinct sources.
    ``queries`` has query_id, category, relevant (array). Out-of-domain queries and those without relevant
    sources are not scored.
    """
    sources = hits.groupBy("query_id", "source_id").agg(F.min("rank").alias("rank"))
    sources = sources.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "source_id")))
    wanted = queries.select("query_id", F.explode("relevant").alias("source_id"))
    first = sources.join(wanted, ["query_id", "source_id"]).groupBy("query_id").agg(F.min("place").alias("first_rank"))
    rows = queries.join(first, "query_id", "left").withColumn("scored", (F.col("category") != "out_of_domain") & (F.size("relevant") > 0))
    hit = lambda k: F.when(F.col("scored"), (F.coalesce("first_rank", F.lit(1 << 30)) <= k).cast("int"))
    return rows.select("query_id", "category", "scored", "first_rank", hit(1).alias("hit1"), hit(3).alias("hit3"), hit(5).alias("hit5"), F.when(F.col("scored"), F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))).alias("rr"))


METRICS = ("hit1", "hit3", "hit5", "rr")


def retrieval_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """Means over the scored rows, zero where there are none, and the numbers of scored and skipped rows."""
    means = [F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(m) for m in METRICS]
    return rows.groupBy(*by).agg(F.count_if("scored").alias("n"), F.count_if(~F.col("scored")).alias("n_skipped"), *means)


def regression_gate(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """(metric, value, base, delta, verdict): one row of metrics, melted and held against a baseline with tolerances."""
    long = metrics.unpivot([], list(metrics.columns), "metric", "value")
    rows = long.join(F.broadcast(baseline), "metric", "left").withColumn("delta", F.round(F.col("value") - F.col("base"), 6))
    verdict = F.when(F.col("base").isNull(), "no-baseline").when(F.col("delta") >= 0, "ok").when(F.col("delta") >= -F.col("tolerance"), "within_tol").otherwise("REGRESSED")
    return rows.select("metric", "value", "base", "delta", verdict.alias("verdict"))
