"""Folders of files in two phases: a listing that opens nothing, then the contents of the files that are asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

SUFFIXES = [".txt", ".md", ".markdown", ".html", ".htm"]


def listing(spark: SparkSession, root: str, kb: str, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """(source_id, uri, suffix, title, cheap_hash, bytes) of the files below ``root`` with known suffixes, upper case or lower.

    ``cheap_hash`` is the time of the last change in microseconds and the length. No column is asked for that
    the reader would have to open a file for.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")
    name, suffix = F.element_at(F.split("path", "/"), -1), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    cheap = F.concat_ws(":", F.unix_micros("modificationTime").cast("string"), F.col("length").cast("string"))
    rows = files.select(T.stable_source_id(F.lit(kb), F.col("path")).alias("source_id"), F.col("path").alias("uri"), suffix.alias("suffix"), F.regexp_replace(name, r"\.[^.]+$", "").alias("title"), cheap.alias("cheap_hash"), F.col("length").alias("bytes"))
    return rows.where(F.col("suffix").isin(suffixes))


def contents(rows: DataFrame, block: int = 10_000) -> DataFrame:
    """(uri, content) of the files named by ``rows`` (uri, ...), and of no others.

    The paths go to the reader in blocks, as a reader takes its files by name; they are what changed, never a whole
    folder that did not. A file that is gone by then is left out.
    """
    spark, out = rows.sparkSession, None
    paths, taken = rows.select("uri").distinct().toLocalIterator(), []

    def opened(names: list[str]) -> DataFrame:
        return spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(names).select(F.col("path").alias("uri"), "content")

    for row in paths:
        taken.append(row["uri"])
        if len(taken) == block:
            out, taken = opened(taken) if out is None else out.unionByName(opened(taken)), []
    if taken or out is None:
        last = opened(taken) if taken else spark.createDataFrame([], "uri string, content binary")
        out = last if out is None else out.unionByName(last)
    return out
