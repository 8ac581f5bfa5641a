"""What the operators share: reading tables, the shared scratch folder, empty-text rules."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import importable, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) only, so that other columns of ``docs`` can bear any name; a null text is empty."""
    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))


def held_out(doc_id: Column | str) -> Column:
    """Rows that no model learns from: crc32 of the id as text, modulo 4, is 2 (a null id counts as empty text)."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def parts(batches: Iterator[pa.RecordBatch], column: int, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``size`` bytes of the text column, so that a task holds little at a time."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ends):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column of ``df`` bears it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
