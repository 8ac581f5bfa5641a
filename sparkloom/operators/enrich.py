"""Around a model call: what to send, how to read the reply, what to keep. Models are plugged in as batch functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T


def cache_misses(rows: DataFrame, cache: DataFrame, *keys: str) -> DataFrame:
    return rows.join(cache.select(*keys).distinct(), list(keys), "left_anti")


def judge_flags(reply: Column) -> list[Column]:
    """Four flags of the first flat object in a reply; what is missing is false."""
    got = F.from_json(F.regexp_extract(reply, r"\{[^{}]*\}", 0), "faithful boolean, cites boolean, answers boolean, abstains boolean")
    return [F.coalesce(got[c], F.lit(False)).alias(c) for c in ("faithful", "cites", "answers", "abstains")]


def _distinct_in_order(items: Column) -> Column:
    """Without later items that differ from an earlier one in case only."""
    return F.aggregate(items, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def metadata(reply: Column) -> list[Column]:
    """entities (six at most, forty characters), topics (of the first three, white space to underscores, forty characters), date (ISO shape or null).

    Entities that differ in case only are one; topics repeat as they come. What is no text in the lists is left out.
    """
    got = F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "entities array<string>, topics array<string>, date string")
    items = lambda name: F.coalesce(got[name], F.array().cast("array<string>"))
    entities = F.filter(F.transform(items("entities"), T.trimmed), lambda x: (x != "") & (F.length(x) <= 40))
    topics = F.transform(F.slice(items("topics"), 1, 3), lambda x: F.regexp_replace(F.lower(T.trimmed(x)), r"(?U)\s+", "_"))
    return [F.slice(_distinct_in_order(entities), 1, 6).alias("entities"), F.filter(topics, lambda x: (x != "") & (F.length(x) <= 40)).alias("topics"), F.when(got["date"].rlike(r"^\d{4}-\d{2}-\d{2}$"), got["date"]).alias("date")]


def context_prompt(title: Column, section_path: Column, text: Column, parent: Column) -> Column:
    """What a model is asked for a chunk's context: title, breadcrumb, the parent's text if it is another, cut to 1,500 characters, and the chunk."""
    section = F.when(F.coalesce(F.size(section_path), F.lit(0)) > 0, F.array_join(section_path, " / ")).otherwise(rules.CONTEXT_TOP)
    cut = F.when(F.length(parent) <= rules.CONTEXT_PARENT, parent).otherwise(F.concat(F.substring(parent, 1, rules.CONTEXT_PARENT), F.lit(" ...")))
    around = F.when(F.coalesce(parent, F.lit("")).isin("") | (T.trimmed(parent) == T.trimmed(text)), "").otherwise(F.concat(F.lit(rules.CONTEXT_HEADS[2]), cut, F.lit("\n")))
    heads = rules.CONTEXT_HEADS
    return F.concat(F.lit(heads[0]), title, F.lit(heads[1]), section, F.lit("\n"), around, F.lit(heads[3]), text, F.lit(heads[4]))


def with_context(text: Column, tokens: Column, reply: Column) -> list[Column]:
    """text, token_count, contextual_prefix and original_text of a chunk given the model's reply, of which the first line counts."""
    prefix = T.trimmed(F.substring_index(T.trimmed(F.coalesce(reply, F.lit(""))), "\n", 1))
    words = F.size(F.filter(F.split(prefix, r"(?U)\s+"), lambda w: w != ""))
    return [F.when(prefix == "", text).otherwise(F.concat(prefix, F.lit("\n\n"), text)).alias("text"), (tokens + words).alias("token_count"), prefix.alias("contextual_prefix"), text.alias("original_text")]


def variants(reply: Column, query: Column, most: int = 4) -> Column:
    got = F.from_json(F.regexp_extract(reply, r"(?s)\[.*?\]", 0), "array<string>")
    clean = F.filter(F.transform(F.coalesce(got, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: (x != "") & (F.lower(x) != F.lower(F.trim(query))))
    return F.slice(_distinct_in_order(clean), 1, most)


def history_tail(turns: DataFrame, last: int, chars: int) -> DataFrame:
    """The last turns of each conversation as lines; Spark keeps no more than those before the shuffle."""
    back = turns.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text")))).where(F.col("back") <= last)
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.substring("text", 1, chars))
    return back.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n").alias("history"))


def merge_rewrite(query: Column, reply: Column, has_history: Column) -> Column:
    first = F.trim(F.substring_index(F.coalesce(reply, F.lit("")), "\n", 1))
    return F.when(first == "", query).when(has_history, first).otherwise(F.concat(query, F.lit(" "), first))


def hashed_ngrams(texts: list[str], width: int = 64) -> np.ndarray:
    """The default embedder: hashed trigrams of bytes in lower case, scaled to unit length; shorter texts by the sum of their bytes."""
    out = np.zeros((len(texts), width))
    for row, text in zip(out, texts):
        raw = text.lower().encode()
        if len(raw) >= 3:
            codes = np.frombuffer(raw, np.uint8).astype(np.uint32)
            grams = (codes[:-2] * 65_599 + codes[1:-1] * 257 + codes[2:]) * np.uint32(2_654_435_761)
            row += np.bincount((grams >> np.uint32(26)).astype(np.int64) % width, minlength=width)
        else:
            row[sum(raw) % width] = 1.0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def embed(rows: DataFrame, id_col: str, text_col: str, model: Callable[[list[str]], np.ndarray] = hashed_ngrams) -> DataFrame:
    """(id, vector): batches of texts through a model, loaded once per worker by its function."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf[id_col], "vector": list(np.asarray(model(pdf[text_col].fillna("").tolist()), np.float32))})

    return rows.select(id_col, text_col).mapInPandas(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, vector array<float>")
