"""Filters as data: many filters over many chunks without their product.

Each filter proposes chunks by one of its keys, the one with the fewest chunks behind it, by an equality: a substring
by its rarest run of three characters, a source type or a date by its value, entities and topics by values that contain, or are
contained in, what is wanted. All its keys are then checked on what it proposes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import stored

#: Substring keys and the texts they look into.
SUBSTRINGS = {"source_path_contains": "path", "title_contains": "title", "section_contains": "section"}
OVERLAPS = {"entities_contains": "entities", "topics_contains": "topics"}
N = 3


def runs(text: Column, n: int) -> Column:
    """The distinct runs of ``n`` characters; of a shorter text none."""
    length = F.length(text)
    every = F.transform(F.sequence(F.lit(1), F.greatest(length - n + 1, F.lit(1))), lambda i: text.substr(i, F.lit(n)))
    return F.when(length >= n, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def lowered(items: Column) -> Column:
    """In lower case, without nulls and empty texts, which count as not there."""
    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), F.lower), lambda x: F.length(x) > 0)


def either(have: Column, wanted: Column) -> Column:
    """Whether something that is there contains, or is contained in, something wanted."""
    return F.exists(wanted, lambda w: F.exists(have, lambda h: h.contains(w) | w.contains(h)))


def passes() -> Column:
    """All eight keys of a filter against a chunk; a key that is null or empty asks for nothing, and a missing date meets no bound."""
    given = lambda c: F.coalesce(F.length(c), F.lit(0)) > 0
    some = lambda c: F.size(lowered(F.col(c))) > 0
    tests = [~given(k) | F.col(f"_{of}").contains(F.lower(k)) for k, of in SUBSTRINGS.items()]
    tests += [~some(k) | either(F.col(f"_{of}"), lowered(F.col(k))) for k, of in OVERLAPS.items()]
    tests.append(~some("source_type") | F.array_contains("source_type", F.col("_type")))
    tests += [~given("date_after") | F.coalesce(F.col("_date") >= F.col("date_after"), F.lit(False)), ~given("date_before") | F.coalesce(F.col("_date") <= F.col("date_before"), F.lit(False))]
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def prepared(chunks: DataFrame) -> DataFrame:
    """(chunk_id, _path, _title, _section, _type, _entities, _topics, _date), in lower case."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return chunks.select("chunk_id", low("source_path").alias("_path"), low("title").alias("_title"), low(F.array_join("section_path", " / ")).alias("_section"), T.source_type(F.coalesce("source_path", F.lit(""))).alias("_type"), *(F.array_distinct(lowered(F.col(c))).alias(f"_{c}") for c in ("entities", "topics")), F.when(F.col("date") != "", F.col("date")).alias("_date"))


def filter_hits(hits: DataFrame, filters: DataFrame) -> DataFrame:
    """The rows of ``hits`` (query_id, chunk_id, ...) that their own query's filter lets pass; a query without a filter keeps all."""
    own = filters.withColumnRenamed("filter_id", "_of")
    rows = hits.join(prepared(hits.select("chunk_id", "source_path", "title", "section_path", "entities", "topics", "date").dropDuplicates(["chunk_id"])), "chunk_id").join(own, F.col("query_id") == F.col("_of"), "left")
    return rows.where(F.col("_of").isNull() | passes()).select(*hits.columns)


def tagged(kind: str) -> Callable[[Column], Column]:
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))


def keys_of(chunks: DataFrame) -> DataFrame:
    """(kind, value, chunk_id): all that chunks can be proposed by. Texts of one or two characters are found by shorter runs."""
    out = []
    for k, of in SUBSTRINGS.items():
        out.append(F.transform(F.flatten(F.array(*(runs(F.col(f"_{of}"), n) for n in range(1, N + 1)))), tagged(k)))
    for k, of in OVERLAPS.items():
        grams = F.flatten(F.transform(F.col(f"_{of}"), lambda h: F.flatten(F.array(*(runs(h, n) for n in range(1, N + 1))))))
        out.append(F.transform(F.array_distinct(grams), tagged(k + ":in")))
        out.append(F.transform(F.col(f"_{of}"), tagged(k + ":is")))
    for k, c in (("source_type", "_type"), ("date", "_date")):
        out.append(F.transform(F.array_compact(F.array(F.col(c))), tagged(k)))
    return chunks.select("chunk_id", F.explode(F.concat(*out)).alias("x")).select("x.kind", "x.value", "chunk_id")


def wants(filters: DataFrame, dates: DataFrame) -> DataFrame:
    """(filter_id, key, piece, kind, value): by which values a filter could propose; all values of one piece together, one piece is enough."""
    gram = lambda w: F.when(F.length(w) >= N, runs(w, N)).otherwise(F.array(w))
    rows = []
    for k in SUBSTRINGS:
        rows.append(filters.where(F.length(k) > 0).select("filter_id", F.lit(k).alias("key"), F.explode(gram(F.lower(k))).alias("value")).select("filter_id", "key", F.col("value").alias("piece"), F.lit(k).alias("kind"), "value"))
    for k in OVERLAPS:  # what contains a wanted word holds its first run; what is contained in it is one of its substrings
        words = filters.select("filter_id", F.explode(lowered(F.col(k))).alias("w"))
        inside = F.flatten(F.transform(F.sequence(F.lit(1), F.length("w")), lambda n: F.transform(F.sequence(F.lit(1), F.length("w") - n + 1), lambda i: F.col("w").substr(i, n))))
        holds = words.select("filter_id", F.lit(k).alias("key"), F.lit("").alias("piece"), F.lit(k + ":in").alias("kind"), F.col("w").substr(1, N).alias("value"))
        rows.append(holds.unionByName(words.select("filter_id", F.lit(k).alias("key"), F.lit("").alias("piece"), F.lit(k + ":is").alias("kind"), F.explode(F.array_distinct(inside)).alias("value"))))
    rows.append(filters.where("size(source_type) > 0").select("filter_id", F.lit("source_type").alias("key"), F.lit("").alias("piece"), F.lit("source_type").alias("kind"), F.explode("source_type").alias("value")))
    bounds = filters.where("length(date_after) > 0 OR length(date_before) > 0").select("filter_id", F.coalesce("date_after", F.lit("")).alias("a"), F.when(F.length("date_before") > 0, F.col("date_before")).alias("b"))
    within = bounds.join(F.broadcast(dates), (F.col("value") >= F.col("a")) & (F.col("b").isNull() | (F.col("value") <= F.col("b"))))  # of different dates there are a few per day
    rows.append(within.select("filter_id", F.lit("date").alias("key"), F.lit("").alias("piece"), F.lit("date").alias("kind"), "value"))
    return reduce(lambda a, b: a.unionByName(b), rows)


def filter_chunks(chunks: DataFrame, filters: DataFrame) -> DataFrame:
    """(filter_id, chunk_id): the chunks that each filter lets pass.

    ``chunks`` is (chunk_id, source_path, title, section_path, entities, topics, date), ``filters`` (filter_id, source_path_contains,
    title_contains, section_contains, source_type, entities_contains, topics_contains, date_after, date_before), each key null or empty
    where it asks for nothing; ``source_type`` and the overlap keys are arrays. Case is not looked at, dates are ISO texts. Missing
    metadata meets no key. A filter that asks for nothing lets every chunk pass.
    """
    known = stored(prepared(chunks), "chunks")
    asked = stored(wants(filters, known.select(F.col("_date").alias("value")).where("value IS NOT NULL").distinct()), "wants")
    # only what some filter could propose by is kept of the keys
    keys = stored(keys_of(known).join(asked.select("kind", "value").distinct(), ["kind", "value"], "left_semi"), "keys")
    behind = keys.groupBy("kind", "value").agg(F.count("*").alias("n"))
    size = asked.join(behind, ["kind", "value"], "left").groupBy("filter_id", "key", "piece").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    best = size.withColumn("nth", F.row_number().over(Window.partitionBy("filter_id").orderBy("n", "key", "piece"))).where("nth = 1").drop("nth", "n")
    # repetitive columns are small as files and large in memory: keys and chunks are named as sides that no join may broadcast
    picked = stored(asked.join(best, ["filter_id", "key", "piece"]).select("filter_id", "kind", "value"), "picked")
    proposed = keys.hint("shuffle_merge").join(picked, ["kind", "value"]).select("filter_id", "chunk_id").distinct()
    blank = [F.coalesce(F.length(k), F.lit(0)) == 0 for k in (*SUBSTRINGS, "date_after", "date_before")] + [F.size(lowered(F.col(k))) == 0 for k in (*OVERLAPS, "source_type")]
    everything = reduce(lambda a, b: a & b, blank)
    rows = proposed.join(known.hint("shuffle_merge"), "chunk_id").join(filters.where(~everything), "filter_id").where(passes()).select("filter_id", "chunk_id")
    return rows.unionByName(F.broadcast(filters.where(everything).select("filter_id")).crossJoin(known.select("chunk_id")).select("filter_id", "chunk_id"))  # all of them are the result
