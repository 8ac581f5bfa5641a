"""Whether answers keep to their sources: the sentences of an answer against a verifier's verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

WARN = "⚠ "


def verdicts(reply: Column) -> Column:
    """array of (i, unsupported, reasoning) of the objects in a reply's JSON array; null where there is none that can be read.

    The array is what stands between the first and the last square bracket. A verdict that is given, but false, null, zero or
    empty, is unsupported; one that is not given is supported.
    """
    items = F.from_json(F.regexp_extract(reply, r"(?s)\[.*\]", 0), "array<string>")
    number = F.regexp_extract_all
    one = lambda x: F.struct(
        F.try_element_at(number(x, F.lit(r'"i"\s*:\s*(\d{1,9})\s*[,}]'), 1), F.lit(1)).cast("int").alias("i"),
        x.rlike(r'"supported"\s*:\s*(false|null|-?0(\.0*)?|""|\[\s*\]|\{\s*\})\s*[,}]').alias("unsupported"),
        F.trim(F.coalesce(F.get_json_object(x, "$.reasoning"), F.lit(""))).alias("reasoning"),
    )
    return F.transform(F.filter(items, lambda x: x.startswith("{")), one)


def ground(answers: DataFrame, text_col: str = "text", reply_col: str = "reply") -> DataFrame:
    """``answers`` with ``sentences`` array<struct<i, text, supported, reasoning, cited>>, ``unsupported`` and ``flagged``.

    Verdicts go to sentences by their number, from 1; of several for one the last counts, and numbers of no sentence are ignored.
    A reply that is null or cannot be read leaves the answer as it is, with all its sentences supported. ``flagged`` are the
    sentences, those that are not supported marked.
    """
    rows = answers.withColumn("_s", T.verifier_sentences(F.coalesce(F.col(text_col), F.lit("")))).withColumn("_v", verdicts(F.col(reply_col)))

    def told(s: Column, k: Column) -> Column:
        last = F.try_element_at(F.filter(F.coalesce("_v", F.array().cast("array<struct<i:int,unsupported:boolean,reasoning:string>>")), lambda v: v["i"] == k + 1), F.lit(-1))
        cited = F.transform(F.regexp_extract_all(s, F.lit(r"\[(\d{1,9})\]"), 1), lambda n: n.cast("int"))
        return F.struct((k + 1).alias("i"), s.alias("text"), (~F.coalesce(last["unsupported"], F.lit(False))).alias("supported"), F.coalesce(last["reasoning"], F.lit("")).alias("reasoning"), cited.alias("cited"))

    rows = rows.withColumn("sentences", F.transform("_s", told))
    bad = F.filter("sentences", lambda x: ~x["supported"])
    flagged = F.array_join(F.transform("sentences", lambda x: F.when(x["supported"], x["text"]).otherwise(F.concat(F.lit(WARN), x["text"]))), " ")
    return rows.withColumn("unsupported", F.size(bad)).withColumn("flagged", F.when(F.col("_v").isNull() | (F.size("_s") == 0), F.coalesce(F.col(text_col), F.lit(""))).otherwise(flagged)).drop("_s", "_v")
