"""Language ID by compression: a zstandard raw-content dictionary per language, the smallest size wins.

The model is fitted on a bounded sample of labelled rows: per language the documents with the smallest
hashes, cut whole to windows, and of these the windows with the smallest hashes, up to ``dictionary_bytes``. Every language of the
table is learned. A whole text, as lower-case words, is compressed window by window
with each dictionary; its language is the one with the smallest total. Every window is compressed behind a fixed
string that ends all dictionaries, since zstandard stores a short block raw unless something in it shrinks. The
score is how much smaller the total is than the second, on a scale of 0 to 1; a text whose margin is under
``min_margin`` is rejected.
"""

from __future__ import annotations

import dataclasses
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, parts, unused


@dataclasses.dataclass(frozen=True)
class Settings:
    """``sample_docs`` rows per language and, of their whole texts, windows of ``learned_bytes`` that fill ``dictionary_bytes`` are learned from."""

    sample_docs: int = 200
    dictionary_bytes: int = 24_576
    learned_bytes: int = 256
    window_bytes: int = 1024
    min_margin: float = 0.002


#: What every window is compressed behind; not a piece of UTF-8.
LEAD = bytes(range(128, 224))
BETWEEN_WORDS = re.compile(r"[\W\d_]+")


@dataclasses.dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]
    settings: Settings


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings = Settings()) -> Model:
    """Learn from the rows that are not held out and have a language and letters."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    first = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
    sample = rows.select("lang", "text", "doc_id", F.xxhash64("doc_id").alias("h")).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= settings.sample_docs)
    size = settings.learned_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            langs, found = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = plain(text).encode()
                own = [text[k : k + size] for k in range(0, len(text), size)]
                found += own
                langs += [lang] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], names=["lang", "window"])

    cut = sample.select("lang", "text").mapInArrow(run, "lang string, window binary").distinct()
    least = Window.partitionBy("lang").orderBy("h", "window")
    cut = cut.withColumn("h", F.xxhash64("window")).withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= -(-settings.dictionary_bytes // size))
    texts: dict[str, list[bytes]] = {}
    for r in cut.orderBy("lang", "nth").toLocalIterator():
        texts.setdefault(r["lang"], []).append(bytes(r["window"]))
    # languages with more rows first: a tie goes to the first
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    order = sorted(texts, key=lambda lang: (-sizes[lang], lang))
    return Model(tuple(order), tuple(b" ".join(texts[lang])[: settings.dictionary_bytes] + b" " + LEAD for lang in order), settings)


@functools.lru_cache(maxsize=4)
def compressors(model: Model) -> list:
    import zstandard as z

    params = z.ZstdCompressionParameters(window_log=18, hash_log=15, chain_log=15, search_log=4, min_match=4, target_length=16, strategy=z.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
    return [z.ZstdCompressor(compression_params=params, dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT)).compress for d in model.dictionaries]


def plain(text: str) -> str:
    """Lower-case words and single spaces."""
    return BETWEEN_WORDS.sub(" ", text.lower())


def windows(text: bytes, size: int) -> list[bytes]:
    return [LEAD + text[k : k + size] for k in range(0, len(text), size)]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, margin, accepted) of every whole text.

    A null text, or one without letters, is ``und`` with score 0 and is not accepted; so is every text if
    no language was learned. Ties go to the language with more learned rows. Repeated rows are predicted each;
    other columns are not read, unless ``keep_columns`` asks for all of ``docs`` as they are, before the last five, whose
    names get underscores before them where ``docs`` has such a column.
    """
    own = [F.col(f"`{c}`") for c in docs.columns] if keep_columns else [F.col(id_col).alias("doc_id")]
    made = ["held_out", "lang_pred", "score", "margin", "accepted"]
    made = [unused(docs, name) for name in made] if keep_columns else made
    text, letters, held = (unused(docs, name) for name in ("whole_text", "has_letters", "is_held_out"))
    rows = docs.select(*own, F.col(text_col).alias(text), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias(letters), held_out(id_col).alias(held))
    n = len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = compressors(model)
        for batch in parts(batches, n):
            langs, scores, margins = [], [], []
            for text, letters in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()):
                pieces = windows(plain(text).encode(), model.settings.window_bytes) if letters else []
                if not pieces or not tools:
                    langs.append("und"), scores.append(0.0), margins.append(0.0)
                    continue
                sizes = [sum([len(compress(p)) for p in pieces]) for compress in tools]
                best = min(range(len(sizes)), key=sizes.__getitem__)
                second = min([s for k, s in enumerate(sizes) if k != best], default=2 * sizes[best])
                margin = (second - sizes[best]) / second
                langs.append(model.languages[best]), margins.append(margin), scores.append(min(1.0, margin / 0.1))
            values = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array([x != "und" and m >= model.settings.min_margin for x, m in zip(langs, margins)], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), batch.column(n + 2), *values], names=[*batch.schema.names[:n], *made])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n]]
    kinds = ("boolean", "string", "double", "double", "boolean")
    return rows.mapInArrow(run, ", ".join([*fields, *(f"`{name}` {kind}" for name, kind in zip(made, kinds))]))


def keep_known(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is told by a sufficient margin, with their own columns."""
    marked = predict(docs, model, id_col, text_col, keep_columns=True)
    return marked.where(F.col(marked.columns[-1])).select(*(f"`{c}`" for c in docs.columns))
