"""Toxicity by compression distance: zstandard dictionaries trained on toxic and on ordinary text, compared window by window.

zstandard's trainer makes three dictionaries: one of ordinary text, a base that both sides share, and one more of each
side, of equal size, from short windows of other rows. Toxic rows are mostly ordinary text, so a side is trained on what
tells its class in the windows: words with beginnings that its windows hold far more often than the other's, by a test on
counts over distinct windows, so that copies count once. What stands beside such words is left out, as it is ordinary
text that shortens windows of either class.

A window of a document that compresses better with the toxic dictionary than with the ordinary one holds toxic text; windows
are short, so a few words in a long document show. The document's largest gain, its three largest, and what
gains sum to go into a logistic curve, calibrated on sampled rows kept out of the dictionaries and weighted to the classes'
shares of all labelled rows. Of a few sizes of the base, with a side of ordinary text or without, and then of a few bars
for what tells a class and sizes of the sides, those whose calibration loses least make the model. A large base shortens
more, but its matches run from ordinary words into those that tell.
"""

from __future__ import annotations

import dataclasses
import functools
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, id_and_text, parts, stored, unused


@dataclasses.dataclass(frozen=True)
class Settings:
    """At most ``sample_toxic`` and ``sample_ordinary`` labelled rows are learned from, by the least hash of the id, and of
    their whole texts about ``sample_windows`` training windows of the base and of each side, by hash of the window."""

    sample_toxic: int = 4000
    sample_ordinary: int = 8000
    sample_windows: int = 200_000
    window_bytes: int = 64
    training_bytes: int = 20
    base_bytes: int = 98_304
    side_bytes: tuple[int, ...] = (768, 1536, 3072)
    threshold: float = 0.3


#: What every window is compressed behind; not a piece of UTF-8. zstandard stores a short block raw unless something in it shrinks.
LEAD = bytes(range(128, 224))
#: Makes a shorter side as long as the other, so that the base is as far away; not a piece of UTF-8 either.
FILLER = bytes(range(224, 256))
#: The base is tried at the size of the settings and at these parts of it.
BASE_PARTS = (1, 16, 64)
#: Bars for what tells a class: times the expected number of windows, and standard deviations above it.
BARS = ((6.0, 6.0), (4.5, 4.5), (3.0, 3.0))
#: What a pair of dictionaries is made by: size of the base, bar, size of a side, whether ordinary text has a side too.
Form = tuple[int, tuple[float, float], int, bool]
BETWEEN_WORDS = re.compile(r"[\W\d_]+")


@dataclasses.dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    settings: Settings


def windows(text: bytes, size: int) -> list[bytes]:
    """The whole text in pieces of at most ``size`` bytes, cut at spaces where there are any in a piece's second half."""
    out, at, n = [], 0, len(text)
    while n - at > size:
        end = text.rfind(b" ", at + size // 2, at + size)
        end = end if end > at else at + size
        out.append(text[at:end])
        at = end
    out.append(text[at:])
    return out


@functools.lru_cache(maxsize=4)
def compressor(dictionary: bytes):
    import zstandard as z

    # min_match 4 and a search of all candidates: short words must be found in the dictionary
    params = z.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=15, search_log=6, min_match=4, target_length=16, strategy=z.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
    data = z.ZstdCompressionDict(dictionary, dict_type=z.DICT_TYPE_RAWCONTENT)
    return z.ZstdCompressor(compression_params=params, dict_data=data)


def plain(text: str) -> str:
    """Lower-case words and single spaces."""
    return BETWEEN_WORDS.sub(" ", text.lower())


def gains(text: str, model: Model) -> np.ndarray:
    """Bytes that the toxic dictionary saves over the ordinary one, by window."""
    a, b = compressor(model.ordinary).compress, compressor(model.toxic).compress
    found = []
    for w in windows(plain(text).encode(), model.settings.window_bytes):
        w = LEAD + w
        found.append(len(a(w)) - len(b(w)))
    return np.array(found)


def measures(gain: np.ndarray) -> tuple[float, ...]:
    n, total = len(gain), float(np.maximum(gain - 1, 0).sum())
    return float(gain.max()), float(np.sort(gain)[-3:].sum()), math.log1p(total), total / n, total / math.sqrt(n), math.log(n)


def score(measured: tuple[float, ...], weights: tuple[float, ...]) -> float:
    z = weights[0] + sum(w * x for w, x in zip(weights[1:], measured))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def calibrate(measured: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Weighted logistic regression by Newton steps, with a little shrinkage of the standardised measures."""
    mean, scale = measured.mean(0), measured.std(0) + 1e-9
    x = np.column_stack([np.ones(len(measured)), (measured - mean) / scale])
    w, shrink = np.zeros(x.shape[1]), np.diag([1e-6, *[1e-3] * measured.shape[1]]) * len(measured)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + shrink, x.T @ (weight * (labels - p)) - shrink @ w)
        w = w + np.clip(step, -5, 5)
    return (float(w[0] - (w[1:] * mean / scale).sum()), *map(float, w[1:] / scale))


def content(windows: list[bytes], size: int) -> bytes:
    """The content that zstandard's trainer chooses from windows; none if they are too few to train on."""
    import zstandard as z

    try:
        return z.train_dictionary(size, windows).as_bytes()[-(size - 300) :]  # entropy tables stand before it
    except z.ZstdError:
        return b""


def beginnings(window: bytes) -> set[bytes]:
    """The words of a window of four bytes or more, and what they begin with."""
    return {w[:n] for w in window.split() if len(w) >= 4 for n in (4, 5, 6, 7, len(w))}


def telling(own: Counter, other: Counter, n_own: int, n_other: int, bar: tuple[float, float]) -> set[bytes]:
    """What windows of one class hold far more often than the other's."""
    found = set()
    for piece, n in own.items():
        expected = (other[piece] + 0.5) * n_own / max(1, n_other)
        if n >= max(3, bar[0] * expected) and n - expected >= bar[1] * math.sqrt(expected + 1):
            found.add(piece)
    return found


def telling_words(windows: list[bytes], told: set[bytes], bunch: int = 6) -> list[bytes]:
    """Samples of the words of ``windows`` that begin with what is ``told``; those of a few windows are one, as the trainer passes over samples under 8 bytes."""
    found = [b" ".join(w for w in window.split() if not told.isdisjoint(beginnings(w))) for window in windows]
    found = [words for words in found if words]
    return [b" " + b" ".join(found[k : k + bunch]) + b" " for k in range(0, len(found), bunch)]


def training_windows(texts: DataFrame, settings: Settings) -> DataFrame:
    """(label, window), written to the shared folder: distinct windows of whole texts (label, text), about ``sample_windows`` of each label at most.

    Label -1 is the base and has windows of ``window_bytes``, the sides have shorter ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            labels, found = [], []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = windows(plain(text).encode(), settings.window_bytes if label < 0 else settings.training_bytes)
                found += own
                labels += [label] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(found, pa.binary())], names=["label", "window"])

    cut = texts.select(F.col("label").cast("int"), "text").mapInArrow(run, "label int, window binary").where("length(window) > 3").distinct()
    cut = stored(cut, "windows")
    # the same share of the hash range of each label whose windows are too many
    most = 1 << 20
    counts = {r["label"]: r["count"] for r in cut.groupBy("label").count().collect()}
    share = sum((F.when(F.col("label") == label, min(most, most * settings.sample_windows // n)).otherwise(0) for label, n in counts.items()), F.lit(0))
    return cut.where(F.pmod(F.xxhash64("window"), F.lit(most)) < share)


def measured_rows(texts: DataFrame, models: list[Model]) -> DataFrame:
    """(label, m): the measures of each whole text of (label, text) by each of the models."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            own = batch.column(1).to_pylist()
            found = [[list(measures(gains(t, model))) for t in own] for model in models]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(zip(*found)), pa.list_(pa.list_(pa.float64())))], names=["label", "m"])

    return texts.select(F.col("label").cast("int"), "text").mapInArrow(run, "label int, m array<array<double>>")


def dictionaries(made: DataFrame, settings: Settings) -> Callable[[Form], tuple[bytes, bytes]]:
    """A function that makes (ordinary, toxic) dictionaries of a form."""
    rows = [(r["label"], bytes(r["window"])) for r in made.toLocalIterator()]
    rows.sort(key=lambda r: (zlib.crc32(r[1]), r))  # the trainer takes from each stretch of its samples, so alike ones must not stand together
    shared, *sides = ([w for a, w in rows if a == label] for label in (-1, 0, 1))
    counts = [Counter(p for w in side for p in beginnings(w)) for side in sides]

    @functools.cache
    def base(size: int) -> bytes:
        return content(shared, size)

    @functools.cache
    def samples(bar: tuple[float, float]) -> list[list[bytes]]:
        return [telling_words(sides[k], telling(counts[k], counts[1 - k], len(sides[k]), len(sides[1 - k]), bar)) for k in (0, 1)]

    def make(form: Form) -> tuple[bytes, bytes]:
        base_bytes, bar, side_bytes, both = form
        ordinary, toxic = (content(words, side_bytes) for words in samples(bar))
        ordinary = ordinary if both else b""
        n = max(len(ordinary), len(toxic))
        return tuple(base(base_bytes) + (FILLER * n)[: n - len(side)] + side + LEAD for side in (ordinary, toxic))

    return make


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings = Settings()) -> Model:
    """Learn from the labelled rows that are not held out; a bounded sample, by hash of the id.

    The driver gets training windows (about ``sample_windows`` of each kind at most) and measures of the sampled rows. With
    too few labels to calibrate nothing is called toxic.
    """
    marked = labels.select(F.col("doc_id").alias("__id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out("__id"))
    shares = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    first = lambda label, n: marked.where(F.col("label") == label).orderBy(F.xxhash64("__id"), "__id").limit(n)
    chosen = first(1, settings.sample_toxic).unionByName(first(0, settings.sample_ordinary)).distinct()
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("label", "text").distinct()
    # four rows of ten calibrate; of the ordinary ones, three make the base and three the side
    rows = stored(rows.withColumn("part", F.pmod(F.xxhash64("text", F.lit(1)), F.lit(10))), "labelled")
    rest = rows.where("part > 5")
    learn = rows.where("part <= 5").select(F.when((F.col("label") == 0) & (F.col("part") < 3), -1).otherwise(F.col("label")).alias("label"), "text")
    known = {r["label"]: r["count"] for r in rest.groupBy("label").count().collect()}
    if len(known) < 2:
        return Model(LEAD, LEAD, (-4.0, *[0.0] * 6), settings)
    make = dictionaries(training_windows(learn, settings), settings)

    def best(forms: list[Form]) -> tuple[float, Model, Form]:
        models = [Model(*make(form), (), settings) for form in forms]
        found = sorted((r["label"], tuple(map(tuple, r["m"]))) for r in measured_rows(rest, models).collect())
        marks, measured = np.array([f[0] for f in found]), np.array([f[1] for f in found])
        weight = np.array([shares[label] / known[label] for label in marks], float)
        weight *= len(marks) / weight.sum()
        out = []
        for k, model in enumerate(models):
            model = dataclasses.replace(model, weights=calibrate(measured[:, k], marks, weight))
            p = np.array([score(tuple(m), model.weights) for m in measured[:, k]])
            out.append((float(-(weight * np.log(np.where(marks == 1, p, 1 - p))).sum()), model, forms[k]))
        return min(out, key=lambda o: o[0])

    bases = [n for n in (settings.base_bytes // part for part in BASE_PARTS) if n >= 1024] or [settings.base_bytes]
    start = BARS[0], settings.side_bytes[0]
    first = best([(base, *start, both) for base in bases for both in (True, False)])
    base, _, _, both = first[2]
    second = best([(base, bar, size, both) for bar in BARS for size in settings.side_bytes if (bar, size) != start])
    return min(first, second, key=lambda o: o[0])[1]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted, max_gain) of every whole text.

    A null or empty text is one empty window. Repeated rows are scored each; other columns are not read,
    unless ``keep_columns`` asks for all of ``docs`` as they are, before the last three, whose names get underscores
    before them where ``docs`` has such a column.
    """
    own = [F.col(f"`{c}`") for c in docs.columns] if keep_columns else [F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out")]
    made = [unused(docs, name) for name in ("score", "predicted", "max_gain")] if keep_columns else ["score", "predicted", "max_gain"]
    text = unused(docs, "whole_text")
    rows = docs.select(*own, F.coalesce(F.col(text_col), F.lit("")).alias(text))
    n = len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, n):
            found = [measures(gains(t, model)) for t in batch.column(n).to_pylist()]
            scores = [score(m, model.weights) for m in found]
            values = [pa.array(scores, pa.float64()), pa.array([int(s >= model.settings.threshold) for s in scores], pa.int32()), pa.array([int(m[0]) for m in found], pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), *values], names=[*batch.schema.names[:n], *made])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n]]
    return rows.mapInArrow(run, ", ".join([*fields, f"`{made[0]}` double", f"`{made[1]}` int", f"`{made[2]}` int"]))


def keep_ordinary(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not called toxic, with their own columns."""
    marked = predict(docs, model, id_col, text_col, keep_columns=True)
    return marked.where(F.col(marked.columns[-2]) == 0).select(*(f"`{c}`" for c in docs.columns))
