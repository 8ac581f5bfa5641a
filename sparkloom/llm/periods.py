"""Periodic runs of words: dyadic blocks ask a wavelet tree over the suffix array for their next occurrence.

A run is a stretch of words with smallest period q that is at least 4q and six words long, and that no
neighbouring word extends. Let B be the least power of two that is at least q, and at least four. Blocks of B words begin
at every multiple of B / 2, so a run holds one whole, with q more words behind it. A block that is as long as the
period occurs next exactly q words on: nearer, the period would not be the smallest. So it is enough to ask, for
blocks that occur twice in their text, for the next occurrence within B words; those that are B / 2 or
nearer belong to smaller blocks.

- Suffix array by prefix doubling over the texts of a step, words of different texts being different symbols. Each
  doubling sorts again what is not yet alone, and gives each block of that length its interval of the array.
- Next occurrence: the range successor of the block's place among the array's entries in its interval, by two descents of a
  wavelet matrix (a wavelet tree laid out level by level) for all blocks of a step at once.
- Blocks that follow each other at one distance are a progression, whose distance is a candidate period. Its stretch is
  extended word by word on both sides and kept if it is long enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, importable, parts

LEAST, TIMES, BLOCK = 6, 4, 4
WHITE = r"[\x20\x09-\x0D]+"


class WaveletMatrix:
    """Integers from 0 to ``size`` - 1 with rank and order queries on ranges, for arrays of queries."""

    def __init__(self, values: np.ndarray, size: int):
        self.levels = []
        for bit in range(int(size).bit_length() - 1, -1, -1):  # a bound may be ``size`` itself
            zero = (values >> bit & 1) == 0
            before = np.concatenate([[0], np.cumsum(zero)])
            self.levels.append((bit, before))
            values = np.concatenate([values[zero], values[~zero]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of each range [lo, hi) are less than x."""
        out = np.zeros(len(lo), np.int64)
        for bit, before in self.levels:
            a, b, one = before[lo], before[hi], (x >> bit & 1) == 1
            out += np.where(one, b - a, 0)
            lo, hi = np.where(one, lo - a + before[-1], a), np.where(one, hi - b + before[-1], b)
        return out

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value of each range, from 0."""
        out = np.zeros(len(lo), np.int64)
        for bit, before in self.levels:
            a, b = before[lo], before[hi]
            one = k >= b - a
            out |= np.where(one, 1 << bit, 0)
            k = np.where(one, k - (b - a), k)
            lo, hi = np.where(one, lo - a + before[-1], a), np.where(one, hi - b + before[-1], b)
        return out

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which ranges hold a value of x or more, the smallest such value of those)."""
        k = self.below(lo, hi, x)
        there = k < hi - lo
        return there, self.kth(lo[there], hi[there], k[there])


def dyadic_blocks(symbols: np.ndarray, longest: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """(suffix array, (block length, starts, lo, hi) for each length of blocks that occur twice); lo and hi bound their interval of the array."""
    n = len(symbols)
    order = np.argsort(symbols)
    rank, count = np.empty(n, np.int64), np.empty(n, np.int64)

    def grouped(suffixes: np.ndarray, slots: np.ndarray, new: np.ndarray) -> None:
        """``suffixes`` in order at ``slots`` of the array; ``new`` marks where a class begins."""
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(new)))
        rank[suffixes] = np.repeat(slots[first], size)
        count[suffixes] = np.repeat(size, size)

    if n:
        grouped(order, np.arange(n), np.concatenate([[True], np.diff(symbols[order]) != 0]))
    array, blocks, length = order, [], 1
    while length <= max(BLOCK, longest // 2) and longest >= LEAST:  # what is longer is no block of a run, and its order is not asked for
        slots = np.flatnonzero(count[array] > 1)
        if not len(slots):
            break
        if length >= BLOCK:
            starts = np.arange(0, n, length // 2)
            starts = starts[count[starts] > 1]
            blocks.append((length, starts, rank[starts], rank[starts] + count[starts]))
        own = array[slots]
        ahead = own + length
        then = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        key = np.argsort(rank[own] * (n + 1) + then)
        own, then = own[key], then[key]
        was = rank[own]
        new = np.concatenate([[True], (np.diff(was) != 0) | (np.diff(then) != 0)])
        array[slots] = own
        grouped(own, slots, new)
        length *= 2
    return array, blocks


def candidates(symbols: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, end, period): stretches that have the period, one for each progression of blocks that occur again at one distance."""
    array, blocks = dyadic_blocks(symbols, longest)
    if not blocks:
        return []
    lo, at = np.unique(blocks[0][2], return_index=True)  # longer blocks have their intervals within those of the shortest
    size = blocks[0][3][at] - lo
    inside = np.repeat(lo, size) + ramp(size)
    places = np.sort(array[inside])
    tree = WaveletMatrix(np.searchsorted(places, array[inside]), len(places))
    found = []
    for length, starts, lo, hi in blocks:
        lo, hi = np.searchsorted(inside, lo), np.searchsorted(inside, hi)
        whole = hi - lo > 1
        starts, lo, hi = starts[whole], lo[whole], hi[whole]
        there, nearest = tree.successor(lo, hi, np.searchsorted(places, starts, side="right"))
        starts = starts[there]
        gap = places[nearest] - starts
        near = (gap <= length) & ((gap > length // 2) | (length == BLOCK))
        starts, gap = starts[near], gap[near]
        if not len(starts):
            continue
        key = np.lexsort((starts, gap))
        starts, gap = starts[key], gap[key]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(gap) != 0) | (np.diff(starts) > length)]))
        last = np.append(first[1:], len(starts)) - 1
        found += zip(starts[first].tolist(), (starts[last] + length + gap[last]).tolist(), gap[first].tolist())
    return found


def ramp(sizes: np.ndarray) -> np.ndarray:
    """0 to size - 1 for each size in turn."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def grown(symbols: np.ndarray, start: int, end: int, q: int) -> tuple[int, int]:
    """The stretch as far as it keeps the period on both sides, looked at in steps that double."""
    step = 16
    while end < len(symbols):
        same = symbols[end : end + step] == symbols[end - q : end - q + min(step, len(symbols) - end)]
        stop = int(np.argmin(same)) if not same.all() else len(same)
        end += stop
        if stop < len(same):
            break
        step *= 2
    step = 16
    while start > 0:
        low = max(0, start - step)
        same = (symbols[low:start] == symbols[low + q : start + q])[::-1]
        stop = int(np.argmin(same)) if not same.all() else len(same)
        start -= stop
        if stop < len(same):
            break
        step *= 2
    return start, end


def runs_of(symbols: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, sorted. Symbols of different texts differ; ``longest`` is the words of the longest text."""
    out = set()
    for start, end, q in candidates(symbols, longest):
        start, end = grown(symbols, start, end, q)
        if end - start >= max(LEAST, TIMES * q):
            out.add((start, end - start, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed): one row for each of ``docs``.

    Words are what white space (space, and tab to carriage return) parts; ``runs`` is sorted by start and period, words counted
    from 0. ``collapsed`` are the words, one space between, without those that some run holds after its first period.
    A null text is empty; an empty one has no words and no runs. Repeated rows are repeated, ids are not looked at. A task
    holds two megabytes of texts at a time, or one longer text whole.
    """
    importable(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            texts = [raw.split() for raw in batch.column(1).to_pylist()]
            sizes = np.array([len(words) for words in texts], np.int64)
            ends, known = np.cumsum(sizes), {}
            ids = np.fromiter((known.setdefault(w, len(known)) for words in texts for w in words), np.int64, int(sizes.sum()))
            symbols = np.repeat(np.arange(len(texts)), sizes) * max(1, len(known)) + ids
            runs = [[] for _ in texts]
            for start, length, q in runs_of(symbols, int(sizes.max(initial=0))):
                at = int(np.searchsorted(ends, start, side="right"))
                runs[at].append((start - int(ends[at] - sizes[at]), length, q))
            collapsed = []
            for words, own in zip(texts, runs):
                if own:
                    keep = np.ones(len(words), bool)
                    for start, length, q in own:
                        keep[start + q : start + length] = False
                    words = [words[k] for k in np.flatnonzero(keep)]
                collapsed.append(b" ".join(words))
            out = [{"start": s, "length": n, "period": q} for own in runs for s, n, q in own]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(own) for own in runs])]), pa.int32()), pa.array(out, kind.value_type))
            made = [pa.array(sizes), lists, pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def looped(doc_id: Column, text: Column) -> Column:
    """The text, or for a tenth of the ids its words with a loop for an end, as the query plants it; a null id counts as empty text."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    g = F.floor(h / 10)
    # bound once each: a lambda evaluates what it closes over for every element
    bound = F.transform(F.array(F.struct(words.alias("w"), g.alias("g"))), lambda s: F.struct(s["w"].alias("w"), F.size(s["w"]).alias("n"), (s["g"] % F.greatest(F.size(s["w"]), F.lit(1))).alias("a"), s["g"].alias("g")))
    bound = F.transform(bound, lambda s: F.struct(s["w"].alias("w"), s["n"].alias("n"), s["a"].alias("a"), (1 + F.floor((s["n"] - s["a"]) / (3 + s["g"] % 8))).alias("p")))
    at = lambda s, i: F.when(i >= s["a"], s["a"] + (i - s["a"]) % s["p"]).otherwise(i)
    tail = F.transform(bound, lambda s: F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(s["n"] - 1, F.lit(0))), lambda i: F.get(s["w"], at(s, i).cast("int"))), " "))
    return F.when((h % 10 == 0) & (F.length(F.regexp_replace(text, WHITE, "")) > 0), F.element_at(tail, 1)).otherwise(text)


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of ``docs`` with looped ends.

    The run named is the longest, of those the first, then that of the smallest period; without runs it is null.
    """
    rows = id_and_text(docs, id_col, text_col).select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(rows)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    most = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("s"), r["period"].alias("q"))))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), most.alias("m"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", F.col("m.s").alias("start"), (-F.col("m.n")).alias("length"), F.col("m.q").alias("period"), F.floor(1000 * -F.col("m.n") / F.col("m.q")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
