"""Edit-aware token counts: a segment tree of counts per document, and edits that re-encode only what they touch.

A document is cut into leaves of some hundred characters, each border at a space after a non-space,
which is always a pre-token border; so a document's count is the sum of its leaves' counts. The tree
is an array: node k has children 2k and 2k + 1, the leaves stand in its second half, node 1 is the
document's count.

An edit replaces the leaves that it touches by one region. A border stays a border while the characters
on its two sides stay, so the region also takes the neighbouring leaf when an edit reaches a leaf's first
or last character. Only the region is encoded again; its count goes to the region's first leaf, the
others become empty, and the sums on their paths to the root are set anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import TextCoder, default_vocabulary, library_coder
from .common import id_and_text, parts

LEAF_CHARS = 512
#: Fixed: Unicode's White_Space characters.
SPACES = frozenset("\t\n\v\f\r \x85\xa0     　") | {chr(c) for c in range(0x2000, 0x200B)}
EDITS = "array<struct<pos:long,remove:long,insert:string>>"


def leaf_starts(text: str, leaf_chars: int = LEAF_CHARS) -> list[int]:
    starts, at = [0], 0
    while (at := text.find(" ", at + leaf_chars)) > 0:
        while at > 0 and text[at - 1] in SPACES:
            at = text.find(" ", at + 1)
        if at < 0:
            break
        starts.append(at)
    return starts


def leaf_counts(text: str, starts: list[int], ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Tokens of each leaf, from the ids of the whole text."""
    if len(starts) == 1:
        return np.array([len(ids)], np.int64)
    if text.isascii():
        sizes = np.array([*starts[1:], len(text)], np.int64)
    else:
        sizes = np.cumsum([len(text[a:b].encode()) for a, b in zip(starts, [*starts[1:], len(text)])])
    return np.diff(np.searchsorted(np.cumsum(lengths[ids]), sizes, side="right"), prepend=0)


def build_tree(counts: np.ndarray) -> np.ndarray:
    width = 1 << max(0, int(len(counts) - 1).bit_length())
    tree = np.zeros(2 * width, np.int64)
    tree[width : width + len(counts)] = counts
    while width > 1:
        tree[width // 2 : width] = tree[width : 2 * width : 2] + tree[width + 1 : 2 * width : 2]
        width //= 2
    return tree


def apply_edit(text: str, starts: np.ndarray, tree: np.ndarray, edit: dict, coder: TextCoder) -> tuple[str, int]:
    """The edited text and how many characters were encoded; ``starts`` and ``tree`` are changed in place.

    Places beyond the end are the end; negative ones are 0.
    """
    pos = min(max(0, edit["pos"] or 0), len(text))
    stop = min(len(text), pos + max(0, edit["remove"] or 0))
    new = edit["insert"] or ""
    ends = np.append(starts[1:], len(text))
    # leaves that hold a character next to the edit; empty leaves have the start of the leaf after them
    first = max(0, int(np.searchsorted(starts, pos, side="right")) - 1)
    while first > 0 and (starts[first] >= pos or starts[first] == ends[first]):
        first -= 1
    last = max(first, int(np.searchsorted(ends, stop, side="right")))
    last = min(last, len(starts) - 1)
    low, high = int(starts[first]), int(ends[last])
    region = text[low:pos] + new + text[stop:high]
    shift = len(new) - (stop - pos)
    starts[first + 1 : last + 1] = high + shift
    starts[last + 1 :] += shift
    width = len(tree) // 2
    tree[width + first] = len(coder.encode(region))
    tree[width + first + 1 : width + last + 1] = 0
    a, b = (width + first) // 2, (width + last) // 2
    while a:
        tree[a : b + 1] = tree[2 * a : 2 * b + 2].reshape(-1, 2).sum(1)
        a, b = a // 2, b // 2
    return text[:low] + region + text[high:], len(region)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS, path: str | None = None) -> DataFrame:
    """(doc_id, text, starts, tree): one segment tree per document; ``tree[1]`` is its token count.

    A null or empty text has one leaf of no tokens. Repeated rows get a tree each. Other columns are not
    read. Leaf borders need a space, so a long text without one is a single leaf.
    """
    path = path or default_vocabulary()
    rows = id_and_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_coder(path)
        for batch in parts(batches, 1):
            starts, trees = [], []
            for text, ids in zip(batch.column(1).to_pylist(), coder.encode_all(batch.column(1))):
                own = leaf_starts(text, leaf_chars)
                starts.append(np.array(own, np.int64))
                trees.append(build_tree(leaf_counts(text, own, ids, coder.lengths)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(starts, pa.list_(pa.int64())), pa.array(trees, pa.list_(pa.int64()))], names=["doc_id", "text", "starts", "tree"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, starts array<long>, tree array<long>")


def apply_edits(index: DataFrame, edits_col: str = "edits", path: str | None = None) -> DataFrame:
    """Apply each document's edits in order: (doc_id, text, starts, tree, tokens_before, n_tokens, n_edits, encoded_chars).

    ``edits_col`` is an array of (pos, remove, insert) in characters of the text as the edits before it
    left it; null is no edit. ``encoded_chars`` counts what was encoded again.
    """
    path = path or default_vocabulary()
    rows = index.select("doc_id", "text", "starts", "tree", F.coalesce(F.col(edits_col), F.array().cast(EDITS)).cast(EDITS).alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_coder(path)
        for batch in parts(batches, 1):
            out: list[list] = [[] for _ in range(7)]
            for text, starts, tree, edits in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                starts, tree = np.array(starts, np.int64), np.array(tree, np.int64)
                before, seen = int(tree[1]), 0
                for edit in edits:
                    text, n = apply_edit(text, starts, tree, edit, coder)
                    seen += n
                for column, value in zip(out, (text, starts, tree, before, int(tree[1]), len(edits), seen)):
                    column.append(value)
            kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, kinds)], names=["doc_id", "text", "starts", "tree", "tokens_before", "n_tokens", "n_edits", "encoded_chars"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, starts array<long>, tree array<long>, tokens_before long, n_tokens long, n_edits long, encoded_chars long")


def sample_edits(doc_id: Column, text: Column) -> Column:
    """Three edits for every document, from its id and text: a word goes in, a stretch goes out, a line is added at the end."""
    size = F.length(text).cast("long")
    at = lambda salt: F.pmod(F.xxhash64(doc_id, F.lit(salt)), size + 1)
    return F.array(
        F.struct(at(1).alias("pos"), F.lit(0).cast("long").alias("remove"), F.lit(" revised ").alias("insert")),
        F.struct(at(2).alias("pos"), F.pmod(F.xxhash64(doc_id), F.lit(64)).alias("remove"), F.substring(text, 1, 24).alias("insert")),
        F.struct((size + 1000).alias("pos"), F.lit(0).cast("long").alias("remove"), F.lit("\nEnd of file.").alias("insert")),
    ).cast(EDITS)
