"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

Each task packs the documents of its partition and needs no shuffle. A document that one sequence can hold
waits whole in a pool of bounded size. A longer one is cut: its tokens without loss into pieces that leave room
for a full share of loss, its loss-bearing ones into pieces of that share, so that the two kinds complete each
other (where loss is not limited, into whole sequences of its own). A sequence takes from the pool the piece
with the largest dot product of its demand and the room left, both as shares of the limits, among the pieces
that fit on all three. If none fits, the piece with the most tokens is cut to what still has room.

A sequence that a limit closes before it is full, and the last ones of a partition, give back tokens until
their length is a power of two, which needs no padding. So every limit holds and nothing is padded.

A sequence's id is its task's partition number and a counter: a task that runs again gives its own
documents' pieces again, whatever other tasks did.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import default_vocabulary, library_coder
from .common import parts, text_or_empty


@dataclasses.dataclass(frozen=True)
class Limits:
    """Of one sequence. ``end_id`` is put after each document; ``pool`` pieces wait at most."""

    tokens: int = 2048
    segments: int = 512
    loss_tokens: int = 2048
    end_id: int = 1
    pool: int = 1024


#: For plain documents, which have no prompt of their own: their first half is the prompt, and a sequence learns 5/8 of its places at most.
DOCUMENTS, PROMPT_SHARE = Limits(loss_tokens=1280), 0.5


class Packer:
    """Takes documents as id arrays and gives rows (document, start, length, sequence, offset, loss)."""

    def __init__(self, limits: Limits, first_sequence: int):
        self.limits, self.sequence = limits, first_sequence
        n = limits.pool
        self.docs: list = [None] * n
        self.at, self.end, self.loss_from = (np.zeros(n, np.int64) for _ in range(3))
        self.live = np.zeros(n, bool)
        self.rows: list[tuple] = []

    @staticmethod
    def loss(start, stop, loss_from):
        return np.maximum(0, stop - np.maximum(start, loss_from))

    def add(self, doc, n: int, loss_from: int) -> None:
        lim = self.limits
        if n <= lim.tokens and self.loss(0, n, loss_from) <= lim.loss_tokens:
            self.wait(doc, 0, n, loss_from)
            return
        turn = min(n, loss_from)
        spare = max(0, lim.tokens - lim.loss_tokens)
        for start, stop, step in ((0, turn, spare or lim.tokens), (turn, n, lim.loss_tokens)) if spare else ((0, n, lim.tokens),):
            for k in range(start, stop, step):
                end = min(stop, k + step)
                if end - k == lim.tokens:
                    self.rows.append((doc, k, end - k, self.sequence, 0, int(self.loss(k, end, loss_from))))
                    self.sequence += 1
                else:
                    self.wait(doc, k, end, loss_from)

    def wait(self, doc, start: int, stop: int, loss_from: int) -> None:
        if self.live.all():
            while self.live.sum() > self.limits.pool // 2:
                self.fill(self.limits.tokens)
        k = int(np.argmin(self.live))
        self.docs[k], self.live[k] = doc, True
        self.at[k], self.end[k], self.loss_from[k] = start, stop, loss_from

    def fill(self, tokens: int) -> None:
        """Close one sequence of so many tokens, or of the largest power of two that the limits leave."""
        lim = self.limits
        most = np.array([lim.tokens, lim.segments, lim.loss_tokens], float)
        room, taken = np.array([tokens, lim.segments, lim.loss_tokens], float), []
        slots = np.flatnonzero(self.live)
        start, stop, loss_from = self.at[slots], self.end[slots], self.loss_from[slots]
        need = np.stack([stop - start, np.ones(len(slots)), self.loss(start, stop, loss_from)], 1)
        shares, open_ = need / most, np.ones(len(slots), bool)
        while room[0] > 0 and room[1] > 0 and open_.any():
            fits = open_ & (need <= room).all(1)
            if fits.any():
                j = int(np.argmax(np.where(fits, shares @ (room / most), -1.0)))
                cut = int(stop[j])
            else:  # how far each could be cut: the furthest
                far = np.minimum(np.minimum(stop, start + int(room[0])), np.maximum(start, loss_from) + int(room[2]))
                j = int(np.argmax(np.where(open_, far - start, -1)))
                cut = int(far[j])
                if cut <= start[j]:
                    break
            taken.append((slots[j], int(start[j]), cut))
            room -= (cut - start[j], 1, self.loss(start[j], cut, loss_from[j]))
            open_[j] = False  # what is left of a cut piece goes to another sequence
        length = sum(cut - at for _, at, cut in taken)
        over = 0 if length == tokens == lim.tokens else length - (1 << (length.bit_length() - 1))
        while over:  # give tokens back from the end
            k, at, cut = taken.pop()
            back = min(over, cut - at)
            if back < cut - at:
                taken.append((k, at, cut - back))
            over -= back
        offset = 0
        for k, at, cut in taken:
            self.rows.append((self.docs[k], at, cut - at, self.sequence, offset, int(self.loss(at, cut, self.loss_from[k]))))
            offset += cut - at
            self.at[k] = cut
            if cut == self.end[k]:
                self.live[k], self.docs[k] = False, None
        self.sequence += 1

    def finish(self) -> None:
        while self.live.any():
            self.fill(self.limits.tokens)

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", loss_from_col: str | None = None, prompt_share: float = 0.0, limits: Limits = Limits(), path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens, and ``ids`` if asked for.

    ``loss_from_col`` has the number of leading tokens of a document that bear no loss (a prompt's). Without it, or
    where it is null, ``prompt_share`` of a document's tokens bear none, its first one at least. A null or empty text is the end
    token alone. Repeated rows are packed each. Other columns are not read. An empty table gives no rows. The rows of a
    partition must be the same whenever it is computed (as from a file or a shuffle by key).
    """
    path = path or default_vocabulary()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), (F.col(loss_from_col) if loss_from_col else F.lit(None)).cast("long").alias("loss_from"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = library_coder(path), Packer(limits, TaskContext.get().partitionId() << 40)
        end, id_type = np.array([limits.end_id], "<u4"), None

        def out() -> pa.RecordBatch:
            taken = packer.take()
            cols = list(zip(*taken)) if taken else [()] * 6
            pieces = [d[1][s : s + n].tobytes() for d, s, n in zip(*cols[:3])]
            arrays = [pa.array([d[0] for d in cols[0]], id_type), *(pa.array(c, pa.int64()) for c in (cols[1], cols[2], [zlib.crc32(p) for p in pieces], [len(d[1]) for d in cols[0]], cols[3], cols[4], cols[5]))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in pieces], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in parts(batches, 1):
            id_type = batch.column(0).type
            for doc_id, loss_from, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), coder.encode_all(batch.column(1))):
                ids = np.concatenate([ids.astype("<u4"), end])
                packer.add((doc_id, ids), len(ids), max(1, int(prompt_share * len(ids))) if loss_from is None else max(0, loss_from))
            yield out()
        packer.finish()
        if id_type is not None:
            yield out()

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema)
