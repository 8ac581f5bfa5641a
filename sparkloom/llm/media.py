"""Matroska media columns: write samples as Matroska, and parse EBML into packet tables.

``read_matroska`` walks variable-length EBML elements (also of unknown size), tracks, clusters, simple
blocks and block groups with no, Xiph, fixed-size or EBML lacing, and cues. It gives one row per file
with an array of packets, each with its track, time, cluster and byte range in the file, so a packet's
bytes can be cut from the column without parsing again. ``packet_table`` explodes it to a row per packet.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, parts

#: Fixed: element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, AUDIO, RATE, CHANNELS, BITS = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE = 0x4282
MASTERS = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS}
#: An unknown-sized element ends where one of these, of its own level or above, begins.
TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}

#: Masters within masters that a file can have; the format needs five.
DEEPEST = 32

SAMPLE_RATE, FRAME, LACED, BLOCKS = 8000, 2048, 4, 4
PAYLOAD_UNIT = 64


def vint(value: int, width: int = 0) -> bytes:
    """A size or lace number: as many leading zero bits as further bytes. All ones is reserved for unknown."""
    n = width or next(k for k in range(1, 9) if value < (1 << 7 * k) - 1)
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(sizes: list[int], kind: int) -> bytes:
    """The lace header of all sizes but the last. kind: 1 Xiph, 2 fixed, 3 EBML."""
    out = bytes([len(sizes) - 1])
    if kind == 1:
        for n in sizes[:-1]:
            out += b"\xff" * (n // 255) + bytes([n % 255])
    elif kind == 3:
        out += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = next(k for k in range(1, 9) if abs(b - a) < (1 << 7 * k - 1) - 1)
            out += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return out


def write_samples(payload: bytes) -> bytes:
    """8-bit samples, mono, as a Matroska file with laced blocks, clusters and cues."""
    ms = lambda samples: samples * 1000 // SAMPLE_RATE
    head = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(DOC_TYPE, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", ms(len(payload)))) + element(MUXING_APP, b"sparkloom") + element(WRITING_APP, b"sparkloom"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", SAMPLE_RATE)) + number(CHANNELS, 1) + number(BITS, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    for k in range(0, len(payload), FRAME * LACED * BLOCKS):
        blocks = [number(TIMESTAMP, ms(k))]
        for j in range(k, min(len(payload), k + FRAME * LACED * BLOCKS), FRAME * LACED):
            frames = [payload[i : min(i + FRAME, j + FRAME * LACED)] for i in range(j, min(len(payload), j + FRAME * LACED), FRAME)]
            sizes = list(map(len, frames))
            kind = 0 if len(frames) == 1 else (2, 3, 1)[j // (FRAME * LACED) % 3] if len(set(sizes)) == 1 else 3
            body = b"\x81" + struct.pack(">h", ms(j - k)) + bytes([0x80 | kind << 1]) + (lace(sizes, kind) if kind else b"") + b"".join(frames)
            blocks.append(element(SIMPLE_BLOCK, body))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, number(CUE_TIME, ms(k)) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


class Matroska:
    """What one file holds. A broken file keeps what was read before the fault, and says so in ``error``."""

    def __init__(self, data: bytes):
        self.data, self.error = data, None
        self.packets: list[dict] = []
        self.tracks: list[dict] = []
        self.cues: list[dict] = []
        self.cluster_offsets: set[int] = set()
        self.scale, self.cluster, self.cluster_at, self.segment_at, self.clusters = 1_000_000, 0, 0, 0, 0
        try:
            if data[:4] != EBML.to_bytes(4, "big"):
                raise ValueError("no EBML header")
            self.walk(0, len(data), 0)
        except (ValueError, IndexError, struct.error) as fault:
            self.error = str(fault) or type(fault).__name__
        self.close()

    def close(self) -> None:
        """Leave out what a table cannot hold, and hold the cues against the clusters."""
        for name, rows in (("packet", self.packets), ("track", self.tracks), ("cue", self.cues)):
            whole = [r for r in rows if all(not isinstance(v, int) or -(1 << 63) <= v < 1 << 63 for v in r.values())]
            if len(whole) < len(rows):
                self.error = self.error or f"{name} with a number out of range"
                rows[:] = whole
        self.cues[:] = [c for c in self.cues if "offset" in c]
        self.lost_cues = sum(c["offset"] not in self.cluster_offsets for c in self.cues)

    def read_vint(self, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
        """(value, place after it, whether all its bits are ones)."""
        first = self.data[at]
        if not first:
            raise ValueError(f"bad number at {at}")
        n = 9 - first.bit_length()
        if at + n > len(self.data):
            raise ValueError(f"cut off at {at}")
        raw = int.from_bytes(self.data[at : at + n], "big")
        value = raw & ((1 << 7 * n) - 1)
        return (raw if keep_marker else value), at + n, value == (1 << 7 * n) - 1

    def walk(self, at: int, stop: int, parent: int, open_ended: bool = False, depth: int = 0) -> int:
        entry: dict = {}
        if parent == TRACK_ENTRY:
            self.tracks.append(entry)
        elif parent == CUE_POINT:
            self.cues.append(entry)
        elif parent in (AUDIO, CUE_POSITIONS):
            entry = (self.tracks if parent == AUDIO else self.cues)[-1]
        while at < stop:
            ident, body, _ = self.read_vint(at, keep_marker=True)
            if open_ended and ident in TOP and not (parent == SEGMENT and ident not in (EBML, SEGMENT)):
                return at
            size, body, unknown = self.read_vint(body)
            end = stop if unknown else body + size
            if end > stop:
                raise ValueError(f"element at {at} is cut off")
            if ident == SEGMENT:
                self.segment_at = body
            elif ident == CLUSTER:
                self.cluster_at, self.cluster, self.clusters = at, 0, self.clusters + 1
                self.cluster_offsets.add(at)
            if ident in MASTERS:
                if depth > DEEPEST:
                    raise ValueError(f"elements nested too deep at {at}")
                at = self.walk(body, end, ident, unknown, depth + 1)
                at = at if unknown else end
                continue
            if unknown:
                raise ValueError(f"unknown size at {at}")
            raw = self.data[body:end] if size <= 4096 and ident not in (SIMPLE_BLOCK, BLOCK) else b""
            value = int.from_bytes(raw, "big") if size <= 8 else 0
            if ident == TIMESTAMP_SCALE and parent == INFO:
                self.scale = value
            elif ident == TIMESTAMP and parent == CLUSTER:
                self.cluster = value
            elif ident in (SIMPLE_BLOCK, BLOCK):
                self.block(body, end, bool(self.data[body + 3] & 0x80) if ident == SIMPLE_BLOCK and body + 3 < end else None)
            elif ident == REFERENCE and parent == BLOCK_GROUP:
                entry["reference"] = True
            elif name := {(TRACK_ENTRY, TRACK_NUMBER): "track", (TRACK_ENTRY, TRACK_TYPE): "type", (AUDIO, CHANNELS): "channels", (AUDIO, BITS): "bits", (CUE_POINT, CUE_TIME): "time", (CUE_POSITIONS, CUE_TRACK): "track", (CUE_POSITIONS, CUE_CLUSTER): "position"}.get((parent, ident)):
                entry[name] = value
            elif (parent, ident) == (TRACK_ENTRY, CODEC):
                entry["codec"] = raw.decode("ascii", "replace")
            elif (parent, ident) == (AUDIO, RATE):
                entry["rate"] = struct.unpack(">f" if size == 4 else ">d", raw)[0] if size else 0.0
            at = end
        if parent == CUE_POINT:
            entry["time_ns"] = entry.pop("time", 0) * self.scale
            entry["offset"] = self.segment_at + entry.pop("position", 0)
        elif parent == BLOCK_GROUP:
            for p in reversed(self.packets):
                if p["keyframe"] is not None:
                    break
                p["keyframe"] = "reference" not in entry
        return at

    def block(self, at: int, end: int, keyframe: bool | None) -> None:
        track, at, _ = self.read_vint(at)
        if at + 3 > end:
            raise ValueError(f"block at {at} is cut off")
        time, flags = struct.unpack(">hB", self.data[at : at + 3])
        at, kind = at + 3, flags >> 1 & 3
        sizes = []
        if kind:
            n, at = self.data[at] + 1, at + 1
            if kind == 1:
                for _ in range(n - 1):
                    size = 0
                    while self.data[at] == 255:
                        size, at = size + 255, at + 1
                    sizes.append(size + self.data[at])
                    at += 1
            elif kind == 3:
                for k in range(n - 1):
                    value, after, _ = self.read_vint(at)
                    sizes.append(value if not k else sizes[-1] + value - (1 << 7 * (after - at) - 1) + 1)
                    at = after
            elif (end - at) % n:
                raise ValueError(f"fixed lace at {at} does not divide")
            else:
                sizes = [(end - at) // n] * (n - 1)
        sizes.append(end - at - sum(sizes))
        if min(sizes) < 0:
            raise ValueError(f"lace at {at} is too long")
        for k, size in enumerate(sizes):
            self.packets.append({"track": track, "time_ns": (self.cluster + time) * self.scale, "frame": k, "lacing": kind, "keyframe": keyframe, "cluster_offset": self.cluster_at, "offset": at, "length": size})
            at += size


PACKET = pa.struct([("track", pa.int64()), ("time_ns", pa.int64()), ("frame", pa.int32()), ("lacing", pa.int32()), ("keyframe", pa.bool_()), ("cluster_offset", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
TRACK = pa.struct([("track", pa.int64()), ("type", pa.int64()), ("codec", pa.string()), ("rate", pa.float64()), ("channels", pa.int64()), ("bits", pa.int64())])
CUE = pa.struct([("time_ns", pa.int64()), ("track", pa.int64()), ("offset", pa.int64())])
PACKET_SQL = "array<struct<track:long,time_ns:long,frame:int,lacing:int,keyframe:boolean,cluster_offset:long,offset:long,length:long>>"
TRACK_SQL = "array<struct<track:long,type:long,codec:string,rate:double,channels:long,bits:long>>"
CUE_SQL = "array<struct<time_ns:long,track:long,offset:long>>"


def write_matroska(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, zero-padded to a positive multiple of 64, as samples in a file.

    A null text is empty and gives 64 zero samples. Repeated rows are written each; other columns are not read.
    """
    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            texts = batch.column(1).to_pylist()
            media = [write_samples(t + bytes((-len(t)) % PAYLOAD_UNIT or (0 if t else PAYLOAD_UNIT))) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def read_matroska(files: DataFrame, media_col: str = "media", payload: bool = False) -> DataFrame:
    """The columns of ``files`` but the media, with packets, tracks, cues, n_clusters, error, and ``payload`` if asked for.

    ``payload`` joins the bytes of all packets in file order. Null media give empty arrays and the error
    "null"; broken media keep what was read before the fault. A column of ``files`` that bears one of the
    new names is replaced.
    """
    made = {"packets": PACKET_SQL, "tracks": TRACK_SQL, "cues": CUE_SQL, "n_clusters": "long", "error": "string"} | ({"payload": "binary"} if payload else {})
    kept = [c for c in files.columns if c != media_col and c not in made]
    rows = files.select(*(f"`{c}`" for c in kept), F.col(media_col).alias("media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, len(kept)):
            out: list[list] = [[] for _ in made]
            for data in batch.column(len(kept)).to_pylist():
                m = Matroska(data or b"")
                body = b"".join([m.data[p["offset"] : p["offset"] + p["length"]] for p in m.packets]) if payload else None
                for column, value in zip(out, (m.packets, m.tracks, m.cues, m.clusters, m.error if data is not None else "null", body)):
                    column.append(value)
            kinds = [pa.list_(PACKET), pa.list_(TRACK), pa.list_(CUE), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), *map(pa.array, out, kinds)], names=[*kept, *made])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join([*fields, *(f"{k} {v}" for k, v in made.items())]))


def packet_table(parsed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per packet: the id, its number in the file, and the packet's fields."""
    return parsed.select(F.col(id_col).alias("doc_id"), F.posexplode("packets").alias("packet_no", "p")).select("doc_id", "packet_no", "p.*")


def features(samples: np.ndarray, m: Matroska) -> str:
    """A few numbers of the decoded samples and of how they are stored; a file without samples has no mean and no peak."""
    sound = f"mean={samples.mean():.4f} peak={int(samples.max())}" if len(samples) else "mean=- peak=-"
    end = m.packets[-1]["time_ns"] // 1_000_000 if m.packets else 0
    return f"packets={len(m.packets)} {sound} clusters={m.clusters} cues={len(m.cues)} lacings={len({p['lacing'] for p in m.packets})} end_ms={end}"


FEATURE_COLUMNS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, " + f"packets {PACKET_SQL}, tracks {TRACK_SQL}, cues {CUE_SQL}, lost_cues int, error string"


def payload_features(files: DataFrame) -> DataFrame:
    """What is read back from (doc_id, n_bytes, media): the payload's digests, features, and the packet, track and cue tables.

    ``packets`` holds track, time and byte range of each packet, ``lost_cues`` counts cues that point at no cluster.
    Broken media keep what was read before the fault, and ``error`` names it; null media are empty bytes with the error "null".
    """
    import hashlib
    import zlib

    id_type = files.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 2):
            out: list[list] = [[] for _ in range(11)]
            for media in batch.column(2).to_pylist():
                data = media or b""
                m = Matroska(data)
                body = b"".join([data[p["offset"] : p["offset"] + p["length"]] for p in m.packets])
                error = "null" if media is None else m.error
                values = (len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-PAYLOAD_UNIT:]), len(data), hashlib.sha256(data).hexdigest(), features(np.frombuffer(body, np.uint8), m), m.packets, m.tracks, m.cues, m.lost_cues, error)
                for column, value in zip(out, values):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(PACKET), pa.list_(TRACK), pa.list_(CUE), pa.int32(), pa.string()]
            names = [c.split()[0] for c in FEATURE_COLUMNS.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, out, kinds)], names=["doc_id", "n_bytes", *names])

    return files.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {id_type}, n_bytes long, {FEATURE_COLUMNS}")
