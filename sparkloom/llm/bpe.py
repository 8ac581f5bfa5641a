"""Byte-level BPE: an exact encoder by backtracking, and decoding through an offset table.

The vocabulary is a ``tokenizers`` JSON file of the byte-level BPE kind whose ids follow the merge
order. A text is cut at every space that follows a non-space, which is always a pre-token border; the
distinct segments of some megabytes of text are encoded once and their ids gathered with Arrow.

A distinct segment's pre-tokens go through the backtracking encoder. One scan of the Aho-Corasick
automaton of the vocabulary gives the longest token that starts at each byte; a table gives for each
token the next shorter one that begins it. From the longest token at the current byte down that table,
the first is taken whose pair with its left neighbour is compatible (BPE merges would not cross the
border), and the encoder steps back when none is. Every byte position is ruled out once at most, so the
time is linear.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import id_and_text, parts

VOCABULARY = "byte_bpe_50k.json"
#: Pre-tokens that a worker's cache holds at most, and the longest that it holds; bytes of text encoded at once.
CACHE_ENTRIES, CACHED_CHARS, STEP_BYTES = 300_000, 48, 2 << 20
PAIR_ENTRIES = 500_000
#: Fixed: the characters of Unicode's White_Space property, one of them before a space, and the pre-token pattern of this vocabulary.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
UNSAFE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself, or the next free one above 255."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes, the merge of each pair, the halves of each token, and the special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = [b""] * (1 + max([*model["vocab"].values(), *special.values()]))
        for word, i in model["vocab"].items():
            self.tokens[i] = bytes(letters[c] for c in word) if word not in special else word.encode()
        for word, i in special.items():
            self.tokens[i] = word.encode()
        self.special = special
        self.halves = [(i, i) for i in range(len(self.tokens))]
        self.merge: dict[tuple[int, int], int] = {}
        last = -1
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, ab = (model["vocab"][x] for x in (left, right, left + right))
            if ab <= last:
                raise ValueError(f"{path}: ids must follow the merge order")
            last = self.merge[a, b] = ab
            self.halves[ab] = (a, b)
        self.ranks = {b: i for i, b in enumerate(self.tokens) if i not in set(special.values())}
        lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        #: The offset table: token i is blob[offsets[i]:offsets[i + 1]].
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.blob = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)

    def decode(self, ids: np.ndarray, step: int = 1 << 18) -> bytes:
        out = []
        for k in range(0, len(ids), step):
            part = ids[k : k + step]
            starts, lengths = self.offsets[part], self.offsets[part + 1] - self.offsets[part]
            ends = np.cumsum(lengths)
            at = np.repeat(starts - (ends - lengths), lengths)
            at += np.arange(len(at))
            out.append(self.blob[at].tobytes())
        return b"".join(out)


class BacktrackingEncoder:
    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick
        import regex

        self.v, self.pre_tokens = vocabulary, regex.compile(PRE_TOKEN)
        rank = {token.decode("latin-1"): i for token, i in vocabulary.ranks.items() if token}
        self.automaton = ahocorasick.Automaton()
        for token, i in rank.items():
            self.automaton.add_word(token, i)
        self.automaton.make_automaton()
        self.lengths = list(map(len, vocabulary.tokens))
        #: The longest token that begins token i and is shorter, or -1.
        self.shorter = [-1] * len(vocabulary.tokens)
        for token, i in rank.items():
            self.shorter[i] = next((rank[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in rank), -1)
        self.cache = RecentCache()
        #: The pair-compatibility table, filled as pairs are met; bounded by clearing.
        self.fits: dict[int, bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left`` and ``right`` apart: undo merges on both sides of the border, latest
        first, and look for a pair across it that would have been merged before the merge just undone."""
        merge, halves, limit = self.v.merge, self.v.halves, 1 << 62
        while True:
            if merge.get((left, right), limit) < limit:
                return False
            inner_left, inner_right = halves[left][1], halves[right][0]
            if left > right and inner_left != left or inner_right == right:
                if inner_left == left:
                    return True
                limit, left = left, inner_left
            else:
                limit, right = right + 1, inner_right

    def longest_tokens(self, letters: str) -> list[int]:
        """The longest token that starts at each place, from one scan: matches come by their ends, so the last to be seen is it."""
        longest, lengths = [-1] * (len(letters) + 1), self.lengths
        for end, i in self.automaton.iter(letters):
            longest[end - lengths[i] + 1] = i
        return longest

    def encode_pre_token(self, piece: bytes) -> list[int]:
        longest, lengths, shorter, fits = self.longest_tokens(piece.decode("latin-1")), self.lengths, self.shorter, self.fits
        size, ids, open_at = len(piece), [], bytearray(b"\1") * (len(piece) + 1)
        at, i = 0, longest[0]
        while at < size:
            while i >= 0:
                if open_at[at + lengths[i]]:
                    if not ids:
                        break
                    if (ok := fits.get(pair := ids[-1] << 20 | i)) is None:
                        if len(fits) > PAIR_ENTRIES:
                            fits.clear()
                        ok = fits[pair] = self.compatible(ids[-1], i)
                    if ok:
                        break
                i = shorter[i]
            if i >= 0:
                ids.append(i)
                at += lengths[i]
                i = longest[at]
            else:
                open_at[at] = 0
                i = ids.pop()
                at -= lengths[i]
                i = shorter[i]
        return ids

    def encode_ordinary(self, text: str) -> np.ndarray:
        pieces, cache = self.pre_tokens.findall(text), self.cache
        found = list(map(cache.young.get, pieces))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    piece = pieces[k]
                    if (ids := cache.get(piece)) is None:
                        cache.put(piece, ids := array("I", self.encode_pre_token(piece.encode("utf-8"))).tobytes())
                    found[k] = ids
        return np.frombuffer(b"".join(found), dtype=np.uint32)


class RecentCache:
    """A bounded cache of two generations: what is still in use when the young one fills up stays."""

    def __init__(self, entries: int = CACHE_ENTRIES):
        self.young: dict = {}
        self.old: dict = {}
        self.half = entries // 2

    def get(self, key: str):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key: str, value) -> None:
        if len(key) <= CACHED_CHARS:
            if len(self.young) >= self.half:
                self.old, self.young = self.young, {}
            self.young[key] = value


class TextCoder:
    """Ids of whole texts. ``encode_ordinary`` encodes a text without special tokens."""

    def __init__(self, vocabulary: Vocabulary, encode_ordinary: Callable[[str], np.ndarray]):
        self.v, self.encode_ordinary = vocabulary, encode_ordinary
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.open_end = re.compile(f"[{WHITE}]\\Z")
        self.lengths = np.diff(vocabulary.offsets)

    def encode(self, text: str) -> np.ndarray:
        if self.specials is None or not any(s in text for s in self.v.special):
            return self.encode_ordinary(text).astype(np.uint32, copy=False)
        parts = self.specials.split(text)
        return np.concatenate([np.array([self.v.special[p]], np.uint32) if k % 2 else self.encode(p) for k, p in enumerate(parts)])

    def _distinct(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct segments, each after a space, and their counts. Joined they are one text that is cut again by length."""
        words = segments.to_pylist()
        alone = [k for k, w in enumerate(words) if not w or self.open_end.search(w)]  # what follows could merge with these
        ids = self.encode_ordinary("".join([" " + w for w in words if w and not self.open_end.search(w)] if alone else [" " + w for w in words])).astype(np.uint32, copy=False)
        sizes = pc.binary_length(segments).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        if alone:
            sizes[alone] = 0
        ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes), side="right")
        counts = np.diff(ends, prepend=0)
        if alone:
            ends = np.cumsum(counts)
            out, last = [], 0
            for k in alone:
                own = self.encode_ordinary(" " + words[k]).astype(np.uint32, copy=False)
                out += [ids[last : ends[k]], own]
                last, counts[k] = ends[k], len(own)
            ids = np.concatenate([*out, ids[last:]])
        return ids, counts

    def _step(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = pc.split_pattern(texts, " ")
        borders = parts.offsets.to_numpy().astype(np.int64)
        borders, flat = borders - borders[0], parts.flatten()
        coded = flat.dictionary_encode()
        ids, counts = self._distinct(coded.dictionary)
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first = [self.encode_ordinary(w) if w else np.empty(0, np.uint32) for w in flat.take(pa.array(borders[:-1])).to_pylist()]
        at[borders[:-1]] = len(counts) + np.arange(len(first))
        counts = np.concatenate([counts, np.array([len(f) for f in first], np.int64)])
        ids = np.concatenate([ids, *first]).astype(np.uint32, copy=False)
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)])), pa.array(ids))
        total = np.concatenate([[0], np.cumsum(counts[at])])
        return lists.take(pa.array(at)).flatten().to_numpy(), total[borders[1:]]

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text in turn, as unsigned 32-bit integers. A text in which a space follows white space has no
        safe cut there and is encoded alone, like one that holds a special token."""
        alone = pc.match_substring_regex(texts, UNSAFE)
        for s in self.v.special:
            alone = pc.or_(alone, pc.match_substring(texts, s))
        alone = alone.to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + STEP_BYTES, side="right")))
            part, own = texts.slice(start, stop - start), alone[start:stop]
            safe = part.filter(pa.array(~own))
            ids, border = self._step(safe) if len(safe) else (np.empty(0, np.uint32), [])
            last, k = 0, 0
            for i, single in enumerate(own):
                if single:
                    yield self.encode(part[i].as_py())
                else:
                    yield ids[last : border[k]]
                    last, k = border[k], k + 1
            start = stop


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.cache
def backtracking_coder(path: str) -> TextCoder:
    return TextCoder(vocabulary(path), BacktrackingEncoder(vocabulary(path)).encode_ordinary)


@functools.cache
def library_coder(path: str) -> TextCoder:
    """The same ids by a library's encoder, for operators that only need ids."""
    import tiktoken

    v = vocabulary(path)
    encoding = tiktoken.Encoding("byte-bpe", pat_str=PRE_TOKEN, mergeable_ranks=v.ranks, special_tokens={})
    return TextCoder(v, lambda text: np.array(encoding.encode_ordinary(text), dtype=np.uint32) if len(text) < 64 else encoding.encode_to_numpy(text, disallowed_special=()))


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids binary, n_tokens, decoded): ids are little-endian unsigned 32-bit.

    Null and empty texts have no ids and decode to the empty text. Repeated rows are encoded each;
    other columns are not read. A string of the vocabulary's special tokens becomes that token.
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, v = backtracking_coder(path), vocabulary(path)
        for batch in parts(batches, 1):
            ids = list(coder.encode_all(batch.column(1)))
            decoded = [v.decode(i).decode("utf-8", "replace") for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()), pa.array([len(i) for i in ids], pa.int64()), pa.array(decoded, pa.string())], names=["doc_id", "ids", "n_tokens", "decoded"])

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, n_tokens long, decoded string")


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text; rules as in ``encode_decode``.

    Ids and decoded bytes are hashed where they are made, so that they need not travel.
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, v = backtracking_coder(path), vocabulary(path)
        for batch in parts(batches, 1):
            n, a, b = [], [], []
            for ids in coder.encode_all(batch.column(1)):
                n.append(len(ids))
                a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                b.append(hashlib.sha256(v.decode(ids).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
