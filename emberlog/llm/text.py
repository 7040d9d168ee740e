"""Whole batches of texts as numpy arrays: words, their positions and hashes.

All operators that run in Python workers share these helpers. A batch is cut
into blocks of at most ``BLOCK_BYTES`` of text (one document may be longer, it
is never split), so that memory stays bounded whatever the Arrow batch holds.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1_000_000

#: Bytes that end a word: space and U+0009 to U+000D.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes outside letters: ASCII apart from A-Z and a-z; bytes from 0x80 belong to letters of other scripts.
NOT_LETTERS = np.ones(256, bool)
NOT_LETTERS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
#: Bits of the first k bytes of a chunk of eight.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Byte ranges longer than this are hashed one by one, by a keyed BLAKE2.
_LONG, _KEY = 64, b"emberlog"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Block:
    """Some documents of a batch: ``rows`` in it, the bytes of their texts and each text's place in them."""

    def __init__(self, rows: range, data: np.ndarray, offsets: np.ndarray):
        self.rows, self.data, self.offsets = rows, data, offsets

    def __len__(self) -> int:
        return len(self.rows)

    def raw(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()

    def spans(self, separators: np.ndarray = SEPARATORS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and for each document the index of its first word (and one more)."""
        inside = ~separators[self.data]
        if not len(inside):
            empty = np.zeros(0, np.int64)
            return empty, empty, np.zeros(len(self) + 1, np.int64)
        full = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        before[full] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        after[np.append(full[1:], len(inside)) - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def identities(self, starts: np.ndarray, ends: np.ndarray, translate: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each byte range, which together identify it.

        Chunks of eight bytes go through two chains of mixing steps; neither is a
        polynomial, so no family of texts is known to collide in both.
        """
        data = self.data if translate is None else translate[self.data]
        room = np.zeros(len(data) + 8, np.uint8)
        room[: len(data)] = data
        chunks = np.ndarray((len(data) + 1,), "<u8", room, strides=(1,))  # the eight bytes from each place on
        sizes = ends - starts
        left = sizes.astype(np.uint64)
        a, b = mix(left ^ np.uint64(0x9E3779B97F4A7C15)), mix(left + np.uint64(0xD6E8FEB86659FD93))
        some = np.flatnonzero((sizes > 0) & (sizes <= _LONG))
        at = 0
        while len(some):
            chunk = chunks[starts[some] + at] & _MASKS[np.minimum(sizes[some] - at, 8)]
            a[some] = mix(a[some] ^ chunk)
            b[some] = mix((b[some] + chunk) * np.uint64(0x9FB21C651E98DF25))
            at += 8
            some = some[sizes[some] > at]
        for k in np.flatnonzero(sizes > _LONG).tolist():
            digest = hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=16, key=_KEY).digest()
            a[k], b[k] = np.frombuffer(digest, np.uint64)
        return mix(a + b), b

    def hashes(self, starts: np.ndarray, ends: np.ndarray, translate: np.ndarray | None = None) -> np.ndarray:
        """The first of the two: a 64-bit hash of each byte range."""
        return self.identities(starts, ends, translate)[0]


def numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number from 0 on for each distinct identity (a, b), the same for equal ones."""
    _, first, codes = np.unique(a, return_index=True, return_inverse=True)
    if (b == b[first][codes]).all():
        return codes
    return np.unique(np.stack([a, b], 1), axis=0, return_inverse=True)[1].reshape(-1)


def give_back() -> None:
    """Returns freed memory to the system, as a worker that waits for its next task shares a machine with others."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of an Arrow array of strings; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Block(range(at, to), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to
    give_back()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n neighbouring values (also of those across documents)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out = out * np.uint64(0x9FB21C651E98DF25) + hashes[k : len(hashes) - n + 1 + k]
        out ^= out >> np.uint64(29)
    return mix(out)


def inner(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of n words, those inside one document: their first word and their document."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[:-1][doc], doc


class Codes:
    """Results of a slow function of byte strings, kept in arrays sorted by the strings' hashes.

    ``look`` returns for each string its place in ``values``; unknown strings
    are sent, each once, through ``encode``. A string is known by both its hashes: one that only
    shares the first with another is encoded by itself. Past ``bound`` entries all are forgotten.
    A worker keeps one table: when another is used, the one before is emptied.
    """

    held: Codes | None = None

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], bound: int = 500_000):
        """encode: from byte strings to all their codes and each string's number of codes."""
        self.encode, self.bound = encode, bound
        self.clear()

    def clear(self) -> None:
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.new_keys, self.new_at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.checks = np.zeros(0, np.uint64)
        self.lengths, self.starts, self.codes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    @staticmethod
    def release() -> None:
        """Empties this worker's table; for operators that use none."""
        if Codes.held is not None:
            Codes.held.clear()
            Codes.held = None

    @staticmethod
    def _find(keys: np.ndarray, at: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), -1, np.int64)
        i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[i] == wanted, at[i], -1)

    def _add(self, block: Block, starts: np.ndarray, ends: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Encodes strings and returns their places."""
        data, before = block.data, len(self.lengths)
        codes, lengths = self.encode([data[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
        self.starts = np.concatenate([self.starts, len(self.codes) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths.astype(np.int32)])
        self.codes = np.concatenate([self.codes, codes.astype(np.int32)])
        self.checks = np.concatenate([self.checks, checks])
        return before + np.arange(len(starts))

    def look(self, block: Block, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
        if Codes.held is not self:
            if Codes.held is not None:
                Codes.held.clear()
            Codes.held = self
        wanted, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.lengths) > self.bound:
            self.clear()
        place = self._find(self.keys, self.at, wanted)
        miss = np.flatnonzero(place < 0)
        if len(miss):
            place[miss] = self._find(self.new_keys, self.new_at, wanted[miss])
            miss = miss[place[miss] < 0]
        if len(miss):
            place[miss] = self._add(block, starts[where[miss]], ends[where[miss]], checks[where[miss]])
            keys, values = np.concatenate([self.new_keys, wanted[miss]]), np.concatenate([self.new_at, place[miss]])
            order = np.argsort(keys, kind="stable")
            self.new_keys, self.new_at = keys[order], values[order]
            if len(self.new_keys) > max(50_000, len(self.keys) // 8):  # merged now and then only
                keys, values = np.concatenate([self.keys, self.new_keys]), np.concatenate([self.at, self.new_at])
                order = np.argsort(keys, kind="stable")
                self.keys, self.at = keys[order], values[order]
                self.new_keys, self.new_at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out = place[back]
        other = np.flatnonzero(self.checks[out] != checks)
        if len(other):  # another string's codes
            out[other] = self._add(block, starts[other], ends[other], checks[other])
        return out

    def gather(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All codes of the strings at these places, one after another, and where each string's begin (and one more)."""
        lengths = self.lengths[place].astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        return self.codes[np.arange(bounds[-1]) + np.repeat(self.starts[place] - bounds[:-1], lengths)], bounds
