"""SentencePiece encoding with the place of every piece in the original text, and decoding.

A text is normalised by longest prefixes through the model's compiled
character map (a double-array trie and its replacement strings), and the
source of each normalised byte is recorded. Codes are those of the normalised
bytes: the library that merges them is loaded without its own rules of
normalising, so no other normalisation takes part. Merges never join a
non-space with a following space mark (checked against the vocabulary), so a
normalised text is encoded by its distinct pieces of a run of marks and the word
behind it. The bytes of each code are projected through the alignment to a
span of the original bytes. Where the map is empty and spaces are kept, a whole
block is normalised at once by the same rule.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import shared
from emberlog.llm.text import Block, Codes, blocks, column

MARK = "▁"
_MARK = MARK.encode()
#: Rules of normalising that change nothing: no map, no mark in front, all spaces kept and shown as marks.
_NO_RULES = b"\x1a\x08\x12\x00\x18\x00\x20\x00\x28\x01"


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The numbered fields of a protocol buffer's message."""
    for number, value, _ in _placed(message):
        yield number, value


def _placed(message: bytes) -> Iterator[tuple[int, int | bytes, slice]]:
    """Number and value of each field, and where it lies in the message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        begin, key = at, varint()
        if key & 7 == 0:
            value: int | bytes = varint()
        else:
            n = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            value = message[at : at + n]
            at += n
        yield key >> 3, value, slice(begin, at)


def without_rules(message: bytes) -> bytes:
    """A model whose normaliser changes nothing; samples for its self-test go too."""
    return b"".join(message[at] for number, _, at in _placed(message) if number not in (3, 4)) + _NO_RULES


class CharacterMap:
    """A compiled map: the size of a double-array trie, its 32-bit units, and the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """The longest prefix of raw[at:] in the map: its length and what replaces it."""
        units, found = self.units, None
        if not units:
            return None
        unit = units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for k in range(at, len(raw)):
            node ^= raw[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != raw[k]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = (k + 1 - at, self.strings[value : self.strings.index(b"\0", value)])
        return found


class Model:
    """What a model file says on normalising, and its pieces; the library does the merges."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        with open(path, "rb") as file:
            raw = file.read()
        #: Takes normalised texts as they are.
        self.plain = SentencePieceProcessor(model_proto=without_rules(raw))
        pieces, rules, trained = [], {}, {}
        for number, value in fields(raw):
            if number == 1:
                pieces.append(dict(fields(value)))
            elif number == 2:
                trained = dict(fields(value))
            elif number == 3:
                rules = dict(fields(value))
        if trained.get(24, 0):
            raise ValueError("marks behind words are not supported")
        self.map = CharacterMap(rules.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))
        self.space = _MARK if self.escape else b" "
        kinds = [p.get(3, 1) for p in pieces]
        self.bytes_ = [bytes([int(p[1][3:5], 16)]) if k == 6 else p[1] for p, k in zip(pieces, kinds, strict=True)]
        #: Symbols of the user's, which the map leaves alone.
        self.symbols = sorted((p[1] for p, k in zip(pieces, kinds, strict=True) if k == 4), key=len, reverse=True)
        #: Whether codes can be had by pieces: merges only, bytes for what no piece has, no own symbols, no piece with a mark behind another character.
        self.local = self.escape and trained.get(3, 1) == 2 and 6 in kinds and not self.symbols and not any(_MARK in b.lstrip(_MARK) for b in self.bytes_)
        #: Normalised bytes of each code.
        self.sizes = np.array([len(b) for b in self.bytes_], np.int64)
        self.unknown = next((k for k, x in enumerate(kinds) if x == 2), 0)
        self.digits = [str(k) for k in range(len(pieces))]
        self.codes = Codes(self._pieces)

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        coded = self.plain.encode([p.decode("utf-8", "replace") for p in pieces], num_threads=1)
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter((x for c in coded for x in c), np.int32, int(lengths.sum())), lengths

    def _step(self, raw: bytes, at: int) -> tuple[int, bytes]:
        """Bytes of the source taken at a place, and what they become: an own symbol, the longest prefix in the map, or one character as it is."""
        for symbol in self.symbols:
            if raw.startswith(symbol, at):
                return len(symbol), symbol
        found = self.map.longest(raw, at)
        if found is None:
            byte = raw[at]
            n = 1 if byte < 0x80 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
            found = n, raw[at : at + n]
        return found

    def normalise(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes (and its end) the place in raw that it comes from.

        Where spaces are squeezed, those in front and behind go and others become one.
        """
        parts, places, at = [], [], 0
        while self.squeeze and at < len(raw):
            n, put = self._step(raw, at)
            if put != b" ":
                break
            at += n
        if at == len(raw):
            return b"", np.array([at], np.int64)
        if self.prefix:
            parts.append(self.space)
            places += [at] * len(self.space)
        drop = self.squeeze
        while at < len(raw):
            n, put = self._step(raw, at)
            if drop:
                put = put.lstrip(b" ")
            if put:
                drop = self.squeeze and put.endswith(b" ")
                put = put.replace(b" ", self.space)
                parts.append(put)
                places += [at] * len(put)
            at += n
        text, end = b"".join(parts), at
        while self.squeeze and text.endswith(self.space):
            text = text[: -len(self.space)]
            end = places[len(text)]
        return text, np.array([*places[: len(text)], end], np.int64)

    def normalised(self, block: Block) -> tuple[Block, np.ndarray]:
        """All texts of a block normalised, and the places of their bytes, with one more behind each text."""
        if self.map.units or self.squeeze or self.symbols or not self.escape:
            found = [self.normalise(block.raw(k)) for k in range(len(block))]
            offsets = np.cumsum([0, *(len(t) for t, _ in found)])
            return Block(block.rows, np.frombuffer(b"".join(t for t, _ in found), np.uint8), offsets), np.concatenate([p for _, p in found])
        # the map is empty: every character stands for itself, a space for a mark
        data, sizes = block.data, np.diff(block.offsets)
        text = np.repeat(np.arange(len(block)), sizes)
        space = data == 0x20
        room = 1 + (len(_MARK) - 1) * space.astype(np.int64)
        front = len(_MARK) * self.prefix * (sizes > 0)
        total = np.concatenate([[0], np.cumsum(room)])
        offsets = total[block.offsets] + np.concatenate([[0], np.cumsum(front)])
        at = total[:-1] + np.cumsum(front)[text]
        out = np.zeros(int(offsets[-1]), np.uint8)
        out[at] = data
        head = np.maximum.accumulate(np.where((data & 0xC0) != 0x80, np.arange(len(data)), 0)) - block.offsets[:-1][text]
        places = np.zeros(len(out) + len(block), np.int64)
        places[at + text] = head
        begins = offsets[:-1][front > 0]
        for k, byte in enumerate(_MARK):
            out[at[space] + k] = byte
            places[at[space] + text[space] + k] = head[space]
            out[begins + k] = byte
        places[offsets[1:] + np.arange(len(block))] = sizes
        return Block(block.rows, out, offsets), places

    def _cut(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the pieces of normalised texts, and each text's first piece (and one more)."""
        data = block.data
        mark = np.zeros(len(data) + 3, bool)  # of each place: whether a mark begins there, three places on
        if len(data) > 2:
            mark[3:-2] = (data[:-2] == _MARK[0]) & (data[1:-1] == _MARK[1]) & (data[2:] == _MARK[2])
        bounds = np.unique(np.concatenate([np.flatnonzero(mark[3:] & ~mark[:-3]), block.offsets]))
        return bounds[:-1], bounds[1:], np.searchsorted(bounds[:-1], block.offsets)

    def documents(self, block: Block) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The codes of each text of a block, and where each begins and ends in the bytes of the original text.

        Of the codes that one source character becomes the last has its span and the others are empty;
        so is a code of nothing but the mark put in front of a text.
        """
        own, places = self.normalised(block)
        if not self.local:
            return [self._whole(own.raw(k), places[own.offsets[k] + k : own.offsets[k + 1] + k + 1]) for k in range(len(own))]
        starts, ends, first = self._cut(own)
        codes, bounds = self.codes.gather(self.codes.look(own, starts, ends, *own.identities(starts, ends)))
        upto = bounds[first]
        text = np.repeat(np.arange(len(own)), np.diff(upto))
        end = np.cumsum(self.sizes[codes])
        begins, ends = places[end - self.sizes[codes] + text], places[end + text]
        return [(codes[i:j], begins[i:j], ends[i:j]) for i, j in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]

    def _whole(self, text: bytes, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of one normalised text, for models whose codes can't be had by pieces."""
        codes = np.array(self.plain.encode(text.decode("utf-8", "replace")), np.int32)
        at, where = 0, [0]
        for k, code in enumerate(codes.tolist()):
            to = at + int(self.sizes[code])
            if code == self.unknown:  # it stands for a run of characters that no piece has
                to, following = at + 1, self.bytes_[int(codes[k + 1])] if k + 1 < len(codes) else None
                while to < len(text) and (following is None or text[to : to + len(following)] != following):
                    to += 1
            where.append(to)
            at = to
        cuts = places[np.array(where, np.int64)]
        return codes, cuts[:-1], cuts[1:]


@cache
def model(path: str) -> Model:
    return Model(path)


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", arrays: bool = True) -> DataFrame:
    """Codes, spans and the decoded text of every row.

    Columns: the id, n_tokens, ids_sha256 (of the decimal codes joined by
    commas), decoded_sha256, spans_crc32 (of begins, then ends, as
    little-endian signed 64-bit) and, by ``arrays``, ids, begins, ends (arrays)
    and decoded. A null text counts as empty: no codes, an empty decoded text. Repeated rows are encoded each. An
    empty table gives no rows. A very long text is encoded whole, in memory that grows with its length. Columns
    apart from the two are not read, whatever their names.
    """
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32", "ids", "begins", "ends", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        m = model(path)
        digit = m.digits.__getitem__
        for batch in batches:
            ids = column(batch, "id")
            for block in blocks(column(batch, "text")):
                coded = m.documents(block)
                listed = [c.tolist() for c, _, _ in coded]
                decoded = m.library.decode(listed, num_threads=1) if listed else []
                spans = [(b, e) for _, b, e in coded]
                out = [
                    ids.slice(block.rows[0], len(block)),
                    pa.array([len(c) for c in listed], pa.int64()),
                    pa.array([hashlib.sha256(",".join(map(digit, c)).encode()).hexdigest() for c in listed]),
                    pa.array([hashlib.sha256(d.encode("utf-8", "replace")).hexdigest() for d in decoded], pa.string()),
                    pa.array([zlib.crc32(e.astype("<i8"), zlib.crc32(b.astype("<i8"))) for b, e in spans], pa.int64()),
                ]
                if arrays:
                    out += [pa.array(listed, pa.list_(pa.int32())), pa.array([b for b, _ in spans], pa.list_(pa.int64())), pa.array([e for _, e in spans], pa.list_(pa.int64())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(out, names[: len(out)])

    shared.small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long"
    return source.mapInArrow(run, schema + ", ids array<int>, begins array<long>, ends array<long>, decoded string" * arrays).withColumnRenamed("id", id_col)
