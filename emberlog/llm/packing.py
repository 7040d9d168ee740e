"""Sum-of-squares packing of token sequences into windows, online and without a shuffle.

Each partition keeps a level array: how many open windows are filled to each
level. A document goes where the sum of the squared counts of partially
filled windows becomes least. Longer ones are first cut into full windows and a
rest. When a partition ends, open windows are poured into each other, cutting
freely, until at most one is left; that one is cut at powers of two, which need
no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import shared, vocab
from emberlog.llm.text import blocks, column

#: Open windows a partition holds at most, which bounds its memory (8 million ids); beyond it the least filled half are poured together.
MAX_OPEN = 2048

Piece = tuple[int, int, int]  # document (an index or row), start in it, length


class Packer:
    """Places pieces in windows of ``size`` and calls ``emit(sequence, [(document, start, length), ...])`` for each closed one."""

    def __init__(self, size: int, emit: Callable[[int, list], None], first: int = 0, max_open: int = MAX_OPEN):
        self.size, self.emit, self.next, self.max_open = size, emit, first, max_open
        self.levels = np.zeros(size + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(size + 1)]  # by level: windows, each a list of pieces
        self.n_open = 0

    def _close(self, pieces: list) -> None:
        self.emit(self.next, pieces)
        self.next += 1

    def add(self, document, length: int) -> None:
        """A document of so many tokens; an empty one takes no place."""
        start = 0
        while length - start >= self.size:
            self._close([(document, start, self.size)])
            start += self.size
        if start < length:
            self._place((document, start, length - start))

    def _place(self, piece: Piece) -> None:
        s = piece[2]
        # Taking a window from level l to l+s changes the sum of squares by -(2 N[l] - 1) + (2 N[l+s] + 1);
        # level 0 (a new window) and the full level don't count.
        levels, size = self.levels, self.size
        to = 2 * levels[s : size + 1] + 1
        to[-1] = 0
        change = to - (2 * levels[: size - s + 1] - 1)
        change[0] = to[0]
        change[1:][levels[1 : size - s + 1] == 0] = np.iinfo(np.int64).max
        # of equal ones the fullest
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        pieces = [piece]
        if best:
            pieces = self.open[best].pop()
            pieces.append(piece)
            levels[best] -= 1
            self.n_open -= 1
        if best + s == size:
            self._close(pieces)
            return
        self.open[best + s].append(pieces)
        levels[best + s] += 1
        self.n_open += 1
        if self.n_open > self.max_open:
            self._pour(self.max_open // 2)

    def _pour(self, keep: int) -> None:
        """Cuts the least filled windows into the gaps of others until ``keep`` or fewer are open."""
        windows = [w for at in self.open for w in at]  # by level, least filled first
        fills = [sum(p[2] for p in w) for w in windows]
        poured, windows, fills = windows[: len(windows) - keep], windows[len(windows) - keep :], fills[len(fills) - keep :]
        at, fill = [], 0
        for piece in (p for w in poured for p in w):
            while piece:
                document, start, length = piece
                n = min(length, self.size - fill)
                at.append((document, start, n))
                fill += n
                piece = (document, start + n, length - n) if n < length else None
                if fill == self.size:
                    self._close(at)
                    at, fill = [], 0
        if at:
            windows.append(at)
            fills.append(fill)
        self.open = [[] for _ in range(self.size + 1)]
        self.levels[:] = 0
        for w, f in zip(windows, fills, strict=True):
            self.open[f].append(w)
            self.levels[f] += 1
        self.n_open = len(windows)

    def finish(self) -> None:
        self._pour(0)
        for pieces in [w for at in self.open for w in at]:
            left, at, room = list(reversed(pieces)), [], 0
            fill = sum(p[2] for p in pieces)
            while left:
                if not room:
                    room = 1 << (fill.bit_length() - 1)
                document, start, length = left.pop()
                n = min(length, room)
                at.append((document, start, n))
                room, fill = room - n, fill - n
                if n < length:
                    left.append((document, start + n, length - n))
                if not room:
                    self._close(at)
                    at = []
        self.open, self.n_open = [[] for _ in range(self.size + 1)], 0
        self.levels[:] = 0


def pack_partition(documents: Iterator[tuple[object, np.ndarray]], size: int, first: int, max_open: int = MAX_OPEN) -> Iterator[tuple[object, int, np.ndarray, int, int, int]]:
    """(document, start, ids of the piece, document's length, sequence, offset) for a stream of (document, ids)."""
    out: list = []

    def emit(sequence: int, pieces: list) -> None:
        offset = 0
        for (document, ids), start, length in pieces:
            out.append((document, start, ids[start : start + length], len(ids), sequence, offset))
            offset += length

    packer = Packer(size, emit, first, max_open)
    for document, ids in documents:
        packer.add((document, ids), len(ids))
        if out:
            yield from out
            out.clear()
    packer.finish()
    yield from out


def pack(docs: DataFrame, path: str, *, end_id: int = 2, size: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, max_open: int = MAX_OPEN) -> DataFrame:
    """Packs every row of docs; one row for each piece of a document.

    Columns: the id, start, length, ids_crc32 (of the piece's ids as
    little-endian unsigned 32-bit), doc_tokens, sequence_id, offset and, by ``with_ids``, ids (array). A document is its codes by ``path`` and then ``end_id``, so an empty or null text
    is that id alone. Repeated rows are packed each. A sequence has at most
    ``size`` ids; all are full but the last few of each partition, whose lengths are powers of two. Of levels that are
    equally good the fullest is taken. While no more than ``max_open`` windows are open the rule alone decides; past that
    the least filled are cut into each other, which leaves no gap and loses nothing. An empty table gives no rows; a very long text
    is encoded whole. Columns apart from the two are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, kind = vocab.word_encoder(path), []

        def documents():
            for batch in batches:
                ids = column(batch, "id")
                kind[:] = [ids.type]
                ids = ids.to_pylist()
                for block in blocks(column(batch, "text")):
                    for k, codes in zip(block.rows, encoder.documents(block), strict=True):
                        yield ids[k], np.append(codes, np.int32(end_id))

        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

        def table(rows: list) -> pa.RecordBatch:
            id_, start, ids, tokens, sequence, offset = zip(*rows, strict=True)
            sizes = np.array([len(x) for x in ids], np.int64)
            check = pa.array([zlib.crc32(np.ascontiguousarray(x, "<u4")) for x in ids], pa.int64())
            columns = [pa.array(id_, kind[0]), pa.array(start, pa.int64()), pa.array(sizes), check, pa.array(tokens, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(ids), pa.int32())))
            return pa.RecordBatch.from_arrays(columns, names[: len(columns)])

        rows, held = [], 0
        for row in pack_partition(documents(), size, TaskContext.get().partitionId() << 33, max_open):
            rows.append(row)
            held += len(row[2])
            if held > 1_000_000:
                yield table(rows)
                rows, held = [], 0
        if rows:
            yield table(rows)

    shared.small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids).withColumnRenamed("id", id_col)
