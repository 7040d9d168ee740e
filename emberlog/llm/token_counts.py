"""Token counts by a two-tier lookup on the map side; no pre-token is ever shuffled.

Tier one is a broadcast hash table, in open addressing, from two hashes
of a frequent pre-token (a run of white space with the word after it) to its
number of tokens. Tier two is each worker's cache: a pre-token that tier one
lacks is encoded once by the tokenizer's library and remembered by hash. Both
tiers hold the library's own counts, so results don't depend on which answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import shared, vocab
from emberlog.llm.text import blocks, column

#: Documents from which frequent pre-tokens are taken (the least by a hash of the id), and entries of tier one at most.
SAMPLE_DOCUMENTS, TABLE_ENTRIES = 500, 1 << 16


class LengthTable:
    """An open-addressing table of at most TABLE_ENTRIES pre-tokens, each known by two hashes (5 MiB with its slack of three quarters)."""

    def __init__(self, hashes: np.ndarray, checks: np.ndarray, lengths: np.ndarray, bits: int = 18):
        assert len(hashes) <= 1 << (bits - 2)
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.checks, self.lengths = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self.probes = 0
        free, left = np.ones(1 << bits, bool), np.flatnonzero(hashes != 0)
        while len(left):  # one probe of all that have no slot yet
            slots = ((hashes[left] + np.uint64(self.probes)) & self.mask).astype(np.int64)
            _, first = np.unique(slots, return_index=True)
            first = first[free[slots[first]]]
            self.keys[slots[first]], self.checks[slots[first]] = hashes[left[first]], checks[left[first]]
            self.lengths[slots[first]], free[slots[first]] = lengths[left[first]], False
            left = np.delete(left, first)
            self.probes += 1

    def look(self, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Lengths; -1 where the table has none."""
        out, left = np.full(len(hashes), -1, np.int32), np.arange(len(hashes))
        for probe in range(self.probes):
            slots = ((hashes[left] + np.uint64(probe)) & self.mask).astype(np.int64)
            keys = self.keys[slots]
            hit = keys == hashes[left]
            same = hit & (self.checks[slots] == checks[left])
            out[left[same]] = self.lengths[slots[same]]
            left = left[~hit & (keys != 0)]
            if not len(left):
                break
        return out


def frequent(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> LengthTable:
    """Tier one: the most frequent pre-tokens of a bounded sample of documents, counted in one task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, hashes, checks, counts = vocab.byte_encoder(path), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        lengths = np.zeros(0, np.int32)
        for batch in batches:
            for block in blocks(column(batch, text_col)):
                starts, ends, _ = encoder.cut(block)
                own, other = block.identities(starts, ends)
                places = encoder.codes.look(block, starts, ends, own, other)
                hashes, at, back = np.unique(np.concatenate([hashes, own]), return_index=True, return_inverse=True)
                checks = np.concatenate([checks, other])[at]
                lengths = np.concatenate([lengths, encoder.codes.lengths[places]])[at]
                counts = np.bincount(back, np.concatenate([counts, np.ones(len(own))]), len(hashes)).astype(np.int64)
        top = np.argsort(-counts, kind="stable")[:TABLE_ENTRIES]
        yield pa.RecordBatch.from_arrays([pa.array(hashes[top].view(np.int64)), pa.array(checks[top].view(np.int64)), pa.array(lengths[top])], ["hash", "other", "length"])

    ids = docs.select(F.col(id_col).alias("id")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCUMENTS)
    # ids of a sample of fixed size are broadcast
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias(text_col)).join(F.broadcast(ids.distinct()), "id", "left_semi")
    found = sample.select(text_col).orderBy(F.xxhash64(text_col)).limit(SAMPLE_DOCUMENTS).mapInArrow(count, "hash long, other long, length int").toArrow()
    hashes = found.column("hash").to_numpy().view(np.uint64)
    _, once = np.unique(hashes, return_index=True)
    once = once[:TABLE_ENTRIES]
    return LengthTable(hashes[once], found.column("other").to_numpy().view(np.uint64)[once], found.column("length").to_numpy()[once])


def count_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row; a null text counts as empty, repeated rows are counted each.

    An empty text has 0 tokens, an empty table gives no rows. A very long text is counted whole, its pre-tokens
    looked up at once. Columns apart from the two are not read, whatever their names.
    """
    shared.small_batches(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(frequent(docs, path, id_col=id_col, text_col=text_col))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tier_one = vocab.byte_encoder(path), table.value
        for batch in batches:
            ids, tokens, sizes = column(batch, "id"), [], []
            for block in blocks(column(batch, "text")):
                starts, ends, first = encoder.cut(block)
                hashes, checks = block.identities(starts, ends)
                lengths = tier_one.look(hashes, checks)
                miss = np.flatnonzero(lengths < 0)
                places = encoder.codes.look(block, starts[miss], ends[miss], hashes[miss], checks[miss])
                lengths[miss] = encoder.codes.lengths[places]
                total = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                own = np.diff(total[first])
                if encoder.odd(block.data.tobytes()):
                    for k in range(len(block)):
                        if encoder.odd(raw := block.raw(k)):
                            own[k] = len(encoder.whole(raw.decode("utf-8", "replace")))
                tokens.append(own)
                sizes.append(np.diff(block.offsets))
            if len(batch):
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(sizes)), pa.array(np.concatenate(tokens))], ["id", "n_bytes", "n_tokens"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
