"""A Bloom filter of ids, of bounded size, to keep rows that nothing asks for out of a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.text import mix

#: Bits for each id, and bits at most (32 MiB): beyond that more rows pass, which costs time but changes no result.
BITS_PER_ID, MAX_BITS = 12, 1 << 28
SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)


class IdFilter:
    """May say yes to an id that was not put in, never no to one that was."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        out, mask = np.ones(len(ids), bool), np.uint64(len(self.words) * 64 - 1)
        for seed in SEEDS:
            at = mix(ids.view(np.uint64) ^ np.uint64(seed)) & mask
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def id_filter(ids: DataFrame) -> IdFilter:
    """Of a column of longs without nulls. Words of the filter are combined on the executors; only these, at most MAX_BITS, are collected."""
    n = ids.count()
    bits = min(MAX_BITS, 1 << max(12, int(BITS_PER_ID * n - 1).bit_length() if n else 12))
    name = ids.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            at = np.concatenate([mix(own ^ np.uint64(s)) for s in SEEDS]) & np.uint64(bits - 1)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "bit"])

    found = ids.select(F.col(name).cast("long").alias("id")).mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return IdFilter(words)


def passing(docs: DataFrame, wanted: IdFilter, id_col: str, inverse: bool = False) -> DataFrame:
    """Rows whose id may be wanted; by ``inverse`` all the others, those without an id too."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(id_col))
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            keep = (known & shared.value(pc.fill_null(ids, 0).to_numpy())) != inverse
            if keep.any():
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
