"""Connected components of a graph of edges, in DataFrames.

Each task first reduces its own edges to a star around the least node of each of their components, so that what is
left grows with the nodes. As long as that is more than ``WHOLE`` edges they go through rounds of alternating stars:
in a large star every node hands its larger neighbours to its least one; in a small star its smaller neighbours and
itself. Edges shrink to stars around the least node of each component in a number of rounds that grows with the
logarithm of the graph. Each round is written to the shared folder. Groups are only ever reduced to a minimum, so a
hub of any degree is pre-aggregated. At most ``WHOLE`` edges are one task's, as rounds over a few thousand
edges cost far more in tasks than in work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import shared
from emberlog.llm.text import column

#: Edges that one task takes at once: 16 MB of ids. Graphs of any number of edges have the same result.
WHOLE = 1_000_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges (u, v) but the least of each component, and the least of theirs."""
    ids, codes = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = codes[: len(u)], codes[len(u) :]
    root = np.arange(len(ids))
    while True:
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:  # a root's number is its least, so chains only lead down
            up = root[root]
            if (up == root).all():
                break
            root = up
    rest = np.flatnonzero(root != np.arange(len(ids)))
    return ids[rest], ids[root[rest]]


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) with the same components: stars, of at most WHOLE edges and a batch at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        return stars(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))

    def sent(found: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["u", "v"])

    for batch in batches:
        held.append((column(batch, "u").to_numpy(), column(batch, "v").to_numpy()))
        n += len(batch)
        if n > WHOLE:
            held = [joined()]
            n = len(held[0][0])
            if n > WHOLE // 2:  # mostly tree edges: nothing is won by holding them
                yield sent(held[0])
                held, n = [], 0
    if n:
        yield sent(joined())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of the edges (a, b), component being its least node.

    Nodes are not null. Loops and repeated edges do no harm; a node only in loops is its own component, without a row.
    """
    spark = edges.sparkSession

    def star(pairs: DataFrame) -> DataFrame:
        """Both stars: pairs (u, v) with u > v."""
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        return small.where("u > v").distinct()

    def state(pairs: DataFrame):
        return pairs.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("u", pa.int64()), ("v", pa.int64())]))
        u, v = stars(table["u"].to_numpy(), table["v"].to_numpy())
        roots = np.unique(v)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, roots])), pa.array(np.concatenate([v, roots]))], ["id", "component"])

    now, path = shared.written(shared.few(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v")).mapInArrow(contracted, "u long, v long"))
    before = state(now)
    while before["n"] > WHOLE:
        new, new_path = shared.written(star(now))
        after = state(new)
        shared.remove(spark, path)
        now, path = new, new_path
        if after == before:
            break
        before = after
    if before["n"] <= WHOLE:
        found, _ = shared.written(now.coalesce(1).mapInArrow(whole, "id long, component long"))
        shared.remove(spark, path)
        return found
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
