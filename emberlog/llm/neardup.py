"""Near-duplicate documents by an inverted join of MinHash signatures on their coordinates.

1. Each document gets the distinct shingles of its words and a signature of
   ``K`` minima. Documents with equal sets are one class, kept as its least id.
2. Classes are posted under every pair of coordinate and value. Postings that
   no other class shares are skipped. Two signatures that agree in ``T`` of K
   coordinates share one of the K - T + 1 rarest pairs of each (a global order by count and pair),
   so only that prefix is merged, and agreements are counted on full signatures.
   Within a posting list only a spanning forest of the matches is emitted.
3. Connected matches form clusters. Each is tested on full sets, and again
   only a spanning forest of the true links is emitted. Its components are the
   result.

Posting lists and clusters of more than ``GROUP`` members are gone through in rounds:
some members, as pivots, meet all of the group, block by block, and what becomes one
tree is not compared again.

T lies so far below K times the threshold that a pair at the threshold is
missed with a probability below 1e-5; pairs above it far more rarely.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import shared
from emberlog.llm.components import components
from emberlog.llm.filters import id_filter, passing
from emberlog.llm.shingles import shingle_sets
from emberlog.llm.text import Codes, blocks, column, mix

K, SEED = 64, 20240229
#: Largest posting list or cluster that one task takes whole; of larger ones so many pivots and so many rows meet in a task.
GROUP, TILE = 2048, 1024
#: Bytes of sets or signatures that small groups are put together to, so that they are not gone through one by one.
RUN_BYTES = 4_000_000
#: Pivots of a large group in the first round, and how many times more each next one has.
PIVOTS, GROWTH = 32, 8


def matches_needed(threshold: float, k: int = K, miss: float = 1e-5) -> int:
    """The most T for which a pair at the threshold agrees in fewer than T of k coordinates with a probability of at most ``miss``."""
    below, t = 0.0, 0
    while True:
        below += math.comb(k, t) * threshold**t * (1 - threshold) ** (k - t)
        if below > miss:
            return max(1, t)
        t += 1


def signatures(hashes: np.ndarray, first: np.ndarray, k: int = K) -> np.ndarray:
    """A row of k 32-bit minima for each set; zeros for an empty one."""
    seeds = mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(SEED))
    out, full = np.zeros((len(first) - 1, k), np.int32), np.flatnonzero(first[:-1] < first[1:])
    if len(full):
        for c in range(k):
            values = ((hashes ^ seeds[c]) * (seeds[k + c] | np.uint64(1))) >> np.uint64(32)
            out[full, c] = np.minimum.reduceat(values, first[:-1][full]).astype(np.uint32).view(np.int32)
    return out


def identities(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit values for each set that are equal for equal sets."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(s)))]) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    c1, c2 = ((s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums)
    return c1, c2


def prepared(docs: DataFrame, n: int) -> DataFrame:
    """(id, size, c1, c2, sig): set size, a 128-bit identity of the set, and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Codes.release()
        for batch in batches:
            for block in blocks(column(batch, "text")):
                h, first = shingle_sets(block, n)
                sig = signatures(h, first)
                c1, c2 = identities(h, first)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1) * K, pa.int32()), pa.array(sig.ravel()))
                yield pa.RecordBatch.from_arrays([column(batch, "id").slice(block.rows[0], len(block)), pa.array(np.diff(first)), pa.array(c1), pa.array(c2), lists], ["id", "size", "c1", "c2", "sig"])

    return docs.mapInArrow(run, "id long, size long, c1 long, c2 long, sig array<int>")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal keys, from batches of a partition sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        values = np.stack([column(batch, k).to_numpy() for k in keys], 1)
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1).tolist(), len(batch)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if last is not None and not (values[i] == last).all():
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(i, j - i))
            last = values[i]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, weight: Callable[[pa.RecordBatch], np.ndarray], limit: int) -> Iterator[pa.RecordBatch]:
    """Whole runs of rows with equal keys, put together until they weigh ``limit`` or more; from batches of a partition sorted by the key."""
    held: list[pa.RecordBatch] = []
    total, last = 0, None

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not len(batch):
            continue
        keys = column(batch, key).to_numpy()
        upto = np.concatenate([[0], np.cumsum(weight(batch))])
        begins = np.flatnonzero(np.concatenate([[last is not None and keys[0] != last], keys[1:] != keys[:-1]]))
        at, last = 0, keys[-1]
        while True:  # the first begin of a run before which there is enough
            k = int(np.searchsorted(upto[begins] - upto[at], limit - total))
            if k == len(begins):
                break
            to = int(begins[k])
            held += [batch.slice(at, to - at)] * (to > at)
            yield joined()
            held, total, at = [], 0, to
        held.append(batch.slice(at))
        total += int(upto[-1] - upto[at])
    if held:
        yield joined()


def forest(n: int, partners: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph on 0..n-1; partners(k, some) says which of some are neighbours of k.

    Only nodes not yet in one tree are compared, so a large dense group takes few steps.
    """
    left, edges = np.arange(n), []
    while len(left):
        # a tree grows from one node by rings; what it takes leaves the rest
        ring, left = [int(left[0])], left[1:]
        while ring and len(left):
            node = ring.pop()
            hit = partners(node, left)
            for other in left[hit].tolist():
                edges.append((node, other))
                ring.append(other)
            left = left[~hit]
    return edges


def _edges(ids: np.ndarray, edges: list[tuple[int, int]]) -> pa.RecordBatch:
    at = np.array(edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ids[at[:, 0]]), pa.array(ids[at[:, 1]])], ["a", "b"])


def payload_bytes(rows: pa.RecordBatch) -> np.ndarray:
    """The size of each row's set or signature."""
    payload = column(rows, "payload")
    if pa.types.is_list(payload.type):
        return pc.list_value_length(payload).to_numpy(zero_copy_only=False) * 4
    return pc.binary_length(payload).to_numpy(zero_copy_only=False).astype(np.int64)


Similar = Callable[[pa.Array], Callable[[int, np.ndarray], np.ndarray]]


def linked(members: DataFrame, payload: Callable[[DataFrame], DataFrame], similar: Similar) -> DataFrame:
    """Edges (a, b) whose components are those of the graph of all similar pairs that share a group.

    members: (grp, id, members), the last being how many a group has; payload: from (id) to
    (id, payload); similar: from an array of payloads to the test of one of them against some.
    Groups of up to GROUP members are one task's, which emits a spanning forest.
    Of larger ones no task sees all, and no pairs are dealt out that a tree joins already; see _in_rounds.
    """
    spark = members.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small = members.where(F.col("members") <= GROUP).select("grp", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "grp", payload_bytes, RUN_BYTES):
            ids, grp = column(rows, "id").to_numpy(), column(rows, "grp").to_numpy()
            order = np.lexsort((ids, grp))
            ids, grp, partners = ids[order], grp[order], similar(column(rows, "payload").take(pa.array(order)))
            bounds = [0, *(np.flatnonzero(grp[1:] != grp[:-1]) + 1).tolist(), len(grp)]
            edges = [(at + a, at + b) for at, to in zip(bounds, bounds[1:], strict=False) for a, b in forest(to - at, lambda k, some, at=at: partners(at + k, at + some))]
            if edges:
                yield _edges(ids, edges)

    rows = small.join(payload(small.select("id").distinct()), "id").select("grp", "id", "payload")
    found, _ = shared.written(rows.repartition(parts, "grp").sortWithinPartitions("grp").mapInArrow(run, "a long, b long"))
    large = members.where(F.col("members") > GROUP).select("grp", "id")
    return _in_rounds(large, payload, similar, found) if large.limit(1).count() else found


def _in_rounds(members: DataFrame, payload: Callable[[DataFrame], DataFrame], similar: Similar, edges: DataFrame) -> DataFrame:
    """The same for large groups, from edges known before: rounds of pivots against whole groups.

    Of two rows in different trees one lies outside the group's largest tree. So pivots are drawn from there; each is
    compared with all rows of its group that are in other trees, and then done. A group is finished when
    none is left. Near copies of one text need one round or two, as a few pivots join them all; a group whose rows stay apart
    gets GROWTH times as many pivots each round, so there are few rounds whatever its size.
    """
    spark = members.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    state, state_path = shared.written(shared.few(members.withColumn("done", F.lit(False))))
    before = [state_path]
    ids = state.select("id").distinct()
    texts, texts_path = shared.written(payload(ids).join(ids, "id", "left_semi"))
    keys = ["grp", "block", "tile"]

    def tree_edges(trees: DataFrame) -> DataFrame:
        return trees.select(F.col("id").alias("a"), F.col("component").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, keys):
            ids, pivot = column(rows, "id").to_numpy(), column(rows, "pivot").to_numpy(zero_copy_only=False)
            order = np.lexsort((ids, ~pivot))
            ids, partners = ids[order], similar(column(rows, "payload").take(pa.array(order)))
            _, tree = np.unique(column(rows, "tree").to_numpy()[order], return_inverse=True)
            n, out = int(pivot.sum()), []
            others = np.arange(n, len(ids))
            for p in range(n):
                some = others[tree[others] != tree[p]]
                hits = some[partners(p, some)] if len(some) else some
                joined, first = np.unique(tree[hits], return_index=True)
                out += [(p, int(k)) for k in hits[first]]
                tree[np.isin(tree, joined)] = tree[p]
            if out:
                yield _edges(ids, out)

    for number in itertools.count():
        trees = components(edges)
        placed, placed_path = shared.written(shared.few(state.join(trees, "id", "left").select("grp", "id", "done", F.coalesce("component", "id").alias("tree"))))
        for path in before:
            shared.remove(spark, path)
        by_tree = placed.groupBy("grp", "tree").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("done")).alias("open"))
        largest = F.struct("n", "tree")
        groups = by_tree.groupBy("grp").agg(F.sum("n").alias("members"), F.max_by("tree", largest).alias("main"), (F.sum("open") - F.max_by("open", largest)).alias("open")).where("open > 0")
        groups, groups_path = shared.written(shared.few(groups))
        before = [placed_path, groups_path]
        if not groups.limit(1).count():
            break
        wanted = PIVOTS * GROWTH ** min(number, 10)
        rows = placed.join(groups, "grp")
        chance = F.pmod(F.xxhash64("id", F.lit(number)), F.lit(1 << 20)) < F.ceil(F.lit(wanted * (1 << 20)).cast("double") / F.col("open"))
        rows = rows.withColumn("pivot", ~F.col("done") & (F.col("tree") != F.col("main")) & chance)
        tiles, blocks_ = F.ceil(F.least(F.col("open"), F.lit(wanted).cast("long")) / TILE).cast("int"), F.ceil(F.col("members") / TILE).cast("int")
        block, tile = F.pmod(F.xxhash64("id"), blocks_).cast("int"), F.pmod(F.xxhash64("id", F.lit("tile")), tiles).cast("int")
        nodes = rows.select("grp", "id", "tree", F.lit(False).alias("pivot"), block.alias("block"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("tile"))
        pivots = rows.where("pivot").select("grp", "id", "tree", "pivot", tile.alias("tile"), F.explode(F.sequence(F.lit(0), blocks_ - 1)).alias("block"))
        dealt = nodes.unionByName(pivots).join(texts, "id").select(*keys, "id", "tree", "pivot", "payload")
        new, _ = shared.written(dealt.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long"))
        edges = tree_edges(trees).unionByName(new)
        state = rows.select("grp", "id", (F.col("done") | F.col("pivot")).alias("done"))
    for path in [*before, texts_path]:
        shared.remove(spark, path)
    return tree_edges(trees)


def match_edges(reps: DataFrame, need: int) -> DataFrame:
    """Edges (a, b) between classes whose signatures agree in ``need`` coordinates and which share a posting list of their prefixes.

    Agreements are counted on whole signatures, not by merging records of pairs, as a list of n classes would give n * n of those.
    """
    posted = reps.select("id", F.posexplode("sig")).select("id", F.xxhash64("pos", "col").alias("key"))
    counts = posted.groupBy("key").agg(F.count(F.lit(1)).alias("count")).where("count > 1")
    shared_ = posted.join(counts.withColumn("count", F.least("count", F.lit(2**31 - 1)).cast("int")), "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("count", "key"))).alias("keys"))  # K at most
    prefix, path = shared.written(shared_.where(F.size("keys") >= need).select("id", F.explode(F.transform(F.slice("keys", F.lit(1), F.size("keys") - (need - 1)), lambda x: x["key"])).alias("grp")))
    lists = prefix.groupBy("grp").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    sig = reps.select("id", F.col("sig").alias("payload"))

    def similar(payload: pa.Array) -> Callable[[int, np.ndarray], np.ndarray]:
        rows = payload.flatten().to_numpy().reshape(len(payload), -1)
        return lambda k, some: (rows[some] == rows[k]).sum(1) >= need

    found = linked(prefix.join(lists, "grp"), lambda ids: sig, similar)  # written, so that nothing reads the prefixes any more
    shared.remove(reps.sparkSession, path)
    return found


def set_test(threshold: tuple[int, int]) -> Similar:
    """Of packed sets, whether two are as similar as a threshold asks."""
    above, of = threshold

    def similar(payload: pa.Array) -> Callable[[int, np.ndarray], np.ndarray]:
        members = [np.frombuffer(x.as_buffer(), np.uint64) for x in payload]
        sizes = np.array([len(m) for m in members], np.int64)
        words, codes = np.unique(np.concatenate(members), return_inverse=True)
        first = np.concatenate([[0], np.cumsum(sizes)])
        doc = np.repeat(np.arange(len(sizes)), sizes)
        marked = np.zeros(len(words), bool)

        def partners(k: int, some: np.ndarray) -> np.ndarray:
            own = codes[first[k] : first[k + 1]]
            # sets whose sizes alone rule a link out are not looked at
            near = (of * np.minimum(sizes[some], sizes[k]) >= above * np.maximum(sizes[some], sizes[k])).nonzero()[0]
            out = np.zeros(len(some), bool)
            if not len(near):
                return out
            marked[own] = True
            all_ = len(near) * 4 > len(sizes)
            common = np.bincount(doc, marked[codes], len(sizes))[some[near]] if all_ else np.array([marked[codes[first[s] : first[s + 1]]].sum() for s in some[near]])
            marked[own] = False
            out[near] = of * common >= above * (sizes[k] + sizes[some[near]] - common)
            return out

        return partners

    return similar


def link_edges(docs: DataFrame, reps: DataFrame, clusters: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """The true links within clusters (id, component) of classes, tested on full sets: edges with the same components. reps tell a class's set and a document of it."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(column(batch, "text")):
                h, first = shingle_sets(block, n)
                c1, c2 = identities(h, first)
                packed = pa.array([h[first[k] : first[k + 1]].tobytes() for k in range(len(block))], pa.binary())
                part = batch.slice(block.rows[0], len(block))
                # an id may have other texts than the class's
                same = (np.diff(first) == column(part, "size").to_numpy()) & (c1 == column(part, "c1").to_numpy()) & (c2 == column(part, "c2").to_numpy())
                yield pa.RecordBatch.from_arrays([column(part, "id"), packed], ["id", "payload"]).filter(pa.array(same))

    def payload(ids: DataFrame) -> DataFrame:
        own = reps.select(F.col("class").alias("id"), F.col("id").alias("doc"), "size", "c1", "c2").join(ids, "id")
        # most documents are in no cluster: their texts stay out of the shuffle
        some = passing(docs, id_filter(own.select("doc")), "id").withColumnRenamed("id", "doc")
        return some.join(own, "doc").select("id", "size", "c1", "c2", "text").mapInArrow(sets, "id long, payload binary").dropDuplicates(["id"])

    counts = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    return linked(clusters.join(counts, "component").select(F.col("component").alias("grp"), "id", "members"), payload, set_test(threshold))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row.

    Documents are linked if ``threshold[1] * intersection >= threshold[0] * union``
    of their distinct n-word shingles; component_id is the least id reachable. A
    document without words is linked with nothing. Rows that repeat an id are judged each by
    their own text, and links to any of them count for the id. A row
    without an id is linked with nothing, has no component_id and is kept. An empty table gives no rows. A
    very long text is one set, in memory that grows with its length. Further columns are not read, whatever their names.
    """
    shared.small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known, _ = shared.written(prepared(source, n))
    some = known.where("size > 0 and id is not null")
    found = some.groupBy("size", "c1", "c2").agg(F.min("id").alias("id"), F.min_by("sig", "id").alias("sig"))
    reps, _ = shared.written(found.withColumn("class", F.monotonically_increasing_id()))  # the number stays as written
    need = matches_needed(threshold[0] / threshold[1])
    clusters, _ = shared.written(components(match_edges(reps.select(F.col("class").alias("id"), "sig"), need)))  # matches are few beside texts
    links = link_edges(source, reps, clusters, n, threshold)
    for end in ("a", "b"):
        links = links.join(reps.select(F.col("class").alias(end), F.col("id").alias(f"{end}_id")), end)
    # an id with several texts links their classes
    text = F.struct("size", "c1", "c2")
    several = some.groupBy("id").agg(F.min(text).alias("least"), F.max(text).alias("most")).where("least <> most").select(F.col("id").alias("a"))
    repeated = some.select(F.col("id").alias("a"), "size", "c1", "c2").join(several, "a", "left_semi").join(reps.select("size", "c1", "c2", F.col("id").alias("b")), ["size", "c1", "c2"]).select("a", "b")
    joined = components(links.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).unionByName(repeated))
    classes = reps.select("size", "c1", "c2", F.col("id").alias("rep")).join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("size", "c1", "c2", F.coalesce("component", "rep").alias("component"))
    found = known.drop("sig").join(classes, ["size", "c1", "c2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return found.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


#: The same over ``documents`` as DuckDB SQL: all pairs of documents of like size, for two-word shingles and 0.8.
ORACLE_SQL = r"""
with recursive d as (
  select doc_id, row_number() over () as row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select doc_id, row, list_distinct(case when len(w) < 2 then w else list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) end) as s from d
), each as (
  select row, doc_id, len(s) as n, unnest(s) as shingle from s where doc_id is not null
), numbers as (
  select shingle, row_number() over () as k from each group by shingle having count(*) > 1
), coded as (
  select row, doc_id, n, k from each join numbers using (shingle)
), links as (
  select any_value(a.doc_id) as a, any_value(b.doc_id) as b
  from coded a join coded b on a.k = b.k and a.row < b.row and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.row, b.row having 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), pairs as (
  select a, b from links union select b, a from links
), reach as (
  select a as id, b as other from pairs union select r.id, l.b from reach r join pairs l on r.other = l.a
), least_ as (
  select id, min(other) as other from reach group by id
)
select doc_id, len(s)::bigint as n_shingles, least(doc_id, coalesce(other, doc_id)) as component_id, coalesce(least(doc_id, coalesce(other, doc_id)) = doc_id, true) as kept
from s left join least_ on least_.id = s.doc_id
"""
