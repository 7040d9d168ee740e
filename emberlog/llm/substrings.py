"""Substring deduplication: words covered by a run of ``LENGTH`` words that starts in a document of smaller id too.

1. Every run of LENGTH words has an anchor, the least-hashed run of ``ANCHOR``
   words in it, so equal runs have equal anchors. Anchors found in one
   document only are dropped; the count is pre-aggregated before its shuffle.
2. The stretch of a document whose runs share a repeated anchor is a segment.
   A task merges equal segments before it sends them, and a shard gets all segments of
   its anchors. Very frequent anchors are dealt out by whole runs instead.
3. A shard is indexed by a compressed FM-index (see ``fmindex``) in blocks of
   whole anchors, its segments are streamed through backward
   search, and runs whose matching statistic reaches LENGTH are reported with the least id.
4. Reports go back to the documents, which lose the words they cover.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import shared
from emberlog.llm.filters import BITS_PER_ID, MAX_BITS, IdFilter, id_filter, passing
from emberlog.llm.fmindex import Index
from emberlog.llm.neardup import whole_groups
from emberlog.llm.text import Block, Codes, blocks, column, give_back, inner, mix, numbered, windows

LENGTH, ANCHOR = 13, 4
_LOW = np.uint64(0xFFFF)
#: Documents that share an anchor from which on its runs are dealt out one by one.
HOT = 5000
#: Repeated anchors that a filter of bounded size holds well.
MAX_FILTERED = MAX_BITS // BITS_PER_ID
#: Words of the segments that are indexed together; one anchor's are never parted.
INDEX_WORDS = 1_000_000


def anchored(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Each run's first word, document, place of its anchor and the anchor; and the block's words."""
    starts, ends, first = block.spans()
    hashes = block.hashes(starts, ends)
    at, doc = inner(first, LENGTH)
    # the place goes into the low bits, counted down: of equal hashes the last is the least
    grams = windows(hashes, ANCHOR)
    least = grams & ~_LOW | ~np.arange(len(grams), dtype=np.uint64) & _LOW
    width, whole = 1, LENGTH - ANCHOR + 1
    while width < whole:  # the least of each window, from those of half its width
        step = min(width, whole - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    best = least[at]
    place = at + ((~best - at.astype(np.uint64)) & _LOW).astype(np.int64)
    return at, doc, place, (best >> np.uint64(16)).view(np.int64), (starts, ends, first, hashes)


def anchors(docs: DataFrame) -> DataFrame:
    """(id, anchor), distinct in each row of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Codes.release()
        for batch in batches:
            ids = column(batch, "id").to_numpy()
            for block in blocks(column(batch, "text")):
                _, doc, place, best, _ = anchored(block)
                new = np.ones(len(doc), bool)
                new[1:] = place[1:] != place[:-1]
                found = np.stack([doc[new], best[new]], 1)
                found = found[np.lexsort((found[:, 1], found[:, 0]))]
                once = np.ones(len(found), bool)
                once[1:] = (found[1:] != found[:-1]).any(1)
                found = found[once]
                yield pa.RecordBatch.from_arrays([pa.array(ids[block.rows[0] + found[:, 0]]), pa.array(found[:, 1])], ["id", "anchor"])

    return docs.where(F.col("id").isNotNull() & F.col("text").isNotNull()).mapInArrow(run, "id long, anchor long")


def _key(raw: bytes, size: int = 16) -> bytes:
    return hashlib.blake2b(raw, digest_size=size).digest()


def _digest(raw: bytes) -> tuple[int, str]:
    words = raw.split()
    return len(words), hashlib.sha256(b" ".join(words)).hexdigest()


class Repeated:
    """Which anchors of documents are in more than one: told by filters of bounded size, or by lists in the rows themselves."""

    def __init__(self, cold: IdFilter | None = None, hot: IdFilter | None = None):
        self.cold, self.hot = cold, hot

    def tests(self, part: pa.RecordBatch, doc: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of runs with these documents and anchors, those with a repeated anchor that is not hot, and those with a hot one."""
        if self.cold is not None:
            hot = self.hot(best)
            return self.cold(best) & ~hot, hot

        def pairs(name: str) -> np.ndarray:  # (document, anchor) as one number each
            lists = column(part, name)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            return mix(values.view(np.uint64) ^ mix(np.repeat(np.arange(len(lengths)), lengths).astype(np.uint64) + np.uint64(1)))

        own = mix(best.view(np.uint64) ^ mix(doc.astype(np.uint64) + np.uint64(1)))
        return np.isin(own, pairs("cold")), np.isin(own, pairs("hot"))


def repeated(docs: DataFrame) -> tuple[DataFrame, Repeated]:
    """The documents, and what tells the repeated anchors of their runs.

    As long as filters of bounded size can hold them, nothing is joined: an
    anchor that a filter lets pass by mistake only makes a segment more. Beyond
    that bound the anchors are joined and the documents get theirs as lists.
    """
    found = anchors(docs)
    counts = found.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("count")).where("low < high")
    counts, path = shared.written(counts.select("anchor", (F.col("count") >= HOT).alias("hot")))
    if counts.count() <= MAX_FILTERED:
        known = Repeated(id_filter(counts.select("anchor")), id_filter(counts.where("hot").select("anchor")))
        shared.remove(docs.sparkSession, path)
        return docs, known
    by_document = found.join(counts, "anchor").groupBy("id").agg(F.collect_list(F.when(~F.col("hot"), F.col("anchor"))).alias("cold"), F.collect_list(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
    return docs.join(by_document, "id", "left"), Repeated()


class Cut:
    """A block of documents with the segments that its repeated anchors make."""

    def __init__(self, part: pa.RecordBatch, block: Block, known: Repeated):
        self.ids = column(part, "id")
        at, doc, place, best, (self.starts, self.ends, first, hashes) = anchored(block)
        cold, hot = known.tests(part, doc, best)
        has_id = self.ids.is_valid().to_numpy(zero_copy_only=False)
        cold, hot = cold & has_id[doc], hot & has_id[doc]
        begins = np.ones(len(at), bool)
        begins[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
        heads = np.flatnonzero(begins)
        tails = np.append(heads[1:], len(at))[: len(heads)] - 1
        take = cold[heads]
        heads, tails, singles = heads[take], tails[take], np.flatnonzero(hot)
        self.head = np.concatenate([at[heads], at[singles]])
        self.tail = np.concatenate([at[tails], at[singles]]) + LENGTH - 1
        runs = windows(hashes, LENGTH)
        self.route = np.concatenate([best[heads], runs[at[singles]].view(np.int64)])
        self.doc = np.concatenate([doc[heads], doc[singles]])
        self.start = self.head - first[self.doc]

    def contents(self, block: Block) -> tuple[list[bytes], np.ndarray]:
        """The bytes of each segment, and two 64-bit keys of them."""
        data = block.data.tobytes()
        content = [data[s:e] for s, e in zip(self.starts[self.head].tolist(), self.ends[self.tail].tolist(), strict=True)]
        return content, np.frombuffer(b"".join(map(_key, content)), np.int64).reshape(-1, 2)


def _merged(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row of each pair of keys: its place, and the least and largest id."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]).any(1)
    at = np.flatnonzero(new)
    if not len(at):
        return order, low, high
    return order[at], np.minimum.reduceat(low[order], at), np.maximum.reduceat(high[order], at)


def segments(docs: DataFrame, known: Repeated) -> DataFrame:
    """(route, k1, k2, content, low, high): equal segments of a task's documents merged, with their least and largest id."""
    shared_ = docs.sparkSession.sparkContext.broadcast(known)
    names = ["route", "k1", "k2", "content", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            route, keys, low = (np.concatenate([h[k] for h in held]) for k in (0, 1, 2))
            content = pa.concat_arrays([h[3] for h in held])
            at, low, high = _merged(keys, low, low)
            return pa.RecordBatch.from_arrays([pa.array(route[at]), pa.array(keys[at, 0]), pa.array(keys[at, 1]), content.take(pa.array(at)), pa.array(low), pa.array(high)], names)

        for batch in batches:
            for block in blocks(column(batch, "text")):
                cut = Cut(batch.slice(block.rows[0], len(block)), block, shared_.value)
                if len(cut.head):
                    content, keys = cut.contents(block)
                    held.append((cut.route, keys, cut.ids.take(pa.array(cut.doc)).to_numpy(), pa.array(content, pa.binary())))
                    n += len(content)
                if n > 200_000:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "route long, k1 long, k2 long, content binary, low long, high long")


def places(docs: DataFrame, known: Repeated) -> DataFrame:
    """(k1, k2, id, row, start): where segments begin in their documents."""
    shared_ = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(column(batch, "text")):
                part = batch.slice(block.rows[0], len(block))
                cut = Cut(part, block, shared_.value)
                if len(cut.head):
                    _, keys = cut.contents(block)
                    doc = pa.array(cut.doc)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), cut.ids.take(doc), column(part, "row").take(doc), pa.array(cut.start.astype(np.int32))], ["k1", "k2", "id", "row", "start"])

    return docs.mapInArrow(run, "k1 long, k2 long, id long, row long, start int")


def untouched(docs: DataFrame, with_text: bool, keep: dict[str, str]) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256 and, by ``with_text``, text, and columns to keep) of documents that lose nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(column(batch, "text")):
                part = batch.slice(block.rows[0], len(block))
                digests = [_digest(block.raw(k)) for k in range(len(block))]
                columns = [column(part, "id"), pa.array([d[0] for d in digests], pa.int64()), pa.array(np.zeros(len(block), np.int64)), pa.array([d[1] for d in digests])]
                yield pa.RecordBatch.from_arrays(columns + [column(part, "text").cast(pa.string())] * with_text + [column(part, k) for k in keep], ["id", "n_words", "n_removed", "kept_sha256"] + ["text"] * with_text + [*keep])

    return docs.mapInArrow(run, "id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text + "".join(f", {k} {kind}" for k, kind in keep.items()))


def reports(found: DataFrame) -> DataFrame:
    """(k1, k2, lows) of distinct segments: for each of its runs the least id of a document that has it; only of those where that tells anything."""

    def indexed(table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = np.stack([column(table, "k1").to_numpy(), column(table, "k2").to_numpy()], 1)
        once, low, high = _merged(keys, column(table, "low").to_numpy(), column(table, "high").to_numpy())
        table = table.take(pa.array(once))
        (block,) = blocks(column(table, "content"), 1 << 62)
        starts, ends, first = block.spans()
        codes = numbered(*block.identities(starts, ends))
        sizes = np.diff(first)
        # a zero ends each segment
        text = np.zeros(len(codes) + len(sizes), np.int64)
        segment = np.repeat(np.arange(len(sizes)), sizes)
        text[np.arange(len(codes)) + segment] = codes + 1
        index = Index(text, int(codes.max()) + 2, np.repeat(low, sizes + 1))
        at, of = inner(first, LENGTH)
        lows = low[of]
        alive, begin, end = index.matching(text, at + of + LENGTH - 1, LENGTH)
        lows[alive] = index.least_of(begin, end)
        counts = sizes - LENGTH + 1
        bounds = np.concatenate([[0], np.cumsum(counts)])
        told = np.flatnonzero(np.minimum.reduceat(lows, bounds[:-1]) < high)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts[told])]), pa.int32()), pa.array(lows[np.isin(of, told)]))
        taken = table.take(pa.array(told))
        found = pa.RecordBatch.from_arrays([column(taken, "k1"), column(taken, "k2"), lists], ["k1", "k2", "lows"])
        del index, text, codes, segment, starts, ends, block, at, of, lows
        give_back()
        yield found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "route", lambda b: pc.binary_length(column(b, "content")).to_numpy() // 6, INDEX_WORDS):
            yield from indexed(rows)

    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(parts, "route").sortWithinPartitions("route").mapInArrow(run, "k1 long, k2 long, lows array<long>")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, keep: list[str] = ()) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, by ``with_text`` text, and columns to keep) of every row.

    kept_sha256 is of the words left, joined by one space. A text that loses
    nothing stays as it is; else what is left between removed words is
    joined by one space. Of rows that share an id none counts as smaller; rows
    without an id are never removed from and remove from nothing. A null text has no words and stays null. An empty table gives
    no rows. A very long text is cut whole, in memory that grows with its length. Columns to keep may have any name; others are not read.
    """
    shared.small_batches(docs.sparkSession)
    text = F.col(text_col)
    source = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("row"), *[F.col(c).alias(f"_keep_{k}") for k, c in enumerate(keep)])
    kinds = {f.name: f.dataType.simpleString() for f in source.schema if f.name.startswith("_keep_")}
    own = source.select("id", "text", "row")
    own, known = repeated(own)
    told = places(own, known).join(reports(segments(own, known)), ["k1", "k2"])
    told, _ = shared.written(told.where(F.array_min("lows") < F.col("id")).groupBy("id", "row").agg(F.collect_list("start").alias("starts"), F.collect_list("lows").alias("lows")))
    # the texts of documents that lose nothing stay out of the shuffle
    losers = id_filter(told.select("id"))
    texts = passing(source, losers, "id").join(told, ["id", "row"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(column(batch, "text")):
                part = batch.slice(block.rows[0], len(block))
                ids = column(part, "id").to_numpy()
                starts, ends, first = block.spans()
                # all runs of all segments at once: marks where a run that goes begins and ends
                in_doc, in_segment = column(part, "starts"), column(part, "lows").flatten()
                of = np.repeat(np.arange(len(block)), pc.fill_null(pc.list_value_length(in_doc), 0).to_numpy(zero_copy_only=False))
                counts = pc.list_value_length(in_segment).to_numpy(zero_copy_only=False).astype(np.int64)
                runs_of = np.repeat(np.arange(len(of)), counts)
                at = (first[of] + in_doc.flatten().to_numpy(zero_copy_only=False))[runs_of] + np.arange(len(runs_of)) - np.repeat(np.cumsum(counts) - counts, counts)
                at = at[in_segment.flatten().to_numpy(zero_copy_only=False) < ids[of][runs_of]].astype(np.int64)
                marks = np.bincount(at, minlength=len(starts) + LENGTH + 1) - np.bincount(at + LENGTH, minlength=len(starts) + LENGTH + 1)
                all_gone = np.cumsum(marks)[: len(starts)] > 0
                out = []
                for k, id_ in enumerate(ids.tolist()):
                    s, e = starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]]
                    gone = all_gone[first[k] : first[k + 1]]
                    left = np.flatnonzero(~gone)
                    if len(left) == len(s):
                        text = block.raw(k)
                    else:
                        breaks = np.flatnonzero(np.diff(left) > 1) + 1
                        runs = [r for r in np.split(left, breaks) if len(r)]
                        text = b" ".join(block.data[s[r[0]] : e[r[-1]]].tobytes() for r in runs)
                    out.append((id_, len(s), int(gone.sum()), _digest(text)[1], text))
                id_, n, removed, sha, text = zip(*out, strict=True)
                columns = [pa.array(id_, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha)]
                if with_text:
                    columns.append(pa.array([t.decode("utf-8", "replace") for t in text]))
                names = ["id", "n_words", "n_removed", "kept_sha256", "text"][: len(columns)]
                yield pa.RecordBatch.from_arrays(columns + [column(part, k) for k in kinds], names + [*kinds])

    shown = ["id", "n_words", "n_removed", "kept_sha256"] + ["text"] * with_text + [*kinds]
    changed = texts.mapInArrow(cut, "id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text + "".join(f", {k} {kind}" for k, kind in kinds.items()))
    done = untouched(passing(source, losers, "id", inverse=True), with_text, kinds)
    return done.unionByName(changed).select(*shown).withColumnsRenamed({"id": id_col} | ({"text": text_col} if with_text else {}) | {f"_keep_{k}": c for k, c in enumerate(keep)})


#: The same over ``documents`` as DuckDB SQL.
ORACLE_SQL = r"""
with d as (
  select doc_id, row_number() over () as row, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), runs as (
  select doc_id, row, i, list_aggregate(w[i:i + 12], 'string_agg', ' ') as run
  from (select doc_id, row, w, unnest(generate_series(1, len(w) - 12)) as i from d)
), first as (
  select run, min(doc_id) as low from runs group by run
), gone as (
  select distinct row, i + k as place
  from runs join first using (run), (select unnest(generate_series(0, 12)) as k) where low < doc_id
), words as (
  select doc_id, row, unnest(generate_series(1, len(w))) as place, unnest(w) as word from d
), kept as (
  select row, string_agg(word, ' ' order by place) as text, count(*) as n from words anti join gone using (row, place) group by row
)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(text, '')) as kept_sha256
from d left join kept using (row)
"""
