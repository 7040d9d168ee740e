"""Writing rules as plans: field policy, clocks, rotation, retention, vacuum, and checks of what was written."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE, LEAST_FILE, MOST_COMPACT, FRACTION = 4096, 512 * 1024, 4 * 1024**3, 20


def valid_name(name: Column) -> Column:
    """At most 64 of A-Z, 0-9 and _, not beginning with a digit."""
    return name.rlike("^[A-Z_][A-Z0-9_]{0,63}$")


def accepted(fields: Column, policy: str) -> Column:
    """Fields of an entry under a policy: ``journald`` fails on an invalid name, ``app`` drops it and names that begin with _, ``raw`` takes any without =."""
    if policy == "journald":
        bad = F.exists(fields, lambda f: ~valid_name(f["name"]))
        return F.when(bad, F.raise_error(F.lit("invalid field name")).cast("array<struct<name:string,value:binary>>")).otherwise(fields)
    if policy == "app":
        return F.filter(fields, lambda f: valid_name(f["name"]) & ~f["name"].startswith("_"))
    return F.filter(fields, lambda f: (f["name"] != "") & ~f["name"].contains("="))


def distinct_fields(fields: Column) -> Column:
    return F.array_distinct(fields)


def with_source_time(fields: Column, usec: Column) -> Column:
    """The field of the source's time put in front, where it is given."""
    own = F.struct(F.lit("_SOURCE_REALTIME_TIMESTAMP").alias("name"), usec.cast("string").cast("binary").alias("value"))
    return F.when(usec.isNotNull(), F.concat(F.array(own), fields)).otherwise(fields)


def strict_clock(df: DataFrame, chain: list[str], order: list[str], time: str, name: str = "clock_usec") -> DataFrame:
    """Times that strictly rise along each chain: ``max(time, last + 1)``, as a running maximum of time minus place."""
    own = Window.partitionBy(*chain).orderBy(*order)
    numbered = df.withColumn("_n", F.row_number().over(own).cast("long"))
    upto = Window.partitionBy(*chain).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    return numbered.withColumn(name, F.max(F.col(time) - F.col("_n")).over(upto) + F.col("_n")).drop("_n")


@dataclass(frozen=True)
class Rotation:
    entries: int | None = None
    size: int | None = None
    duration_usec: int | None = None


def derived_rotation(rotation: Rotation, keep_size: int | None, keep_usec: int | None, compact: bool = True) -> Rotation:
    """Limits not given are a twentieth of what is retained; sizes in whole pages, within the least and the compact layout's most."""
    size, usec = rotation.size, rotation.duration_usec
    if size is None and keep_size is not None:
        size = -(-max(keep_size // FRACTION, 1) // PAGE) * PAGE
        size = max(min(size, MOST_COMPACT) if compact else size, LEAST_FILE)
    if usec is None and keep_usec is not None:
        usec = max(1, -(-keep_usec // FRACTION))
    return Rotation(rotation.entries, size, usec)


def rotation_ids(df: DataFrame, chain: list[str], order: list[str], entries: int, name: str = "file_no") -> DataFrame:
    """The number, from 0, of the file each entry goes to when files hold so many entries."""
    place = F.row_number().over(Window.partitionBy(*chain).orderBy(*order))
    return df.withColumn(name, F.floor((place - 1) / F.lit(entries)).cast("long"))


def rotated(df: DataFrame, chain: str, order: list[str], rotation: Rotation, *, size: str | None = None, time: str | None = None, name: str = "file_no") -> DataFrame:
    """The same under all limits of a rotation: a file that holds ``entries``, would grow past ``size`` or is ``duration_usec`` old is closed before the next entry.

    Where a file ends depends on where the one before ended, so each chain is gone through in order, in a sorted
    partition with a constant state; chains are dealt over the partitions.
    """
    columns, kinds = df.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, number, held, grown, began = object(), 0, 0, 0, 0
        for batch in batches:
            sizes = batch[size] if size is not None else [0] * len(batch)
            times = batch[time] if time is not None else [0] * len(batch)
            out = []
            for key, more, at in zip(batch[chain], sizes, times, strict=True):
                if key != last:
                    last, number, held, grown, began = key, 0, 0, 0, at
                full = rotation.entries is not None and held >= rotation.entries
                full |= rotation.size is not None and held > 0 and grown + more > rotation.size
                full |= rotation.duration_usec is not None and at - began >= rotation.duration_usec
                if full:
                    number, held, grown, began = number + 1, 0, 0, at
                held, grown = held + 1, grown + more
                out.append(number)
            yield batch.assign(**{name: out})

    return df.repartition(chain).sortWithinPartitions(chain, *order).mapInPandas(run, f"{kinds}, {name} long").select(*columns, name)


def retention_plan(files: DataFrame, chain: list[str], order: list[str], *, count: int | None = None, size: int | None = None, oldest: int | None = None) -> DataFrame:
    """Files with ``action`` keep or delete and the first limit broken: count, then size, then age.

    ``order`` runs from the oldest to the newest; the newest is active: it counts but stays. Columns needed: size_bytes, tail_realtime.
    """
    newer = Window.partitionBy(*chain).orderBy(*[F.col(c).desc() for c in order])
    upto = newer.rowsBetween(Window.unboundedPreceding, 0)
    ranked = files.withColumn("_rank", F.row_number().over(newer)).withColumn("_size", F.sum("size_bytes").over(upto))
    broken = F
    for limit, test, why in ((count, F.col("_rank") > F.lit(count), "count"), (size, F.col("_size") > F.lit(size), "size"), (oldest, F.col("tail_realtime") < F.lit(oldest), "age")):
        if limit is not None:
            broken = broken.when((F.col("_rank") > 1) & test, F.lit(why))
    reason = F.lit(None).cast("string") if broken is F else broken.otherwise(F.lit(None))
    return ranked.withColumn("reason", reason).withColumn("action", F.when(F.col("reason").isNull(), "keep").otherwise("delete")).drop("_rank", "_size")


def vacuum_plan(files: DataFrame, order: list[str], *, count: int | None = None, size: int | None = None, oldest: int | None = None) -> DataFrame:
    """Archived files with ``action``: empty ones go first; then from the oldest on until count, size and age all hold.

    Active files (column ``active``) stay but take part in the sums. Columns needed: size_bytes, n_entries, tail_realtime, active.
    """
    full = files.where(F.col("active") | (F.col("n_entries") > 0))
    empty = files.where(~F.col("active") & (F.col("n_entries") == 0)).withColumn("action", F.lit("delete"))
    # what stays if deleting stops before a file: it, the later ones and the active ones
    rank = F.when(F.col("active"), 1).otherwise(0)
    later = Window.partitionBy().orderBy(rank.desc(), *[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    left = full.withColumn("_count", F.count(F.lit(1)).over(later)).withColumn("_size", F.sum("size_bytes").over(later))
    enough = F.lit(True)
    if count is not None:
        enough = enough & (F.col("_count") <= count)
    if size is not None:
        enough = enough & (F.col("_size") <= size)
    if oldest is not None:
        enough = enough & (F.col("tail_realtime") >= oldest)
    # the first file that meets all limits stops the deletion
    first = left.withColumn("_enough", (enough & ~F.col("active")).cast("int"))
    older = Window.partitionBy().orderBy(rank, *order).rowsBetween(Window.unboundedPreceding, 0)
    action = F.when(F.col("active") | (F.max("_enough").over(older) == 1), "keep").otherwise("delete")
    return first.withColumn("action", action).drop("_count", "_size", "_enough").unionByName(empty)


def verify(entries: DataFrame, chain: list[str], seqnum: str, boot: str, monotonic: str, realtime: str) -> DataFrame:
    """Faults of each chain: entries, zero or not rising sequence numbers, monotonic time going back within a boot, first and last time."""
    own = Window.partitionBy(*chain).orderBy(seqnum, realtime)
    checked = entries.withColumn("_seq", F.lag(seqnum).over(own)).withColumn("_boot", F.lag(boot).over(own)).withColumn("_mono", F.lag(monotonic).over(own))
    return checked.groupBy(*chain).agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(F.col(seqnum) == 0).alias("zero_seqnums"),
        F.count_if(F.col(seqnum) <= F.col("_seq")).alias("repeated_seqnums"),
        F.count_if(F.col(boot).eqNullSafe(F.col("_boot")) & (F.col(monotonic) < F.col("_mono"))).alias("monotonic_back"),
        F.min(realtime).alias("head_realtime"),
        F.max(realtime).alias("tail_realtime"),
    )


def corpus_digest(entries: DataFrame) -> DataFrame:
    """Counters of canonical entries: entries, payloads, bytes, values that aren't printable, repeated names."""
    from emberlog.functions.display import printable

    fields = F.col("fields")
    return entries.agg(
        F.count(F.lit(1)).alias("entries"),
        F.sum(F.size(fields)).cast("long").alias("payloads"),
        F.sum(F.aggregate(fields, F.lit(0).cast("long"), lambda a, f: a + F.octet_length(f["value"]) + F.octet_length(f["name"]) + 1)).alias("payload_bytes"),
        F.sum(F.size(F.filter(fields, lambda f: ~printable(f["value"])))).cast("long").alias("binary_values"),
        F.sum(F.size(fields) - F.size(F.array_distinct(F.transform(fields, lambda f: f["name"])))).cast("long").alias("repeated_names"),
        F.bit_xor(F.xxhash64("realtime_usec", "seqnum", fields)).alias("digest"),
    )


def epoch_keys(key: bytes, epochs: list[int]) -> dict[int, bytes]:
    """The keys of some epochs, each a hash of the one before, stepped once from the secret."""
    wanted, out, own = set(epochs), {}, key
    for k in range(max(wanted, default=-1) + 1):
        own = hashlib.sha256(b"next" + own).digest()
        if k in wanted:
            out[k] = own
    return out


def sealed(entries: DataFrame, start_usec: int, interval_usec: int, key: bytes) -> DataFrame:
    """(source_file, epoch, entries, tag): an HMAC-SHA256 over the entries of each epoch, keyed forward from a secret.

    The key of an epoch is a hash of the one before, so a key that is lost tells nothing of earlier epochs. Epochs with
    entries are collected, which are few beside entries.
    """
    epoch = F.floor((F.col("realtime_usec") - start_usec) / F.lit(interval_usec)).cast("long")
    line = F.sha2(F.concat_ws("|", "seqnum", "realtime_usec", F.to_json("fields")), 256)
    lines = entries.select("source_file", epoch.alias("epoch"), "seqnum", line.alias("line"))
    keys = epoch_keys(key, [r["epoch"] for r in lines.select("epoch").distinct().collect()])

    def tag(batch: pd.DataFrame) -> pd.DataFrame:
        mac = hmac.new(keys[int(batch["epoch"].iloc[0])], digestmod=hashlib.sha256)
        for x in batch.sort_values(["seqnum", "line"])["line"]:
            mac.update(x.encode())
        return pd.DataFrame({"source_file": [batch["source_file"].iloc[0]], "epoch": [batch["epoch"].iloc[0]], "entries": [len(batch)], "tag": [mac.hexdigest()]})

    return lines.groupBy("source_file", "epoch").applyInPandas(tag, "source_file string, epoch long, entries long, tag string")


def verify_seals(entries: DataFrame, tags: DataFrame, start_usec: int, interval_usec: int, key: bytes) -> DataFrame:
    """(source_file, epoch, status) of every epoch that has entries or a tag: ok, changed, unsealed (no tag) or lost (no entries)."""
    now = sealed(entries, start_usec, interval_usec, key).select("source_file", "epoch", F.col("tag").alias("_now"))
    both = now.join(tags.select("source_file", "epoch", "tag"), ["source_file", "epoch"], "full")
    status = F.when(F.col("tag").isNull(), "unsealed").when(F.col("_now").isNull(), "lost").when(F.col("tag") == F.col("_now"), "ok").otherwise("changed")
    return both.select("source_file", "epoch", status.alias("status"))


def flattened(objects: Iterator[dict]) -> Iterator[list[tuple[str, str]]]:
    """JSON objects as fields: keys of inner objects joined by a dot, arrays as repeated fields."""

    def walk(prefix: str, value) -> Iterator[tuple[str, str]]:
        if isinstance(value, dict):
            for k, v in value.items():
                yield from walk(f"{prefix}.{k}" if prefix else k, v)
        elif isinstance(value, list):
            for v in value:
                yield from walk(prefix, v)
        elif value is not None:
            yield prefix, str(value).lower() if isinstance(value, bool) else str(value)

    for x in objects:
        yield list(walk("", x))


def from_json(df: DataFrame, column: str) -> DataFrame:
    """Adds ``fields``, the flattened JSON objects of a text column; text that is no object gives no fields."""
    import json

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for text in batch:
                try:
                    value = json.loads(text) if text is not None else {}
                except ValueError:
                    value = {}
                out.append([{"name": k, "value": v.encode()} for k, v in next(flattened([value if isinstance(value, dict) else {}]))])
            yield pd.Series(out)

    return df.withColumn("fields", F.pandas_udf(run, "array<struct<name:string,value:binary>>")(F.col(column)))
