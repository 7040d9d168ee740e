"""Journal files as a Spark data source, ``spark.read.format("journal").load(path)``, and other ways in and out.

A file is one partition; its objects are read as the public journal file format
describes them. Files that can't be read are skipped where ``skip_bad`` is true. After
ingestion the canonical entries belong in Parquet, sorted by time.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from emberlog.schema import ENTRIES
from emberlog.sources import catalog

SIGNATURE = b"LPKSHHRH"
#: Fixed values of the format: object types and flags.
DATA, ENTRY = 1, 3
XZ, LZ4, ZSTD = 1, 2, 4
COMPACT = 1 << 4


class FilePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class JournalSource(DataSource):
    """Options: path (a file or directory), skip_bad."""

    @classmethod
    def name(cls) -> str:
        return "journal"

    def schema(self):
        return ENTRIES

    def reader(self, schema):
        return JournalReader(self.options)


class JournalReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.skip = options["path"], str(options.get("skip_bad", "true")).lower() == "true"

    def partitions(self):
        paths = catalog.files_in(self.path) if os.path.isdir(self.path) else [self.path]
        return [FilePartition(p) for p in paths]

    def read(self, partition):
        try:
            yield from entries_of(partition.path)
        except (ValueError, struct.error, OSError):
            if not self.skip:
                raise


def _bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        raw = file.read()
    if path.endswith(".zst"):
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    return raw


def entries_of(path: str) -> Iterator[tuple]:
    """The entries of a file in the order of their objects; one that refers to a damaged object is left out."""
    raw = _bytes(path)
    if raw[:8] != SIGNATURE:
        raise ValueError(f"not a journal file: {path}")
    incompatible = struct.unpack_from("<I", raw, 12)[0]
    machine, seqnum_id = raw[40:56].hex(), raw[72:88].hex()
    header_size, arena_size = struct.unpack_from("<QQ", raw, 88)
    compact = bool(incompatible & COMPACT)
    at, end, values = header_size, min(len(raw), header_size + arena_size), {}

    def value(offset: int) -> bytes:
        if offset not in values:
            kind, flags = raw[offset], raw[offset + 1]
            (size,) = struct.unpack_from("<Q", raw, offset + 8)
            if kind != DATA or size < 64 or offset + size > len(raw):
                raise ValueError("a damaged object")
            body = raw[offset + (72 if compact else 64) : offset + size]
            if flags & ZSTD:
                import zstandard

                body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
            elif flags & XZ:
                import lzma

                body = lzma.decompress(body)
            elif flags & LZ4:
                raise ValueError("lz4 isn't installed")
            values[offset] = body
        return values[offset]

    while at + 16 <= end:
        kind = raw[at]
        (size,) = struct.unpack_from("<Q", raw, at + 8)
        if size < 16:
            break
        if kind == ENTRY:
            seqnum, realtime, monotonic = struct.unpack_from("<QQQ", raw, at + 16)
            boot = raw[at + 40 : at + 56].hex()
            (xor,) = struct.unpack_from("<Q", raw, at + 56)
            step, form = (4, "<I") if compact else (16, "<Q")
            try:
                payloads = [value(struct.unpack_from(form, raw, p)[0]) for p in range(at + 64, at + size - step + 1, step)]
            except (ValueError, struct.error, IndexError):
                payloads = None
            if payloads is not None:
                fields = [(n.decode("utf-8", "replace"), v) for n, sign, v in (p.partition(b"=") for p in payloads) if sign]
                yield path, machine, boot, seqnum_id, seqnum, realtime, monotonic, f"{xor:016x}", fields
        at += (size + 7) & ~7


def read(spark: SparkSession, path: str) -> DataFrame:
    """Entries of journal files; a snapshot of what they hold when they are read."""
    spark.dataSource.register(JournalSource)
    return spark.read.format("journal").load(path)


def read_tables(spark: SparkSession, *paths: str) -> DataFrame:
    """Entries that were ingested to Parquet before, each path once."""
    return spark.read.schema(ENTRIES).parquet(*dict.fromkeys(paths))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Ingestion records in JSON lines: values as text, base64 bytes, or a text repeated."""
    value = "struct<kind:string,value:string,data:string,base64:string,text:string,count:int>"
    schema = f"record_type string, entry_id string, realtime_usec long, monotonic_usec long, boot_id string, machine_id string, fields array<struct<name:string,value:{value}>>"
    v = lambda f: f["value"]
    raw = F.transform("fields", lambda f: F.struct(f["name"].alias("name"), F.when(v(f)["kind"] == "bytes", F.unbase64(F.coalesce(v(f)["base64"], v(f)["data"]))).when(v(f)["kind"] == "repeat", F.repeat(v(f)["text"], v(f)["count"]).cast("binary")).otherwise(F.coalesce(v(f)["value"], v(f)["text"]).cast("binary")).alias("value")))
    return spark.read.schema(schema).json(path).withColumn("fields", raw)


def write(entries: DataFrame, path: str, *, max_records: int | None = None, codec: str = "zstd") -> None:
    """Entries as Parquet, sorted by time within files so that time bounds prune row groups."""
    writer = entries.sortWithinPartitions("realtime_usec").write.mode("append").option("compression", codec)
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    writer.parquet(path)
