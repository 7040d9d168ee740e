"""Log files as a table: discovery, names, order, overlap with a window, sources."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUFFIXES = (".journal", ".journal~", ".journal.zst", ".journal~.zst")
MAX_DEPTH, MAX_DIRECTORIES = 64, 8192
#: Bits of source classes.
ALL, LOCAL, REMOTE, SYSTEM, USER, NAMESPACE, OTHER = 1, 2, 4, 8, 16, 32, 64
CLASSES = {"all": ALL, "all-local-logs": LOCAL, "all-remote-systems": REMOTE, "all-local-system-logs": SYSTEM, "all-local-user-logs": USER, "all-local-namespaces": NAMESPACE, "all-uncategorized": OTHER}

FILES = "path string, size_bytes long, mtime_usec long"


def is_log_file(name: str) -> bool:
    return name.endswith(SUFFIXES)


def files_in(directory: str) -> list[str]:
    """Log files of a directory and of its direct subdirectories, in order of name."""
    found = []
    for name in sorted(os.listdir(directory)):
        path = os.path.join(directory, name)
        if os.path.isdir(path):
            found += [os.path.join(path, n) for n in sorted(os.listdir(path)) if is_log_file(n)]
        elif is_log_file(name):
            found.append(path)
    return found


def explicit(paths: list[str]) -> list[str]:
    """Files as given, each once by its real path."""
    return list({os.path.realpath(p): p for p in reversed(paths)}.values())[::-1]


def discover(root: str) -> tuple[list[str], int]:
    """Log files below a root, breadth first, and how many subdirectories couldn't be read. Links to directories and files seen before are skipped; an unreadable root is an error."""
    todo, seen, files, found, failed = [(root, 0)], set(), set(), [], 0
    while todo and len(seen) < MAX_DIRECTORIES:
        directory, depth = todo.pop(0)
        real = os.path.realpath(directory)
        if real in seen or depth > MAX_DEPTH:
            continue
        seen.add(real)
        try:
            names = sorted(os.listdir(directory))
        except OSError:
            if directory == root:
                raise
            failed += 1
            continue
        for name in names:
            path = os.path.join(directory, name)
            if os.path.isdir(path):
                todo.append((path, depth + 1))
            elif is_log_file(name) and (own := os.path.realpath(path)) not in files:
                files.add(own)
                found.append(path)
    return found, failed


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, event) between two catalogues (path, size_bytes): created, grown, truncated or deleted; files that stay as they are have none."""
    old, new = before.select("path", F.col("size_bytes").alias("_old")), after.select("path", F.col("size_bytes").alias("_new"))
    event = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "deleted").when(F.col("_new") > F.col("_old"), "grown").when(F.col("_new") < F.col("_old"), "truncated")
    return old.join(new, "path", "full").select("path", event.alias("event")).where("event is not null")


def catalogue(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, size_bytes, mtime_usec, and what names say) of local files."""
    rows = [(p, (s := os.stat(p)).st_size, s.st_mtime_ns // 1000) for p in paths]
    return named(spark.createDataFrame(rows, FILES))


def named(files: DataFrame) -> DataFrame:
    """Adds what a path says: status, seqnum_id, head_seqnum, head_realtime, disposed_at, disposed_no, machine_id, namespace, source, source_name."""
    path = F.col("path")
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    stem = F.regexp_replace(name, r"\.journal~?(\.zst)?$", "")
    parent = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    tail = F.regexp_extract(stem, r"@(.+)$", 1)
    archived = r"^([0-9a-fA-F]{32})-([0-9a-fA-F]{16})-([0-9a-fA-F]{16})$"
    disposed = r"^([0-9a-fA-F]{16})-([0-9a-fA-F]{16})$"

    def hexed(pattern: str, group: int) -> Column:
        return F.conv(F.nullif(F.regexp_extract(tail, pattern, group), F.lit("")), 16, 10).cast("long")

    status = F.when(name.rlike(r"\.journal~"), "disposed").when(tail.rlike(archived), "archived").when(~stem.contains("@"), "active").otherwise("unknown")
    base = F.regexp_replace(stem, r"@.*$", "")
    source = F.when(base == "system", "system").when(base.rlike(r"^user-\d+$"), "user").when(base.rlike("^remote-"), "remote").otherwise("unknown")
    return files.withColumns(
        {
            "status": status,
            "seqnum_id": F.lower(F.nullif(F.regexp_extract(tail, archived, 1), F.lit(""))),
            "head_seqnum": hexed(archived, 2),
            "head_realtime": hexed(archived, 3),
            "disposed_at": hexed(disposed, 1),
            "disposed_no": hexed(disposed, 2),
            "machine_id": F.lower(F.nullif(F.regexp_replace(F.regexp_extract(parent, r"^([0-9a-fA-F-]{32,36})(?:\..+)?$", 1), "-", ""), F.lit(""))),
            "namespace": F.nullif(F.regexp_extract(parent, r"^[0-9a-fA-F-]{32,36}\.(.+)$", 1), F.lit("")),
            "source": source,
            "source_name": F.when(source == "user", F.regexp_extract(base, r"^user-(\d+)$", 1)).when(source == "remote", F.regexp_extract(base, r"^remote-(.+)$", 1)),
            "source_type": source_type(path),
        }
    )


def source_type(path: Column) -> Column:
    """Class bits by path: remote, namespace, system, user or other; all but remote are local."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    spaced = path.rlike(r"/[0-9a-fA-F]{32}\.[^/]+/[^/]+$")
    kind = F.when(path.contains("/remote/"), REMOTE).when(spaced, LOCAL | NAMESPACE).when(name.startswith("system"), LOCAL | SYSTEM).when(name.startswith("user"), LOCAL | USER).otherwise(LOCAL | OTHER)
    return kind.bitwiseOR(F.lit(ALL))


def source_condition(path: Column, wanted: list[str]) -> Column:
    """Whether a file is of any class or exact source named; ``all`` or nothing selects every file."""
    mask = 0
    for w in wanted:
        mask |= CLASSES.get(w, 0)
    if not wanted or mask & ALL:
        return F.lit(True)
    names = [w for w in wanted if w not in CLASSES]
    kind = source_type(path).bitwiseAND(F.lit(mask)) != 0
    own = F.regexp_extract(path, r"(?:user|remote)-([^/@]+?)(?:@[^/]*)?\.journal~?(?:\.zst)?$", 1)
    return kind | own.isin(*names) if names else kind


def selected(files: DataFrame, wanted: list[str]) -> DataFrame:
    """Files of any class or exact source named; ``all`` or nothing selects every file."""
    return files.where(source_condition(F.col("path"), wanted))


def status_order() -> list[Column]:
    """Disposed files before archived before active; archived by head time, sequence id, head sequence number."""
    rank = F.when(F.col("status") == "disposed", 0).when(F.col("status") == "archived", 1).otherwise(2)
    return [rank, F.col("disposed_at"), F.col("disposed_no"), F.col("head_realtime"), F.col("seqnum_id"), F.col("head_seqnum")]


def in_range(files: DataFrame, chain: list[str], start: int, end: int) -> DataFrame:
    """Files of each chain that may hold entries of [start, end): an archived one ends where the next begins, an active one never; disposed ones are left out."""
    kept = files.where(F.col("status").isin("archived", "active"))
    own = Window.partitionBy(*chain).orderBy(*status_order())
    ends = kept.withColumn("_next", F.lead("head_realtime").over(own)).withColumn("_head", F.coalesce("head_realtime", F.lag("head_realtime").over(own), F.lit(0)))
    tail = F.when(F.col("status") == "active", F.lit(None)).otherwise(F.col("_next"))
    return ends.where((F.col("_head") < end) & F.coalesce(tail > start, F.lit(True))).drop("_next", "_head")


SLACK = 120_000_000


def may_overlap(files: DataFrame, after: int, before: int, slack: int = SLACK) -> DataFrame:
    """Files by head and tail time, with slack on both sides; a tail of 0 keeps a file."""
    return files.where((F.col("tail_realtime") == 0) | ((F.col("tail_realtime") >= after - slack) & (F.col("head_realtime") <= before + slack)))


def request_order(backward: bool = True) -> list[Column]:
    cols = [F.col("tail_realtime"), F.col("mtime_usec"), F.col("head_realtime")]
    return [c.desc() if backward else c.asc() for c in cols]


def summary(files: DataFrame, by: str = "source") -> DataFrame:
    """(source, files, size_bytes, first, last) of each source."""
    return files.groupBy(by).agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("size_bytes"), F.min("head_realtime").alias("first_usec"), F.max("tail_realtime").alias("last_usec"))


def disk_usage(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("size_bytes"), F.lit(0).cast("long")).alias("size_bytes"))


def status_of(path: str) -> str:
    """A name's status on the driver."""
    name = os.path.basename(path)
    if ".journal~" in name:
        return "disposed"
    if re.search(r"@[0-9a-fA-F]{32}-[0-9a-fA-F]{16}-[0-9a-fA-F]{16}\.journal", name):
        return "archived"
    return "active" if "@" not in name else "unknown"
