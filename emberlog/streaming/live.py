"""Live logs: follow, incremental facets and histograms, strict clocks and rotation as state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberlog.operators.facets import facets
from emberlog.schema import ABSENT, LogSchema


def read(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """New Parquet files of a folder as they appear."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def follow(rows: DataFrame, emit: Callable[[DataFrame, int], None], checkpoint: str, condition=None, interval: str = "1 second", initial: DataFrame | None = None):
    """Calls emit for each batch of rows that meet a condition; the checkpoint takes the place of a cursor, so a restart goes on behind the last batch.

    ``initial``, such as the last lines of what is there, is emitted first, as batch -1.
    """
    if initial is not None:
        emit(initial, -1)
    found = rows if condition is None else rows.where(condition)
    return found.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def facet_updates(rows: DataFrame, schema: LogSchema, names: list[str], selected: dict[str, list[str]] | None = None) -> DataFrame:
    """Running facet counts, for output mode update or complete. State: one row for each field and value."""
    return facets(rows, schema, names, selected=selected)


def histogram_updates(rows: DataFrame, schema: LogSchema, name: str, width: str, lateness: str = "2 minutes") -> DataFrame:
    """(bucket_start, value, n) by tumbling windows of effective time. Rows later than ``lateness`` are dropped, which bounds the state."""
    timed = rows.withColumn("_at", F.timestamp_micros(schema.effective())).withColumn("_value", F.coalesce(schema.value(name), F.lit(ABSENT)))
    counted = timed.withWatermark("_at", lateness).groupBy(F.window("_at", width), "_value").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.unix_micros("window.start").alias("bucket_start"), F.col("_value").alias("value"), "n")


def strict_clock(rows: DataFrame, chain: str, time: str, max_entries: int | None = None) -> DataFrame:
    """(chain, time, clock_usec, file_no): times that strictly rise along each chain, and the file each entry goes to, as state by chain."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, seen = state.get if state.exists else (-1, 0)
        for batch in batches:
            clocks, files = [], []
            for t in batch[time]:
                last = max(int(t), last + 1)
                clocks.append(last)
                files.append(seen // max_entries if max_entries else 0)
                seen += 1
            yield pd.DataFrame({chain: [key[0]] * len(batch), time: batch[time], "clock_usec": clocks, "file_no": files})
        state.update((last, seen))

    kind = rows.schema[chain].dataType.simpleString()
    out = f"{chain} {kind}, {time} long, clock_usec long, file_no long"
    return rows.select(chain, time).groupBy(chain).applyInPandasWithState(step, out, "last long, seen long", "append", GroupStateTimeout.NoTimeout)


def changed_since(rows: DataFrame, schema: LogSchema, usec: int) -> bool:
    """Whether any entry is newer; the answer to a poll that finds nothing is 304."""
    newest = rows.agg(F.max(schema.realtime).alias("m")).first()["m"]
    return newest is not None and newest > usec


def learned_slack(rows: DataFrame, schema: LogSchema, least: int = 5_000_000, most: int = 120_000_000) -> DataFrame:
    """(file, slack_usec): the most a file's source time was behind its commit time, within bounds."""
    late = F.max(schema.realtime - schema.source_time)
    return rows.groupBy((schema.file if schema.file is not None else F.lit("")).alias("file")).agg(F.least(F.greatest(F.coalesce(late, F.lit(0)), F.lit(least)), F.lit(most)).cast("long").alias("slack_usec"))
