"""Gap-free time histograms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.predicates import effective_within, false_if_null
from emberlog.schema import ABSENT, LogSchema

#: Widths of a bucket in seconds, from one second to thirty days.
WIDTHS = [1, 2, 5, 10, 15, 30, 60, 120, 180, 300, 600, 900, 1800, 3600, 7200, 21600, 28800, 43200, 86400, 172800, 259200, 432000, 604800, 1209600, 2592000]
USEC = 1_000_000
MAX_BUCKETS = 1001


def bucket_width(after: int, before: int, target: int = 150) -> int:
    """The largest width, in the unit of microseconds, of which at least ``target`` fit into the window; else one second."""
    return next((w * USEC for w in reversed(WIDTHS) if max(0, before - after) // (w * USEC) >= target), USEC)


@dataclass(frozen=True)
class Buckets:
    """``count`` buckets of ``width`` from ``start``; the last one also takes what lies beyond."""

    start: int
    width: int
    count: int

    @staticmethod
    def explorer(after: int | None, before: int | None, target: int = 150) -> Buckets:
        """Aligned to the width, with one bucket past the end; never more than 1001."""
        start = after or 0
        end = start + 3600 * USEC if before is None else before
        if end <= start:
            end = start + 1
        width = bucket_width(start, end, max(1, target))
        start -= start % width
        end += width - end % width
        count = (end - start) // width + 1
        if count > MAX_BUCKETS:
            return Buckets(start, max(1, (end - start) // 1000), MAX_BUCKETS)
        return Buckets(start, width, count)

    @staticmethod
    def engine(after: int, before: int, target: int = 50) -> Buckets:
        """The index engine's: the aligned range [start, end) that covers the window."""
        width = bucket_width(after, before, target)
        start = after - after % width
        return Buckets(start, width, max(1, -(-(before - start) // width)))

    def index(self, time: Column) -> Column:
        at = _div(time - F.lit(self.start).cast("long"), self.width)
        return F.least(F.greatest(at, F.lit(0).cast("long")), F.lit(self.count - 1).cast("long"))

    def spine(self, spark: SparkSession) -> DataFrame:
        at = spark.range(self.count)
        return at.select((F.lit(self.start).cast("long") + F.col("id") * F.lit(self.width).cast("long")).alias("bucket_start"))

    def start_of(self, time: Column) -> Column:
        return F.lit(self.start).cast("long") + self.index(time) * F.lit(self.width).cast("long")


def _div(a: Column, b: int) -> Column:
    """Integer division that rounds down; exact up to 2**53 buckets."""
    b = F.lit(b).cast("long")
    return ((a - F.pmod(a, b)) / b).cast("long")


def histogram(df: DataFrame, schema: LogSchema, name: str, buckets: Buckets, condition: Column | None = None) -> DataFrame:
    """(bucket_start, value, n) for every bucket and every value met, 0 where there is none; by effective time, absent as ``-``.

    The spine is a range of at most 1001 rows and values are joined after aggregation.
    """
    rows = df if condition is None else df.where(condition)
    counts = rows.groupBy(buckets.start_of(schema.effective()).alias("bucket_start"), F.coalesce(schema.value(name), F.lit(ABSENT)).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    # the counts are needed twice; both uses read one exchange
    dense = counts.select("value").distinct().select("value", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets.count - 1).cast("long"))).alias("at"))
    dense = dense.select((F.lit(buckets.start).cast("long") + F.col("at") * F.lit(buckets.width).cast("long")).alias("bucket_start"), "value")
    return dense.join(counts, ["bucket_start", "value"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def engine_histogram(df: DataFrame, schema: LogSchema, buckets: Buckets, condition: Column, names: list[str]) -> DataFrame:
    """(bucket_start, field, value, unfiltered, filtered): counts of all rows and of those that meet a condition.

    A row with null field and value has the bucket's totals; time is half open, as the index engine's.
    """
    end = buckets.start + buckets.width * buckets.count
    inside = df.where(effective_within(schema, buckets.start, end, half=True))
    none = F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"))
    pairs = F.array_compact(F.array(none, *[F.when(schema.value(n).isNotNull(), F.struct(F.lit(n).alias("field"), schema.value(n).alias("value"))) for n in names]))
    rows = inside.select(buckets.start_of(schema.effective()).alias("bucket_start"), false_if_null(condition).alias("ok"), F.explode(pairs).alias("f"))
    return rows.groupBy("bucket_start", F.col("f.field").alias("field"), F.col("f.value").alias("value")).agg(F.count(F.lit(1)).alias("unfiltered"), F.count_if("ok").alias("filtered"))


def dimension_stats(dense: DataFrame) -> DataFrame:
    """(value, min, max, sum, avg, points) of each value's counts over all buckets."""
    n = F.col("n")
    return dense.groupBy("value").agg(F.min(n).alias("min"), F.max(n).alias("max"), F.sum(n).alias("sum"), F.avg(n).alias("avg"), F.count(n).alias("points"))


def count_in_range(df: DataFrame, schema: LogSchema, start: int, end: int, width: int, condition: Column) -> DataFrame | None:
    """(n) of rows of an aligned range [start, end) that meet a condition; None if the range isn't aligned to the width."""
    if start % width or end % width:
        return None
    return df.where(effective_within(schema, start, end, half=True)).agg(F.count_if(false_if_null(condition)).alias("n"))


def merged(parts: list[tuple[Buckets, DataFrame]]) -> tuple[Buckets, DataFrame]:
    """One histogram of several of the same buckets."""
    shapes = {b for b, _ in parts}
    if len(shapes) != 1:
        raise ValueError("histograms of different buckets can't be merged")
    total = parts[0][1]
    for _, other in parts[1:]:
        total = total.unionByName(other)
    return parts[0][0], total.groupBy("bucket_start", "value").agg(F.sum("n").alias("n"))
