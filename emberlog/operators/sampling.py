"""Sampled exploration: exact by default; within a budget otherwise, with what wasn't read labelled.

The budget is dealt to (file, time slot) groups up front instead of being
carried along one scan. A group within its share is sampled whole, of a larger one the rows whose
hash falls below that share; so no rows are sorted. ``matched = sampled + unsampled + estimated`` always holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators.histogram import Buckets
from emberlog.schema import ABSENT, LogSchema

UNSAMPLED, ESTIMATED = "[unsampled]", "[estimated]"
DEFAULT_BUDGET = 1_000_000


def wanted(budget: int, after: int | None, before: int | None, data_only: bool, delta: bool) -> bool:
    """Sampling needs a budget and both bounds; rows alone are always exact."""
    return budget > 0 and after is not None and before is not None and (delta or not data_only)


def marked(df: DataFrame, schema: LogSchema, buckets: Buckets, *, budget: int = DEFAULT_BUDGET, files: int = 1, limit: int = 200) -> DataFrame:
    """Adds ``sampled``: of each group ``max(budget / 4 / (files x slots), limit)`` rows and an equal share of half the budget, by a hash of time and order.

    Costs one aggregate, of a row for each group, and a join with it.
    """
    groups = max(1, files * buckets.count)
    share = max(budget // 4 // groups, limit) + max(1, budget // 2 // groups)
    rows = df.withColumn("_file", F.coalesce(schema.file, F.lit("")) if schema.file is not None else F.lit("")).withColumn("_slot", buckets.index(schema.effective()))
    sizes = rows.groupBy("_file", "_slot").agg(F.count(F.lit(1)).alias("_members"))
    place = F.pmod(F.xxhash64(schema.effective(), *schema.order), F.lit(1 << 30))
    chosen = place < F.ceil(F.lit(float(share << 30)) / F.col("_members"))
    return rows.join(sizes, ["_file", "_slot"]).withColumn("sampled", chosen).drop("_file", "_slot", "_members")


def sampled_histogram(rows: DataFrame, schema: LogSchema, name: str, buckets: Buckets) -> DataFrame:
    """(bucket_start, value, n) of rows marked by ``marked``; rows not sampled count as [unsampled]."""
    value = F.when(F.col("sampled"), F.coalesce(schema.value(name), F.lit(ABSENT))).otherwise(UNSAMPLED)
    return rows.groupBy(buckets.start_of(schema.effective()).alias("bucket_start"), value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def spread(estimated: Column, first: Column, buckets: int) -> Column:
    """An estimate dealt over buckets from ``first`` on: an array of the count of each, by integer division, the remainder to the last."""
    left = F.lit(buckets) - first
    each = F.floor(estimated / left)
    return F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda k: F.when(k < first, F.lit(0)).when(k == buckets - 1, estimated - each * (left - 1)).otherwise(each))


def remaining(seen: Column, first_seqnum: Column, at_seqnum: Column, last_seqnum: Column) -> Column:
    """Rows left in a file: as many a sequence number as so far."""
    share = (at_seqnum - first_seqnum + 1) / F.nullif(last_seqnum - first_seqnum + 1, F.lit(0))
    return F.greatest(F.floor(seen / share) - seen, F.lit(0)).cast("long")


def shares(histogram: DataFrame) -> DataFrame:
    """Percentages of the two labels, for a message."""
    n = F.sum("n")

    def percent(label: str) -> Column:
        return F.coalesce(100.0 * F.sum(F.when(F.col("value") == label, F.col("n"))) / n, F.lit(0.0))

    return histogram.agg(n.alias("matched"), percent(UNSAMPLED).alias("unsampled_percent"), percent(ESTIMATED).alias("estimated_percent"))
