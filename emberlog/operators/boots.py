"""Boots and invocations: first and last entry of each id, and their numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.predicates import INVOCATION_FIELDS
from emberlog.schema import LogSchema


def boots(df: DataFrame, boot: Column, time: Column) -> DataFrame:
    """(index, boot_id, first_usec, last_usec, entries), numbered 1-n to 0 by last, first and id; an all-zero or null id is left out.

    One row a boot: counts of boots are far below those of entries, so the numbering sorts little.
    """
    rows = df.where(boot.isNotNull() & ~boot.cast("string").rlike("^0+$"))
    found = rows.groupBy(boot.cast("string").alias("boot_id")).agg(F.min(time).alias("first_usec"), F.max(time).alias("last_usec"), F.count(F.lit(1)).alias("entries"))
    order = Window.orderBy("last_usec", "first_usec", "boot_id")
    total = F.count(F.lit(1)).over(Window.partitionBy())
    return found.withColumn("index", (F.row_number().over(order) - total).cast("long"))


def boot_at(listed: DataFrame, offset: int) -> DataFrame:
    """The boot at an offset: above 0 counted from the oldest, else from the newest; none if out of range."""
    total = F.count(F.lit(1)).over(Window.partitionBy())
    place = F.col("index") + total  # 1 is the oldest
    wanted = F.lit(offset) if offset > 0 else total + F.lit(offset)
    return listed.withColumn("_place", place).withColumn("_wanted", wanted).where("_place = _wanted").drop("_place", "_wanted")


def invocations(df: DataFrame, schema: LogSchema, time: Column, condition: Column | None = None) -> DataFrame:
    """(index, invocation_id, first_usec, last_usec) of valid ids in any of the four invocation fields, numbered by first and id."""
    rows = df if condition is None else df.where(condition)
    ids = F.array_distinct(F.flatten(F.array(*[schema.values(n) for n in INVOCATION_FIELDS])))
    found = rows.select(time.alias("_time"), F.explode(ids).alias("invocation_id")).where(F.col("invocation_id").rlike("^[0-9a-f]{32}$") & ~F.col("invocation_id").rlike("^0+$"))
    listed = found.groupBy("invocation_id").agg(F.min("_time").alias("first_usec"), F.max("_time").alias("last_usec"))
    order = Window.orderBy("first_usec", "invocation_id")
    return listed.withColumn("index", (F.row_number().over(order) - F.count(F.lit(1)).over(Window.partitionBy())).cast("long"))


def first_times(df: DataFrame, boot: Column, time: Column) -> DataFrame:
    """(boot_id, first_usec), for notes on boots."""
    return df.where(boot.isNotNull()).groupBy(boot.cast("string").alias("boot_id")).agg(F.min(time).alias("first_usec"))


def with_before(df: DataFrame, order: list[str], columns: list[str], name: str = "_before") -> DataFrame:
    """Rows with a struct of these columns of the row before, null for the first; ``order`` begins with a number.

    Rows are dealt into buckets bounded by quantiles of that number; the first of a bucket takes
    the last row of the bucket below.
    """
    n = min(4096, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    steps = F.array(*[F.lit(j / n) for j in range(1, n)])
    bounds = sorted(set(df.agg(F.percentile_approx(order[0], steps, 20 * n).alias("b")).first()["b"] or []))
    bucket = F.size(F.filter(F.lit(bounds) if bounds else F.array().cast("array<bigint>"), lambda b: b < F.col(order[0])))
    rows = df.withColumn("_bucket", bucket).withColumn("_own", F.struct(*columns))
    tops = rows.groupBy("_bucket").agg(F.max_by("_own", F.struct(*order)).alias("_top"))
    below = tops.select("_bucket", F.lag("_top").over(Window.orderBy("_bucket")).alias("_below"))  # 4096 rows at most
    found = rows.withColumn("_lag", F.lag("_own").over(Window.partitionBy("_bucket").orderBy(*order)))
    return found.join(F.broadcast(below), "_bucket").withColumn(name, F.coalesce("_lag", "_below")).drop("_bucket", "_own", "_lag", "_below")


def separators(df: DataFrame, boot: str, order: list[str]) -> DataFrame:
    """Rows in order, with ``separator`` where the boot differs from the row before."""
    before = F.col("_before")
    changed = before.isNotNull() & ~F.col(boot).eqNullSafe(before[boot])
    return with_before(df, order, [boot]).withColumn("separator", F.when(changed, F.concat(F.lit("-- Boot "), F.col(boot).cast("string"), F.lit(" --")))).drop("_before").orderBy(*order)
