"""Counts by field and value, in one pass over the rows, with same-field filters excluded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.predicates import all_of, false_if_null, filters
from emberlog.schema import ABSENT, LogSchema

#: Longest facet value shown, in bytes.
MAX_VALUE_BYTES = 8192


def _pair(name: str):
    return lambda v: F.struct(F.lit(name).alias("field"), v.alias("value"))


def facets(
    df: DataFrame,
    schema: LogSchema,
    names: list[str],
    *,
    selected: dict[str, list[str]] | None = None,
    base: Column | None = None,
    exclude_own: bool = True,
    all_values: bool = False,
) -> DataFrame:
    """(field, value, n). A facet is counted under every filter but, by ``exclude_own``, those on its own field.

    Counts first values, an absent one as ``-``; by ``all_values`` every
    occurrence. Each row is read once: it is exploded to one element for each
    facet whose other filters it meets, and counts are added up before the shuffle.
    """
    wanted = filters(schema, selected or {})
    own = {n for n in wanted if exclude_own and n in names}  # some facet leaves these out; the others hold for all and come first
    tests = {n: false_if_null(wanted[n]) for n in wanted if n in own}
    elements = []
    for n in names:
        ok = all_of(c for m, c in tests.items() if m != n)
        if all_values:
            values = F.when(F.size(schema.values(n)) > 0, schema.values(n)).otherwise(F.array(F.lit(ABSENT)))
            elements.append(F.when(ok, F.transform(values, _pair(n))).otherwise(F.array().cast("array<struct<field:string,value:string>>")))
        else:
            elements.append(F.when(ok, F.struct(F.lit(n).alias("field"), F.coalesce(schema.value(n), F.lit(ABSENT)).alias("value"))))
    found = F.flatten(F.array(*elements)) if all_values else F.array_compact(F.array(*elements))
    rows = df if base is None else df.where(base)
    for c in (wanted[n] for n in wanted if n not in own):
        rows = rows.where(c)
    return rows.select(F.explode(found).alias("f")).groupBy(F.col("f.field").alias("field"), F.col("f.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def function_facets(df: DataFrame, schema: LogSchema, names: list[str], selected: dict[str, list[str]], base: Column | None = None) -> DataFrame:
    """Facets as the logs function counts them: own filters are excluded only if filters touch more than one field."""
    touched = [n for n, v in selected.items() if v]
    return facets(df, schema, names, selected=selected, base=base, exclude_own=len(touched) > 1)


def with_empty(counts: DataFrame, names: list[str]) -> DataFrame:
    """Requested facets without any row appear with a null value and 0."""
    asked = counts.sparkSession.createDataFrame([(n,) for n in names], "field string")
    return asked.join(counts, "field", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def vocabulary(df: DataFrame, schema: LogSchema, names: list[str], base: Column | None = None) -> DataFrame:
    """(field, value) of all values in the rows, filtered or not; absent ones are left out."""
    pairs = F.flatten(F.array(*[F.transform(schema.values(n), _pair(n)) for n in names]))
    rows = df if base is None else df.where(base)
    return rows.select(F.explode(pairs).alias("f")).select("f.field", "f.value").distinct()


def with_zero_counts(counts: DataFrame, known: DataFrame, selected: dict[str, list[str]]) -> DataFrame:
    """Counts with every known or selected value, 0 where nothing was counted."""
    chosen = [(n, v) for n, values in selected.items() for v in values]
    if chosen:
        known = known.unionByName(counts.sparkSession.createDataFrame(chosen, "field string, value string")).distinct()
    return known.join(counts, ["field", "value"], "full").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def truncated(value: Column, limit: int = MAX_VALUE_BYTES) -> Column:
    """At most ``limit`` bytes of a value; a character cut in two becomes the replacement character."""
    raw = F.encode(value, "UTF-8")
    return F.when(F.octet_length(value) <= limit, value).otherwise(F.make_valid_utf8(F.substring(raw, 1, limit).cast("string")))


def presented(counts: DataFrame, most: int | None = None) -> DataFrame:
    """Facet options as shown: empty and absent values dropped, long ones cut and merged, and their order from 1.

    PRIORITY is ordered by number, other facets by count downwards and value. With ``most`` a facet has so many options
    at most; Spark then keeps no more of each before it shuffles them.
    """
    shown = counts.where(~F.col("value").isin("", ABSENT)).groupBy("field", truncated(F.col("value")).alias("value")).agg(F.sum("n").alias("n"))
    number = F.when(F.col("field") == "PRIORITY", F.coalesce(F.col("value").try_cast("bigint"), F.lit(1 << 62)))
    order = Window.partitionBy("field").orderBy(number.asc_nulls_last(), F.when(F.col("field") == "PRIORITY", F.lit(0)).otherwise(-F.col("n")), "value")
    ranked = shown.withColumn("order", F.row_number().over(order))
    ranked = ranked if most is None else ranked.where(F.col("order") <= most)
    return ranked.withColumn("order", F.col("order").cast("long"))
