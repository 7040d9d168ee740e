"""How operators see a table as log entries.

A ``LogSchema`` names, for any DataFrame, the commit time, the source time, the
file and the fields. Fields are expressions over the row: wide columns (one
value each) or arrays of structs (name, value) that may repeat a name.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Label of a field that a row doesn't have.
ABSENT = "-"

FIELD = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.BinaryType())])
ENTRIES = T.StructType(
    [
        T.StructField("source_file", T.StringType()),
        T.StructField("machine_id", T.StringType()),
        T.StructField("boot_id", T.StringType()),
        T.StructField("seqnum_id", T.StringType()),
        T.StructField("seqnum", T.LongType()),
        T.StructField("realtime_usec", T.LongType()),
        T.StructField("monotonic_usec", T.LongType()),
        T.StructField("xor_hash", T.StringType()),
        T.StructField("fields", T.ArrayType(FIELD)),
    ]
)


def micros(name: str | Column) -> Column:
    """A timestamp with or without zone as microseconds; times without one are UTC."""
    return F.unix_micros((F.col(name) if isinstance(name, str) else name).cast("timestamp"))


@dataclass(frozen=True)
class Stored:
    """A stored column of times and how it holds them: ``usec`` as a number, ``timestamp`` with a zone or ``timestamp_ntz`` in UTC.

    A bound compared with the column itself, in its own type, reaches the scan.
    """

    column: Column
    kind: str = "usec"

    def literal(self, usec: int) -> Column:
        if self.kind == "usec":
            return F.lit(usec).cast("long")
        text = (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=usec)).strftime("%Y-%m-%d %H:%M:%S.%f")
        return F.expr(f"timestamp_ntz '{text}'" if self.kind == "timestamp_ntz" else f"timestamp '{text}+00:00'")


@dataclass(frozen=True)
class LogSchema:
    """Bindings of a table. ``fields`` maps a field's name to the expression of its (first) value as text.

    ``types`` tells fields that are stored as whole numbers (``long``): what they are matched with is then
    compared as numbers, so that it reaches the scan. ``stored`` is the column that the commit time is read from.
    """

    realtime: Column
    fields: dict[str, Column] = field(default_factory=dict)
    source_time: Column | None = None
    file: Column | None = None
    order: tuple[Column, ...] = ()
    #: An array of structs (name, value as text or bytes) for rows that may repeat a field.
    repeated: Column | None = None
    types: dict[str, str] = field(default_factory=dict)
    stored: Stored | None = None
    #: Whether values of ``repeated`` are bytes, which need not be text.
    binary: bool = False

    def text(self, value: Column) -> Column:
        """A value of ``repeated`` as text; bytes that are none become replacement characters."""
        return F.make_valid_utf8(value.cast("string")) if self.binary else value.cast("string")

    def raw_values(self, name: str) -> Column:
        """All values of a field as bytes, just as they are."""
        if self.repeated is not None and name not in self.fields:
            return F.transform(F.filter(self.repeated, lambda f: f["name"] == name), lambda f: f["value"].cast("binary"))
        return F.array_compact(F.array(self.value(name).cast("binary")))

    def raw_value(self, name: str) -> Column:
        return F.get(self.raw_values(name), F.lit(0))

    def value(self, name: str) -> Column:
        """The first value of a field, null where it is absent."""
        if name in self.fields:
            return self.fields[name].cast("string")
        if self.repeated is None:
            return F.lit(None).cast("string")
        return self.text(F.get(F.filter(self.repeated, lambda f: f["name"] == name), F.lit(0))["value"])

    def values(self, name: str) -> Column:
        """All values of a field as an array; empty where it is absent."""
        if self.repeated is not None and name not in self.fields:
            return F.transform(F.filter(self.repeated, lambda f: f["name"] == name), lambda f: self.text(f["value"]))
        return F.array_compact(F.array(self.value(name)))

    def payloads(self) -> Column:
        """All values of a row, whatever their field."""
        wide = [self.value(n) for n in self.fields]
        own = F.array_compact(F.array(*wide)) if wide else F.array().cast("array<string>")
        if self.repeated is None:
            return own
        return F.concat(own, F.transform(self.repeated, lambda f: self.text(f["value"])))

    def effective(self) -> Column:
        """The source time where there is one, not zero and before the commit time; else the commit time."""
        if self.source_time is None:
            return self.realtime
        return F.when((self.source_time != 0) & (self.source_time < self.realtime), self.source_time).otherwise(self.realtime)


def entries_schema() -> LogSchema:
    """The binding of the canonical ``entries`` table. Values are bytes; only those that are asked for are turned into text."""
    fields = F.col("fields")
    source = F.get(F.filter(fields, lambda f: f["name"] == "_SOURCE_REALTIME_TIMESTAMP"), F.lit(0))["value"]
    usec = F.make_valid_utf8(source.cast("string")).try_cast("bigint")
    return LogSchema(F.col("realtime_usec"), {}, usec, F.col("source_file"), (F.col("seqnum"),), fields, stored=Stored(F.col("realtime_usec")), binary=True)


def wide(entries: DataFrame, names: list[str], as_bytes: bool = False) -> DataFrame:
    """Promotes fields to columns of their first values as text; the others stay in ``rest``, a map to all their values, as text or as bytes."""
    schema = entries_schema()
    rest = F.filter(schema.repeated, lambda f: ~f["name"].isin(*names))
    keys = F.array_distinct(F.transform(rest, lambda f: f["name"]))
    grouped = F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(rest, lambda f: f["name"] == k), lambda f: f["value"] if as_bytes else schema.text(f["value"]))))
    return entries.select(*[c for c in entries.columns if c != "fields"], *[schema.value(n).alias(n) for n in names], grouped.alias("rest"))


def narrow(df: DataFrame, names: list[str], rest: list[str]) -> DataFrame:
    """The inverse for wide columns: an array of fields from those that aren't null, in the order of names."""
    pairs = F.array(*[F.when(F.col(n).isNotNull(), F.struct(F.lit(n).alias("name"), F.col(n).cast("string").cast("binary").alias("value"))) for n in names])
    return df.select(*rest, F.array_compact(pairs).alias("fields"))
