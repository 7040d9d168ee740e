"""Which fields and values there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.schema import ABSENT, LogSchema


def field_names(df: DataFrame, schema: LogSchema) -> DataFrame:
    """(field) of every field that some row has; matches play no part.

    Wide columns are only counted: one aggregate row, then unpivoted.
    """
    names = list(schema.fields)
    parts = []
    if names:
        seen = df.agg(*[F.max(schema.value(n).isNotNull()).alias(f"c{k}") for k, n in enumerate(names)])
        pairs = F.array_compact(F.array(*[F.when(F.col(f"c{k}"), F.lit(n)) for k, n in enumerate(names)]))
        parts.append(seen.select(F.explode(pairs).alias("field")))
    if schema.repeated is not None:
        parts.append(df.select(F.explode(F.array_distinct(F.transform(schema.repeated, lambda f: f["name"]))).alias("field")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.distinct()


def unique_values(df: DataFrame, schema: LogSchema, name: str) -> DataFrame:
    """(value) distinct over all rows."""
    if name in schema.fields:
        return df.select(schema.value(name).alias("value")).where("value is not null").distinct()
    return df.select(F.explode(schema.values(name)).alias("value")).distinct()


def payload(name: Column | str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}=") if isinstance(name, str) else F.concat(name, F.lit("=")), value)


def split_payload(raw: Column) -> tuple[Column, Column]:
    """Name and value of a payload at its first =; without one both are null."""
    at = F.instr(raw, "=")
    return F.when(at > 0, F.substring(raw, F.lit(1), at - 1)), F.when(at > 0, F.substring(raw, at + 1, F.length(raw)))


def projected(df: DataFrame, schema: LogSchema, names: list[str], time: str = "timestamp") -> DataFrame:
    """A table of chosen fields, the time first; a repeated field shows its last value, an absent one null."""
    return df.select(schema.effective().alias(time), *[F.try_element_at(schema.values(n), F.lit(-1)).alias(n) if schema.repeated is not None and n not in schema.fields else schema.value(n).alias(n) for n in names])


def process_name(schema: LogSchema) -> Column:
    """Container, else identifier, else command, with the process id in brackets (``[-]`` without one); ``-`` with no name."""
    name = F.coalesce(schema.value("CONTAINER_NAME"), schema.value("SYSLOG_IDENTIFIER"), schema.value("_COMM"))
    return F.when(name.isNull(), F.lit("-")).otherwise(F.concat(name, F.lit("["), F.coalesce(schema.value("_PID"), F.lit("-")), F.lit("]")))


def from_payloads(raw: Column) -> Column:
    """Raw payloads (an array of ``KEY=value`` bytes) as fields, cut at the first =; those without one, or without a key, are dropped."""

    def field(p: Column) -> Column:
        at = F.position(F.lit("3D"), F.regexp_replace(F.hex(p), "(..)", "$1 "))  # hexadecimal with a blank behind each byte
        key = F.floor((at - 1) / 3).cast("int")
        value = F.substring(p, key + 2, F.greatest(F.octet_length(p) - key - 1, F.lit(0)))
        return F.when((at > 0) & (key > 0), F.struct(F.make_valid_utf8(F.substring(p, F.lit(1), key).cast("string")).alias("name"), value.alias("value")))

    return F.array_compact(F.transform(raw, field))


def as_table(rows: list, names: list[str], gap: str = "  ") -> str:
    """Rows of a page as text, columns as wide as their longest value; an absent one is shown as -."""
    lines = [names, *[[ABSENT if r[n] is None else str(r[n]).replace("\n", " ") for n in names] for r in rows]]
    widths = [max(len(line[k]) for line in lines) for k in range(len(names))]
    return "\n".join(gap.join(v.ljust(w) for v, w in zip(line, widths, strict=True)).rstrip() for line in lines) + "\n"
