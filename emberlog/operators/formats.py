"""Renderings of entries: lines, JSON, export records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.display import printable
from emberlog.operators.boots import with_before
from emberlog.schema import LogSchema

UNIT_LABELS = ["_SYSTEMD_USER_UNIT", "_SYSTEMD_UNIT", "USER_UNIT", "UNIT", "OBJECT_SYSTEMD_USER_UNIT", "OBJECT_SYSTEMD_UNIT"]
#: JSON values are null from this length of name, = and value on, unless all is asked for.
LONG_JSON, LONG_VERBOSE, COLUMNS = 4096, 300, 80

#: Time formats of the short modes; see stamp() for the others.
FORMATS = {
    "short": "MMM dd HH:mm:ss",
    "short-precise": "MMM dd HH:mm:ss.SSSSSS",
    "short-iso": "yyyy-MM-dd'T'HH:mm:ssXXX",
    "short-iso-precise": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "short-full": "EEE yyyy-MM-dd HH:mm:ss z",
    "with-unit": "EEE yyyy-MM-dd HH:mm:ss z",
}


def stamp(mode: str, realtime: Column, monotonic: Column) -> Column:
    if mode == "short-unix":
        return F.format_string("%d.%06d", F.floor(realtime / 1_000_000), F.pmod(realtime, F.lit(1_000_000)))
    if mode == "short-monotonic":
        return F.format_string("[%5d.%06d]", F.floor(monotonic / 1_000_000), F.pmod(monotonic, F.lit(1_000_000)))
    return F.date_format(F.timestamp_micros(realtime), FORMATS[mode])


def label(schema: LogSchema, hostname: bool = True, unit: bool = False) -> Column:
    """Host, name and process id: identifier, command or executable; with ``unit`` the first unit field there is."""
    name = F.coalesce(*[schema.value(n) for n in UNIT_LABELS] * unit, *[schema.value(n) for n in ("SYSLOG_IDENTIFIER", "_COMM", "_EXE")], F.lit("unknown"))
    pid = F.coalesce(schema.value("_PID"), schema.value("SYSLOG_PID"))
    own = F.concat(name, F.coalesce(F.concat(F.lit("["), pid, F.lit("]")), F.lit("")))
    return F.concat(F.coalesce(F.concat(schema.value("_HOSTNAME"), F.lit(" ")), F.lit("")), own) if hostname else own


def blob(value: Column) -> Column:
    """A value as text, or its size where it can't be printed."""
    return F.when(printable(value), value.cast("string")).when(value.isNotNull(), F.format_string("[%dB blob data]", F.octet_length(value)))


def short(schema: LogSchema, mode: str, realtime: Column, monotonic: Column, hostname: bool = True) -> Column:
    message = F.coalesce(blob(schema.raw_value("MESSAGE")), F.lit(""))
    return F.concat(stamp(mode, realtime, monotonic), F.lit(" "), label(schema, hostname, mode == "with-unit"), F.lit(": "), message)


def delta(df: DataFrame, order: list[str], boot: str, realtime: str, monotonic: str, name: str = "delta_usec") -> DataFrame:
    """Microseconds since the row before: monotonic within a boot, else by realtime, then ``other_boot`` is true."""
    before = F.col("_before")
    first, same = before.isNull(), F.col(boot).eqNullSafe(before[boot])
    change = F.when(~first, F.when(same, F.col(monotonic) - before[monotonic]).otherwise(F.col(realtime) - before[realtime]))
    return with_before(df, order, [boot, realtime, monotonic]).withColumn(name, change).withColumn("other_boot", F.when(~first, ~same)).drop("_before").orderBy(*order)



def text(schema: LogSchema) -> Column:
    return F.concat(F.coalesce(schema.value("MESSAGE"), F.lit("")), F.lit("\n"))


def ellipsis(value: Column, width: int = COLUMNS) -> Column:
    return F.when(F.length(value) > width, F.concat(F.substring(value, 1, width - 1), F.lit("…"))).otherwise(value)


def json_value(name: str | Column, value: Column, show_all: bool = False) -> Column:
    """A value as JSON text: a string, or an array of bytes where it can't be printed; null if too long."""
    raw = value.cast("binary")
    numbers = F.concat(F.lit("["), F.array_join(F.transform(F.regexp_extract_all(F.hex(raw), F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10)), ","), F.lit("]"))
    quoted = F.regexp_extract(F.to_json(F.struct(value.cast("string").alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    shown = F.when(printable(value), quoted).otherwise(numbers)
    if show_all:
        return shown
    length = len(name) if isinstance(name, str) else F.octet_length(name)
    return F.when(F.octet_length(raw) + length + 1 >= LONG_JSON, F.lit("null")).otherwise(shown)


def _json(name: str, show_all: bool):
    return lambda v: json_value(name, v, show_all)


def json_entry(schema: LogSchema, names: list[str], meta: dict[str, Column], show_all: bool = False) -> Column:
    """One JSON object: metadata first, then fields in order of name; a repeated field is an array, an absent one left out.

    Where all are single columns, a row whose values can all be printed and are short is written as a whole.
    """
    slow = _json_by_field(schema, names, meta, show_all)
    if any(n not in schema.fields for n in names):
        return slow
    own = {n: schema.value(n) for n in sorted(names)}
    plain = printable(F.concat_ws("", *own.values()))
    if not show_all:
        plain = plain & ~_any_long(own)
    return F.when(plain, F.to_json(F.struct(*[c.cast("string").alias(k) for k, c in (meta | own).items()]))).otherwise(slow)


def _any_long(values: dict[str, Column]) -> Column:
    out = F.lit(False)
    for n, v in values.items():
        out = out | F.coalesce(F.octet_length(v) + len(n) + 1 >= LONG_JSON, F.lit(False))
    return out


def _json_by_field(schema: LogSchema, names: list[str], meta: dict[str, Column], show_all: bool) -> Column:
    parts = [F.concat(F.lit(f'"{k}":'), F.regexp_extract(F.to_json(F.struct(c.cast("string").alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)) for k, c in meta.items()]
    for n in sorted(names):
        values = schema.raw_values(n)
        listed = F.transform(values, _json(n, show_all))
        one = F.when(F.size(values) == 1, F.get(listed, F.lit(0))).when(F.size(values) > 1, F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")))
        parts.append(F.concat(F.lit(f'"{n}":'), one))
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))


def json_fields(fields: Column, meta: dict[str, Column], show_all: bool = False, pretty: bool = False) -> Column:
    """As json_entry, with all of an array of fields (name, value as bytes); by ``pretty`` with a line for each member and element."""
    colon, within_list, inside = (" : ", ",\n\t\t", "\n\t\t") if pretty else (":", ",", "")

    def text_(c: Column) -> Column:
        return F.regexp_extract(F.to_json(F.struct(c.cast("string").alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)

    def one(name: Column) -> Column:
        def bytes_spread(text: Column, tabs: str) -> Column:  # an array of bytes has a line for each
            inner = F.regexp_replace(F.regexp_replace(text, ",", f",\n{tabs}\t"), r"^\[(.*)", f"[\n{tabs}\t$1")
            return F.when(text.startswith("["), F.regexp_replace(F.regexp_replace(inner, r"(?s)\]$", f"\n{tabs}]"), r"(?s)^\[\s*\]$", "[]")).otherwise(text)

        values = F.filter(fields, lambda f: f["name"] == name)
        listed = F.transform(values, lambda f: bytes_spread(json_value(name, f["value"], show_all), "\t\t") if pretty else json_value(name, f["value"], show_all))
        single = json_value(name, F.get(values, F.lit(0))["value"], show_all)
        single = bytes_spread(single, "\t") if pretty else single
        several = F.concat(F.lit("[" + inside), F.array_join(listed, within_list), F.lit("\n\t]" if pretty else "]"))
        return F.concat(text_(name), F.lit(colon), F.when(F.size(listed) == 1, single).otherwise(several))

    parts = F.array_compact(F.array(*[F.concat(F.lit(f'"{k}"{colon}'), text_(c)) for k, c in meta.items()]))
    names = F.array_sort(F.array_distinct(F.transform(fields, lambda f: f["name"])))
    begin, between, end = ("{\n\t", ",\n\t", "\n}") if pretty else ("{", ",", "}")
    return F.concat(F.lit(begin), F.array_join(F.concat(parts, F.transform(names, one)), between), F.lit(end))


def framed(json: Column, mode: str) -> Column:
    """JSON as lines, server-sent events, a text sequence, or spread over lines."""
    if mode == "json-pretty":
        return F.concat(json, F.lit("\n"))
    if mode == "json-sse":
        return F.concat(F.lit("data: "), json, F.lit("\n\n"))
    if mode == "json-seq":
        return F.concat(F.lit("\x1e"), json, F.lit("\n"))
    return F.concat(json, F.lit("\n"))


def verbose(schema: LogSchema, names: list[str], head: Column) -> Column:
    """A headline and a line for each field; long values are cut."""
    lines = [F.transform(schema.raw_values(n), _verbose_line(F.lit(n))) for n in sorted(names)]
    return F.concat_ws("\n", head, *lines)


def _verbose_line(name: Column):
    def line(value: Column) -> Column:
        long_ = F.octet_length(value) + F.octet_length(name) + 1 >= LONG_VERBOSE
        return F.concat(F.lit("    "), name, F.lit("="), F.when(long_, F.format_string("[%dB blob data]", F.octet_length(value))).otherwise(blob(value)))

    return line


def cat(schema: LogSchema, names: list[str] | None = None) -> Column:
    """The values of some fields, of MESSAGE unless others are named, on a line each, repeated ones too; bytes that are no text become replacement characters."""
    return F.array_join(F.flatten(F.array(*[schema.values(n) for n in names or ["MESSAGE"]])), "\n")


def verbose_fields(fields: Column, head: Column) -> Column:
    """As verbose, with all of an array of fields (name, value as bytes), repeated ones too."""

    def line(f: Column) -> Column:
        return _verbose_line(f["name"])(f["value"])

    ordered = F.array_sort(fields, lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    return F.concat_ws("\n", head, F.transform(ordered, line))


def export_text(schema: LogSchema, names: list[str], meta: dict[str, Column]) -> Column:
    """An export record of text values: metadata, then fields in order of name, every value of a repeated one, and an empty line."""

    def line(n: str):
        return lambda v: F.concat(F.lit(f"{n}="), v)

    lines = [F.concat(F.lit(f"{k}="), c.cast("string")) for k, c in meta.items()] + [line(n)(schema.value(n)) if n in schema.fields else F.transform(schema.values(n), line(n)) for n in sorted(names)]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n\n"))


def export_binary(entries: DataFrame) -> DataFrame:
    """(record) in the export format of canonical entries: values beyond tab and printable ASCII are written by length.

    Needs little-endian lengths, which no built-in function writes, so batches go through pandas.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                record = bytearray()
                for name in ("cursor", "realtime_usec", "monotonic_usec", "boot_id"):
                    label_ = {"cursor": "__CURSOR", "realtime_usec": "__REALTIME_TIMESTAMP", "monotonic_usec": "__MONOTONIC_TIMESTAMP", "boot_id": "_BOOT_ID"}[name]
                    record += f"{label_}={getattr(row, name)}\n".encode()
                for f in sorted(row.fields, key=lambda f: f["name"]):
                    value = bytes(f["value"])
                    if all(b == 9 or 0x20 <= b <= 0x7E for b in value):
                        record += f["name"].encode() + b"=" + value + b"\n"
                    else:
                        record += f["name"].encode() + b"\n" + len(value).to_bytes(8, "little") + value + b"\n"
                out.append(bytes(record + b"\n"))
            yield pd.DataFrame({"record": out})

    return entries.select("cursor", "realtime_usec", "monotonic_usec", "boot_id", "fields").mapInPandas(run, "record binary")
