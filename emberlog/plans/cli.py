"""Command-line options over entries: ``select(entries, argv)`` gives the rows and ``render`` their lines."""

from __future__ import annotations

import argparse
import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions import predicates as P
from emberlog.functions.timeparse import id128, timestamp
from emberlog.operators import boots, formats, paging
from emberlog.plans.reader import KEYS
from emberlog.schema import LogSchema, entries_schema

TEXT_MODES = [*formats.FORMATS, "short-unix", "short-monotonic", "short-delta"]
MODES = [*TEXT_MODES, "cat", "verbose", "export", "json", "json-pretty", "json-sse", "json-seq"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="emberlog", exit_on_error=False)
    add = p.add_argument
    add("matches", nargs="*")
    add("-S", "--since")
    add("-U", "--until")
    add("-c", "--cursor")
    add("--after-cursor")
    add("-b", "--boot", nargs="?", const="0")
    add("-k", "--dmesg", action="store_true")
    add("-u", "--unit", action="append", default=[])
    add("--user-unit", action="append", default=[])
    add("--uid", default="1000")
    add("--invocation")
    add("-I", dest="invocation", action="store_const", const="0")
    add("--cursor-file")
    add("-t", "--identifier", action="append", default=[])
    add("-T", "--exclude-identifier", action="append", default=[])
    add("-p", "--priority")
    add("--facility")
    add("-g", "--grep")
    add("--case-sensitive", type=lambda x: x == "true")
    add("-n", "--lines", nargs="?", const="10")
    add("-r", "--reverse", action="store_true")
    add("-e", "--pager-end", action="store_true")
    add("-m", "--merge", action="store_true")
    add("-o", "--output", default="short", choices=MODES)
    add("--output-fields")
    add("-a", "--all", action="store_true")
    add("--no-hostname", action="store_true")
    return p


def condition(options: argparse.Namespace, schema: LogSchema) -> Column:
    """All options that test a row by itself."""
    tests, m = [], P.Matches()
    for x in options.matches:
        m = m.disjunction() if x == "+" else m.add(x)
    tests.append(m.condition(schema))
    since, until = (timestamp(x) if x else None for x in (options.since, options.until))
    if since is not None and until is not None and since > until:
        raise ValueError("--since must be before --until")
    tests.append(P.within(F.col("realtime_usec"), since, until))
    if options.dmesg:
        tests.append(P.dmesg(schema))
    units = [P.unit(schema, u) for u in options.unit] + [P.unit(schema, u, options.uid) for u in options.user_unit]
    if units:
        tests.append(P.any_of(units))
    excluded = options.exclude_identifier if options.output in TEXT_MODES else []
    tests.append(P.identifiers(schema, options.identifier, excluded))
    if options.priority:
        tests.append(P.has_value(schema, "PRIORITY", P.priority_range(options.priority)))
    if options.facility:
        tests.append(P.has_value(schema, "SYSLOG_FACILITY", P.facility_list(options.facility)))
    if options.grep:
        tests.append(P.grep(schema, options.grep, options.case_sensitive))
    saved = None
    if options.cursor_file and os.path.exists(options.cursor_file):
        with open(options.cursor_file) as file:
            saved = file.read().strip()
    for cursor, exclusive in ((options.cursor, False), (options.after_cursor, True), (saved, True)):
        if cursor:
            tests.append(paging.from_cursor(paging.parse_cursor(cursor), exclusive))
    return P.all_of(tests)


def boot_condition(entries: DataFrame, option: str) -> Column:
    """``ID``, ``ID±N``, ``±N`` or ``all``; an offset out of range is an error. One small query finds the boot."""
    if option == "all":
        return F.lit(True)
    m = re.fullmatch(r"([0-9a-fA-F-]{32,36})?([+-]?\d+)?", option)
    if not m:
        raise ValueError(f"not a boot: {option!r}")
    if m[1] and not m[2]:
        return F.col("boot_id") == m[1].replace("-", "").lower()
    listed = boots.boots(entries, F.col("boot_id"), F.col("realtime_usec"))
    if m[1]:
        base = listed.where(F.col("boot_id") == m[1].replace("-", "").lower()).select((F.col("index") + int(m[2])).alias("index"))
        found = listed.join(base, "index", "left_semi").first()
    else:
        found = boots.boot_at(listed, int(m[2])).first()
    if found is None:
        raise ValueError(f"no such boot: {option!r}")
    return F.col("boot_id") == found.boot_id


def invocation_condition(entries: DataFrame, schema: LogSchema, option: str) -> Column:
    """``ID`` or an offset: above 0 from the oldest, else from the newest; one out of range is an error."""
    if not re.fullmatch(r"[+-]?\d{1,9}", option):
        return P.invocation(schema, id128(option))
    found = boots.boot_at(boots.invocations(entries, schema, F.col("realtime_usec")), int(option)).first()
    if found is None:
        raise ValueError(f"no such invocation: {option!r}")
    return P.invocation(schema, found.invocation_id)


def save_cursor(rows: DataFrame, options: argparse.Namespace) -> None:
    """Writes the cursor of the last row to the cursor file, for the next run to go on behind it; without rows the file stays."""
    last = rows.orderBy(*[F.col(k).desc() for k in KEYS]).limit(1).select(cursor_of().alias("cursor")).first()
    if options.cursor_file and last is not None:
        with open(options.cursor_file, "w") as file:
            file.write(last.cursor + "\n")


def cursor_of() -> Column:
    return paging.cursor(F.col("seqnum_id"), F.col("seqnum"), F.col("boot_id"), F.col("monotonic_usec"), F.col("realtime_usec"), F.col("xor_hash"))


def select(entries: DataFrame, argv: list[str]) -> tuple[DataFrame, argparse.Namespace]:
    """The rows of a command line, in the order of output."""
    options = parser().parse_args(argv)
    schema = entries_schema()
    if options.boot is None and (options.dmesg or options.pager_end) and not options.merge:
        options.boot = "0"
    if options.grep and options.lines and not options.lines.startswith("+"):
        options.reverse = True
    rows = entries
    if options.boot is not None and options.invocation is None:
        rows = rows.where(boot_condition(entries, options.boot))
    if options.invocation is not None:
        rows = rows.where(invocation_condition(entries, schema, options.invocation))
    rows = rows.where(condition(options, schema))
    lines = options.lines or ("1000" if options.pager_end else "all")
    rows = paging.lines(rows, KEYS, lines)
    return (rows.orderBy(*[F.col(k).desc() for k in KEYS]) if options.reverse else rows), options


def render(rows: DataFrame, options: argparse.Namespace) -> DataFrame:
    """(line) of each row, bytes for export; a boot's begin is told in text modes. All fields are shown where no output fields are named."""
    s, mode = entries_schema(), options.output
    fields = F.col("fields")
    if options.output_fields:
        fields = F.filter(fields, lambda f: f["name"].isin(*options.output_fields.split(",")))
    others = F.filter(fields, lambda f: f["name"] != "_BOOT_ID")  # told by the metadata
    cursor = cursor_of()
    meta = {"__CURSOR": cursor, "__REALTIME_TIMESTAMP": F.col("realtime_usec"), "__MONOTONIC_TIMESTAMP": F.col("monotonic_usec"), "_BOOT_ID": F.col("boot_id")}
    if mode == "cat":
        line = formats.cat(s, options.output_fields.split(",") if options.output_fields else None)
    elif mode == "export":
        return formats.export_binary(rows.withColumn("fields", others).withColumn("cursor", cursor)).withColumnRenamed("record", "line")
    elif mode.startswith("json"):
        line = formats.framed(formats.json_fields(others, meta, options.all, mode == "json-pretty"), mode)
    elif mode == "verbose":
        line = formats.verbose_fields(fields, F.concat(formats.stamp("short-full", F.col("realtime_usec"), F.col("monotonic_usec")), F.lit(" ["), cursor, F.lit("]")))
    elif mode == "short-delta":
        rows = formats.delta(rows, KEYS, "boot_id", "realtime_usec", "monotonic_usec")
        change = F.coalesce(F.format_string("<%d.%06d>", F.floor(F.col("delta_usec") / 1_000_000), F.pmod("delta_usec", F.lit(1_000_000))), F.lit(""))
        line = F.concat(formats.stamp("short-monotonic", F.col("realtime_usec"), F.col("monotonic_usec")), change, F.when(F.col("other_boot"), "*").otherwise(""), F.lit(" "), formats.label(s, not options.no_hostname), F.lit(": "), F.coalesce(formats.blob(s.raw_value("MESSAGE")), F.lit("")))
    else:
        line = formats.short(s, mode, F.col("realtime_usec"), F.col("monotonic_usec"), not options.no_hostname)
    if mode in TEXT_MODES:
        rows = boots.separators(rows, "boot_id", KEYS)
        line = F.concat_ws("\n", "separator", line)
    return rows.select(line.alias("line"))
