"""Ordered reading: heads, tails, pages by anchor or key, and display times."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.schema import Stored

#: Rows of a page unless asked otherwise, and least rows of one.
DEFAULT_ROWS, LEAST_ROWS = 200, 2


def head(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows; a top-k, so no full sort."""
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, order: list[str | Column], n: int) -> DataFrame:
    """The last n rows, in forward order."""
    names = [F.col(c) if isinstance(c, str) else c for c in order]
    return df.orderBy(*[c.desc() for c in names]).limit(n).orderBy(*names)


def lines(df: DataFrame, order: list[str], option: str | None) -> DataFrame:
    """The command line's number of lines: ``N`` the last, ``+N`` the first, ``all``; bare is 10."""
    if option is None:
        return tail(df, order, 10)
    if option == "all":
        return df.orderBy(*order)
    if option.startswith("+"):
        return head(df, [F.col(c) for c in order], int(option[1:]))
    return tail(df, order, int(option))


def journal_order() -> list[str]:
    """A total order of the canonical entries. Within one sequence id, sequence numbers rise with time, so it agrees with them there."""
    return ["realtime_usec", "seqnum_id", "seqnum", "boot_id", "monotonic_usec", "xor_hash"]


@dataclass(frozen=True)
class Anchor:
    """Where a page begins: ``auto``, ``head``, ``tail``, or a time."""

    kind: str = "auto"
    time: int | None = None

    def condition(self, time: Column, backward: bool, exclusive: bool = False) -> Column:
        """Forward: later than the anchor. Backward: up to it, without it if exclusive."""
        if self.time is None:
            return F.lit(True)
        return time > self.time if not backward else (time < self.time if exclusive else time <= self.time)


def checked_anchor(anchor: int | None, backward: bool, after: int, before: int) -> tuple[Anchor, bool]:
    """An anchor outside the window is none, and the page goes backward then."""
    if anchor is None:
        return Anchor(), backward
    if not after <= anchor <= before:
        return Anchor(), True
    return Anchor("realtime", anchor), backward


def page(df: DataFrame, time: str, n: int, *, backward: bool = True, anchor: Anchor | None = None, exclusive: bool = True, ties: list[str] = (), stored: Stored | None = None) -> DataFrame:
    """n rows from an anchor, and all rows tied with the last of them, in order of time and ties.

    The n-th time is found first, by a top-k over the time column alone. The rows are
    then taken by comparing with it as a literal, so wide rows are never sorted as a whole. Where the times are those of
    ``stored``, both comparisons are made with that column and prune the scan.
    """
    at = F.col(time)

    def bounded(rows: DataFrame, usec: int, upper: bool, strict: bool) -> DataFrame:
        value = F.lit(usec).cast("long") if stored is None else stored.literal(usec)
        c = at if stored is None else stored.column
        return rows.where((c < value if strict else c <= value) if upper else (c > value if strict else c >= value))

    rows = df
    if anchor is not None and anchor.time is not None:
        rows = bounded(rows, anchor.time, backward, exclusive or not backward)
    first = rows.select(at.alias("_at")).orderBy(F.col("_at").desc() if backward else F.col("_at")).limit(max(n, 0))
    bound = first.agg((F.min if backward else F.max)("_at").alias("bound")).first()["bound"]
    kept = rows.limit(0) if bound is None else bounded(rows, bound, not backward, False)
    return kept.orderBy(at.desc() if backward else at, *ties)


def page_counters(df: DataFrame, shown: DataFrame, time: str, *, backward: bool, anchor: Anchor | None) -> DataFrame:
    """(matched, before, after): rows inside the anchor, and those not shown on either side of the page."""
    inside = F.lit(True) if anchor is None else anchor.condition(F.col(time), backward, True)
    counts = df.agg(F.count_if(inside).alias("matched"), F.count_if(~inside).alias("outside"))
    n = shown.agg(F.count(F.lit(1)).alias("shown"))
    rest = F.col("matched") - F.col("shown")
    before = F.lit(0).cast("long") + (F.col("outside") if backward else rest)
    after = F.lit(0).cast("long") + (rest if backward else F.col("outside"))
    return counts.join(F.broadcast(n)).select("matched", before.alias("before"), after.alias("after"))


def keyset(keys: list[str], values: list, forward: bool = True, stored: Stored | None = None) -> Column:
    """Rows strictly after (or before) a position, by the order of keys; the filter on the first key reaches the scan, through ``stored`` where that key is read from it."""
    tie = F.lit(False)
    for k, v in reversed(list(zip(keys, values, strict=True))):
        c, v = F.col(k), F.lit(v)
        tie = (c > v if forward else c < v) | ((c == v) & tie)
    own, value = (F.col(keys[0]), F.lit(values[0])) if stored is None else (stored.column, stored.literal(values[0]))
    return (own >= value if forward else own <= value) & tie


def next_page(df: DataFrame, keys: list[str], position: list | None, n: int, forward: bool = True, stored: Stored | None = None) -> DataFrame:
    """n rows after a position in the order of keys, which together identify a row."""
    rows = df if position is None else df.where(keyset(keys, position, forward, stored))
    return rows.orderBy(*[F.col(k) if forward else F.col(k).desc() for k in keys]).limit(n)


def unique_times(rows: DataFrame, time: str, file: str, ties: list[str], *, backward: bool = True, name: str = "display_usec") -> DataFrame:
    """Times of the rows of one page made unique within a run of rows of one file: each at least one microsecond on from the one before.

    For a page, whose size is bounded: the window over it is one partition.
    """
    at = F.col(time)
    order = Window.orderBy(at.desc() if backward else at, *ties)
    new = F.coalesce((F.lag(file).over(order) != F.col(file)).cast("int"), F.lit(1))
    runs = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("_run").orderBy(at.desc() if backward else at, *ties)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    numbered = runs.withColumn("_n", F.row_number().over(own).cast("long"))
    if backward:
        shown = F.min(at + F.col("_n")).over(upto) - F.col("_n")
    else:
        shown = F.max(at - F.col("_n")).over(upto) + F.col("_n")
    return numbered.withColumn(name, shown).drop("_new", "_run", "_n")


def cursor(seqnum_id: Column, seqnum: Column, boot: Column, monotonic: Column, realtime: Column, xor: Column) -> Column:
    """``s=..;i=..;b=..;m=..;t=..;x=..`` with numbers in hexadecimal."""

    def hexed(c: Column) -> Column:
        return F.lower(F.hex(c))

    return F.concat(F.lit("s="), seqnum_id, F.lit(";i="), hexed(seqnum), F.lit(";b="), boot, F.lit(";m="), hexed(monotonic), F.lit(";t="), hexed(realtime), F.lit(";x="), xor)


def cursor_parts(text: Column) -> dict[str, Column]:
    """The parts of a cursor; null where it has none. Ids without dashes, in lower case."""

    def part(letter: str) -> Column:
        return F.nullif(F.regexp_extract(text, f"(?:^|;){letter}=([0-9a-fA-F-]+)", 1), F.lit(""))

    def number(letter: str) -> Column:
        return F.conv(part(letter), 16, 10).cast("long")

    def id_(letter: str) -> Column:
        return F.lower(F.regexp_replace(part(letter), "-", ""))

    return {"seqnum_id": id_("s"), "seqnum": number("i"), "boot_id": id_("b"), "monotonic_usec": number("m"), "realtime_usec": number("t"), "xor_hash": F.lower(part("x"))}


def parse_cursor(text: str) -> dict[str, str | int]:
    """A cursor's parts on the driver; unknown ones are an error."""
    names = {"s": "seqnum_id", "i": "seqnum", "b": "boot_id", "m": "monotonic_usec", "t": "realtime_usec", "x": "xor_hash"}
    out: dict[str, str | int] = {}
    for item in filter(None, text.strip().split(";")):
        letter, sign, value = item.partition("=")
        if not sign or letter not in names:
            raise ValueError(f"not a cursor: {text!r}")
        out[names[letter]] = int(value, 16) if letter in "imt" else value.replace("-", "").lower()
    return out


def at_cursor(parts: dict[str, str | int]) -> Column:
    """Rows at a cursor: only the parts it has are compared."""
    out = F.lit(True)
    for name, value in parts.items():
        out = out & (F.col(name) == F.lit(value))
    return out


def from_cursor(parts: dict[str, str | int], exclusive: bool = False) -> Column:
    """Rows at or after a cursor, its hash apart: by sequence number within its sequence, else by monotonic time within its boot, else by time."""
    if "seqnum_id" in parts and "seqnum" in parts:
        own = F.col("seqnum_id") == parts["seqnum_id"]
        later = F.when(own, F.col("seqnum") > parts["seqnum"] if exclusive else F.col("seqnum") >= parts["seqnum"])
    else:
        later = F
    if "boot_id" in parts and "monotonic_usec" in parts:
        later = later.when(F.col("boot_id") == parts["boot_id"], F.col("monotonic_usec") > parts["monotonic_usec"] if exclusive else F.col("monotonic_usec") >= parts["monotonic_usec"])
    time = parts.get("realtime_usec")
    rest = F.lit(True) if time is None else (F.col("realtime_usec") > time if exclusive else F.col("realtime_usec") >= time)
    return rest if later is F else later.otherwise(rest)
