"""A reader over entries in the shape of a journal handle: matches, a position, pages, fields.

The state is a condition and a position; each read is one bounded top-k query.
Entries are the canonical table (see ``schema.ENTRIES``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from emberlog.functions import predicates as P
from emberlog.operators import boots, formats, listing, paging
from emberlog.schema import entries_schema

KEYS = ["realtime_usec", "seqnum_id", "seqnum", "boot_id", "monotonic_usec", "xor_hash"]


class Reader:
    def __init__(self, entries: DataFrame, page: int = 256):
        self.entries, self.page, self.schema = entries, page, entries_schema()
        self.matches = P.Matches()
        self.position: list | None = None
        self.start: Column | None = None
        self.row: Row | None = None
        self.held: list[Row] = []
        self.forward = True

    # Matches.

    def add_match(self, payload: str) -> None:
        self.matches.add(payload)
        self.held = []

    def add_disjunction(self) -> None:
        self.matches.disjunction()

    def add_conjunction(self) -> None:
        self.matches.conjunction()

    def flush_matches(self) -> None:
        self.matches.flush()
        self.held = []

    def matched(self) -> DataFrame:
        return self.entries.where(self.matches.condition(self.schema))

    # Position.

    def _seek(self, start: Column | None, position: list | None = None) -> None:
        self.start, self.position, self.row, self.held = start, position, None, []

    def seek_head(self) -> None:
        self._seek(None)

    def seek_tail(self) -> None:
        self._seek(None)
        self.forward = False

    def seek_realtime(self, usec: int) -> None:
        self._seek(F.col("realtime_usec") >= usec)

    def seek_cursor(self, cursor: str) -> None:
        self._seek(paging.from_cursor(paging.parse_cursor(cursor)))

    def test_cursor(self, cursor: str) -> bool:
        """Whether the row at the position is at a cursor; parts that it lacks aren't compared."""
        parts = paging.parse_cursor(cursor)
        return self.row is not None and all(getattr(self.row, k) == v for k, v in parts.items())

    def _read(self, forward: bool) -> Row | None:
        if forward != self.forward or not self.held:
            rows = self.matched()
            if self.start is not None and self.position is None:
                rows = rows.where(self.start if forward else ~self.start)
            self.held = paging.next_page(rows, KEYS, self.position, self.page, forward).collect()
            self.forward = forward
        if not self.held:
            return None
        self.row = self.held.pop(0)
        self.position = [self.row[k] for k in KEYS]
        return self.row

    def next(self, n: int = 1) -> int:
        """Moves on by up to n rows; how many it moved."""
        return sum(1 for _ in range(n) if self._read(True) is not None)

    def previous(self, n: int = 1) -> int:
        return sum(1 for _ in range(n) if self._read(False) is not None)

    # The row.

    def entry(self) -> dict[str, list[bytes]]:
        out: dict[str, list[bytes]] = {}
        for f in self._at().fields:
            out.setdefault(f["name"], []).append(bytes(f["value"]))
        return out

    def data(self, name: str) -> bytes | None:
        return next((v[0] for n, v in self.entry().items() if n == name), None)

    def payloads(self) -> list[bytes]:
        return [f["name"].encode() + b"=" + bytes(f["value"]) for f in self._at().fields]

    def realtime(self) -> int:
        return self._at().realtime_usec

    def monotonic(self) -> tuple[int, str]:
        return self._at().monotonic_usec, self._at().boot_id

    def seqnum(self) -> tuple[int, str]:
        return self._at().seqnum, self._at().seqnum_id

    def cursor(self) -> str:
        r = self._at()
        return f"s={r.seqnum_id};i={r.seqnum:x};b={r.boot_id};m={r.monotonic_usec:x};t={r.realtime_usec:x};x={r.xor_hash}"

    def _at(self) -> Row:
        if self.row is None:
            raise ValueError("not at an entry")
        return self.row

    # All entries, whatever the matches.

    def field_names(self) -> list[str]:
        return [r.field for r in listing.field_names(self.entries, self.schema).orderBy("field").collect()]

    def unique(self, name: str) -> DataFrame:
        return listing.unique_values(self.entries, self.schema, name)

    def boots(self) -> DataFrame:
        return boots.boots(self.entries, F.col("boot_id"), F.col("realtime_usec"))

    def output(self, mode: str, names: list[str]) -> DataFrame:
        """(realtime_usec, text) of the matching entries."""
        text = {"text": formats.text(self.schema), "export": formats.export_text(self.schema, names, self._meta()), "json": formats.json_entry(self.schema, names, self._meta())}[mode]
        return self.matched().select("realtime_usec", text.alias("text"))

    def _meta(self) -> dict[str, Column]:
        cursor = paging.cursor(F.col("seqnum_id"), F.col("seqnum"), F.col("boot_id"), F.col("monotonic_usec"), F.col("realtime_usec"), F.col("xor_hash"))
        return {"__CURSOR": cursor, "__REALTIME_TIMESTAMP": F.col("realtime_usec"), "__MONOTONIC_TIMESTAMP": F.col("monotonic_usec"), "_BOOT_ID": F.col("boot_id")}
