"""Times, durations and sizes as text, and time windows of requests. Driver side: each gives one literal."""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timedelta, timezone

USEC = 1_000_000

#: Microseconds of each unit; M alone is a month, other units ignore case.
UNITS = {
    "us usec usecs": 1,
    "ms msec msecs": 1_000,
    "s sec secs second seconds": USEC,
    "m min mins minute minutes": 60 * USEC,
    "h hr hour hours": 3600 * USEC,
    "d day days": 86_400 * USEC,
    "w week weeks": 604_800 * USEC,
    "month months": 2_629_800 * USEC,
    "y year years": 31_557_600 * USEC,
}
_BY_NAME = {name: value for names, value in UNITS.items() for name in names.split()}

#: A window asked for without bounds, and without a begin; the longest relative bound: three years.
DEFAULT_WINDOW, MISSING_AFTER, LONGEST_RELATIVE = 3600, 600, 3 * 365 * 86_400


def duration(text: str, allow_zero: bool = False) -> int:
    """The sum of numbers with units; a bare number is seconds."""
    total, at = 0.0, 0
    items = list(re.finditer(r"\s*([0-9.]+)\s*([A-Za-z]*)", text))
    for m in items:
        if m.start() != at:
            break
        at = m.end()
        unit = m[2] or "s"
        scale = _BY_NAME["month"] if unit == "M" else _BY_NAME.get(unit.lower())
        if scale is None:
            raise ValueError(f"not a unit of time: {unit!r}")
        total += float(m[1]) * scale
    if not items or text[at:].strip() or not total and not allow_zero:
        raise ValueError(f"not a duration: {text!r}")
    return int(total)


def timestamp(text: str, now: datetime | None = None) -> int:
    """Microseconds since 1970 of now, today, @epoch, ``N ago``, ``+N``, ``-N``, a date, time or both; local without an offset."""
    text = text.strip()
    now = now or datetime.now().astimezone()

    def usec(t: datetime) -> int:
        if t.tzinfo is None:
            t = t.replace(tzinfo=now.tzinfo)
        return (t - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)

    days = {"today": 0, "yesterday": -1, "tomorrow": 1}
    if text == "now":
        return usec(now)
    if text in days:
        return usec(now.replace(hour=0, minute=0, second=0, microsecond=0) + timedelta(days=days[text]))
    if text.startswith("@"):
        if not (m := re.fullmatch(r"(\d+)(?:\.(\d*))?", text[1:])):
            raise ValueError(f"not a time: {text!r}")
        return int(m[1]) * USEC + int(((m[2] or "") + "000000")[:6])
    if text.endswith(" ago"):
        return usec(now) - duration(text[:-4].strip())
    if re.match(r"[+-](?!\d{4}-)", text):
        return usec(now) + (1 if text[0] == "+" else -1) * duration(text[1:])
    if "T" in text and re.search(r"[+-]\d{4}$", text):
        raise ValueError(f"not a time: {text!r}")
    if m := re.fullmatch(r"(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d+))?)?", text):
        return usec(now.replace(hour=int(m[1]), minute=int(m[2]), second=int(m[3] or 0), microsecond=int(((m[4] or "") + "000000")[:6])))
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?", text):
        return usec(datetime.fromisoformat(text))
    raise ValueError(f"not a time: {text!r}")


def size(text: str) -> int:
    """Bytes: a number with b, k, m, g, t, p or e, by 1024."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([bkmgtpe]?)(?:i?b)?\s*", text.lower())
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(float(m[1]) * 1024 ** "bkmgtpe".index(m[2] or "b"))


def human_size(n: int) -> str:
    """A size by 1024 with at most one decimal, cut off; a decimal of zero is left out."""
    unit = 0
    while n >> 10 * (unit + 1) and unit < 6:
        unit += 1
    if not unit:
        return f"{n}B"
    # the decimal is taken from whole units of the next smaller kind; those of K are bytes
    tenth = (n >> 10 * (unit - 1)) * 10 // 1024 % 10
    return f"{n >> 10 * unit}" + f".{tenth}" * bool(tenth) + "BKMGTPE"[unit]


def human_binary_size(n: int) -> str:
    """A size in B, KiB, MiB, GiB or TiB with at most two decimals, rounded; zeros behind them are left out."""
    value, unit = float(n), 0
    while value >= 1024 and unit < 4:
        value, unit = value / 1024, unit + 1
    name = ["B", "KiB", "MiB", "GiB", "TiB"][unit]
    return f"{n}B" if not unit else f"{value:.2f}".rstrip("0").rstrip(".") + name


def human_duration(seconds: int) -> str:
    """Years of 365 and months of 30 days, days, hours, minutes and seconds; zero parts are left out."""
    parts = []
    for unit, length in (("y", 365 * 86_400), ("mo", 30 * 86_400), ("d", 86_400), ("h", 3600), ("m", 60), ("s", 1)):
        n, seconds = divmod(seconds, length)
        parts += [f"{n}{unit}"] * bool(n)
    return " ".join(parts) or "0s"


def flag(text: str) -> bool:
    value = text.strip().lower()
    if value in ("1", "true", "yes", "y", "t", "on"):
        return True
    if value in ("0", "false", "no", "n", "f", "off"):
        return False
    raise ValueError(f"neither yes nor no: {text!r}")


def to_usec(value: int, end_of_second: bool = False) -> int:
    """Values from 1e12 are microseconds already, others seconds."""
    return value if value >= 10**12 else value * USEC + 999_999 * end_of_second


def time_window(now: int, after: int | None, before: int | None) -> tuple[int, int]:
    """A request's window in microseconds; now and small bounds are seconds.

    No bounds: the last hour. A bound within three years of 0 is relative, in the
    past whatever its sign; a missing begin is ten minutes. A relative begin counts from the end
    and gains a second. Swapped bounds are turned, empty windows become an hour, future ones move back.
    """
    after, before = after or 0, before or 0
    if not after and not before:
        before, after = now, now - DEFAULT_WINDOW
    else:
        if abs(before) <= LONGEST_RELATIVE:
            before = now - abs(before)
        if abs(after) <= LONGEST_RELATIVE:
            after = before - (abs(after) or MISSING_AFTER) + 1
        after, before = min(after, before), max(after, before)
        late = max(0, before - now)
        after, before = after - late, before - late
    after, before = min(after, before), max(after, before)
    if after == before:
        after = before - DEFAULT_WINDOW
    return to_usec(max(after, 0)), to_usec(max(before, 0), True)


def id128(text: str) -> str:
    """An id of 32 hexadecimal digits, with or without dashes at the usual places, in lower case; all zeros and any other text are an error."""
    plain = text.replace("-", "") if re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", text) else text
    if not re.fullmatch(r"[0-9a-fA-F]{32}", plain) or not int(plain, 16):
        raise ValueError(f"not an id: {text!r}")
    return plain.lower()


def new_id128() -> str:
    return uuid.uuid4().hex
