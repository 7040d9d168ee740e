from datetime import datetime, timezone

import pytest

from emberlog.functions import timeparse as t

NOW = datetime(2024, 3, 10, 12, 0, tzinfo=timezone.utc)
USEC = 1_000_000


def at(*args):
    return int(datetime(*args, tzinfo=timezone.utc).timestamp()) * USEC


def test_durations():
    assert t.duration("1h 30m") == 5400 * USEC and t.duration("2M") == 2 * 2_629_800 * USEC and t.duration("5") == 5 * USEC and t.duration("2m") == 120 * USEC and t.duration("1.5s") == 1_500_000
    for bad in ("", "x", "1 parsec", "0"):
        with pytest.raises(ValueError):
            t.duration(bad)
    assert t.duration("0", True) == 0


def test_timestamps():
    assert t.timestamp("@12.5") == 12_500_000
    assert t.timestamp("today", NOW) == at(2024, 3, 10) and t.timestamp("yesterday", NOW) == at(2024, 3, 9)
    assert t.timestamp("2 hours ago", NOW) == at(2024, 3, 10, 10) == t.timestamp("-2h", NOW)
    assert t.timestamp("2024-01-02 03:04", NOW) == at(2024, 1, 2, 3, 4)
    assert t.timestamp("2024-01-02T03:04:05+01:00", NOW) == at(2024, 1, 2, 2, 4, 5)
    assert t.timestamp("07:30", NOW) == at(2024, 3, 10, 7, 30)
    for bad in ("2024-01-02T03:04:05+0100", "soon", "@x"):
        with pytest.raises(ValueError):
            t.timestamp(bad, NOW)


def test_sizes_and_words():
    assert t.size("1.5K") == 1536 and t.size("2g") == 2 * 1024**3 and t.human_size(1536) == "1.5K" and t.human_size(12) == "12B"
    assert t.human_duration(365 * 86_400 + 61) == "1y 1m 1s" and t.human_duration(0) == "0s"
    assert t.flag("Yes") and not t.flag("off")


def test_windows():
    now = 1_700_000_000
    assert t.time_window(now, None, None) == ((now - 3600) * USEC, now * USEC + 999_999)
    assert t.time_window(now, -60, None) == ((now - 59) * USEC, now * USEC + 999_999)
    assert t.time_window(now, None, -10) == ((now - 10 - 599) * USEC, (now - 10) * USEC + 999_999)
    assert t.time_window(now, now + 10, now + 20) == ((now - 10) * USEC, now * USEC + 999_999)
    assert t.time_window(now, now, now - 50) == ((now - 50) * USEC, now * USEC + 999_999)
    assert t.to_usec(10**12) == 10**12


def test_ids():
    assert t.id128("0123456789ABCDEF0123456789abcdef") == t.id128("01234567-89AB-CDEF-0123-456789abcdef") == "0123456789abcdef0123456789abcdef"
    assert t.id128(t.new_id128())
    for bad in ("", "0" * 32, "x" * 32, "01234567-89ABCDEF-0123-456789abcdef0"):
        with pytest.raises(ValueError):
            t.id128(bad)


def test_tables_as_text():
    from emberlog.operators.listing import as_table

    assert as_table([{"a": 1, "b": None}, {"a": "long\nline", "b": "x"}], ["a", "b"]) == "a          b\n1          -\nlong line  x\n"
