import pytest

from emberlog.plans import cli
from emberlog.plans.reader import Reader
from emberlog.schema import ENTRIES


@pytest.fixture(scope="module")
def entries(spark):
    def row(n, boot, **fields):
        return ("f", "m", boot, "5" * 32, n, 1_700_004_000_000_000 + n * 1000, n * 10, "ff", [(k, v.encode()) for k, v in fields.items()])

    a, b = "a" * 32, "b" * 32
    return spark.createDataFrame(
        [
            row(1, a, MESSAGE="file-a", SYSLOG_IDENTIFIER="app-a", PRIORITY="3", SYSLOG_FACILITY="3", _SYSTEMD_UNIT="alpha.service"),
            row(2, b, MESSAGE="second", SYSLOG_IDENTIFIER="app-a", PRIORITY="5", _SYSTEMD_UNIT="alpha.service", _SYSTEMD_INVOCATION_ID="2" * 32),
            row(3, b, MESSAGE="file-B", SYSLOG_IDENTIFIER="app-b", PRIORITY="4"),
            row(4, b, MESSAGE="kernel", PRIORITY="7", _TRANSPORT="kernel"),
        ],
        ENTRIES,
    )


def numbers(entries, *argv):
    return [r.seqnum for r in cli.select(entries, list(argv))[0].collect()]


def test_reader(entries):
    r = Reader(entries, page=2)
    assert r.next() == 1 and r.data("MESSAGE") == b"file-a" and r.next(9) == 3 and r.next() == 0
    cursor = r.cursor()
    assert r.test_cursor(cursor) and r.previous() == 1 and r.seqnum()[0] == 3 and not r.test_cursor(cursor)
    r.seek_cursor(cursor)
    assert r.next() == 1 and r.seqnum()[0] == 4
    r.seek_tail()
    assert r.previous(2) == 2 and r.seqnum()[0] == 3
    r.seek_realtime(1_700_004_000_002_000)
    assert r.next() == 1 and r.seqnum()[0] == 2
    r.add_match("SYSLOG_IDENTIFIER=app-b")
    r.add_disjunction()
    r.add_match("PRIORITY=7")
    r.seek_head()
    assert r.next(5) == 2
    r.flush_matches()
    assert r.matched().count() == 4 and "PRIORITY" in r.field_names() and r.unique("PRIORITY").count() == 4 and r.boots().count() == 2
    assert r.output("text", []).count() == 4
    with pytest.raises(ValueError):
        Reader(entries).cursor()


def test_options(entries):
    assert numbers(entries) == [1, 2, 3, 4]
    assert numbers(entries, "-b") == [2, 3, 4] and numbers(entries, "-b", "1") == [1] and numbers(entries, "-b", "-1") == [1] and numbers(entries, "-b", "a" * 32 + "+1") == [2, 3, 4]
    assert numbers(entries, "-k") == [4] and numbers(entries, "-u", "alpha") == [1, 2] and numbers(entries, "-u", "al*") == [1, 2]
    assert numbers(entries, "-p", "warning") == [1, 3] and numbers(entries, "--facility", "daemon") == [1]
    assert numbers(entries, "-t", "app-a", "-n", "1") == [2] and numbers(entries, "-T", "app-a") == [3, 4] and numbers(entries, "-T", "app-a", "-o", "json") == [1, 2, 3, 4]
    assert numbers(entries, "-g", "FILE") == [] and numbers(entries, "-g", "file") == [1, 3] and numbers(entries, "-g", "file", "-n", "5") == [3, 1]
    assert numbers(entries, "-r", "-n", "2") == [4, 3] and numbers(entries, "-n", "+2") == [1, 2]
    assert numbers(entries, "PRIORITY=3", "+", "PRIORITY=7") == [1, 4] and numbers(entries, "--invocation", "2" * 32) == [2]
    assert numbers(entries, "--since", "@1700004000.002", "--until", "@1700004000.003") == [2, 3]
    for bad in (["-b", "9"], ["--since", "@2", "--until", "@1"], ["-p", "loud"]):
        with pytest.raises(ValueError):
            numbers(entries, *bad)


def test_lines(entries):
    def lines(*argv):
        return [r.line for r in cli.render(*cli.select(entries, list(argv))).collect()]

    assert lines("-o", "cat", "-n", "+1") == ["file-a"]
    assert lines("-o", "short-unix")[1].startswith("-- Boot " + "b" * 32 + " --\n1700004000.002000 app-a: second")
    assert all(x.startswith('{"__CURSOR":') for x in lines("-o", "json"))
    for mode in cli.MODES:
        assert len(lines("-o", mode)) == 4


def test_all_fields_are_shown(spark):
    import json

    fields = [("MESSAGE", b"m"), ("X", b"1"), ("_BOOT_ID", b"b"), ("BLOB", b"\x00\xff"), ("X", b"2"), ("OTHER", b"o")]
    entries = spark.createDataFrame([("f", "m", "b" * 32, "5" * 32, 1, 1_700_004_000_000_000, 10, "ff", fields)], ENTRIES)

    def line(*argv):
        return cli.render(*cli.select(entries, ["-a", *argv])).first().line

    shown = json.loads(line("-o", "json"))
    assert shown.pop("__CURSOR") and {k: v for k, v in shown.items() if k[:2] != "__"} == {"_BOOT_ID": "b" * 32, "MESSAGE": "m", "X": ["1", "2"], "BLOB": [0, 255], "OTHER": "o"}
    assert line("-o", "verbose").split("\n")[1:] == ["    BLOB=[2B blob data]", "    MESSAGE=m", "    OTHER=o", "    X=1", "    X=2", "    _BOOT_ID=b"]
    record = bytes(line("-o", "export"))
    assert record.endswith(b"_BOOT_ID=" + b"b" * 32 + b"\nBLOB\n\x02" + bytes(7) + b"\x00\xff\nMESSAGE=m\nOTHER=o\nX=1\nX=2\n\n")
    only = json.loads(line("-o", "json", "--output-fields", "X"))
    assert only["X"] == ["1", "2"] and "MESSAGE" not in only and b"MESSAGE" not in bytes(line("-o", "export", "--output-fields", "X"))


def test_cursor_file(entries, tmp_path):
    """A run goes on behind the last row that the run before has written down."""
    path, total = str(tmp_path / "cursor"), entries.count()
    rows, options = cli.select(entries, ["--cursor-file", path, "-n", "+2"])
    assert rows.count() == 2
    cli.save_cursor(rows, options)
    rest, options = cli.select(entries, ["--cursor-file", path])
    assert rest.count() == total - 2
    cli.save_cursor(rest, options)
    none, options = cli.select(entries, ["--cursor-file", path])
    assert none.count() == 0
    cli.save_cursor(none, options)
    assert cli.select(entries, ["--cursor-file", path])[0].count() == 0
