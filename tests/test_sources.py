import struct

from pyspark.sql import functions as F

from emberlog.schema import ENTRIES, LogSchema
from emberlog.sources import catalog, journal
from emberlog.streaming import live


def journal_bytes(entries):
    """A file of the public format: data objects, then entries that point to them."""
    body, at, places = b"", 272, {}

    def put(kind, payload):
        nonlocal body, at
        size = 16 + len(payload)
        raw = struct.pack("<BB6xQ", kind, 0, size) + payload
        raw += b"\0" * (-len(raw) % 8)
        here, body, at = at, body + raw, at + len(raw)
        return here

    for n, (t, fields) in enumerate(entries, 1):
        offsets = []
        for f in fields:
            if f not in places:
                places[f] = put(1, bytes(48) + f)
            offsets.append(places[f])
        put(3, struct.pack("<QQQ", n, t, t) + b"\xbb" * 16 + struct.pack("<Q", n) + b"".join(struct.pack("<QQ", o, 0) for o in offsets))
    head = bytearray(272)
    head[:8] = b"LPKSHHRH"
    head[72:88] = b"\xaa" * 16
    struct.pack_into("<QQ", head, 88, 272, len(body))
    return bytes(head) + body


def test_journal_source(spark, tmp_path):
    (tmp_path / "a.journal").write_bytes(journal_bytes([(10, [b"MESSAGE=x=y", b"A=1"]), (20, [b"MESSAGE=z", b"A=1", b"no sign"])]))
    (tmp_path / "bad.journal").write_bytes(b"nothing")
    sub = tmp_path / "m"
    sub.mkdir()
    import zstandard

    (sub / "c.journal.zst").write_bytes(zstandard.compress(journal_bytes([(5, [b"B=2"])])))
    got = journal.read(spark, str(tmp_path)).orderBy("realtime_usec").collect()
    assert [(r.seqnum, r.realtime_usec, r.boot_id[:2]) for r in got] == [(1, 5, "bb"), (1, 10, "bb"), (2, 20, "bb")]
    assert [(f.name, bytes(f.value)) for f in got[1].fields] == [("MESSAGE", b"x=y"), ("A", b"1")]
    journal.write(journal.read(spark, str(tmp_path)), str(tmp_path / "out"))
    assert journal.read_tables(spark, str(tmp_path / "out"), str(tmp_path / "out")).count() == 3


def test_records(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"entry_id": "1", "fields": [{"name": "A", "value": {"kind": "utf8", "value": "x"}}, {"name": "B", "value": {"kind": "bytes", "base64": "AAE="}}, {"name": "C", "value": {"kind": "repeat", "text": "ab", "count": 2}}]}\n')
    row = journal.read_records(spark, str(tmp_path / "r.jsonl")).first()
    assert [bytes(f.value) for f in row.fields] == [b"x", b"\x00\x01", b"abab"]


def test_catalogue(spark, tmp_path):
    a = "a" * 32
    names = ["system.journal", f"system@{a}-0000000000000001-0000000000000010.journal", f"system@{a}-0000000000000005-0000000000000020.journal", "user-1000.journal", "system@0000000000000030-0000000000000001.journal~", "x.txt"]
    for n in names:
        (tmp_path / n).write_text("x")
    paths, failed = catalog.discover(str(tmp_path))
    assert len(paths) == 5 and not failed and catalog.explicit([paths[0], paths[0]]) == [paths[0]]
    files = catalog.catalogue(spark, paths).cache()
    status = {r.path.rsplit("/", 1)[1]: r for r in files.collect()}
    assert status[names[1]].status == "archived" and status[names[1]].head_realtime == 16 and status[names[4]].status == "disposed" and status["user-1000.journal"].source_name == "1000"
    assert {r.path.rsplit("/", 1)[1] for r in catalog.in_range(files.where("source = 'system'"), ["source"], 17, 25).collect()} == {names[1]}
    assert catalog.in_range(files.where("source = 'system'"), ["source"], 33, 40).count() == 2
    assert catalog.selected(files, ["all-local-user-logs"]).count() == 1 and catalog.selected(files, ["all"]).count() == 5 and catalog.selected(files, ["1000"]).count() == 1
    ordered = [r.path.rsplit("/", 1)[1] for r in files.where("source = 'system'").orderBy(*catalog.status_order()).collect()]
    assert ordered == [names[4], names[1], names[2], names[0]]
    assert catalog.disk_usage(files).first().size_bytes == 5


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("c", 10, "a"), ("c", 10, "b"), ("c", 5, None)], "chain string, rt long, service string").coalesce(1)
    rows.write.parquet(str(tmp_path / "in"))
    s = LogSchema(F.col("rt"), {"SERVICE": F.col("service")})
    stream = live.read(spark, str(tmp_path / "in"), rows.schema)
    q = live.facet_updates(stream, s, ["SERVICE"]).writeStream.outputMode("complete").format("memory").queryName("facet_updates").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.value, r.n) for r in spark.table("facet_updates").collect()} == {("a", 1), ("b", 1), ("-", 1)}
    q = live.strict_clock(stream, "chain", "rt", 2).writeStream.outputMode("append").format("memory").queryName("clocks").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.clock_usec, r.file_no) for r in spark.table("clocks").collect()) == [(10, 0), (11, 0), (12, 1)]
    seen = []
    q = live.follow(stream, lambda df, _: seen.extend(df.collect()), str(tmp_path / "ck"), F.col("service") == "a")
    q.processAllAvailable()
    q.stop()
    assert len(seen) == 1
    assert live.changed_since(rows, s, 9) and not live.changed_since(rows, s, 10)


def test_entries_schema_is_stable():
    assert [f.name for f in ENTRIES][:3] == ["source_file", "machine_id", "boot_id"]


def test_linked_files_are_found_once(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "system.journal").write_bytes(b"")
    (tmp_path / "b.journal").symlink_to(tmp_path / "a" / "system.journal")
    (tmp_path / "again").symlink_to(tmp_path / "a")
    found, failed = catalog.discover(str(tmp_path))
    assert len(found) == 1 and failed == 0


def test_follow_begins_with_what_is_there(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.range(3).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    rows = live.read(spark, str(tmp_path / "in"), "id long")
    query = live.follow(rows, lambda df, n: seen.append((n, df.count())), str(tmp_path / "check"), initial=spark.range(2))
    query.processAllAvailable()
    query.stop()
    assert seen[0] == (-1, 2) and (0, 3) in seen
