"""Small tables whose results are known."""

import random

import pytest
from pyspark.sql import functions as F

from emberlog.functions import display, predicates as P
from emberlog.operators import boots, facets, formats, lifecycle, paging, sampling
from emberlog.operators.histogram import Buckets, histogram, merged
from emberlog.plans import request
from emberlog.plans.explore import LogQuery, explore, explore_by_pass
from emberlog.schema import ENTRIES, LogSchema, entries_schema, narrow, wide

S: LogSchema


@pytest.fixture(autouse=True)
def schema(spark):
    """Columns need a session."""
    global S
    S = LogSchema(F.col("rt"), {"SERVICE": F.col("service"), "PRIORITY": F.col("priority")})


def rows(spark, *data):
    return spark.createDataFrame(data, "rt long, service string, priority string")


def pairs(df):
    return {(r.field, r.value): r.n for r in df.collect()}


def entry(fields, rt, n=1, boot="b1", file="f1"):
    return (file, "m", boot, "s", n, rt, rt, "00", [(k, v.encode()) for k, v in fields])


def test_filters_or_within_and_across(spark):
    df = rows(spark, (1000, "a", "3"), (2000, "b", "3"), (3000, "b", "4"))
    q = LogQuery(filters={"SERVICE": ["a", "b"], "PRIORITY": ["3"]}, facets=("SERVICE",))
    found = explore(df, S, q)
    assert found.rows.count() == 2
    assert pairs(found.facets) == {("SERVICE", "a"): 1, ("SERVICE", "b"): 1}


def test_own_filter_is_excluded(spark):
    df = rows(spark, (1000, "a", "3"), (2000, "b", "3"), (3000, "a", "4"))
    q = LogQuery(filters={"SERVICE": ["a"], "PRIORITY": ["3"]}, facets=("SERVICE", "PRIORITY"))
    expected = {("SERVICE", "a"): 1, ("SERVICE", "b"): 1, ("PRIORITY", "3"): 1, ("PRIORITY", "4"): 1}
    assert pairs(explore(df, S, q).facets) == expected == pairs(explore_by_pass(df, S, q))
    single = facets.function_facets(df, S, ["SERVICE"], {"SERVICE": ["a"]})
    assert pairs(single) == {("SERVICE", "a"): 2}


def test_absent_empty_and_literal_dash(spark):
    df = rows(spark, (1, None, "3"), (2, "-", "3"), (3, "", "3"))
    counts = facets.facets(df, S, ["SERVICE"])
    assert pairs(counts) == {("SERVICE", "-"): 2, ("SERVICE", ""): 1}
    assert facets.presented(counts).count() == 0
    assert pairs(facets.with_empty(counts.where("value = 'x'"), ["SERVICE"])) == {("SERVICE", None): 0}


def test_repeated_field(spark):
    df = spark.createDataFrame([entry([("TAG", "one"), ("TAG", "two"), ("SERVICE", "a")], 1000)], ENTRIES)
    s = entries_schema()
    assert pairs(facets.facets(df, s, ["TAG"], all_values=True)) == {("TAG", "one"): 1, ("TAG", "two"): 1}
    assert pairs(facets.facets(df, s, ["TAG"])) == {("TAG", "one"): 1}
    assert df.where(P.has_value(s, "TAG", ["two"])).count() == 1


def test_full_text(spark):
    data = [entry([("TAG", t), ("MESSAGE", m)], 1000 * k) for k, (t, m) in enumerate([("alpha", "alpha keep"), ("beta", "beta keep"), ("debug", "alpha debug"), ("other", "other"), ("wild", "start middle end")], 1)]
    df, s = spark.createDataFrame(data, ENTRIES), entries_schema()
    found = df.where(P.full_text(s, P.parse_terms("!debug|alpha|beta|start*end")))
    assert pairs(facets.facets(found, s, ["TAG"])) == {("TAG", "alpha"): 1, ("TAG", "beta"): 1, ("TAG", "wild"): 1}
    assert df.where(P.full_text(s, P.parse_terms("*"))).count() == 5
    assert df.where(P.full_text(s, P.parse_terms("ALPHA"))).count() == 2
    assert df.where(P.full_text_lists(s, ["alpha"], ["debug"])).count() == 1


def test_term_syntax():
    assert P.parse_terms(r"a|!b\|c|d*e||!") == [P.Term(("a",)), P.Term(("b|c",), True), P.Term(("d", "e"))]


def test_matches_shape(spark):
    df = rows(spark, (1, "a", "3"), (2, "b", "3"), (3, "b", "4"), (4, None, "4"))

    def ids(m):
        return [r.rt for r in df.where(m.condition(S)).orderBy("rt").collect()]

    assert ids(P.Matches()) == [1, 2, 3, 4]
    assert ids(P.Matches().add("SERVICE=a").add("SERVICE=b").add("PRIORITY=3")) == [1, 2]
    assert ids(P.Matches().add("SERVICE=a").disjunction().add("PRIORITY=4")) == [1, 3, 4]
    assert ids(P.Matches().add("SERVICE=b").conjunction().add("PRIORITY=4")) == [3]
    with pytest.raises(ValueError):
        P.Matches().add("lower=x")
    assert P.Filter.all(None, P.Filter.pair("SERVICE", "a")) == P.Filter.pair("SERVICE", "a")
    assert P.Filter.any(None, None) is None


def test_effective_time(spark):
    df = spark.createDataFrame([(100, 50), (100, 0), (100, 150), (100, None)], "rt long, src long")
    s = LogSchema(F.col("rt"), source_time=F.col("src"))
    assert [r[0] for r in df.select(s.effective()).collect()] == [50, 100, 100, 100]


def test_histogram_keeps_every_row_and_has_no_gaps(spark):
    df = rows(spark, *[(1_000_000 * k, "a" if k % 2 else None, "3") for k in range(100)])
    b = Buckets.explorer(0, 99_000_000)
    dense = histogram(df, S, "SERVICE", b)
    assert dense.count() == 2 * b.count and dense.agg(F.sum("n")).first()[0] == 100
    assert Buckets.explorer(0, 10**16, 10**6).count == 1001
    with pytest.raises(ValueError):
        merged([(b, dense), (Buckets.explorer(0, 10), dense)])


def test_page_keeps_the_boundary_group(spark):
    df = spark.createDataFrame([("a", 1_700_000_000_000_000), ("b", 1_700_000_000_000_000), ("c", 1_700_000_000_000_000)], "file string, rt long")
    assert paging.page(df, "rt", 2, ties=["file"]).count() == 3
    shown = paging.unique_times(df, "rt", "file", ["file"])
    assert {r.display_usec for r in shown.collect()} == {1_700_000_000_000_000}
    assert paging.page(df, "rt", 0).count() == 0


def test_keyset_pages_cover_every_row_once(spark):
    df = spark.createDataFrame([(k // 5, k) for k in range(23)], "t long, i long")
    seen, position = [], None
    while got := paging.next_page(df, ["t", "i"], position, 4).collect():
        seen += [r.i for r in got]
        position = list(got[-1])
    assert seen == list(range(23))


def test_unique_times_within_a_file(spark):
    df = spark.createDataFrame([("a", 10, 1), ("a", 10, 2), ("a", 10, 3), ("b", 9, 4), ("a", 9, 5)], "file string, rt long, i long")
    back = {r.i: r.display_usec for r in paging.unique_times(df, "rt", "file", ["i"]).collect()}
    assert back == {1: 10, 2: 9, 3: 8, 4: 9, 5: 9}


def test_cursors():
    parts = paging.parse_cursor("s=AB;i=1f;b=c-d;m=2;t=3;x=ff")
    assert parts == {"seqnum_id": "ab", "seqnum": 31, "boot_id": "cd", "monotonic_usec": 2, "realtime_usec": 3, "xor_hash": "ff"}
    with pytest.raises(ValueError):
        paging.parse_cursor("q=1")


def test_partial_cursor(spark):
    df = spark.createDataFrame([("s", k, "b", k * 10, k * 100) for k in range(5)], "seqnum_id string, seqnum long, boot_id string, monotonic_usec long, realtime_usec long")
    assert df.where(paging.from_cursor({"seqnum_id": "s", "seqnum": 2})).count() == 3
    assert df.where(paging.from_cursor({"seqnum_id": "s", "seqnum": 2}, True)).count() == 2
    assert df.where(paging.from_cursor({"realtime_usec": 300})).count() == 2
    assert df.where(paging.at_cursor({"boot_id": "b", "monotonic_usec": 10})).count() == 1


def test_boots(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 5), ("c", 7), ("000", 9)], "boot string, rt long")
    listed = boots.boots(df, F.col("boot"), F.col("rt"))
    assert [(r["index"], r.boot_id) for r in listed.orderBy("index").collect()] == [(-2, "a"), (-1, "b"), (0, "c")]
    assert boots.boot_at(listed, 1).first().boot_id == "a"
    assert boots.boot_at(listed, 0).first().boot_id == "c"
    assert boots.boot_at(listed, -5).count() == 0


def test_units_and_globs(spark):
    s = LogSchema(F.lit(0), {n: F.col(n) for n in ("_SYSTEMD_UNIT", "UNIT", "_SYSTEMD_CGROUP", "_SYSTEMD_SLICE")})
    df = spark.createDataFrame([("alpha.service", None, None, None), (None, "alpha.service", "/init.scope", None), (None, "alpha.service", "/other", None), ("beta.service", None, None, "app.slice")], "_SYSTEMD_UNIT string, UNIT string, _SYSTEMD_CGROUP string, _SYSTEMD_SLICE string")
    assert df.where(P.unit(s, "alpha")).count() == 2
    assert df.where(P.unit(s, "app.slice")).count() == 1
    assert df.where(P.unit(s, "*eta*")).count() == 1
    assert P.priority_range("err") == ["0", "1", "2", "3"] and P.priority_range("5..warning") == ["4", "5"]
    assert P.facility_list("kern,local7,3") == ["0", "23", "3"]


def test_display(spark):
    df = spark.createDataFrame([("3", "10", "2", "0"), ("9", "99", "1000", "zz")], "p string, f string, e string, c string")
    got = df.select(display.priority(F.col("p")), display.facility(F.col("f")), display.error_number(F.col("e")), display.capabilities(F.col("c")), display.severity(F.col("p"))).collect()
    assert tuple(got[0]) == ("error", "authpriv", "2 (ENOENT)", "0", "critical")
    assert tuple(got[1]) == ("9", "99", "1000", "zz", "debug")


def test_formats(spark):
    df = spark.createDataFrame([entry([("MESSAGE", "a\nb"), ("X", "1"), ("X", "2")], 1_700_000_000_000_001)], ENTRIES)
    s = entries_schema()
    assert df.select(formats.json_entry(s, ["MESSAGE", "X", "Y"], {"__T": F.col("seqnum")})).first()[0] == '{"__T":"1","MESSAGE":"a\\nb","X":["1","2"]}'
    assert df.select(formats.short(s, "short-unix", F.col("realtime_usec"), F.col("monotonic_usec"))).first()[0] == "1700000000.000001 unknown: a\nb"
    record = formats.export_binary(df.withColumn("cursor", F.lit("c"))).first()[0]
    assert bytes(record).endswith(b"MESSAGE\n" + (3).to_bytes(8, "little") + b"a\nb\nX=1\nX=2\n\n")


def test_field_policies(spark):
    df = spark.createDataFrame([entry([("OK", "1"), ("_T", "2"), ("bad", "3"), ("9X", "4")], 1)], ENTRIES)

    def names(policy):
        return [f.name for f in df.select(lifecycle.accepted(F.col("fields"), policy).alias("f")).first().f]

    assert names("app") == ["OK"] and names("raw") == ["OK", "_T", "bad", "9X"]
    with pytest.raises(Exception, match="invalid field name"):
        names("journald")


def test_rotation_is_derived():
    got = lifecycle.derived_rotation(lifecycle.Rotation(), 20 * 1024**4, 100)
    assert got == lifecycle.Rotation(None, 4 * 1024**3, 5)
    assert lifecycle.derived_rotation(lifecycle.Rotation(size=7), 10**9, None).size == 7


def test_wide_and_back(spark):
    df = spark.createDataFrame([entry([("A", "1"), ("A", "2"), ("B", "3")], 5)], ENTRIES)
    w = wide(df, ["A"]).first()
    assert w.A == "1" and w.rest == {"B": ["3"]}
    back = narrow(wide(df, ["A", "B"]), ["A", "B"], ["seqnum"]).first()
    assert [(f.name, bytes(f.value)) for f in back.fields] == [("A", b"1"), ("B", b"3")]


def test_json_is_flattened(spark):
    df = spark.createDataFrame([('{"a": {"b": [1, true]}, "c": "x"}',), ("no json",), (None,)], "j string")
    got = [[(f.name, bytes(f.value)) for f in r.fields] for r in lifecycle.from_json(df, "j").collect()]
    assert got == [[("a.b", b"1"), ("a.b", b"true"), ("c", b"x")], [], []]


def test_seals_change_with_content(spark):
    df = spark.createDataFrame([entry([("A", "1")], 5), entry([("A", "2")], 25, 2)], ENTRIES)
    tags = {r.epoch: r.tag for r in lifecycle.sealed(df, 0, 10, b"k").collect()}
    other = {r.epoch: r.tag for r in lifecycle.sealed(df.where("seqnum = 1").unionByName(spark.createDataFrame([entry([("A", "3")], 25, 2)], ENTRIES)), 0, 10, b"k").collect()}
    assert set(tags) == {0, 2} and tags[0] == other[0] and tags[2] != other[2]


def test_seals_are_verified(spark):
    df = spark.createDataFrame([entry([("A", str(k))], 5 + 10 * k, k + 1) for k in range(4)], ENTRIES)
    tags = lifecycle.sealed(df, 0, 10, b"k").where("epoch <> 3")
    now = df.where("seqnum < 4 and seqnum <> 1").unionByName(spark.createDataFrame([entry([("A", "x")], 6, 1), entry([("A", "9")], 35, 9)], ENTRIES))
    got = {r.epoch: r.status for r in lifecycle.verify_seals(now.where("seqnum <> 3"), tags, 0, 10, b"k").collect()}
    assert got == {0: "changed", 1: "ok", 2: "lost", 3: "unsealed"}


def test_rotation_by_all_limits(spark):
    """Against a plain walk along each chain."""
    rng = random.Random(3)
    data = [(c, k, rng.randrange(1, 40), k * 10 + rng.randrange(10)) for c in "abc" for k in range(80)]
    df = spark.createDataFrame(data, "chain string, i long, size long, t long").repartition(3)
    limits = lifecycle.Rotation(entries=9, size=150, duration_usec=70)
    want = {}
    for c in "abc":
        no, file = 0, []
        for _, i, size, t in sorted(x for x in data if x[0] == c):
            if file and (len(file) >= 9 or sum(s for s, _ in file) + size > 150 or t - file[0][1] >= 70):
                no, file = no + 1, []
            file.append((size, t))
            want[c, i] = no
    assert {(r.chain, r.i): r.file_no for r in lifecycle.rotated(df, "chain", ["i"], limits, size="size", time="t").collect()} == want


def test_sizes_as_text():
    from emberlog.functions.timeparse import human_binary_size, human_size

    assert [human_size(n) for n in (12, 1024, 1536, 1024**2 + 100 * 1024, 5 * 1024**3 - 1)] == ["12B", "1K", "1.5K", "1M", "4.9G"]
    assert [human_binary_size(n) for n in (12, 1024, 1536, 1024**3 + 1024**2 * 13, 1024**5)] == ["12B", "1KiB", "1.5KiB", "1.01GiB", "1024TiB"]


def test_sampling_keeps_the_total(spark):
    df = rows(spark, *[(k * 1000, "a", "3") for k in range(5000)])
    b = Buckets.explorer(0, 5_000_000)
    marked = sampling.marked(df, S, b, budget=1000, limit=10)
    got = sampling.sampled_histogram(marked, S, "SERVICE", b)
    assert got.agg(F.sum("n")).first()[0] == 5000
    assert 0 < marked.where("sampled").count() < 5000
    assert sampling.shares(got).first().matched == 5000
    assert not sampling.wanted(10, 0, 1, True, False)


def test_request_round_trip(spark):
    base = 1_700_000_000_000_000
    df = rows(spark, *[(base + k * 1_000_000, "even" if k % 2 == 0 else "odd", "6") for k in range(20)])
    raw = {"after": 1_700_000_000, "before": 1_700_000_100, "last": 5, "facets": ["SERVICE"], "histogram": "PRIORITY", "selections": {"PRIORITY": ["info"]}}
    out = request.respond(df, S, raw, columns=["service", "priority"], now=1_800_000_000)
    assert out["status"] == 200 and len(out["data"]) == 5 and out["items"]["matched"] == 20 and out["items"]["after"] == 15
    assert {(f["value"], f["n"]) for f in out["facets"]} == {("even", 10), ("odd", 10)}
    assert sum(p["n"] for p in out["histogram"]["points"]) == 20
    page2 = request.respond(df, S, raw | {"anchor": out["data"][-1][0], "data_only": True}, columns=["service"], now=1_800_000_000)
    assert page2["data"][0][0] == out["data"][-1][0] - 1_000_000 and "facets" not in page2
    assert request.respond(df, S, raw | {"if_modified_since": base + 10**9}, columns=[], now=1_800_000_000)["status"] == 304
    info = request.respond(df, S, {"info": True}, columns=[])
    assert info["status"] == 200 and "sampling" in info["accepted_params"] and info["pagination"]["key"] == "anchor"


def raw_request(**more):
    return {"after": 1_700_000_000, "before": 1_700_000_100, "last": 5, "facets": ["SERVICE"], "histogram": "SERVICE"} | more


def journal(spark, n=5_000, step=1_000):
    base = 1_700_000_000_000_000
    return rows(spark, *[(base + k * step, "even" if k % 2 == 0 else "odd", "6") for k in range(n)])


def test_keys_of_data_only_and_delta(spark):
    df = journal(spark, 10)
    parts = ("facets", "histogram", "items")
    for more, want in (({}, parts), ({"delta": True}, parts), ({"data_only": True, "delta": True}, [f"{p}_delta" for p in parts]), ({"data_only": True}, [])):
        out = request.respond(df, S, raw_request(**more), now=1_800_000_000)
        assert [k for p in parts for k in (p, f"{p}_delta") if k in out] == list(want)
        assert ("last_modified" in out) == ("data_only" not in more)
    assert set(out["columns"]) >= {"timestamp", "rowOptions", "SERVICE", "PRIORITY"} and out["columns"]["SERVICE"]["filter"] == "facet"


def test_sampled_request(spark):
    out = request.respond(journal(spark), S, raw_request(sampling=20), now=1_800_000_000)
    block, items = out["_sampling"], out["items"]
    assert block["sampled"] > 0 and block["unsampled"] > 0 and block["sampled"] + block["unsampled"] == items["evaluated"] == 5_000
    assert out["message"]["status"] == "notice" and "unsampled" in out["message"]["title"]
    bars = {}
    for p in out["histogram"]["points"]:
        bars[p["value"]] = bars.get(p["value"], 0) + p["n"]
    assert bars["[unsampled]"] == block["unsampled"] and sum(bars.values()) == 5_000
    assert "_sampling" not in request.respond(journal(spark, 50), S, raw_request(sampling=20, data_only=True), now=1_800_000_000)


def test_progress_cancel_and_timeout(spark):
    df, seen = journal(spark, 10), []
    assert request.respond(df, S, raw_request(), now=1_800_000_000, progress=seen.append)["message"] == "OK" and len(seen) > 3
    out = request.respond(df, S, raw_request(), now=1_800_000_000, progress=seen.clear, cancelled=lambda: True)
    assert out == {"status": 499, "errorMessage": "Request cancelled."}
    late = request.respond(df, S, raw_request(), now=1_800_000_000, timeout=0)
    assert late["status"] == 200 and late["partial"] and late["message"] == {"title": "Query timed-out, incomplete data. ", "status": "warning"}


def test_requested_sources(spark):
    names = ["/var/log/journal/m/system.journal", "/var/log/journal/remote/remote-host1.journal", "/var/log/journal/m/user-1000@x.journal"]
    df = spark.createDataFrame([(1_700_000_000_000_000 + k, f) for k, f in enumerate(names)], "rt long, f string")
    s = LogSchema(F.col("rt"), {"F": F.col("f")}, file=F.col("f"))

    def files(*wanted):
        out = request.respond(df, s, raw_request(facets=["F"], histogram="F", selections={"__logs_sources": list(wanted)}), columns=["F"], now=1_800_000_000)
        return sorted(names.index(r[2]) for r in out["data"])

    assert files() == [0, 1, 2] == files("all") and files("all-remote-systems") == [1] and files("all-local-logs") == [0, 2]
    assert files("host1") == [1] and files("all-local-system-logs", "1000") == [0, 2]
