"""Queries over canonical entries made of events: repeated and binary fields, command lines, renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions import display
from emberlog.operators import boots, facets, formats, histogram, lifecycle, listing, paging
from emberlog.plans import cli
from emberlog.plans.explore import LogQuery, explore, explore_by_pass
from emberlog.plans.queries import AFTER, BEFORE, BUCKETS, DAY, bucket_sql, events
from emberlog.plans.reader import Reader
from emberlog.registry import register
from emberlog.schema import entries_schema, micros, narrow, wide
from emberlog.sources import catalog


def md5(c: Column) -> Column:
    return F.md5(c.cast("string").cast("binary"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an entry: TAG is there twice, MESSAGE is no text on every fifth, BLOB on none that has it."""
    i, user = F.col("event_id"), F.col("user_id")
    values = [
        ("MESSAGE", F.when(i % 5 == 0, F.unhex(F.lit("FFFE"))).otherwise(F.concat("event_type", F.lit(" "), "props").cast("binary"))),
        ("PRIORITY", (i % 8).cast("string").cast("binary")),
        ("SYSLOG_FACILITY", (i % 24).cast("string").cast("binary")),
        ("SYSLOG_IDENTIFIER", F.when(i % 3 != 0, F.col("event_type").cast("binary"))),
        ("_PID", user.cast("string").cast("binary")),
        ("_SYSTEMD_UNIT", F.concat(F.lit("u"), user % 5, F.lit(".service")).cast("binary")),
        ("_UID", (user % 2).cast("string").cast("binary")),
        ("_SYSTEMD_USER_UNIT", F.concat(F.lit("v"), user % 5, F.lit(".service")).cast("binary")),
        ("_SYSTEMD_INVOCATION_ID", md5(user).cast("binary")),
        ("_TRANSPORT", F.when(i % 9 == 0, F.lit("kernel").cast("binary"))),
        ("TAG", F.concat(F.lit("a"), i % 3).cast("binary")),
        ("TAG", F.concat(F.lit("b"), i % 2).cast("binary")),
        ("BLOB", F.when(i % 4 == 0, F.unhex(F.lit("FFFE41")))),
    ]
    fields = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(n).alias("name"), v.alias("value"))) for n, v in values]))
    return events(spark, sf_dir).select(
        F.concat(F.lit("/logs/file"), user % 3).alias("source_file"), md5(F.lit("machine")).alias("machine_id"), md5(F.floor(i / 100)).alias("boot_id"), md5(F.lit("sequence")).alias("seqnum_id"), (i + 1).alias("seqnum"),
        micros("ts").alias("realtime_usec"), (i * 10).alias("monotonic_usec"), F.lpad(F.lower(F.hex(i)), 16, "0").alias("xor_hash"), fields.alias("fields"),
    )


#: The same in SQL: a column for each field; message_ok where MESSAGE is text.
EN = r"""
en as (
  select event_id, event_id + 1 as seqnum, epoch_us(ts) as rt, event_id * 10 as mono, md5((event_id // 100)::varchar) as boot, md5('sequence') as sequence, lpad(printf('%x', event_id), 16, '0') as xor_,
    event_id % 5 <> 0 as message_ok, event_type || ' ' || props as message, event_id % 8 as priority, event_id % 24 as facility,
    case when event_id % 3 <> 0 then event_type end as identifier, user_id, user_id % 5 as unit, user_id % 2 as uid, md5(user_id::varchar) as invocation,
    case when event_id % 9 = 0 then 'kernel' end as transport, 'a' || (event_id % 3) as tag1, 'b' || (event_id % 2) as tag2, event_id % 4 = 0 as blob, user_id % 3 as file
  from events
), cur as (
  select *, 's=' || sequence || ';i=' || printf('%x', seqnum) || ';b=' || boot || ';m=' || printf('%x', mono) || ';t=' || printf('%x', rt) || ';x=' || xor_ as cursor from en
)
"""


# Command lines: each gives the sequence numbers of its rows.


def command(name: str, argv: list[str], where: str, tail: str = "") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, _ = cli.select(entries(spark, sf_dir), argv)
        return rows.select("seqnum")

    run.__name__ = name
    register(name, f"with {EN} select seqnum from cur where {where} {tail}")(run)


command("cli_match", ["TAG=a1", "TAG=b0", "PRIORITY=3"], "(tag1 = 'a1' or tag2 = 'b0') and priority = 3")
command("cli_disjunction", ["TAG=a1", "PRIORITY=3", "+", "_PID=7"], "(tag1 = 'a1' and priority = 3) or user_id = 7")
command("cli_priority", ["-p", "warning"], "priority <= 4")
command("cli_priority_range", ["-p", "info..err"], "priority between 3 and 6")
command("cli_facility", ["--facility", "kern,auth,3,local1"], "facility in (0, 3, 4, 17)")
command("cli_identifier", ["-t", "click", "-t", "view"], "identifier in ('click', 'view')")
command("cli_exclude_identifier", ["-T", "click"], "identifier is null or identifier <> 'click'")
command("cli_unit", ["-u", "u1"], "unit = 1")
command("cli_unit_glob", ["-u", "u[12]*"], "unit in (1, 2)")
command("cli_user_unit", ["--user-unit", "v3.service", "--uid", "1"], "unit = 3 and uid = 1")
command("cli_invocation", ["--invocation", "c4ca4238a0b923820dcc509a6f75849b"], "invocation = md5('1')")
LISTED = "(select user_id, row_number() over (order by min(rt), invocation) as a, count(*) over () as n from en group by user_id, invocation)"
command("cli_invocation_first", ["--invocation", "1"], f"user_id = (select user_id from {LISTED} where a = 1)")
command("cli_invocation_last", ["-I"], f"user_id = (select user_id from {LISTED} where a = n)")
command("cli_dmesg", ["-k", "-m"], "transport = 'kernel'")
command("cli_since_until", ["-S", f"@{AFTER // 10**6}", "-U", f"@{BEFORE // 10**6}"], f"rt between {AFTER} and {BEFORE}")
command("cli_grep", ["-g", "CLICK.*k\": 3"], "message_ok and regexp_matches(message, 'CLICK.*k\": 3')")
command("cli_grep_smartcase", ["-g", "click.*k\": 3"], "message_ok and regexp_matches(message, '(?i)click.*k\": 3')")
command("cli_boot", ["-b", "2"], "event_id // 100 = 1")
command("cli_boot_back", ["-b", "-1"], "event_id // 100 = (select max(event_id // 100) - 1 from events)")
command("cli_lines", ["-n", "30", "-p", "3"], "priority <= 3", "order by rt desc, seqnum desc limit 30")
command("cli_after_cursor", ["--after-cursor", f"t={AFTER:x}"], f"rt > {AFTER}")
command("cli_cursor_seqnum", ["-c", "s=aa;i=10"], "true")


# Renderings.


def rendered(name: str, mode: str, line: str, *more: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, options = cli.select(entries(spark, sf_dir).where("seqnum % 7 = 0"), ["-o", mode, *more])
        lines = cli.render(rows, options)
        return lines.select(F.hex("line").alias("line")) if mode == "export" else lines

    run.__name__ = name
    register(name, f"with {EN} select {line} as line from cur where seqnum % 7 = 0")(run)


LABEL = "coalesce(identifier, 'unknown') || '[' || user_id || ']: ' || case when message_ok then message else '[2B blob data]' end"
MEMBERS = """'"__CURSOR"@"' || cursor || '"~"__REALTIME_TIMESTAMP"@"' || rt || '"~"__MONOTONIC_TIMESTAMP"@"' || mono || '"~"_BOOT_ID"@"' || boot || '"'"""
QUOTED = """case when message_ok then '"' || replace(message, '"', '\\"') || '"' else '[255,254]' end"""
FIELDS = f"""case when blob then '~"BLOB"@[255,254,65]' else '' end || '~"MESSAGE"@' || {QUOTED} || '~"PRIORITY"@"' || priority || '"~"SYSLOG_FACILITY"@"' || facility || '"' || coalesce('~"SYSLOG_IDENTIFIER"@"' || identifier || '"', '')
 || '~"TAG"@["' || tag1 || '","' || tag2 || '"]~"_PID"@"' || user_id || '"~"_SYSTEMD_INVOCATION_ID"@"' || invocation || '"~"_SYSTEMD_UNIT"@"u' || unit || '.service"~"_SYSTEMD_USER_UNIT"@"v' || unit || '.service"' || coalesce('~"_TRANSPORT"@"' || transport || '"', '') || '~"_UID"@"' || uid || '"'"""


def members(separator: str, colon: str) -> str:
    return f"replace(replace({MEMBERS} || {FIELDS}, '~', {separator}), '@', {colon})"


rendered("out_json", "json", f"'{{' || {members(repr(','), repr(':'))} || '}}' || chr(10)")
rendered("out_json_sse", "json-sse", f"'data: {{' || {members(repr(','), repr(':'))} || '}}' || chr(10) || chr(10)")
rendered("out_json_seq", "json-seq", f"chr(30) || '{{' || {members(repr(','), repr(':'))} || '}}' || chr(10)")
SPREAD = members("',' || chr(10) || chr(9)", "' : '")
for _list in ("[255,254,65]", "[255,254]"):
    SPREAD = f"replace({SPREAD}, '{_list}', '[' || chr(10) || chr(9) || chr(9) || replace('{_list[1:-1]}', ',', ',' || chr(10) || chr(9) || chr(9)) || chr(10) || chr(9) || ']')"
SPREAD = f"""replace({SPREAD}, '["' || tag1 || '","' || tag2 || '"]', '[' || chr(10) || chr(9) || chr(9) || '"' || tag1 || '",' || chr(10) || chr(9) || chr(9) || '"' || tag2 || '"' || chr(10) || chr(9) || ']')"""
rendered("out_json_pretty", "json-pretty", f"'{{' || chr(10) || chr(9) || {SPREAD} || chr(10) || '}}' || chr(10)")
rendered("out_cat", "cat", "case when message_ok then message else chr(65533) || chr(65533) end")
rendered("out_cat_fields", "cat", "tag1 || chr(10) || tag2 || chr(10) || priority", "--output-fields", "TAG,PRIORITY")
#: Only the label: short lines begin with the time and, at a new boot, with a separator.
rendered("out_short_unix", "short-unix", f"case when seqnum <> 7 and boot <> md5(((event_id - 7) // 100)::varchar) then '-- Boot ' || boot || ' --' || chr(10) else '' end || rt // 1000000 || '.' || lpad((rt % 1000000)::varchar, 6, '0') || ' ' || {LABEL}", "--no-hostname")
VERBOSE = """strftime(make_timestamp(rt), '%a %Y-%m-%d %H:%M:%S UTC') || ' [' || cursor || ']' || case when blob then chr(10) || '    BLOB=[3B blob data]' else '' end || chr(10) || '    MESSAGE=' || case when message_ok then message else '[2B blob data]' end || chr(10) || '    PRIORITY=' || priority || chr(10) || '    SYSLOG_FACILITY=' || facility || coalesce(chr(10) || '    SYSLOG_IDENTIFIER=' || identifier, '') || chr(10) || '    TAG=' || tag1 || chr(10) || '    TAG=' || tag2"""
VERBOSE += """ || chr(10) || '    _PID=' || user_id || chr(10) || '    _SYSTEMD_INVOCATION_ID=' || invocation || chr(10) || '    _SYSTEMD_UNIT=u' || unit || '.service' || chr(10) || '    _SYSTEMD_USER_UNIT=v' || unit || '.service' || coalesce(chr(10) || '    _TRANSPORT=' || transport, '') || chr(10) || '    _UID=' || uid"""
rendered("out_verbose", "verbose", VERBOSE)


def hexed(text: str) -> str:
    return f"hex(encode({text}))"


NL = "|| chr(10)"
EXPORT = hexed(f"'__CURSOR=' || cursor {NL} || '__REALTIME_TIMESTAMP=' || rt {NL} || '__MONOTONIC_TIMESTAMP=' || mono {NL} || '_BOOT_ID=' || boot {NL}")
EXPORT += " || case when blob then " + hexed("'BLOB' || chr(10)") + " || '0300000000000000FFFE410A' else '' end"
EXPORT += " || case when message_ok then " + hexed(f"'MESSAGE=' || message {NL}") + " else " + hexed("'MESSAGE' || chr(10)") + " || '0200000000000000FFFE0A' end || "
EXPORT += hexed(f"'PRIORITY=' || priority {NL} || 'SYSLOG_FACILITY=' || facility {NL} || coalesce('SYSLOG_IDENTIFIER=' || identifier {NL}, '') || 'TAG=' || tag1 {NL} || 'TAG=' || tag2 {NL} || '_PID=' || user_id {NL} || '_SYSTEMD_INVOCATION_ID=' || invocation {NL} || '_SYSTEMD_UNIT=u' || unit || '.service' {NL} || '_SYSTEMD_USER_UNIT=v' || unit || '.service' {NL} || coalesce('_TRANSPORT=' || transport {NL}, '') || '_UID=' || uid {NL} {NL}")
rendered("out_export", "export", EXPORT)


# Fields, facets and histograms of repeated and binary values.


@register("entry_facets", f"with {EN} select 'TAG' as field, value, count(*) as n from (select unnest([tag1, tag2]) as value from en) group by 2 union all select 'BLOB', case when blob then chr(65533) || chr(65533) || 'A' else '-' end, count(*) from en group by 2")
def entry_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.facets(entries(spark, sf_dir), entries_schema(), ["TAG", "BLOB"], all_values=True)


@register("entry_facets_excl", f"with {EN} select 'TAG' as field, tag1 as value, count(*) as n from en where priority in (1, 2) group by 2 union all select 'PRIORITY', priority::varchar, count(*) from en where tag1 = 'a1' or tag2 = 'b1' group by 2")
def entry_facets_excl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First values are counted; any value of a repeated field meets a filter."""
    return facets.facets(entries(spark, sf_dir), entries_schema(), ["TAG", "PRIORITY"], selected={"TAG": ["a1", "b1"], "PRIORITY": ["1", "2"]})


@register("facets_by_pass", f"with {EN} select 'TAG' as field, tag1 as value, count(*) as n from en where priority in (1, 2) and rt between {AFTER} and {BEFORE} group by 2 union all select 'PRIORITY', priority::varchar, count(*) from en where (tag1 = 'a1' or tag2 = 'b1') and rt between {AFTER} and {BEFORE} group by 2")
def facets_by_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = LogQuery(AFTER, BEFORE, {"TAG": ["a1", "b1"], "PRIORITY": ["1", "2"]}, facets=("TAG", "PRIORITY"))
    return explore_by_pass(entries(spark, sf_dir), entries_schema(), query)


@register("facets_with_empty", f"with {EN}, c as (select 'TAG' as field, tag1 as value, count(*) as n from en where priority = 9 group by 2) select f.field, value, coalesce(n, 0) as n from (select unnest(['TAG', 'NONE']) as field) f left join c using (field)")
def facets_with_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = facets.facets(entries(spark, sf_dir), entries_schema(), ["TAG"], selected={"PRIORITY": ["9"]})
    return facets.with_empty(none, ["TAG", "NONE"])


@register("entry_field_names", f"with {EN} select distinct unnest(['MESSAGE', 'PRIORITY', 'SYSLOG_FACILITY', 'SYSLOG_IDENTIFIER', '_PID', '_SYSTEMD_UNIT', '_UID', '_SYSTEMD_USER_UNIT', '_SYSTEMD_INVOCATION_ID', '_TRANSPORT', 'TAG', 'BLOB']) as field from en")
def entry_field_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.field_names(entries(spark, sf_dir), entries_schema())


@register("entry_unique_values", f"with {EN} select distinct unnest([tag1, tag2]) as value from en")
def entry_unique_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Reader(entries(spark, sf_dir)).unique("TAG")


@register("entry_wide", f"with {EN} select seqnum, priority::varchar as PRIORITY, identifier as SYSLOG_IDENTIFIER, 'FFFE41' as blob_hex, 2 as tags from en where blob")
def entry_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wide(entries(spark, sf_dir), ["PRIORITY", "SYSLOG_IDENTIFIER"], as_bytes=True).where(F.col("rest")["BLOB"].isNotNull())
    return found.select("seqnum", "PRIORITY", "SYSLOG_IDENTIFIER", F.hex(F.col("rest")["BLOB"][0]).alias("blob_hex"), F.size(F.col("rest")["TAG"]).alias("tags"))


@register("raw_payloads", "select event_id, 'A' as name, hex(encode(event_type || '=' || user_id)) as value from events union all select event_id, 'BIN', 'FF3D00' from events where event_id % 2 = 0")
def raw_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads are cut at the first =; one without a key or without = is none."""
    text = F.concat(F.lit("A="), "event_type", F.lit("="), "user_id").cast("binary")
    raw = F.array(text, F.when(F.col("event_id") % 2 == 0, F.unhex(F.lit("42494E3DFF3D00"))), F.lit("=x").cast("binary"), F.lit("none").cast("binary"))
    rows = events(spark, sf_dir).select("event_id", F.explode(listing.from_payloads(F.array_compact(raw))).alias("f"))
    return rows.select("event_id", F.col("f.name").alias("name"), F.hex("f.value").alias("value"))


@register("catalogue_changes", "select user_id::varchar as path, case when user_id % 4 = 0 then 'created' when user_id % 4 = 1 then 'deleted' else 'grown' end as event from events where user_id % 4 < 3 group by all")
def catalogue_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("size_bytes")).select(F.col("user_id").cast("string").alias("path"), "size_bytes", F.col("user_id") % 4)
    kind = files.columns[2]
    before = files.where(F.col(kind) != 0).withColumn("size_bytes", F.when(F.col(kind) == 2, F.col("size_bytes") - 1).otherwise(F.col("size_bytes")))
    return catalog.changes(before, files.where(F.col(kind) != 1))


@register("entry_narrow", "select event_id, 'event_type=' || event_type || case when user_id > 5 then ',user=' || user_id else '' end as fields from events")
def entry_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = narrow(events(spark, sf_dir).withColumn("user", F.when(F.col("user_id") > 5, F.col("user_id"))), ["event_type", "user"], ["event_id"])
    return rows.select("event_id", F.array_join(F.transform("fields", lambda f: F.concat(f["name"], F.lit("="), f["value"].cast("string"))), ",").alias("fields"))


@register("entry_projected", f"with {EN} select rt as timestamp, tag2 as TAG, identifier as SYSLOG_IDENTIFIER from en")
def entry_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.projected(entries(spark, sf_dir), entries_schema(), ["TAG", "SYSLOG_IDENTIFIER"])


@register("entry_histogram", f"with {EN}, c as (select {bucket_sql(BUCKETS, 'rt')} as bucket_start, tag1 as value, count(*) as n from en where rt between {AFTER} and {BEFORE} group by 1, 2), spine as (select {BUCKETS.start} + i * {BUCKETS.width} as bucket_start, value from (select unnest(generate_series(0, {BUCKETS.count - 1})) as i), (select distinct value from c)) select bucket_start, value, coalesce(n, 0) as n from spine left join c using (bucket_start, value)")
def entry_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore(entries(spark, sf_dir), entries_schema(), LogQuery(AFTER, BEFORE, histogram="TAG")).histogram


@register("histogram_merged", f"with {EN}, c as (select {bucket_sql(BUCKETS, 'rt')} as bucket_start, tag1 as value, count(*) as n from en where rt between {AFTER} and {BEFORE} group by 1, 2), spine as (select {BUCKETS.start} + i * {BUCKETS.width} as bucket_start, value from (select unnest(generate_series(0, {BUCKETS.count - 1})) as i), (select distinct value from c)) select bucket_start, value, coalesce(n, 0) as n from spine left join c using (bucket_start, value)")
def histogram_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of each file added up."""
    df, parts = entries(spark, sf_dir), []
    for k in range(3):
        own = df.where(F.col("source_file") == f"/logs/file{k}")
        parts.append((BUCKETS, explore(own, entries_schema(), LogQuery(AFTER, BEFORE, histogram="TAG")).histogram))
    return histogram.merged(parts)[1]


@register("explore_stats", f"with {EN} select count(*) as examined, count(*) filter (rt <= {BEFORE} and priority = 3) as matched, null::bigint as largest_delta, max(rt) as last_realtime from en where rt >= {AFTER} and rt <= {BEFORE + 120_000_000}")
def explore_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore(entries(spark, sf_dir), entries_schema(), LogQuery(AFTER, BEFORE, {"PRIORITY": ["3"]})).stats


@register("explore_rows", f"with {EN} select seqnum from (select *, rank() over (order by rt desc) as r from en where rt between {AFTER} and {BEFORE} and priority = 3 and message_ok and regexp_matches(message, '(?i)click')) where r <= 50")
def explore_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore(entries(spark, sf_dir), entries_schema(), LogQuery(AFTER, BEFORE, {"PRIORITY": ["3"]}, limit=50).with_term("click ")).rows.select("seqnum")


@register("entry_page_forward", f"with {EN} select seqnum from (select *, row_number() over (order by rt, seqnum) as r from en where rt > {AFTER + DAY}) where r <= 60")
def entry_page_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.page(entries(spark, sf_dir), "realtime_usec", 60, backward=False, anchor=paging.Anchor("realtime", AFTER + DAY), ties=["seqnum"], stored=entries_schema().stored).select("seqnum")


@register("entry_boots", f"with {EN}, b as (select boot as boot_id, min(rt) as first_usec, max(rt) as last_usec, count(*) as entries from en group by 1) select boot_id, first_usec, last_usec, entries, (row_number() over (order by last_usec, first_usec, boot_id) - count(*) over ())::bigint as index from b")
def entry_boots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Reader(entries(spark, sf_dir)).boots()


@register("boot_first_times", f"with {EN} select boot as boot_id, min(rt) as first_usec from en group by 1")
def boot_first_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boots.first_times(entries(spark, sf_dir), F.col("boot_id"), F.col("realtime_usec"))


@register("boot_shown", f"with {EN}, b as (select boot, min(rt) as f from en group by 1) select seqnum, boot || ' (' || strftime(make_timestamp(f), '%Y-%m-%dT%H:%M:%S.%f') || 'Z)  ' as shown from en join b using (boot)")
def boot_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir)
    times = boots.first_times(rows, F.col("boot_id"), F.col("realtime_usec"))
    return rows.join(times, "boot_id").select("seqnum", display.boot(F.col("boot_id"), F.col("first_usec")).alias("shown"))


@register("entry_digest", f"with {EN} select count(*) as entries, sum(10 + blob::int + (identifier is not null)::int + (transport is not null)::int)::bigint as payloads, (count(*) filter (not message_ok) + count(*) filter (blob))::bigint as binary_values, count(*)::bigint as repeated_names from en")
def entry_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.corpus_digest(entries(spark, sf_dir)).select("entries", "payloads", "binary_values", "repeated_names")


@register("error_numbers", "select event_id, case event_id % 4 when 1 then '1 (EPERM)' when 2 then '2 (ENOENT)' when 3 then '13 (EACCES)' else '0' end as shown from events")
def error_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("event_id") % 4 == 3, "13").otherwise((F.col("event_id") % 4).cast("string"))
    return events(spark, sf_dir).select("event_id", display.error_number(code).alias("shown"))


@register("message_ids", "select event_id, case event_id % 3 when 0 then 'fc2e22bc6ee647b6b90729ab34a250b1 (Coredump)' when 1 then '8d45620c1a4348dbb17410da57c60c66 (User Session created)' else event_type end as shown from events")
def message_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("event_id") % 3 == 0, "fc2e22bc6ee647b6b90729ab34a250b1").when(F.col("event_id") % 3 == 1, "8d45620c1a4348dbb17410da57c60c66").otherwise(F.col("event_type"))
    return events(spark, sf_dir).select("event_id", display.message_id(code).alias("shown"))


@register("severity", "select event_id, case when event_id % 9 <= 3 then 'critical' when event_id % 9 = 4 then 'warning' when event_id % 9 = 5 then 'notice' when event_id % 9 = 7 then 'debug' else 'normal' end as severity from events")
def severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every priority, and one that is no number."""
    p = F.when(F.col("event_id") % 9 < 8, (F.col("event_id") % 9).cast("string")).otherwise("none")
    return events(spark, sf_dir).select("event_id", display.severity(p).alias("severity"))


@register("user_names", "select event_id, coalesce(n_name, (user_id % 30)::varchar) as shown from events left join nation on user_id % 30 = n_nationkey")
def user_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    rows = events(spark, sf_dir).select("event_id", (F.col("user_id") % 30).cast("string").alias("shown"))
    return display.with_user_names(rows, "shown", users)


@register("mapped_monotonic", "select event_id, greatest(0, event_id * 10 - (event_id * 7) % 100) as mono from events")
def mapped_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, commit = F.col("event_id"), micros("ts")
    return events(spark, sf_dir).select("event_id", display.mapped_monotonic(i * 10, commit - (i * 7) % 100, commit).alias("mono"))


@register("sort_keys", "select event_id, lower(event_type) as key from events")
def sort_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.when(F.col("event_id") % 2 == 0, F.lit("_.-")).otherwise(F.lit(""))
    return events(spark, sf_dir).select("event_id", display.sort_key(F.concat(marks, F.upper("event_type"))).alias("key"))


@register("ellipsis", "select doc_id, case when length(text) > 80 then left(text, 79) || '…' else text end as shown from documents")
def ellipsis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", formats.ellipsis(F.col("text")).alias("shown"))


@register("source_times", "select event_id, case when event_id % 2 = 0 then '_SOURCE_REALTIME_TIMESTAMP=' || epoch_us(ts) || ',' else '' end || 'A=' || event_type as fields from events")
def source_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal fields are kept once, the source time is put in front."""
    own = F.struct(F.lit("A").alias("name"), F.col("event_type").cast("binary").alias("value"))
    usec = F.when(F.col("event_id") % 2 == 0, micros("ts"))
    fields = lifecycle.with_source_time(lifecycle.distinct_fields(F.array(own, own)), usec)
    return events(spark, sf_dir).select("event_id", F.array_join(F.transform(fields, lambda f: F.concat(f["name"], F.lit("="), f["value"].cast("string"))), ",").alias("fields"))
