"""Every SQL-expressible operator as a query over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions import display
from emberlog.functions import predicates as P
from emberlog.operators import boots, facets, formats, histogram, lifecycle, listing, paging
from emberlog.registry import register
from emberlog.schema import LogSchema, Stored, micros

DAY = 86_400_000_000
AFTER, BEFORE = 1_704_067_200_000_000 + 5 * DAY, 1_704_067_200_000_000 + 20 * DAY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Fields of events that are stored columns.
STORED = {"event_type": "string", "user_id": "long"}


def events_schema() -> LogSchema:
    """Events as entries: the source time is some whole seconds before the commit; field k is absent on every seventh."""
    k = F.when(F.col("event_id") % 7 != 0, F.get_json_object("props", "$.k"))
    late = F.pmod(F.floor("value").cast("long"), F.lit(300)) * F.lit(1_000_000)
    fields = {"event_type": F.col("event_type"), "user_id": F.col("user_id"), "k": k}
    return LogSchema(micros("ts"), fields, micros("ts") - late, F.pmod("user_id", F.lit(5)).cast("string"), (F.col("event_id"),), types=STORED, stored=Stored(F.col("ts"), "timestamp_ntz"))


#: The same columns in SQL.
EV = r"""
ev as (
  select *, epoch_us(ts) as rt, case when event_id % 7 <> 0 then regexp_extract(props, '"k": *([0-9]+)', 1) end as k,
    epoch_us(ts) - (((floor(value)::bigint % 300) + 300) % 300) * 1000000 as src
  from events
), e as (
  select *, case when src <> 0 and src < rt then src else rt end as eff from ev
)
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


# Matches.


@register("match_or_and", f"with {EV} select event_id, event_type, user_id from e where event_type in ('click', 'purchase') and k in ('3', '5', '7')")
def match_or_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.Matches()
    names = LogSchema(micros("ts"), {"EVENT_TYPE": F.col("event_type"), "K": events_schema().fields["k"]}, types={"EVENT_TYPE": "string"})
    for payload in ("EVENT_TYPE=click", "EVENT_TYPE=purchase", "K=3", "K=5", "K=7"):
        m.add(payload)
    return events(spark, sf_dir).where(m.condition(names)).select("event_id", "event_type", "user_id")


@register("match_disjunction", f"with {EV} select event_id, event_type from e where ((event_type = 'click' and k = '3') or user_id = 7) and k is not null")
def match_disjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events_schema()
    names = LogSchema(own.realtime, {"EVENT_TYPE": F.col("event_type"), "USER": F.col("user_id"), "K": own.fields["k"]}, types={"EVENT_TYPE": "string", "USER": "long"})
    m = P.Matches().add("EVENT_TYPE=click").add("K=3").disjunction().add("USER=7")
    return events(spark, sf_dir).where(m.condition(names) & P.Filter.exists("K").condition(names)).select("event_id", "event_type")


@register("match_empty_filter", f"with {EV} select event_type, count(*) as n from e where k = '4' group by event_type")
def match_empty_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = P.filters(events_schema(), {"event_type": [], "k": ["4"]})
    return events(spark, sf_dir).where(P.all_of(tests.values())).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@register("index_filter", f"with {EV} select event_id from e where k is not null and (event_type = 'view' or user_id = 3)")
def index_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = P.Filter.all(P.Filter.exists("k"), None, P.Filter.any(P.Filter.pair("event_type", "view"), P.Filter.pair("user_id", "3")))
    return events(spark, sf_dir).where(wanted.condition(events_schema())).select("event_id")


# Time.


@register("time_window", f"with {EV} select event_id, eff from e where eff between {AFTER} and {BEFORE} and rt >= {AFTER} and rt <= {BEFORE + P.SLACK_USEC}")
def time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events_schema()
    return events(spark, sf_dir).where(P.window(s, AFTER, BEFORE)).select("event_id", s.effective().alias("eff"))


@register("effective_time", f"with {EV} select event_id, rt, eff, rt - src as late from e")
def effective_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events_schema()
    return events(spark, sf_dir).select("event_id", s.realtime.alias("rt"), s.effective().alias("eff"), (s.realtime - s.source_time).alias("late"))


@register("commit_guard", f"with {EV} select count(*) as examined, count(*) filter (eff between {AFTER} and {BEFORE}) as matched, max(rt - src) as largest_delta, max(rt) as last_realtime from e where rt >= {AFTER} and rt <= {BEFORE + P.SLACK_USEC}")
def commit_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events_schema()
    rows = events(spark, sf_dir).where(P.commit_guard(s, AFTER, BEFORE))
    return rows.agg(F.count(F.lit(1)).alias("examined"), F.count_if(P.within(s.effective(), AFTER, BEFORE)).alias("matched"), F.max(s.realtime - s.source_time).alias("largest_delta"), F.max(s.realtime).alias("last_realtime"))


@register("half_open_window", f"with {EV} select event_id from e where eff >= {AFTER} and eff < {BEFORE}")
def half_open_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where(P.effective_within(events_schema(), AFTER, BEFORE, half=True)).select("event_id")


# Text.


def document_schema() -> LogSchema:
    return LogSchema(F.col("doc_id"), {"TEXT": F.col("text"), "LANG": F.col("lang"), "SOURCE": F.col("source")})


@register(
    "fts_or_not",
    """
with v as (
  select doc_id, [text, lang, source] as vs from documents
), s as (
  select doc_id, list_transform(vs, lambda x: case when regexp_matches(x, 'thandon', 'is') then 1 when regexp_matches(x, 'idiot', 'is') then -1 when regexp_matches(x, 'tion', 'is') then 1 when regexp_matches(x, '^src1$', 'is') then -1 else 0 end) as signs from v
)
select doc_id from s where not list_contains(signs, -1) and list_contains(signs, 1)
""".replace("when regexp_matches(x, '^src1$', 'is') then -1 ", ""),
)
def fts_or_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(P.full_text(document_schema(), P.parse_terms("thandon|!idiot|tion"))).select("doc_id")


@register("fts_wildcard_parts", "select doc_id from documents where regexp_matches(text, 'the.*license.*version', 'is') or regexp_matches(lang, 'the.*license.*version', 'is') or regexp_matches(source, 'the.*license.*version', 'is')")
def fts_wildcard_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(P.full_text(document_schema(), P.parse_terms("the*license*version"))).select("doc_id")


@register("grep_smartcase", "select conv_id, turn, regexp_matches(text, 'The') as exact from conversations where regexp_matches(text, '(?i)ing[ .]')")
def grep_smartcase(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = LogSchema(F.col("turn"), {"MESSAGE": F.col("text")})
    return table(spark, sf_dir, "conversations").where(P.grep(s, "ing[ .]")).select("conv_id", "turn", P.grep(s, "The").alias("exact"))


@register("regex_payload", "select page_id from pages where regexp_matches('HTML=' || html, 'HTML=<[a-z!]') or regexp_matches('URL=' || url, 'URL=.*/[a-m][^/]*$')")
def regex_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    html, url = LogSchema(F.col("page_id"), {"HTML": F.col("html")}), LogSchema(F.col("page_id"), {"URL": F.col("url")})
    return pages.where(P.regex_payload(html, "HTML=<[a-z!]") | P.regex_payload(url, "URL=.*/[a-m][^/]*$")).select("page_id")


# Facets.

CHOSEN = {"event_type": ["click", "view"], "user_id": [str(k) for k in range(1, 40)]}
FACETS = ["event_type", "user_id", "k"]
IN_TYPE, IN_USER = "event_type in ('click', 'view')", "user_id between 1 and 39"


def facet_sql(types: str, users: str, ks: str, more: str = "true") -> str:
    return f"""with {EV}
select 'event_type' as field, coalesce(event_type, '-') as value, count(*) as n from e where {types} and {more} group by 2
union all select 'user_id', coalesce(user_id::varchar, '-'), count(*) from e where {users} and {more} group by 2
union all select 'k', coalesce(k, '-'), count(*) from e where {ks} and {more} group by 2"""


@register("facets_first", facet_sql("true", "true", "true"))
def facets_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.facets(events(spark, sf_dir), events_schema(), FACETS)


WINDOW_SQL = f"rt >= {AFTER} and rt <= {BEFORE + P.SLACK_USEC} and eff between {AFTER} and {BEFORE}"


@register("facets_excl", facet_sql(IN_USER, IN_TYPE, f"{IN_TYPE} and {IN_USER}", WINDOW_SQL))
def facets_excl(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events_schema()
    return facets.function_facets(events(spark, sf_dir), s, FACETS, CHOSEN, P.window(s, AFTER, BEFORE))


@register("facets_single_filter", facet_sql(IN_TYPE, IN_TYPE, IN_TYPE))
def facets_single_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One filtered field only: the function doesn't exclude it."""
    return facets.function_facets(events(spark, sf_dir), events_schema(), FACETS, {"event_type": CHOSEN["event_type"], "k": []})


@register("facets_all", "select 'FLAG' as field, l_returnflag as value, count(*) as n from lineitem group by 2 union all select 'STATUS', l_linestatus, count(*) from lineitem group by 2 union all select 'NONE', '-', count(distinct l_orderkey) from lineitem")
def facets_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entries that repeat FLAG and STATUS for each line; an order's lines are few."""
    pair = F.array(F.struct(F.lit("FLAG").alias("name"), F.col("l_returnflag").alias("value")), F.struct(F.lit("STATUS").alias("name"), F.col("l_linestatus").alias("value")))
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.flatten(F.collect_list(pair)).alias("fields"))
    return facets.facets(orders, LogSchema(F.col("l_orderkey"), repeated=F.col("fields")), ["FLAG", "STATUS", "NONE"], all_values=True)


@register(
    "facets_zero",
    f"""with {EV}, known as (select distinct event_type as value from e union select 'never'), counted as (select event_type as value, count(*) as n from e where event_type in ('click', 'never') and user_id < 40 group by 1)
select 'event_type' as field, value, coalesce(n, 0) as n from known left join counted using (value)""",
)
def facets_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, s = events(spark, sf_dir), events_schema()
    chosen = {"event_type": ["click", "never"]}
    counts = facets.facets(df, s, ["event_type"], selected=chosen, base=F.col("user_id") < 40, exclude_own=False)
    return facets.with_zero_counts(counts, facets.vocabulary(df, s, ["event_type"]), chosen)


@register(
    "facets_presented",
    f"""with {EV}, c as ({facet_sql('true', 'true', 'true').split(EV)[1]})
select field, value, n, row_number() over (partition by field order by n desc, value) as "order" from c where value not in ('', '-')""",
)
def facets_presented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.presented(facets.facets(events(spark, sf_dir), events_schema(), FACETS))


# Histograms.

BUCKETS = histogram.Buckets.explorer(AFTER, BEFORE)
ENGINE = histogram.Buckets.engine(AFTER, BEFORE)


def bucket_sql(b: histogram.Buckets, time: str) -> str:
    return f"{b.start} + least(greatest(({time} - {b.start}) // {b.width}, 0), {b.count - 1}) * {b.width}"


@register(
    "histogram_dense",
    f"""with {EV}, c as (
  select {bucket_sql(BUCKETS, "eff")} as bucket_start, coalesce(k, '-') as value, count(*) as n from e where {WINDOW_SQL} group by 1, 2
), spine as (
  select {BUCKETS.start} + i * {BUCKETS.width} as bucket_start, value from (select unnest(generate_series(0, {BUCKETS.count - 1})) as i), (select distinct value from c)
) select bucket_start, value, coalesce(n, 0) as n from spine left join c using (bucket_start, value)""",
)
def histogram_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events_schema()
    return histogram.histogram(events(spark, sf_dir), s, "k", BUCKETS, P.window(s, AFTER, BEFORE))


@register(
    "histogram_stats",
    f"""with {EV}, c as (
  select {bucket_sql(BUCKETS, "eff")} as b, coalesce(event_type, '-') as value, count(*) as n from e where {WINDOW_SQL} group by 1, 2
), spine as (
  select {BUCKETS.start} + i * {BUCKETS.width} as b, value from (select unnest(generate_series(0, {BUCKETS.count - 1})) as i), (select distinct value from c)
), d as (select value, coalesce(n, 0) as n from spine left join c using (b, value))
select value, min(n) as min, max(n) as max, sum(n)::bigint as sum, avg(n) as avg, count(n) as points from d group by value""",
)
def histogram_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events_schema()
    return histogram.dimension_stats(histogram.histogram(events(spark, sf_dir), s, "event_type", BUCKETS, P.window(s, AFTER, BEFORE)))


SPANS = [60, 3600, 7 * 3600, 86_400, 30 * 86_400, 400 * 86_400, 3000 * 86_400]


@register(
    "bucket_width",
    "with w(s) as (values " + ", ".join(f"({w})" for w in histogram.WIDTHS) + "), q(span) as (values " + ", ".join(f"({x})" for x in SPANS) + ") "
    "select span::bigint as span, coalesce(max(s) filter (span // s >= 150), 1)::bigint * 1000000 as explorer_width, coalesce(max(s) filter (span // s >= 50), 1)::bigint * 1000000 as engine_width from q, w group by span",
)
def bucket_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(x, histogram.bucket_width(0, x * 10**6), histogram.bucket_width(0, x * 10**6, 50)) for x in SPANS]
    return spark.createDataFrame(rows, "span long, explorer_width long, engine_width long")


ENGINE_SQL = f"eff >= {ENGINE.start} and eff < {ENGINE.start + ENGINE.width * ENGINE.count}"


@register(
    "engine_histogram",
    f"""with {EV}, c as (select {bucket_sql(ENGINE, "eff")} as bucket_start, k is not null and user_id < 50 as ok, event_type, k from e where {ENGINE_SQL})
select bucket_start, null::varchar as field, null::varchar as value, count(*) as unfiltered, count(*) filter (ok) as filtered from c group by 1
union all select bucket_start, 'event_type', event_type, count(*), count(*) filter (ok) from c where event_type is not null group by 1, 3
union all select bucket_start, 'k', k, count(*), count(*) filter (ok) from c where k is not null group by 1, 3""",
)
def engine_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events_schema()
    return histogram.engine_histogram(events(spark, sf_dir), s, ENGINE, P.has_field(s, "k") & (F.col("user_id") < 50), ["event_type", "k"])


@register("count_in_range", f"with {EV} select count(*) filter (event_type = 'click') as n from e where eff >= {AFTER} and eff < {AFTER + 3 * DAY}")
def count_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events_schema()
    return histogram.count_in_range(events(spark, sf_dir), s, AFTER, AFTER + 3 * DAY, DAY, P.has_value(s, "event_type", ["click"]))


# Boots and invocations.


@register(
    "boots_list",
    """with b as (select user_id::varchar as boot_id, min(epoch_us(ts)) as first_usec, max(epoch_us(ts)) as last_usec, count(*) as entries from events where not regexp_matches(user_id::varchar, '^0+$') group by 1)
select boot_id, first_usec, last_usec, entries, (row_number() over (order by last_usec, first_usec, boot_id) - count(*) over ())::bigint as index from b""",
)
def boots_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boots.boots(events(spark, sf_dir), F.col("user_id"), micros("ts"))


INVOCATION = "md5(conv_id::varchar)"


@register(
    "invocations_list",
    f"""with i as (select {INVOCATION} as invocation_id, min(turn) as first_usec, max(turn) as last_usec from conversations where turn % 2 = 0 group by 1)
select invocation_id, first_usec, last_usec, (row_number() over (order by first_usec, invocation_id) - count(*) over ())::bigint as index from i""",
)
def invocations_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.md5(F.col("conv_id").cast("string").cast("binary"))
    s = LogSchema(F.col("turn"), {"_SYSTEMD_INVOCATION_ID": F.when(F.col("turn") % 2 == 0, id_), "INVOCATION_ID": F.when(F.col("turn") % 4 == 0, id_), "USER_INVOCATION_ID": F.lit("not an id"), "OBJECT_SYSTEMD_INVOCATION_ID": F.lit(None)})
    return boots.invocations(table(spark, sf_dir, "conversations"), s, F.col("turn"))


@register("boot_by_offset", "with b as (select user_id::varchar as boot_id, min(epoch_us(ts)) as f, max(epoch_us(ts)) as l from events where user_id <> 0 group by 1), r as (select *, row_number() over (order by l, f, boot_id) as a, count(*) over () as n from b) select e.event_id from events e join r on e.user_id::varchar = r.boot_id where a = 2 or a = n - 1")
def boot_by_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the second boot and of the last but one."""
    df = events(spark, sf_dir)
    listed = boots.boots(df, F.col("user_id"), micros("ts"))
    wanted = boots.boot_at(listed, 2).select("boot_id").unionByName(boots.boot_at(listed, -1).select("boot_id")).distinct()
    return df.withColumn("boot_id", F.col("user_id").cast("string")).join(wanted, "boot_id", "left_semi").select("event_id")


# Pages.


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(micros("l_shipdate").alias("rt"), "l_shipdate", "l_orderkey", "l_linenumber", F.pmod("l_suppkey", F.lit(3)).cast("string").alias("file"))


def shipped() -> Stored:
    return Stored(F.col("l_shipdate"), "timestamp_ntz")


LINES = "lines as (select epoch_us(l_shipdate) as rt, l_orderkey, l_linenumber, (l_suppkey % 3)::varchar as file from lineitem)"


@register("page_boundary", f"with {LINES} select rt, l_orderkey, l_linenumber from (select *, rank() over (order by rt desc) as r from lines) where r <= 20")
def page_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.page(lines_of(spark, sf_dir), "rt", 20, ties=["l_orderkey", "l_linenumber"], stored=shipped()).select("rt", "l_orderkey", "l_linenumber")


ANCHOR = 850_000_000_000_000


@register("page_anchor", f"with {LINES} select 'backward' as direction, rt, l_orderkey, l_linenumber from (select *, rank() over (order by rt desc) as r from lines where rt < {ANCHOR}) where r <= 30 union all select 'forward', rt, l_orderkey, l_linenumber from (select *, rank() over (order by rt) as r from lines where rt > {ANCHOR}) where r <= 30")
def page_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchor, df = paging.Anchor("realtime", ANCHOR), lines_of(spark, sf_dir)
    parts = [paging.page(df, "rt", 30, backward=b, anchor=anchor, stored=shipped()).select(F.lit(d).alias("direction"), "rt", "l_orderkey", "l_linenumber") for d, b in (("backward", True), ("forward", False))]
    return parts[0].unionByName(parts[1])


@register("page_counters", f"with {LINES}, m as (select *, rank() over (order by rt desc) as r from lines where rt < {ANCHOR}) select (select count(*) from m) as matched, (select count(*) from lines where rt >= {ANCHOR}) as before, (select count(*) from m where r > 30) as after")
def page_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchor, df = paging.Anchor("realtime", ANCHOR), lines_of(spark, sf_dir)
    return paging.page_counters(df, paging.page(df, "rt", 30, anchor=anchor, stored=shipped()), "rt", backward=True, anchor=anchor)


@register("page_pages", f"with {LINES} select l_orderkey, l_linenumber, rt from (select *, row_number() over (order by rt, l_orderkey, l_linenumber) as r from lines where (rt, l_orderkey, l_linenumber) > ({ANCHOR}, 100, 2)) where r <= 50")
def page_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.next_page(lines_of(spark, sf_dir), ["rt", "l_orderkey", "l_linenumber"], [ANCHOR, 100, 2], 50, stored=shipped()).select("l_orderkey", "l_linenumber", "rt")


@register(
    "unique_ts",
    f"""with {LINES}, p as (select * from (select *, rank() over (order by rt desc) as r from lines) where r <= 40),
o as (select *, row_number() over (order by rt desc, file, l_orderkey, l_linenumber) as a from p),
g as (select *, a - row_number() over (partition by file order by a) as run from o),
n as (select *, row_number() over (partition by file, run order by a) as i from g)
select l_orderkey, l_linenumber, rt, min(rt + i) over (partition by file, run order by a rows unbounded preceding) - i as display_usec from n""",
)
def unique_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = paging.page(lines_of(spark, sf_dir), "rt", 40, stored=shipped())
    return paging.unique_times(page, "rt", "file", ["file", "l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "rt", "display_usec")


@register("head_n", "select event_id, event_type from events order by ts, event_id limit 25")
def head_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.lines(events(spark, sf_dir), ["ts", "event_id"], "+25").select("event_id", "event_type")


@register("tail_n", "select event_id, event_type from events order by ts desc, event_id desc limit 25")
def tail_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.lines(events(spark, sf_dir), ["ts", "event_id"], "25").select("event_id", "event_type")


@register("reverse", "select event_id, event_type from events order by ts desc, event_id desc limit 40")
def reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.head(events(spark, sf_dir), [F.col("ts").desc(), F.col("event_id").desc()], 40).select("event_id", "event_type")


PRINTED = "l as (select event_id, epoch_us(ts) as rt, event_id * 10 as mono, (event_id // 7)::varchar as boot from events), o as (select *, lag(boot) over (order by event_id) as pb, lag(rt) over (order by event_id) as pr, lag(mono) over (order by event_id) as pm from l)"


def printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", micros("ts").alias("rt"), (F.col("event_id") * 10).alias("mono"), F.floor(F.col("event_id") / 7).cast("string").alias("boot"))


@register("short_delta", f"with {PRINTED} select event_id, case when pb = boot then mono - pm else rt - pr end as delta_usec, case when pr is not null then pb <> boot end as other_boot from o")
def short_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.delta(printed(spark, sf_dir), ["event_id"], "boot", "rt", "mono").select("event_id", "delta_usec", "other_boot")


@register("boot_separator", f"with {PRINTED} select event_id, case when pb <> boot then '-- Boot ' || boot || ' --' end as separator from o")
def boot_separator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boots.separators(printed(spark, sf_dir), "boot", ["event_id"]).select("event_id", "separator")


# Fields and values.


@register("field_names", "select unnest(['event_type', 'user_id', 'k']) as field")
def field_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events_schema()
    with_none = LogSchema(own.realtime, own.fields | {"NEVER": F.lit(None).cast("string")})
    return listing.field_names(events(spark, sf_dir), with_none)


@register("unique_values", f"with {EV} select distinct k as value from e where k is not null")
def unique_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.unique_values(events(spark, sf_dir), events_schema(), "k")


# Display.


@register("display_priority", "select o_orderkey, p as priority, case p when '1' then 'alert' when '2' then 'critical' when '3' then 'error' when '4' then 'warning' when '5' then 'notice' end as label, case when p <= '3' then 'critical' when p = '4' then 'warning' else 'notice' end as severity from (select o_orderkey, left(o_orderpriority, 1) as p from orders)")
def display_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.substring("o_orderpriority", 1, 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", p.alias("priority"), display.priority(p).alias("label"), display.severity(p).alias("severity"))


@register("facility_names", "with f(i, n) as (values (0, 'kern'), (1, 'user'), (2, 'mail'), (3, 'daemon'), (4, 'auth'), (5, 'syslog'), (6, 'lpr'), (7, 'news'), (8, 'uucp'), (9, 'cron'), (10, 'authpriv'), (11, 'ftp'), (12, 'ntp'), (13, 'security'), (14, 'console'), (15, 'solaris-cron')) select event_id, coalesce(n, 'local' || (event_id % 26 - 16)) as facility from events left join f on event_id % 26 = i where event_id % 26 < 24 union all select event_id, (event_id % 26)::varchar from events where event_id % 26 >= 24")
def facility_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", display.facility((F.col("event_id") % 26).cast("string")).alias("facility"))


def capability_sql() -> str:
    parts = ", ".join(f"case when (v >> {k}) & 1 = 1 then '{n}' end" for k, n in enumerate(display.CAPABILITIES))
    return f"select event_id, case when h = '0' or not regexp_matches(h, '^[0-9]') then h else h || ' (' || array_to_string(list_filter([{parts}], lambda x: x is not null), ' | ') || ')' end as capabilities from (select event_id, event_id * 977 as v, lower(printf('%x', event_id * 977)) as h from events)"


@register("capabilities", capability_sql())
def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", display.capabilities(F.lower(F.hex(F.col("event_id") * 977))).alias("capabilities"))


@register("source_ts", f"with {EV} select event_id, src::varchar || ' (' || strftime(make_timestamp(src), '%Y-%m-%dT%H:%M:%S.%f') || 'Z)' as shown from e")
def source_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", display.source_time(events_schema().source_time.cast("string")).alias("shown"))


# Plans of the writer.


@register("rotation_ids", "select l_orderkey, l_linenumber, ((row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) - 1) // 100)::bigint as file_no from lineitem")
def rotation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lifecycle.rotation_ids(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber"), ["l_suppkey"], ["l_orderkey", "l_linenumber"], 100)
    return rows.select("l_orderkey", "l_linenumber", "file_no")


FILES = "files as (select l_suppkey % 7 as chain, l_suppkey as file, sum(l_quantity)::bigint as size_bytes, case when l_suppkey % 11 = 0 then 0 else count(*) end as n_entries, max(epoch_us(l_shipdate)) as tail_realtime, l_suppkey % 10 = 9 as active from lineitem group by l_suppkey)"
OLDEST = 905_000_000_000_000


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' lines as files of seven chains."""
    files = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("file")).agg(F.sum("l_quantity").cast("long").alias("size_bytes"), F.count(F.lit(1)).alias("n"), F.max(micros("l_shipdate")).alias("tail_realtime"))
    entries = F.when(F.col("file") % 11 == 0, F.lit(0).cast("long")).otherwise(F.col("n"))
    return files.select((F.col("file") % 7).alias("chain"), "file", "size_bytes", entries.alias("n_entries"), "tail_realtime", (F.col("file") % 10 == 9).alias("active"))


@register(
    "retention_plan",
    f"""with {FILES}, r as (select *, row_number() over w as rank, sum(size_bytes) over w as total from files window w as (partition by chain order by file desc rows unbounded preceding))
select file, case when rank > 1 then case when rank > 9 then 'count' when total > 60000 then 'size' when tail_realtime < {OLDEST} then 'age' end end as reason,
case when rank > 1 and (rank > 9 or total > 60000 or tail_realtime < {OLDEST}) then 'delete' else 'keep' end as action from r""",
)
def retention_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.retention_plan(files_of(spark, sf_dir), ["chain"], ["file"], count=9, size=60_000, oldest=OLDEST).select("file", "reason", "action")


@register(
    "vacuum_plan",
    f"""with {FILES}, f as (select * from files where active or n_entries > 0),
l as (select *, count(*) over w as c, sum(size_bytes) over w as s from f window w as (order by active desc, file desc rows unbounded preceding)),
t as (select *, not active and c <= 40 and s <= 400000 as enough from l),
g as (select *, bool_or(enough) over (order by active, file rows unbounded preceding) as stopped from t)
select file, case when active or stopped then 'keep' else 'delete' end as action from g union all select file, 'delete' from files where not active and n_entries = 0""",
)
def vacuum_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.vacuum_plan(files_of(spark, sf_dir), ["file"], count=40, size=400_000).select("file", "action")


@register(
    "strict_clock",
    """with n as (select l_suppkey, l_orderkey, l_linenumber, epoch_us(l_shipdate) as rt, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_shipdate) as i from lineitem)
select l_orderkey, l_linenumber, max(rt - i) over (partition by l_suppkey order by i rows unbounded preceding) + i as clock_usec from n""",
)
def strict_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", micros("l_shipdate").alias("rt"))
    return lifecycle.strict_clock(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "rt"], "rt").select("l_orderkey", "l_linenumber", "clock_usec")


@register("field_policy", "with n as (select event_id, [upper(event_type), event_type, '_' || upper(event_type), '9' || upper(event_type), 'F' || event_id, repeat('A', (event_id % 80)::bigint)] as names from events) select event_id, array_to_string(list_filter(names, lambda x: regexp_full_match(x, '[A-Z_][A-Z0-9_]{0,63}') and not starts_with(x, '_')), ',') as kept from n")
def field_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    names = F.array(F.upper(t), t, F.concat(F.lit("_"), F.upper(t)), F.concat(F.lit("9"), F.upper(t)), F.concat(F.lit("F"), "event_id"), F.repeat(F.lit("A"), (F.col("event_id") % 80).cast("int")))
    fields = F.transform(names, lambda n: F.struct(n.alias("name"), F.lit("v").cast("binary").alias("value")))
    kept = F.transform(lifecycle.accepted(fields, "app"), lambda f: f["name"])
    return events(spark, sf_dir).select("event_id", F.array_join(kept, ",").alias("kept"))


@register("dq_verify", "with o as (select *, lag(event_id) over w as ps, lag(event_type) over w as pb, lag(value) over w as pm from events window w as (partition by user_id order by event_id, ts)) select user_id, count(*) as entries, count(*) filter (event_id = 0) as zero_seqnums, count(*) filter (event_id <= ps) as repeated_seqnums, count(*) filter (event_type = pb and value < pm) as monotonic_back, min(epoch_us(ts)) as head_realtime, max(epoch_us(ts)) as tail_realtime from o group by user_id")
def dq_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("rt", micros("ts"))
    return lifecycle.verify(rows, ["user_id"], "event_id", "event_type", "value", "rt")


# Output.


@register("json_entry", f"""with {EV} select event_id, '{{"__REALTIME_TIMESTAMP":"' || rt || '","event_type":"' || event_type || '",' || case when k is not null then '"k":"' || k || '",' else '' end || '"user_id":"' || user_id || '"}}' as json from e""")
def json_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events_schema()
    return events(spark, sf_dir).select("event_id", formats.json_entry(s, list(s.fields), {"__REALTIME_TIMESTAMP": s.realtime}).alias("json"))


@register("export_text", f"with {EV} select event_id, '__REALTIME_TIMESTAMP=' || rt || chr(10) || 'event_type=' || event_type || chr(10) || case when k is not null then 'k=' || k || chr(10) else '' end || 'user_id=' || user_id || chr(10) || chr(10) as record from e")
def export_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events_schema()
    return events(spark, sf_dir).select("event_id", formats.export_text(s, list(s.fields), {"__REALTIME_TIMESTAMP": s.realtime}).alias("record"))


@register("process_name", "select event_id, case when event_id % 3 = 0 and event_id % 5 = 0 then '-' else coalesce(case when event_id % 3 <> 0 then event_type end, 'comm') || '[' || coalesce(case when event_id % 2 = 0 then user_id::varchar end, '-') || ']' end as process from events")
def process_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    s = LogSchema(micros("ts"), {"SYSLOG_IDENTIFIER": F.when(i % 3 != 0, F.col("event_type")), "_COMM": F.when(i % 5 != 0, F.lit("comm")), "_PID": F.when(i % 2 == 0, F.col("user_id"))})
    return events(spark, sf_dir).select("event_id", listing.process_name(s).alias("process"))


@register("payload_split", "with p as (select event_id, case when event_id % 4 = 0 then event_type else upper(event_type) || '=' || props || '=' || user_id end as raw from events) select event_id, case when instr(raw, '=') > 0 then left(raw, instr(raw, '=') - 1) end as name, case when instr(raw, '=') > 0 then substr(raw, instr(raw, '=') + 1) end as value from p")
def payload_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 4 == 0, F.col("event_type")).otherwise(F.concat(F.upper("event_type"), F.lit("="), "props", F.lit("="), F.col("user_id").cast("string")))
    name, value = listing.split_payload(F.col("raw"))
    return events(spark, sf_dir).select("event_id", raw.alias("raw")).select("event_id", name.alias("name"), value.alias("value"))


@register("cursor_roundtrip", "select event_id, 's=' || md5(event_type) || ';i=' || printf('%x', event_id) || ';b=' || md5(user_id::varchar) || ';m=' || printf('%x', event_id * 31) || ';t=' || printf('%x', epoch_us(ts)) || ';x=00ff' as cursor, md5(event_type) as seqnum_id, event_id as seqnum, md5(user_id::varchar) as boot_id, event_id * 31 as monotonic_usec, epoch_us(ts) as realtime_usec, '00ff' as xor_hash from events")
def cursor_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    def md5(c: Column) -> Column:
        return F.md5(c.cast("string").cast("binary"))

    made = paging.cursor(md5(F.col("event_type")), F.col("event_id"), md5(F.col("user_id")), F.col("event_id") * 31, micros("ts"), F.lit("00ff"))
    rows = events(spark, sf_dir).select("event_id", made.alias("cursor"))
    return rows.select("event_id", "cursor", *[c.alias(n) for n, c in paging.cursor_parts(F.col("cursor")).items()])


@register("scan_digest", "select event_type, count(*) as entries, sum(length(props) + length(event_type))::bigint as payload_bytes, min(epoch_us(ts)) as first_usec, max(epoch_us(ts)) as last_usec from events group by event_type")
def scan_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.sum(F.length("props") + F.length("event_type")).cast("long")
    return events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("entries"), size.alias("payload_bytes"), F.min(micros("ts")).alias("first_usec"), F.max(micros("ts")).alias("last_usec"))
