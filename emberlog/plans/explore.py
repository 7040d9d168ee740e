"""A query as data, run to lazy DataFrames: rows, facets, histogram and statistics."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions import predicates as P
from emberlog.operators import facets, histogram, paging
from emberlog.schema import LogSchema


@dataclass(frozen=True)
class LogQuery:
    """What to look at. ``filters``: values by field; ``terms``: full text; ``limit`` 0: no rows."""

    after: int | None = None
    before: int | None = None
    filters: dict[str, list[str]] = field(default_factory=dict)
    terms: tuple[P.Term, ...] = ()
    facets: tuple[str, ...] = ()
    histogram: str | None = None
    limit: int = paging.DEFAULT_ROWS
    backward: bool = True
    anchor: paging.Anchor = paging.Anchor()
    exclude_own: bool = True
    all_values: bool = False
    slack: int = P.SLACK_USEC
    target_buckets: int = 150

    def with_filter(self, name: str, *values: str) -> LogQuery:
        return replace(self, filters=self.filters | {name: [*self.filters.get(name, []), *values]})

    def with_facet(self, name: str) -> LogQuery:
        return replace(self, facets=(*self.facets, name))

    def with_histogram(self, name: str) -> LogQuery:
        return replace(self, histogram=name)

    def with_term(self, term: str, negative: bool = False) -> LogQuery:
        return replace(self, terms=(*self.terms, P.Term(tuple(p for p in term.split("*") if p), negative)))


@dataclass(frozen=True)
class ExploreResult:
    rows: DataFrame | None
    facets: DataFrame | None
    histogram: DataFrame | None
    stats: DataFrame


def explore(df: DataFrame, schema: LogSchema, query: LogQuery) -> ExploreResult:
    """Lowers a query; each part is lazy and reads only the columns it needs.

    The commit-time bounds are pushed to the scan. Facets are one pass whatever filters they leave out.
    """
    P.validate(query.after, query.before, list(query.facets), query.filters)
    inside = P.window(schema, query.after, query.before, query.slack) & P.full_text(schema, list(query.terms))
    matched = P.all_of(P.filters(schema, query.filters).values())
    rows = counted = bars = None
    timed = df.where(inside)
    if query.limit:
        page = timed.where(matched).withColumn("effective_usec", schema.effective())
        rows = paging.page(page, "effective_usec", query.limit, backward=query.backward, anchor=query.anchor, exclusive=False)
    if query.facets:
        counted = facets.facets(timed, schema, list(query.facets), selected=query.filters, exclude_own=query.exclude_own, all_values=query.all_values)
    if query.histogram:
        buckets = histogram.Buckets.explorer(query.after, query.before, query.target_buckets)
        bars = histogram.histogram(timed, schema, query.histogram, buckets, matched)
    late = schema.realtime - (schema.source_time if schema.source_time is not None else schema.realtime)
    stats = df.where(P.commit_guard(schema, query.after, query.before, query.slack)).agg(
        F.count(F.lit(1)).alias("examined"), F.count_if(P.false_if_null(inside & matched)).alias("matched"), F.max(late).alias("largest_delta"), F.max(schema.realtime).alias("last_realtime")
    )
    return ExploreResult(rows, counted, bars, stats)


def explore_by_pass(df: DataFrame, schema: LogSchema, query: LogQuery) -> DataFrame:
    """Facets counted in one pass each; the same rows as explore().facets, to check one plan by another."""
    inside = P.window(schema, query.after, query.before, query.slack) & P.full_text(schema, list(query.terms))
    out = None
    for n in query.facets:
        others = {m: v for m, v in query.filters.items() if not (query.exclude_own and m == n)}
        part = facets.facets(df.where(inside & P.all_of(P.filters(schema, others).values())), schema, [n], all_values=query.all_values)
        out = part if out is None else out.unionByName(part)
    return out
