"""The logs function: a JSON request in, an envelope with table, facets and histogram out.

A page of rows, facet options and buckets are collected. Options and dimensions
are as many as there are values, unless ``most`` bounds them.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions import predicates as P
from emberlog.functions.display import Registry, default_registry, severity
from emberlog.functions.timeparse import time_window
from emberlog.operators import facets, histogram, listing, paging, sampling
from emberlog.plans.explore import LogQuery, explore
from emberlog.schema import LogSchema
from emberlog.sources import catalog

KEYS = "info __logs_sources after before anchor direction last query facets histogram if_modified_since data_only delta tail sampling slice".split()
IGNORED_SELECTIONS = {"query", "source", "__logs_sources"}
NOT_MODIFIED, CANCELLED, FAILED = 304, 499, 500

#: Columns shown, and fields that are facets, unless a request names others.
DEFAULT_VIEW = (
    "_HOSTNAME MESSAGE PRIORITY SYSLOG_FACILITY ERRNO SYSLOG_IDENTIFIER UNIT USER_UNIT MESSAGE_ID _BOOT_ID _SYSTEMD_OWNER_UID _UID "
    "OBJECT_SYSTEMD_OWNER_UID OBJECT_UID _GID OBJECT_GID _CAP_EFFECTIVE _AUDIT_LOGINUID OBJECT_AUDIT_LOGINUID _SOURCE_REALTIME_TIMESTAMP"
).split()
DEFAULT_FACETS = (
    "_HOSTNAME PRIORITY SYSLOG_FACILITY ERRNO SYSLOG_IDENTIFIER UNIT USER_UNIT MESSAGE_ID _BOOT_ID _SYSTEMD_OWNER_UID _UID OBJECT_SYSTEMD_OWNER_UID OBJECT_UID "
    "_GID OBJECT_GID _AUDIT_LOGINUID OBJECT_AUDIT_LOGINUID CODE_FILE _SYSTEMD_UNIT _SYSTEMD_USER_SLICE CODE_FUNC _TRANSPORT _COMM _RUNTIME_SCOPE _MACHINE_ID _SYSTEMD_SLICE "
    "UNIT_RESULT _SYSTEMD_CGROUP _EXE _SYSTEMD_USER_UNIT _SYSTEMD_SESSION COREDUMP_CGROUP COREDUMP_USER_UNIT COREDUMP_UNIT COREDUMP_SIGNAL_NAME COREDUMP_COMM _UDEV_DEVNODE "
    "_KERNEL_SUBSYSTEM OBJECT_EXE OBJECT_SYSTEMD_CGROUP OBJECT_COMM OBJECT_SYSTEMD_UNIT OBJECT_SYSTEMD_USER_UNIT _SELINUX_CONTEXT _NAMESPACE OBJECT_SYSTEMD_SESSION "
    "CONTAINER_ID CONTAINER_NAME CONTAINER_TAG IMAGE_NAME"
).split()
PAGINATION = {"enabled": True, "key": "anchor", "column": "timestamp", "units": "timestamp_usec"}


@dataclass(frozen=True)
class Request:
    after: int
    before: int
    info: bool = False
    anchor: int | None = None
    backward: bool = True
    last: int = paging.DEFAULT_ROWS
    shown_last: int = paging.DEFAULT_ROWS
    query: str = ""
    facets: tuple[str, ...] = ()
    histogram: str | None = None
    if_modified_since: int = 0
    data_only: bool = False
    delta: bool = False
    tail: bool = False
    sampling: int = 0
    selections: dict[str, list[str]] = field(default_factory=dict)
    sources: list[str] = field(default_factory=list)


def parse(raw: dict, now: int | None = None, default_facets: tuple[str, ...] = (), default_histogram: str | None = "PRIORITY") -> Request:
    """A request as asked: a window of absolute times, an anchor inside it, at least two rows, selections as stored."""
    after, before = time_window(int(time.time()) if now is None else now, raw.get("after"), raw.get("before"))
    backward = raw.get("direction", "backward") != "forward"
    anchor, backward = paging.checked_anchor(raw.get("anchor") or None, backward, after, before)
    asked = int(raw.get("last") or paging.DEFAULT_ROWS)
    chosen = {n: [P.normalise_selection(n, v) for v in values] for n, values in (raw.get("selections") or {}).items() if n not in IGNORED_SELECTIONS}
    data_only = bool(raw.get("data_only"))
    return Request(
        after, before, bool(raw.get("info")), anchor.time, backward, max(asked, paging.LEAST_ROWS), asked, raw.get("query") or "", tuple(raw.get("facets") or default_facets), raw.get("histogram") or default_histogram,
        int(raw.get("if_modified_since") or 0), data_only, bool(raw.get("delta")), bool(raw.get("tail")), int(raw.get("sampling") or 0), chosen, list((raw.get("selections") or {}).get("__logs_sources", [])),
    )


def column_catalogue(names: list[str], facet_names: list[str]) -> dict[str, dict]:
    """A table's columns by name: place, whether shown at first, and whether a facet filters it."""
    out = {"timestamp": {"index": 0, "visible": True, "filter": "range"}, "rowOptions": {"index": 1, "visible": False, "filter": "none"}}
    for k, n in enumerate(names):
        out[n] = {"index": k + 2, "visible": n in DEFAULT_VIEW, "filter": "facet" if n in facet_names else "none"}
    return out


def message(timed_out: bool, examined: int, unsampled: int, estimated: int) -> str | dict:
    """``OK``, or what of the data a table leaves out."""
    if not timed_out and not unsampled and not estimated:
        return "OK"
    total = max(1, examined + unsampled + estimated)
    shares = [(f"{100 * n / total:.2f}%", label) for n, label in ((examined, "real data"), (unsampled, "unsampled"), (estimated, "estimated")) if n or label == "real data"]
    title = "Query timed-out, incomplete data. " * timed_out + ", ".join(f"{share} {label}" for share, label in shares) * bool(unsampled or estimated)
    return {"title": title, "status": "warning" if timed_out else "notice"}


class Cancelled(Exception):
    """The caller asked to stop."""


class Steps:
    """Runs a response's Spark jobs one after another, within a time, and tells how far it is."""

    def __init__(self, df: DataFrame, timeout: float | None, progress: Callable[[dict], None] | None, cancelled: Callable[[], bool] | None):
        self.context, self.group = df.sparkSession.sparkContext, f"respond-{uuid.uuid4().hex}"
        self.progress, self.cancelled, self.done, self.timed_out = progress, cancelled, 0, timeout is not None and timeout <= 0
        self.timer = threading.Timer(timeout, self._stop) if timeout is not None and timeout > 0 else None

    def _stop(self) -> None:
        self.timed_out = True
        self.context.cancelJobGroup(self.group)

    def __enter__(self) -> Steps:
        self.context.setJobGroup(self.group, "logs function", True)
        if self.timer is not None:
            self.timer.start()
        return self

    def __exit__(self, *_) -> None:
        if self.timer is not None:
            self.timer.cancel()
        self.context.setLocalProperty("spark.jobGroup.id", None)

    def run(self, what: str, job: Callable, otherwise):
        """What a job gives, or ``otherwise`` once the time is over."""
        if self.cancelled is not None and self.cancelled():
            raise Cancelled
        if self.timed_out:
            return otherwise
        try:
            found = job()
        except Exception:  # a job that the timer stopped fails; any other failure is one
            if not self.timed_out:
                raise
            return otherwise
        self.done += 1
        if self.progress is not None:
            self.progress({"step": what, "done": self.done})
        return found


def respond(
    df: DataFrame, schema: LogSchema, raw: dict, *, columns: list[str] | None = None, ties: list[str] = (), now: int | None = None, registry: Registry | None = None, default_facets: tuple[str, ...] = (),
    default_histogram: str | None = "PRIORITY", most: int | None = None, timeout: float | None = None, progress: Callable[[dict], None] | None = None, cancelled: Callable[[], bool] | None = None,
) -> dict:
    """The response. With ``data_only`` facets, histogram and counters are left out, unless ``delta`` asks for them too, under names of their own.

    columns: shown fields, by default all that the entries have. After ``timeout`` seconds the table holds what is known
    (``partial``); ``progress`` is called after each step, and where ``cancelled`` says so the answer is 499.
    """
    request = parse(raw, now, default_facets, default_histogram)
    if request.info:
        return {"status": 200, "type": "table", "v": 3, "accepted_params": KEYS, "required_params": [{"id": "__logs_sources", "options": list(catalog.CLASSES)}], "show_ids": True, "has_history": True, "pagination": PAGINATION, "facets": list(request.facets), "histogram": request.histogram}
    try:
        with Steps(df, timeout, progress, cancelled) as steps:
            return _answer(df, schema, request, steps, columns, ties, registry or default_registry(), most)
    except Cancelled:
        return {"status": CANCELLED, "errorMessage": "Request cancelled."}
    except ValueError as e:
        return {"status": FAILED, "errorMessage": str(e)}


def _answer(df: DataFrame, schema: LogSchema, request: Request, steps: Steps, columns: list[str] | None, ties: list[str], registry: Registry, most: int | None) -> dict:
    if request.sources and schema.file is not None:
        df = df.where(catalog.source_condition(schema.file, request.sources))
    newest = steps.run("newest", lambda: df.agg(F.max(schema.realtime).alias("m")).first()["m"] or 0, 0)
    if request.if_modified_since and not steps.timed_out and newest <= request.if_modified_since:
        return {"status": NOT_MODIFIED, "errorMessage": "No new data since the previous call."}
    if columns is None:
        columns = sorted({r.field for r in steps.run("columns", lambda: listing.field_names(df, schema).collect(), [])})  # names of fields alone
    touched = [n for n, v in request.selections.items() if v]
    query = LogQuery(request.after, request.before, request.selections, tuple(P.parse_terms(request.query)), request.facets, request.histogram, 0, request.backward, exclude_own=len(touched) > 1)
    analysed = not request.data_only or request.delta
    anchor = paging.Anchor("realtime", request.anchor) if request.anchor is not None else None
    inside = P.window(schema, request.after, request.before) & P.full_text(schema, list(query.terms))
    chosen = P.all_of(P.filters(schema, request.selections).values())
    timed = df.where(inside & chosen).withColumn("effective_usec", schema.effective())
    out: dict = {
        "status": 200, "type": "table", "show_ids": True, "has_history": True, "pagination": PAGINATION, "expires": 3600 if request.data_only else 0,
        "_request": {k: getattr(request, k) for k in ("after", "before", "anchor", "query", "data_only", "delta", "tail", "sampling")} | {"last": request.shown_last, "slice": True},
        "columns": column_catalogue(columns, list(request.facets)),
    }

    def rows() -> list:
        page = paging.page(timed, "effective_usec", request.last, backward=request.backward and not request.tail, anchor=anchor, ties=ties)
        values = page.withColumn("severity", severity(schema.value("PRIORITY"))).withColumns({f"_c{k}": schema.value(c) for k, c in enumerate(columns)})
        shown = values.orderBy(F.col("effective_usec").desc(), *ties).select("effective_usec", "severity", *[registry.show(c, F.col(f"_c{k}")) for k, c in enumerate(columns)])
        return shown.collect()

    found = steps.run("rows", rows, [])
    out["data"] = [[r[0], {"severity": r[1]}, *r[2:]] for r in found]
    if not request.data_only or request.tail:
        out["last_modified"] = newest
    unsampled = 0
    examined = len(found)
    if analysed:
        suffix = "_delta" if request.data_only else ""
        base = df if not (request.delta and anchor is not None) else df.where(schema.effective() > request.anchor)  # counts of new rows alone
        sampled = sampling.wanted(request.sampling, request.after, request.before, request.data_only, request.delta)
        buckets = histogram.Buckets.explorer(request.after, request.before)
        marked = sampling.marked(base.where(inside), schema, buckets, budget=request.sampling, limit=max(1, request.last)) if sampled else base
        result = explore(marked.where("sampled") if sampled else base, schema, query)
        at = F.col("effective_usec")
        within = F.lit(True) if anchor is None else anchor.condition(at, request.backward, True)
        counted = steps.run("counters", lambda: timed.agg(F.count(F.lit(1)).alias("all"), F.count_if(within).alias("matched")).first(), None)
        total = steps.run("examined", lambda: marked.agg(F.count(F.lit(1)).alias("n"), F.count_if("sampled").alias("sampled")).first() if sampled else base.where(P.window(schema, request.after, request.before)).agg(F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("sampled")).first(), None)
        if total is not None:
            examined, unsampled = total["sampled"], total["n"] - total["sampled"]
        if sampled:
            out["_sampling"] = {"enabled": True, "sampled": examined, "unsampled": unsampled, "estimated": 0}
        matched, everything = (counted["matched"], counted["all"]) if counted is not None else (len(found), len(found))
        rest, outside = max(0, matched - len(found)), everything - matched
        before, after = (outside, rest) if request.backward else (rest, outside)
        out[f"items{suffix}"] = {"evaluated": examined + unsampled, "matched": matched, "unsampled": unsampled, "estimated": 0, "returned": len(found), "max_to_return": request.last, "before": before, "after": after}
        if result.facets is not None:
            known = facets.vocabulary(df.where(P.window(schema, request.after, request.before)), schema, list(request.facets))
            counts = facets.presented(facets.with_zero_counts(result.facets, known, {n: v for n, v in request.selections.items() if n in request.facets}), most)
            out[f"facets{suffix}"] = [r.asDict() for r in steps.run("facets", lambda: counts.orderBy("field", "order").collect(), [])]
        if result.histogram is not None:
            bars = result.histogram
            if sampled:  # what wasn't evaluated is a dimension of its own
                bars = sampling.sampled_histogram(marked.where(chosen | ~F.col("sampled")), schema, request.histogram, buckets)
            if most is not None:
                top = bars.groupBy("value").agg(F.sum("n").alias("_sum")).orderBy(F.col("_sum").desc(), "value").limit(most).select("value")
                bars = bars.join(F.broadcast(top), "value", "left_semi")  # ``most`` rows at most
            points = steps.run("histogram", lambda: bars.orderBy("bucket_start", "value").collect(), [])
            dimensions = steps.run("dimensions", lambda: histogram.dimension_stats(bars).orderBy("value").collect(), [])
            out[f"histogram{suffix}"] = {"id": request.histogram, "points": [r.asDict() for r in points], "dimensions": [r.asDict() for r in dimensions]}
    out["partial"] = steps.timed_out
    out["message"] = message(steps.timed_out, examined, unsampled, 0)
    return out
