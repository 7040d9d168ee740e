"""Row conditions: field matches, time windows, full text, units, boots, priorities."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.schema import LogSchema

FIELD_NAME = re.compile(r"[A-Z_][A-Z0-9_]*")

#: Names of syslog priorities and facilities, in numeric order.
PRIORITIES = "emerg alert crit err warning notice info debug".split()
PRIORITY_NAMES = {"emerg": 0, "panic": 0, "alert": 1, "crit": 2, "critical": 2, "err": 3, "error": 3, "warn": 4, "warning": 4, "notice": 5, "info": 6, "debug": 7}
FACILITIES = "kern user mail daemon auth syslog lpr news uucp cron authpriv ftp".split()
FACILITY_NAMES = {n: k for k, n in enumerate(FACILITIES)} | {f"local{k}": 16 + k for k in range(8)}

#: Message id of core dumps and the fields that name a unit or an invocation.
COREDUMP = "fc2e22bc6ee647b6b90729ab34a250b1"
UNIT_FIELDS = ["_SYSTEMD_UNIT", "COREDUMP_UNIT", "UNIT", "OBJECT_SYSTEMD_UNIT", "_SYSTEMD_SLICE"]
USER_UNIT_FIELDS = ["_SYSTEMD_USER_UNIT", "USER_UNIT", "COREDUMP_USER_UNIT", "OBJECT_SYSTEMD_USER_UNIT", "_SYSTEMD_USER_SLICE"]
INVOCATION_FIELDS = ["_SYSTEMD_INVOCATION_ID", "OBJECT_SYSTEMD_INVOCATION_ID", "INVOCATION_ID", "USER_INVOCATION_ID"]


def false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def match_nothing() -> Column:
    return F.lit(False)


def has_value(schema: LogSchema, name: str, values: Iterable[str]) -> Column:
    """Whether any occurrence of a field has one of the values; null where a wide column is.

    On a wide column it is a plain IN of the column's own type, which reaches the scan.
    """
    values = list(values)
    if not values:
        return match_nothing()
    if name in schema.fields and schema.types.get(name) == "long":  # text that is no number as Spark writes it equals none
        numbers = [int(v) for v in values if re.fullmatch(r"0|-?[1-9][0-9]{0,18}", v) and -(2**63) <= int(v) < 2**63]
        return schema.fields[name].isin(*numbers) if numbers else match_nothing()
    if name in schema.fields:
        return schema.fields[name].cast("string").isin(*values)
    if schema.binary and schema.repeated is not None:  # bytes are compared as they are
        return F.exists(schema.raw_values(name), lambda v: v.isin(*[x.encode() for x in values]))
    return F.exists(schema.values(name), lambda v: v.isin(*values))


def has_field(schema: LogSchema, name: str) -> Column:
    if name in schema.fields:
        return schema.fields[name].isNotNull()
    return F.exists(schema.repeated, lambda f: f["name"] == name) if schema.repeated is not None else match_nothing()


@dataclass
class Matches:
    """A builder of matches: AND of terms, each an OR of groups, each an AND over fields of an OR over values."""

    terms: list[list[dict[str, list[str]]]] = field(default_factory=lambda: [[{}]])

    def add(self, payload: str) -> Matches:
        """Adds FIELD=value; values of a field within a group are alternatives."""
        name, sign, value = payload.partition("=")
        if not sign or not FIELD_NAME.fullmatch(name):
            raise ValueError(f"not a match: {payload!r}")
        values = self.terms[-1][-1].setdefault(name, [])
        if value not in values:
            values.append(value)
        return self

    def disjunction(self) -> Matches:
        """What follows is an alternative to the group before."""
        if self.terms[-1][-1]:
            self.terms[-1].append({})
        return self

    def conjunction(self) -> Matches:
        """What follows must hold besides all before."""
        if any(self.terms[-1]):
            self.terms.append([{}])
        return self

    def flush(self) -> Matches:
        self.terms = [[{}]]
        return self

    def condition(self, schema: LogSchema) -> Column:
        """No match at all: every row."""
        terms = [[g for g in t if g] for t in self.terms]
        return all_of(any_of(all_of(has_value(schema, n, v) for n, v in g.items()) for g in t) for t in terms if t)


def filters(schema: LogSchema, wanted: dict[str, list[str]]) -> dict[str, Column]:
    """A condition for each field with values; an empty list of values is no constraint."""
    return {n: has_value(schema, n, v) for n, v in wanted.items() if v}


@dataclass(frozen=True)
class Filter:
    """The algebra of the index engine. ``None`` operands are no constraint and are dropped."""

    kind: str
    name: str = ""
    value: str = ""
    parts: tuple = ()

    @staticmethod
    def exists(name: str) -> Filter:
        return Filter("exists", name)

    @staticmethod
    def pair(name: str, value: str) -> Filter:
        return Filter("pair", name, value)

    @staticmethod
    def _join(kind: str, parts) -> Filter | None:
        flat = []
        for p in parts:
            if p is not None:
                flat += p.parts if p.kind == kind else (p,)
        return None if not flat else flat[0] if len(flat) == 1 else Filter(kind, parts=tuple(flat))

    @staticmethod
    def all(*parts) -> Filter | None:
        return Filter._join("and", parts)

    @staticmethod
    def any(*parts) -> Filter | None:
        return Filter._join("or", parts)

    def condition(self, schema: LogSchema) -> Column:
        if self.kind == "exists":
            return has_field(schema, self.name)
        if self.kind == "pair":
            return has_value(schema, self.name, [self.value])
        return (all_of if self.kind == "and" else any_of)(p.condition(schema) for p in self.parts)


# Time. Three rules: both ends inclusive on effective time; half open; both ends inclusive on commit time.


def stored_within(schema: LogSchema, after: int | None, before: int | None) -> Column:
    """Both ends inclusive on the commit time, compared with the stored column where there is one, so that the scan sees it."""
    if schema.stored is None:
        return within(schema.realtime, after, before)
    at = schema.stored
    tests = [at.column >= at.literal(after)] if after is not None else []
    return all_of(tests + ([at.column <= at.literal(before)] if before is not None else []))


def effective_within(schema: LogSchema, after: int | None, before: int | None, half: bool = False) -> Column:
    """Bounds on the effective time. It is never past the commit time, so the lower bound holds for that too and reaches the scan."""
    test = (half_open if half else within)(schema.effective(), after, before)
    return stored_within(schema, after, None) & test if after is not None else test


def within(time: Column, after: int | None, before: int | None) -> Column:
    return all_of([time >= after] * (after is not None) + [time <= before] * (before is not None))


def half_open(time: Column, after: int | None, before: int | None) -> Column:
    return all_of([time >= after] * (after is not None) + [time < before] * (before is not None))


SLACK_USEC = 120_000_000


def commit_guard(schema: LogSchema, after: int | None, before: int | None, slack: int = SLACK_USEC) -> Column:
    """Bounds on the commit time that every row in the window meets; unlike the effective time they reach the scan."""
    return stored_within(schema, after, None if before is None else before + slack)


def window(schema: LogSchema, after: int | None, before: int | None, slack: int = SLACK_USEC) -> Column:
    return commit_guard(schema, after, before, slack) & within(schema.effective(), after, before)


# Full text.


@dataclass(frozen=True)
class Term:
    """Parts that must occur in this order; a negative term rejects."""

    parts: tuple[str, ...]
    negative: bool = False

    def matches(self, value: Column) -> Column:
        """ASCII case is ignored; an empty value never matches, a term of stars alone matches any other."""
        if not any(self.parts):
            return F.length(value) > 0
        return value.rlike("(?is)" + ".*".join(_quoted(p) for p in self.parts if p))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in " _-" or ord(c) > 127 else "\\" + c for c in text)


def parse_terms(query: str) -> list[Term]:
    """``a|b|!c*d``: a bar parts terms, a star parts of a term, a leading ! negates, a backslash takes the next character as it is."""
    terms, part, parts, at, negative, begun = [], "", [], 0, False, False

    def close() -> None:
        nonlocal part, parts, negative, begun
        full = [*parts, part]
        if begun:
            terms.append(Term(tuple(p for p in full if p), negative))
        part, parts, negative, begun = "", [], False, False

    while at < len(query):
        c = query[at]
        if c == "\\" and at + 1 < len(query):
            at += 1
            part, begun = part + query[at], True
        elif c == "|":
            close()
        elif c == "!" and not begun and not negative:
            negative = True
        elif c == "*":
            parts, part, begun = [*parts, part], "", True
        else:
            part, begun = part + c, True
        at += 1
    close()
    return terms


def full_text(schema: LogSchema, terms: list[Term]) -> Column:
    """Each value takes the sign of the first term it matches; a row stays without a negative value and, if there are positive terms, with a positive one."""
    if not terms:
        return F.lit(True)

    def sign(value: Column) -> Column:
        out = F
        for t in terms:
            out = out.when(t.matches(value), F.lit(-1 if t.negative else 1))
        return out.otherwise(F.lit(0))

    if schema.repeated is None:  # wide columns need no array
        signs = [F.coalesce(sign(schema.value(n)), F.lit(0)) for n in schema.fields]
        bad, good = any_of(s == -1 for s in signs), any_of(s == 1 for s in signs)
    else:
        signs = F.transform(schema.payloads(), sign)
        bad, good = F.exists(signs, lambda s: s == -1), F.exists(signs, lambda s: s == 1)
    return ~bad & good if any(not t.negative for t in terms) else ~bad


def full_text_lists(schema: LogSchema, positive: list[str], negative: list[str]) -> Column:
    """Terms in two lists: negative ones are tried first."""
    return full_text(schema, [Term(tuple(p for p in t.split("*") if p), True) for t in negative] + [Term(tuple(p for p in t.split("*") if p)) for t in positive])


def regex_payload(schema: LogSchema, pattern: str) -> Column:
    """A regular expression found in any ``FIELD=value``; case counts."""
    own = [false_if_null(F.concat(F.lit(f"{n}="), schema.value(n)).rlike(pattern)) for n in schema.fields]
    if schema.repeated is not None:
        own.append(F.exists(schema.repeated, lambda f: F.concat(f["name"], F.lit("="), schema.text(f["value"])).rlike(pattern)))
    return any_of(own)


def grep(schema: LogSchema, pattern: str, case_sensitive: bool | None = None, name: str = "MESSAGE") -> Column:
    """A pattern found in any message; without an upper-case letter in it, case is ignored."""
    if case_sensitive is None:
        case_sensitive = any(c.isupper() for c in pattern)
    return F.exists(schema.values(name), lambda v: v.rlike(pattern if case_sensitive else f"(?i){pattern}"))


# Shorthands of the command line.


def priority_range(option: str) -> list[str]:
    """``X``: 0 to X; ``A..B``: from the lesser to the greater. As text values."""

    def number(x: str) -> int:
        if x.strip().lower() in PRIORITY_NAMES:
            return PRIORITY_NAMES[x.strip().lower()]
        if x.strip() in set("01234567"):
            return int(x)
        raise ValueError(f"not a priority: {x!r}")

    low, dots, high = option.partition("..")
    a, b = (number(low), number(high)) if dots else (0, number(low))
    return [str(k) for k in range(min(a, b), max(a, b) + 1)]


def facility_list(option: str) -> list[str]:
    out = []
    for x in option.split(","):
        x = x.strip().lower()
        if x in FACILITY_NAMES:
            out.append(str(FACILITY_NAMES[x]))
        elif x.isdigit() and int(x) < 128:
            out.append(str(int(x)))
        else:
            raise ValueError(f"not a facility: {x!r}")
    return out


def identifiers(schema: LogSchema, wanted: list[str], excluded: list[str] = ()) -> Column:
    keep = has_value(schema, "SYSLOG_IDENTIFIER", wanted) if wanted else F.lit(True)
    return keep & ~false_if_null(has_value(schema, "SYSLOG_IDENTIFIER", excluded)) if excluded else keep


def mangle_unit(name: str) -> str:
    """A unit's full name: .service unless it has a known suffix or is a pattern."""
    kinds = "service socket device mount automount swap target path timer slice scope".split()
    if is_glob(name) or name.rpartition(".")[2] in kinds and "." in name:
        return name
    return f"{name}.service"


def is_glob(text: str) -> bool:
    return any(c in text for c in "*?[")


def glob_regex(pattern: str) -> str:
    """A shell pattern (* ? [...]) as an anchored regular expression."""
    out, at = "", 0
    while at < len(pattern):
        c = pattern[at]
        end = pattern.find("]", at + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inside = pattern[at + 1 : end]
            out += "[" + ("^" + inside[1:] if inside[0] in "!^" else inside).replace("\\", "\\\\") + "]"
            at = end
        else:
            out += _quoted(c)
        at += 1
    return f"(?s)^{out}$"


def _unit_groups(schema: LogSchema, is_value, slices: bool, user: str | None) -> Column:
    def both(*conditions: Column) -> Column:
        return all_of(conditions)

    if user is None:
        groups = [
            is_value("_SYSTEMD_UNIT"),
            both(has_value(schema, "_SYSTEMD_CGROUP", ["/init.scope"]), is_value("UNIT")),
            both(has_value(schema, "_UID", ["0"]), is_value("OBJECT_SYSTEMD_UNIT")),
            both(has_value(schema, "MESSAGE_ID", [COREDUMP]), has_value(schema, "_UID", ["0"]), is_value("COREDUMP_UNIT")),
        ]
        if slices:
            groups.append(is_value("_SYSTEMD_SLICE"))
    else:
        mine = has_value(schema, "_UID", [user])
        trusted = has_value(schema, "_UID", [user, "0"])
        groups = [
            both(mine, is_value("_SYSTEMD_USER_UNIT")),
            both(mine, is_value("USER_UNIT")),
            both(trusted, is_value("OBJECT_SYSTEMD_USER_UNIT")),
            both(trusted, is_value("COREDUMP_USER_UNIT")),
        ]
        if slices:
            groups.append(both(mine, is_value("_SYSTEMD_USER_SLICE")))
    return any_of(groups)


def unit(schema: LogSchema, name: str, user: str | None = None) -> Column:
    """Messages of a system unit, or with ``user`` (a uid) of that user's unit; a pattern is matched against the fields' values."""
    full = mangle_unit(name)
    if is_glob(full):
        pattern = glob_regex(full)
        return _unit_groups(schema, lambda n: F.exists(schema.values(n), lambda v: v.rlike(pattern)), True, user)
    return _unit_groups(schema, lambda n: has_value(schema, n, [full]), full.endswith(".slice"), user)


def invocation(schema: LogSchema, id_: str) -> Column:
    return any_of(has_value(schema, n, [id_]) for n in INVOCATION_FIELDS)


def dmesg(schema: LogSchema) -> Column:
    return has_value(schema, "_TRANSPORT", ["kernel"])


def normalise_selection(name: str, value: str) -> str:
    """A selected value as stored: names of priorities become numbers."""
    if name == "PRIORITY" and value.lower() in PRIORITY_NAMES:
        return str(PRIORITY_NAMES[value.lower()])
    return value


def validate(after: int | None, before: int | None, facets: list[str], fields: Iterable[str]) -> None:
    if after is not None and before is not None and after > before:
        raise ValueError("the window ends before it begins")
    if len(set(facets)) != len(facets):
        raise ValueError("a facet is named twice")
    for n in [*facets, *fields]:
        if not n or "=" in n:
            raise ValueError(f"not a field name: {n!r}")
