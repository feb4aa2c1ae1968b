"""Timestamps of mixed formats, precisions and zones, as one UTC instant.

An ordered cascade of anchored patterns reads a text into fields, the fields are checked strictly,
and the zone is settled: an offset in the text, letters, a named zone, else the zone of the source
from a lookup. A local time that occurs twice or never in its zone states no instant.

The cascade runs in Arrow batches: as one built-in expression tree (seven patterns, nine fields,
zone rules) it made plans that took the optimizer longer than the data took.
"""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone
from functools import cache, lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names, by month.
MONTHS = (
    "jan january januar jänner janvier enero ene",
    "feb february februar février febrero fevr",
    "mar march märz mrz mars marzo maerz",
    "apr april avril abril abr avr",
    "may mai mayo",
    "jun june juni juin junio",
    "jul july juli juillet julio juil",
    "aug august août agosto ago aout",
    "sep sept september septembre septiembre set setiembre",
    "oct october oktober octobre octubre okt",
    "nov november novembre noviembre",
    "dec december dezember décembre diciembre dez dic",
)
# Zone letters of mail headers (RFC 5322, 4.3), in minutes.
MAIL_ZONES = {"ut": 0, "gmt": 0, "utc": 0, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420}

_MONTH_NO = {name: i for i, names in enumerate(MONTHS, 1) for name in names.split()}
_WEEKDAY = r"(?:[^\W\d_]{2,10}(?:\.?, ?|\.? ))?"
_MONTH = r"(?P<b>[^\W\d_]{3,10})\.?"
_TIME = r"(?P<h>\d{1,2}):(?P<m>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?(?: ?(?P<p>[AP])\.?M\b\.?)?"
_ZONE = r"(?: ?\[?(?P<z>(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?|[A-Z]+(?:/[A-Z_+\-0-9]+)+|[A-Z]{1,5})\]?(?:\[[A-Z/_]+\])?)?"
_Y = r"(?P<y>\d{4}|\d{2})"
#: Patterns in order; the first that matches the whole text decides.
FORMATS = tuple(
    re.compile(p, re.IGNORECASE)
    for p in (
        rf"{_WEEKDAY}(?P<d>\d{{1,2}})(?:\.|er|st|nd|rd|th)?[ -](?:de )?{_MONTH}[ -](?:del? )?{_Y},? {_TIME}{_ZONE}",
        rf"(?P<y>\d{{4}})-(?P<n>\d{{2}})-(?P<d>\d{{2}})(?:[T ]{_TIME})?{_ZONE}",
        rf"{_WEEKDAY}{_MONTH} (?P<d>\d{{1,2}}) {_TIME}{_ZONE} (?P<y>\d{{4}})",
        rf"{_WEEKDAY}{_MONTH} (?P<d>\d{{1,2}})(?:st|nd|rd|th)?,? (?P<y>\d{{4}}),?(?: at)? {_TIME}{_ZONE}",
        rf"(?P<y>\d{{4}})(?P<n>\d{{2}})(?P<d>\d{{2}})T(?P<h>\d{{2}})(?P<m>\d{{2}})(?:(?P<s>\d{{2}})(?:[.,](?P<f>\d{{1,9}}))?)?{_ZONE}",
        rf"(?P<d>\d{{1,2}})\.(?P<n>\d{{1,2}})\.{_Y}(?:,? {_TIME})?{_ZONE}",
        rf"(?P<n>\d{{1,2}})/(?P<d>\d{{1,2}})/{_Y}(?:,? {_TIME})?{_ZONE}",
    )
)
_COMMENT, _BLANKS, _OFFSET = re.compile(r"\([^()]*\)"), re.compile(r"\s+"), re.compile(r"(?:utc|gmt)?([+-])(\d{1,2}):?(\d{2})?$")
#: Bare numbers, by their digits: (units, of so many microseconds, from so many microseconds after 1970).
_FROM_1601 = -11_644_473_600_000_000
COUNTS = {9: (1, 60_000_000, _FROM_1601), 10: (1, 1_000_000, 0), 13: (1, 1000, 0), 16: (1, 1, 0), 18: (10, 1, _FROM_1601), 19: (1000, 1, 0)}
#: The years that bare counts may lie in, and that zones' letters are taken from, unless others are asked for: the first and the last.
YEARS = (2023, 2025)
DAY_US = 86_400_000_000


@cache
def year_begins(year: int) -> int:
    """The first microsecond of a year in UTC."""
    return (date(year, 1, 1).toordinal() - 719_163) * DAY_US


@cache
def zone_of(name: str) -> ZoneInfo | None:
    """A zone by its name, without regard to case; null where there is none."""
    from zoneinfo import available_timezones

    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        known = {z.lower(): z for z in available_timezones()}
        return ZoneInfo(known[name.lower()]) if name.lower() in known else None


@cache
def letters_of(name: str, years: tuple[int, int] = YEARS) -> dict[str, int]:
    """The letters that a zone's clocks show in some years, in minutes from UTC."""
    zone, found = zone_of(name), {}
    for week in range(0, (years[1] - years[0] + 1) * 366, 7) if zone else ():
        at = (datetime(years[0], 1, 1, tzinfo=timezone.utc) + timedelta(days=week)).astimezone(zone)
        if at.tzname().isalpha():
            found[at.tzname().lower()] = int(at.utcoffset().total_seconds() // 60)
    return found


@lru_cache(maxsize=65536)
def _offset_at(zone: str, hours: int) -> int | None:
    """The zone's offset from UTC in microseconds at an instant, given in quarters of an hour since 1970."""
    z = zone_of(zone)
    return z and int((datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(minutes=15 * hours)).astimezone(z).utcoffset() / timedelta(microseconds=1))


def from_local(zone: str, local_us: int) -> int | None:
    """The instant of a local time; null if it occurs twice or never there, or nobody knows the zone."""
    quarter = 900_000_000
    offsets = {_offset_at(zone, (local_us + d) // quarter) for d in (-DAY_US, DAY_US)}
    found = [local_us - o for o in offsets if o is not None and _offset_at(zone, (local_us - o) // quarter) == o]
    return found[0] if len(found) == 1 else None


def instant(text: str | None, zone: str | None, years: tuple[int, int] = YEARS) -> int | None:
    """The microseconds since 1970 UTC that a text states, or null; ``zone`` is where it was written.

    Null, empty and unreadable texts, dates not in the calendar, zones nobody knows and local times
    that are ambiguous or don't exist give null. Parts not written are zero; fractions below a
    microsecond are cut. Dotted dates have the day first, slashed ones the month; two-digit years
    are 20xx; ``-0000`` is UTC. Letters mean what they mean in ``zone``, else in mail headers. Bare
    numbers count seconds, milliseconds, microseconds or nanoseconds since 1970, or 100 ns or
    minutes since 1601, by their digits, and are times only if these lie in ``years``.
    """
    if not text:
        return None
    text = _BLANKS.sub(" ", _COMMENT.sub(" ", text)).strip()
    if text.isdecimal():
        over, times, origin = COUNTS.get(len(text), (1, 0, 0))
        us = int(text) * times // over + origin
        return us if year_begins(years[0]) <= us < year_begins(years[1] + 1) else None
    for pattern in FORMATS:
        if m := pattern.fullmatch(text):
            break
    else:
        return None
    g = m.groupdict()
    month = int(g["n"]) if g.get("n") else _MONTH_NO.get(g["b"].lower())
    try:
        day = date(int(g["y"]) + 2000 * (len(g["y"]) == 2), month or 0, int(g["d"])).toordinal() - 719_163
    except ValueError:
        return None
    hour, minute, second = (int(g.get(k) or 0) for k in "hms")
    if half := (g.get("p") or "").lower():
        hour = hour % 12 + 12 * (half == "p") if 1 <= hour <= 12 else 99
    if hour > 23 or minute > 59 or second > 59:
        return None
    local = day * DAY_US + (hour * 3600 + minute * 60 + second) * 1_000_000 + int((g.get("f") or "0").ljust(6, "0")[:6])
    z = (g["z"] or "").lower()
    if not z:
        return from_local(zone, local) if zone else None
    if o := _OFFSET.match(z):
        minutes = int(o[2]) * 60 + int(o[3] or 0)
        return local - (1 if o[1] == "+" else -1) * minutes * 60_000_000 if int(o[2]) <= 15 and int(o[3] or 0) <= 59 else None
    if "/" in z:
        return from_local(g["z"], local)
    minutes = letters_of(zone, years).get(z) if zone else None
    if minutes is None:
        minutes = MAIL_ZONES.get(z, 0 if len(z) == 1 and z != "j" else None)
    return None if minutes is None else local - minutes * 60_000_000


def host_key(col: Column) -> Column:
    """A host without regard to case and final dot."""
    return F.regexp_replace(F.lower(F.trim(col)), r"\.$", "")


def source_zones(relays: DataFrame, host: str, zone: str) -> DataFrame:
    """(source, tz_name): one row a host. Null hosts and zones, and hosts listed with two zones, are left out."""
    return (
        relays.select(host_key(F.col(host)).alias("source"), F.col(zone).alias("tz_name")).filter("source is not null and tz_name is not null")
        .groupBy("source").agg(F.min("tz_name").alias("tz_name"), F.max("tz_name").alias("_other")).filter("tz_name = _other").drop("_other")
    )


def normalise(df: DataFrame, id_col: str, host: str, texts: list[Column], zones: DataFrame, years: tuple[int, int] = YEARS) -> DataFrame:
    """(id, utc_us) of each row with a text that states an instant; the first such text decides.

    ``zones`` comes from :func:`source_zones`. Rows of null or unknown hosts keep texts that carry a
    zone. Repeated rows give repeated results; an empty table gives an empty one. Only the id, the
    host and the texts are read; ``years`` are those of :func:`instant`. The lookup is broadcast by Spark only where it is known to be small.
    """

    @F.pandas_udf("long")
    def first_instant(zone: pd.Series, *parts: pd.Series) -> pd.Series:
        out = []
        for z, *row in zip(zone, *parts, strict=True):
            out.append(next((u for t in row if (u := instant(t, z, years)) is not None), None))
        return pd.Series(out, dtype="Int64")

    cols = [f"_t{i}" for i in range(len(texts))]
    rows = df.select(F.col(id_col), host_key(F.col(host)).alias("source"), *[x.alias(c) for x, c in zip(texts, cols, strict=True)])
    return rows.join(zones, "source", "left").select(id_col, first_instant("tz_name", *cols).alias("utc_us")).filter("utc_us is not null")


def after_last_semicolon(col: Column) -> Column:
    """The text after the last ``;``; null where there is none."""
    return F.when(F.contains(col, F.lit(";")), F.substring_index(col, ";", -1))
