"""Dates and windows. Every window takes the time it looks back from."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

_FORMATS = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "d MMM yyyy HH:mm:ss XX", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss", "d MMM yyyy", "MMM d, yyyy"]


def parse(text: Column) -> Column:
    """A timestamp of the usual feed formats (a weekday before is dropped; without a zone: UTC); null if none fits."""
    t = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},\s*", "")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in _FORMATS])


def standardize(text: Column) -> Column:
    """yyyy-MM-dd HH:mm in UTC, '' if it can't be read."""
    return F.coalesce(F.date_format(parse(text), "yyyy-MM-dd HH:mm"), F.lit(""))


def _at(as_of: datetime | str) -> Column:
    return F.lit(str(as_of)).cast("timestamp_ntz")


def closed(ts: Column, as_of: datetime | str, days: int) -> Column:
    """as_of - days <= ts <= as_of."""
    end = _at(as_of)
    return ts.cast("timestamp_ntz").between(end - F.make_dt_interval(F.lit(days)), end)


def half_open(ts: Column, as_of: datetime | str, days: int) -> Column:
    """as_of - days <= ts, later rows too."""
    return ts.cast("timestamp_ntz") >= _at(as_of) - F.make_dt_interval(F.lit(days))


def preset(ts: Column, as_of: datetime | str, name: str, start: str | None = None, end: str | None = None) -> Column:
    """By date: last_30, last_90, ytd, all or custom (its ends in either order)."""
    day, today = F.to_date(ts), F.to_date(_at(as_of))
    if name == "all":
        return F.lit(True)
    if name == "ytd":
        return day.between(F.trunc(today, "YEAR"), today)
    if name == "custom":
        a, b = sorted([start, end])
        return day.between(F.lit(a).cast("date"), F.lit(b).cast("date"))
    return day.between(F.date_sub(today, {"last_30": 30, "last_90": 90}[name]), today)
