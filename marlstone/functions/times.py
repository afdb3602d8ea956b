"""Event times and recurrent weekly windows.  The session's time zone has to be UTC."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.text import is_blank, number, strip

_ISO = r"^\d{4}-\d{2}-\d{2}([T_ ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"
DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")


def iso_time(c: Column, zone: str = "UTC") -> Column:
    """A time with an offset, or a local one of the zone; null for other text."""
    text = F.upper(strip(c))
    text = F.regexp_replace(F.when(text.rlike(_ISO), text), "[T_]", " ")
    local = F.to_utc_timestamp(text.try_cast("timestamp"), zone)
    return F.when(text.rlike(r"(Z|[+-]\d{2}:\d{2})$") & (F.length(text) > 10), text.try_cast("timestamp")).otherwise(local)


def epoch_time(c: Column) -> Column:
    """Seconds since 1970, with a fraction; null for negative or other text."""
    seconds = number(c)
    return F.when((seconds >= 0) & (seconds < 253402300800), F.timestamp_micros(F.round(seconds * 1_000_000).cast("bigint")))


def event_time(epoch: Column | None, iso: Column | None, zone: str = "UTC", tolerance: float = 1.0) -> tuple[Column, Column]:
    """(time, issue): the epoch wins; issue is null, INVALID or CONFLICT (they differ by more than the tolerance)."""
    a = epoch_time(epoch) if epoch is not None else None
    b = iso_time(iso, zone) if iso is not None else None
    if a is None and b is None:
        return F.lit(None).cast("timestamp"), F.lit("INVALID")
    if a is None or b is None:
        one = a if b is None else b
        return one, F.when(one.isNull(), "INVALID")
    apart = F.abs(F.unix_micros(a) - F.unix_micros(b)) > int(tolerance * 1_000_000)
    issue = F.when(a.isNull() | b.isNull(), "INVALID").when(apart, "CONFLICT")
    return F.when(issue.isNull(), a), issue


def context_time(epoch: Column | None, iso: Column | None, tolerance: float = 1.0) -> tuple[Column, Column]:
    """As ``event_time``, but a blank value counts as not given; MISSING when neither is."""
    none = F.lit(None).cast("string")
    e, i = (none if c is None else c.cast("string") for c in (epoch, iso))
    a, b, no_e, no_i = epoch_time(e), iso_time(i), is_blank(e), is_blank(i)
    apart = F.abs(F.unix_micros(a) - F.unix_micros(b)) > int(tolerance * 1_000_000)
    issue = F.when(no_e & no_i, "MISSING").when((~no_e & a.isNull()) | (~no_i & b.isNull()), "INVALID").when(apart, "CONFLICT")
    return F.when(issue.isNull(), F.coalesce(a, b)), issue


@dataclass(frozen=True)
class Weekly:
    """Minutes of certain weekdays, both ends included; it may run past midnight."""

    days: tuple[str, ...]
    start: str
    end: str
    zone: str = "UTC"

    @staticmethod
    def minutes(text: str) -> int:
        h, m = text.split(":")
        return int(h) * 60 + int(m)

    def contains(self, time: Column) -> Column:
        local = F.from_utc_timestamp(time, self.zone)
        at, low, high = F.hour(local) * 60 + F.minute(local), self.minutes(self.start), self.minutes(self.end)
        days = [DAYS.index(d[:3].lower()) for d in self.days]
        today = F.weekday(local).isin(days)
        if low <= high:
            return today & at.between(low, high)
        return (today & (at >= low)) | (F.weekday(local).isin([(d + 1) % 7 for d in days]) & (at <= high))
