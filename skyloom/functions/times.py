"""Column expressions on zone-less times. Minutes are whole and truncated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 1440


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hhmm_to_time(text) -> Column:
    """'0930' -> 1900-01-01 09:30 without zone; anything else, 2400 included, -> null."""
    text = _col(text)
    good = text.rlike("^([01][0-9]|2[0-3])[0-5][0-9]$")
    hour = F.when(good, F.substring(text, 1, 2).cast("int"))
    minute = F.when(good, F.substring(text, 3, 2).cast("int"))
    return F.make_timestamp_ntz(F.lit(1900), F.lit(1), F.lit(1), hour, minute, F.lit(0))


def strict_date(text) -> Column:
    """'2025-07-18' -> date; other shapes and impossible days -> null."""
    text = _col(text)
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def at_time(day, clock) -> Column:
    """The clock reading of ``clock`` on the calendar day ``day``; null if either is."""
    day, clock = _col(day), _col(clock)
    return F.make_timestamp_ntz(
        F.year(day), F.month(day), F.dayofmonth(day), F.hour(clock), F.minute(clock), F.second(clock)
    )


def minutes_between(start, end) -> Column:
    return F.timestamp_diff("MINUTE", _col(start), _col(end)).cast("int")


def shift_minutes(ts, minutes) -> Column:
    return F.timestamp_add("MINUTE", _col(minutes), _col(ts))


def epoch_minute(ts) -> Column:
    """Minutes since 1970 of a zone-less time, rounded down."""
    # Of a zone-less time these are its own seconds, whatever the session's zone; a time difference
    # would make two calendar dates of every row.
    return F.floor(F.unix_timestamp(_col(ts)) / 60)


def wrap_offset(minutes) -> Column:
    """Fold onto (-720, 720], so a dateline station reads +600 and not -840."""
    folded = F.pmod(_col(minutes), F.lit(DAY))
    return F.when(folded > DAY // 2, folded - DAY).otherwise(folded)


def iso(ts) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss")


def date_text(day) -> Column:
    return F.date_format(_col(day), "yyyy-MM-dd")
