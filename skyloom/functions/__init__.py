from skyloom.functions.codes import carrier_family, flight_label, leg_id
from skyloom.functions.times import (
    at_time,
    date_text,
    hhmm_to_time,
    iso,
    minutes_between,
    shift_minutes,
    strict_date,
    wrap_offset,
)

__all__ = [
    "at_time",
    "carrier_family",
    "date_text",
    "flight_label",
    "hhmm_to_time",
    "iso",
    "leg_id",
    "minutes_between",
    "shift_minutes",
    "strict_date",
    "wrap_offset",
]
