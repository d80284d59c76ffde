"""Carrier codes and leg identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.schema import CARRIER_FAMILY


def carrier_family(code, family: dict | None = None) -> Column:
    """Parent code of a wholly-owned regional, else the code itself."""
    code = F.col(code) if isinstance(code, str) else code
    family = CARRIER_FAMILY if family is None else family
    if not family:
        return code
    pairs = [F.lit(x) for item in family.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), code)


def flight_label(prefix: str = "") -> Column:
    return F.concat(
        F.col(f"{prefix}reporting_airline"),
        F.col(f"{prefix}flight_number_reporting_airline").cast("string"),
    )


def leg_id() -> Column:
    """Exact text key of a leg within its date: carrier|number|origin|dest.

    A 64-bit hash would be shorter but collides at the row counts of one hot date.
    """
    return F.concat_ws(
        "|",
        "reporting_airline",
        F.col("flight_number_reporting_airline").cast("string"),
        "origin",
        "dest",
    )
