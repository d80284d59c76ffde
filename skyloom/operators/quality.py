"""Data-quality rules as column expressions, one report job, one violations table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.times import hhmm_to_time, strict_date
from skyloom.schema import LEG_KEY

COMPLETE = 0.95


def _c(column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def carrier_code(column, lenient: bool = False) -> Column:
    """Two upper-case letters or digits, one letter at least; lenient ignores case."""
    code = F.upper(_c(column)) if lenient else _c(column)
    return code.rlike("^[A-Z0-9]{2}$") & code.rlike("[A-Z]")


def airport_code(column, lenient: bool = False) -> Column:
    """Three upper-case letters; lenient takes letters and digits of any case."""
    return F.upper(_c(column)).rlike("^[A-Z0-9]{3}$") if lenient else _c(column).rlike("^[A-Z]{3}$")


def flight_number(column, allow_zero: bool = False) -> Column:
    text = _c(column).cast("string")
    number = F.when(text.rlike("^[0-9]{1,4}$"), text.cast("int"))
    return F.coalesce(number >= (0 if allow_zero else 1), F.lit(False))


def present(column) -> Column:
    c = _c(column)
    return c.isNotNull() & (F.trim(c.cast("string")) != "")


def different_ends(origin="origin", dest="dest") -> Column:
    return _c(origin) != _c(dest)


def cancelled_flag(column="cancelled") -> Column:
    return F.coalesce(_c(column).cast("string").try_cast("double").isin(0.0, 1.0), F.lit(False))


def cancelled_agrees(cancelled="cancelled", dep="deptime", arr="arrtime") -> Column:
    """A cancelled flight has neither time, any other has both."""
    none = _c(dep).isNull() & _c(arr).isNull()
    both = _c(dep).isNotNull() & _c(arr).isNotNull()
    return F.when(_c(cancelled) == 1, none).otherwise(both)


def distance_range(column="distance", strict: bool = True) -> Column:
    return _c(column).between(50, 10_000) if strict else _c(column) > 0


def delay_range(column) -> Column:
    return _c(column).isNull() | _c(column).between(-30, 720)


def hhmm_text(column) -> Column:
    return hhmm_to_time(column).isNotNull()


def date_text_valid(column) -> Column:
    return F.coalesce(F.year(strict_date(column)).between(1987, 2030), F.lit(False))


def date_in_era(column) -> Column:
    return F.year(_c(column)).between(1987, 2030)


def _minute_of_day(ts) -> Column:
    return F.hour(_c(ts)) * 60 + F.minute(_c(ts))


def same_day_sequence(dep, arr) -> Column:
    return (_minute_of_day(arr) - _minute_of_day(dep)).between(30, 720)


def overnight_sequence(dep, arr) -> Column:
    return F.pmod(_minute_of_day(arr) - _minute_of_day(dep), F.lit(1440)).between(60, 480)


def plausible_duration(dep, arr) -> Column:
    """Three quarters of an hour to eight hours after a wrap at midnight."""
    return F.pmod(_minute_of_day(arr) - _minute_of_day(dep), F.lit(1440)).between(45, 480)


def clock_order(dep, arr) -> Column:
    """Times differ, and a flight past midnight takes less than 18 hours."""
    gap = _minute_of_day(arr) - _minute_of_day(dep)
    return (gap > 0) | ((gap < 0) & (gap + 1440 < 18 * 60))


def layover_range(column) -> Column:
    return _c(column).between(45, 300)


def overnight_layover_range(column) -> Column:
    return _c(column).between(120, 600)


def speed_range(distance, minutes) -> Column:
    """Block speed by distance band, and the least time of very short and very long legs."""
    miles, mins = _c(distance), _c(minutes)
    mph = F.try_divide(miles, mins) * 60
    low = F.when(miles < 300, 100).when(miles < 1000, 150).otherwise(200)
    long_enough = F.when(miles > 2000, mins >= 240).when(miles < 500, mins >= 45).otherwise(F.lit(True))
    return (mins > 0) & mph.between(low, F.lit(700)) & long_enough


def whole_number(column) -> Column:
    """Numeric text of an integer field; blanks, 'N/A', 'NULL' and fractions are not."""
    text = F.trim(_c(column).cast("string"))
    return F.when(text.rlike("^-?[0-9]+$"), text.try_cast("bigint"))


def decimal_number(column) -> Column:
    text = F.trim(_c(column).cast("string"))
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))


def reference_row(code: Column, name, fields, shortest_name: int) -> Column:
    """A reference row (airport, airline): fields present, code well formed, name not too short."""
    ok = code & (F.length(F.trim(_c(name))) > shortest_name)
    for field in fields:
        ok = ok & present(field)
    return F.coalesce(ok, F.lit(False))


def airport_row(code="code", name="name", fields=("city", "state", "country")) -> Column:
    return reference_row(airport_code(code), name, (code, name, *fields), 5)


def airline_row(code="code", name="name", fields=("country",)) -> Column:
    return reference_row(carrier_code(code), name, (code, name, *fields), 3)


def record_rules() -> dict[str, Column]:
    """Rules for typed records. A null result counts as failed."""
    times = ("crsdeptime", "crsarrtime")
    return {
        "carrier_code": carrier_code("reporting_airline"),
        "carrier_code_lenient": carrier_code("reporting_airline", lenient=True),
        "origin_code": airport_code("origin"),
        "dest_code": airport_code("dest"),
        "airport_code_lenient": airport_code("origin", lenient=True) & airport_code("dest", lenient=True),
        "flight_number": flight_number("flight_number_reporting_airline"),
        "required_fields": _all(present(c) for c in LEG_KEY),
        "different_ends": different_ends(),
        "cancelled_flag": cancelled_flag(),
        "cancelled_agrees": cancelled_agrees(),
        "distance_positive": distance_range(strict=False),
        "distance_range": distance_range(),
        "departure_delay": delay_range("depdelay"),
        "arrival_delay": delay_range("arrdelay"),
        "date_in_era": date_in_era("flightdate"),
        "same_day_sequence": same_day_sequence(*times),
        "overnight_sequence": overnight_sequence(*times),
        "plausible_duration": plausible_duration(*times),
        "clock_order": clock_order(*times),
        "speed_range": speed_range("distance", "crselapsedtime"),
    }


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def quality_report(df: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """(rule, checked, failed, ratio) for all rules in one pass over the table."""
    rules = record_rules() if rules is None else rules
    failed = df.agg(
        F.count("*").alias("checked"),
        *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()],
    )
    report = failed.unpivot("checked", list(rules), "rule", "failed")
    return report.select(
        "rule", "checked", "failed", F.when(F.col("checked") > 0, F.col("failed") / F.col("checked")).alias("ratio")
    )


def violations(df: DataFrame, rules: dict[str, Column] | None = None, key=LEG_KEY) -> DataFrame:
    """One row per record and broken rule."""
    rules = record_rules() if rules is None else rules
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    )
    return df.select(*key, F.explode(broken).alias("rule"))


def duplicate_keys(df: DataFrame, key=LEG_KEY) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


def completeness(df: DataFrame, columns=None, threshold: float = COMPLETE) -> DataFrame:
    """Share of non-null cells per column, all columns in one pass."""
    columns = list(columns or df.columns)
    counts = df.agg(F.count("*").alias("rows"), *[F.count(c).alias(c) for c in columns])
    out = counts.unpivot("rows", columns, "column", "filled")
    ratio = F.when(F.col("rows") > 0, F.col("filled") / F.col("rows"))
    return out.select("column", "rows", "filled", ratio.alias("ratio"), (ratio >= threshold).alias("complete"))


def temporal_types(df: DataFrame) -> list[tuple[str, str]]:
    """Date and time columns of a leg table that are not natively typed. From the schema only."""
    expected = {c: "timestamp_ntz" for c in df.columns if c.startswith("scheduled_") and "duration" not in c}
    expected |= {c: "timestamp_ntz" for c in df.columns if c.startswith("actual_") and "duration" not in c}
    expected |= {"flightdate": "date"} if "flightdate" in df.columns else {}
    return [(c, df.schema[c].dataType.simpleString()) for c, t in expected.items() if df.schema[c].dataType.simpleString() != t]
