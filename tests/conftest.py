import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from skyloom.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "tests",
        "local[8]",
        {
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


LEG_DDL = (
    "flightdate date, reporting_airline string, flight_number_reporting_airline bigint, origin string, "
    "dest string, scheduled_departure_time timestamp_ntz, scheduled_arrival_time timestamp_ntz, "
    "scheduled_duration_minutes int"
)

DAY = dt.date(2025, 7, 18)


def clock(text, day=DAY, plus=0):
    hour, minute = map(int, text.split(":"))
    return dt.datetime.combine(day, dt.time(hour, minute)) + dt.timedelta(days=plus)


def loaded_leg(carrier, number, origin, dest, dep, block, offsets, day=DAY):
    """A leg as loaded: the arrival clock is right, its date is the departure date."""
    if dep is None:
        return (day, carrier, number, origin, dest, None, None, block)
    departs = clock(dep, day)
    arrives = None
    if block is not None:
        real = departs + dt.timedelta(minutes=block + offsets[dest] - offsets[origin])
        arrives = dt.datetime.combine(day, real.time())
    return (day, carrier, number, origin, dest, departs, arrives, block)


@pytest.fixture
def make_legs(spark):
    """Legs with UTC times from (carrier, number, origin, dest, dep, block[, day]) rows."""
    from skyloom.operators.offsets import utc_times

    def make(rows, offsets):
        loaded = spark.createDataFrame(
            [loaded_leg(*r[:6], offsets, *(r[6:7] or (DAY,))) for r in rows], LEG_DDL
        )
        days = sorted({r[6] if len(r) > 6 else DAY for r in rows})
        table = spark.createDataFrame(
            [(d, a, o) for d in days for a, o in offsets.items()],
            "flightdate date, airport string, offset_minutes int",
        )
        return utc_times(loaded, table)

    return make
