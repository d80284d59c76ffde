"""Declared schemas, keys and fixed policy values."""

from __future__ import annotations

from pyspark.sql import types as T

# Declared column types of a monthly on-time file, in file-map order.
RECORD_TYPES = {
    "year": "int",
    "quarter": "int",
    "month": "int",
    "dayofmonth": "int",
    "dayofweek": "int",
    "flight_number_reporting_airline": "bigint",
    "dot_id_reporting_airline": "bigint",
    "reporting_airline": "string",
    "iata_code_reporting_airline": "string",
    "tail_number": "string",
    "origin": "string",
    "dest": "string",
    "originairportid": "bigint",
    "originairportseqid": "bigint",
    "destairportid": "bigint",
    "destairportseqid": "bigint",
    "origincitymarketid": "bigint",
    "destcitymarketid": "bigint",
    "origincityname": "string",
    "destcityname": "string",
    "originstate": "string",
    "deststate": "string",
    "originstatename": "string",
    "deststatename": "string",
    "originstatefips": "bigint",
    "deststatefips": "bigint",
    "originwac": "bigint",
    "destwac": "bigint",
    "flightdate": "date",
    "crsdeptime": "hhmm",
    "deptime": "hhmm",
    "crsarrtime": "hhmm",
    "arrtime": "hhmm",
    "wheelsoff": "hhmm",
    "wheelson": "hhmm",
    "firstdeptime": "hhmm",
    "deptimeblk": "string",
    "arrtimeblk": "string",
    "crselapsedtime": "double",
    "actualelapsedtime": "double",
    "airtime": "double",
    "flights": "double",
    "distance": "double",
    "distancegroup": "bigint",
    "depdelay": "double",
    "depdelayminutes": "double",
    "depdel15": "double",
    "departuredelaygroups": "double",
    "arrdelay": "double",
    "arrdelayminutes": "double",
    "arrdel15": "double",
    "arrivaldelaygroups": "double",
    "carrierdelay": "double",
    "weatherdelay": "double",
    "nasdelay": "double",
    "securitydelay": "double",
    "lateaircraftdelay": "double",
    "taxiout": "double",
    "taxiin": "double",
    "cancelled": "double",
    "cancellationcode": "string",
    "diverted": "double",
    "divreacheddest": "double",
    "divactualelapsedtime": "double",
    "divarrdelay": "double",
    "divdistance": "double",
    "divairportlandings": "bigint",
    **{
        f"div{n}{field}": "string" if field in ("airport", "tailnum") else "double"
        for n in range(1, 6)
        for field in (
            "airport",
            "airportid",
            "airportseqid",
            "wheelson",
            "wheelsoff",
            "totalgtime",
            "longestgtime",
            "tailnum",
        )
    },
    "totaladdgtime": "double",
    "longestaddgtime": "double",
    "unnamed:_109": "double",
}

STORED_TYPES = {"date": "timestamp_ntz", "hhmm": "timestamp_ntz"}

# Rows without these ids are dropped on ingest.
REQUIRED_IDS = ("flight_number_reporting_airline", "dot_id_reporting_airline")

# Columns whose stored type must agree between files.
CRITICAL_COLUMNS = ("flight_number_reporting_airline", "div2tailnum")

LEG_KEY = (
    "flightdate",
    "reporting_airline",
    "flight_number_reporting_airline",
    "origin",
    "dest",
)

# Regionals sold only under one parent's code. SkyWest (OO), Republic
# (YX) and Mesa (YV) fly for several parents and are left out on purpose.
CARRIER_FAMILY = {
    "MQ": "AA",
    "OH": "AA",
    "PT": "AA",
    "9E": "DL",
    "QX": "AS",
}

# Carriers whose marketing parent cannot be known from the file.
AMBIGUOUS_CARRIERS = ("OO", "YX")

# Fixed value: Phoenix keeps UTC-7 all year, so it pins the offset solve.
OFFSET_ANCHOR = ("PHX", -420)

MIN_LAYOVER = 45
MAX_LAYOVER = 300
STRONG_PAIR_FLIGHTS = 3

DEFAULT_MAX_STOPS = 2
DEFAULT_LIMIT = 20
SERVED_MAX_STOPS = 3
SERVED_MAX_LIMIT = 100


def record_schema(columns=None) -> T.StructType:
    """Stored schema of a monthly file, restricted to ``columns`` if given."""
    wanted = RECORD_TYPES if columns is None else {c: RECORD_TYPES[c] for c in RECORD_TYPES if c in columns}
    ddl = ", ".join(f"`{c}` {STORED_TYPES.get(t, t)}" for c, t in wanted.items())
    return T.StructType.fromDDL(ddl)
