"""Spark session with the settings whose values change results, plus AQE."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Zone-less times must stay zone-less, and text must never be cast in a machine's
# own zone. Everything else is left to Spark's defaults and to the cluster.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
    "spark.sql.timestampType": "TIMESTAMP_LTZ",
}

# Stage tables are dictionary-encoded Parquet: in memory a row takes about eight times its
# place on disk. Without the factor Spark takes a 10 MB file for a 10 MB hash table and
# broadcasts through the driver what it had better shuffle.
SCALE_CONF = {
    "spark.sql.sources.fileCompressionFactor": "8.0",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_session(app_name: str = "skyloom", master: str | None = None, conf: dict | None = None):
    """Build or fetch a session; ``conf`` wins over the defaults here."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SCALE_CONF, **(conf or {}), **SEMANTIC_CONF}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
