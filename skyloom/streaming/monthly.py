"""Incremental load: pick up month files that were not loaded yet.

The stream's checkpoint remembers the files, so a month is read once; the sink merges by
key, so a batch that is retried after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyloom.jobs import add_records
from skyloom.operators.legs import project_legs, valid_legs
from skyloom.sources.records import type_records
from skyloom.sources.tables import upsert_legs


def load_new_files(
    spark: SparkSession, source: str, columns: list[str], target: str, checkpoint: str, strict: bool = False
) -> None:
    """Load every CSV month file under ``source`` not seen before into the leg table.

    ``columns`` is the header of the files. Runs until no file is left, then stops.
    """
    _each_batch(spark, source, columns, checkpoint, lambda records: upsert_legs(project_legs(valid_legs(records, strict)), target))


def keep_loaded(
    spark: SparkSession, source: str, columns: list[str], root: str, checkpoint: str, strict: bool = False
) -> None:
    """The same into the tables of ``skyloom.jobs``: cancelled legs, airports, carriers and routes follow,
    and the dates touched are refused by a search until they are solved and connected again."""
    _each_batch(spark, source, columns, checkpoint, lambda records: add_records(spark, records, root, strict))


def _each_batch(spark: SparkSession, source: str, columns: list[str], checkpoint: str, load) -> None:
    schema = ", ".join(f"`{c}` string" for c in columns)
    # Header names are compared with ``columns``: a file laid out differently fails the
    # batch instead of filling the wrong columns.
    text = spark.readStream.schema(schema).option("header", True).option("enforceSchema", False).csv(source)
    query = (
        text.writeStream.foreachBatch(lambda batch, _epoch: load(type_records(batch)))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
