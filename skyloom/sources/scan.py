"""Parquet scans, from strict to tolerant, and reports over a folder of files."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.schema import CRITICAL_COLUMNS
from skyloom.sources.records import declared_only, union_by_name
from skyloom.storage import as_uri, file_table, list_files, stage


class NoReadableFile(RuntimeError):
    """Every file of a tolerant scan failed."""


class UnreadableFiles(RuntimeError):
    """Some files of a folder cannot be read; ``files`` names them all."""

    def __init__(self, files: list[str]):
        super().__init__(f"{len(files)} files cannot be read: " + ", ".join(files))
        self.files = files


# Spark's error conditions that mark a file, or a clash of schemas between files.
SCHEMA_CLASH = ("CANNOT_MERGE_SCHEMAS", "FAILED_READ_FILE", "PARQUET_COLUMN_DATA_TYPE_MISMATCH")
FILE_FAULTS = (*SCHEMA_CLASH, "CANNOT_READ_FILE_FOOTER", "Illegal Parquet type")


def scan_strict(spark: SparkSession, path: str, file: str | None = None) -> DataFrame:
    """One schema for all files; ``file`` names a single one."""
    reader = spark.read.option("mergeSchema", "false")
    return reader.parquet(f"{path}/{file}" if file else path)


def scan_merged(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def _read_footers(batches):
    import pandas as pd
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    for batch in batches:
        rows = []
        for file in batch["file"]:
            try:
                store, where = fs.FileSystem.from_uri(as_uri(file))
                with store.open_input_file(where) as stream:
                    footer = pq.ParquetFile(stream)
                    nulls = _null_counts(footer.metadata)
                    rows += [(file, f.name, str(f.type), None, nulls.get(f.name)) for f in footer.schema_arrow]
            except Exception as error:  # an unreadable file is a finding, not a failure
                rows.append((file, None, None, str(error), None))
        found = pd.DataFrame(rows, columns=["file", "column", "type", "error", "null_count"])
        yield found.astype({"null_count": "Int64"})


def _null_counts(metadata) -> dict[str, int]:
    """Nulls of each plain column of a file, where all its row groups state them."""
    counts: dict[str, int | None] = {}
    for group in range(metadata.num_row_groups):
        for at in range(metadata.num_columns):
            chunk = metadata.row_group(group).column(at)
            stated = chunk.statistics.null_count if chunk.is_stats_set and chunk.statistics.has_null_count else None
            before = counts.get(chunk.path_in_schema, 0)
            counts[chunk.path_in_schema] = None if stated is None or before is None else before + stated
    return {name: n for name, n in counts.items() if n is not None}


def footers(spark: SparkSession, path: str) -> DataFrame:
    """(file, column, type, error, null_count), read by the executors, one row per file and column.
    Null counts come from the statistics of the row groups; null where a file has none."""
    return file_table(spark, list_files(spark, path)).mapInPandas(
        _read_footers, "file string, column string, type string, error string, null_count long"
    )


def scan_each(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Files of one schema read together, each schema cast to the declared types, files
    that cannot be opened skipped. Returns the union by column name and the skipped files.

    Only file names reach the driver; the plan grows with the distinct schemas.
    """
    layout = F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "column", "type"))), ",")
    per_file = footers(spark, path).groupBy("file").agg(F.max("error").alias("error"), layout.alias("layout"))
    skipped = sorted(r.file for r in per_file.filter("error is not null").select("file").collect())
    groups = per_file.filter("error is null").groupBy("layout").agg(F.collect_list("file").alias("files"))
    frames = [
        declared_only(spark.read.parquet(*sorted(r.files))) for r in groups.orderBy("layout").collect()
    ]
    if not frames:
        raise NoReadableFile(f"no parquet file under {path} could be read")
    return union_by_name(frames), skipped


def scan_records(spark: SparkSession, path: str, allow_unreadable: bool = False) -> DataFrame:
    """Strict scan; where footers differ, merged; where they clash, by schema group.

    A folder of which files cannot be read is refused with their names, unless the caller
    allows to go on with the others.
    """
    try:
        merged = scan_merged(spark, path)
        strict = scan_strict(spark, path)
        return strict if strict.schema == merged.schema else merged
    except (PySparkException, Py4JJavaError) as error:
        if not any(mark in str(error) for mark in FILE_FAULTS):
            raise
    records, skipped = scan_each(spark, path)
    if skipped and not allow_unreadable:
        raise UnreadableFiles(skipped)
    return records


def sample_head(df: DataFrame, n: int = 1000) -> DataFrame:
    return df.limit(n)


def schema_report(spark: SparkSession, path: str, columns=CRITICAL_COLUMNS) -> DataFrame:
    """Per file and critical column: stored type, null count, agreement with the first file.

    An unreadable file shows up with its error and no column.
    """
    found = footers(spark, path)
    name = F.regexp_extract("file", r"([^/]+)$", 1).alias("file")
    typed = found.filter(F.col("column").isin(*columns) | F.col("error").isNotNull())
    typed = stage(typed.select(F.col("file").alias("path"), name, "column", "type", "error", "null_count"), "footers")
    first = typed.filter("error is null").groupBy("column").agg(F.min_by("type", "file").alias("expected"))
    out = typed.join(first, "column", "left").withColumn(
        "consistent", F.col("error").isNull() & (F.col("type") == F.col("expected"))
    )
    columns_out = ["column", "file", "type", "error", "expected", "null_count", "consistent"]
    if typed.filter("error is null and null_count is null").isEmpty():
        return out.select(*columns_out)
    # Files without statistics have their nulls counted; the others are not read.
    df = scan_each(spark, path)[0]
    present = [c for c in columns if c in df.columns]
    lacking = typed.filter("error is null and null_count is null").select("file").distinct()
    counted = (
        df.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), *present)
        .join(lacking, "file", "left_semi")
        .groupBy("file")
        .agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in present])
        .unpivot("file", present, "column", "counted")
    )
    out = out.join(counted, ["file", "column"], "left")
    return out.withColumn("null_count", F.coalesce("null_count", "counted")).select(*columns_out)


def dataset_summary(records: DataFrame) -> DataFrame:
    """Rows, months, exact distinct carriers and airports of the whole table."""
    airports = records.select(F.explode(F.array("origin", "dest")).alias("a")).agg(
        F.count_distinct("a").alias("airports")
    )
    totals = records.agg(
        F.count("*").alias("total_flights"),
        F.count_distinct(F.date_format("flightdate", "yyyy-MM")).alias("months"),
        F.count_distinct("reporting_airline").alias("airlines"),
    )
    return totals.join(F.broadcast(airports))


def month_breakdown(records: DataFrame) -> DataFrame:
    return records.groupBy(F.date_format("flightdate", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("flights")
    )


def file_month_agreement(records: DataFrame) -> DataFrame:
    """Rows per file whose date lies in the month the file name states (`…_2025_07.parquet`)."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    month = F.regexp_extract("file", r"_([0-9]{4}_[0-9]{2})(?:[_.]|$)", 1)
    return (
        records.select(name.alias("file"), F.date_format("flightdate", "yyyy_MM").alias("m"))
        .groupBy("file", "m")
        .agg(F.count("*").alias("n"))
        .groupBy("file")
        .agg(
            F.sum("n").alias("rows"),
            F.sum(F.when(F.col("m") == month, F.col("n")).otherwise(0)).alias("rows_in_named_month"),
        )
    )
