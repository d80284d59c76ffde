"""Monthly on-time CSV files -> typed records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.functions.times import hhmm_to_time, strict_date
from skyloom.schema import RECORD_TYPES, REQUIRED_IDS, record_schema
from skyloom.storage import as_uri, file_table, list_files, path_exists


def normalise_names(df: DataFrame) -> DataFrame:
    """Lower-case column names, blanks to underscores."""
    return df.toDF(*[c.lower().replace(" ", "_") for c in df.columns])


def convert(column: str, declared: str) -> Column:
    """Text column -> declared type; what does not parse becomes null."""
    text = F.trim(F.col(column))
    if declared == "string":
        return F.col(column)
    if declared == "hhmm":
        return hhmm_to_time(text)
    if declared == "date":
        return strict_date(text).cast("timestamp_ntz")
    if declared == "double":
        return text.try_cast("double")
    # Ids arrive as '12' or '12.0'; a real fraction is not an id.
    whole = F.regexp_replace(text, r"\.0+$", "")
    return F.when(whole.rlike("^-?[0-9]+$"), whole.try_cast(declared))


def type_records(text_df: DataFrame) -> DataFrame:
    """Apply the declared types, then drop rows lacking a required id.

    Columns outside the map pass through; declared columns not in the file stay absent.
    """
    df = normalise_names(text_df)
    df = df.select(
        *[convert(c, RECORD_TYPES[c]).alias(c) if c in RECORD_TYPES else F.col(c) for c in df.columns]
    )
    required = [c for c in REQUIRED_IDS if c in df.columns]
    return df.dropna(subset=required) if required else df


def _read_headers(batches):
    import pandas as pd
    import pyarrow.fs as fs

    for batch in batches:
        rows = []
        for file in batch["file"]:
            store, where = fs.FileSystem.from_uri(as_uri(file))
            with store.open_input_stream(where) as stream:
                rows.append((file, _first_line(stream)))
        yield pd.DataFrame(rows, columns=["file", "header"])


def _first_line(stream) -> str:
    text = b""
    while b"\n" not in text and (block := stream.read(65536)):
        text += block
    return text.split(b"\n", 1)[0].decode("utf-8", "replace").strip()


def _text_frames(spark: SparkSession, path: str) -> list[DataFrame]:
    """Every cell of the CSV files as text, a frame for each distinct header.

    Spark matches a folder's files by position to the first header it meets. Months whose
    header differs are therefore read apart, one scan per distinct header.
    """
    files = list_files(spark, path, "*.csv")
    headers = file_table(spark, files).mapInPandas(_read_headers, "file string, header string")
    groups = headers.groupBy("header").agg(F.collect_list("file").alias("files")).orderBy("header").collect()
    reader = spark.read.option("header", True).option("escape", '"')
    if not groups:
        raise FileNotFoundError(f"no CSV file under {path}")
    return [normalise_names(reader.csv(sorted(g.files))) for g in groups]


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every cell of the CSV files as text, matched by column name."""
    return union_by_name(_text_frames(spark, path))


def read_records_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read every cell as text (no inference pass over the data) and type it.

    Each header is typed by itself: a required id that some files don't have is no reason to
    drop their rows."""
    return union_by_name([type_records(frame) for frame in _text_frames(spark, path)])


def conversion_losses(text_df: DataFrame) -> DataFrame:
    """Per column: cells that held text but did not convert (the ingest warning)."""
    df = normalise_names(text_df)
    typed = [c for c in df.columns if RECORD_TYPES.get(c, "string") != "string"]
    lost = df.agg(
        *[
            F.count_if(
                F.col(c).isNotNull() & (F.trim(F.col(c)) != "") & convert(c, RECORD_TYPES[c]).isNull()
            ).alias(c)
            for c in typed
        ]
    )
    return lost.unpivot([], typed, "column", "lost_cells")


def declared_only(df: DataFrame) -> DataFrame:
    """Keep the declared columns that are present, in declared order and stored type."""
    schema = record_schema([c for c in df.columns if c in RECORD_TYPES])
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def widen_types(df: DataFrame) -> DataFrame:
    """Types for a file without a declared map: long, double, zone-less time or text."""

    def widened(field: T.StructField) -> Column:
        c = F.col(field.name)
        if isinstance(field.dataType, T.IntegralType):
            return c.cast("bigint")
        if isinstance(field.dataType, (T.FractionalType, T.DecimalType)):
            return c.cast("double")
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return c.cast("timestamp_ntz")
        return c.cast("string")

    return df.select(*[widened(f).alias(f.name) for f in df.schema.fields])


def write_records(df: DataFrame, path: str, declared: bool = True, mode: str = "overwrite") -> None:
    """Typed snappy Parquet, by the declared map or by the widened own types."""
    out = declared_only(df) if declared else widen_types(df)
    out.write.mode(mode).option("compression", "snappy").parquet(path)


def new_months(records: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Rows of (year, month) groups that the stored table does not hold yet.

    The stored months are a row for each month of the calendar and go to the tasks: dealt out by
    month, all records of a month would meet in one task.
    """
    if stored is None:
        return records
    months = stored.select("year", "month").distinct()
    return records.join(F.broadcast(months), ["year", "month"], "left_anti")


def append_new_months(records: DataFrame, path: str) -> None:
    """Write only the months not yet under ``path``; a repeated run adds nothing."""
    spark = records.sparkSession
    stored = spark.read.parquet(path) if path_exists(spark, path) else None
    new_months(declared_only(records), stored).write.mode("append").partitionBy("year", "month").parquet(path)


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
