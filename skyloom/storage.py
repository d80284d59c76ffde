"""Stage tables: written once to the shared folder, read back by later jobs.

A written table cuts the lineage, survives lost executors and keeps Parquet's column
pruning and filter pushdown, which a row checkpoint does not.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="skyloom-"))
    return _local_root[0]


def stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` under the shared folder and return the stored table."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_root(spark)}/skyloom/{app}/{name}-{uuid.uuid4().hex[:12]}"
    if partition_by:
        # REBALANCE gives each date a few well-sized files and splits a hot date.
        df.hint("rebalance", partition_by).write.partitionBy(partition_by).parquet(path)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(table: DataFrame) -> None:
    """Remove a stage table that nothing will read any more; only tables of ``stage`` are removed."""
    spark = table.sparkSession
    own = f"/skyloom/{spark.sparkContext.applicationId}/"
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if own in folder:
            drop_path(spark, folder)


def clear_stages(spark: SparkSession) -> None:
    """Remove the stage tables of this application; none of its results may be read after."""
    drop_path(spark, f"{shared_root(spark)}/skyloom/{spark.sparkContext.applicationId}")


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def drop_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def move_path(spark: SparkSession, source: str, target: str) -> None:
    """Rename; an existing ``target`` is replaced."""
    drop_path(spark, target)
    hadoop = spark._jvm.org.apache.hadoop.fs
    old, new = hadoop.Path(source), hadoop.Path(target)
    store = old.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(new.getParent())
    if not store.rename(old, new):
        raise OSError(f"cannot move {source} to {target}")


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the partition folders of a stored table."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)
    return sorted(s.getPath().getName() for s in found if s.isDirectory() and "=" in s.getPath().getName())


def list_files(spark: SparkSession, path: str, pattern: str = "*.parquet") -> list[str]:
    """Names of the data files, from the file listing only; no data is read."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path if path.endswith(pattern.lstrip("*")) else f"{path}/{pattern}")
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    paths = [s.getPath() for s in (found or [])]
    return sorted(p.toString() for p in paths if not p.getName().startswith(("_", ".")))


def file_table(spark: SparkSession, files: list[str]) -> DataFrame:
    """File names as rows, spread over tasks that each open a few."""
    slices = max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame([(f,) for f in files], "file string").repartition(slices)


def as_uri(file: str) -> str:
    return file.replace("file:/", "file:///", 1) if file.startswith("file:/") else file
