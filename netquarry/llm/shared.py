"""Cutting lineage in the folder that all executors share, and joins that a hot key cannot slow."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOT = 1024
HOT_ROWS = 1000


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, from spark.checkpoint.dir or set on the context; only a local session may go without and gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = shared or tempfile.mkdtemp()
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def cut(df: DataFrame, made: list[str] | None = None) -> DataFrame:
    """df written once as Parquet to the shared checkpoint folder and read back from there: a lost executor recomputes nothing before it. The path is added to made, for drop."""
    spark = df.sparkSession
    path = f"{folder(spark)}/cut-{uuid.uuid4().hex}"
    if made is not None:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, column: str) -> str:
    """df written to the shared checkpoint folder with a folder for each value of an integer column; for of_value."""
    path = f"{folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.partitionBy(column).parquet(path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Deletes what a cut wrote, once nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def of_value(path: str, column: str, value: int) -> list[dict]:
    """In a task: the rows, without column, that cut_by wrote for one value, few enough for a task's memory."""
    at = f"{path}/{column}={value}"
    files, at = (pyarrow.fs.LocalFileSystem(), "/" + at.removeprefix("file:").lstrip("/")) if at.startswith(("file:", "/")) else pyarrow.fs.FileSystem.from_uri(at)
    found = files.get_file_info(pyarrow.fs.FileSelector(at, allow_not_found=True))
    return [r for f in sorted(f.path for f in found if f.base_name.endswith(".parquet")) for r in pyarrow.parquet.ParquetFile(files.open_input_file(f)).read().to_pylist()]


def hot_values(values: DataFrame, n: int) -> list:
    """Values of the one column of `values` that have at least HOT_ROWS of its n rows and 1 / HOT of them, so at most HOT."""
    if n < HOT_ROWS:
        return []
    name = values.columns[0]
    counts = values.groupBy(name).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= max(HOT_ROWS, n / HOT))
    return [r[0] for r in counts.where(F.col(name).isNotNull()).select(name).collect()]


def join_hot(left: DataFrame, right: DataFrame, on: str, hot: list, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row a value of `on`; right's rows of the hot values, HOT at most, are broadcast."""
    if not hot:
        return left.join(right, on, how)
    marked = F.col(on).isin(hot)
    cold = left.where(~F.coalesce(marked, F.lit(False))).join(right.where(~marked), on, how)
    return cold.unionByName(left.where(marked).join(F.broadcast(right.where(marked)), on, how))
