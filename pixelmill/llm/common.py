"""Shared helpers: the folder that driver and executors share, and table access."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or set on the context; one of this machine only for a local master."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _OWN:
            made = tempfile.mkdtemp(prefix="pixelmill-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            _OWN[context.applicationId] = f"file://{made}"
        found = _OWN[context.applicationId]
    return found.rstrip("/")


class Scratch:
    """Tables written under the shared folder, which cut lineage and survive lost executors.

    What is not dropped earlier goes when the driver's JVM ends, as results are lazy and may read it until then.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        fs, at = hadoop(spark, self.root)
        fs.mkdirs(at)
        fs.deleteOnExit(at)

    def path(self, tag: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{tag}"

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        """Write df and return it as read back from storage."""
        at = self.path(tag)
        df.write.option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch_path = at
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a table of this object that nothing will read again."""
        delete(self.spark, df._scratch_path)

    def close(self) -> None:
        delete(self.spark, self.root)


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path of any store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    fs.delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that text operators read; a null text is an empty one."""
    return df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))


def with_length(df: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """df with the length of its text brought up to date, if it has a column for it."""
    if length_col not in df.columns:
        return df
    return df.withColumn(length_col, F.coalesce(F.length(text_col), F.lit(0)).cast(df.schema[length_col].dataType))


#: Rows that a Python operator turns into Python objects at once.
SLICE = 512


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches cut into small ones, so that long texts don't fill a worker's memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_rows(df: DataFrame, rows_of: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = SLICE) -> DataFrame:
    """mapInArrow with one small batch in and one out."""

    def run(batches):
        for part in slices(batches, rows):
            yield rows_of(part)

    return df.mapInArrow(run, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
