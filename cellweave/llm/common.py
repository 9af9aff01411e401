"""Shared helpers of the training-data operators: shared-folder tables, Arrow batches and byte rules."""

from __future__ import annotations

import os
import posixpath
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.core import shuffles_released

#: The ASCII blanks of every contract of this subpackage, [\x20\x09-\x0D]; bytes.split() without arguments splits at exactly these.
BLANKS = b" \t\n\x0b\x0c\r"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or on a local master one of our own where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _own_dirs.setdefault(app, "file://" + tempfile.mkdtemp(prefix="cellweave-"))
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/cellweave-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or new_path(spark, tag)
    with shuffles_released(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder through Spark's own file systems."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Steps:
    """The intermediate tables of one run, each written and read again; those that nothing reads any more are dropped by name."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.folder = spark, new_path(spark, tag)

    def table(self, df: DataFrame, name: str, files: int | None = None) -> DataFrame:
        """df written and read again, in so many files at most, where the caller knows how much there is."""
        return materialize(df.coalesce(files) if files else df, name, f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            delete_path(self.spark, f"{self.folder}/{name}")

    def close(self) -> None:
        delete_path(self.spark, self.folder)


def small_batches(spark: SparkSession) -> None:
    """Bound what one batch of long texts holds, in Arrow by rows and bytes and in the Parquet reader by rows. The session's settings are the same for all operators, so that lazy frames of one are not changed by another."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", 512)


def parts(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: A key with more rows than this share of a task's fair number is hot.
HOT_SHARE = 0.25


def join_spread(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """rows joined with table, a written table of one row a key, by keys; weight names its column that says how many of the rows have the key.

    Hot keys (at most tasks / HOT_SHARE) are broadcast and meet their rows where they are, so that no task gets all rows of one key.
    """
    fair = max(1, int(HOT_SHARE * (table.agg(F.sum(weight)).head()[0] or 0) / parts(rows.sparkSession)))
    hot = table.where(F.col(weight) > fair)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(F.col(weight) <= fair), keys)
    return rest.unionByName(rows.join(F.broadcast(hot), keys))


def as_bytes(col: str = "text"):
    """UTF-8 bytes of a string column, null as empty."""
    return F.encode(F.coalesce(F.col(col), F.lit("")), "UTF-8")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch] | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is None:
                continue
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(run, schema)


def open_shared(path: str):
    """A file to write in the shared folder, whatever file system that is in."""
    where = urlparse(path)
    if where.scheme in ("", "file"):
        os.makedirs(os.path.dirname(where.path), exist_ok=True)
        return open(where.path, "wb")
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path)
    system.create_dir(posixpath.dirname(inside), recursive=True)
    return system.open_output_stream(inside)


def read_shared(path: str) -> bytes:
    """The content of a file in the shared folder, whatever file system that is in."""
    where = urlparse(path)
    if where.scheme in ("", "file"):
        with open(where.path, "rb") as f:
            return f.read()
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path)
    with system.open_input_stream(inside) as f:
        return f.read()


def open_input(path: str):
    """A file of the shared folder to read piece by piece, whatever file system that is in."""
    where = urlparse(path)
    if where.scheme in ("", "file"):
        return open(where.path, "rb")
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path)
    return system.open_input_file(inside)
