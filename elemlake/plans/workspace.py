"""Tables written to the shared folder, to cut lineage between the rounds of an iterative operator.

The folder is the one named in ``spark.checkpoint.dir``, which all executors
share, so a lost executor only costs the tasks it was running. Only a session
that is one process (tests, a notebook) gets a folder of its own where that
setting is missing; on a cluster it is an error.

Results are lazy and read these tables, so they live until the process ends, or until
the ``tables()`` block in which they were made does.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_FALLBACK: list[str] = []
_WRITTEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _FALLBACK:
        _FALLBACK.append(tempfile.mkdtemp(prefix="elemlake-"))
    return _FALLBACK[0]


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """df, written as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._elemlake_path = path
    return out


def written_counting(df: DataFrame, name: str, counted: Column) -> tuple[DataFrame, int]:
    """written(), and for how many rows a condition holds, counted while they are written instead of in a pass of its own."""
    seen = Observation()
    out = written(df.observe(seen, F.count_if(counted).alias("n")), name)
    return out, seen.get["n"]


def bucketed(df: DataFrame, name: str, keys: list[str], partition_by: list[str] | None = None, buckets: int | None = None, placed: bool = False) -> DataFrame:
    """df, written hash-bucketed and sorted by keys. Joins and aggregations on exactly these keys need no exchange.

    placed says that df comes from tables of the same buckets without an exchange, so that each task holds the rows of one bucket already.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # One task per bucket writes one file per partition value, instead of one per task and bucket.
    writer = (df if placed else df.repartition(buckets, *keys)).write.bucketBy(buckets, *keys).sortBy(*keys)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    table = _table_name(path)
    writer.format("parquet").option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._elemlake_path, out._elemlake_table = path, table
    return out


def release(df: DataFrame | None) -> None:
    """Deletes a table made by written() or bucketed() that no plan reads any more."""
    path = getattr(df, "_elemlake_path", None)
    if path is None:
        return
    spark = df.sparkSession
    if getattr(df, "_elemlake_table", None):
        spark.sql(f"DROP TABLE IF EXISTS {df._elemlake_table}")
    _delete(spark, path)
    _WRITTEN.pop(path, None)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A file of the shared folder's file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(data))
    out.close()


@contextlib.contextmanager
def tables() -> Iterator[None]:
    """Deletes the tables made inside the block at its end; results made there must have been written or collected by then."""
    before = set(_WRITTEN)
    try:
        yield
    finally:
        for path in set(_WRITTEN) - before:
            spark = _WRITTEN.pop(path)
            spark.sql(f"DROP TABLE IF EXISTS {_table_name(path)}")
            _delete(spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/elemlake-{name}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def _table_name(path: str) -> str:
    return "elemlake_" + path.rsplit("-", 1)[1]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for path, spark in list(_WRITTEN.items()):
        try:
            spark.sql(f"DROP TABLE IF EXISTS {_table_name(path)}")
            _delete(spark, path)
        except Exception:
            pass
