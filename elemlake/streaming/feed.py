"""The change feed and the stores as streams.

Two forms: a keyed state per element that follows its last operation; and
batch-wise upkeep of tables, where each micro-batch appends only what is
new, or what it has reduced its rows to, to be merged when read. There the table is the
state: a batch that is run again writes its own folder again, and operations that come late count like any other,
however late they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from elemlake.operators.analytics import counts_by_kind, once
from elemlake.operators.change_feed import operation, position
from elemlake.operators.search import insert_ignore

OPERATION = ["dbnum", "ref0", "ref1", "sesno", "op_no"]


def read_feed(spark: SparkSession, path: str, schema, files_per_batch: int = 8) -> DataFrame:
    """A folder of Parquet files as a stream; a single file is read as its folder, by name."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if status.isFile():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def follow_elements(changes: DataFrame) -> DataFrame:
    """(ref0, ref1, last, kind, n): per element its last operation in (sesno, op_no) order whatever the order of arrival; emitted when an element moves. The state is three values an element."""
    rows = changes.where("ref0 is not null and ref1 is not null").select("ref0", "ref1", F.struct(position().alias("at"), operation(F.col("operation_type")).alias("kind")).alias("op"))
    return rows.groupBy("ref0", "ref1").agg(F.max("op").alias("op"), F.count(F.lit(1)).alias("n")).select("ref0", "ref1", F.col("op.at").alias("last"), "op.kind", "n")


def keep_operations(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that reduces a batch to one row per operation and keeps it; kept_daily() merges what several batches say of one."""

    def sink(batch: DataFrame, number: int) -> None:
        once(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink


def kept_daily(spark: SparkSession, path: str) -> DataFrame:
    """(day, n_add, n_modify, n_delete, n_none) of the operations kept so far, each counted once at its earliest time."""
    kept = spark.read.parquet(path).groupBy(*OPERATION).agg(F.min("kind").alias("kind"), F.min("ts").alias("ts"))
    return kept.where("ts is not null").groupBy(F.to_date("ts").alias("day")).agg(*counts_by_kind())


def append_new(path: str, keys: list[str], part: Column | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends the rows whose key is not in the table yet.

    part is a value of the key by which the table is partitioned; of the table a batch reads only
    the keys of the parts it has rows of, so rows near each other in it should arrive together. Without it the table is one part.
    """
    part = F.lit(0) if part is None else part

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(keys).withColumn("part", part)
        try:
            # A batch that is run again must not find its own rows.
            table = spark.read.parquet(path)
            asked = [r[0] for r in rows.select("part").distinct().collect()]  # no more than the table has partitions
            stored = table.where((F.col("batch") != number) & (F.col("part").isin(asked) | F.col("part").isNull())).select(*keys)
            fresh = insert_ignore(stored, rows, keys)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            fresh = rows
        # A batch that is run again writes its own folder again instead of adding to it.
        fresh.write.mode("overwrite").partitionBy("part").parquet(f"{path}/batch={number}")

    return sink


def changed_stores(headers: DataFrame, known: DataFrame) -> DataFrame:
    """Stores whose newest session page differs from the one last seen; unchanged files are passed over."""
    seen = known.select("path", F.col("latest_ses_pgno").alias("seen_pgno"))
    return headers.join(seen, "path", "left").where(~F.col("latest_ses_pgno").eqNullSafe(F.col("seen_pgno"))).drop("seen_pgno")
