"""What is kept of sessions and elements between runs: statistics, additions, histories by noun, session records, subsets.

Every keeping step is an append of what is not there yet, so a run that is repeated adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from elemlake.operators.changes import newest_and_older
from elemlake.operators.lookup import ELEMENT, VERSION, existing, sessions_once, standing
from elemlake.operators.search import insert_ignore


def session_statistics(sessions: DataFrame, status: DataFrame) -> DataFrame:
    """sessions with add_count, modify_count and delete_count as the operations of the sessions say, whatever was delivered; a session without any has 0."""
    counted = status.groupBy("dbnum", "sesno").agg(*[F.count_if(F.col("operation") == name).cast("int").alias(column) for name, column in (("Add", "add_count"), ("Modified", "modify_count"), ("Deleted", "delete_count"))])
    counts = ("add_count", "modify_count", "delete_count")
    rows = sessions_once(sessions).drop(*counts).join(counted, ["dbnum", "sesno"], "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def added_elements(status: DataFrame, versions: DataFrame) -> DataFrame:
    """The versions that added an element: what an add-only table of elements takes."""
    return standing(versions).join(status.where("operation = 'Add'").select(*VERSION), VERSION, "left_semi")


def session_json(sessions: DataFrame) -> DataFrame:
    """(dbnum, sesno, json): a session as one JSON object; what is null is an empty text or 0."""
    text = lambda c: F.coalesce(c, F.lit(""))
    number = lambda c: F.coalesce(c, F.lit(0))
    fields = F.struct(
        F.concat_ws("_", "dbnum", "sesno").alias("id"), "sesno", number("ses_pgno").alias("pgno"), "dbnum", number("index_root_pgno").alias("index_pgno"), number("claim_pgno").alias("claim_pgno"), number("end_pgno").alias("end_pgno"),
        text("computer_name").alias("computer_name"), text("comments").alias("comments"), text(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).alias("date"),
    )
    return sessions_once(sessions).select("dbnum", "sesno", F.to_json(fields).alias("json"))


def save_noun_history(versions: DataFrame, path: str) -> None:
    """Appends the versions that are not their element's newest to a table with a folder per noun; those that it has are left out."""
    _, older = newest_and_older(versions)
    rows = older.where("not deleted").select(*VERSION, "byte_offset", "noun", "name", "owner_ref0", "owner_ref1")
    spark = versions.sparkSession
    if _exists(spark, path):
        rows = insert_ignore(spark.read.parquet(path).select(*VERSION), rows, VERSION)
    rows.write.mode("append").partitionBy("noun").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def subset(versions: DataFrame, wanted: DataFrame, with_worlds: bool = True) -> DataFrame:
    """The existing elements of a list (ELEMENT), their children reduced to those of the list: (ELEMENT, noun, name, children).

    World elements belong to every list unless with_worlds is false. Children keep their order.
    """
    now = existing(versions)
    keep = wanted.select(*ELEMENT)
    if with_worlds:
        keep = keep.unionByName(now.where("noun = 'WORL'").select(*ELEMENT))
    keep = keep.distinct()
    chosen = now.join(keep, ELEMENT, "left_semi")
    kids = chosen.select(*ELEMENT, F.posexplode("children").alias("ord", "c")).select("dbnum", F.col("ref0").alias("parent0"), F.col("ref1").alias("parent1"), "ord", F.col("c.ref0").alias("ref0"), F.col("c.ref1").alias("ref1"))
    # A list is one array of one row to begin with, so putting it together again gathers no more than that.
    lists = kids.join(keep, ELEMENT, "left_semi").groupBy("dbnum", F.col("parent0").alias("p0"), F.col("parent1").alias("p1")).agg(F.array_sort(F.collect_list(F.struct("ord", "ref0", "ref1"))).alias("kept"))
    lists = lists.select("dbnum", F.col("p0").alias("ref0"), F.col("p1").alias("ref1"), F.transform("kept", lambda x: F.struct(x["ref0"].alias("ref0"), x["ref1"].alias("ref1"))).alias("children"))
    return chosen.drop("children").join(lists, ELEMENT, "left").select(*ELEMENT, "noun", "name", F.coalesce("children", F.array().cast("array<struct<ref0:bigint,ref1:bigint>>")).alias("children"))


def noun_members(versions: DataFrame) -> DataFrame:
    """(noun, ELEMENT): the elements that ever had a noun, each once. A noun may hold most of all elements, so its set is rows, not an array."""
    return versions.where("noun is not null").select("noun", *ELEMENT).distinct()


def first_filled(rows: DataFrame, column: str, order: list[str], n: int) -> DataFrame:
    """The first n rows, in a stated order, that have a value in a column."""
    return rows.where(F.col(column).isNotNull()).orderBy(*order).limit(n)
