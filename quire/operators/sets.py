"""Sets of files, books and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import strings
from quire.operators import filters


def sides(names: DataFrame, files: DataFrame) -> DataFrame:
    """name, local, remote for every name of either side and of the given ones. One pass: flags by a single aggregation."""
    flags = files.select("name", (F.col("side") == "local").cast("int").alias("l"), (F.col("side") == "remote").cast("int").alias("r"), F.lit(0).alias("k"))
    flags = flags.unionByName(names.select("name", F.lit(0).alias("l"), F.lit(0).alias("r"), F.lit(1).alias("k")))
    return flags.groupBy("name").agg((F.max("l") == 1).alias("local"), (F.max("r") == 1).alias("remote"), (F.max("k") == 1).alias("known"))


def book_files(books: DataFrame) -> DataFrame:
    return filters.live(books).select(strings.file_name("file_path").alias("name"))


def sync_status(books: DataFrame, files: DataFrame) -> DataFrame:
    """name, status of each live book's file: both, localOnly, remoteOnly or nonExistent."""
    status = F.when(F.col("local") & F.col("remote"), "both").when(F.col("local"), "localOnly").when(F.col("remote"), "remoteOnly").otherwise("nonExistent")
    return sides(book_files(books), files).where("known").select("name", status.alias("status"))


def sync_plan(books: DataFrame, files: DataFrame, covers: bool = False) -> DataFrame:
    """name, action: upload what is here and wanted, download covers that are not, delete what no book names. Nothing if there is no book."""
    if filters.live(books).isEmpty():
        return files.select("name").limit(0).withColumn("action", F.lit(""))
    action = (
        F.when(F.col("known") & F.col("local") & ~F.col("remote"), "upload").when(F.col("known") & ~F.col("local") & F.col("remote") & F.lit(covers), "download")
        .when(~F.col("known") & F.col("local") & F.col("remote"), "deleteBoth").when(~F.col("known") & F.col("remote"), "deleteRemote").when(~F.col("known") & F.col("local"), "deleteLocal")
    )
    return sides(book_files(books), files).select("name", action.alias("action")).where(F.col("action").isNotNull())


def tag_changes(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """book_id, to_add, to_remove: differences of two lists of names (book_id, tags), whatever their case."""
    both = current.select("book_id", F.col("tags").alias("have")).join(wanted.select("book_id", F.col("tags").alias("want")), "book_id")
    low = lambda c: F.transform(c, F.lower)
    return both.select("book_id", F.array_sort(F.array_except(low("want"), low("have"))).alias("to_add"), F.array_sort(F.array_except(low("have"), low("want"))).alias("to_remove"))


def unique(values: str | Column) -> Column:
    """An array's values, each at its first place."""
    return F.array_distinct(values)


def repeated_targets(plan: DataFrame) -> DataFrame:
    """Books that a plan names more than once."""
    return plan.groupBy("book_id").agg(F.count("*").alias("n")).where("n > 1")


def sync_direction(states: DataFrame) -> DataFrame:
    """The direction for each (local_version, remote_version, local_mtime, remote_mtime, last_upload, asked): abort on a newer remote version, none
    within five seconds, upload without a remote; for both sides ask if the last upload is unknown or differs from the remote by over five seconds."""
    gap = F.abs(F.unix_timestamp("local_mtime") - F.unix_timestamp("remote_mtime"))
    drift = F.abs(F.unix_timestamp("last_upload") - F.unix_timestamp("remote_mtime"))
    decision = (
        F.when(F.col("remote_version") > F.col("local_version"), "abort").when(F.col("remote_mtime").isNull(), "upload").when(gap < 5, "none")
        .when((F.col("asked") == "both") & (F.col("last_upload").isNull() | (drift > 5)), "ask").otherwise(F.col("asked"))
    )
    return states.withColumn("direction", decision)
