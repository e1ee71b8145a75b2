"""Reading time and last places as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quire.operators import access


def daily_seconds(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Seconds by book and day of a stream (ts, book_id, seconds); a day closes once the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "book_id").agg(F.sum("seconds").alias("seconds")).select(F.col("window.start").cast("date").alias("day"), "book_id", "seconds")


def once_each(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events without repeats of (book_id, ts, place) within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["book_id", "ts", "place"])


def moves(events: DataFrame) -> DataFrame:
    """Of a batch of relocation events (id, book_id, ts, place, progress), those that changed the place."""
    w = Window.partitionBy("book_id").orderBy("ts", "id")
    return events.withColumn("_last", F.lag("place").over(w)).where(F.col("_last").isNull() | (F.col("_last") != F.col("place"))).drop("_last")


def last_places(events: DataFrame) -> DataFrame:
    """book_id, place, progress, ts: the last of each book. Only one row for each book and task is shuffled."""
    last = events.groupBy("book_id").agg(F.max_by(F.struct("place", "progress", "ts"), F.struct("ts", "id")).alias("l"))
    return last.select("book_id", "l.place", "l.progress", "l.ts")


def keep_last_places(stream: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    """Writes the last place of each book after every batch; a batch that is run again gives the same table."""

    def put(batch: DataFrame, _: int) -> None:
        spark: SparkSession = batch.sparkSession
        try:
            old = spark.read.parquet(path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = None
        new = last_places(batch)
        if old is not None:
            new = last_places(new.withColumn("id", F.lit(0)).unionByName(old.withColumn("id", F.lit(0))))
        access.replace_atomically(spark, new, path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def cumulative_answers(chunks: DataFrame) -> DataFrame:
    """Of cumulative emissions (conv_id, seq, text), the last: what the answer came to."""
    return chunks.groupBy("conv_id").agg(F.max_by("text", "seq").alias("text"))


def timeline(chunks: DataFrame) -> DataFrame:
    """conv_id, run, kind, text: neighbouring chunks (conv_id, seq, kind, text) of one kind as one entry, in order. A conversation's chunks are one task's."""
    w = Window.partitionBy("conv_id").orderBy("seq")
    new = F.coalesce((F.lag("kind").over(w) != F.col("kind")).cast("int"), F.lit(1))
    marked = chunks.withColumn("_new", new).withColumn("run", F.sum("_new").over(w).cast("int"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    return marked.groupBy("conv_id", "run").agg(F.first("kind").alias("kind"), F.array_join(parts, "").alias("text"))
