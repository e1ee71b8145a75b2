"""Streaks, running totals and positions in books."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quire.functions import dates
from quire.operators import aggregates


def islands(rows: DataFrame, *by: str) -> DataFrame:
    """Runs of consecutive reading days: first, last, length; by other columns, if any, each with its own. A day minus its rank is the same all along a run.

    The window runs over distinct days, of which there are some hundreds a year, not over rows.
    """
    days = rows.select(*by, dates.day_of(rows).alias("day")).where(F.col("day").isNotNull()).distinct()
    runs = days.withColumn("run", F.date_sub("day", F.row_number().over(Window.partitionBy(*by).orderBy("day"))))
    return runs.groupBy(*by, "run").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("length")).drop("run")


def streak(rows: DataFrame, as_of: str, *by: str) -> DataFrame:
    """Current and longest run of days, and the last day. The current one is 0 once its last day is before yesterday; one in the future counts."""
    top = islands(rows, *by).groupBy(*by).agg(F.max("length").alias("longest"), F.max(F.struct("last", "length")).alias("end"))
    alive = F.datediff(F.lit(as_of).cast("date"), F.col("end.last")) <= 1
    return top.select(*by, F.coalesce(F.when(alive, F.col("end.length")), F.lit(0)).alias("current"), F.coalesce("longest", F.lit(0)).alias("longest"), F.col("end.last").alias("last_day"))


def running_total(spark: SparkSession, rows: DataFrame, days: int, as_of: str) -> DataFrame:
    """The last days up to as_of, each with its seconds and the sum so far. The window has as many rows as days."""
    start = (dt.date.fromisoformat(as_of) - dt.timedelta(days=days - 1)).isoformat()
    per_day = aggregates.filled(spark, aggregates.daily(rows, since=start), start, as_of)
    return per_day.withColumn("running", F.sum("seconds").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


def book_series(spark: SparkSession, rows: DataFrame, book: int, days: int, as_of: str) -> DataFrame:
    """One book's last days, zero-filled, with the labelled ones: the first, each month's first and every fifth. No row if the book was not read."""
    start = (dt.date.fromisoformat(as_of) - dt.timedelta(days=days - 1)).isoformat()
    read = aggregates.daily(rows, book, start).withColumn("read", F.lit(True))
    out = aggregates.filled(spark, read, start, as_of)
    out = out.withColumn("any", F.max("read").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).where("any").drop("any", "read")
    place = F.datediff("day", F.lit(start).cast("date"))
    return out.withColumn("labelled", (place == 0) | (F.dayofmonth("day") == 1) | (place % 5 == 0))


def carried_labels(sections: DataFrame, toc: DataFrame) -> DataFrame:
    """Each section with its own table-of-contents label, or else the last one before it. A document is a window."""
    w = Window.partitionBy("doc_id").orderBy("section_idx").rowsBetween(Window.unboundedPreceding, 0)
    return sections.join(toc.select("doc_id", "section_idx", "label"), ["doc_id", "section_idx"], "left").withColumn("label", F.last("label", ignorenulls=True).over(w))


def fractions(sections: DataFrame) -> DataFrame:
    """Where each section begins and ends in its document, as fractions of the whole; sections that aren't linear count nothing."""
    size = F.when(F.col("linear") & (F.col("size") > 0), F.col("size")).otherwise(0)
    w = Window.partitionBy("doc_id")
    upto = F.sum("counted").over(w.orderBy("section_idx").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("counted").over(w)
    return sections.withColumn("counted", size).withColumn("end", F.try_divide(upto, total)).withColumn("start", F.try_divide(upto - F.col("counted"), total)).withColumn("total", total)


def progress(placed: DataFrame, section: str = "section_idx", within: str = "within", unit: int = 1500, per_second: float = 25.0) -> DataFrame:
    """Places (a fraction `within` a section of `fractions`) as a fraction of the book, locations of `unit` characters and seconds left."""
    at = F.col("start") + F.col(within) * (F.col("end") - F.col("start"))
    total = F.ceil(F.col("total") / unit)
    return placed.withColumn("fraction", at).withColumn("location", F.floor(at * F.col("total") / unit)).withColumn("locations", total).withColumn("seconds_left", F.round((1 - at) * F.col("total") / per_second, 3))


def section_at(placed: DataFrame, fraction: float) -> DataFrame:
    """Of each document, the section that holds a fraction of the whole and the fraction within it; sections without size are passed over."""
    inside = placed.where((F.col("counted") > 0) & (F.col("start") <= fraction + 1e-12))
    last = inside.groupBy("doc_id").agg(F.max_by(F.struct("section_idx", "start", "end"), "section_idx").alias("s"))
    within = F.least(F.lit(1.0), (F.lit(fraction) - F.col("s.start")) / (F.col("s.end") - F.col("s.start")))
    return last.select("doc_id", F.col("s.section_idx").alias("section_idx"), within.alias("within"))


def requests_in_minute(log: DataFrame, per_minute: int) -> DataFrame:
    """Each request of a service with the number in the minute up to it, and the seconds it would have waited: a report, not a throttle."""
    at = F.unix_timestamp("ts")
    w = Window.partitionBy("service").orderBy(at).rangeBetween(-59, 0)
    out = log.withColumn("in_minute", F.count("*").over(w)).withColumn("oldest", F.min(at).over(w))
    return out.withColumn("wait", F.when(F.col("in_minute") > per_minute, F.col("oldest") + 60 - at).otherwise(0))


def bodies(matches: DataFrame, lengths: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, body_start, body_end: what lies between each match (key, start, end) and the next, or the text's end (key, length)."""
    nxt = F.lead("start").over(Window.partitionBy(key).orderBy("start"))
    return matches.join(lengths, key).select(key, "start", F.col("end").alias("body_start"), F.coalesce(nxt, F.col("length")).alias("body_end"))
