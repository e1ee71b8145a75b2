"""Roll-ups of reading time, notes and files. Seconds are integers throughout, so sums are exact in any order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quire.functions import dates, numbers, strings
from quire.operators import filters, joins


def seconds(c: str = "reading_time") -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def total(rows: DataFrame) -> DataFrame:
    return rows.agg(seconds().alias("total"))


def books_read(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_distinct("book_id").alias("books"))


def days_read(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_distinct(dates.day_of(rows)).alias("days"))


def notes_per_book(notes: DataFrame) -> DataFrame:
    return notes.where(filters.annotation()).groupBy("book_id").agg(F.count("*").alias("n_notes")).where(F.col("book_id") != 0)


def note_totals(notes: DataFrame) -> DataFrame:
    return notes.where(filters.annotation()).agg(F.count("id").alias("n_notes"), F.count_distinct("book_id").alias("n_books"))


def daily(rows: DataFrame, book: int | None = None, since: str | None = None) -> DataFrame:
    """day, seconds; rows without a readable day are left out."""
    rows = rows if book is None else rows.where(F.col("book_id") == book)
    rows = rows.withColumn("day", dates.day_of(rows)).where(F.col("day").isNotNull())
    rows = rows if since is None else rows.where(F.col("day") >= F.lit(since).cast("date"))
    return rows.groupBy("day").agg(seconds().alias("seconds"))


def filled(spark: SparkSession, per_day: DataFrame, start: str, end: str) -> DataFrame:
    """The series with a zero for every day without reading."""
    return dates.spine(spark, start, end).join(per_day, "day", "left").withColumn("seconds", F.coalesce("seconds", F.lit(0).cast("long")))


def bounds(mode: str, as_of: str) -> tuple[str, str]:
    """First and last day of the calendar day, week (from Monday), month or year of as_of."""
    import calendar
    import datetime as dt

    d = dt.date.fromisoformat(as_of)
    if mode == "day":
        return as_of, as_of
    if mode == "week":
        first = d - dt.timedelta(days=d.weekday())
        return first.isoformat(), (first + dt.timedelta(days=6)).isoformat()
    if mode == "month":
        return d.replace(day=1).isoformat(), d.replace(day=calendar.monthrange(d.year, d.month)[1]).isoformat()
    return f"{d.year}-01-01", f"{d.year}-12-31"


def series(spark: SparkSession, rows: DataFrame, mode: str, as_of: str) -> DataFrame:
    """Zero-filled series of a week or a month by day, or of a year by month."""
    start, end = bounds(mode, as_of)
    inside = filters.days_between(rows, start, end)
    if mode != "year":
        return filled(spark, daily(inside), start, end)
    monthly = inside.groupBy(dates.month_start(dates.day_of(inside)).alias("day")).agg(seconds().alias("seconds"))
    return dates.spine(spark, start, end, "month").join(monthly, "day", "left").select(F.date_format("day", "yyyy-MM").alias("month"), F.coalesce("seconds", F.lit(0).cast("long")).alias("seconds"))


def by_book(rows: DataFrame, books: DataFrame, mode: str = "all", as_of: str = "") -> DataFrame:
    """Seconds by live book in a calendar period, most first, then by id."""
    inside = rows if mode == "all" else filters.days_between(rows, *bounds(mode, as_of))
    totals = inside.groupBy("book_id").agg(seconds().alias("seconds"))
    return joins.named_totals(totals, books).orderBy(F.desc("seconds"), "book_id")


def week_books(rows: DataFrame, as_of: str) -> DataFrame:
    """Seconds by book since Monday, without an end."""
    return filters.days_between(rows, bounds("week", as_of)[0]).groupBy("book_id").agg(seconds().alias("seconds"))


def of_book(rows: DataFrame, book: int) -> DataFrame:
    return rows.where(F.col("book_id") == book).agg(seconds().alias("total"))


def period_share(rows: DataFrame, mode: str, as_of: str) -> DataFrame:
    """A period's seconds, their share of all in percent to one decimal (null without any), and the bar's length in [0, 1]."""
    d, (start, end) = dates.day_of(rows), (bounds(mode, as_of) if mode != "all" else ("0001-01-01", "9999-12-31"))
    inside = F.when(d.between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.col("reading_time"))
    sums = rows.agg(F.coalesce(F.sum(inside), F.lit(0)).cast("long").alias("period"), seconds().alias("total"))
    share = F.try_divide(F.col("period"), F.col("total"))
    return sums.select("period", "total", F.round(share * 100, 1).alias("percent"), numbers.clamped(F.when(F.col("period") == 0, 0.0).otherwise(F.coalesce(share, F.lit(0.0))), 0.0, 1.0).alias("bar"))


def mean_completion(books: DataFrame) -> DataFrame:
    """Mean percentage of the five books nearest completion; 0 without any."""
    from quire.operators import sorts

    return sorts.top_completion(books).agg(F.coalesce(F.avg("reading_percentage"), F.lit(0.0)).alias("mean"))


def chart_bound(per_day: DataFrame) -> DataFrame:
    return per_day.agg(F.coalesce(F.max("seconds"), F.lit(0)).alias("max"), (F.coalesce(F.max("seconds"), F.lit(0)) * 1.2).alias("bound"))


def group_ids(books: DataFrame) -> DataFrame:
    return books.where(F.col("group_id").isNotNull() & (F.col("group_id") != 0)).select("group_id").distinct()


def storage(files: DataFrame) -> DataFrame:
    """Bytes by class of files, and as text; files: kind, length."""
    return files.groupBy("kind").agg(F.sum("length").cast("long").alias("bytes")).withColumn("size", numbers.human_size("bytes"))


def hash_backfill(books: DataFrame, files: DataFrame) -> DataFrame:
    """Of the books without a hash: how many get one from their file, are skipped without a file, or fail on an empty one. files: name, md5, length."""
    lacking = filters.unhashed(books).withColumn("name", strings.file_name("file_path")).join(files, "name", "left")
    return lacking.agg(
        F.count_if(F.col("length") > 0).alias("calculated"), F.count_if(F.col("length").isNull()).alias("skipped"), F.count_if(F.col("length") == 0).alias("failed"), F.count("*").alias("total"),
    )


def hash_statistics(books: DataFrame, files: DataFrame) -> DataFrame:
    """Live books, with and without hash, with a local file, and local without hash."""
    local = files.where(F.col("side") == "local").select("name", F.lit(True).alias("here"))
    rows = filters.live(books).withColumn("name", strings.file_name("file_path")).join(local, "name", "left")
    has = F.col("file_md5").isNotNull() & (F.col("file_md5") != "")
    return rows.agg(
        F.count("*").alias("total"), F.count_if(has).alias("with_md5"), F.count_if(~has).alias("without_md5"), F.count_if("here").alias("local"), F.count_if(F.col("here") & ~has).alias("local_without_md5"),
    )


def plan_statistics(plan: DataFrame, books: DataFrame) -> DataFrame:
    """An organising plan (book_id, group_id; 0 ungroups): groups it makes, books that it moves, books that it takes out of groups."""
    moved = plan.join(filters.live(books).select(F.col("id").alias("book_id"), F.col("group_id").alias("was")), "book_id")
    return moved.agg(
        F.count_distinct(F.when(F.col("group_id") != 0, F.col("group_id"))).alias("groups"), F.count_if(F.col("group_id") != F.col("was")).alias("moved"),
        F.count_if((F.col("group_id") == 0) & (F.col("was") != 0)).alias("ungrouped"),
    )


def multimap(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key and the sorted list of its values."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("values"))


def shelf_folders(books: DataFrame) -> DataFrame:
    """Folders in the order of their first book by last change: a book without group is a folder of its own."""
    folder = F.when(F.col("group_id") == 0, F.concat(F.lit("b"), F.col("id"))).otherwise(F.concat(F.lit("g"), F.col("group_id")))
    rows = filters.live(books).select("id", folder.alias("folder"), F.struct(F.col("update_time"), F.col("id")).alias("at"))
    heads = rows.groupBy("folder").agg(F.max("at").alias("head"), F.count("*").alias("n_books"))
    return heads.select("folder", "n_books", F.col("head.id").alias("first_book"), F.col("head.update_time").alias("latest")).orderBy(F.desc("latest"), F.desc("first_book"))


def chapter_runs(notes: DataFrame) -> DataFrame:
    """Runs of neighbouring notes of one chapter, by book in order of id: the run's number, chapter and size."""
    w = Window.partitionBy("book_id").orderBy("id")
    starts = F.coalesce((F.lag("chapter").over(w) != F.col("chapter")).cast("int"), F.lit(1))
    return notes.withColumn("start", starts).withColumn("run", F.sum("start").over(w)).groupBy("book_id", "run").agg(F.first("chapter").alias("chapter"), F.count("*").alias("n_notes"), F.min("id").alias("first_id"))


def base_levels(toc: DataFrame) -> DataFrame:
    """Levels counted from each document's least, from 1, and clamped to 6 for headings."""
    level = F.col("level") - F.min("level").over(Window.partitionBy("doc_id")) + 1
    return toc.withColumn("base", level).withColumn("heading", numbers.clamped("base", 1, 6).cast("int"))
