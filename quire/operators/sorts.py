"""Orders, limits and the first of groups. Every order ends in a unique key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.internal import InternalFunction

from quire.functions import dates
from quire.operators import filters

#: Limits of the tools: (least, most, default).
CLAMPS = {"bookshelf": (1, 50, 500), "notes": (1, 50, 10), "history": (1, 100, 20), "results": (1, 10, 5), "snippets": (1, 10, 3), "characters": (100, 2000, None), "chapter": (500, 12000, None)}


def clamp(kind: str, asked: int | None) -> int | None:
    """A limit within its bounds. The shelf's default lies above its bound, so it is the bound."""
    low, high, default = CLAMPS[kind]
    n = default if asked is None else asked
    return None if n is None else max(low, min(high, n))


def shelf(books: DataFrame, field: str = "title", ascending: bool = True, key: Callable[[Column], Column] = F.lower) -> DataFrame:
    """Live books by title or author (through a transliterating key, if one is given), or by change, progress or creation."""
    c = key(F.col(field)) if field in ("title", "author") else F.col(field)
    return filters.live(books).orderBy(c.asc() if ascending else c.desc(), "id")


def pinyin(c: Column) -> Column:
    """A key for titles: Chinese ones by the sound of their characters, ahead of other scripts, which go by their letters whatever their case and accents. Worked out in the JVM."""
    return F.collate(F.lower(c), "zh")


def placed(ordered: DataFrame, place: str = "place") -> DataFrame:
    """Rows in order with their place from 0. Partitions of the sort are counted and numbered on from each other, so no task holds more than its range."""
    return ordered.select(InternalFunction.distributed_sequence_id().alias(place), "*")


def tags(rows: DataFrame, key: Callable[[Column], Column] = F.lower) -> DataFrame:
    return rows.orderBy(key(F.col("name")), "id")


def notes_by_time(notes: DataFrame, ascending: bool = True) -> DataFrame:
    at = F.coalesce("create_time", F.lit("1970-01-01").cast("timestamp_ntz"))
    return notes.orderBy(at.asc() if ascending else at.desc(), "id")


def top_completion(books: DataFrame, k: int = 5) -> DataFrame:
    return filters.nearly_done(books).orderBy(F.desc("reading_percentage"), "id").limit(k)


def latest_reading(rows: DataFrame) -> DataFrame:
    return by_recency(rows).limit(1)


def by_recency(rows: DataFrame, book: int | None = None) -> DataFrame:
    rows = rows if book is None else rows.where(F.col("book_id") == book)
    return rows.orderBy(F.desc_nulls_last(dates.stamp("date")), F.desc("id"))


def random_note(notes: DataFrame, seed: int | None = None) -> DataFrame:
    return notes.where(filters.annotation()).orderBy(F.rand(seed)).limit(1)


def newest(rows: DataFrame, by: str, keep: int, key: str = "id") -> DataFrame:
    """The newest rows, all if keep is 0 or less: what a bounded cache holds. Top-k, so each task hands on k rows at most."""
    return rows if keep <= 0 else rows.orderBy(F.desc(by), F.desc(key)).limit(keep)


def evicted(rows: DataFrame, by: str, keep: int, key: str = "id") -> DataFrame:
    return rows.join(newest(rows, by, keep, key).select(key), key, "left_anti")


def bookmarks(rows: DataFrame) -> DataFrame:
    return rows.orderBy("percentage", "id")


def by_size(files: DataFrame) -> DataFrame:
    return files.orderBy(F.desc("length"), "path")


def on_top(rows: DataFrame, book: int, rank: str = "rank") -> DataFrame:
    """rows with one book first and the others in their order: rank is counted anew within its folder."""
    w = Window.partitionBy("folder").orderBy((F.col("id") != book).cast("int"), rank, "id")
    return rows.withColumn(rank, F.row_number().over(w))
