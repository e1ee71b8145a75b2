"""Joins of the library's tables. Sides are left to the optimizer, which broadcasts the small ones by their measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quire.operators import filters
from quire.functions import strings


def named_totals(totals: DataFrame, books: DataFrame) -> DataFrame:
    """Totals by book with title and author; books that are deleted or missing go."""
    return totals.join(filters.live(books).select(F.col("id").alias("book_id"), "title", "author"), "book_id")


def first_notes(notes: DataFrame, books: DataFrame, limit: int) -> DataFrame:
    """The latest notes with their books. The limit comes first, so fewer rows may remain."""
    top = notes.orderBy(F.desc("update_time"), F.desc("id")).limit(limit)
    return top.select(*filters.note_card(), "update_time").join(filters.live(books).select(F.col("id").alias("book_id"), "title", "author"), "book_id")


def first_readings(rows: DataFrame, books: DataFrame, limit: int) -> DataFrame:
    """The latest reading rows with their books, limited before the join."""
    from quire.functions import dates

    top = rows.orderBy(F.desc_nulls_last(dates.stamp("date")), F.desc("id")).limit(limit)
    return top.join(filters.live(books).select(F.col("id").alias("book_id"), "title"), "book_id")


def notes_by_book(notes: DataFrame, books: DataFrame) -> DataFrame:
    """One row for each live book with notes: their number, the latest change, and the notes, newest first."""
    notes = notes.select("book_id", "update_time", F.struct("update_time", "id", strings.snippet("content", "reader_note").alias("snippet")).alias("note"))
    grouped = notes.groupBy("book_id").agg(F.count("*").alias("n_notes"), F.max("update_time").alias("latest"), F.sort_array(F.collect_list("note"), asc=False).alias("notes"))
    return grouped.join(filters.live(books).select(F.col("id").alias("book_id"), "title"), "book_id")


def tag_names(books: DataFrame, links: DataFrame, tags: DataFrame) -> DataFrame:
    """book_id and the names of its tags in alphabetical order; an empty list for books without."""
    named = links.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id").groupBy("book_id").agg(F.array_sort(F.collect_list("name")).alias("tags"))
    return books.select(F.col("id").alias("book_id")).join(named, "book_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def tags_of_books(books: DataFrame, links: DataFrame, tags: DataFrame, ids: list[int] | None = None, all_books: bool = False) -> DataFrame:
    """Live books of a list with their tags. Without a list there is no row, unless all books are asked for."""
    if not ids and not all_books:
        chosen = filters.live(books).limit(0)
    else:
        chosen = filters.by_ids(books, ids) if ids else filters.live(books)
    return tag_names(chosen, links, tags).join(chosen.select(F.col("id").alias("book_id"), "title"), "book_id")


def note_statistics(notes: DataFrame, books: DataFrame, rows: DataFrame) -> DataFrame:
    """Notes and reading seconds of each annotated book, deleted ones too."""
    counts = notes.where(filters.annotation() & (F.col("book_id") != 0)).groupBy("book_id").agg(F.count("*").alias("n_notes"))
    seconds = rows.groupBy("book_id").agg(F.sum("reading_time").alias("seconds"))
    out = counts.join(books.select(F.col("id").alias("book_id"), "title"), "book_id").join(seconds, "book_id", "left")
    return out.withColumn("seconds", F.coalesce("seconds", F.lit(0).cast("long")))


def random_note(notes: DataFrame, books: DataFrame, seed: int | None = None) -> DataFrame:
    """Any one annotation with its book, if that is there; deleted books are."""
    one = notes.where(filters.annotation()).orderBy(F.rand(seed)).limit(1)
    return one.select(F.col("id").alias("note_id"), "book_id", "content").join(books.select(F.col("id").alias("book_id"), "title"), "book_id", "left")


def last_read_book(rows: DataFrame, books: DataFrame) -> DataFrame:
    """The book read last and when. If it is deleted or missing, the newest live book stands in, with that time kept."""
    from quire.functions import dates

    last = rows.orderBy(F.desc_nulls_last(dates.stamp("date")), F.desc("id")).limit(1).select("book_id", F.col("date").alias("last_read"))
    alive = filters.live(books).select(F.col("id").alias("book_id"), F.col("title").alias("read_title"))
    newest = filters.live(books).orderBy(F.desc("update_time"), F.desc("id")).limit(1).select(F.col("id").alias("new_id"), F.col("title").alias("new_title"))
    found = newest.join(last.join(alive, "book_id", "left"), F.lit(True), "left")  # one row by at most one row
    return found.select(F.when(F.col("read_title").isNull(), F.col("new_id")).otherwise(F.col("book_id")).alias("book_id"), F.coalesce("read_title", "new_title").alias("title"), "last_read")


def books_with_file(books: DataFrame, files: DataFrame, side: str) -> DataFrame:
    """Live books whose file is among one side's."""
    names = files.where(F.col("side") == side).select("name")
    return filters.live(books).withColumn("name", strings.file_name("file_path")).join(names, "name", "left_semi")


def group_names(books: DataFrame, groups: DataFrame) -> DataFrame:
    return filters.live(books).select("id", "title", "group_id").join(groups.where(~F.col("is_deleted")).select(F.col("id").alias("group_id"), F.col("name").alias("group_name")), "group_id", "left")


def labelled_hits(hits: DataFrame, toc: DataFrame) -> DataFrame:
    """Search hits (doc_id, section_idx, …) with the label of the last table-of-contents entry at or before their section.

    An as-of join by a union and a window over each document: no range join, one shuffle.
    """
    marks = toc.select("doc_id", "section_idx", F.lit(0).alias("kind"), "label", *(F.lit(None).cast(hits.schema[c].dataType).alias(c) for c in hits.columns if c not in ("doc_id", "section_idx")))
    rows = hits.select("doc_id", "section_idx", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("label"), *(c for c in hits.columns if c not in ("doc_id", "section_idx")))
    w = Window.partitionBy("doc_id").orderBy("section_idx", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return marks.unionByName(rows).withColumn("label", F.last("label", ignorenulls=True).over(w)).where("kind = 1").drop("kind")
