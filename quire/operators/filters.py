"""Predicates and filters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from quire import schema
from quire.functions import dates, strings


def annotation() -> Column:
    return F.col("type").isin(*schema.NOTE_TYPES)


def live(books: DataFrame) -> DataFrame:
    """Books that aren't deleted; one whose flag is null is left out."""
    return books.where(~F.col("is_deleted"))


def by_id(table: DataFrame, key: int) -> DataFrame:
    return table.where(F.col("id") == key)


def by_ids(books: DataFrame, keys: Iterable[int]) -> DataFrame:
    """Live books of a list of ids; none for an empty list."""
    keys = list(keys)
    return live(books).where(F.col("id").isin(keys)) if keys else books.limit(0)


def matching(books: DataFrame, query: str) -> DataFrame:
    """Live books whose title or author contains the trimmed query, whatever its case; none for a blank one."""
    q = query.strip()
    return live(books).where(strings.contains_folded("title", q) | strings.contains_folded("author", q)) if q else books.limit(0)


def on_shelf(books: DataFrame, query: str) -> DataFrame:
    """Live books whose title or author contains the query as it is."""
    return live(books).where(F.col("title").contains(query) | F.col("author").contains(query))


def unhashed(books: DataFrame) -> DataFrame:
    return live(books).where(F.col("file_md5").isNull() | (F.col("file_md5") == ""))


def notes_of(notes: DataFrame, book: int) -> DataFrame:
    return notes.where(annotation() & (F.col("book_id") == book))


def notes_at(notes: DataFrame, cfi: str, book: int) -> DataFrame:
    return notes_of(notes, book).where(F.col("cfi") == cfi)


def notes_where(notes: DataFrame, keyword: str | None = None, book: int | None = None, start: str | None = None, end: str | None = None, types: Iterable[str] | None = schema.NOTE_TYPES) -> DataFrame:
    """Notes under any of several conditions: a keyword in content, reader's note or chapter; a book; ISO bounds of the last change; types."""
    tests: list[Column] = []
    if keyword and keyword.strip():
        tests.append(strings.contains_folded("content", keyword.strip()) | strings.contains_folded(F.coalesce("reader_note", F.lit("")), keyword.strip()) | strings.contains_folded("chapter", keyword.strip()))
    if book is not None:
        tests.append(F.col("book_id") == book)
    if start:
        tests.append(F.col("update_time") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        tests.append(F.col("update_time") <= F.lit(end).cast("timestamp_ntz"))
    if types := list(types or ()):
        tests.append(F.col("type").isin(types))
    for t in tests:
        notes = notes.where(t)
    return notes


def reading_where(rows: DataFrame, book: int | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Reading rows of a book and of a range of times; a row with a date alone is at its midnight."""
    at = dates.stamp("date")
    rows = rows if book is None else rows.where(F.col("book_id") == book)
    rows = rows.where(at >= F.lit(start).cast("timestamp_ntz")) if start else rows
    return rows.where(at <= F.lit(end).cast("timestamp_ntz")) if end else rows


def days_between(rows: DataFrame, start: str, end: str | None = None) -> DataFrame:
    """Reading rows from a day on, to another one inclusive if given."""
    d = dates.day_of(rows)
    return rows.where(d >= F.lit(start).cast("date")) if end is None else rows.where(d.between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def status(percentage: str = "reading_percentage") -> Column:
    p = F.col(percentage)
    return F.when(p <= 0.02, "notStarted").when(p < 0.98, "reading").otherwise("finished")


def with_all_tags(books: DataFrame, links: DataFrame, tags: Iterable[int]) -> DataFrame:
    """Live books that have every one of the tags; the pseudo tag of the untagged stands alone. All books for no tag."""
    wanted = sorted(set(tags))
    if schema.UNTAGGED in wanted:
        return live(books).join(links.select(F.col("book_id").alias("id")), "id", "left_anti")
    if not wanted:
        return live(books)
    having = links.where(F.col("tag_id").isin(wanted)).groupBy("book_id").agg(F.count_distinct("tag_id").alias("n")).where(F.col("n") == len(wanted))
    return live(books).join(having.select(F.col("book_id").alias("id")), "id", "left_semi")


def shown_notes(notes: DataFrame, selected: Iterable[str] | None = None, bookmarks: bool = True) -> DataFrame:
    """Notes whose type#COLOUR is selected, and bookmarks if they are shown; other types never."""
    chosen = list(selected) if selected is not None else [f"{t}#{c}" for t in ("highlight", "underline") for c in schema.NOTE_COLORS]
    key = F.concat("type", F.lit("#"), F.upper("color"))
    return notes.where((F.col("type").isin("highlight", "underline") & key.isin(chosen)) | ((F.col("type") == "bookmark") & F.lit(bookmarks)))


def nearly_done(books: DataFrame) -> DataFrame:
    p = F.col("reading_percentage")
    return live(books).where((p >= 0.6) & (p < 0.93))


def shelf_lookup(books: DataFrame, query: str | None = None, group: int | None = None, include_deleted: bool = False) -> DataFrame:
    """All books, or the matching ones; then by group. With a query deleted books are out whatever is asked."""
    if query and query.strip():
        out = matching(books, query)
    else:
        out = books if include_deleted else live(books)
    return out if group is None else out.where(F.col("group_id") == group)


def children(groups: DataFrame, parent: int) -> DataFrame:
    return groups.where(~F.col("is_deleted") & (F.col("parent_id") == parent))


def importable(files: DataFrame, path: str = "path") -> DataFrame:
    return files.where(strings.extension(path).isin(*schema.EXTENSIONS))


def book_card(*more: Column) -> list[Column]:
    """A book as the tools show it."""
    names = ("id", "title", "author", "reading_percentage", "group_id", "is_deleted")
    return [*(F.col(c) for c in names), *more]


def note_card() -> list[Column]:
    return [F.col("id").alias("note_id"), "book_id", "chapter", "type", strings.snippet("content", "reader_note").alias("snippet")]
