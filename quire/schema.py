"""The reading library's tables, with explicit schemas, and the decoding of its two multiplexed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

VERSION = 7
SCHEMAS = {
    "books": "id long, title string, cover_path string, file_path string, last_read_position string, reading_percentage double, author string, is_deleted boolean, description string, rating double, group_id long, file_md5 string, create_time timestamp_ntz, update_time timestamp_ntz",
    "notes": "id long, book_id long, content string, cfi string, chapter string, type string, color string, reader_note string, create_time timestamp_ntz, update_time timestamp_ntz",
    "reading_time": "id long, book_id long, date string, reading_time long",
    "groups": "id long, name string, parent_id long, is_deleted boolean, create_time timestamp_ntz, update_time timestamp_ntz",
    "sections": "book_id long, section_idx int, title string, href string, content string",
    "themes": "id long, background_color string, text_color string, background_image_path string",
    "tags": "id long, name string, rgb long",
    "book_tags": "id long, book_id long, tag_id long",
}
#: Kinds of notes that count as annotations.
NOTE_TYPES = ("highlight", "underline", "bookmark")
#: Colours of annotations, as hex digits.
NOTE_COLORS = ("66CCFF", "FF0000", "00FF00", "EB3BFF", "FFD700")
#: File types that may be imported.
EXTENSIONS = ("epub", "mobi", "azw3", "fb2", "txt", "pdf")
#: The pseudo tag of books that have none.
UNTAGGED = -1


def defaulted_books(books: DataFrame) -> DataFrame:
    """Nulls as the model reads them: empty strings, 0 for percentage, rating and group; not deleted; description and hash stay null."""
    text = {c: "" for c in ("title", "cover_path", "file_path", "last_read_position", "author")}
    return books.fillna(text).fillna({"reading_percentage": 0.0, "rating": 0.0, "group_id": 0, "is_deleted": False})


def defaulted_notes(notes: DataFrame, as_of: str) -> DataFrame:
    out = notes.fillna({c: "" for c in ("content", "cfi", "chapter", "type", "color")}).fillna({"book_id": 0})
    return out.withColumn("update_time", F.coalesce("update_time", F.lit(as_of).cast("timestamp_ntz")))


def _near(c: str, x: float) -> F.Column:
    return F.abs(F.col(c) - x) < 0.0001


def tags_of_styles(styles: DataFrame) -> DataFrame:
    """Tags among the style rows: font size 1, the name in font_family, the colour in line_height."""
    return styles.where(_near("font_size", 1.0)).select("id", F.col("font_family").alias("name"), F.col("line_height").cast("long").bitwiseAND(0xFFFFFF).alias("rgb"))


def book_tags_of_styles(styles: DataFrame) -> DataFrame:
    """Links of books and tags among the style rows: font size 2, the book in line_height, the tag in letter_spacing."""
    return styles.where(_near("font_size", 2.0)).select("id", F.col("line_height").cast("long").alias("book_id"), F.col("letter_spacing").cast("long").alias("tag_id"))


def bookmarks_of_notes(notes: DataFrame) -> DataFrame:
    """Bookmarks among the notes: the colour column holds the place in the book as a fraction."""
    return notes.where(F.col("type") == "bookmark").select("id", "book_id", "content", "cfi", "chapter", F.coalesce(F.col("color").try_cast("double"), F.lit(0.0)).alias("percentage"), "update_time")
