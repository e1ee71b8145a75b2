"""Changes of tables, as functions from versions to versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quire.functions import dates
from quire.operators import access, aggregates, filters


def captured(sessions: DataFrame) -> DataFrame:
    """Reading rows of sessions (book_id, started, ended, reason): a pause or a hidden or detached app counts from six seconds on, the end of reading always. All of it goes to the day of the start."""
    s = (F.unix_timestamp("ended") - F.unix_timestamp("started")).cast("long")
    return sessions.withColumn("reading_time", s).where((F.col("reason") == "dispose") | ((s > 5) & F.col("reason").isin("paused", "hidden", "detached"))).select("book_id", F.date_format("started", "yyyy-MM-dd").alias("date"), "reading_time")


def merged_reading(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Seconds by book and day of the old rows and the new ones: what repeated additions to one row a day come to."""
    both = rows.select("book_id", "date", "reading_time").unionByName(new.select("book_id", "date", "reading_time"))
    return both.groupBy("book_id", dates.day("date").alias("day")).agg(F.sum("reading_time").cast("long").alias("reading_time"))


def saved_notes(notes: DataFrame, new: DataFrame) -> DataFrame:
    """Of the old and the new annotations, the last change of each place in a book; notes of other types stay as they are."""
    w = Window.partitionBy("book_id", "cfi").orderBy(F.desc("update_time"), F.desc("id"))
    both = notes.unionByName(new, allowMissingColumns=True)
    kept = both.where(filters.annotation()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return kept.unionByName(both.where(~filters.annotation()))


def new_bookmarks(notes: DataFrame, marks: DataFrame) -> DataFrame:
    """Bookmarks at places where the book has no note of any type."""
    return marks.join(notes, ["cfi", "book_id"], "left_anti")


def saved_books(books: DataFrame, changes: DataFrame, as_of: str) -> DataFrame:
    """Books with changes put in, their change time set; those with id -1 are new."""
    changed = changes.where("id <> -1").withColumn("update_time", F.lit(as_of).cast("timestamp_ntz"))
    new = access.numbered(changes.where("id = -1"), books).withColumn("update_time", F.lit(as_of).cast("timestamp_ntz"))
    return access.upserted(books, changed, "id").unionByName(new, allowMissingColumns=True)


def imported(books: DataFrame, files: DataFrame, as_of: str) -> DataFrame:
    """Books from imported files (file_md5, title, author, file_path): one known by its hash keeps title, author, place, progress, rating and
    creation, loses description and group, and is no longer deleted; within a batch a hash counts once."""
    w = Window.partitionBy("file_md5").orderBy("file_path")
    once = files.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    last = books.where(F.col("file_md5") != "").groupBy("file_md5").agg(F.max_by(F.struct(*books.columns), "id").alias("old"))
    j = once.join(last, "file_md5", "left")
    keep = lambda c, new: F.coalesce(F.col("old")[c], new).alias(c)
    return j.select(
        F.col("old.id").alias("id"), keep("title", F.col("title")), keep("author", F.col("author")), "file_path", "file_md5", keep("last_read_position", F.lit("")), keep("reading_percentage", F.lit(0.0)),
        keep("rating", F.lit(0.0)), F.lit(None).cast("string").alias("description"), F.lit(0).cast("long").alias("group_id"), F.lit(False).alias("is_deleted"),
        keep("create_time", F.lit(as_of).cast("timestamp_ntz")), F.lit(as_of).cast("timestamp_ntz").alias("update_time"),
    )


def duplicates(books: DataFrame, files: DataFrame) -> DataFrame:
    """Each file (name, file_md5) with the newest book of its hash, whether that makes it a duplicate (a deleted book doesn't), and its place among the batch's files of that hash."""
    known = books.where(F.col("file_md5") != "").groupBy("file_md5").agg(F.max_by(F.struct("id", "is_deleted"), F.struct(~F.col("is_deleted"), F.col("id"))).alias("b"))
    w = Window.partitionBy("file_md5").orderBy("name")
    return files.withColumn("copy", F.row_number().over(w)).join(known, "file_md5", "left").select("name", "file_md5", "copy", F.col("b.id").alias("duplicate_book"), F.coalesce(~F.col("b.is_deleted"), F.lit(False)).alias("is_duplicate"))


def soft_deleted(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    flags = keys.select(key).distinct().withColumn("_gone", F.lit(True))
    return table.join(flags, key, "left").withColumn("is_deleted", F.col("is_deleted") | F.coalesce("_gone", F.lit(False))).drop("_gone")


def added_groups(groups: DataFrame, new: DataFrame) -> DataFrame:
    """Groups with those of new (id, name, parent_id) that aren't there; ... is the name of one without, the root its parent."""
    rows = new.join(groups, "id", "left_anti").select("id", F.coalesce("name", F.lit("...")).alias("name"), F.coalesce("parent_id", F.lit(0)).cast("long").alias("parent_id"), F.lit(False).alias("is_deleted"))
    return groups.unionByName(rows, allowMissingColumns=True)


def renamed_groups(groups: DataFrame, names: DataFrame) -> DataFrame:
    return groups.join(names.select("id", F.col("name").alias("_new")), "id", "left").withColumn("name", F.coalesce("_new", "name")).drop("_new")


def added_tags(tags: DataFrame, names: DataFrame) -> DataFrame:
    """Tags with those of names that aren't there in any case; in a batch the first spelling in order counts."""
    once = names.groupBy(F.lower("name").alias("low")).agg(F.min("name").alias("name"))
    new = once.join(tags.select(F.lower("name").alias("low")), "low", "left_anti").select("name", F.lit(None).cast("long").alias("rgb"))
    return tags.unionByName(access.numbered(new, tags).select("id", "name", "rgb"))


def merged_tags(links: DataFrame, source: int, target: int) -> DataFrame:
    """Links with the source tag's moved to the target, each book linked once."""
    return links.withColumn("tag_id", F.when(F.col("tag_id") == source, target).otherwise(F.col("tag_id")).cast("long")).groupBy("book_id", "tag_id").agg(F.min("id").alias("id"))


def without_tag(tags: DataFrame, links: DataFrame, tag: int) -> tuple[DataFrame, DataFrame]:
    return tags.where(F.col("id") != tag), links.where(F.col("tag_id") != tag)


def without_readings(rows: DataFrame, books: DataFrame) -> DataFrame:
    return rows.join(books.select(F.col("id").alias("book_id")), "book_id", "left_anti")


def organised(books: DataFrame, plan: DataFrame, as_of: str) -> DataFrame:
    """Books after a plan (book_id, group_id): only those whose group changes are touched."""
    j = books.join(plan.select(F.col("book_id").alias("id"), F.col("group_id").alias("_to")), "id", "left")
    moves = F.col("_to").isNotNull() & (F.col("_to") != F.col("group_id"))
    return j.withColumn("update_time", F.when(moves, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("update_time"))).withColumn("group_id", F.when(moves, F.col("_to")).otherwise(F.col("group_id"))).drop("_to")


def empty_groups(groups: DataFrame, books: DataFrame) -> DataFrame:
    """Groups other than the root with no live book and no live child: what cleaning up after a plan removes."""
    held = filters.live(books).select(F.col("group_id").alias("id")).union(groups.where(~F.col("is_deleted")).select(F.col("parent_id").alias("id")))
    return groups.where((F.col("id") != 0) & ~F.col("is_deleted")).join(held, "id", "left_anti")


def schema_version_ok(version: int) -> bool:
    from quire import schema

    return 0 < version <= schema.VERSION


def deletable_themes(themes: DataFrame, ids: list[int], keep: int = 2) -> DataFrame:
    """Themes without those of ids, or all of them where fewer than `keep` would stay."""
    left = themes.where(~F.col("id").isin(ids)) if ids else themes
    return left if left.count() >= keep else themes


def migrated(tables: dict[str, DataFrame], version: int, base: str = "") -> dict[str, DataFrame]:
    """Tables of an older version in the current one's columns: what is new is empty, paths lose the base folder, groups in use get a row."""
    from quire import schema

    if not 0 <= version <= schema.VERSION:
        raise ValueError(f"version {version} is newer than {schema.VERSION}")
    out = dict(tables)
    books = out["books"]
    new = {"rating": F.lit(0.0), "group_id": F.lit(0).cast("long"), "file_md5": F.lit(None).cast("string")}
    for c, v in new.items():
        books = books if c in books.columns else books.withColumn(c, v)
    if base:
        for c in ("cover_path", "file_path"):
            books = books.withColumn(c, F.replace(c, F.lit(base), F.lit("")))
    out["books"] = books
    if "reader_note" not in out["notes"].columns:
        out["notes"] = out["notes"].withColumn("reader_note", F.lit(None).cast("string"))
    if "groups" not in out:
        used = aggregates.group_ids(books).select(F.col("group_id").alias("id"), F.lit("...").alias("name"), F.lit(0).cast("long").alias("parent_id"), F.lit(False).alias("is_deleted"))
        root = books.sparkSession.range(1).select("id", F.lit("Root").alias("name"), F.lit(None).cast("long").alias("parent_id"), F.lit(False).alias("is_deleted"))
        out["groups"] = root.unionByName(used)
    return out
