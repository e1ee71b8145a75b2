"""A reading library, as tables of a folder or as views over the driver's generic tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire import schema
from quire.functions import dates


class Library:
    """A library stored as one Parquet table for each of the schema's tables."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        derived = ", day date" if name == "reading_time" else ""
        return self.spark.read.schema(schema.SCHEMAS[name] + derived).parquet(f"{self.path}/{name}")

    @cached_property
    def books(self) -> DataFrame:
        return self.table("books")

    @cached_property
    def notes(self) -> DataFrame:
        return self.table("notes")

    @cached_property
    def reading_time(self) -> DataFrame:
        return self.table("reading_time")

    @cached_property
    def groups(self) -> DataFrame:
        return self.table("groups")

    @cached_property
    def tags(self) -> DataFrame:
        return self.table("tags")

    @cached_property
    def book_tags(self) -> DataFrame:
        return self.table("book_tags")

    @cached_property
    def sections(self) -> DataFrame:
        """The books' own text, section by section."""
        return self.table("sections")

    def save(self, path: str) -> None:
        """Writes every table as a new snapshot folder. Reading rows get their day and lie in its order, so that a period's files and row groups are all that is read."""
        for name in ("books", "notes", "groups", "tags", "book_tags"):
            getattr(self, name).write.parquet(f"{path}/{name}")
        rows = self.reading_time.withColumn("day", dates.day_of(self.reading_time))
        rows.repartitionByRange("day", "id").sortWithinPartitions("day", "book_id").write.parquet(f"{path}/reading_time")


class DriverLibrary(Library):
    """The canonical views over the driver's tables; `plans.views` says the same in SQL."""

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def reading_time(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id AS id", "user_id AS book_id", "CASE WHEN event_id % 2 = 0 THEN date_format(ts, 'yyyy-MM-dd') ELSE date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") END AS date",
            "CAST(floor(value) AS BIGINT) AS reading_time", "CAST(ts AS DATE) AS day",
        )

    @cached_property
    def books(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "p_partkey AS id", "p_name AS title", "'' AS cover_path", "concat('file/', p_partkey, '.', element_at(array('epub', 'mobi', 'azw3', 'fb2', 'txt', 'pdf'), CAST(p_partkey % 6 AS INT) + 1)) AS file_path",
            "concat('epubcfi(/6/', 2 * (p_partkey % 30) + 2, '!/4/', 2 * (p_partkey % 9) + 2, ')') AS last_read_position", "p_size / 50D AS reading_percentage", "p_brand AS author", "p_partkey % 10 = 0 AS is_deleted",
            "CASE WHEN p_partkey % 2 = 0 THEN p_type END AS description", "CAST(p_partkey % 6 AS DOUBLE) AS rating", "p_partkey % 7 AS group_id",
            "CASE p_partkey % 3 WHEN 1 THEN md5(p_name) WHEN 2 THEN '' END AS file_md5", "timestamp_ntz'2023-06-01 00:00:00' + make_dt_interval(0, CAST(p_partkey AS INT)) AS create_time",
            "timestamp_ntz'2023-12-01 00:00:00' + make_dt_interval(0, 0, CAST((p_partkey * 37) % 50000 AS INT)) AS update_time",
        )

    @cached_property
    def notes(self) -> DataFrame:
        return self.raw("documents").selectExpr(
            "doc_id + 1 AS id", "doc_id % 150 AS book_id", "text AS content",
            "concat('epubcfi(/6/', 2 * (doc_id % 40) + 2, '!/4/', 2 * (doc_id % 25) + 2, '/1:', doc_id % 97, ')') AS cfi", "source AS chapter",
            "element_at(array('highlight', 'underline', 'bookmark', 'draft'), CAST(doc_id % 4 AS INT) + 1) AS type",
            "CASE WHEN doc_id % 4 = 2 THEN format_string('%.2f', (doc_id % 100) / 100D) ELSE element_at(array('66ccff', 'FF0000', '00FF00', 'EB3BFF', 'FFD700', '123456'), CAST(doc_id % 6 AS INT) + 1) END AS color",
            "CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' ELSE concat('note ', doc_id, ' ', lang) END AS reader_note",
            "CASE WHEN doc_id % 11 > 0 THEN timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(doc_id * 7 AS INT)) END AS create_time",
            "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST((doc_id * 7919) % 40000 AS INT)) AS update_time",
        )

    @cached_property
    def groups(self) -> DataFrame:
        when = "timestamp_ntz'2024-01-01 00:00:00' AS create_time", "timestamp_ntz'2024-01-01 00:00:00' AS update_time"
        root = self.spark.range(1).selectExpr("id", "'Root' AS name", "CAST(NULL AS BIGINT) AS parent_id", "false AS is_deleted", *when)
        top = self.raw("region").selectExpr("CAST(r_regionkey + 1 AS BIGINT) AS id", "r_name AS name", "0L AS parent_id", "false AS is_deleted", *when)
        rest = self.raw("nation").selectExpr("CAST(n_nationkey + 100 AS BIGINT) AS id", "n_name AS name", "CAST(n_regionkey + 1 AS BIGINT) AS parent_id", "n_nationkey % 9 = 8 AS is_deleted", *when)
        return root.unionByName(top).unionByName(rest)

    @cached_property
    def tags(self) -> DataFrame:
        return self.spark.sql("SELECT * FROM VALUES (1L, 'quality', 6737151L), (2L, 'Toxic', 16711680L), (3L, 'unused', CAST(NULL AS BIGINT)) AS t(id, name, rgb)")

    @cached_property
    def book_tags(self) -> DataFrame:
        labels = self.raw("labels")
        one, two = (labels.where(F.col(c) == 1).selectExpr(f"CAST(doc_id * 2 + {k} AS BIGINT) AS id", "doc_id AS book_id", f"{k}L AS tag_id") for k, c in ((1, "quality"), (2, "toxic")))
        return one.unionByName(two)

    @cached_property
    def sections(self) -> DataFrame:
        return self.raw("documents").selectExpr("doc_id % 150 AS book_id", "CAST(doc_id DIV 150 AS INT) AS section_idx", "concat(source, ' ', lang) AS title", "concat('s', doc_id DIV 150, '.xhtml') AS href", "text AS content")

    @cached_property
    def history(self) -> DataFrame:
        """One row for each conversation, its messages in order."""
        turns = self.raw("conversations")
        return turns.groupBy(F.col("conv_id").alias("id")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("messages"), F.count("*").alias("n_messages"),
        ).withColumn("updated_at", (F.col("id") * 7919) % 100003)

    @cached_property
    def files(self) -> DataFrame:
        """name, side: which files are here and which on the remote side."""
        name = "substring_index(file_path, '/', -1) AS name"
        local = self.books.where("rating <> 3").selectExpr(name, "'local' AS side")
        remote = self.books.where("group_id <> 2").selectExpr(name, "'remote' AS side")
        stray = self.spark.sql("SELECT * FROM VALUES ('stray-a.epub', 'local'), ('stray-b.epub', 'remote') AS t(name, side)")
        return local.unionByName(remote).unionByName(stray)
