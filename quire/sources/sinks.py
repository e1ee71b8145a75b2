"""Exports: notes as CSV, Markdown and text, snapshots of a library, checks of a snapshot, JSON envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire import schema
from quire.operators import aggregates, filters


def notes_table(notes: DataFrame, books: DataFrame) -> DataFrame:
    """The nine columns of the CSV export, colours with their sign; a note without creation time keeps it empty."""
    named = notes.join(books.select(F.col("id").alias("book_id"), "title", "author"), "book_id")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return named.select(
        F.col("title").alias("Book"), F.col("author").alias("Author"), F.col("chapter").alias("Chapter"), F.col("content").alias("Content"), F.col("reader_note").alias("Reader Note"), F.col("type").alias("Type"),
        F.concat(F.lit("#"), "color").alias("Color"), iso("create_time").alias("Create Time"), iso("update_time").alias("Update Time"),
    )


def write_csv(table: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    table.write.option("header", "true").option("encoding", encoding).option("quote", '"').option("escape", '"').csv(path)


def _note_lines(markdown: bool) -> Column:
    content, note = F.coalesce("content", F.lit("")), F.coalesce("reader_note", F.lit(""))
    if markdown:
        return F.concat(F.when(content != "", F.concat(F.lit("> "), content, F.lit("\n\n"))).otherwise(""), F.when(note != "", F.concat(note, F.lit("\n\n"))).otherwise(""), F.lit("\n"))
    return F.concat(F.when(content != "", F.concat(F.lit("\t"), content, F.lit("\n"))).otherwise(""), F.when(note != "", F.concat(F.lit("\t\t"), note, F.lit("\n"))).otherwise(""), F.lit("\n"))


def rendered(notes: DataFrame, books: DataFrame, kind: str = "md", merge: bool = True) -> DataFrame:
    """book_id, text: each book's notes in order of id under their chapters, runs of one chapter together if merged; as Markdown, plain text, or what is copied (with author)."""
    from pyspark.sql import Window

    w = Window.partitionBy("book_id").orderBy("id")
    new = F.coalesce((F.lag("chapter").over(w) != F.col("chapter")).cast("int"), F.lit(1)) if merge else F.lit(1)
    marked = notes.withColumn("_new", new).withColumn("run", F.sum("_new").over(w))
    grouped = marked.groupBy("book_id", "run").agg(F.first("chapter").alias("chapter"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", _note_lines(kind == "md").alias("t")))), lambda x: x["t"]), "").alias("body"))
    if kind == "md":
        text = F.concat(F.lit("## "), F.coalesce("chapter", F.lit("")), F.lit("\n\n"), "body")
    else:
        text = F.regexp_replace(F.concat(F.when(F.coalesce("chapter", F.lit("")) != "", F.concat("chapter", F.lit("\n"))).otherwise(""), F.col("body")), r"(?U)^\s+|\s+$", "")
    joined = grouped.groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", text.alias("t")))), lambda x: x["t"]), "" if kind == "md" else "\n\n").alias("body"))
    head = {"md": F.concat(F.lit("# "), "title", F.lit("\n\n *"), "author", F.lit("*\n\n")), "copy": F.concat("title", F.lit("\n\t"), "author", F.lit("\n\n"))}.get(kind, F.lit(""))
    return joined.join(books.select(F.col("id").alias("book_id"), "title", "author"), "book_id").select("book_id", F.concat(head, "body").alias("text"))


def snapshot(library, path: str) -> str:  # noqa: ANN001
    """A whole library as a new folder: written, then marked as whole by its version table, last."""
    library.save(path)
    library.spark.createDataFrame([(schema.VERSION,)], "version int").coalesce(1).write.parquet(f"{path}/version")
    return path


def restored(spark: SparkSession, path: str, target: str) -> None:
    """Puts a snapshot that passes its checks in a library's place, or raises ValueError."""
    from quire.operators.access import replace_atomically
    from quire.sources.library import Library

    if failed := [r["check"] for r in checks(spark, path).where("NOT ok").collect()]:
        raise ValueError(f"snapshot fails: {', '.join(failed)}")
    for name in ("books", "notes", "reading_time", "groups", "tags", "book_tags"):
        replace_atomically(spark, Library(spark, path).table(name), f"{target}/{name}")


def checks(spark: SparkSession, path: str) -> DataFrame:
    """check, ok, detail of a snapshot: it is there, its tables can be read, it has books, it isn't newer than this schema."""
    found: list[tuple[str, bool, str]] = []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = files.exists(hadoop)
    found.append(("exists", there, path))
    if there:
        size = files.getContentSummary(hadoop).getLength()
        found.append(("size", size >= 1024, str(size)))
        for name in ("books", "notes", "groups"):
            table = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
            found.append((f"table {name}", files.exists(table), name))
        if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/books")):
            n = spark.read.schema(schema.SCHEMAS["books"]).parquet(f"{path}/books").count()
            found.append(("has books", n > 0, str(n)))
        marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version")
        version = spark.read.parquet(f"{path}/version").first()[0] if files.exists(marker) else 0
        found.append(("version", 0 < version <= schema.VERSION, str(version)))
    return spark.createDataFrame(found, "check string, ok boolean, detail string")


def integrity(library) -> DataFrame:  # noqa: ANN001
    """check, ok, detail over a library's tables in one row a check: required tables filled, keys unique, references whole."""
    books, notes, rows = library.books, library.notes, library.reading_time
    one = lambda df, name, ok, detail: df.select(F.lit(name).alias("check"), ok.alias("ok"), detail.cast("string").alias("detail"))
    n = books.agg(F.count("*").alias("n"), F.count_distinct("id").alias("d"))
    orphans = rows.join(books, rows["book_id"] == books["id"], "left_anti").agg(F.count("*").alias("n"))
    dup = notes.where(filters.annotation()).groupBy("cfi", "book_id").count().where("count > 1").agg(F.count("*").alias("n"))
    return (
        one(n, "has books", F.col("n") > 0, F.col("n")).unionByName(one(n, "book ids unique", F.col("n") == F.col("d"), F.col("n") - F.col("d")))
        .unionByName(one(orphans, "readings have books", F.col("n") == 0, F.col("n"))).unionByName(one(dup, "places unique", F.col("n") == 0, F.col("n")))
    )


def envelope(df: DataFrame, name: str) -> DataFrame:
    """One JSON text: {"status": "ok", "name": …, "data": [rows]}, rows in order of their JSON. What it holds was limited by the tool before."""
    data = F.sort_array(F.collect_list(F.struct(*df.columns)))
    return df.agg(F.to_json(F.struct(F.lit("ok").alias("status"), F.lit(name).alias("name"), data.alias("data"))).alias("json"))


def error_envelope(name: str, message: str) -> str:
    import json

    return json.dumps({"status": "error", "name": name, "message": message})


def storage(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Bytes by kind of file, and of all."""
    by = aggregates.storage(files)
    return by.unionByName(aggregates.storage(files.withColumn("kind", F.lit("total"))))
