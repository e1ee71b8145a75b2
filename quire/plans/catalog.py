"""Named queries over the canonical views, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.functions import dates, numbers, strings
from quire.operators import access, aggregates, changes, filters, joins, sets, sorts, windows
from quire.plans.views import with_views
from quire.sources.library import DriverLibrary

AS_OF = "2024-01-30"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOTES = "('highlight', 'underline', 'bookmark')"


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of a library as a query of a session and a folder."""

    def add(f: Callable[[DriverLibrary], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(DriverLibrary(spark, sf_dir))
        if sql:
            SQL[name] = with_views(" ".join(sql.split()))
        return f

    return add


# --- generic access ---------------------------------------------------------


@query("g1_select", f"SELECT type, count(*) AS n FROM notes WHERE type IN {NOTES} GROUP BY type HAVING count(*) > 1")
def g1(lib: DriverLibrary) -> DataFrame:
    return access.select(lib.notes, where=filters.annotation(), group_by=["type"], aggregates=[F.count("*").alias("n")], having=F.col("n") > 1)


@query("g1_page", "SELECT id, title FROM books ORDER BY id LIMIT 10 OFFSET 5")
def g1_page(lib: DriverLibrary) -> DataFrame:
    return access.select(lib.books, columns=["id", "title"], order_by=["id"], limit=10, offset=5)


@query("g2_single", "SELECT id, title FROM books WHERE id = 7")
def g2(lib: DriverLibrary) -> DataFrame:
    return access.single(lib.books, columns=["id", "title"], where=F.col("id") == 7, order_by=["id"])


@query("g3_statement", "SELECT book_id, sum(reading_time)::BIGINT AS seconds FROM reading_time WHERE book_id < 20 GROUP BY book_id")
def g3(lib: DriverLibrary) -> DataFrame:
    return access.statement(lib.spark, "SELECT book_id, sum(reading_time) AS seconds FROM {rows} WHERE book_id < :most GROUP BY book_id", {"most": 20}, rows=lib.reading_time)


@query("g4_write", "SELECT id, CASE WHEN rating = 0 THEN 'renamed' ELSE title END AS title FROM books WHERE group_id <> 3")
def g4(lib: DriverLibrary) -> DataFrame:
    changed = access.upserted(lib.books.select("id", "title"), lib.books.where("rating = 0").select("id", F.lit("renamed").alias("title")), "id")
    return access.deleted(changed, lib.books.where("group_id = 3").select("id"), "id")


# --- sources ----------------------------------------------------------------


@query("c1_table_scan", "SELECT id, name, parent_id FROM lib_groups")
def c1(lib: DriverLibrary) -> DataFrame:
    return lib.groups.select("id", "name", "parent_id")


@query("c7_duplicates", """SELECT f.name, f.file_md5, CAST(row_number() OVER (PARTITION BY f.file_md5 ORDER BY f.name) AS INT) AS copy, b.id AS duplicate_book, coalesce(NOT b.is_deleted, false) AS is_duplicate
    FROM (SELECT 'part-' || p_partkey AS name, md5(p_name) AS file_md5 FROM part) f LEFT JOIN
    (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_md5 ORDER BY is_deleted, id DESC) AS n FROM books WHERE file_md5 <> '') WHERE n = 1) b ON b.file_md5 = f.file_md5""")
def c7(lib: DriverLibrary) -> DataFrame:
    return changes.duplicates(lib.books, lib.raw("part").selectExpr("concat('part-', p_partkey) AS name", "md5(p_name) AS file_md5"))


_FILES = "SELECT split_part(file_path, '/', 2) AS name, CASE WHEN rating = 2 THEN 0 ELSE id * 100 END AS length FROM books WHERE group_id <> 4"


@query("c8_md5_backfill", f"""SELECT count(*) FILTER (f.length > 0) AS calculated, count(*) FILTER (f.length IS NULL) AS skipped, count(*) FILTER (f.length = 0) AS failed, count(*) AS total
    FROM books b LEFT JOIN ({_FILES}) f ON f.name = split_part(b.file_path, '/', 2) WHERE NOT b.is_deleted AND coalesce(b.file_md5, '') = ''""")
def c8(lib: DriverLibrary) -> DataFrame:
    return aggregates.hash_backfill(lib.books, lib.books.where("group_id <> 4").selectExpr("substring_index(file_path, '/', -1) AS name", "CASE WHEN rating = 2 THEN 0 ELSE id * 100 END AS length"))


@query("c9_md5_statistics", """SELECT count(*) AS total, count(*) FILTER (coalesce(file_md5, '') <> '') AS with_md5, count(*) FILTER (coalesce(file_md5, '') = '') AS without_md5,
    count(*) FILTER (here) AS local, count(*) FILTER (here AND coalesce(file_md5, '') = '') AS local_without_md5
    FROM (SELECT b.*, f.name IS NOT NULL AS here FROM books b LEFT JOIN files f ON f.side = 'local' AND f.name = split_part(b.file_path, '/', 2) WHERE NOT b.is_deleted)""")
def c9(lib: DriverLibrary) -> DataFrame:
    return aggregates.hash_statistics(lib.books, lib.files)


# --- filters ----------------------------------------------------------------


@query("f1_live_books", "SELECT row_number() OVER (ORDER BY update_time DESC, id) - 1 AS place, id, title, update_time FROM books WHERE NOT is_deleted")
def f1(lib: DriverLibrary) -> DataFrame:
    return sorts.placed(filters.live(lib.books).select("id", "title", "update_time").orderBy(F.desc("update_time"), "id"))


@query("f2_by_id", "SELECT id, type, cfi FROM notes WHERE id = 42")
def f2(lib: DriverLibrary) -> DataFrame:
    return filters.by_id(lib.notes, 42).select("id", "type", "cfi")


@query("f3_by_ids", "SELECT id, title FROM books WHERE id IN (3, 10, 17, 999999) AND NOT is_deleted")
def f3(lib: DriverLibrary) -> DataFrame:
    return filters.by_ids(lib.books, [3, 10, 17, 999999]).select("id", "title")


@query("f4_keyword", "SELECT id, title, author FROM books WHERE NOT is_deleted AND (title ILIKE '%bRand#1_%' OR author ILIKE '%bRand#1_%')")
def f4(lib: DriverLibrary) -> DataFrame:
    return filters.matching(lib.books, " bRand#1_ ").select("id", "title", "author")


@query("f5_shelf_search", "SELECT id, title FROM books WHERE NOT is_deleted AND (contains(title, 'a') OR contains(author, 'a'))")
def f5(lib: DriverLibrary) -> DataFrame:
    return filters.on_shelf(lib.books, "a").select("id", "title")


@query("f6_unhashed", "SELECT id FROM books WHERE NOT is_deleted AND (file_md5 IS NULL OR file_md5 = '')")
def f6(lib: DriverLibrary) -> DataFrame:
    return filters.unhashed(lib.books).select("id")


@query("f7_annotations", f"SELECT id, type FROM notes WHERE type IN {NOTES}")
def f7(lib: DriverLibrary) -> DataFrame:
    return lib.notes.where(filters.annotation()).select("id", "type")


@query("f8_notes_of_book", f"SELECT row_number() OVER (ORDER BY update_time DESC, id) - 1 AS place, id, cfi, update_time FROM notes WHERE type IN {NOTES} AND book_id = 12")
def f8(lib: DriverLibrary) -> DataFrame:
    return sorts.placed(filters.notes_of(lib.notes, 12).select("id", "cfi", "update_time").orderBy(F.desc("update_time"), "id"))


@query("f8_notes_at_place", f"SELECT id, type FROM notes WHERE type IN {NOTES} AND book_id = 12 AND cfi = 'epubcfi(/6/26!/4/26/1:12)'")
def f8b(lib: DriverLibrary) -> DataFrame:
    return filters.notes_at(lib.notes, "epubcfi(/6/26!/4/26/1:12)", 12).select("id", "type")


@query("f9_note_search", f"""SELECT id, book_id FROM notes WHERE (content ILIKE '%the%' OR reader_note ILIKE '%the%' OR chapter ILIKE '%the%')
    AND update_time >= TIMESTAMP '2024-01-05 00:00:00' AND update_time <= TIMESTAMP '2024-01-20 00:00:00' AND type IN {NOTES}""")
def f9(lib: DriverLibrary) -> DataFrame:
    return filters.notes_where(lib.notes, " the ", None, "2024-01-05", "2024-01-20").select("id", "book_id")


@query("f9_note_search_any_type", "SELECT id, book_id FROM notes WHERE book_id = 7")
def f9b(lib: DriverLibrary) -> DataFrame:
    return filters.notes_where(lib.notes, book=7, types=[]).select("id", "book_id")


@query("f10_history_filter", """SELECT id, book_id, reading_time FROM reading_time WHERE try_cast(date AS TIMESTAMP) >= TIMESTAMP '2024-01-10 00:00:00' AND try_cast(date AS TIMESTAMP) <= TIMESTAMP '2024-01-12 00:00:00'""")
def f10(lib: DriverLibrary) -> DataFrame:
    return filters.reading_where(lib.reading_time, None, "2024-01-10", "2024-01-12").select("id", "book_id", "reading_time")


@query("f11_day_range", "SELECT id, reading_time FROM reading_time WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'")
def f11(lib: DriverLibrary) -> DataFrame:
    return filters.days_between(lib.reading_time, "2024-01-10", "2024-01-12").select("id", "reading_time")


@query("f12_status", "SELECT id, CASE WHEN reading_percentage <= 0.02 THEN 'notStarted' WHEN reading_percentage < 0.98 THEN 'reading' ELSE 'finished' END AS status FROM books WHERE NOT is_deleted")
def f12(lib: DriverLibrary) -> DataFrame:
    return filters.live(lib.books).select("id", filters.status().alias("status"))


@query("f13_all_tags", "SELECT id FROM books WHERE NOT is_deleted AND id IN (SELECT book_id FROM book_tags WHERE tag_id IN (1, 2) GROUP BY book_id HAVING count(DISTINCT tag_id) = 2)")
def f13(lib: DriverLibrary) -> DataFrame:
    return filters.with_all_tags(lib.books, lib.book_tags, [1, 2]).select("id")


@query("f13_untagged", "SELECT id FROM books WHERE NOT is_deleted AND id NOT IN (SELECT book_id FROM book_tags)")
def f13b(lib: DriverLibrary) -> DataFrame:
    return filters.with_all_tags(lib.books, lib.book_tags.select("book_id", "tag_id"), [-1, 1]).select("id")


@query("f14_shown_notes", """SELECT id FROM notes WHERE (type IN ('highlight', 'underline') AND upper(color) IN ('66CCFF', 'FF0000', '00FF00', 'EB3BFF', 'FFD700')) OR type = 'bookmark'""")
def f14(lib: DriverLibrary) -> DataFrame:
    return filters.shown_notes(lib.notes).select("id")


@query("f15_nearly_done", "SELECT id, reading_percentage FROM books WHERE NOT is_deleted AND reading_percentage >= 0.6 AND reading_percentage < 0.93")
def f15(lib: DriverLibrary) -> DataFrame:
    return filters.nearly_done(lib.books).select("id", "reading_percentage")


@query("f16_shelf_lookup", "SELECT id, title FROM books WHERE NOT is_deleted AND group_id = 3 AND (title ILIKE '%an%' OR author ILIKE '%an%')")
def f16(lib: DriverLibrary) -> DataFrame:
    return filters.shelf_lookup(lib.books, "an", 3, include_deleted=True).select("id", "title")


@query("f17_decoded_tags", "SELECT id, name, rgb FROM tags WHERE rgb IS NOT NULL")
def f17(lib: DriverLibrary) -> DataFrame:
    from quire import schema

    styles = lib.tags.selectExpr("id", "1.00003D AS font_size", "name AS font_family", "CAST(rgb AS DOUBLE) AS line_height").where("line_height IS NOT NULL")
    return schema.tags_of_styles(styles.unionByName(styles.withColumn("font_size", F.lit(2.0))))


@query("f18_children", "SELECT id, name FROM lib_groups WHERE NOT is_deleted AND parent_id = 2")
def f18(lib: DriverLibrary) -> DataFrame:
    return filters.children(lib.groups, 2).select("id", "name")


@query("f19_bookmarks", "SELECT id, book_id, cfi, CAST(color AS DOUBLE) AS percentage FROM notes WHERE type = 'bookmark' AND book_id = 10")
def f19(lib: DriverLibrary) -> DataFrame:
    from quire import schema

    return schema.bookmarks_of_notes(lib.notes).where("book_id = 10").select("id", "book_id", "cfi", "percentage")


@query("f20_importable", "SELECT file_path FROM books WHERE regexp_extract(file_path, '[^.]*$') IN ('epub', 'mobi', 'azw3', 'fb2', 'txt', 'pdf')")
def f20(lib: DriverLibrary) -> DataFrame:
    return filters.importable(lib.books.select("file_path").union(lib.books.select(F.lit("a/b.docx"))), "file_path")


@query("f21_cards", "SELECT id, title, author, reading_percentage, group_id, is_deleted FROM books")
def f21(lib: DriverLibrary) -> DataFrame:
    return lib.books.select(*filters.book_card())


# --- joins ------------------------------------------------------------------


@query("j1_named_totals", "SELECT b.id AS book_id, title, author, sum(reading_time)::BIGINT AS seconds FROM reading_time r JOIN books b ON b.id = r.book_id WHERE NOT is_deleted GROUP BY b.id, title, author")
def j1(lib: DriverLibrary) -> DataFrame:
    return joins.named_totals(lib.reading_time.groupBy("book_id").agg(aggregates.seconds().alias("seconds")), lib.books)


_SNIP = "CASE WHEN reader_note IS NOT NULL AND trim(reader_note) <> '' THEN reader_note WHEN length(content) > 160 THEN substring(content, 1, 157) || '…' ELSE content END"


@query("j2_first_notes", f"""SELECT n.id AS note_id, n.book_id, chapter, type, {_SNIP} AS snippet, n.update_time, title, author
    FROM (SELECT * FROM notes WHERE type IN {NOTES} ORDER BY update_time DESC, id DESC LIMIT 30) n JOIN books b ON b.id = n.book_id AND NOT is_deleted""")
def j2(lib: DriverLibrary) -> DataFrame:
    return joins.first_notes(filters.notes_where(lib.notes), lib.books, 30)


@query("j3_first_readings", """SELECT r.id, r.book_id, r.date, r.reading_time, title FROM (SELECT * FROM reading_time ORDER BY try_cast(date AS TIMESTAMP) DESC, id DESC LIMIT 20) r JOIN books b ON b.id = r.book_id AND NOT is_deleted""")
def j3(lib: DriverLibrary) -> DataFrame:
    return joins.first_readings(lib.reading_time, lib.books, 20).select("id", "book_id", "date", "reading_time", "title")


@query("j4_notes_by_book", f"""SELECT book_id, title, count(*) AS n_notes, max(n.update_time) AS latest, arg_max(n.id, (n.update_time, n.id)) AS newest_note
    FROM notes n JOIN books b ON b.id = n.book_id AND NOT is_deleted WHERE type IN {NOTES} AND content ILIKE '%on%' GROUP BY book_id, title""")
def j4(lib: DriverLibrary) -> DataFrame:
    found = joins.notes_by_book(lib.notes.where(filters.annotation() & strings.contains_folded("content", "on")), lib.books)
    return found.select("book_id", "title", "n_notes", "latest", F.col("notes")[0]["id"].alias("newest_note"))


@query("j5_tag_names", """SELECT b.id AS book_id, coalesce(string_agg(t.name, ',' ORDER BY t.name), '') AS tags FROM books b LEFT JOIN book_tags l ON l.book_id = b.id LEFT JOIN tags t ON t.id = l.tag_id GROUP BY b.id""")
def j5(lib: DriverLibrary) -> DataFrame:
    return joins.tag_names(lib.books, lib.book_tags, lib.tags).select("book_id", F.array_join("tags", ",").alias("tags"))


@query("j6_tags_of_books", """SELECT b.id AS book_id, title, coalesce(string_agg(t.name, ',' ORDER BY t.name), '') AS tags FROM books b LEFT JOIN book_tags l ON l.book_id = b.id LEFT JOIN tags t ON t.id = l.tag_id
    WHERE b.id IN (1, 2, 3, 10) AND NOT is_deleted GROUP BY b.id, title""")
def j6(lib: DriverLibrary) -> DataFrame:
    return joins.tags_of_books(lib.books, lib.book_tags, lib.tags, [1, 2, 3, 10]).select("book_id", "title", F.array_join("tags", ",").alias("tags"))


@query("j7_note_statistics", f"""SELECT n.book_id, title, n_notes, coalesce(seconds, 0)::BIGINT AS seconds FROM (SELECT book_id, count(*) AS n_notes FROM notes WHERE type IN {NOTES} AND book_id <> 0 GROUP BY book_id) n
    JOIN books b ON b.id = n.book_id LEFT JOIN (SELECT book_id, sum(reading_time) AS seconds FROM reading_time GROUP BY book_id) r ON r.book_id = n.book_id""")
def j7(lib: DriverLibrary) -> DataFrame:
    return joins.note_statistics(lib.notes, lib.books, lib.reading_time)


@query("j8_random_note")
def j8(lib: DriverLibrary) -> DataFrame:
    return joins.random_note(lib.notes, lib.books, 5)


@query("j9_last_read", """WITH l AS (SELECT book_id, date FROM reading_time ORDER BY try_cast(date AS TIMESTAMP) DESC, id DESC LIMIT 1), n AS (SELECT id, title FROM books WHERE NOT is_deleted ORDER BY update_time DESC, id DESC LIMIT 1)
    SELECT coalesce(b.id, n.id) AS book_id, coalesce(b.title, n.title) AS title, l.date AS last_read FROM n LEFT JOIN l ON true LEFT JOIN books b ON b.id = l.book_id AND NOT b.is_deleted""")
def j9(lib: DriverLibrary) -> DataFrame:
    return joins.last_read_book(lib.reading_time, lib.books)


@query("j10_books_with_file", "SELECT id FROM books WHERE NOT is_deleted AND split_part(file_path, '/', 2) IN (SELECT name FROM files WHERE side = 'remote')")
def j10(lib: DriverLibrary) -> DataFrame:
    return joins.books_with_file(lib.books, lib.files, "remote").select("id")


@query("j11_group_names", "SELECT b.id, title, group_id, g.name AS group_name FROM books b LEFT JOIN lib_groups g ON g.id = b.group_id AND NOT g.is_deleted WHERE NOT b.is_deleted")
def j11(lib: DriverLibrary) -> DataFrame:
    return joins.group_names(lib.books, lib.groups)


def _toc(lib: DriverLibrary) -> DataFrame:
    return lib.raw("conversations").where("role = 'assistant'").selectExpr("conv_id AS doc_id", "turn AS section_idx", "concat('turn ', turn) AS label")


@query("j12_labelled_hits", """SELECT c.conv_id AS doc_id, c.turn AS section_idx, CASE WHEN count(*) > 0 THEN max_by('turn ' || t.turn, t.turn) END AS label
    FROM conversations c LEFT JOIN conversations t ON t.conv_id = c.conv_id AND t.turn <= c.turn AND t.role = 'assistant' WHERE c.role = 'user' GROUP BY c.conv_id, c.turn""")
def j12(lib: DriverLibrary) -> DataFrame:
    hits = lib.raw("conversations").where("role = 'user'").selectExpr("conv_id AS doc_id", "turn AS section_idx").distinct()
    return joins.labelled_hits(hits, _toc(lib).distinct())


# --- aggregations -----------------------------------------------------------


@query("a1_total_seconds", "SELECT coalesce(sum(reading_time), 0)::BIGINT AS total FROM reading_time")
def a1(lib: DriverLibrary) -> DataFrame:
    return aggregates.total(lib.reading_time)


@query("a2_books_read", "SELECT count(DISTINCT book_id) AS books FROM reading_time")
def a2(lib: DriverLibrary) -> DataFrame:
    return aggregates.books_read(lib.reading_time)


@query("a3_days_read", "SELECT count(DISTINCT day) AS days FROM reading_time")
def a3(lib: DriverLibrary) -> DataFrame:
    return aggregates.days_read(lib.reading_time)


@query("a4_all_notes", "SELECT count(*) AS n_notes FROM notes")
def a4(lib: DriverLibrary) -> DataFrame:
    return lib.notes.agg(F.count("*").alias("n_notes"))


@query("a5_notes_per_book", f"SELECT book_id, count(*) AS n_notes FROM notes WHERE type IN {NOTES} AND book_id <> 0 GROUP BY book_id")
def a5(lib: DriverLibrary) -> DataFrame:
    return aggregates.notes_per_book(lib.notes).orderBy(F.desc("n_notes"), "book_id")


@query("a6_note_totals", f"SELECT count(id) AS n_notes, count(DISTINCT book_id) AS n_books FROM notes WHERE type IN {NOTES}")
def a6(lib: DriverLibrary) -> DataFrame:
    return aggregates.note_totals(lib.notes)


def _series_sql(start: str, end: str) -> str:
    return f"""SELECT s.day, coalesce(sum(r.reading_time), 0)::BIGINT AS seconds FROM (SELECT CAST(unnest(generate_series(DATE '{start}', DATE '{end}', INTERVAL 1 DAY)) AS DATE) AS day) s
        LEFT JOIN reading_time r ON r.day = s.day GROUP BY s.day"""


@query("a7_week", _series_sql("2024-01-29", "2024-02-04"))
def a7(lib: DriverLibrary) -> DataFrame:
    return aggregates.series(lib.spark, lib.reading_time, "week", AS_OF)


@query("a8_month", _series_sql("2024-01-01", "2024-01-31"))
def a8(lib: DriverLibrary) -> DataFrame:
    return aggregates.series(lib.spark, lib.reading_time, "month", AS_OF)


@query("a9_year", """SELECT strftime(s.m, '%Y-%m') AS month, coalesce(sum(r.reading_time), 0)::BIGINT AS seconds FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-12-01', INTERVAL 1 MONTH)) AS DATE) AS m) s
    LEFT JOIN reading_time r ON date_trunc('month', r.day) = s.m GROUP BY s.m""")
def a9(lib: DriverLibrary) -> DataFrame:
    return aggregates.series(lib.spark, lib.reading_time, "year", AS_OF)


def _by_book_sql(where: str) -> str:
    return f"SELECT b.id AS book_id, title, author, sum(reading_time)::BIGINT AS seconds FROM reading_time r JOIN books b ON b.id = r.book_id AND NOT is_deleted WHERE {where} GROUP BY b.id, title, author"


def _by_book(mode: str, where: str) -> None:
    query(f"a10_by_book_{mode}", _by_book_sql(where))(lambda lib: aggregates.by_book(lib.reading_time, lib.books, mode, AS_OF))


_by_book("day", "r.day = DATE '2024-01-30'")
_by_book("week", "r.day BETWEEN DATE '2024-01-29' AND DATE '2024-02-04'")
_by_book("month", "r.day BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'")
_by_book("year", "r.day BETWEEN DATE '2024-01-01' AND DATE '2024-12-31'")
_by_book("all", "true")


@query("a11_week_books", "SELECT book_id, sum(reading_time)::BIGINT AS seconds FROM reading_time WHERE day >= DATE '2024-01-29' GROUP BY book_id")
def a11(lib: DriverLibrary) -> DataFrame:
    return aggregates.week_books(lib.reading_time, AS_OF)


@query("a12_of_book", "SELECT coalesce(sum(reading_time), 0)::BIGINT AS total FROM reading_time WHERE book_id = 3")
def a12(lib: DriverLibrary) -> DataFrame:
    return aggregates.of_book(lib.reading_time, 3)


@query("a13_all_days", "SELECT day, sum(reading_time)::BIGINT AS seconds FROM reading_time GROUP BY day")
def a13(lib: DriverLibrary) -> DataFrame:
    return aggregates.daily(lib.reading_time).orderBy("day")


@query("a14_daily_of_book", "SELECT day, sum(reading_time)::BIGINT AS seconds FROM reading_time WHERE book_id = 3 AND day >= DATE '2024-01-17' GROUP BY day")
def a14(lib: DriverLibrary) -> DataFrame:
    return aggregates.daily(lib.reading_time, 3, "2024-01-17")


@query("a15_daily_since", "SELECT day, sum(reading_time)::BIGINT AS seconds FROM reading_time WHERE day >= DATE '2024-01-20' GROUP BY day")
def a15(lib: DriverLibrary) -> DataFrame:
    return aggregates.daily(lib.reading_time, since="2024-01-20")


@query("a16_period_share", """SELECT period::BIGINT AS period, total::BIGINT AS total, round(period / total * 100, 1) AS percent, least(1.0::DOUBLE, greatest(0.0::DOUBLE, period / total)) AS bar
    FROM (SELECT sum(reading_time) FILTER (day BETWEEN DATE '2024-01-29' AND DATE '2024-02-04')::DOUBLE AS period, sum(reading_time)::DOUBLE AS total FROM reading_time)""")
def a16(lib: DriverLibrary) -> DataFrame:
    return aggregates.period_share(lib.reading_time, "week", AS_OF)


@query("a17_mean_completion", "SELECT round(avg(reading_percentage), 9) AS mean FROM (SELECT reading_percentage FROM books WHERE NOT is_deleted AND reading_percentage >= 0.6 AND reading_percentage < 0.93 ORDER BY reading_percentage DESC, id LIMIT 5)")
def a17(lib: DriverLibrary) -> DataFrame:
    return aggregates.mean_completion(lib.books).select(F.round("mean", 9).alias("mean"))


@query("a18_chart_bound", 'SELECT max(s)::BIGINT AS "max", max(s) * 1.2::DOUBLE AS bound FROM (SELECT sum(reading_time) AS s FROM reading_time GROUP BY day)')
def a18(lib: DriverLibrary) -> DataFrame:
    return aggregates.chart_bound(aggregates.daily(lib.reading_time))


@query("a19_fold", "SELECT sum(reading_time)::BIGINT AS total FROM reading_time")
def a19(lib: DriverLibrary) -> DataFrame:
    return aggregates.total(lib.reading_time)


@query("a20_group_ids", "SELECT DISTINCT group_id FROM books WHERE group_id IS NOT NULL AND group_id <> 0")
def a20(lib: DriverLibrary) -> DataFrame:
    return aggregates.group_ids(lib.books)


@query("a21_storage", """SELECT kind, bytes, CASE WHEN bytes <= 0 THEN '0 B' ELSE printf('%.2f', bytes / pow(1024.0, u)) || ' ' || list_extract(['B', 'KB', 'MB', 'GB', 'TB'], u + 1) END AS size
    FROM (SELECT kind, bytes, CAST(floor(log2(greatest(bytes, 1)) / 10) AS INT) AS u FROM (SELECT regexp_extract(file_path, '[^.]*$') AS kind, sum(id * id * 10)::BIGINT AS bytes FROM books GROUP BY 1))""")
def a21(lib: DriverLibrary) -> DataFrame:
    return aggregates.storage(lib.books.select(strings.extension("file_path").alias("kind"), (F.col("id") * F.col("id") * 10).alias("length")))


def _plan(lib: DriverLibrary) -> DataFrame:
    return lib.books.selectExpr("id AS book_id", "CASE WHEN id % 5 = 0 THEN 0 ELSE id % 11 END AS group_id")


_PLAN = "SELECT id AS book_id, CASE WHEN id % 5 = 0 THEN 0 ELSE id % 11 END AS group_id FROM books"


@query("a22_plan_statistics", f"""SELECT count(DISTINCT CASE WHEN p.group_id <> 0 THEN p.group_id END) AS groups, count(*) FILTER (p.group_id <> b.group_id) AS moved, count(*) FILTER (p.group_id = 0 AND b.group_id <> 0) AS ungrouped
    FROM ({_PLAN}) p JOIN books b ON b.id = p.book_id AND NOT is_deleted""")
def a22(lib: DriverLibrary) -> DataFrame:
    return aggregates.plan_statistics(_plan(lib), lib.books)


@query("a23_multimap", "SELECT book_id, string_agg(tag_id::VARCHAR, ',' ORDER BY tag_id) AS tags FROM book_tags GROUP BY book_id")
def a23(lib: DriverLibrary) -> DataFrame:
    return aggregates.multimap(lib.book_tags, "book_id", "tag_id").select("book_id", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("tags"))


@query("a24_shelf_folders", """SELECT CASE WHEN group_id = 0 THEN 'b' || id ELSE 'g' || group_id END AS folder, count(*) AS n_books, arg_max(id, (update_time, id)) AS first_book, max(update_time) AS latest FROM books WHERE NOT is_deleted GROUP BY 1""")
def a24(lib: DriverLibrary) -> DataFrame:
    return aggregates.shelf_folders(lib.books)


@query("a25_chapter_runs", """SELECT book_id, run, min(chapter) AS chapter, count(*) AS n_notes, min(id) AS first_id FROM (SELECT *, sum(new) OVER (PARTITION BY book_id ORDER BY id)::BIGINT AS run FROM
    (SELECT book_id, id, chapter, CASE WHEN lag(chapter) OVER (PARTITION BY book_id ORDER BY id) = chapter THEN 0 ELSE 1 END AS new FROM notes)) GROUP BY book_id, run""")
def a25(lib: DriverLibrary) -> DataFrame:
    return aggregates.chapter_runs(lib.notes)


@query("a26_base_levels", """SELECT doc_id, ord, base, least(6, greatest(1, base))::INT AS heading FROM (SELECT *, level - min(level) OVER (PARTITION BY doc_id) + 1 AS base FROM
    (SELECT conv_id AS doc_id, turn AS ord, (turn * 7 + conv_id) % 9 AS level FROM conversations))""")
def a26(lib: DriverLibrary) -> DataFrame:
    toc = lib.raw("conversations").selectExpr("conv_id AS doc_id", "turn AS ord", "(turn * 7 + conv_id) % 9 AS level")
    return aggregates.base_levels(toc).select("doc_id", "ord", "base", "heading")


# --- windows ----------------------------------------------------------------

_ISLANDS = "SELECT book_id, min(day) AS first, max(day) AS last, count(*) AS length FROM (SELECT book_id, day, day - CAST(row_number() OVER (PARTITION BY book_id ORDER BY day) AS INT) AS run FROM (SELECT DISTINCT book_id, day FROM reading_time)) GROUP BY book_id, run"
_STREAK = "coalesce(CASE WHEN date_diff('day', max(last), DATE '2024-01-30') <= 1 THEN arg_max(length, last) END, 0) AS current, coalesce(max(length), 0) AS longest, max(last) AS last_day"


@query("w1_islands", _ISLANDS)
def w1(lib: DriverLibrary) -> DataFrame:
    return windows.islands(lib.reading_time, "book_id")


@query("w2_w3_streak", f"SELECT {_STREAK} FROM ({_ISLANDS.replace('book_id, ', '').replace('PARTITION BY book_id ', '')})")
def w2(lib: DriverLibrary) -> DataFrame:
    return windows.streak(lib.reading_time, AS_OF)


@query("w2_w3_streak_by_book", f"SELECT book_id, {_STREAK} FROM ({_ISLANDS}) GROUP BY book_id")
def w3(lib: DriverLibrary) -> DataFrame:
    return windows.streak(lib.reading_time, AS_OF, "book_id")


def _running(days: int, start: str) -> None:
    sql = f"SELECT day, seconds, sum(seconds) OVER (ORDER BY day)::BIGINT AS running FROM ({_series_sql(start, AS_OF)})"
    query(f"w4_running_{days}", sql)(lambda lib: windows.running_total(lib.spark, lib.reading_time, days, AS_OF))


_running(7, "2024-01-24")
_running(30, "2024-01-01")


def _sections(lib: DriverLibrary) -> DataFrame:
    return lib.raw("conversations").selectExpr("conv_id AS doc_id", "turn AS section_idx", "CAST(length(text) AS BIGINT) AS size", "(conv_id + turn) % 7 <> 0 AS linear").dropDuplicates(["doc_id", "section_idx"])


_SECTIONS = "SELECT conv_id AS doc_id, turn AS section_idx, length(text) AS size, (conv_id + turn) % 7 <> 0 AS linear FROM conversations"
_FRACTIONS = f"""SELECT doc_id, section_idx, counted, upto / nullif(total, 0) AS "end", (upto - counted) / nullif(total, 0) AS start, total FROM (SELECT *, sum(counted) OVER (PARTITION BY doc_id ORDER BY section_idx) AS upto, sum(counted) OVER (PARTITION BY doc_id) AS total
    FROM (SELECT *, CASE WHEN linear AND size > 0 THEN size ELSE 0 END AS counted FROM ({_SECTIONS})))"""


@query("w5_carried_labels", """SELECT doc_id, section_idx, label FROM (SELECT c.conv_id AS doc_id, c.turn AS section_idx, last_value(CASE WHEN role = 'assistant' THEN 'turn ' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS label FROM conversations c)""")
def w5(lib: DriverLibrary) -> DataFrame:
    return windows.carried_labels(_sections(lib).select("doc_id", "section_idx"), _toc(lib))


@query("w6_fractions", f'SELECT doc_id, section_idx, round(start, 9) AS start, round("end", 9) AS "end" FROM ({_FRACTIONS})')
def w6(lib: DriverLibrary) -> DataFrame:
    return windows.fractions(_sections(lib)).select("doc_id", "section_idx", F.round("start", 9).alias("start"), F.round("end", 9).alias("end"))


@query("w7_progress", f'SELECT doc_id, section_idx, round(start + 0.5 * ("end" - start), 6) AS fraction, CAST(ceil(total / 1500.0) AS BIGINT) AS locations FROM ({_FRACTIONS})')
def w7(lib: DriverLibrary) -> DataFrame:
    return windows.progress(windows.fractions(_sections(lib)).withColumn("within", F.lit(0.5))).select("doc_id", "section_idx", F.round("fraction", 6).alias("fraction"), "locations")


@query("w8_section_at", f'SELECT doc_id, max(section_idx) AS section_idx FROM ({_FRACTIONS}) WHERE counted > 0 AND start <= 0.37 + 1e-12 GROUP BY doc_id')
def w8(lib: DriverLibrary) -> DataFrame:
    return windows.section_at(windows.fractions(_sections(lib)), 0.37).select("doc_id", "section_idx")


@query("w10_book_series", f"""SELECT day, seconds, day = DATE '2024-01-17' OR extract(day FROM day) = 1 OR date_diff('day', DATE '2024-01-17', day) % 5 = 0 AS labelled FROM
    ({_series_sql('2024-01-17', AS_OF).replace('LEFT JOIN reading_time r ON', 'LEFT JOIN reading_time r ON r.book_id = 3 AND')})""")
def w10(lib: DriverLibrary) -> DataFrame:
    return windows.book_series(lib.spark, lib.reading_time, 3, 14, AS_OF)


@query("w11_rate_window", """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS in_minute FROM events""")
def w11(lib: DriverLibrary) -> DataFrame:
    return windows.requests_in_minute(lib.raw("events").selectExpr("event_id", "user_id AS service", "ts"), 5).select("event_id", "in_minute")


# --- sorts ------------------------------------------------------------------


@query("t1_shelf", "SELECT row_number() OVER (ORDER BY lower(title) DESC, id) - 1 AS place, id, title FROM books WHERE NOT is_deleted")
def t1(lib: DriverLibrary) -> DataFrame:
    return sorts.placed(sorts.shelf(lib.books, "title", ascending=False).select("id", "title"))


@query("t2_tags", "SELECT row_number() OVER (ORDER BY lower(name), id) - 1 AS place, id, name FROM tags")
def t2(lib: DriverLibrary) -> DataFrame:
    return sorts.placed(sorts.tags(lib.tags).select("id", "name"))


@query("t3_notes_by_time", "SELECT row_number() OVER (ORDER BY coalesce(create_time, TIMESTAMP '1970-01-01 00:00:00'), id) - 1 AS place, id, create_time FROM notes")
def t3(lib: DriverLibrary) -> DataFrame:
    return sorts.placed(sorts.notes_by_time(lib.notes).select("id", "create_time"))


@query("t5_top_completion", "SELECT id, reading_percentage FROM books WHERE NOT is_deleted AND reading_percentage >= 0.6 AND reading_percentage < 0.93 ORDER BY reading_percentage DESC, id LIMIT 5")
def t5(lib: DriverLibrary) -> DataFrame:
    return sorts.top_completion(lib.books).select("id", "reading_percentage")


@query("t6_top_book", f"{_by_book_sql('true')} ORDER BY seconds DESC, book_id LIMIT 1")
def t6(lib: DriverLibrary) -> DataFrame:
    return aggregates.by_book(lib.reading_time, lib.books).limit(1)


@query("t7_latest_reading", "SELECT id, book_id, date FROM reading_time ORDER BY try_cast(date AS TIMESTAMP) DESC, id DESC LIMIT 1")
def t7(lib: DriverLibrary) -> DataFrame:
    return sorts.latest_reading(lib.reading_time).select("id", "book_id", "date")


@query("t8_by_recency", "SELECT row_number() OVER (ORDER BY try_cast(date AS TIMESTAMP) DESC NULLS LAST, id DESC) - 1 AS place, id, date FROM reading_time WHERE book_id = 3")
def t8(lib: DriverLibrary) -> DataFrame:
    return sorts.placed(sorts.by_recency(lib.reading_time, 3).select("id", "date"))


@query("t9_random_note")
def t9(lib: DriverLibrary) -> DataFrame:
    return sorts.random_note(lib.notes, 3).select("id", "type")


@query("t10_clamps", "SELECT * FROM (VALUES ('bookshelf', 50), ('notes', 10), ('history', 20), ('results', 5), ('snippets', 3)) AS t(kind, most)")
def t10(lib: DriverLibrary) -> DataFrame:
    return lib.spark.createDataFrame([(k, sorts.clamp(k, None)) for k in ("bookshelf", "notes", "history", "results", "snippets")], "kind string, most int")


@query("t11_evicted", "SELECT id FROM history ORDER BY updated_at DESC, id DESC OFFSET 60")
def t11(lib: DriverLibrary) -> DataFrame:
    return sorts.evicted(lib.history.select("id", "updated_at"), "updated_at", 60).select("id")


@query("t12_retention", "SELECT id, updated_at FROM history ORDER BY updated_at DESC, id DESC LIMIT 3")
def t12(lib: DriverLibrary) -> DataFrame:
    return sorts.newest(lib.history.select("id", "updated_at"), "updated_at", 3)


@query("t13_bookmarks", "SELECT row_number() OVER (ORDER BY CAST(color AS DOUBLE), id) - 1 AS place, id, CAST(color AS DOUBLE) AS percentage FROM notes WHERE type = 'bookmark'")
def t13(lib: DriverLibrary) -> DataFrame:
    from quire import schema

    return sorts.placed(sorts.bookmarks(schema.bookmarks_of_notes(lib.notes)).select("id", "percentage"))


@query("t14_by_size", "SELECT row_number() OVER (ORDER BY (id * 7919) % 10007 DESC, file_path) - 1 AS place, file_path AS path, (id * 7919) % 10007 AS length FROM books")
def t14(lib: DriverLibrary) -> DataFrame:
    return sorts.placed(sorts.by_size(lib.books.selectExpr("file_path AS path", "(id * 7919) % 10007 AS length")))


@query("t15_on_top", "SELECT id, group_id AS folder, CAST(row_number() OVER (PARTITION BY group_id ORDER BY id <> 24, id) AS INT) AS rank FROM books WHERE group_id <> 0")
def t15(lib: DriverLibrary) -> DataFrame:
    return sorts.on_top(lib.books.where("group_id <> 0").selectExpr("id", "group_id AS folder", "CAST(id AS INT) AS rank"), 24)


# --- sets -------------------------------------------------------------------

_STATUS = """SELECT split_part(b.file_path, '/', 2) AS name, CASE WHEN l.name IS NOT NULL AND r.name IS NOT NULL THEN 'both' WHEN l.name IS NOT NULL THEN 'localOnly' WHEN r.name IS NOT NULL THEN 'remoteOnly' ELSE 'nonExistent' END AS status
    FROM books b LEFT JOIN files l ON l.side = 'local' AND l.name = split_part(b.file_path, '/', 2) LEFT JOIN files r ON r.side = 'remote' AND r.name = split_part(b.file_path, '/', 2) WHERE NOT b.is_deleted"""


@query("s1_sync_status", _STATUS)
def s1(lib: DriverLibrary) -> DataFrame:
    return sets.sync_status(lib.books, lib.files)


@query("s2_sync_plan", """SELECT * FROM (SELECT name, CASE WHEN known AND l AND NOT r THEN 'upload' WHEN NOT known AND l AND r THEN 'deleteBoth' WHEN NOT known AND r THEN 'deleteRemote' WHEN NOT known AND l THEN 'deleteLocal' END AS action FROM
    (SELECT name, bool_or(side = 'local') AS l, bool_or(side = 'remote') AS r, bool_or(side = 'book') AS known FROM (SELECT * FROM files UNION ALL SELECT split_part(file_path, '/', 2), 'book' FROM books WHERE NOT is_deleted) GROUP BY name)) WHERE action IS NOT NULL""")
def s2(lib: DriverLibrary) -> DataFrame:
    return sets.sync_plan(lib.books, lib.files)


@query("s3_tag_changes", """SELECT b.id AS book_id, CASE WHEN max(coalesce(l.tag_id, 0) = 2) THEN '' ELSE 'toxic' END AS to_add, CASE WHEN max(coalesce(l.tag_id, 0) = 1) THEN 'quality' ELSE '' END AS to_remove
    FROM books b LEFT JOIN book_tags l ON l.book_id = b.id GROUP BY b.id""")
def s3(lib: DriverLibrary) -> DataFrame:
    have = joins.tag_names(lib.books, lib.book_tags, lib.tags)
    want = lib.books.select(F.col("id").alias("book_id"), F.array(F.lit("TOXIC")).alias("tags"))
    return sets.tag_changes(have, want).select("book_id", F.array_join("to_add", ",").alias("to_add"), F.array_join("to_remove", ",").alias("to_remove"))


@query("s4_unique", "SELECT id, (id % 3)::VARCHAR || ',' || ((id + 1) % 3)::VARCHAR AS kept FROM books")
def s4(lib: DriverLibrary) -> DataFrame:
    return lib.books.select("id", F.array_join(sets.unique(F.transform(F.array(F.col("id") % 3, (F.col("id") + 1) % 3, F.col("id") % 3), lambda v: v.cast("string"))), ",").alias("kept"))


@query("s5_repeated_targets", "SELECT book_id, count(*) AS n FROM (SELECT id % 400 AS book_id FROM books) GROUP BY 1 HAVING count(*) > 1")
def s5(lib: DriverLibrary) -> DataFrame:
    return sets.repeated_targets(lib.books.selectExpr("id % 400 AS book_id"))


@query("s6_sync_direction", """SELECT id, CASE WHEN rv > 7 THEN 'abort' WHEN remote IS NULL THEN 'upload' WHEN abs(l - remote) < 5 THEN 'none' WHEN asked = 'both' AND (u IS NULL OR abs(u - remote) > 5) THEN 'ask' ELSE asked END AS direction
    FROM (SELECT id, 6 + id % 3 AS rv, id % 20 AS l, CASE WHEN id % 6 > 0 THEN id % 17 END AS remote, CASE WHEN id % 4 > 0 THEN id % 11 END AS u, CASE WHEN id % 2 = 0 THEN 'both' ELSE 'download' END AS asked FROM books)""")
def s6(lib: DriverLibrary) -> DataFrame:
    at = lambda e: f"timestamp_seconds({e})"
    states = lib.books.selectExpr(
        "id", "7 AS local_version", "6 + id % 3 AS remote_version", f"{at('id % 20')} AS local_mtime", f"CASE WHEN id % 6 > 0 THEN {at('id % 17')} END AS remote_mtime", f"CASE WHEN id % 4 > 0 THEN {at('id % 11')} END AS last_upload",
        "CASE WHEN id % 2 = 0 THEN 'both' ELSE 'download' END AS asked",
    )
    return sets.sync_direction(states).select("id", "direction")


# --- changes ----------------------------------------------------------------


@query("u1_merged_reading", "SELECT book_id, day, sum(reading_time)::BIGINT AS reading_time FROM (SELECT book_id, day, reading_time FROM reading_time UNION ALL SELECT book_id, DATE '2024-01-30', 60 FROM reading_time) GROUP BY book_id, day")
def u1(lib: DriverLibrary) -> DataFrame:
    return changes.merged_reading(lib.reading_time, lib.reading_time.selectExpr("book_id", "'2024-01-30T10:00:00' AS date", "60L AS reading_time"))


@query("u2_captured", "SELECT user_id AS book_id, strftime(ts, '%Y-%m-%d') AS date, event_id % 12 AS reading_time FROM events WHERE event_id % 3 = 0 OR (event_id % 12 > 5 AND event_id % 3 = 1)")
def u2(lib: DriverLibrary) -> DataFrame:
    sessions = lib.raw("events").selectExpr("user_id AS book_id", "ts AS started", "ts + make_dt_interval(0, 0, 0, CAST(event_id % 12 AS INT)) AS ended", "element_at(array('dispose', 'paused', 'inactive'), CAST(event_id % 3 AS INT) + 1) AS reason")
    return changes.captured(sessions)


@query("u3_saved_notes", f"""SELECT id, book_id, cfi, type FROM (SELECT *, row_number() OVER (PARTITION BY book_id, cfi ORDER BY update_time DESC, id DESC) AS n FROM notes WHERE type IN {NOTES}) WHERE n = 1
    UNION ALL SELECT id, book_id, cfi, type FROM notes WHERE type NOT IN {NOTES}""")
def u3(lib: DriverLibrary) -> DataFrame:
    return changes.saved_notes(lib.notes.where("type = 'highlight'"), lib.notes.where("type <> 'highlight'")).select("id", "book_id", "cfi", "type")


@query("u4_new_bookmarks", "SELECT id, book_id, cfi FROM notes b WHERE type = 'bookmark' AND NOT EXISTS (SELECT 1 FROM notes n WHERE n.cfi = b.cfi AND n.book_id = b.book_id AND n.type <> 'bookmark')")
def u4(lib: DriverLibrary) -> DataFrame:
    return changes.new_bookmarks(lib.notes.where("type <> 'bookmark'"), lib.notes.where("type = 'bookmark'").select("id", "book_id", "cfi")).select("id", "book_id", "cfi")


@query("u5_saved_books", "SELECT id, CASE WHEN is_deleted THEN 'new' ELSE title END AS title, CASE WHEN is_deleted THEN TIMESTAMP '2024-01-30' ELSE update_time END AS update_time FROM books")
def u5(lib: DriverLibrary) -> DataFrame:
    return changes.saved_books(lib.books, lib.books.where("is_deleted").withColumn("title", F.lit("new")), AS_OF).select("id", "title", "update_time")


@query("u6_imported", """SELECT b.id, coalesce(b.title, f.title) AS title, f.file_path, coalesce(b.rating, 0.0) AS rating, false AS is_deleted, 0::BIGINT AS group_id FROM
    (SELECT md5(p_name) AS file_md5, min('in/' || p_partkey || '.epub') AS file_path, 'imported' AS title FROM part GROUP BY 1) f
    LEFT JOIN (SELECT file_md5, max_by(id, id) AS id, max_by(title, id) AS title, max_by(rating, id) AS rating FROM books WHERE file_md5 <> '' GROUP BY 1) b ON b.file_md5 = f.file_md5""")
def u6(lib: DriverLibrary) -> DataFrame:
    files = lib.raw("part").selectExpr("md5(p_name) AS file_md5", "'imported' AS title", "'x' AS author", "concat('in/', p_partkey, '.epub') AS file_path")
    return changes.imported(lib.books, files, AS_OF).select("id", "title", "file_path", "rating", "is_deleted", "group_id")


@query("u7_soft_deleted", "SELECT id, is_deleted OR group_id = 1 AS is_deleted FROM books")
def u7(lib: DriverLibrary) -> DataFrame:
    return changes.soft_deleted(lib.books, lib.books.where("group_id = 1")).select("id", "is_deleted")


@query("u8_added_groups", "SELECT id, name, parent_id FROM lib_groups UNION ALL SELECT 900 + n_nationkey, '...', 0 FROM nation")
def u8(lib: DriverLibrary) -> DataFrame:
    new = lib.raw("nation").selectExpr("CAST(900 + n_nationkey AS BIGINT) AS id", "CAST(NULL AS STRING) AS name", "CAST(NULL AS BIGINT) AS parent_id").unionByName(lib.groups.select("id", "name", "parent_id"))
    return changes.added_groups(lib.groups, new).select("id", "name", "parent_id")


@query("u9_merged_tags", "SELECT book_id, 1::BIGINT AS tag_id FROM book_tags WHERE tag_id IN (1, 2) GROUP BY book_id")
def u9(lib: DriverLibrary) -> DataFrame:
    return changes.merged_tags(lib.book_tags, 2, 1).select("book_id", "tag_id")


@query("u9_added_tags", "SELECT name FROM tags UNION ALL SELECT 'Fresh'")
def u9b(lib: DriverLibrary) -> DataFrame:
    names = lib.spark.createDataFrame([("QUALITY",), ("Fresh",), ("fresh",)], "name string")
    return changes.added_tags(lib.tags, names).select("name")


@query("u11_without_readings", "SELECT id FROM reading_time WHERE book_id NOT IN (SELECT id FROM books WHERE is_deleted)")
def u11(lib: DriverLibrary) -> DataFrame:
    return changes.without_readings(lib.reading_time, lib.books.where("is_deleted")).select("id")


@query("u12_organised", f"SELECT b.id, coalesce(p.group_id, b.group_id) AS group_id, CASE WHEN p.group_id <> b.group_id THEN TIMESTAMP '2024-01-30' ELSE b.update_time END AS update_time FROM books b LEFT JOIN ({_PLAN}) p ON p.book_id = b.id")
def u12(lib: DriverLibrary) -> DataFrame:
    return changes.organised(lib.books, _plan(lib), AS_OF).select("id", "group_id", "update_time")


@query("u12_empty_groups", "SELECT id, name FROM lib_groups WHERE id <> 0 AND NOT is_deleted AND id NOT IN (SELECT group_id FROM books WHERE NOT is_deleted) AND id NOT IN (SELECT parent_id FROM lib_groups WHERE NOT is_deleted AND parent_id IS NOT NULL)")
def u12b(lib: DriverLibrary) -> DataFrame:
    return changes.empty_groups(lib.groups, lib.books).select("id", "name")


@query("u10_themes_kept", "SELECT r_regionkey::BIGINT AS id FROM region WHERE r_regionkey NOT IN (0, 1)")
def u10(lib: DriverLibrary) -> DataFrame:
    themes = lib.raw("region").selectExpr("CAST(r_regionkey AS BIGINT) AS id")
    return changes.deletable_themes(changes.deletable_themes(themes, [0, 1]), [2, 3])


@query("u13_migrated_groups", "SELECT 0::BIGINT AS id, 'Root' AS name UNION ALL SELECT DISTINCT group_id, '...' FROM books WHERE group_id <> 0")
def u13(lib: DriverLibrary) -> DataFrame:
    return changes.migrated({"books": lib.books.drop("rating", "file_md5"), "notes": lib.notes.drop("reader_note")}, 4)["groups"].select("id", "name")


# --- scalar functions -------------------------------------------------------


@query("d1_d3_days", "SELECT id, substring(date, 1, 10) AS key, day, strftime(day, '%Y-%m') AS month FROM reading_time")
def d1(lib: DriverLibrary) -> DataFrame:
    return lib.reading_time.select("id", dates.day_key("date").alias("key"), dates.day("date").alias("day"), F.date_format(dates.day("date"), "yyyy-MM").alias("month"))


@query("d2_resolved_day", "SELECT id, CASE id % 4 WHEN 0 THEN DATE '2024-02-02' WHEN 1 THEN DATE '2024-03-03' WHEN 2 THEN day ELSE DATE '2024-01-30' END AS day FROM reading_time")
def d2(lib: DriverLibrary) -> DataFrame:
    rows = lib.reading_time.selectExpr("id", "CASE WHEN id % 4 = 0 THEN '2024-02-02T01:02:03' END AS stored", "CASE WHEN id % 4 = 1 THEN '2024-03-03' END AS started", "CASE WHEN id % 4 = 2 THEN concat(substring(date, 1, 10), ' junk') ELSE 'garbage' END AS raw")
    return rows.select("id", dates.resolved_day("stored", "started", "raw", AS_OF).alias("day"))


@query("d4_d5_bounds", "SELECT DISTINCT day, CAST(date_trunc('week', day) AS DATE) AS week, last_day(day) AS month_end FROM reading_time")
def d4(lib: DriverLibrary) -> DataFrame:
    return lib.reading_time.select(dates.day("date").alias("day")).distinct().select("day", dates.week_start("day").alias("week"), dates.month_end("day").alias("month_end"))


@query("d6_plain_week", "SELECT DISTINCT day, year(day) || '-' || CAST(floor((dayofyear(day) - 1 - isodow(day) + 10) / 7) AS INT) AS week FROM reading_time")
def d6(lib: DriverLibrary) -> DataFrame:
    return lib.reading_time.select(dates.day("date").alias("day")).distinct().select("day", dates.plain_week("day").alias("week"))


@query("d7_duration", """SELECT id, CASE WHEN s >= 3600 THEN (s // 3600) || ' h ' || (s % 3600 // 60) || ' min' WHEN s >= 60 THEN (s // 60) || ' min' ELSE s || ' s' END AS text FROM (SELECT id, reading_time * (id % 40) AS s FROM reading_time)""")
def d7(lib: DriverLibrary) -> DataFrame:
    return lib.reading_time.select("id", dates.duration(F.col("reading_time") * (F.col("id") % 40)).alias("text"))


_AGO = """CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' minutes ago' WHEN s < 86400 THEN (s // 3600) || ' hours ago' WHEN s // 86400 = 1 THEN 'yesterday' WHEN s < 2592000 THEN (s // 86400) || ' days ago'
    WHEN s < 31536000 AND s // 86400 // 30 <= 1 THEN 'last month' WHEN s < 31536000 THEN (s // 86400 // 30) || ' months ago' WHEN s // 86400 // 365 <= 1 THEN 'last year' ELSE (s // 86400 // 365) || ' years ago' END"""


@query("d8_relative", f"SELECT id, {_AGO} AS ago FROM (SELECT id, date_diff('second', update_time, TIMESTAMP '2024-12-30 00:00:00') AS s FROM books)")
def d8(lib: DriverLibrary) -> DataFrame:
    return lib.books.select("id", dates.relative("update_time", "2024-12-30").alias("ago"))


@query("d9_tolerant", "SELECT id, try_cast(replace(date, 'T', ' ') AS TIMESTAMP) AS at FROM reading_time")
def d9(lib: DriverLibrary) -> DataFrame:
    return lib.reading_time.select("id", dates.tolerant_stamp(F.replace("date", F.lit("T"), F.lit(" "))).alias("at"))


@query("d10_clock", "SELECT id, ((id % 3) * 3600 + (id % 60) * 60 + id % 50)::DOUBLE AS seconds FROM books")
def d10(lib: DriverLibrary) -> DataFrame:
    return lib.books.select("id", dates.clock_seconds(F.format_string("%d:%02d:%02d", F.col("id") % 3, F.col("id") % 60, F.col("id") % 50)).alias("seconds"))


@query("d11_current_time")
def d11(lib: DriverLibrary) -> DataFrame:
    return lib.spark.range(1).select(*(c.alias(n) for n, c in dates.current_time().items()))


@query("x1_substr", "SELECT id, replace(file_path, 'file/', '') || substring(title, 1, 24) AS moved FROM books")
def x1(lib: DriverLibrary) -> DataFrame:
    return lib.books.select("id", F.concat(F.replace("file_path", F.lit("file/"), F.lit("")), F.substring("title", 1, 24)).alias("moved"))


@query("x2_tag_by_name", "SELECT id, name FROM tags WHERE lower(name) = lower('TOXIC')")
def x2(lib: DriverLibrary) -> DataFrame:
    return lib.tags.where(F.lower("name") == F.lower(F.lit("TOXIC"))).select("id", "name")


@query("x3_snippet", f"SELECT id, {_SNIP} AS snippet FROM notes")
def x3(lib: DriverLibrary) -> DataFrame:
    return lib.notes.select("id", strings.snippet("content", "reader_note").alias("snippet"))


@query("x4_newlines", "SELECT id, md5(replace(content, chr(10), '|')) AS hash FROM notes")
def x4(lib: DriverLibrary) -> DataFrame:
    return lib.notes.select("id", F.md5(F.replace(strings.newlines(F.replace("content", F.lit("\n"), F.lit("\r\n"))), F.lit("\n"), F.lit("|"))).alias("hash"))


@query("x5_file_parts", "SELECT id, title AS book, author AS writer FROM books")
def x5(lib: DriverLibrary) -> DataFrame:
    name = F.concat(F.lit("《"), "title", F.lit("》作者："), "author")
    return lib.books.select("id", strings.title_of_file(name).alias("book"), strings.author_of_file(name).alias("writer"))


@query("x6_xml_escaped", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS text FROM pages")
def x6(lib: DriverLibrary) -> DataFrame:
    return lib.raw("pages").select("page_id", strings.xml_escaped("html").alias("text"))


@query("x7_collapsed", r"SELECT id, md5(regexp_replace(content, '\s+', ' ', 'g')) AS hash FROM notes")
def x7(lib: DriverLibrary) -> DataFrame:
    return lib.notes.select("id", F.md5(strings.collapsed("content")).alias("hash"))


@query("x8_context", r"SELECT id, substring(trim(regexp_replace(substring(content, greatest(id % 90 - 120, 0) + 1, least(id % 90 + 130, length(content)) - greatest(id % 90 - 120, 0)), '\s+', ' ', 'g')), 1, 600) AS context FROM notes")
def x8(lib: DriverLibrary) -> DataFrame:
    return lib.notes.select("id", strings.context("content", F.col("id") % 90, F.col("id") % 90 + 10).alias("context"))


@query("x9_safe_name", r"""SELECT id, trim(regexp_replace(substring(title || '?*a', 1, 20), '[<>:"/\\|?*]', '_', 'g')) AS name FROM books""")
def x9(lib: DriverLibrary) -> DataFrame:
    return lib.books.select("id", strings.safe_name(F.concat("title", F.lit("?*a"))).alias("name"))


@query("x10_title_or_file", "SELECT id, CASE WHEN id % 3 = 0 THEN split_part(file_path, '/', 2) ELSE title END AS title FROM books")
def x10(lib: DriverLibrary) -> DataFrame:
    given = F.when(F.col("id") % 6 == 0, "Unknown").when(F.col("id") % 3 == 0, " 　").otherwise(F.col("title"))
    return lib.books.select("id", strings.title_or_file(given, "file_path").alias("title"))


@query("x11_authors", "SELECT id, CASE WHEN id % 2 = 0 THEN author || ', ' || title ELSE 'Unknown' END AS authors FROM books")
def x11(lib: DriverLibrary) -> DataFrame:
    return lib.books.select("id", strings.authors(F.when(F.col("id") % 2 == 0, F.array("author", "title")).otherwise(F.array().cast("array<string>"))).alias("authors"))


@query("x12_mapped", "SELECT id, translate(title, 'abc', 'xyz') AS title FROM books")
def x12(lib: DriverLibrary) -> DataFrame:
    return lib.books.select("id", strings.mapped("title", "abca", "xyzq").alias("title"))


@query("x13_quotes", "SELECT id, '『' || title || '』「' || author || '」' AS line FROM books")
def x13(lib: DriverLibrary) -> DataFrame:
    return lib.books.select("id", strings.vertical_quotes(F.concat(F.lit("“"), "title", F.lit("”‘"), "author", F.lit("’"))).alias("line"))


@query("x14_reasoning", "SELECT id, chapter AS thought, 'answer ' || id AS answer FROM notes")
def x14(lib: DriverLibrary) -> DataFrame:
    reply = F.concat(F.lit("<think>"), "chapter", F.lit("</think>\n answer "), "id")
    return lib.notes.select("id", F.array_join(strings.reasoning(reply), "|").alias("thought"), strings.answer(reply).alias("answer"))


@query("x15_filled", "SELECT id, 'Sum up ' || title || ' by ' || author AS prompt FROM books")
def x15(lib: DriverLibrary) -> DataFrame:
    return lib.books.select("id", strings.filled(F.lit("Sum up {{title}} by {author}"), {"title": F.col("title"), "author": F.col("author")}).alias("prompt"))


@query("x16_rgb", "SELECT id, (id * 7919) % 16777216 AS rgb, '0x' || lpad(lower(to_hex((id * 7919) % 16777216)), 6, '0') AS text FROM books")
def x16(lib: DriverLibrary) -> DataFrame:
    given = F.concat(F.lit("#"), F.hex((F.col("id") * 7919) % 16777216))
    return lib.books.select("id", strings.rgb(given).alias("rgb"), strings.rgb_text(strings.rgb(given)).alias("text"))


@query("x17_hash_rgb", """SELECT id, (list_reduce(list_prepend(0::BIGINT, list_transform(string_split(title, ''), lambda c: unicode(c)::BIGINT)), lambda h, u: (h * 31 + u) & 4294967295) & 16777215) AS rgb FROM books""")
def x17(lib: DriverLibrary) -> DataFrame:
    return lib.books.select("id", strings.hash_rgb("title").alias("rgb"))


@query("x18_uri", "SELECT id, 'http://h/' || id || '?q=' || replace(url_encode(author), '+', '%20') AS uri FROM books")
def x18(lib: DriverLibrary) -> DataFrame:
    return lib.books.select("id", strings.uri_expanded("http://h{/id}{?q,none}", {"id": F.col("id").cast("string"), "q": F.col("author")}).alias("uri"))


@query("x19_paths", "SELECT id, 'OPS/img/' || id || '.png' AS resolved, '../img/' || id || '.png' AS relative FROM books")
def x19(lib: DriverLibrary) -> DataFrame:
    target = F.concat(F.lit("./../img/"), "id", F.lit(".png"))
    found = strings.resolved_path(target, F.lit("OPS/text/ch1.xhtml"))
    return lib.books.select("id", found.alias("resolved"), strings.relative_path(found, F.lit("OPS/text")).alias("relative"))


@query("m1_truncated", "SELECT id, CAST(trunc(id / 7.0) AS BIGINT) AS whole, abs(50 - id) AS distance FROM books")
def m1(lib: DriverLibrary) -> DataFrame:
    return lib.books.select("id", numbers.truncated(F.col("id") / 7).alias("whole"), F.abs(50 - F.col("id")).alias("distance"))


@query("m2_calculator", "SELECT * FROM (VALUES ('1+2*3', '7'), ('(1+2)*3', '9'), ('2^3^2', '512'), ('-4/8', '-0.5')) AS t(expression, result)")
def m2(lib: DriverLibrary) -> DataFrame:
    return lib.spark.createDataFrame([(e, numbers.calculate(e)) for e in ("1+2*3", "(1+2)*3", "2^3^2", "-4/8")], "expression string, result string")


@query("m3_tap_zone", "SELECT id, (CASE WHEN y < 0.33 THEN 0 WHEN y < 0.66 THEN 1 ELSE 2 END * 3 + CASE WHEN x < 0.33 THEN 0 WHEN x < 0.66 THEN 1 ELSE 2 END) AS zone FROM (SELECT id, (id % 100) / 100.0::DOUBLE AS x, (id % 71) / 71.0::DOUBLE AS y FROM books)")
def m3(lib: DriverLibrary) -> DataFrame:
    return lib.books.select("id", ((F.col("id") % 100) / 100).alias("x"), ((F.col("id") % 71) / 71).alias("y")).select("id", numbers.tap_zone("x", "y").alias("zone"))


@query("m4_round_robin", "SELECT id, list_extract(['a', 'b', 'c'], CAST(id % 3 AS INT) + 1) AS key FROM books")
def m4(lib: DriverLibrary) -> DataFrame:
    return lib.books.select("id", numbers.round_robin(F.array(F.lit("a"), F.lit("b"), F.lit("c")), "id").alias("key"))


@query("m5_m8_sizes", """SELECT id, printf('%.2f%%', reading_percentage * 100) AS percent, greatest(0.2::DOUBLE, least(0.8::DOUBLE, reading_percentage)) AS clamped FROM books""")
def m5(lib: DriverLibrary) -> DataFrame:
    return lib.books.select("id", numbers.percent_text("reading_percentage").alias("percent"), numbers.clamped("reading_percentage", 0.2, 0.8).alias("clamped"))


@query("m6_json", "SELECT id, coalesce(title, '') AS name, id % 2 = 0 AS multi_line FROM books")
def m6(lib: DriverLibrary) -> DataFrame:
    text = F.to_json(F.struct(F.col("title").alias("name"), F.when(F.col("id") % 2 == 0, True).alias("multiLine")))
    rule = F.from_json(text, "name string, multiLine boolean, samples array<string>")
    return lib.books.select("id", rule.alias("r")).select("id", F.coalesce("r.name", F.lit("")).alias("name"), F.coalesce("r.multiLine", F.lit(False)).alias("multi_line"))


@query("m7_string_keys", """SELECT p_partkey AS id, '{"' || p_partkey || '":{"' || p_size || '":"' || p_name || '"}}' AS json FROM part""")
def m7(lib: DriverLibrary) -> DataFrame:
    return lib.raw("part").select(F.col("p_partkey").alias("id"), F.to_json(strings.string_keys(F.create_map("p_partkey", F.create_map("p_size", "p_name")))).alias("json"))


@query("m9_pages", "SELECT id, CAST(ceil(reading_percentage * 40) AS BIGINT) AS page FROM books")
def m9(lib: DriverLibrary) -> DataFrame:
    return lib.books.select("id", numbers.page_of("reading_percentage", F.lit(0.25), F.lit(0.5), F.lit(10)).alias("page"))
