"""Hand-made edge rows for the operators."""

import datetime as dt
import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from quire import schema
from quire.operators import access, aggregates, changes, documents, filters, joins, search, sets, sorts, windows
from quire.plans import tools
from quire.sources import books as book_files, files, remote, sinks
from quire.sources.library import DriverLibrary, Library
from quire.streaming import reading


def readings(spark, rows):
    return spark.createDataFrame([(i, b, d, s) for i, (b, d, s) in enumerate(rows)], schema.SCHEMAS["reading_time"])


def library(spark, books, **more):
    rows = [{"id": i, "title": f"t{i}", "author": "a", "is_deleted": False, "group_id": 0, "reading_percentage": 0.5, "update_time": dt.datetime(2024, 1, 1, i % 24)} | b for i, b in books.items()]
    fields = {f.name: f for f in spark.createDataFrame([], schema.SCHEMAS["books"]).schema}
    return spark.createDataFrame([tuple(r.get(n) for n in fields) for r in rows], schema.SCHEMAS["books"])


@pytest.mark.parametrize(
    ("days", "as_of", "want"),
    [([], "2024-01-10", (0, 0, None)), (["2024-01-10"], "2024-01-10", (1, 1, "2024-01-10")), (["2024-01-08", "2024-01-09"], "2024-01-10", (2, 2, "2024-01-09")), (["2024-01-07", "2024-01-08"], "2024-01-10", (0, 2, "2024-01-08")),
     (["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-09", "2024-01-11"], "2024-01-10", (1, 3, "2024-01-11")), (["bad", None], "2024-01-10", (0, 0, None))],
)
def test_streaks(spark, days, as_of, want):
    r = windows.streak(readings(spark, [(1, d, 5) for d in days]), as_of).first()
    assert (r["current"], r["longest"], r["last_day"] and r["last_day"].isoformat()) == want


def test_status_and_completion(spark):
    b = library(spark, {i: {"reading_percentage": p} for i, p in enumerate((0.02, 0.0200001, 0.6, 0.93, 0.98))})
    assert [r[0] for r in b.orderBy("id").select(filters.status()).collect()] == ["notStarted", "reading", "reading", "reading", "finished"]
    assert [r["id"] for r in filters.nearly_done(b).collect()] == [2]


def test_tag_division(spark):
    b = library(spark, {1: {}, 2: {}, 3: {}, 4: {"is_deleted": True}})
    links = spark.createDataFrame([(1, 1, 10), (2, 1, 11), (3, 2, 10), (4, 4, 10), (5, 1, 10)], schema.SCHEMAS["book_tags"])
    ids = lambda tags: sorted(r["id"] for r in filters.with_all_tags(b, links, tags).collect())
    assert ids([10, 11]) == [1] and ids([10]) == [1, 2] and ids([]) == [1, 2, 3] and ids([-1, 10]) == [3] and ids([99]) == []


def test_limit_comes_before_the_join(spark):
    b = library(spark, {1: {}, 2: {"is_deleted": True}})
    notes = spark.createDataFrame([(i, 1 + i % 2, "c", "", "", "highlight", "", None, None, dt.datetime(2024, 1, 1, i)) for i in range(6)], schema.SCHEMAS["notes"])
    assert joins.first_notes(notes, b, 3).count() == 1


def test_empty_period_and_share(spark):
    r = aggregates.period_share(readings(spark, []), "week", "2024-01-10").first()
    assert (r["period"], r["total"], r["percent"], r["bar"]) == (0, 0, None, 0.0)
    assert aggregates.series(spark, readings(spark, []), "month", "2024-02-10").agg(F.sum("seconds"), F.count("*")).first()[:] == (0, 29)
    assert windows.book_series(spark, readings(spark, [(2, "2024-01-09", 5)]), 1, 7, "2024-01-10").count() == 0


def test_runs_of_chapters(spark):
    notes = spark.createDataFrame([(i, 1, "c", "", ch, "highlight", "", None, None, None) for i, ch in enumerate("aabba")], schema.SCHEMAS["notes"])
    assert [(r["chapter"], r["n_notes"]) for r in aggregates.chapter_runs(notes).orderBy("run").collect()] == [("a", 2), ("b", 2), ("a", 1)]


def test_import_merge(spark):
    b = library(spark, {1: {"file_md5": "x", "is_deleted": True, "group_id": 4, "description": "d", "rating": 3.0}})
    new = spark.createDataFrame([("x", "new", "who", "p1"), ("x", "again", "who", "p2"), ("y", "other", "who", "p3")], "file_md5 string, title string, author string, file_path string")
    got = {r["file_md5"]: r for r in changes.imported(b, new, "2024-02-01").collect()}
    assert len(got) == 2 and (got["x"]["id"], got["x"]["title"], got["x"]["rating"], got["x"]["group_id"], got["x"]["is_deleted"], got["x"]["description"]) == (1, "t1", 3.0, 0, False, None)
    assert got["y"]["id"] is None and got["y"]["title"] == "other"


def test_duplicate_of_a_deleted_book(spark):
    b = library(spark, {1: {"file_md5": "x", "is_deleted": True}, 2: {"file_md5": "y"}})
    f = spark.createDataFrame([("f1", "x"), ("f2", "y"), ("f3", "y"), ("f4", "z")], "name string, file_md5 string")
    got = {r["name"]: (r["copy"], r["duplicate_book"], r["is_duplicate"]) for r in changes.duplicates(b, f).collect()}
    assert got == {"f1": (1, 1, False), "f2": (1, 2, True), "f3": (2, 2, True), "f4": (1, None, False)}


def test_styles_hold_tags(spark):
    styles = spark.createDataFrame([(1, 1.00001, "fun", 255.0, 0.0), (2, 2.0, None, 7.0, 1.0), (3, 18.0, "Serif", 1.2, 0.0)], "id long, font_size double, font_family string, line_height double, letter_spacing double")
    assert [tuple(r) for r in schema.tags_of_styles(styles).collect()] == [(1, "fun", 255)]
    assert [tuple(r) for r in schema.book_tags_of_styles(styles).collect()] == [(2, 7, 1)]


def test_sync_of_an_empty_library(spark):
    f = spark.createDataFrame([("a", "local")], "name string, side string")
    assert sets.sync_plan(library(spark, {1: {"is_deleted": True}}), f).count() == 0


def test_clamps():
    assert [sorts.clamp("bookshelf", x) for x in (None, 0, 500)] == [50, 1, 50] and sorts.clamp("characters", None) is None and sorts.clamp("characters", 5) == 100


def test_chapters_and_chunks():
    rule = documents.Rule.built_in().compiled()
    for heading in ("第一章 ", "第二章  ", "第三章　"):
        assert rule.search(heading)
    assert documents.chapters("前言\r\n第一章 起\r\n甲\r第二章　\n乙", rule, "f") == [(0, "", "前言"), (1, "第一章 起", "甲"), (2, "第二章", "乙")]
    assert documents.chapters("x" * 20_000, rule, "f") == [(0, "f", "x" * 20_000)]
    long = "x" * 20_001
    assert [t for _, t, _ in documents.chunks(long, "f")] == ["No.1"]
    assert [len(b) for *_, b in documents.chunks(long + "\n" + long, "f")] == [20_001, 20_001]
    assert documents.Rule("(").compiled().pattern == documents.RULES[documents.DEFAULT_RULE] and documents.Rule("(", samples=("a",)).evaluated()[0] == [("a", False)]


def test_search_modes():
    assert list(search.ranges("aaaa", "aa", True, True)) == [(0, 2), (1, 3), (2, 4)]
    assert list(search.ranges("CAFÉ cafe", "cafe")) == [(0, 4), (5, 9)] and list(search.ranges("CAFÉ cafe", "cafe", match_diacritics=True)) == [(5, 9)] and list(search.ranges("CAFÉ cafe", "cafe", match_case=True)) == [(5, 9)]
    assert list(search.ranges("them the  the", "the the", whole_words=True)) == [(5, 13)] and list(search.ranges("ca­fe", "cafe")) == [(0, 5)] and list(search.ranges("x", "")) == []


@pytest.mark.parametrize("n", [49, 50, 51])
def test_excerpt_context(n):
    pre, match, post = search.excerpt("a" * n + "MID" + "b" * n, n, n + 3)
    assert match == "MID" and (pre, post) == ((("…" if n >= 50 else "") + "a" * min(n, 50)), ("b" * min(n, 50) + ("…" if n >= 50 else "")))


def test_sentences_and_nodes():
    page = "<body><p>One. Two 3.5 \"Hi!\" ok</p><p>End<a href='#n'>1</a>。x <a href='http://x'>y</a></p><script>no()</script></body>"
    assert [t for t, *_ in documents.text_nodes(page)] == ["One. Two 3.5 \"Hi!\" ok", "End", "1", "。x ", "y"]
    nodes = [(t, b, a) for t, b, a, _ in documents.text_nodes(page)]
    assert [s for _, s in documents.sentences(nodes)] == ["One.", ' Two 3.5 "Hi!"', " ok", "End。", "x y"]
    assert documents.translatable("<div><p>a <span>b</span></p><pre>c</pre><div><em>d</em></div></div>") == [(0, "p", "a b"), (1, "em", "d")]


def test_outlines():
    assert documents.outline("", "- a\n\t- b\n- c") == [(0, None, -1, "Mindmap"), (1, 0, 0, "a"), (2, 1, 1, "b"), (3, 0, 0, "c")]
    for bad in ("", "a", "-  "):
        with pytest.raises(ValueError):
            documents.outline("t", bad)


def test_decoding(spark):
    raw = ["plain text".encode(), "中文测试文本".encode("gbk"), "中文".encode() + b"\r\nb\rc", "hello".encode("utf-16")]
    got = {r["path"]: (r["encoding"], r["text"]) for r in files.texts(spark.createDataFrame([(str(i), bytearray(x)) for i, x in enumerate(raw)], "path string, content binary")).collect()}
    assert got["0"] == ("utf-8", "plain text") and got["1"] == ("gbk", "中文测试文本") and got["2"] == ("utf-8", "中文\nb\nc") and "hello" in got["3"][1].replace("\0", "")


def test_epub_round_trip():
    raw = book_files.packed_epub("T & T", "A", [("One", "first <line>\nsecond", 1), ("", "untitled", 2), ("Two", "x", 1)])
    e = book_files.Epub(raw)
    assert [x[4] for x in e.spine()] == ["Onefirst <line>second", "untitled", "Twox"]
    assert [(o, p, lv, label) for o, p, lv, label, _ in documents.flattened(e.toc())] == [(0, None, 0, "One"), (1, 0, 1, "untitled"), (2, None, 0, "Two")]
    assert ("title", "T & T", None, None) in e.metadata()
    with pytest.raises(ValueError):
        book_files.Epub(b"no zip")


def test_palmdoc_and_comics():
    assert book_files.palmdoc(b"abc\x80\x1b" + bytes([0xC0 | 0x21]) + b"\x02\x80\x81")[:3] == b"abc"
    assert book_files.palmdoc(b"\x02\xff\xfe") == b"\xff\xfe" and book_files.palmdoc(bytes([0xE1])) == b" a"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in ("b.JPG", "a.png", "readme.txt"):
            z.writestr(n, "x")
    assert [(k, n) for k, n, _ in book_files.comic_pages(out.getvalue())] == [(0, "a.png"), (1, "b.JPG")] and list(book_files.comic_pages(b"")) == []


def mobi(kind, records, extra_records=(), exth=b""):
    """A book's database: header record, text records, others."""
    text = b"".join(records)
    head = struct.pack(">HHIHHHH", kind, 0, 30, len(records), 4096, 0, 0) + b"MOBI" + struct.pack(">III", 232, 2, 65001) + bytes(52) + struct.pack(">II", 16 + 232 + len(exth), 5)
    head += bytes(112 - len(head)) + struct.pack(">II", 1 + len(records), len(extra_records)) + bytes(8) + struct.pack(">I", 0x40 if exth else 0)
    head += bytes(16 + 232 - len(head)) + exth + "Tïtl".encode()
    whole = [head, *records, *extra_records]
    at, table = 78 + 8 * len(whole), b""
    for r in whole:
        table += struct.pack(">II", at, 0)
        at += len(r)
    assert len(text) >= 0
    return bytes(60) + b"BOOKMOBI" + bytes(8) + struct.pack(">H", len(whole)) + table + b"".join(whole)


def test_mobi_kinds():
    exth = b"EXTH" + struct.pack(">III", 0, 2, 100) + struct.pack(">I", 10) + b"Me" + struct.pack(">II", 524, 10) + b"en"
    book = book_files.Mobi(mobi(1, [b"plain text"], exth=exth))
    assert (book.title, book.text(), list(book.metadata())) == ("Tïtl", "plain text", [("title", "Tïtl"), ("creator", "Me"), ("language", "en")])
    # codes of eight bits: byte b stands for phrase 255 - b; phrase 0 is two codes itself
    huff = b"HUFF" + struct.pack(">III", 24, 24, 24 + 1024) + bytes(8) + struct.pack(">256I", *[255 << 8 | 0x80 | 8] * 256) + struct.pack(">64I", *[0] * 64)
    phrases = [b"\xfe\xfd", b"ab", b"c"] + [b"?"] * 253
    offsets, body = [], b""
    for k, ph in enumerate(phrases):
        offsets.append(512 + len(body))
        body += struct.pack(">H", len(ph) | (0x8000 if k else 0)) + ph
    cdic = b"CDIC" + struct.pack(">III", 16, 256, 8) + struct.pack(">256H", *offsets) + body
    assert book_files.Mobi(mobi(17480, [b"\xff\xfd\xfe"], [huff, cdic])).text() == "abccab"
    assert list(book_files.mobi_text(b"junk")) == [] == list(book_files.mobi_text(mobi(99, [b"x"])))


def test_stores(spark, tmp_path):
    (tmp_path / "h.json").write_text('[{"id": "1", "updatedAt": 5}, {"id": "2", "updatedAt": 7}]')
    (tmp_path / "bad.json").write_text("{broken")
    (tmp_path / "c.json").write_text('{"k1": {"data": "x", "timestamp": 3}, "k2": {"data": "y"}}')
    assert files.json_store(spark, str(tmp_path / "h.json"), "id: string, updatedAt: bigint").count() == 2 and files.json_store(spark, str(tmp_path / "bad.json"), "id: string, updatedAt: bigint").count() == 0
    assert sorted((r["key"], r["value"]["data"]) for r in files.keyed_store(spark, str(tmp_path / "c.json"), "struct<data: string, timestamp: bigint>").collect()) == [("k1", "x"), ("k2", "y")]
    assert sorted(r["name"] for r in files.listing(spark, str(tmp_path)).collect()) == ["bad.json", "c.json", "h.json"]


def test_snapshot_and_restore(spark, sf, tmp_path):
    lib = DriverLibrary(spark, sf)
    path = sinks.snapshot(lib, str(tmp_path / "snap"))
    assert sinks.checks(spark, path).where("NOT ok").count() == 0
    sinks.restored(spark, path, str(tmp_path / "live"))
    assert Library(spark, str(tmp_path / "live")).books.count() == lib.books.count()
    assert sinks.checks(spark, str(tmp_path / "none")).where("NOT ok").count() >= 1
    with pytest.raises(ValueError):
        sinks.restored(spark, str(tmp_path / "none"), str(tmp_path / "live"))


def test_remote_folder(spark, tmp_path):
    r = remote.Remote(spark, f"file://{tmp_path}/remote")
    (tmp_path / "local").mkdir()
    (tmp_path / "local" / "a.epub").write_text("a")
    assert not r.ping() and r.listed("books", create=True).count() == 0 and r.ping()
    plan = spark.createDataFrame([("a.epub", "upload")], "name string, action string")
    assert remote.apply(r, plan, str(tmp_path / "local"), "books") == {"upload": 1}
    assert [(x["name"], x["size"], x["is_dir"]) for x in r.listed("books").collect()] == [("a.epub", 1, False)] and r.properties("books/none") is None
    r.download("books/a.epub", str(tmp_path / "back"))
    assert (tmp_path / "back").read_text() == "a" and r.remove("books/a.epub") and r.listed("books").count() == 0
    for name in ("../a", "/etc/x", "", "..", "a/b"):
        with pytest.raises(ValueError):
            remote.apply(r, spark.createDataFrame([(name, "deleteLocal")], "name string, action string"), str(tmp_path / "local"), "books")
    many = spark.createDataFrame([(f"{k}.txt", "upload") for k in range(60)], "name string, action string")
    for k in range(60):
        (tmp_path / "local" / f"{k}.txt").write_text(str(k))
    assert remote.apply(r, many, str(tmp_path / "local"), "books") == {"upload": 60} and r.listed("books").count() == 60
    for bad in (lambda: r.listed("../x"), lambda: r.listed("nowhere")):
        with pytest.raises((ValueError, FileNotFoundError)):
            bad()


def test_migration(spark, sf):
    lib = DriverLibrary(spark, sf)
    old = {"books": lib.books.drop("rating", "file_md5").withColumn("file_path", F.concat(F.lit("/base/"), "file_path")), "notes": lib.notes.drop("reader_note")}
    new = changes.migrated(old, 3, "/base/")
    assert {"rating", "file_md5"} <= set(new["books"].columns) and new["books"].where("file_path LIKE '/base%'").count() == 0 and "reader_note" in new["notes"].columns
    with pytest.raises(ValueError):
        changes.migrated(old, 8)


def test_period_filter_reaches_the_files(spark, sf, tmp_path):
    sinks.snapshot(DriverLibrary(spark, sf), str(tmp_path / "snap"))
    lib = Library(spark, str(tmp_path / "snap"))
    totals = aggregates.by_book(lib.reading_time, lib.books, "week", "2024-01-30")
    plan = totals._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(day,2024-01-29)" in plan and "ReadSchema: struct<book_id:bigint,reading_time:bigint,day:date>" in plan
    assert sorted(map(tuple, totals.collect())) == sorted(map(tuple, aggregates.by_book(DriverLibrary(spark, sf).reading_time, lib.books, "week", "2024-01-30").collect()))


def test_csv(spark, sf, tmp_path):
    lib = DriverLibrary(spark, sf)
    sinks.write_csv(sinks.notes_table(lib.notes, lib.books).orderBy("Update Time").limit(20), str(tmp_path / "csv"))
    back = spark.read.option("header", "true").option("multiLine", "true").option("quote", '"').option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.count() == 20 and back.columns[4] == "Reader Note"


def test_titles_by_sound(spark):
    titles = ["上海", "Zed", "北京", "abc", "阿", "中国", "第一", "Éa"]
    got = [r["title"] for r in sorts.shelf(spark.createDataFrame([(i, t, False) for i, t in enumerate(titles)], "id long, title string, is_deleted boolean"), key=sorts.pinyin).collect()]
    assert got == ["阿", "北京", "第一", "上海", "中国", "abc", "Éa", "Zed"]


def test_places_over_partitions(spark):
    rows = spark.range(0, 5000, 1, 7).selectExpr("id", "(id * 7919) % 1009 AS v")
    got = sorts.placed(rows.orderBy("v", "id")).collect()
    assert [(r["v"], r["id"]) for r in sorted(got, key=lambda r: r["place"])] == sorted((r["v"], r["id"]) for r in got) and sorted(r["place"] for r in got) == list(range(5000))


def plain_excerpt(text, start, end):
    """From the whole text, as the rule says it."""
    before = " ".join(text[:start].split()) + (" " if start and text[start - 1].isspace() and text[:start].strip() else "")
    after = (" " if end < len(text) and text[end].isspace() else "") + " ".join(text[end:].split())
    after = after if after.strip() else ""
    return ("…" if len(before) >= search.CONTEXT else "") + before[-search.CONTEXT :], text[start:end], after[: search.CONTEXT] + ("…" if len(after) >= search.CONTEXT else "")


def test_excerpts_look_no_farther_than_needed():
    import random
    import time

    r = random.Random(2)
    for _ in range(3000):
        text = "".join(r.choice(["a", "bc", " ", "\n", "   ", " " * 300, "word"]) for _ in range(r.randrange(0, 200)))
        start = r.randrange(0, len(text) + 1)
        end = r.randrange(start, len(text) + 1)
        assert search.excerpt(text, start, end) == plain_excerpt(text, start, end)

    def took(n):
        text = "a hit " * n
        began = time.process_time()
        for i in range(n):
            search.excerpt(text, 6 * i + 2, 6 * i + 5)
        return time.process_time() - began

    took(1000)
    assert took(40_000) < 3 * min(took(20_000) for _ in range(2)) + 0.3


def test_entry_without_the_subpackage(monkeypatch):
    """Where a library that only the training-data operators need is missing, the other queries are there."""
    import sys

    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m.startswith("quire.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tiktoken", None)
    assert not [n for n in entry.queries() if n.startswith("op") or n == "pipeline"] and len(entry.queries()) > 150 and set(entry.oracle_sql()) <= set(entry.queries())


def test_replace_is_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 5):
        access.replace_atomically(spark, spark.range(n), path)
        assert spark.read.parquet(path).count() == n


def test_tools(spark, sf):
    import json

    lib = DriverLibrary(spark, sf)
    call = lambda name, **a: json.loads(tools.TOOLS[name].call(lib, json.dumps(a)))
    assert call("calculator", expression="6*7")["data"] == [{"expression": "6*7", "result": "42"}]
    assert call("calculator")["status"] == "error" and tools.TOOLS["tags_list"].call(lib, "[]").startswith('{"status": "error"')
    assert len(call("bookshelf_lookup", limit=3)["data"]) == 3 and call("bookshelf_organize", plan=[{"bookId": 1, "groupId": 2}, {"bookId": 1}])["message"].startswith("a book is named")
    assert call("books_tags_list")["data"] == [] and len(call("tags_list")["data"]) == 3
    assert call("apply_book_tags", books=[{"bookId": 1, "tags": ["x"]}])["data"][0]["to_add"] == ["x"]
    for name, args in {"current_time": {}, "mindmap_draw": {"outline": "- a"}, "notes_search": {"from": "2024-01-01"}, "reading_history": {}, "current_reading_metadata": {"bookId": 1}, "current_book_toc": {"bookId": 1},
                       "current_chapter_content": {"bookId": 1}, "chapter_content_by_href": {"bookId": 1, "href": "s0.xhtml#x"}, "book_content_search": {"bookId": 1, "keyword": "the"}}.items():
        assert call(name, **args)["status"] == "ok", name
    assert [t.name for t in tools.enabled([" tags_list", "nope", "tags_list"])] == ["tags_list"]


def test_streams(spark, sf, tmp_path):
    events = DriverLibrary(spark, sf).raw("events").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "user_id AS book_id", "CAST(floor(value) AS BIGINT) AS seconds", "event_id AS id", "event_type AS place", "value AS progress")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = reading.daily_seconds(stream, "40 days").writeStream.outputMode("complete").format("memory").queryName("daily").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, reading.daily_seconds(events).collect()))
    q = reading.keep_last_places(stream, str(tmp_path / "last"), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    last = {r["book_id"]: r["ts"] for r in reading.last_places(events).collect()}
    assert {r["book_id"]: r["ts"] for r in spark.read.parquet(str(tmp_path / "last")).collect()} == last
