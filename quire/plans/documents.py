"""Named queries over documents, files, exports, tools and streams' batch forms, each with its SQL where there is one."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F

from quire.functions import positions, strings
from quire.operators import access, documents, search, windows
from quire.plans import tools
from quire.plans.catalog import NOTES, query
from quire.sources import books, files, remote, sinks
from quire.sources.library import DriverLibrary, Library
from quire.streaming import reading


def _values(lib: DriverLibrary, rows: list[tuple], schema: str) -> DataFrame:
    return lib.spark.createDataFrame(rows, schema)


def _texts(lib: DriverLibrary) -> DataFrame:
    return files.dealt(lib.raw("documents"))


# --- chapters ---------------------------------------------------------------


@query("p1_chapters", r"""SELECT doc_id, CAST(i - 1 AS INT) AS section_idx, 'Chapter ' || i AS title, md5(trim(line)) AS hash FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)""")
def p1(lib: DriverLibrary) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("Chapter "), (i + 1).cast("string"), F.lit("\r\n"), x))
    docs = _texts(lib).select("doc_id", F.array_join(lines, "\n").alias("text"))
    return documents.split_chapters(docs, rule=documents.Rule.built_in("en_chapter_number")).select("doc_id", "section_idx", "title", F.md5("content").alias("hash"))


@query("p2_p3_rules", """SELECT * FROM (VALUES ('default_chapter_rule', 7, 5), ('cn_only_numeric', 4, 3), ('en_chapter_number', 4, 3), ('en_volume_number', 4, 3)) AS t(rule, samples, matches)""")
def p3(lib: DriverLibrary) -> DataFrame:
    rows = [(n, len(documents.SAMPLES[n]), sum(m for _, m in documents.Rule.built_in(n).evaluated()[0])) for n in documents.RULES]
    return _values(lib, rows, "rule string, samples int, matches int")


_NEXT = "start + 20000 + CASE WHEN strpos(substring(text, start + 20001), chr(10)) > 0 THEN strpos(substring(text, start + 20001), chr(10)) ELSE length(text) END"


@query("p1_p4_default_rule_and_chunks", f"""WITH RECURSIVE c AS (SELECT doc_id, text, 0 AS section_idx, 0::BIGINT AS start FROM documents WHERE length(text) > 20000 UNION ALL
    SELECT doc_id, text, section_idx + 1, {_NEXT} FROM c WHERE {_NEXT} < length(text))
    SELECT doc_id, section_idx, 'No.' || (section_idx + 1) AS title FROM c UNION ALL SELECT doc_id, 0, doc_id::VARCHAR FROM documents WHERE length(text) <= 20000""")
def p4(lib: DriverLibrary) -> DataFrame:
    return documents.split_chapters(_texts(lib)).select("doc_id", "section_idx", "title")


@query("p5_titles", r"SELECT doc_id, trim(regexp_extract(text, '[^\n]*\S[^\n]*')) AS title FROM documents")
def p5(lib: DriverLibrary) -> DataFrame:
    sections = _texts(lib).select("doc_id", F.lit(0).alias("section_idx"), F.lit(" ").alias("title"), F.col("text").alias("content"))
    return documents.titled(sections).select("doc_id", "title")


_LEVELS = "SELECT conv_id AS doc_id, CAST(turn AS INT) AS ord, CAST((turn * 7 + conv_id) % 4 AS INT) AS level FROM conversations"


@query("p6_nested_toc", f"""SELECT a.doc_id, a.ord, (SELECT max(b.ord) FROM ({_LEVELS}) b WHERE b.doc_id = a.doc_id AND b.ord < a.ord AND b.level < a.level) AS parent_ord FROM ({_LEVELS}) a""")
def p6(lib: DriverLibrary) -> DataFrame:
    toc = lib.raw("conversations").selectExpr("conv_id AS doc_id", "turn AS ord", "(turn * 7 + conv_id) % 4 AS level")
    return documents.nested_toc(toc).select("doc_id", "ord", "parent_ord")


def _book_parts(lib: DriverLibrary) -> DataFrame:
    return lib.raw("conversations").selectExpr("conv_id AS doc_id", "concat('Talk ', conv_id) AS book_title", "role AS author", "CAST(turn AS INT) AS section_idx", "concat('Part ', turn, ' <&>') AS title", "text AS content", "CAST(1 + turn % 2 AS INT) AS level")


@query("c3_k3_epub_sections", """SELECT conv_id::VARCHAR AS path, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS section_idx, md5('Part ' || turn || ' <&>' || regexp_replace(text, '\\s*\\n\\s*', '', 'g')) AS hash FROM conversations""")
def c3(lib: DriverLibrary) -> DataFrame:
    made = books.epubs(_book_parts(lib)).select(F.col("doc_id").cast("string").alias("path"), "content")
    return books.epub_sections(made).select("path", "section_idx", F.md5("text").alias("hash"))


@query("p7_p8_epub_toc", """SELECT conv_id::VARCHAR AS path, CAST(row_number() OVER w - 1 AS INT) AS ord, 'Part ' || turn || ' <&>' AS label, 'OEBPS/s' || (row_number() OVER w - 1) || '.xhtml' AS href FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def p7(lib: DriverLibrary) -> DataFrame:
    made = books.epubs(_book_parts(lib)).select(F.col("doc_id").cast("string").alias("path"), "content")
    return books.epub_toc(made).select("path", "ord", "label", "href")


@query("p24_epub_metadata", """SELECT conv_id::VARCHAR AS path, n AS name, CASE n WHEN 'creator' THEN (SELECT arg_min(role, turn) FROM conversations d WHERE d.conv_id = c.conv_id) ELSE 'Talk ' || conv_id END AS value
    FROM (SELECT DISTINCT conv_id FROM conversations) c, (VALUES ('identifier'), ('title'), ('creator')) AS t(n)""")
def p24(lib: DriverLibrary) -> DataFrame:
    parts = _book_parts(lib)
    first = parts.groupBy("doc_id").agg(F.min_by("author", "section_idx").alias("author"))
    made = books.epubs(parts.drop("author").join(first, "doc_id")).select(F.col("doc_id").cast("string").alias("path"), "content")
    return books.epub_metadata(made).where("refinement IS NULL").select("path", "name", "value")


# --- text of pages ----------------------------------------------------------


def _marked(lib: DriverLibrary, *columns: str) -> DataFrame:
    """Pages made of the documents: each line of a text is a paragraph, between a style, a link and a script."""
    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: F.length(x) > 0), lambda x: F.concat(F.lit("<p>"), strings.xml_escaped(x), F.lit("</p>")))
    page = F.concat(F.lit("<html><head><style>p{}</style></head><body>"), F.array_join(lines, ""), F.lit("<p><a href='n.xhtml'>1</a></p><script>x()</script></body></html>"))
    return _texts(lib).select(F.col("doc_id").alias("page_id"), *columns, page.alias("html"))


_LINES = "SELECT doc_id, x, i FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, [y FOR y IN string_split(text, chr(10)) IF length(y) > 0] || ['1'] AS l FROM documents))"


@query("p9_text_nodes", f"SELECT doc_id AS page_id, CAST(i - 1 AS INT) AS node_idx, md5(x) AS hash FROM ({_LINES})")
def p9(lib: DriverLibrary) -> DataFrame:
    return documents.extract_nodes(_marked(lib)).select("page_id", "node_idx", F.md5("text").alias("hash"))


@query("p10_plain_text", f"SELECT doc_id AS page_id, md5(regexp_replace(string_agg(x, '' ORDER BY i) || 'x()', '^\\s+', '')) AS hash FROM ({_LINES}) GROUP BY doc_id")
def p10(lib: DriverLibrary) -> DataFrame:
    return documents.plain_text(_marked(lib)).select("page_id", F.md5("text").alias("hash"))


@query("p11_preceding", """SELECT doc_id, CAST(node_idx AS INT) AS node_idx, md5(coalesce(before, '')) AS hash FROM (SELECT conv_id AS doc_id, turn AS node_idx, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)""")
def p11(lib: DriverLibrary) -> DataFrame:
    nodes = lib.raw("conversations").selectExpr("conv_id AS doc_id", "CAST(turn AS INT) AS node_idx", "text").where("length(text) > 0")
    return documents.preceding(nodes, 1).select("doc_id", "node_idx", F.md5("before").alias("hash"))


_SENTENCES = """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS idx, CASE WHEN i < n THEN x || '.' ELSE x END AS sentence FROM (
    SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i, len(l) AS n FROM (SELECT doc_id, string_split(regexp_replace(text, '[^A-Za-z ]+', '. ', 'g'), '.') AS l FROM documents)) WHERE i < n OR trim(x) <> ''"""


def _plain_sentences(lib: DriverLibrary) -> DataFrame:
    """Sentences of pages in which all that isn't a Latin letter or a space is a full stop."""
    page = F.concat(F.lit("<body><p>"), F.regexp_replace("text", "[^A-Za-z ]+", ". "), F.lit("</p><p><a href='n.xhtml'>No. 1</a></p></body>"))
    return documents.split_sentences(_texts(lib).select(F.col("doc_id").alias("page_id"), page.alias("html")))


@query("p18_sentences", f"SELECT doc_id AS page_id, idx AS sentence_idx, md5(sentence) AS hash FROM ({_SENTENCES})")
def p18(lib: DriverLibrary) -> DataFrame:
    return _plain_sentences(lib).select("page_id", "sentence_idx", F.md5("sentence").alias("hash"))


@query("p19_peeked", f"""SELECT doc_id AS page_id, idx AS sentence_idx, len(a)::INT AS n, md5(array_to_string(a, '|')) AS hash FROM (
    SELECT doc_id, idx, coalesce(list(sentence) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), []) AS a FROM ({_SENTENCES}))""")
def p19(lib: DriverLibrary) -> DataFrame:
    return documents.peeked(_plain_sentences(lib), 10).select("page_id", "sentence_idx", F.size("ahead").alias("n"), F.md5(F.array_join("ahead", "|")).alias("hash"))


@query("p20_translatable", f"SELECT doc_id AS page_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS element_idx, CASE WHEN i = max(i) OVER (PARTITION BY doc_id) THEN 'a' ELSE 'p' END AS tag, md5(trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS hash FROM ({_LINES}) WHERE trim(x) <> ''")
def p20(lib: DriverLibrary) -> DataFrame:
    return documents.translatable_elements(_marked(lib)).select("page_id", "element_idx", "tag", F.md5("text").alias("hash"))


@query("r4_user_rule", r"""SELECT doc_id, CAST(i - 1 AS INT) AS section_idx, 'Part ' || i AS title, md5(trim(line)) AS hash FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)""")
def r4(lib: DriverLibrary) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("Part "), (i + 1).cast("string"), F.lit("\n"), x))
    rule = documents.Rule.from_json('{"pattern": "^part \\\\d+$", "caseSensitive": false}')
    docs = _texts(lib).select("doc_id", F.array_join(lines, "\n").alias("text"))
    return documents.split_chapters(docs, rule=rule).select("doc_id", "section_idx", "title", F.md5("content").alias("hash"))


_SIGNS = "".join(sorted(documents._GARBLED))


@query("p21_garbled", f"SELECT doc_id, (length(h) - length(translate(h, '{_SIGNS}', ''))) * 500 > 20 * length(h) AS garbled FROM (SELECT doc_id, substring(text, 1, 500) AS h FROM documents)")
def p21(lib: DriverLibrary) -> DataFrame:
    return documents.garbled(_texts(lib)).select("doc_id", "garbled")


@query("p22_a27_outline", "SELECT * FROM (VALUES (1, 4::BIGINT, 1), (3, 1::BIGINT, 0)) AS t(id, nodes, depth)")
def p22(lib: DriverLibrary) -> DataFrame:
    outlines = _values(lib, [(1, "Plan", "- a\n  - b\n\t* c\n+ d"), (2, "", "no bullet"), (3, "One", "• x")], "id int, title string, outline string")
    return documents.outline_statistics(documents.outline_nodes(outlines))


# --- search -----------------------------------------------------------------

_PLACES = "SELECT doc_id, text, i FROM (SELECT doc_id, text, {f} AS low, unnest(generate_series(1, greatest(length(text) - 3, 1))) AS i FROM documents) WHERE substring(low, i, 4) = '{q}'"


@query("p12_simple_search", f"SELECT doc_id, CAST(i - 1 AS INT) AS start FROM ({_PLACES.format(f='lower(text)', q='erer')})")
def p12(lib: DriverLibrary) -> DataFrame:
    return search.hits(_texts(lib), "ERER", match_diacritics=True).select("doc_id", "start")


@query("p13_p14_collated_search", f"SELECT doc_id, CAST(i - 1 AS INT) AS start FROM ({_PLACES.format(f='strip_accents(lower(text))', q='eaua')})")
def p13(lib: DriverLibrary) -> DataFrame:
    return search.hits(_texts(lib), "éaUA").select("doc_id", "start")


@query("p15_excerpts", rf"""SELECT doc_id, CAST(i - 1 AS INT) AS start, CASE WHEN length(b) >= 50 THEN '…' ELSE '' END || right(b, 50) AS pre, substring(text, i, 4) AS "match", left(a, 50) || CASE WHEN length(a) >= 50 THEN '…' ELSE '' END AS post
    FROM (SELECT *, ltrim(regexp_replace(substring(text, 1, i - 1), '\s+', ' ', 'g')) AS b, rtrim(regexp_replace(substring(text, i + 4), '\s+', ' ', 'g')) AS a FROM ({_PLACES.format(f='lower(text)', q='tion')}))""")
def p15(lib: DriverLibrary) -> DataFrame:
    return search.hits(_texts(lib), "tion", match_diacritics=True).select("doc_id", "start", "pre", "match", "post")


def _talk_hits(lib: DriverLibrary) -> DataFrame:
    talks = lib.raw("conversations").select(F.struct(F.col("conv_id").alias("doc_id"), F.col("turn").alias("section_idx")).alias("key"), "text")
    return search.hits(talks, "the", "key", "text", match_diacritics=True).select("key.doc_id", "key.section_idx", "hit_idx", "pre", "match", "post")


_TALK = "SELECT conv_id AS doc_id, turn AS section_idx, unnest(generate_series(0, (length(text) - length(replace(lower(text), 'the', ''))) // 3 - 1)) AS hit_idx FROM conversations WHERE contains(lower(text), 'the')"


@query("p16_by_section", f"""SELECT h.doc_id, h.section_idx, count(*) AS n, round((h.section_idx + 1) / (max(t.last) + 1), 9) AS progress FROM ({_TALK}) h JOIN (SELECT conv_id, max(turn)::DOUBLE AS last FROM conversations GROUP BY conv_id) t ON t.conv_id = h.doc_id GROUP BY 1, 2""")
def p16(lib: DriverLibrary) -> DataFrame:
    sections = lib.raw("conversations").selectExpr("conv_id AS doc_id", "turn AS section_idx")
    return search.by_section(_talk_hits(lib), sections).select("doc_id", "section_idx", F.size("hits").cast("long").alias("n"), F.round("progress", 9).alias("progress"))


@query("p17_capped", f"""SELECT doc_id, section_idx, CAST(hit_idx AS INT) AS hit_idx FROM (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY section_idx) AS s FROM ({_TALK})) WHERE s <= 2 AND hit_idx < 3""")
def p17(lib: DriverLibrary) -> DataFrame:
    return search.capped(_talk_hits(lib), results=2, snippets=3, characters=120).select("doc_id", "section_idx", "hit_idx")


@query("e4_search_progress", f"""SELECT t.conv_id AS doc_id, t.turn AS section_idx, coalesce(sum(n) OVER w, 0)::BIGINT AS hits, round((t.turn + 1) / (max(t.turn) OVER (PARTITION BY t.conv_id) + 1)::DOUBLE, 9) AS progress, t.turn = max(t.turn) OVER (PARTITION BY t.conv_id) AS done
    FROM (SELECT conv_id, turn FROM conversations) t LEFT JOIN (SELECT doc_id, section_idx, count(*) AS n FROM ({_TALK}) GROUP BY 1, 2) h ON h.doc_id = t.conv_id AND h.section_idx = t.turn WINDOW w AS (PARTITION BY t.conv_id ORDER BY t.turn)""")
def e4(lib: DriverLibrary) -> DataFrame:
    sections = lib.raw("conversations").selectExpr("conv_id AS doc_id", "turn AS section_idx")
    return search.progressed(_talk_hits(lib), sections).withColumn("progress", F.round("progress", 9))


@query("w9_bodies", f"SELECT doc_id, CAST(i - 1 AS INT) AS start, CAST(i + 3 AS INT) AS body_start, CAST(coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - 1, length(text)) AS INT) AS body_end FROM ({_PLACES.format(f='lower(text)', q='tion')})")
def w9(lib: DriverLibrary) -> DataFrame:
    texts = _texts(lib)
    return windows.bodies(search.hits(texts, "tion", match_diacritics=True), texts.select("doc_id", F.length("text").alias("length")))


# --- positions --------------------------------------------------------------

_PARTS = "CAST(regexp_extract(cfi, '/6/(\\d+)', 1) AS INT), CAST(regexp_extract(cfi, '/4/(\\d+)/1', 1) AS INT), CAST(regexp_extract(cfi, ':(\\d+)', 1) AS INT)"


@query("t4_rough_order", f"SELECT id, concat_ws(',', '6', p[1], '4', p[2], p[3]) AS key FROM (SELECT id, [{_PARTS}] AS p FROM notes)")
def t4(lib: DriverLibrary) -> DataFrame:
    key = positions.rough_key("cfi")
    return lib.notes.orderBy(key, "id").select("id", F.array_join(F.transform(key, lambda x: x.cast("string")), ",").alias("key"))


@query("t16_position_order", f"""SELECT id, concat_ws(',', '1,6,1', p[1], '0,0,1,4,1', p[2], '1,1,0', p[3] + 1, '-1,1,6,1', p[1], '0,0,1,4,1', p[2], '1,1,0', p[3] + 1) AS key FROM (SELECT id, [{_PARTS}] AS p FROM notes)""")
def t16(lib: DriverLibrary) -> DataFrame:
    keyed = lib.notes.select("id", positions.order_key("cfi").alias("k"))
    return keyed.orderBy("k", "id").select("id", F.array_join(F.transform("k", lambda x: x.cast("string")), ",").alias("key"))


@query("p23_positions", """SELECT * FROM (VALUES ('epubcfi(/6/4!/4/10/2/1:1)', 'epubcfi(/6/4!/4/10/3:4)', 'epubcfi(/6/4!/4/10,/2/1:1,/3:4)')) AS t("start", "end", "range")""")
def p23(lib: DriverLibrary) -> DataFrame:
    r = positions.ranged("epubcfi(/6/4!/4/10/2/1:1)", "epubcfi(/6/4!/4/10/3:4)")
    return _values(lib, [(positions.collapsed(r), positions.collapsed(r, True), r)], "start string, end string, range string")


# --- files ------------------------------------------------------------------


@query("c2_decoded", f"""SELECT doc_id::VARCHAR AS path, plain, CASE WHEN plain THEN md5(text) END AS hash FROM (SELECT *, (length(h) - length(translate(h, '{_SIGNS}', ''))) * 500 <= 20 * length(h) AS plain FROM (SELECT *, substring(text, 1, 500) AS h FROM documents))""")
def c2(lib: DriverLibrary) -> DataFrame:
    """Whether each text passes as UTF-8; one with many accents in its head is taken for something else, as the rule has it."""
    raw = _texts(lib).select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    plain = F.coalesce(F.col("encoding") == "utf-8", F.lit(False))
    return files.texts(raw).select("path", plain.alias("plain"), F.when(plain, F.md5("text")).alias("hash"))


@query("c4_mobi", "SELECT doc_id::VARCHAR AS path, 'T' AS title, md5(text) AS hash FROM documents")
def c4(lib: DriverLibrary) -> DataFrame:
    text = F.encode("text", "UTF-8")
    be = lambda n, width: F.unhex(F.lpad(F.hex(n), 2 * width, "0"))
    # a database header of two records: the book's header with its title at the end, and one plain record of text
    head = F.concat(be(F.lit(1), 2), be(F.lit(0), 2), be(F.length(text), 4), be(F.lit(1), 2), be(F.lit(4096), 2), be(F.lit(0), 4), F.encode(F.lit("MOBI"), "UTF-8"), be(F.lit(232), 4), be(F.lit(2), 4), be(F.lit(65001), 4),
                    F.unhex(F.lit("00" * 52)), be(F.lit(244), 4), be(F.lit(1), 4), F.unhex(F.lit("00" * 152)), F.encode(F.lit("T"), "UTF-8"))
    start = F.lit(78 + 16)
    db = F.concat(F.unhex(F.lit("00" * 60)), F.encode(F.lit("BOOKMOBI"), "UTF-8"), F.unhex(F.lit("00" * 8)), be(F.lit(2), 2), be(start, 4), be(F.lit(0), 4), be(start + F.length(head), 4), be(F.lit(2), 4), head, text)
    made = _texts(lib).select(F.col("doc_id").cast("string").alias("path"), db.alias("content"))
    return books.mobi_books(made).select("path", "title", F.md5("text").alias("hash"))


@query("c5_fb2", "SELECT doc_id::VARCHAR AS path, 0 AS section_idx, 'T ' || doc_id AS title, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS hash FROM documents")
def c5(lib: DriverLibrary) -> DataFrame:
    xml = F.concat(F.lit('<FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0"><body><section><title><p>T '), "doc_id", F.lit("</p></title><p>"), strings.xml_escaped("text"), F.lit("</p></section></body></FictionBook>"))
    made = _texts(lib).select(F.col("doc_id").cast("string").alias("path"), F.encode(xml, "UTF-8").alias("content"))
    found = books.fb2_books(made)
    return found.select("path", "section_idx", "title", F.md5(F.regexp_replace("text", r"^T \d+\n", "")).alias("hash"))


@query("c6_sniffed", """SELECT id, CASE id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'cbz' WHEN 2 THEN 'epub' WHEN 3 THEN 'mobi' WHEN 4 THEN 'fb2' END AS kind FROM books""")
def c6(lib: DriverLibrary) -> DataFrame:
    k = F.col("id") % 6
    head = F.when(k == 0, F.encode(F.lit("%PDF-1.7"), "UTF-8")).when((k == 1) | (k == 2), F.unhex(F.lit("504B030414"))).when(k == 3, F.encode(F.concat(F.lpad(F.lit(""), 60, "x"), F.lit("BOOKMOBI")), "UTF-8")).otherwise(F.encode(F.lit("<x/>"), "UTF-8"))
    name = F.when(k == 1, "a.CBZ").when(k == 4, "a.fb2").otherwise("a.bin")
    return lib.books.select("id", files.sniffed(head, name).alias("kind"))


@query("c10_directory_sizes", "SELECT split_part(file_path, '/', 1) AS folder, sum(id)::BIGINT AS bytes, count(*) AS files FROM books GROUP BY 1")
def c10(lib: DriverLibrary) -> DataFrame:
    return files.directory_sizes(lib.books.select(F.col("file_path").alias("path"), F.col("id").alias("length")), 1)


@query("c12_feed", "SELECT p_partkey::VARCHAR AS path, 0 AS ord, CASE WHEN p_partkey % 2 = 0 THEN 'publication' ELSE 'navigation' END AS kind, p_name AS title, p_brand AS author, '/b/' || p_partkey AS href FROM part")
def c12(lib: DriverLibrary) -> DataFrame:
    rel = F.when(F.col("p_partkey") % 2 == 0, "http://opds-spec.org/acquisition").otherwise("subsection")
    xml = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title>'), strings.xml_escaped("p_name"), F.lit("</title><author><name>"), strings.xml_escaped("p_brand"), F.lit('</name></author><link rel="'), rel,
                   F.lit('" href="/b/'), "p_partkey", F.lit('" type="application/epub+zip"/></entry></feed>'))
    return files.feeds(lib.raw("part").select(F.col("p_partkey").cast("string").alias("path"), xml.alias("text"))).select("path", "ord", "kind", "title", "author", "href")


@query("c13_uri_variables", "SELECT id, 'searchTerms,count,lang' AS names FROM books")
def c13(lib: DriverLibrary) -> DataFrame:
    template = F.concat(F.lit("http://h/"), "id", F.lit("{?searchTerms,count:3}{&lang*}"))
    return lib.books.select("id", F.array_join(strings.uri_variables(template), ",").alias("names"))


@query("c14_dictionary", "SELECT lower(p_brand) AS asked, p_brand AS word, p_partkey AS \"offset\", 2::BIGINT AS size FROM part")
def c14(lib: DriverLibrary) -> DataFrame:
    part = lib.raw("part")
    digit = lambda k: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), ((F.col("p_partkey") / 64**k).cast("long") % 64 + 1).cast("int"), F.lit(1))
    lines = part.select(F.concat("p_brand", F.lit("\t"), *(digit(k) for k in (5, 4, 3, 2, 1, 0)), F.lit("\tC")).alias("value"))
    return files.look_up(files.dictd_index(lines), part.select(F.lower("p_brand").alias("word")).distinct())


@query("c11_remote", "SELECT name, size FROM (VALUES ('a.txt', 3::BIGINT), ('b.txt', 0::BIGINT)) AS t(name, size)")
def c11(lib: DriverLibrary) -> DataFrame:
    """A folder elsewhere: files put there by Spark, one removed, listed."""
    root = files.scratch(lib.spark, "remote")
    there = remote.Remote(lib.spark, root)
    there.make("books")
    for name, text in (("a.txt", "abc"), ("b.txt", ""), ("c.txt", "x")):
        there.write(f"books/{name}", text.encode())
    there.remove("books/c.txt")
    return there.listed("books").select("name", "size")


@query("c15_json_store", "SELECT p_partkey AS id, p_name AS name FROM part")
def c15(lib: DriverLibrary) -> DataFrame:
    """A store written as JSON arrays, one a file, and read back; a broken one beside them is empty."""
    path = files.scratch(lib.spark, "store")
    arrays = lib.raw("part").groupBy(F.pmod("p_partkey", F.lit(4)).alias("f")).agg(F.to_json(F.collect_list(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))).alias("value"))
    arrays.select("value").repartition(4, "value").write.text(path)
    lib.spark.createDataFrame([('[{"id": 1, "na',)], "value string").coalesce(1).write.mode("append").text(path)
    return files.json_store(lib.spark, path, "id long, name string")


# --- exports ----------------------------------------------------------------

_ISO = "strftime({c}, '%Y-%m-%dT%H:%M:%S.%g')"


@query("k1_csv_table", f"""SELECT title AS "Book", author AS "Author", chapter AS "Chapter", content AS "Content", reader_note AS "Reader Note", type AS "Type", '#' || color AS "Color", {_ISO.format(c='n.create_time')} AS "Create Time", {_ISO.format(c='n.update_time')} AS "Update Time"
    FROM notes n JOIN books b ON b.id = n.book_id""")
def k1(lib: DriverLibrary) -> DataFrame:
    return sinks.notes_table(lib.notes, lib.books)


@query("k2_markdown", f"""SELECT book_id, md5('# ' || title || chr(10) || chr(10) || ' *' || author || '*' || chr(10) || chr(10) || string_agg(body, '' ORDER BY n.id)) AS hash FROM
    (SELECT *, CASE WHEN lag(chapter) OVER (PARTITION BY book_id ORDER BY id) = chapter THEN '' ELSE '## ' || chapter || chr(10) || chr(10) END || CASE WHEN content <> '' THEN '> ' || content || chr(10) || chr(10) ELSE '' END ||
    CASE WHEN coalesce(reader_note, '') <> '' THEN reader_note || chr(10) || chr(10) ELSE '' END || chr(10) AS body FROM notes WHERE type IN {NOTES}) n JOIN books b ON b.id = n.book_id GROUP BY book_id, title, author""")
def k2(lib: DriverLibrary) -> DataFrame:
    from quire.operators import filters

    return sinks.rendered(lib.notes.where(filters.annotation()), lib.books).select("book_id", F.md5("text").alias("hash"))


_SAVED = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, count(DISTINCT id) AS ids FROM {v}" for t, v in (("books", "books"), ("notes", "notes"), ("reading_time", "reading_time"), ("groups", "lib_groups"), ("tags", "tags"), ("book_tags", "book_tags")))


@query("k4_k5_snapshot", _SAVED)
def k4(lib: DriverLibrary) -> DataFrame:
    """A snapshot that passes its checks, put in a library's place, counted there."""
    path, live = files.scratch(lib.spark, "snapshot"), files.scratch(lib.spark, "live")
    sinks.restored(lib.spark, sinks.snapshot(lib, path), live)
    parts = [Library(lib.spark, live).table(t).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")).select(F.lit(t).alias("name"), "n", "ids") for t in ("books", "notes", "reading_time", "groups", "tags", "book_tags")]
    return functools.reduce(DataFrame.unionByName, parts)


@query("g5_replaced", "SELECT id, title FROM books WHERE id % 3 = 1")
def g5(lib: DriverLibrary) -> DataFrame:
    """A table replaced twice: readers have the last whole version."""
    path = files.scratch(lib.spark, "table")
    for k in (0, 1):
        access.replace_atomically(lib.spark, lib.books.where(F.col("id") % 3 == k).select("id", "title"), path)
    return lib.spark.read.schema("id long, title string").parquet(path)


@query("k6_integrity", f"""SELECT 'has books' AS "check", count(*) > 0 AS ok, count(*)::VARCHAR AS detail FROM books UNION ALL SELECT 'book ids unique', count(*) = count(DISTINCT id), (count(*) - count(DISTINCT id))::VARCHAR FROM books
    UNION ALL SELECT 'readings have books', count(*) = 0, count(*)::VARCHAR FROM reading_time WHERE book_id NOT IN (SELECT id FROM books)
    UNION ALL SELECT 'places unique', count(*) = 0, count(*)::VARCHAR FROM (SELECT cfi, book_id FROM notes WHERE type IN {NOTES} GROUP BY cfi, book_id HAVING count(*) > 1)""")
def k6(lib: DriverLibrary) -> DataFrame:
    return sinks.integrity(lib)


@query("k7_envelope", """SELECT '{"status":"ok","name":"tags_list","data":[{"id":1,"name":"quality","rgb":6737151},{"id":2,"name":"Toxic","rgb":16711680},{"id":3,"name":"unused"}]}' AS json""")
def k7(lib: DriverLibrary) -> DataFrame:
    return sinks.envelope(lib.tags, "tags_list")


# --- tools and streams ------------------------------------------------------


@query("r1_r2_tools", """SELECT * FROM (VALUES ('calculator'), ('current_time'), ('mindmap_draw'), ('book_content_search'), ('bookshelf_lookup'), ('bookshelf_organize'), ('notes_search'), ('reading_history'), ('current_reading_metadata'),
    ('current_book_toc'), ('current_chapter_content'), ('chapter_content_by_href'), ('tags_list'), ('books_tags_list'), ('apply_book_tags')) AS t(name)""")
def r1(lib: DriverLibrary) -> DataFrame:
    return _values(lib, [(t.name,) for t in tools.enabled(None)], "name string")


@query("r2_notes_search_tool", f"""SELECT count(*) AS n FROM (SELECT * FROM notes WHERE type IN {NOTES} AND content ILIKE '%on%' ORDER BY update_time DESC, id DESC LIMIT 50) n JOIN books b ON b.id = n.book_id AND NOT is_deleted""")
def r2(lib: DriverLibrary) -> DataFrame:
    text = tools.TOOLS["notes_search"].call(lib, '{"keyword": "on", "limit": 500}')
    return lib.spark.createDataFrame([(text,)], "t string").select(F.size(F.from_json("t", "status string, data array<struct<note_id long>>")["data"]).cast("long").alias("n"))


@query("r2_content_tools", """SELECT 'toc' AS tool, section_idx, md5(title || href) AS hash FROM sections WHERE book_id = 12 UNION ALL SELECT 'chapter', section_idx, md5(left(content, 700)) FROM sections WHERE book_id = 12 AND href = 's2.xhtml'
    UNION ALL SELECT 'current', s.section_idx, md5(s.content) FROM sections s JOIN books b ON b.id = s.book_id AND b.id = 12 AND s.section_idx = CAST(regexp_extract(b.last_read_position, '/6/(\\d+)', 1) AS INT) // 2 - 1""")
def r2c(lib: DriverLibrary) -> DataFrame:
    """The tools that read a book's own sections."""
    toc, chapter, current = (tools.TOOLS[n].run(lib, 12, *a) for n, a in (("current_book_toc", ()), ("chapter_content_by_href", ("s2.xhtml#p3", 700)), ("current_chapter_content", ())))
    first = toc.select(F.lit("toc").alias("tool"), "section_idx", F.md5(F.concat("title", "href")).alias("hash"))
    return first.unionByName(chapter.select(F.lit("chapter").alias("tool"), "section_idx", F.md5("content").alias("hash"))).unionByName(current.select(F.lit("current").alias("tool"), "section_idx", F.md5("content").alias("hash")))


def _moves(lib: DriverLibrary) -> DataFrame:
    return lib.raw("events").selectExpr("event_id AS id", "user_id AS book_id", "ts", "event_type AS place", "value AS progress")


@query("e3_moves", "SELECT id FROM (SELECT event_id AS id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events) WHERE last IS NULL OR last <> event_type")
def e3(lib: DriverLibrary) -> DataFrame:
    return reading.moves(_moves(lib)).select("id")


@query("e3_last_places", "SELECT user_id AS book_id, arg_max(event_type, (ts, event_id)) AS place FROM events GROUP BY user_id")
def e3b(lib: DriverLibrary) -> DataFrame:
    return reading.last_places(_moves(lib)).select("book_id", "place")


@query("e5_daily_seconds", "SELECT CAST(ts AS DATE) AS day, user_id AS book_id, sum(CAST(floor(value) AS BIGINT))::BIGINT AS seconds FROM events GROUP BY 1, 2")
def e5(lib: DriverLibrary) -> DataFrame:
    return reading.daily_seconds(lib.raw("events").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "user_id AS book_id", "CAST(floor(value) AS BIGINT) AS seconds"))


@query("e2_timeline", """SELECT conv_id, CAST(run AS INT) AS run, kind, md5(string_agg(text, '' ORDER BY turn)) AS hash FROM (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (
    SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY conv_id ORDER BY turn) = kind THEN 0 ELSE 1 END AS new FROM (SELECT conv_id, turn, text, CASE WHEN turn % 5 < 2 THEN 'think' ELSE 'reply' END AS kind FROM conversations))) GROUP BY conv_id, run, kind""")
def e2(lib: DriverLibrary) -> DataFrame:
    chunks = lib.raw("conversations").selectExpr("conv_id", "turn AS seq", "CASE WHEN turn % 5 < 2 THEN 'think' ELSE 'reply' END AS kind", "text")
    return reading.timeline(chunks).select("conv_id", "run", "kind", F.md5("text").alias("hash"))


@query("e1_cumulative_answers", "SELECT conv_id, md5(arg_max(text, turn)) AS hash FROM conversations GROUP BY conv_id")
def e1(lib: DriverLibrary) -> DataFrame:
    return reading.cumulative_answers(lib.raw("conversations").selectExpr("conv_id", "turn AS seq", "text")).select("conv_id", F.md5("text").alias("hash"))
