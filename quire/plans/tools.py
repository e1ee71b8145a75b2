"""Tools: named queries that take JSON and give a JSON envelope."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from quire.functions import dates, numbers
from quire.operators import aggregates, documents, filters, joins, search, sets, sorts
from quire.sources import sinks


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    fields: dict[str, type]
    run: Callable[..., DataFrame]
    required: tuple[str, ...] = ()
    seconds: int = 4

    def schema(self) -> dict:
        kinds = {int: "integer", str: "string", bool: "boolean", list: "array"}
        return {"type": "object", "properties": {n: {"type": kinds[t]} for n, t in self.fields.items()}, "required": list(self.required)}

    def parsed(self, given: dict) -> dict:
        """The arguments that the tool knows, as their types; raises ValueError for a missing or wrong one."""
        out = {}
        for n, kind in self.fields.items():
            v = given.get(n)
            if v is None:
                if n in self.required:
                    raise ValueError(f"{n} is required")
                continue
            if kind is int and isinstance(v, (float, str)) and not isinstance(v, bool):
                v = int(v)
            if kind is str and not isinstance(v, str):
                v = str(v)
            if not isinstance(v, kind):
                raise ValueError(f"{n} must be {kind.__name__}")
            out[n] = v
        return out

    def call(self, library, text: str) -> str:  # noqa: ANN001
        """The envelope for a JSON argument; whatever goes wrong is in the envelope."""
        try:
            given = json.loads(text or "{}")
            if not isinstance(given, dict):
                raise ValueError("an object is required")
            return sinks.envelope(self.run(library, **self.parsed(given)), self.name).first()["json"]
        except Exception as e:  # noqa: BLE001
            return sinks.error_envelope(self.name, str(e))


def _calculator(lib, expression: str) -> DataFrame:  # noqa: ANN001
    return lib.spark.createDataFrame([(expression, numbers.calculate(expression))], "expression string, result string")


def _time(lib) -> DataFrame:  # noqa: ANN001
    return lib.spark.range(1).select(*(c.alias(n) for n, c in dates.current_time().items()))


def _mind_map(lib, outline: str, title: str = "") -> DataFrame:  # noqa: ANN001
    nodes = documents.outline(title, outline)
    return lib.spark.createDataFrame(nodes, "node_id int, parent_id int, level int, label string")


def _shelf(lib, query: str | None = None, groupId: int | None = None, includeDeleted: bool = False, limit: int | None = None) -> DataFrame:  # noqa: ANN001, N803
    return filters.shelf_lookup(lib.books, query, groupId, includeDeleted).orderBy(F.desc("update_time"), "id").limit(sorts.clamp("bookshelf", limit)).select(*filters.book_card())


def _notes(lib, keyword: str | None = None, bookId: int | None = None, **rest) -> DataFrame:  # noqa: ANN001, ANN003, N803
    found = filters.notes_where(lib.notes, keyword, bookId, rest.get("from"), rest.get("to"))
    return joins.first_notes(found, lib.books, sorts.clamp("notes", rest.get("limit")))


def _history(lib, bookId: int | None = None, **rest) -> DataFrame:  # noqa: ANN001, ANN003, N803
    return joins.first_readings(filters.reading_where(lib.reading_time, bookId, rest.get("from"), rest.get("to")), lib.books, sorts.clamp("history", rest.get("limit")))


def _content(lib, keyword: str, bookId: int, maxResults: int | None = None, maxSnippets: int | None = None, maxCharacters: int | None = None) -> DataFrame:  # noqa: ANN001, N803
    texts = lib.sections.where(F.col("book_id") == bookId).select(F.col("book_id").alias("doc_id"), "section_idx", "content")
    found = search.hits(texts.withColumn("key", F.struct("doc_id", "section_idx")), keyword, "key", "content").select("key.doc_id", "key.section_idx", "hit_idx", "pre", "match", "post")
    return search.capped(found, maxResults, maxSnippets, maxCharacters).select("section_idx", "hit_idx", "snippet")


def _plan(lib, plan: list) -> DataFrame:  # noqa: ANN001
    rows = lib.spark.createDataFrame([(int(p["bookId"]), int(p.get("groupId") or 0)) for p in plan], "book_id long, group_id long")
    if not sets.repeated_targets(rows).isEmpty():
        raise ValueError("a book is named more than once")
    missing = rows.join(filters.live(lib.books).select(F.col("id").alias("book_id")), "book_id", "left_anti")
    if not missing.isEmpty():
        raise ValueError("a book was not found")
    return aggregates.plan_statistics(rows, lib.books)


def _tags(lib) -> DataFrame:  # noqa: ANN001
    return sorts.tags(lib.tags)


def _book_tags(lib, bookIds: list | None = None) -> DataFrame:  # noqa: ANN001, N803
    return joins.tags_of_books(lib.books, lib.book_tags, lib.tags, bookIds)


def _apply_tags(lib, books: list) -> DataFrame:  # noqa: ANN001
    wanted = lib.spark.createDataFrame([(int(b["bookId"]), list(b["tags"])) for b in books], "book_id long, tags array<string>")
    return sets.tag_changes(joins.tag_names(filters.live(lib.books), lib.book_tags, lib.tags), wanted)


def _metadata(lib, bookId: int) -> DataFrame:  # noqa: ANN001, N803
    return filters.by_id(lib.books, bookId).select(*filters.book_card(F.col("last_read_position"), F.col("rating"), filters.status().alias("status")))


def _toc(lib, bookId: int) -> DataFrame:  # noqa: ANN001, N803
    return lib.sections.where(F.col("book_id") == bookId).select("section_idx", "title", "href").orderBy("section_idx")


def _cut(sections: DataFrame, most: int | None) -> DataFrame:
    cut = sorts.clamp("chapter", most) if most and most > 0 else None
    return sections.select("section_idx", "title", (F.substring("content", 1, cut) if cut else F.col("content")).alias("content"))


def _chapter(lib, bookId: int, href: str, maxCharacters: int | None = None) -> DataFrame:  # noqa: ANN001, N803
    """The section that a link names, with or without a place in it."""
    return _cut(lib.sections.where((F.col("book_id") == bookId) & (F.col("href") == href.partition("#")[0])), maxCharacters)


def _current_chapter(lib, bookId: int, maxCharacters: int | None = None) -> DataFrame:  # noqa: ANN001, N803
    """The section in which the book was left: the spine's second, fourth, sixth … step names its first, second, third."""
    step = F.regexp_extract("last_read_position", r"^epubcfi\(/6/(\d+)", 1).try_cast("int")
    at = filters.by_id(lib.books, bookId).select(F.col("id").alias("book_id"), (step / 2 - 1).cast("int").alias("section_idx"))
    return _cut(lib.sections.join(at, ["book_id", "section_idx"]), maxCharacters)


TOOLS = {
    t.name: t
    for t in (
        Tool("calculator", "Evaluates an arithmetic expression", {"expression": str}, _calculator, ("expression",), 2), Tool("current_time", "Date and time now", {}, _time, (), 1),
        Tool("mindmap_draw", "A tree from a bulleted outline", {"title": str, "outline": str}, _mind_map, ("outline",)),
        Tool("book_content_search", "Searches a book's text", {"keyword": str, "bookId": int, "maxResults": int, "maxSnippets": int, "maxCharacters": int}, _content, ("keyword", "bookId"), 20),
        Tool("bookshelf_lookup", "Finds books", {"query": str, "groupId": int, "includeDeleted": bool, "limit": int}, _shelf, (), 3), Tool("bookshelf_organize", "Checks a plan of groups", {"plan": list}, _plan, ("plan",), 8),
        Tool("notes_search", "Finds notes", {"keyword": str, "bookId": int, "from": str, "to": str, "limit": int}, _notes), Tool("reading_history", "Reading rows", {"bookId": int, "from": str, "to": str, "limit": int}, _history),
        Tool("current_reading_metadata", "The book that is read", {"bookId": int}, _metadata, ("bookId",)), Tool("current_book_toc", "Chapters of a book", {"bookId": int}, _toc, ("bookId",)),
        Tool("current_chapter_content", "Text of the current chapter", {"bookId": int, "maxCharacters": int}, _current_chapter, ("bookId",)),
        Tool("chapter_content_by_href", "Text of a chapter", {"bookId": int, "href": str, "maxCharacters": int}, _chapter, ("bookId", "href")), Tool("tags_list", "All tags", {}, _tags),
        Tool("books_tags_list", "Tags of books", {"bookIds": list}, _book_tags), Tool("apply_book_tags", "Checks changes of tags", {"books": list}, _apply_tags, ("books",), 12),
    )
}


def enabled(names: list[str] | None) -> list[Tool]:
    """The tools of a list of names, each once and in their own order; unknown names are passed over. All without a list."""
    wanted = None if names is None else {n.strip() for n in names}
    return [t for n, t in TOOLS.items() if wanted is None or n in wanted]
