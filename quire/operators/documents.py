"""Chapters, tables of contents, text of marked-up sections, sentences, outlines."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

from pyspark.sql import DataFrame, Window, functions as F

from quire.functions import strings
from quire.operators import rows

# The built-in rules by which chapter headings are known, and their samples.
DEFAULT_RULE = "default_chapter_rule"
RULES = {
    "default_chapter_rule": r"^(?:(.+[ 　]+)|())(第[一二三四五六七八九十零〇百千万两0123456789]+[章卷]|卷[一二三四五六七八九十零〇百千万两0123456789]+|chap(?:ter)\.?|vol(?:ume)?\.?|book|bk)(?:[ 　]+(?:\S.*)?)?[ 　]*$",
    "cn_only_numeric": r"^\s*第[一二三四五六七八九十零〇百千万两0123456789]+章(?:[ ：:.-].*)?$",
    "en_chapter_number": r"^\s*chapter\s+\d+(?:[ .:-].*)?$",
    "en_volume_number": r"^\s*(volume|book)\s+\d+(?:[ .:-].*)?$",
}
SAMPLES = {
    "default_chapter_rule": ["第一章 起始之地", "第十二卷 风云再起", "Chapter 12: The Journey", "chap 3. another life", "Book 1 - Dawn of Era", "Vol.2 A new world", "bk 4 - outside sample"],
    "cn_only_numeric": ["第一章 少年出山", "第二十章 ：终极之战", "第3章- 遗失的记忆", "第四卷 序章"],
    "en_chapter_number": ["Chapter 1: Beginning", "chapter 23 - A twist", "CHAPTER 99. Finale", "chapter one"],
    "en_volume_number": ["Volume 1: Arrival", "Book 2 - Secrets", "volume 03 introduction", "vol. 4"],
}


@dataclass(frozen=True)
class Rule:
    """A rule for headings: built in, or a user's pattern."""

    pattern: str
    case_sensitive: bool = False
    multi_line: bool = True
    samples: tuple[str, ...] = field(default=())

    @classmethod
    def from_json(cls, text: str) -> Rule:
        """A stored rule {pattern, caseSensitive, multiLine, samples}; what is missing is as in a new one."""
        d = json.loads(text)
        return cls(str(d["pattern"]), bool(d.get("caseSensitive", False)), bool(d.get("multiLine", True)), tuple(map(str, d.get("samples") or ())))

    @classmethod
    def built_in(cls, name: str = DEFAULT_RULE) -> Rule:
        return cls(RULES[name], samples=tuple(SAMPLES[name]))

    def compiled(self) -> re.Pattern:
        """The pattern; the default rule's if it can't be read."""
        flags = (0 if self.case_sensitive else re.I) | (re.M if self.multi_line else 0)
        try:
            return re.compile(self.pattern, flags)
        except re.error:
            return re.compile(RULES[DEFAULT_RULE], re.I | re.M)

    def evaluated(self) -> tuple[list[tuple[str, bool]], str | None]:
        """Whether each sample is a heading, and what is wrong with the pattern."""
        try:
            p = re.compile(self.pattern, (0 if self.case_sensitive else re.I) | (re.M if self.multi_line else 0))
        except re.error as e:
            return [(s, False) for s in self.samples], str(e)
        return [(s, bool(p.search(s))) for s in self.samples], None


def chapters(text: str, rule: re.Pattern, fallback: str) -> list[tuple[int, str, str]]:
    """(number, title, body): what comes before the first heading has no title; without a heading, `chunks`."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    found = list(rule.finditer(text))
    if not found:
        return chunks(text, fallback)
    out = []
    if intro := text[: found[0].start()].strip():
        out.append(("", intro))
    ends = [m.start() for m in found[1:]] + [len(text)]
    out += [(m[0].strip(), text[m.end() : e].strip()) for m, e in zip(found, ends, strict=True)]
    return [(i, *x) for i, x in enumerate(out)]


def chunks(text: str, title: str, size: int = 20_000) -> list[tuple[int, str, str]]:
    """The whole under its title, or pieces cut at the first line end after each `size` characters."""
    if len(text) <= size:
        return [(0, title, text.strip())]
    out, start = [], 0
    while start < len(text):
        end = text.find("\n", start + size) if start + size < len(text) else -1
        end = len(text) if end < 0 else end
        out.append((len(out), f"No.{len(out) + 1}", text[start:end].strip()))
        start = end + 1
    return out


def split_chapters(docs: DataFrame, key: str = "doc_id", text: str = "text", title: str | None = None, rule: Rule | None = None) -> DataFrame:
    """key, section_idx, title, content of every chapter."""
    pattern = (rule or Rule.built_in()).compiled()
    named = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"), (F.col(title) if title else F.col(key).cast("string")).alias("_title"))
    return rows.scan(named, [key], ["_text", "_title"], lambda t, n: chapters(t, pattern, n or ""), "section_idx int, title string, content string")


def titled(sections: DataFrame) -> DataFrame:
    """Sections whose missing titles are their first line that isn't blank, or else their number."""
    first = F.filter(F.split("content", "\n"), lambda x: ~strings.blank(x))
    fallback = F.when(F.size(first) > 0, strings.u_trim(F.element_at(first, 1))).otherwise(F.concat(F.lit("Section "), F.col("section_idx") + 1))
    return sections.withColumn("title", F.when(strings.blank("title"), fallback).otherwise(F.col("title")))


def nested(levels: list[tuple[int, int]]) -> list[tuple[int, int | None, int, int]]:
    """(ord, parent ord, depth, entries that close after it) of entries (ord, level) in reading order."""
    stack: list[tuple[int, int]] = []
    out: list[list] = []
    for o, level in levels:
        closed = 0
        while stack and stack[-1][1] >= level:
            stack.pop()
            closed += 1
        if out:
            out[-1][3] = closed
        out.append([o, stack[-1][0] if stack else None, len(stack), 0])
        stack.append((o, level))
    if out:
        out[-1][3] = len(stack)
    return [tuple(x) for x in out]


def nested_toc(toc: DataFrame) -> DataFrame:
    """doc_id, ord, parent_ord, depth, closes: a table of contents (doc_id, ord, level) as a tree. One document is one list."""
    lists = toc.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("ord").cast("int").alias("ord"), F.col("level").cast("int").alias("level")))).alias("entries"))
    return rows.scan(lists, ["doc_id"], ["entries"], lambda e: nested([(x["ord"], x["level"]) for x in e]), "ord int, parent_ord int, depth int, closes int")


_REJECT = ("script", "style")


# The elements that bound a sentence, and the quotes that belong to the one before.
_SPOKEN_BLOCKS = frozenset({
    "article", "aside", "audio", "blockquote", "caption", "details", "dialog", "div", "dl", "dt", "dd", "figure", "footer", "form", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "li", "main", "math", "nav", "ol", "p", "pre", "section", "tr",
})
_QUOTES = "\"'“”‘’"


class _Texts(HTMLParser):
    """Text nodes of markup, with the block and the link that each is in."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, rejecting: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.rejecting, self.open, self.nodes, self.block = rejecting, [], [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in _SPOKEN_BLOCKS:
            self.block += 1
        if tag not in self.VOID:
            rejected = self.rejecting and (tag in _REJECT or "translated-text" in (a.get("class") or "").split())
            local = tag == "a" and bool((a.get("href") or "").strip()) and not re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", (a.get("href") or "").strip())
            self.open.append((tag, rejected, local))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break
        if tag in _SPOKEN_BLOCKS:
            self.block += 1

    def handle_data(self, data: str) -> None:
        if data and not any(r for _, r, _ in self.open):
            self.nodes.append((data, self.block, any(x for _, _, x in self.open), any(t == "body" for t, _, _ in self.open)))


def text_nodes(markup: str, rejecting: bool = True) -> list[tuple[str, int, bool, bool]]:
    """(text, block, in a local link, in the body) of each text node; scripts, styles and translations are left out if rejecting."""
    p = _Texts(rejecting)
    p.feed(markup)
    p.close()
    return p.nodes


def extract_nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, node_idx, text of every text node that is read."""
    return rows.scan(pages.withColumn("_h", F.coalesce(F.col(html), F.lit(""))), [key], ["_h"], lambda h: ((i, t) for i, (t, *_) in enumerate(text_nodes(h))), "node_idx int, text string")


def plain_text(pages: DataFrame, key: str = "page_id", html: str = "html", limit: int | None = None) -> DataFrame:
    """key, text of each body with its scripts and styles, trimmed and cut to a limit if there is one above 0."""

    def one(h: str) -> list[tuple[str]]:
        nodes = text_nodes(h, rejecting=False)
        body = [n for n in nodes if n[3]] or nodes
        t = "".join(n[0] for n in body).strip()
        return [(t[:limit] if limit and limit > 0 else t,)]

    return rows.scan(pages.withColumn("_h", F.coalesce(F.col(html), F.lit(""))), [key], ["_h"], one, "text string")


def preceding(nodes: DataFrame, count: int, key: str = "doc_id") -> DataFrame:
    """key, node_idx, before: the text before each node in its document, whole nodes back to the one with which `count` characters are reached. One document is one list."""

    def one(entries: list[dict]) -> Iterator[tuple[int, str]]:
        for i, e in enumerate(entries):
            size, k = 0, i
            while k > 0 and size < count:
                k -= 1
                size += len(entries[k]["text"])
            yield e["node_idx"], "".join(x["text"] for x in entries[k:i])

    lists = nodes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("node_idx", "text"))).alias("entries"))
    return rows.scan(lists, [key], ["entries"], one, "node_idx int, before string")


def sentences(nodes: list[tuple[str, int, bool]]) -> Iterator[tuple[int, str]]:
    """(number, sentence) of text nodes (text, block, in a local link). A full stop ends one before a space, a quote or the node's end, other marks always; quotes after it belong to it; a block's end ends one."""
    held, block, n = "", None, 0
    for text, b, local in nodes:
        if local or not text:
            continue
        if block is not None and b != block and held:
            if held.strip():
                yield n, held
                n += 1
            held = ""
        block, start, i = b, 0, 0
        while i < len(text):
            c, after = text[i], text[i + 1 : i + 2]
            if c in "!?。！？" or c == "." and (not after or after in _QUOTES or after.isspace()):
                i += 1
                while i < len(text) and text[i] in _QUOTES:
                    i += 1
                whole = held + text[start:i]
                if whole.strip():
                    yield n, whole
                    n += 1
                held, start = "", i
                continue
            i += 1
        held += text[start:]
    if held.strip():
        yield n, held


def split_sentences(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, sentence_idx, sentence of every page."""
    return rows.scan(pages.withColumn("_h", F.coalesce(F.col(html), F.lit(""))), [key], ["_h"], lambda h: sentences([(t, b, a) for t, b, a, _ in text_nodes(h, rejecting=False)]), "sentence_idx int, sentence string")


def peeked(rows: DataFrame, count: int, key: str = "page_id", order: str = "sentence_idx", text: str = "sentence") -> DataFrame:
    """rows with `ahead`: the texts of the `count` rows that follow in their document, which a speech engine prepares before it needs them."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1, count)
    return rows.withColumn("ahead", F.collect_list(text).over(w))


class _Elements(HTMLParser):
    """Elements with their own text, as a tree."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = {"tag": "#root", "class": "", "kids": []}
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        e = {"tag": tag, "class": dict(attrs).get("class") or "", "kids": []}
        self.open[-1]["kids"].append(e)
        if tag not in _Texts.VOID:
            self.open.append(e)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k]["tag"] == tag:
                del self.open[k:]
                break

    def handle_data(self, data: str) -> None:
        self.open[-1]["kids"].append(data)


def translatable(markup: str, deepest: int = 15) -> list[tuple[int, str, str]]:
    """(number, tag, text) of the elements that a translator takes whole: leaves with text, and elements with text or a span of their own."""
    p = _Elements()
    p.feed(markup)
    p.close()

    def text(e: dict) -> str:
        return "".join(k if isinstance(k, str) else text(k) for k in e["kids"])

    out: list[tuple[int, str, str]] = []

    def walk(e: dict, depth: int) -> None:
        if depth > deepest:
            return
        for k in e["kids"]:
            if isinstance(k, str) or k["tag"] in ("pre", "code", "math", "style", "script") or "translated-text" in k["class"].split():
                continue
            inner = [x for x in k["kids"] if not isinstance(x, str)]
            own = any(isinstance(x, str) and x.strip() or not isinstance(x, str) and x["tag"] == "span" for x in k["kids"])
            if own or not inner and text(k).strip():
                out.append((len(out), k["tag"], " ".join(text(k).split())))
            elif inner:
                walk(k, depth + 1)

    walk(p.root, 0)
    return out


def translatable_elements(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    return rows.scan(pages.withColumn("_h", F.coalesce(F.col(html), F.lit(""))), [key], ["_h"], translatable, "element_idx int, tag string, text string")


def garbled_ratio(text: str) -> float:
    """Share of the first 500 characters that wrongly decoded text is full of."""
    head = text[:500]
    return sum(c in _GARBLED for c in head) / len(head) if head else 0.0


# The characters that count as signs of a wrong decoding.
_GARBLED = frozenset("ÕÊ�Ç³¾ÐÓÎÁÉÃÄÅÆËÌÍÏÒÔÖÙÚÛÜÝàáâãäåæèéêëìíîïðñòóôõöùúûüýÿ｡｢｣､･ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝ€")


def garbled(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ratio and whether it is above 20 in 500: by JVM functions."""
    head = F.substring(F.coalesce(F.col(text), F.lit("")), 1, 500)
    signs = "".join(sorted(_GARBLED))
    ratio = F.try_divide(F.length(head) - F.length(F.translate(head, signs, "")), F.length(head))
    return docs.select(key, F.coalesce(ratio, F.lit(0.0)).alias("ratio")).withColumn("garbled", F.col("ratio") > 20 / 500)


_BULLET = re.compile(r"^(\s*)([-*•+]\s+)(.+)$")


def outline(title: str, text: str) -> list[tuple[int, int | None, int, str]]:
    """(id, parent, level, label) of a bulleted outline; the title is node 0 at level -1. Raises ValueError for a line without bullet."""
    lines = [x.rstrip() for x in re.split(r"\r\n|\r|\n", text) if x.strip()]
    if not lines:
        raise ValueError("the outline is empty")
    out: list[tuple[int, int | None, int, str]] = [(0, None, -1, title.strip() or "Mindmap")]
    stack = [(-1, 0, -1)]  # indent, id, level
    for line in lines:
        m = _BULLET.match(line.replace("\t", "  "))
        if not m or not m[3].strip():
            raise ValueError(f"not a bullet: {line}")
        indent = len(m[1])
        while stack[-1][0] >= indent:
            stack.pop()
        _, parent, level = stack[-1]
        out.append((len(out), parent, level + 1, m[3].strip()))
        stack.append((indent, len(out) - 1, level + 1))
    return out


def outline_nodes(outlines: DataFrame, key: str = "id") -> DataFrame:
    """key, node_id, parent_id, level, label, error of outlines (key, title, outline); one that can't be read has one row with its error."""

    def one(title: str | None, text: str | None) -> list[tuple]:
        try:
            return [(*x, None) for x in outline(title or "", text or "")]
        except ValueError as e:
            return [(None, None, None, None, str(e))]

    return rows.scan(outlines, [key], ["title", "outline"], one, "node_id int, parent_id int, level int, label string, error string")


def outline_statistics(nodes: DataFrame, key: str = "id") -> DataFrame:
    """Nodes besides the root and the deepest level."""
    return nodes.where("error IS NULL").groupBy(key).agg((F.count("*") - 1).alias("nodes"), F.greatest(F.max("level"), F.lit(0)).alias("depth"))


def flattened(items: list, parent: int | None = None, level: int = 0, out: list | None = None) -> list[tuple[int, int | None, int, str, str]]:
    """(ord, parent ord, level, label, href) of nested items {label, href, subitems}, in reading order."""
    out = [] if out is None else out
    for x in items or ():
        out.append((len(out), parent, level, x.get("label") or "", x.get("href") or ""))
        flattened(x.get("subitems"), len(out) - 1, level + 1, out)
    return out
