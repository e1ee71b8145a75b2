"""Book files as tables: EPUB packages, FB2 documents, comic archives, Mobipocket text; a writer for EPUB."""

from __future__ import annotations

import html
import io
import posixpath
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote

from pyspark.sql import DataFrame

from quire.operators import documents, rows


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _all(e: ET.Element, name: str) -> list[ET.Element]:
    return [x for x in e.iter() if _local(x.tag) == name]


def _text(e: ET.Element | None) -> str:
    return "" if e is None else " ".join("".join(e.itertext()).split())


def nav_items(ol: ET.Element | None, base: str) -> list[dict]:
    """Nested items of a navigation list."""
    out = []
    for li in ol if ol is not None else ():
        if _local(li.tag) == "li":
            a = next((x for x in li if _local(x.tag) in ("a", "span")), None)
            href = None if a is None or not a.get("href") else unquote(posixpath.normpath(posixpath.join(base, a.get("href"))))
            out.append({"label": _text(a) or ("" if a is None else a.get("title") or ""), "href": href, "subitems": nav_items(next((x for x in li if _local(x.tag) == "ol"), None), base)})
    return out


def ncx_items(parent: ET.Element, base: str) -> list[dict]:
    """Nested items of the older kind of navigation."""
    out = []
    for p in (x for x in parent if _local(x.tag) == "navPoint"):
        label = next((x for x in p if _local(x.tag) == "navLabel"), None)
        content = next((x for x in p if _local(x.tag) == "content"), None)
        src = None if content is None or not content.get("src") else unquote(posixpath.normpath(posixpath.join(base, content.get("src"))))
        out.append({"label": _text(label), "href": src, "subitems": ncx_items(p, base)})
    return out


class Epub:
    """A package: metadata, spine and table of contents. Raises ValueError for what is none."""

    def __init__(self, raw: bytes) -> None:
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(raw))
            container = ET.fromstring(self.zip.read("META-INF/container.xml"))
            self.opf_path = _all(container, "rootfile")[0].get("full-path")
            self.opf = ET.fromstring(self.zip.read(self.opf_path))
        except (KeyError, IndexError, zipfile.BadZipFile, ET.ParseError) as e:
            raise ValueError(f"not a package: {e}") from e
        self.base = posixpath.dirname(self.opf_path)
        self.items = {i.get("id"): i for i in _all(self.opf, "item")}

    def path(self, href: str) -> str:
        return unquote(posixpath.normpath(posixpath.join(self.base, href)))

    def metadata(self) -> list[tuple[str, str, str | None, str | None]]:
        """(name, value, refinement, its value): core elements, what refines them, and the rendition and media properties."""
        head = next(iter(_all(self.opf, "metadata")), None)
        out = []
        els = list(head) if head is not None else []
        refined: dict[str, list[ET.Element]] = {}
        for e in els:
            if _local(e.tag) == "meta" and e.get("refines"):
                refined.setdefault(e.get("refines").lstrip("#"), []).append(e)
        for e in els:
            name = _local(e.tag)
            if name != "meta":
                out.append((name, _text(e), None, None))
                out += [(name, _text(e), _local(k), v) for k, v in e.attrib.items() if _local(k) in ("role", "file-as")]
                out += [(name, _text(e), r.get("property"), _text(r)) for r in refined.get(e.get("id") or "", ())]
            elif e.get("property") and not e.get("refines"):
                out.append((e.get("property"), _text(e), None, None))
            elif e.get("property") and e.get("property").startswith("media:"):
                out.append((e.get("property"), _text(e), "refines", e.get("refines").lstrip("#")))
        return out

    def spine(self) -> Iterator[tuple[int, str, bool, int, str]]:
        """(section, href, linear, size, text) in reading order."""
        for k, ref in enumerate(_all(self.opf, "itemref")):
            item = self.items.get(ref.get("idref"))
            if item is not None:
                href = self.path(item.get("href") or "")
                try:
                    raw = self.zip.read(href)
                except KeyError:
                    continue
                nodes = documents.text_nodes(raw.decode("utf-8", "replace"))
                yield k, href, ref.get("linear") != "no", len(raw), "".join(t for t, _, _, body in nodes if body)

    def toc(self) -> list[dict]:
        nav = next((i for i in self.items.values() if "nav" in (i.get("properties") or "").split()), None)
        try:
            if nav is not None:
                href = self.path(nav.get("href"))
                for n in _all(ET.fromstring(self.zip.read(href)), "nav"):
                    kind = next((v for k, v in n.attrib.items() if _local(k) == "type"), "")
                    if "toc" in kind.split():
                        return nav_items(next((x for x in n if _local(x.tag) == "ol"), None), posixpath.dirname(href))
            ncx = next((i for i in self.items.values() if i.get("media-type") == "application/x-dtbncx+xml"), None)
            if ncx is not None:
                href = self.path(ncx.get("href"))
                return ncx_items(next(iter(_all(ET.fromstring(self.zip.read(href)), "navMap"))), posixpath.dirname(href))
        except (KeyError, StopIteration, ET.ParseError):
            pass
        return []


def _opened(raw: bytes | None) -> Epub | None:
    try:
        return Epub(raw or b"")
    except ValueError:
        return None


def epub_sections(files: DataFrame) -> DataFrame:
    """path, section_idx, href, linear, size, text of packages (path, content); others have no row."""
    return rows.scan(files, ["path"], ["content"], lambda raw: e.spine() if (e := _opened(raw)) else (), "section_idx int, href string, linear boolean, size long, text string")


def epub_toc(files: DataFrame) -> DataFrame:
    """path, ord, parent_ord, level, label, href: the table of contents in reading order."""
    return rows.scan(files, ["path"], ["content"], lambda raw: documents.flattened(e.toc()) if (e := _opened(raw)) else (), "ord int, parent_ord int, level int, label string, href string")


def epub_metadata(files: DataFrame) -> DataFrame:
    return rows.scan(files, ["path"], ["content"], lambda raw: e.metadata() if (e := _opened(raw)) else (), "name string, value string, refinement string, refined string")


def fb2_sections(raw: bytes | None) -> Iterator[tuple[int, str, str]]:
    """(section, title, text) of the bodies' sections, outermost ones."""
    data = raw or b""
    if data[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            name = next((n for n in z.namelist() if n.endswith(".fb2")), None)
            data = z.read(name) if name else b""
    try:
        root = ET.fromstring(data)
    except ET.ParseError:
        return
    n = 0
    for body in (x for x in root if _local(x.tag) == "body"):
        for s in (x for x in body if _local(x.tag) == "section"):
            title = next((x for x in s if _local(x.tag) == "title"), None)
            yield n, _text(title), "\n".join(t for p in s.iter() if _local(p.tag) in ("p", "v", "subtitle") and (t := _text(p)))
            n += 1


def fb2_books(files: DataFrame) -> DataFrame:
    return rows.scan(files, ["path"], ["content"], fb2_sections, "section_idx int, title string, text string")


def comic_pages(raw: bytes | None) -> Iterator[tuple[int, str, int]]:
    """(page, name, size) of the images of a comic archive, in order of name."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
            images = sorted(i.filename for i in z.infolist() if re.search(r"\.(jpe?g|png|gif|bmp|webp|svg|jxl|avif)$", i.filename, re.I))
            yield from ((k, n, z.getinfo(n).file_size) for k, n in enumerate(images))
    except zipfile.BadZipFile:
        return


def comics(files: DataFrame) -> DataFrame:
    return rows.scan(files, ["path"], ["content"], comic_pages, "page_idx int, name string, size long")


def palmdoc(data: bytes) -> bytes:
    """Text under PalmDOC's byte-pair scheme: literals, runs, a space with a letter, and copies of up to ten bytes from at most 2047 back."""
    out, i = bytearray(), 0
    while i < len(data):
        c = data[i]
        i += 1
        if c == 0 or 9 <= c < 0x80:
            out.append(c)
        elif c < 9:
            out += data[i : i + c]
            i += c
        elif c >= 0xC0:
            out += bytes((0x20, c ^ 0x80))
        elif i < len(data):
            pair = c << 8 | data[i]
            i += 1
            distance = pair >> 3 & 0x7FF
            for _ in range((pair & 7) + 3):
                out.append(out[-distance] if 0 < distance <= len(out) else 0x20)
    return bytes(out)


class Huffman:
    """The phrase codes of the dictionary-compressed kind: codes of up to 32 bits, given by a table over the first byte and the code range of
    each length, stand for phrases, which may be compressed themselves."""

    def __init__(self, codes: bytes, phrases: list[bytes]) -> None:
        first, ranges = struct.unpack_from(">II", codes, 8)
        self.quick = [(v & 0x1F, bool(v & 0x80), ((v >> 8) + 1 << 32 - (v & 0x1F)) - 1 if v & 0x1F else 0) for v in struct.unpack_from(">256I", codes, first)]
        bounds = struct.unpack_from(">64I", codes, ranges)
        self.low = [0] + [bounds[2 * k] << 31 - k for k in range(32)]
        self.high = [0] + [(bounds[2 * k + 1] + 1 << 31 - k) - 1 for k in range(32)]
        self.phrases: list[tuple[bytes, bool]] = []
        for record in phrases:
            head, total, bits = struct.unpack_from(">III", record, 4)
            for k in range(min(1 << bits, total - len(self.phrases))):
                at = head + struct.unpack_from(">H", record, head + 2 * k)[0]
                size = struct.unpack_from(">H", record, at)[0]
                self.phrases.append((record[at + 2 : at + 2 + (size & 0x7FFF)], bool(size & 0x8000)))

    def __call__(self, data: bytes, depth: int = 0) -> bytes:
        if depth > 32:
            raise ValueError("phrases refer to each other")
        out, bits, left = bytearray(), int.from_bytes(data + bytes(4), "big"), 8 * len(data)
        while left > 0:
            code = bits >> left & 0xFFFFFFFF
            length, known, high = self.quick[code >> 24]
            if not known:
                while length < 32 and code < self.low[length]:
                    length += 1
                high = self.high[length]
            left -= length
            if left < 0 or not length:
                break
            phrase, plain = self.phrases[high - code >> 32 - length]
            out += phrase if plain else self(phrase, depth + 1)
        return bytes(out)


class Mobi:
    """A Mobipocket book: its title, metadata and text. Raises ValueError for what is none, or is encrypted."""

    #: Names of the extended header's records.
    NAMES = {100: "creator", 101: "publisher", 103: "description", 104: "isbn", 105: "subject", 106: "published", 108: "contributor", 109: "rights", 503: "title", 524: "language"}

    def __init__(self, data: bytes) -> None:
        if data[60:68] != b"BOOKMOBI" or len(data) < 86:
            raise ValueError("not a book")
        n = struct.unpack_from(">H", data, 76)[0]
        at = [struct.unpack_from(">I", data, 78 + 8 * k)[0] for k in range(n)] + [len(data)]
        self._take([data[s:e] for s, e in zip(at, at[1:], strict=False)])

    @classmethod
    def of(cls, records: list[bytes]) -> Mobi:
        """The book of some records of a file, the first its header."""
        book = cls.__new__(cls)
        book._take(records)
        return book

    def _take(self, records: list[bytes]) -> None:
        self.records, self.head = records, records[0]
        self.kind, _, self.length, self.count, _, locked = struct.unpack_from(">HHIHHH", self.head)
        if locked:
            raise ValueError("encrypted")
        self.size = self.number(20)
        self.encoding = "utf-8" if self.number(28) == 65001 else "cp1252"

    def number(self, at: int) -> int:
        return struct.unpack_from(">I", self.head, at)[0] if len(self.head) >= at + 4 else 0

    @property
    def title(self) -> str:
        start, size = self.number(84), self.number(88)
        return self.head[start : start + size].decode(self.encoding, "replace")

    def metadata(self) -> Iterator[tuple[str, str]]:
        """(name, value) of the extended header, the title first."""
        yield "title", self.title
        for kind, value in self.extended():
            if kind in self.NAMES and kind != 503:
                yield self.NAMES[kind], value.decode(self.encoding, "replace")

    def extended(self) -> Iterator[tuple[int, bytes]]:
        """(kind, value) of the extended header's records."""
        at = 16 + self.size
        if self.number(128) & 0x40 and self.head[at : at + 4] == b"EXTH":
            n = self.number(at + 8)
            at += 12
            for _ in range(n):
                kind, size = self.number(at), self.number(at + 4)
                if size < 8:
                    return
                yield kind, self.head[at + 8 : at + size]
                at += size

    def _body(self, k: int, extra: int) -> bytes:
        r = self.records[k]
        for _ in range(bin(extra >> 1).count("1")):  # sized entries at the end, the size in 7-bit groups read backwards
            size = shift = 0
            for b in reversed(r[-4:]):
                size |= (b & 0x7F) << shift
                shift += 7
                if b & 0x80:
                    break
            r = r[: len(r) - size]
        return r[: len(r) - (r[-1] & 3) - 1] if extra & 1 and r else r

    def text(self) -> str:
        return self.raw().decode(self.encoding, "replace")

    def raw(self) -> bytes:
        if self.kind == 1:
            unpack = bytes
        elif self.kind == 2:
            unpack = palmdoc
        elif self.kind == 17480:
            first, n = self.number(112), self.number(116)
            unpack = Huffman(self.records[first], self.records[first + 1 : first + n])
        else:
            raise ValueError("unknown compression")
        extra = struct.unpack_from(">H", self.head, 242)[0] if len(self.head) >= 244 and self.size >= 228 else 0
        whole = b"".join(unpack(self._body(k, extra)) for k in range(1, min(self.count, len(self.records) - 1) + 1))
        return whole[: self.length]


def _book(raw: bytes | None) -> Mobi | None:
    try:
        return Mobi(raw or b"")
    except (ValueError, struct.error):
        return None


def mobi_text(raw: bytes | None) -> Iterator[tuple[str, str]]:
    """(title, text) of a book; none for what is no book or can't be read."""
    if book := _book(raw):
        try:
            yield book.title, book.text()
        except (ValueError, IndexError, struct.error):
            return


def mobi_books(files: DataFrame) -> DataFrame:
    return rows.scan(files, ["path"], ["content"], mobi_text, "title string, text string")


def mobi_metadata(files: DataFrame) -> DataFrame:
    return rows.scan(files, ["path"], ["content"], lambda raw: book.metadata() if (book := _book(raw)) else (), "name string, value string")


def packed_epub(title: str, author: str, sections: list[tuple[str, str, int]]) -> bytes:
    """An EPUB of sections (title, text, level) with a table of contents of their levels."""
    esc = html.escape
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip")
        z.writestr("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        items = "".join(f'<item id="s{i}" href="s{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(len(sections)))
        spine = "".join(f'<itemref idref="s{i}"/>' for i in range(len(sections)))
        z.writestr("OEBPS/content.opf", f'<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="2.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{esc(title)}</dc:identifier><dc:title>{esc(title)}</dc:title><dc:creator>{esc(author)}</dc:creator></metadata><manifest><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>{items}</manifest><spine toc="ncx">{spine}</spine></package>')
        points = []
        for i, (_, _, depth, closes) in enumerate(documents.nested([(i, level) for i, (*_, level) in enumerate(sections)])):
            name = sections[i][0] or next((x.strip() for x in sections[i][1].split("\n") if x.strip()), f"Section {i + 1}")
            points.append(f'<navPoint id="n{i}" playOrder="{i + 1}"><navLabel><text>{esc(name)}</text></navLabel><content src="s{i}.xhtml"/>' + "</navPoint>" * closes)
        z.writestr("OEBPS/toc.ncx", f'<?xml version="1.0"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><navMap>{"".join(points)}</navMap></ncx>')
        for i, (name, text, level) in enumerate(sections):
            lines = "".join(f"<p>{esc(x)}</p>" for x in text.split("\n") if x.strip())
            z.writestr(f"OEBPS/s{i}.xhtml", f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml"><head><title>{esc(name)}</title></head><body><h{min(6, max(1, level))}>{esc(name)}</h{min(6, max(1, level))}>{lines}</body></html>')
    return out.getvalue()


def epubs(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, content: one EPUB for each book of sections (key, book_title, author, section_idx, title, content, level). One book is one list."""
    from pyspark.sql import functions as F

    lists = sections.groupBy(key).agg(F.first("book_title").alias("t"), F.first("author").alias("a"), F.array_sort(F.collect_list(F.struct("section_idx", "title", "content", "level"))).alias("s"))
    return rows.scan(lists, [key], ["t", "a", "s"], lambda t, a, s: [(packed_epub(t or "", a or "Unknown", [(x["title"] or "", x["content"] or "", x["level"]) for x in s]),)], "content binary")
