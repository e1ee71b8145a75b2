"""Sections and contents of KF8 (AZW3) books, and of older Mobipocket ones.

A KF8 text is skeletons, each followed by its fragments; a section is a skeleton with its fragments put in at their places. Skeletons, fragments
and the table of contents are index records: entries with a name and numbered tags of variable-length numbers, and records of strings
beside them. A file may hold an older book first and the KF8 one after a boundary. Older books have one text, with page breaks between sections.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from quire.operators import rows
from quire.sources.books import Mobi

# Places in a KF8 header, and what tags mean in its indexes.
_VERSION, _NCX, _FRAGMENTS, _SKELETONS = 36, 244, 248, 252
_NONE = 0xFFFFFFFF
_BOUNDARY = 121
_BREAK = re.compile(r"<\s*(?:mbp:)?pagebreak[^>]*>", re.I)
_MARKUP = re.compile(r"<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)


def forward(data: bytes, at: int) -> tuple[int, int]:
    """A number in 7-bit groups, the last marked by its high bit, and where it ends. Four groups at most."""
    value = 0
    for k in range(at, min(at + 4, len(data))):
        value = value << 7 | data[k] & 0x7F
        if data[k] & 0x80:
            return value, k + 1
    return value, min(at + 4, len(data))


@dataclass(frozen=True)
class Tag:
    """One line of an index's tag table: how many numbers a value is, and which bits of its control byte say how many values there are."""

    number: int
    width: int
    mask: int
    byte: int

    @property
    def low(self) -> int:
        return (self.mask & -self.mask).bit_length() - 1


def _tags(head: bytes) -> tuple[list[Tag], int]:
    at = struct.unpack_from(">I", head, 4)[0]
    if head[at : at + 4] != b"TAGX":
        raise ValueError("no tag table")
    size, control = struct.unpack_from(">II", head, at + 4)
    out, byte = [], 0
    for k in range(at + 12, at + size, 4):
        number, width, mask, end = head[k : k + 4]
        if end & 1:
            byte += 1
        else:
            out.append(Tag(number, width, mask, byte))
    return out, control


def _entry(record: bytes, at: int, tags: list[Tag], control: int) -> tuple[str, dict[int, list[int]]]:
    size = record[at]
    name, flags = record[at + 1 : at + 1 + size].decode("utf-8", "replace"), at + 1 + size
    pos, plan = flags + control, []
    for t in tags:
        found = record[flags + t.byte] & t.mask
        if not found:
            continue
        if found == t.mask and t.mask.bit_count() > 1:  # too many to count in the bits: their bytes are counted instead
            room, pos = forward(record, pos)
            plan.append((t, None, room))
        else:
            plan.append((t, found >> t.low, 0))
    values: dict[int, list[int]] = {}
    for t, count, room in plan:
        held, end = [], pos + room
        while pos < end if count is None else len(held) < count * t.width:
            x, pos = forward(record, pos)
            held.append(x)
        values[t.number] = held
    return name, values


def index(records: list[bytes], first: int) -> tuple[list[tuple[str, dict[int, list[int]]]], dict[int, str]]:
    """Entries (name, values by tag) of the index that starts at a record, and its strings by offset."""
    head = records[first]
    if head[:4] != b"INDX":
        raise ValueError("no index")
    parts, strings = struct.unpack_from(">I", head, 24)[0], struct.unpack_from(">I", head, 52)[0]
    tags, control = _tags(head)
    entries = []
    for record in records[first + 1 : first + 1 + parts]:
        table, n = struct.unpack_from(">II", record, 20)
        entries += [_entry(record, struct.unpack_from(">H", record, table + 4 + 2 * k)[0], tags, control) for k in range(n)]
    named: dict[int, str] = {}
    for k, record in enumerate(records[first + 1 + parts : first + 1 + parts + strings]):
        at = 0
        while at < len(record):
            size, start = forward(record, at)
            named[(k << 16) + at] = record[start : start + size].decode("utf-8", "replace")
            at = start + size
    return entries, named


class Book:
    """The sections of a book, and its table of contents. Raises ValueError for what is none."""

    def __init__(self, data: bytes) -> None:
        old = Mobi(data)
        boundary = next((struct.unpack(">I", v)[0] for k, v in old.extended() if k == _BOUNDARY and len(v) == 4), _NONE)
        self.mobi = Mobi.of(old.records[boundary:]) if 0 < boundary < len(old.records) else old
        self.kf8 = self.mobi.number(_VERSION) >= 8 and self.mobi.number(_SKELETONS) not in (0, _NONE)
        self.starts: list[int] = []  # the first fragment of each section

    def sections(self) -> list[str]:
        if not self.kf8:
            return _BREAK.split(self.mobi.text())
        raw = self.mobi.raw()
        skeletons, _ = index(self.mobi.records, self.mobi.number(_SKELETONS))
        fragments = index(self.mobi.records, self.mobi.number(_FRAGMENTS))[0] if self.mobi.number(_FRAGMENTS) not in (0, _NONE) else []
        out, k = [], 0
        for _, values in skeletons:
            offset, size = values[6][:2]
            at, whole = offset + size, bytearray(raw[offset : offset + size])
            self.starts.append(k)
            for name, own in fragments[k : k + values[1][0]]:
                place, length = int(name) - offset, own[6][1]
                whole[place:place] = raw[at : at + length]
                at += length
            k += values[1][0]
            out.append(whole.decode(self.mobi.encoding, "replace"))
        return out

    def contents(self) -> Iterator[tuple[int, int | None, int, str, int | None]]:
        """(ord, parent, level, label, section) of the table of contents; a book without one has none."""
        if not self.kf8 or self.mobi.number(_NCX) in (0, _NONE):
            return
        if not self.starts:
            self.sections()
        entries, named = index(self.mobi.records, self.mobi.number(_NCX))
        for k, (_, v) in enumerate(entries):
            label = named.get(v[3][0], "") if v.get(3) else ""
            section = sum(s <= v[6][0] for s in self.starts) - 1 if v.get(6) else None
            yield k, v[21][0] if v.get(21) else None, v[4][0] if v.get(4) else 0, label, section


def _opened(raw: bytes | None) -> Book | None:
    try:
        return Book(raw or b"")
    except (ValueError, struct.error):
        return None


_BROKEN = (ValueError, IndexError, KeyError, struct.error)


def section_rows(raw: bytes | None) -> Iterator[tuple[int, str, str]]:
    """(section_idx, markup, text) of a book; none for what can't be read."""
    if book := _opened(raw):
        try:
            found = book.sections()
        except _BROKEN:
            return
        for k, markup in enumerate(found):
            yield k, markup, " ".join(_MARKUP.sub(" ", markup).split())


def toc_rows(raw: bytes | None) -> list[tuple]:
    if book := _opened(raw):
        try:
            return list(book.contents())
        except _BROKEN:
            return []
    return []


def sections(files: DataFrame) -> DataFrame:
    """path, section_idx, markup, text of books (path, content)."""
    return rows.scan(files, ["path"], ["content"], section_rows, "section_idx int, markup string, text string")


def toc(files: DataFrame) -> DataFrame:
    """path, ord, parent_ord, level, label, section_idx of books (path, content)."""
    return rows.scan(files, ["path"], ["content"], toc_rows, "ord int, parent_ord int, level int, label string, section_idx int")
