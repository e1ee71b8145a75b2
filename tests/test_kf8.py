"""KF8 books, packed by hand, and older ones with page breaks."""

import struct

from quire.sources import kf8

from .test_operators import mobi


def number(x):
    out = [x & 0x7F | 0x80]
    while x := x >> 7:
        out.insert(0, x & 0x7F)
    return bytes(out)


def index(tags, entries, strings=b""):
    """Records of an index. tags: (tag, width, mask); entries: (name, control byte, numbers)."""
    tagx = b"TAGX" + struct.pack(">II", 12 + 4 * (len(tags) + 1), 1) + b"".join(bytes([*t, 0]) for t in tags) + bytes([0, 0, 0, 1])
    head = (b"INDX" + struct.pack(">IIII", 192, 0, 0, 0) + struct.pack(">III", 0, 1, 65001)).ljust(52, b"\0") + struct.pack(">I", 1 if strings else 0)
    head = head.ljust(192, b"\0") + tagx
    body, places = b"", []
    for name, control, numbers in entries:
        places.append(192 + len(body))
        body += bytes([len(name)]) + name.encode() + bytes([control]) + b"".join(map(number, numbers))
    record = (b"INDX" + struct.pack(">IIII", 192, 1, 0, 0) + struct.pack(">II", 192 + len(body), len(entries))).ljust(192, b"\0") + body + b"IDXT" + b"".join(struct.pack(">H", p) for p in places)
    return [head, record, *([strings] if strings else [])]


def kf8_book():
    skeletons, fragments = [b"<html><body></body></html>", "<html><body>ä</body></html>".encode()], [[b"<p>one</p>", b"<p>two</p>"], [b"<p>three</p>"]]
    raw, skel, frag = b"", [], []
    for s, own in zip(skeletons, fragments, strict=True):
        skel.append(("SKEL", 3, [len(own), len(raw), len(s)]))
        place = len(raw) + s.index(b"</body>")
        for k, f in enumerate(own):
            frag.append((f"{place:010d}", 3, [0, len(frag), 0, len(f)][1:]))
            place += len(f)
        raw += s + b"".join(own)
    one = index([(1, 1, 1), (6, 2, 2)], skel)
    two = index([(4, 1, 1), (6, 2, 2)], frag)
    names = number(5) + b"First" + number(6) + b"Second" + number(5) + b"Third"
    ncx = index([(3, 1, 1), (4, 1, 2), (6, 2, 4), (21, 1, 8)], [("0", 7, [0, 0, 0, 0]), ("1", 15, [6, 1, 1, 0, 0]), ("2", 7, [13, 0, 2, 0])], names)
    records = [raw, *one, *two, *ncx]
    head = bytearray(16 + 264)
    struct.pack_into(">HHIHHHH", head, 0, 1, 0, len(raw), 1, 4096, 0, 0)
    head[16:20] = b"MOBI"
    for field, x in ((20, 264), (24, 2), (28, 65001), (36, 8), (84, len(head)), (88, 1), (252, 2), (248, 4), (244, 6)):
        struct.pack_into(">I", head, field, x)
    return packed([bytes(head) + b"T", *records])


def packed(records):
    at, table = 78 + 8 * len(records), b""
    for r in records:
        table += struct.pack(">II", at, 0)
        at += len(r)
    return bytes(60) + b"BOOKMOBI" + bytes(8) + struct.pack(">H", len(records)) + table + b"".join(records)


def test_sections_and_contents():
    data = kf8_book()
    assert [(k, m) for k, m, _ in kf8.section_rows(data)] == [(0, "<html><body><p>one</p><p>two</p></body></html>"), (1, "<html><body>ä<p>three</p></body></html>")]
    assert [t for *_, t in kf8.section_rows(data)] == ["one two", "ä three"]
    assert kf8.toc_rows(data) == [(0, None, 0, "First", 0), (1, 0, 1, "Second", 0), (2, None, 0, "Third", 1)]


def test_older_books_break_at_pages():
    data = mobi(1, [b"<p>one</p><mbp:pagebreak/><p>two</p>"])
    at = struct.unpack_from(">I", data, 78)[0]
    data = data[: at + 4] + struct.pack(">I", 36) + data[at + 8 :]
    assert [t for *_, t in kf8.section_rows(data)] == ["one", "two"] and kf8.toc_rows(data) == []


def test_what_is_no_book():
    whole = kf8_book()
    for data in (None, b"", b"junk", whole[:400], whole[:-60]):
        assert isinstance(list(kf8.section_rows(data)), list) and isinstance(kf8.toc_rows(data), list)


def test_numbers():
    for x in (0, 1, 127, 128, 16383, 16384, 2**21, 2**28 - 1):
        assert kf8.forward(b"\0" + number(x), 1) == (x, 1 + len(number(x)))


def test_many_values_are_counted_by_bytes():
    """A count that doesn't fit its bits is written as the bytes that the numbers take."""
    tags, control = kf8._tags(index([(1, 1, 3)], [])[0])
    values = [5, 300, 7, 1]
    raw = b"".join(map(number, values))
    assert kf8._entry(bytes([1]) + b"x" + bytes([3]) + number(len(raw)) + raw, 0, tags, control) == ("x", {1: values})
    assert kf8._entry(bytes([1]) + b"x" + bytes([2]) + raw[:3], 0, tags, control) == ("x", {1: [5, 300]})


def test_rows(spark):
    files = spark.createDataFrame([("a", kf8_book()), ("b", b"junk"), ("c", None)], "path string, content binary")
    assert sorted((r["path"], r["section_idx"], r["text"]) for r in kf8.sections(files).collect()) == [("a", 0, "one two"), ("a", 1, "ä three")]
    assert sorted((r["ord"], r["label"], r["section_idx"]) for r in kf8.toc(files).collect()) == [(0, "First", 0), (1, "Second", 0), (2, "Third", 1)]
