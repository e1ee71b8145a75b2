"""Files as rows: texts of unknown encoding, formats told by their first bytes, listings, JSON stores, feeds, dictionaries."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.functions import strings
from quire.functions.dates import Name, col
from quire.operators import documents, rows


#: The setting by which a session asks for scans of texts to be dealt out over so many partitions.
DEALT = "spark.quire.scanPartitions"


def dealt(table: DataFrame) -> DataFrame:
    """The table as it is read, or over the partitions that the session's setting asks for: on one machine, a file of a single row group is else one core's."""
    n = int(table.sparkSession.conf.get(DEALT, "0"))
    return table.repartition(n) if n else table


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder's URI in the folder that all executors share, as the session names it; in a local session without one, of this machine."""
    import tempfile
    import uuid

    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return f"{(where or 'file://' + tempfile.gettempdir()).rstrip('/')}/quire-{tag}-{uuid.uuid4().hex}"


def binary(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """path, modificationTime, length, content of files."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    return reader.option("recursiveFileLookup", str(recursive).lower()).load(path)


def listing(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, name, length, modified of the files below a folder; contents aren't read."""
    found = binary(spark, path, recursive=recursive).select("path", strings.file_name("path").alias("name"), "length", F.col("modificationTime").alias("modified"))
    return found


def directory_sizes(files: DataFrame, depth: int) -> DataFrame:
    """Bytes and files by the folder at a depth of the path."""
    folder = F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.lit(depth)), "/")
    return files.groupBy(folder.alias("folder")).agg(F.sum("length").cast("long").alias("bytes"), F.count("*").alias("files"))


def decoded(raw: bytes) -> tuple[str | None, str | None]:
    """(encoding, text): the first of UTF-8, GBK, Latin-1, UTF-16 and UTF-32 whose first 500 characters have at most 20 that a wrong decoding gives."""
    for name in ("utf-8", "gbk", "latin-1", "utf-16", "utf-32"):
        try:
            text = raw.decode(name)
        except (UnicodeDecodeError, UnicodeError):
            continue
        if documents.garbled_ratio(text) <= 20 / 500:
            return name, text
    return None, None


def texts(files: DataFrame) -> DataFrame:
    """path, encoding, text of files (path, content), line ends made one kind; null where no encoding fits."""

    def one(raw: bytes | None) -> list[tuple]:
        name, text = decoded(raw or b"")
        return [(name, None if text is None else text.replace("\r\n", "\n").replace("\r", "\n"))]

    return rows.scan(files, ["path"], ["content"], one, "encoding string, text string")


def book_sections(files: DataFrame, rule: documents.Rule | None = None) -> DataFrame:
    """path, title, author, section_idx, section title and content of text books."""
    name = F.regexp_replace(strings.file_name("path"), r"\.[^.]*$", "")
    named = texts(files).withColumn("name", name)
    split = documents.split_chapters(named.select("path", "text", "name"), "path", "text", "name", rule)
    meta = named.select("path", strings.title_of_file("name").alias("book_title"), strings.author_of_file("name").alias("author"))
    return split.join(meta, "path")


def sniffed(content: Name, path: Name) -> Column:
    """A file's kind by its first bytes, and by its name where those are shared: pdf, mobi, cbz, fbz, epub, fb2 or null."""
    c, p = col(content), F.lower(col(path))
    head = F.hex(F.substring(c, 1, 5))
    zipped = head.startswith("504B0304")
    return (
        F.when(head == "255044462D", "pdf").when(zipped & p.endswith(".cbz"), "cbz").when(zipped & (p.endswith(".fbz") | p.endswith(".fb2.zip")), "fbz").when(zipped, "epub")
        .when(F.hex(F.substring(c, 61, 8)) == F.hex(F.lit("BOOKMOBI")), "mobi").when(p.endswith(".fb2"), "fb2")
    )


def json_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON stores, each one array of records of a fixed schema; a store that can't be read is an empty one."""
    text = spark.read.option("wholetext", "true").text(path)
    return text.select(F.inline(F.from_json("value", f"array<struct<{schema}>>")))


def keyed_store(spark: SparkSession, path: str, value: str) -> DataFrame:
    """key, value of a JSON object whose members are records of one schema."""
    text = spark.read.option("wholetext", "true").text(path)
    return text.select(F.explode(F.from_json("value", f"map<string, {value}>")).alias("key", "value"))


# --- feeds ------------------------------------------------------------------


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _child(e: ET.Element, *names: str) -> str | None:
    for n in names:
        for x in e:
            if _local(x) == n:
                return "".join(x.itertext()).strip()
    return None


def feed_entries(xml: str | None) -> Iterator[tuple]:
    """(ord, kind, title, author, href, type, group, group title, facet) of a catalogue feed: publications (something to get), navigation, facets."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return
    n = 0
    for link in (x for x in root if _local(x) == "link"):
        if (link.get("rel") or "") == "http://opds-spec.org/facet":
            facet = next((v for k, v in link.attrib.items() if k.endswith("facetGroup")), None)
            yield n, "facet", link.get("title"), None, link.get("href"), link.get("type"), None, None, facet
            n += 1
    for entry in (x for x in root if _local(x) == "entry"):
        links = [x for x in entry if _local(x) == "link"]
        rels = [(x.get("rel") or "") for x in links]
        publication = any(r.startswith("http://opds-spec.org/acquisition") or r == "preview" for r in rels)
        group = next((x for x in links if x.get("rel") in ("http://opds-spec.org/group", "collection")), None)
        if publication:
            main = next(x for x in links if (x.get("rel") or "").startswith("http://opds-spec.org/acquisition") or x.get("rel") == "preview")
        else:
            main = next((x for x in links if "profile=opds-catalog" in (x.get("type") or "").replace(" ", "")), links[0] if links else None)
        author = next((_child(x, "name") for x in entry if _local(x) == "author"), None)
        yield (n, "publication" if publication else "navigation", _child(entry, "title") or "", author, None if main is None else main.get("href"), None if main is None else main.get("type"),
               None if group is None else group.get("href"), None if group is None else group.get("title"), None)
        n += 1


def feeds(xml: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    return rows.scan(xml, [key], [text], feed_entries, "ord int, kind string, title string, author string, href string, type string, group_href string, group_title string, facet string")


# --- dictionaries -----------------------------------------------------------


def base64_number(text: str) -> int:
    """A number in the digits A-Z a-z 0-9 + /, highest first."""
    n = 0
    for c in text:
        n = n * 64 + "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/".index(c)
    return n


def dictd_index(lines: DataFrame) -> DataFrame:
    """word, offset, size of a dictionary's index lines (column value): word, tab, offset, tab, size."""

    def one(line: str | None) -> Iterator[tuple]:
        parts = (line or "").split("\t")
        if len(parts) >= 3 and re.fullmatch(r"[A-Za-z0-9+/]+", parts[1] + parts[2]):
            yield parts[0], base64_number(parts[1]), base64_number(parts[2])

    return rows.scan(lines, [], ["value"], one, "word string, offset long, size long")


def stardict_entries(files: DataFrame) -> DataFrame:
    """path, word, offset, size of binary indexes (path, content): a word ended by a zero byte, then two 32-bit numbers."""

    def one(raw: bytes | None) -> Iterator[tuple]:
        raw, at = raw or b"", 0
        while (end := raw.find(b"\0", at)) >= 0 and end + 9 <= len(raw):
            yield raw[at:end].decode("utf-8", "replace"), int.from_bytes(raw[end + 1 : end + 5], "big"), int.from_bytes(raw[end + 5 : end + 9], "big")
            at = end + 9

    return rows.scan(files, ["path"], ["content"], one, "word string, offset long, size long")


def look_up(index: DataFrame, words: DataFrame) -> DataFrame:
    """Every entry of each word asked for (column word), whatever its case: an equi-join instead of a search in a sorted index."""
    return words.select(F.col("word").alias("asked"), F.lower("word").alias("_k")).join(index.withColumn("_k", F.lower("word")), "_k").drop("_k")
