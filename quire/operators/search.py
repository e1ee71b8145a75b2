"""Full-text search in documents, with excerpts."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import regex
from pyspark.sql import DataFrame, Window, functions as F

from quire.functions import strings
from quire.operators import rows, sorts

CONTEXT = 50


def sensitivity(match_case: bool = False, match_diacritics: bool = False) -> str:
    """base: neither case nor accents matter; accent: accents do; case: case does; variant: both do."""
    return ("variant" if match_case else "accent") if match_diacritics else ("case" if match_case else "base")


def simple(text: str, query: str, kind: str) -> Iterator[tuple[int, int]]:
    """Ranges of the query, overlapping ones too; case matters for variant alone."""
    if not query:
        return
    hay, needle = (text, query) if kind == "variant" else (_same_length_lower(text), query.lower())
    at = hay.find(needle)
    while at >= 0:
        yield at, at + len(needle)
        at = hay.find(needle, at + 1)


def _same_length_lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@lru_cache(1)
def _marks() -> re.Pattern:
    """Runs of combining marks."""
    found = [c for c in range(0x300, sys.maxunicode + 1) if unicodedata.combining(chr(c))]
    return re.compile("[" + "".join(map(chr, found)) + "]+")


@lru_cache(65536)
def _key(text: str, kind: str) -> str:
    """What of a text counts: without accents for base and case, without case for base and accent."""
    x = text if text.isascii() else unicodedata.normalize("NFD", text)
    if kind in ("base", "case") and not x.isascii():
        x = _marks().sub("", x)
    return x.casefold() if kind in ("base", "accent") else x


def _plain(text: str, kind: str) -> str:
    """The whole text as `_segments` reads it, segments joined: a range can only be where the query's is a part of this."""
    x = _key.__wrapped__(text, kind)
    return " ".join((x if x.isascii() else _FORMAT.sub("", x)).split())


_GRAPHEME, _WORD, _FORMAT = regex.compile(r"\X"), regex.compile(r"(?w)\b.+?\b|\X", regex.S), regex.compile(r"\p{Format}+")


def _segments(text: str, whole_words: bool, kind: str) -> list[tuple[str, int, int]]:
    """(key, start, end) of graphemes or words; white space is one space, format characters are nothing."""
    out: list[tuple[str, int, int]] = []
    for m in (_WORD if whole_words else _GRAPHEME).finditer(text):
        s = m[0]
        if _FORMAT.fullmatch(s):
            continue
        if s.isspace():
            if not out or out[-1][0] != " ":
                out.append((" ", m.start(), m.end()))
            continue
        out.append((_key(s, kind), m.start(), m.end()))
    return out


def collated(text: str, query: str, kind: str, whole_words: bool) -> Iterator[tuple[int, int]]:
    """Ranges whose segments, grapheme by grapheme or word by word, are the query's under the sensitivity."""
    wanted = [k for k, *_ in _segments(query, whole_words, kind)]
    if not wanted:
        return
    if _plain(query, kind) not in _plain(text, kind):
        return
    found = _segments(text, whole_words, kind)
    n, first = len(wanted), wanted[0]
    for i, (k, start, _) in enumerate(found[: len(found) - n + 1]):
        if k == first and [x[0] for x in found[i : i + n]] == wanted:
            yield start, found[i + n - 1][2]


def ranges(text: str, query: str, match_case: bool = False, match_diacritics: bool = False, whole_words: bool = False) -> Iterator[tuple[int, int]]:
    """Where the query is. Accents that matter, without whole words, need no segments."""
    kind = sensitivity(match_case, match_diacritics)
    return simple(text, query, kind) if not whole_words and kind in ("variant", "accent") else collated(text, query, kind, whole_words)


def _edge(text: str, at: int, back: bool) -> str:
    """The collapsed text before a place, or after it: all of it, or at least as much as the context takes. Looks no farther than needed."""
    reach = 4 * CONTEXT
    while True:
        part = text[max(0, at - reach) : at] if back else text[at : at + reach]
        joined = " ".join(part.split())
        if len(joined) >= CONTEXT or len(part) < reach:
            return joined
        reach *= 4


def excerpt(text: str, start: int, end: int) -> tuple[str, str, str]:
    """What is before the range, the range, and what is after it: white space collapsed, cut to the context's length with an ellipsis."""
    before, after = _edge(text, start, True), _edge(text, end, False)
    before += " " if before and text[start - 1].isspace() else ""
    after = (" " if after and text[end].isspace() else "") + after
    pre = ("…" if len(before) >= CONTEXT else "") + before[-CONTEXT:]
    post = after[:CONTEXT] + ("…" if len(after) >= CONTEXT else "")
    return pre, text[start:end], post


def hits(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text", **options: bool) -> DataFrame:
    """key, hit_idx, start, end, pre, match, post of every place where the query is."""

    def one(t: str | None) -> Iterator[tuple]:
        for i, (s, e) in enumerate(ranges(t or "", query, **options)):
            yield (i, s, e, *excerpt(t, s, e))

    return rows.scan(docs, [key], [text], one, "hit_idx int, start int, end int, pre string, match string, post string")


def progressed(found: DataFrame, total: DataFrame, key: str = "doc_id") -> DataFrame:
    """What a search reports while it goes through the sections of a document (key, section_idx): after each, the share that is read, the hits so far, and whether it is done."""
    w = Window.partitionBy(key).orderBy("section_idx")
    n = found.groupBy(key, "section_idx").agg(F.count("*").alias("n"))
    read = total.join(n, [key, "section_idx"], "left").withColumn("hits", F.sum(F.coalesce("n", F.lit(0))).over(w).cast("long"))
    last = F.max("section_idx").over(Window.partitionBy(key))
    return read.select(key, "section_idx", "hits", ((F.col("section_idx") + 1) / (last + 1)).alias("progress"), (F.col("section_idx") == last).alias("done"))


def by_section(found: DataFrame, total: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each section (section_idx) with its hits in order and the share of sections read up to it; sections without hits are left out."""
    n = total.groupBy(key).agg(F.max("section_idx").alias("last"))
    grouped = found.groupBy(key, "section_idx").agg(F.array_sort(F.collect_list(F.struct("hit_idx", "pre", "match", "post"))).alias("hits"))
    return grouped.join(n, key).withColumn("progress", (F.col("section_idx") + 1) / (F.col("last") + 1)).drop("last")


def capped(found: DataFrame, results: int | None = None, snippets: int | None = None, characters: int | None = None, key: str = "doc_id") -> DataFrame:
    """The first sections of each document that have hits, and the first hits of each: the caps are the feature."""
    most, each, cut = sorts.clamp("results", results), sorts.clamp("snippets", snippets), None if characters is None else sorts.clamp("characters", characters)
    w = Window.partitionBy(key).orderBy("section_idx")
    some = found.withColumn("_s", F.dense_rank().over(w)).where(F.col("_s") <= most).withColumn("_h", F.row_number().over(Window.partitionBy(key, "section_idx").orderBy("hit_idx"))).where(F.col("_h") <= each)
    snippet = strings.collapsed(F.concat("pre", "match", "post"))
    return some.withColumn("snippet", snippet if cut is None else F.substring(snippet, 1, cut)).drop("_s", "_h")
