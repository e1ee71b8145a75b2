"""Places and rank tables of the public vocabularies."""

from __future__ import annotations

import base64
import json
import re
import unicodedata
from functools import lru_cache

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer


@lru_cache(None)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(None)
def byte_tokens(path: str) -> list[bytes]:
    """The token-byte table: the bytes of each id."""
    table = ranks(path)
    out = [b""] * (max(table.values(), default=-1) + 1)
    for token, rank in table.items():
        out[rank] = token
    return out


@lru_cache(None)
def description(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@lru_cache(None)
def byte_chars() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself if it is printable in Latin-1, else the next from U+0100."""
    plain = {b for r in ((0x21, 0x7F), (0xA1, 0xAD), (0xAE, 0x100)) for b in range(*r)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


def path(name: str) -> str:
    return public_tokenizers.path(name)


@lru_cache(None)
def unsettled() -> re.Pattern:
    """Finds characters about whose class (letter, number, space, other) versions of Unicode differ, or may yet.

    Libraries carry tables of different versions. What Unicode 3.2 had and has kept is the same in all; any other character,
    and all beyond the first plane, sends its text to the library whose result is asked for.
    """
    group = lambda c: {"L": "L", "N": "N", "Z": "Z"}.get(c[0], "-")
    old = unicodedata.ucd_3_2_0.category
    odd = [c for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and (old(chr(c)) == "Cn" or group(old(chr(c))) != group(unicodedata.category(chr(c))))]
    return re.compile(f"[{spans(odd)}\\U00010000-\\U0010ffff]")


def spans(points: list[int]) -> str:
    """Ascending code points as the inside of a character class."""
    out: list[list[int]] = []
    for c in points:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@lru_cache(None)
def explicit(pattern: str) -> re.Pattern:
    r"""A split pattern with \p{L}, \p{N}, \s and \S spelled out by the rank library's own tables, for `re`."""
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    single = {bytes([b]): b for b in range(256)}

    def members(name: str) -> str:
        got = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        return spans(sorted(map(ord, bytes(got).decode())))

    inside = {r"\p{L}": members(r"\p{L}"), r"\p{N}": members(r"\p{N}"), r"\s": members(r"\s")}
    out, open_, k = [], False, 0
    while k < len(pattern):
        name = next((n for n in (*inside, r"\S") if pattern.startswith(n, k)), None)
        if name == r"\S":
            out.append(f"[^{inside[chr(92) + 's']}]")
        elif name:
            out.append(inside[name] if open_ else f"[{inside[name]}]")
        else:
            name = pattern[k : k + 2] if pattern[k] == "\\" else pattern[k]
            open_ = name == "[" or open_ and name != "]"
            out.append(name)
        k += len(name)
    return re.compile("".join(out))


@lru_cache(None)
def library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)
