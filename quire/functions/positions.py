"""Positions in books (fragment identifiers): reading them, ordering by them, ranges.

An identifier is epubcfi(path) or epubcfi(parent,start,end); a path is steps /n with an optional [id], joined over documents by !, and may
end in an offset :n. A circumflex escapes the next character. Order is by the steps of each document in turn and then by the offset.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, LongType

from quire.functions.dates import Name, col

_STEP = re.compile(r"/(\d+)((?:\[(?:\^.|[^\]^])*\])*)(?::(\d+)((?:\[(?:\^.|[^\]^])*\])*))?(?:~([\d.]+))?(?:@([\d.]+(?::[\d.]+)?))?")


@dataclass(frozen=True)
class Step:
    index: int
    id: str = ""
    offset: int | None = None
    text: str = ""


Path = tuple[tuple[Step, ...], ...]


def _cut(text: str, mark: str) -> list[str]:
    """text at each mark that is neither escaped nor in brackets."""
    out, inside, k = [""], 0, 0
    while k < len(text):
        c = text[k]
        if c == "^" and k + 1 < len(text):
            out[-1] += text[k : k + 2]
            k += 2
            continue
        inside += (c == "[") - (c == "]" and inside > 0)
        if c == mark and not inside:
            out.append("")
        else:
            out[-1] += c
        k += 1
    return out


def _bare(bracket: str) -> str:
    return re.sub(r"\^(.)", r"\1", bracket[1:-1].split(";")[0]) if bracket else ""


def _path(text: str) -> Path:
    parts = []
    for part in _cut(text, "!"):
        steps, at = [], 0
        for m in _STEP.finditer(part):
            if m.start() != at:
                raise ValueError(f"cannot read {text!r}")
            steps.append(Step(int(m[1]), _bare(m[2]), int(m[3]) if m[3] else None, _bare(m[4] or "")))
            at = m.end()
        if at < len(part) and part[at:] != "" and re.fullmatch(r":\d+", part[at:]):
            steps.append(Step(0, offset=int(part[at + 1 :])))  # an offset alone belongs to the step before the comma
        elif at < len(part):
            raise ValueError(f"cannot read {text!r}")
        parts.append(tuple(steps))
    return tuple(parts)


def _joined(parent: Path, rest: Path) -> Path:
    """A path that goes on from another: documents after the last, steps within it."""
    last, first = parent[-1], rest[0]
    if first and first[0].index == 0 and last:
        last, first = (*last[:-1], replace(last[-1], offset=first[0].offset)), first[1:]
    return (*parent[:-1], last + first, *rest[1:])


def parse(cfi: str) -> tuple[Path, Path]:
    """Start and end, the same for a point. Raises ValueError for what is no identifier."""
    m = re.fullmatch(r"\s*epubcfi\((.*)\)\s*", cfi, re.S)
    parts = _cut(m[1] if m else cfi.strip(), ",")
    if len(parts) == 1:
        p = _path(parts[0])
        return p, p
    if len(parts) != 3:
        raise ValueError(f"cannot read {cfi!r}")
    parent, start, end = map(_path, parts)
    return _joined(parent, start), _joined(parent, end)


def written(path: Path) -> str:
    esc = lambda x: re.sub(r"([\^\[\](),;=])", r"^\1", x)
    step = lambda s: f"/{s.index}" + (f"[{esc(s.id)}]" if s.id else "") + (f":{s.offset}" if s.offset is not None else "") + (f"[{esc(s.text)}]" if s.text else "")
    return "!".join("".join(map(step, part)) for part in path)


def collapsed(cfi: str, to_end: bool = False) -> str:
    return f"epubcfi({written(parse(cfi)[1 if to_end else 0])})"


def ranged(start: str, end: str) -> str:
    """The range between two points of one document, its shared steps written once."""
    a, b = parse(start)[0], parse(end)[1]
    x, y = a[-1], b[-1]
    n = 0
    while n < min(len(x), len(y)) and x[n].index == y[n].index and not x[n].offset and not y[n].offset:
        n += 1
    return f"epubcfi({written((*a[:-1], x[:n]))},{written((x[n:],))},{written((y[n:],))})"


def sort_key(path: Path) -> list[int]:
    """Numbers whose order is the paths' order: a path's end comes before any further step."""
    out: list[int] = []
    for part in path:
        for k, s in enumerate(part):
            out += [1, s.index]
            if k == len(part) - 1:
                out += [0, 1 + s.offset if s.offset is not None else 0]
        if not part:
            out.append(0)
    return out


def compare(a: str, b: str) -> int:
    """-1, 0 or 1: by the starts, then by the ends."""
    x, y = ([sort_key(p) for p in parse(c)] for c in (a, b))
    return (x > y) - (x < y)


@F.pandas_udf(ArrayType(LongType()))
def _key(cfi: pd.Series) -> pd.Series:
    def one(c: str | None) -> list[int] | None:
        try:
            start, end = parse(c) if c else ((), ())
        except ValueError:
            return None
        return [*sort_key(start), -1, *sort_key(end)] if c else None

    return cfi.map(one, na_action="ignore")


_PLAIN = r"^epubcfi\((?:/\d{1,15})+(?::\d{1,15})?(?:!(?:/\d{1,15})+(?::\d{1,15})?)*\)$"


def order_key(c: Name) -> Column:
    """An array to order identifiers by; null where there is none to read. Points without brackets, which is nearly all, are taken apart in the JVM; Python sees the others alone."""
    c = col(c)
    plain = F.coalesce(c.rlike(_PLAIN), F.lit(False))

    def steps(part: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(part, F.lit(r"/(\d+)"), F.lit(1)), lambda d: F.array(F.lit(1).cast("long"), d.cast("long")))
        offset = F.coalesce(F.regexp_extract(part, r":(\d+)", 1).try_cast("long") + 1, F.lit(0).cast("long"))
        return F.concat(F.flatten(numbers), F.array(F.lit(0).cast("long"), offset))

    path = F.flatten(F.transform(F.split(F.substring(F.when(plain, c), 9, 2**31 - 1), "!"), steps))
    return F.when(plain, F.concat(path, F.array(F.lit(-1).cast("long")), path)).otherwise(_key(F.when(~plain, c)))


def rough_key(c: Name) -> Column:
    """A key of JVM functions for the notes' comparison: numbers of the components, an offset in place of a component that has one.

    The comparison it stands for looks at the first component that differs, as text, and is no order where
    bracketed ids occur; there this key reads the number before the bracket.
    """
    body = F.regexp_replace(col(c), r"epubcfi\(/|\)|,", "")
    parts = F.filter(F.split(body, "/"), lambda p: p != "")
    return F.transform(parts, lambda p: F.coalesce(F.when(p.contains(":"), F.regexp_extract(p, r":(\d+)", 1)).otherwise(F.regexp_extract(p, r"^(\d+)", 1)).try_cast("long"), F.lit(0).cast("long")))
