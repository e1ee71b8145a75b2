"""Near-duplicate classes by weighted minwise hashing with darts.

Elements are five-word shingles, their weights the times they occur, and similarity is weighted
Jaccard: the sum of the smaller weights over the sum of the larger. Each element owns a strip of the plane
as wide as its weight; hashed darts fall on it as a Poisson process, each with a rank and a coordinate,
and a signature keeps the earliest dart of each coordinate. Signatures are cut into bands; texts that
share a band are candidates, and candidates are compared exactly.

1. Equal word sequences become one content, so copies cost one signature and no pair.
2. Each member of a bucket is compared with the bucket's least content, never with all others.
3. Where a bucket's members are not in one class by then, those outside its largest class meet all others block by block
   within a task: pairs estimated within four standard errors of the threshold (or all, if `Setup.errors` is None) are compared exactly, each in
   the first band that it shares, until their classes are joined. Only the links that join classes leave the
   task, so no link between texts is lost and what is shuffled grows with the members, not with their pairs.
4. Classes are the connected components of the links.

Defined cases: a null text is an empty one, and all texts without words are copies of each other; with
one to four words the whole text is the one shingle; repeated rows are copies; a null key stays null
and never names a class while another key is there; classes are told apart by content, never by key; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm import common

U = np.uint64


@dataclass(frozen=True)
class Setup:
    words: int = 5
    threshold: float = 0.8
    #: At a similarity of 0.8 some band agrees with probability 1 - (1 - 0.8^6)^24 > 0.999.
    bands: int = 24
    rows: int = 6
    #: Most members and most characters of a bucket's block, of which a task holds two.
    block: int = 2048
    block_chars: int = 4_000_000
    #: Pairs of a bucket whose signatures estimate less than the threshold by so many standard errors aren't compared; None compares all, whatever the estimate.
    errors: float | None = 4

    @property
    def size(self) -> int:
        return self.bands * self.rows

    @property
    def least_estimate(self) -> float:
        return -1.0 if self.errors is None else self.threshold - self.errors * math.sqrt(self.threshold * (1 - self.threshold) / self.size)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: xor-shifts and odd multipliers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
        x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
        return x ^ (x >> U(33))


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """Sets x size: the earliest dart (its hash) of each coordinate of each set of (distinct uint64 elements, positive weights); no set is empty.

    Darts of all sets fly at once. A dart of an element's strip depends on the element and its place in the strip alone, so equal
    parts of two sets get equal darts; how far ranks are followed differs, as each set needs so many darts that no
    coordinate stays empty.
    """
    elements, weights = np.concatenate([e for e, _ in sets]), np.concatenate([np.asarray(w, np.float64) for _, w in sets])
    owner = np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets])
    total = np.bincount(owner, weights, len(sets))
    cells, width = elements, None
    if (weights != 1).any():  # a strip is cut into cells of width 1, the last maybe narrower
        whole = np.ceil(weights).astype(np.int64)
        at = np.repeat(np.arange(len(elements)), whole)
        j = np.arange(len(at)) - np.repeat(np.cumsum(whole) - whole, whole)
        with np.errstate(over="ignore"):
            cells = elements[at] + j.astype(U) * U(0x9E3779B97F4A7C15)
        owner, width = owner[at], np.minimum(weights[at] - j, 1.0)
        width = None if (width == 1).all() else width
    cells = mix(cells)
    reach = size * (math.log(size) + 3) / total  # so many darts on average; a coordinate stays empty in one set of twenty
    out = np.empty((len(sets), size), U)
    while True:
        best, name = np.full(len(sets) * size, np.inf), np.zeros(len(sets) * size, U)
        state, rank, own, wide, k = cells, np.zeros(len(cells)), owner, width, 0
        while len(state):
            k += 1
            with np.errstate(over="ignore"):
                dart = mix(state + U(k) * U(0xD1342543DE82EF95))
            rank = rank - np.log(((dart >> U(11)).astype(np.float64) + 0.5) * 2.0**-53)
            near = np.flatnonzero(rank <= reach[own])
            state, rank, dart, own = state[near], rank[near], dart[near], own[near]
            r, d, o = rank, dart, own
            if wide is not None:
                wide = wide[near]
                hit = np.flatnonzero((mix(dart ^ U(0xA5A5A5A5A5A5A5A5)) >> U(11)).astype(np.float64) * 2.0**-53 < wide)
                r, d, o = r[hit], d[hit], o[hit]
            d = mix(d)
            at = o * size + (d % U(size)).astype(np.int64)
            np.minimum.at(best, at, r)
            first = np.flatnonzero(best[at] == r)
            name[at[first]] = d[first]
        full = np.isfinite(best.reshape(len(sets), size)).all(axis=1)  # never a set that was full before: its cells are gone
        out[full] = name.reshape(len(sets), size)[full]
        reach = np.where(full, 0.0, reach * 2)
        again = np.flatnonzero(reach[owner] > 0)
        if not len(again):
            return out
        cells, owner, width = cells[again], owner[again], None if width is None else width[again]


def signature(elements: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    return signatures([(elements, weights)], size)[0]


class _Hashes(common.Table):
    """Hashes of words; what one text has may go beyond the bound until the next."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        self.room -= self.weight(word, h)
        return h


class Shingler:
    def __init__(self, n: int) -> None:
        self.n, self.table = n, _Hashes(16 << 20)
        rng = np.random.default_rng(20240501)
        self.odd = rng.integers(0, 2**63, n, dtype=np.uint64) * U(2) + U(1)

    def __call__(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The content's address, the distinct shingles' hashes in ascending order and their counts."""
        words = text.split()
        address = hashlib.md5("\x1f".join(words).encode(), usedforsecurity=False).digest()
        table = self.table
        if table.room < 0:
            table.restart()
        w = np.fromiter(map(table.__getitem__, words), U, len(words))
        n = min(self.n, len(words))
        if not n:
            return address, np.empty(0, U), np.empty(0, np.int64)
        with np.errstate(over="ignore"):
            h = sum((w[i : len(w) - n + 1 + i] * self.odd[i] for i in range(n)), start=U(n))
        return address, *np.unique(mix(h), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (ascending elements, weights); 1 for two empty ones."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (total - both)


def signed(docs: DataFrame, key: str, text: str, setup: Setup) -> DataFrame:
    """key, addr (hash of the text), content, sig: 16 bits a coordinate, null without words."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, known = Shingler(setup.words), {}

        def sign(sets: dict[bytes, tuple]) -> None:
            if sets:
                rows = signatures(list(sets.values()), setup.size).astype("<u2")
                known.update((c, rows[i].tobytes()) for i, c in enumerate(sets))
                sets.clear()

        for b in common.sliced(batches):
            if len(known) > 5000:
                known.clear()
            contents, new, held = [], {}, 0
            for x in b.column(2).to_pylist():
                c, e, n = shingles(x)
                contents.append(c)
                if c not in known and c not in new:
                    if not len(e):
                        known[c] = None
                        continue
                    new[c] = e, n
                    held += int(n.sum())
                    if held > 100_000:  # cells at once
                        sign(new)
                        held = 0
            sign(new)
            sigs = [known[c] for c in contents]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(contents, pa.binary()), pa.array(sigs, pa.binary())], ["key", "addr", "content", "sig"])

    full = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("key"), F.xxhash64(full).alias("addr"), full.alias("text")).mapInArrow(run, f"key {kind}, addr long, content binary, sig binary")


def buckets(contents: DataFrame, setup: Setup) -> DataFrame:
    """bucket, band, content for each band of each content."""
    width = 2 * setup.rows
    band = F.explode(F.sequence(F.lit(0), F.lit(setup.bands - 1))).alias("band")
    return contents.where(F.col("sig").isNotNull()).select("content", "sig", band).select(F.xxhash64("band", F.expr(f"substring(sig, band * {width} + 1, {width})")).alias("bucket"), "band", "content")


def confirmed(pairs: DataFrame, texts: DataFrame, setup: Setup) -> DataFrame:
    """Of pairs (a, b), those at least as similar as the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, last, held = Shingler(setup.words), {}, 0

        def sets(c: bytes, x: str) -> tuple[np.ndarray, np.ndarray]:
            nonlocal held
            if c not in last:
                if held > 1_000_000:  # shingles
                    last.clear()
                    held = 0
                last[c] = shingles(x)[1:]
                held += len(last[c][0])
            return last[c]

        for batch in common.sliced(batches):
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            good = [similarity(sets(p, s), sets(q, t)) >= setup.threshold for p, q, s, t in zip(a, b, x, y, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    left = texts.select(F.col("content").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("content").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """content, label: the least content of its component. Least labels spread over links and jump along labels; only minima are shuffled."""
    both = common.keep(spark, links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = common.keep(spark, both.groupBy(F.col("a").alias("content")).agg(F.min("b").alias("m")).select("content", F.least("content", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("content").alias("b"), "label"), "b").groupBy(F.col("a").alias("content")).agg(F.min("label").alias("m"))
        step = labels.join(near, "content").select("content", F.least("label", "m").alias("label"), F.col("label").alias("was"))
        jump = labels.select(F.col("content").alias("label"), F.col("label").alias("next"))
        new = common.keep(spark, step.join(jump, "label").select("content", F.least("label", "next").alias("label"), "was"), "labels")
        common.forget(spark, labels)
        labels = new.drop("was")
        if new.where("label != was").isEmpty():
            common.forget(spark, both)
            return labels


def _joining(content: list[bytes], label: np.ndarray, sig: np.ndarray, sets: list, left: np.ndarray, right: np.ndarray, other: np.ndarray, band: int, setup: Setup) -> list[tuple[bytes, bytes]]:
    """Links between members of left and right that join classes not joined yet; two others meet once, where the lesser content is on the left. sets: (shingles, counts) of each member."""
    rank = np.empty(len(content), np.int64)
    rank[np.array(sorted(range(len(content)), key=content.__getitem__), np.int64)] = np.arange(len(content))
    _, local = np.unique(np.concatenate([e for e, _ in sets]), return_inverse=True)
    ends = np.cumsum([len(e) for e, _ in sets])
    ids = np.split(local.ravel(), ends[:-1])
    counts = [n for _, n in sets]
    total = np.array([int(n.sum()) for n in counts])
    weight = np.zeros(int(local.max()) + 1, np.int64)
    group = np.arange(int(label.max()) + 1)  # the joined class of each class
    low, out = setup.least_estimate, []
    for p in left.tolist():
        q = right[~other[right] | (rank[right] > rank[p])]
        q = q[group[label[q]] != group[label[p]]]
        if not len(q):
            continue
        equal = sig[q] == sig[p]
        estimate = equal.mean(axis=1)
        good = (estimate >= low) & (equal.reshape(len(q), setup.bands, setup.rows).all(axis=2).argmax(axis=1) == band)
        q = q[good]
        if not len(q):
            continue
        weight[ids[p]] = counts[p]
        sizes = np.array([len(ids[x]) for x in q])
        both = np.minimum(weight[np.concatenate([ids[x] for x in q])], np.concatenate([counts[x] for x in q]))
        both = np.add.reduceat(both, np.cumsum(sizes) - sizes)
        weight[ids[p]] = 0
        for x in q[both >= setup.threshold * (total[q] + total[p] - both)].tolist():
            if group[label[x]] != group[label[p]]:
                group[group == group[label[x]]] = group[label[p]]
                out.append((content[p], content[x]))
    return out


def across(members: DataFrame, sigs: DataFrame, texts: DataFrame, setup: Setup) -> DataFrame:
    """Links (a, b) that join different classes of one bucket. members: bucket, band, content, label; texts: content, text."""
    sized = members.join(texts.select("content", F.length("text").alias("chars")), "content")
    shares = sized.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    size = F.struct("n", "chars", "label")
    mixed = shares.groupBy("bucket").agg(F.max(size).alias("top"), F.sum("n").alias("n"), F.sum("chars").alias("chars")).where("n > top.n")
    blocks = lambda n, chars: F.ceil(F.greatest(F.lit(1), n / setup.block, chars / setup.block_chars)).cast("int")
    cut = mixed.select("bucket", F.col("top.label").alias("top"), blocks(F.col("n") - F.col("top.n"), F.col("chars") - F.col("top.chars")).alias("left"), blocks(F.col("n"), F.col("chars")).alias("right"))
    rows = members.join(cut, "bucket").join(sigs.join(texts, "content"), "content")
    rows = rows.select("*", (F.col("label") != F.col("top")).alias("other"), *(F.pmod(F.xxhash64("content"), side).cast("int").alias(f"in_{side}") for side in ("left", "right")))
    # the task (i, j) holds the i-th block of the members outside the bucket's largest class, and the j-th of all: the largest class's members travel
    # once for each block of the others, so a bucket of one class and some strangers costs a few times its size
    here = F.transform(F.sequence(F.lit(0), F.col("left") - 1), lambda i: F.struct(i.alias("i"), F.col("in_right").alias("j")))
    there = F.transform(F.sequence(F.lit(0), F.col("right") - 1), lambda j: F.struct(F.col("in_left").alias("i"), j.alias("j")))
    rows = rows.withColumn("task", F.explode(F.when(F.col("other"), F.array_union(here, there)).otherwise(here)))
    rows = rows.select("bucket", "band", "task.i", "task.j", "in_left", "in_right", "other", "content", "label", "sig", "text")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[2].as_py(), key[3].as_py()
        _, label = np.unique(np.array(table["label"].to_pylist(), object), return_inverse=True)
        out = []
        if label.max():
            shingles, other = Shingler(setup.words), table["other"].to_numpy()
            left, right = np.flatnonzero(other & (table["in_left"].to_numpy() == i)), np.flatnonzero(table["in_right"].to_numpy() == j)
            sig = np.frombuffer(b"".join(table["sig"].to_pylist()), "<u2").reshape(len(other), setup.size)
            sets = [shingles(x)[1:] for x in table["text"].to_pylist()]
            out = _joining(table["content"].to_pylist(), label, sig, sets, left, right, other, key[1].as_py(), setup)
        return pa.table([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return rows.groupBy("bucket", "band", "i", "j").applyInArrow(run, "a binary, b binary")


def grouped(spark: SparkSession, docs: DataFrame, key: str, text: str, setup: Setup) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """key, addr and content of every row; label of every content; one row (key, addr) of every label: one with its least key; and the links (a, b) between contents that make the classes."""
    rows = common.keep(spark, signed(docs, key, text, setup), "signed")
    contents = common.keep(spark, rows.groupBy("content").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "addr")).alias("at"), F.first("sig").alias("sig")), "contents")
    dealt = buckets(contents, setup)
    shared = dealt.groupBy("bucket").agg(F.min("content").alias("head"), F.count("*").alias("n")).where("n > 1")
    members = common.keep(spark, dealt.join(shared.drop("n"), "bucket"), "members")
    pairs = common.keep(spark, members.where("content != head").select(F.col("head").alias("a"), F.col("content").alias("b")).distinct(), "pairs")
    sought = members.select("content").distinct().join(contents, "content").select("content", "at.key", "at.addr")
    full = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(F.col(key).alias("k"), F.xxhash64(full).alias("h"), full.alias("text"))
    found = source.join(sought, (source["h"] == sought["addr"]) & source["k"].eqNullSafe(sought["key"]))
    texts = common.keep(spark, found.groupBy("content").agg(F.first("text").alias("text")), "texts")
    links = common.keep(spark, confirmed(pairs, texts, setup), "near")
    label = components(spark, links)
    labelled = members.select("bucket", "band", "content").join(label, "content", "left").select("bucket", "band", "content", F.coalesce("label", "content").alias("label"))
    more = common.keep(spark, across(labelled, contents.select("content", "sig"), texts, setup), "near")
    if not more.isEmpty():
        label = components(spark, links.union(more))
    whole = contents.select("content", "at").join(label, "content", "left").select("content", F.coalesce("label", "content").alias("label"), "at")
    one = whole.groupBy("label").agg(F.min(F.struct("at.none", "at.key", "content", "at.addr")).alias("one")).select("label", "one.key", "one.addr")
    for done in (members, pairs, texts):
        common.forget(spark, done)
    return rows, whole.select("content", "label"), one, links.union(more)


def classes(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", setup: Setup = Setup()) -> DataFrame:
    """key, content, label and class_id of every row. The label (the least content) tells classes apart; class_id, the least key, may be null or shared."""
    rows, labels, one, _ = grouped(spark, docs, key, text, setup)
    named = labels.join(one.select("label", F.col("key").alias("class_id")), "label")
    return rows.select(F.col("key").alias(key), "content").join(named, "content").select(key, "content", "label", "class_id")


def links(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", setup: Setup = Setup()) -> DataFrame:
    """a, b (contents) and label: the pairs that were compared exactly, are near copies, and make the classes; each joins two or confirms one."""
    _, labels, _, found = grouped(spark, docs, key, text, setup)
    return found.distinct().join(labels.withColumnRenamed("content", "a"), "a")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark, common.read(spark, sf_dir, "documents")).select("doc_id", "class_id", F.lower(F.hex("label")).alias("class_label"))


def deduplicated(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class: one with the class's least key, and of rows that repeat that key the one of least content."""
    _, _, one, _ = grouped(spark, docs, key, text, Setup())
    rows = common.boxed(docs, k=F.col(key), h=F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    kept = rows.join(one, (rows["h"] == one["addr"]) & rows["k"].eqNullSafe(one["key"]))
    return kept.groupBy("label").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row.*")


#: The classes in DuckDB's SQL: all pairs that share a shingle, compared exactly, and what can be reached over links.
SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+') AS words FROM documents
),
rows_ AS (SELECT doc_id, words, md5(array_to_string(words, chr(31))) AS content FROM docs),
contents AS (SELECT content, any_value(words) AS words FROM rows_ GROUP BY content),
shingles AS (
  SELECT content, shingle, count(*) AS n
  FROM (SELECT content, unnest([array_to_string(words[i:i + least(5, len(words)) - 1], chr(31)) FOR i IN range(1, len(words) - least(5, len(words)) + 2)]) AS shingle FROM contents WHERE len(words) > 0)
  GROUP BY content, shingle
),
totals AS (SELECT content, sum(n) AS total FROM shingles GROUP BY content),
shared AS (SELECT x.content AS a, y.content AS b, sum(least(x.n, y.n)) AS both_ FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.content < y.content GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN totals s ON s.content = a JOIN totals t ON t.content = b WHERE both_ >= 0.8 * (s.total + t.total - both_)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
walk(content, reached) AS (SELECT content, content FROM contents UNION SELECT w.content, l.b FROM walk w JOIN ways l ON l.a = w.reached),
labels AS (SELECT content, min(reached) AS label FROM walk GROUP BY content),
ids AS (SELECT label, min(doc_id) AS class_id FROM rows_ JOIN labels USING (content) GROUP BY label)
SELECT doc_id, class_id, label AS class_label FROM rows_ JOIN labels USING (content) JOIN ids USING (label)
"""
