"""Byte-level BPE over a global shuffle of distinct words.

1. Documents are gathered into blocks. A block's pre-tokens become positions (indexes into the block's own
   word list), kept with the documents; its words, each once, are dealt by hash.
2. A task that receives words encodes each distinct one once, whatever the number of blocks it comes
   from, and answers each block in the order in which the block asked.
3. Answers and positions meet again by block, and each document is put together by position.
4. Decoding joins ids with the token-byte table, which has one row for each id of the vocabulary: as large as the vocabulary, whatever
   the corpus, so every worker has it whole (a broadcast join) and ids keep their places.

Rows of the shuffle are packed: one row holds the words that one block sends to one bucket, or the answer, or
some documents' positions, as compressed bytes. A word that every document repeats is therefore one entry a block. Buckets are as many
as the session's shuffle partitions, each in a partition of its own; so is each block when its answers come back. A bucket's task remembers up to 256 MB of words; only
beyond that may a word be encoded again.

Defined cases: a null text is an empty one with no id; repeated rows are each encoded; an empty table gives
an empty result; keys are integers, or null, and others are refused; other columns are not touched; special strings are ordinary text; a text is never cut, and one longer than a block is a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm import common, tokenizers_

#: Text of one block, in characters: what a worker holds at once, its words and positions included.
BLOCK_CHARS = 24_000_000
#: Documents whose positions are one row.
DOCS_A_ROW = 512
_ROW = "block long, bucket int, kind int, seq int, data binary"
_WORDS, _ANSWER, _DOCS = 0, 0, 1


@dataclass(frozen=True)
class Vocabulary:
    ranks: str
    pattern: str


@lru_cache(None)
def _encoding(v: Vocabulary) -> tiktoken.Encoding:
    return tiktoken.Encoding("words", pat_str=v.pattern, mergeable_ranks=tokenizers_.ranks(v.ranks), special_tokens={})


def _squeeze(*arrays: np.ndarray | bytes) -> bytes:
    raw = [x if isinstance(x, bytes) else x.tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(raw), *map(len, raw)], "<u4").tobytes() + b"".join(raw))


def _parts(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    at = 4 + 4 * n
    out = []
    for size in np.frombuffer(raw, "<u4", n, 4).tolist():
        out.append(raw[at : at + size])
        at += size
    return out


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers byte by byte, all lowest bytes first: bytes of one weight are alike and shrink well."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _joined(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def split(docs: DataFrame, v: Vocabulary, buckets: int, key: str, text: str) -> DataFrame:
    """Rows of words (kind 0) and of documents (kind 1) of each block."""

    def emit(block: int, words: dict[str, int], held: list[tuple]) -> Iterator[tuple]:
        # numbered by falling frequency, so that most positions are small numbers
        counts = np.bincount(np.concatenate([d for _, d in held]), minlength=len(words))
        by_rank = np.argsort(-counts, kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[by_rank] = np.arange(len(words), dtype=np.uint32)
        listed = list(words)
        raw = [listed[i].encode() for i in by_rank.tolist()]
        bucket = np.array([xxhash.xxh3_64_intdigest(w) % buckets for w in raw], np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in range(buckets):
            some = [raw[i] for i in order[edges[b] : edges[b + 1]].tolist()]
            if some:
                yield block, b, _WORDS, 0, _squeeze(_planes(np.array([len(w) for w in some])), b"".join(some))
        # which numbers went to which bucket: the answers come back in that order
        yield block, -1, _DOCS, -1, _squeeze(_planes(np.diff(edges)), _planes(np.diff(order, prepend=0)))
        for k in range(0, len(held), DOCS_A_ROW):
            some = held[k : k + DOCS_A_ROW]
            known = np.array([d[0] is not None for d in some])
            yield block, -1, _DOCS, k // DOCS_A_ROW, _squeeze(np.array([d[0] or 0 for d in some], "<i8"), known, _planes(np.array([len(d[1]) for d in some])), _planes(rank[np.concatenate([d[1] for d in some])]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, unsettled = regex.compile(v.pattern).findall, tokenizers_.unsettled().search
        block = TaskContext.get().partitionId() << 24
        words: dict[str, int] = {}
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            weight = 0
            for row in emit(block, words, held):
                out.append(row)
                weight += len(row[4])
                if weight > 8_000_000:
                    yield _batch(out)
                    out, weight = [], 0
            if out:
                yield _batch(out)

        for b in common.sliced(batches):
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = find(x or "") if not unsettled(x or "") else tokenizers_.explicit(v.pattern).findall(x)
                held.append((k, np.fromiter((words.setdefault(w, len(words)) for w in found), np.uint32, len(found))))
                size += len(x or "")
                if size >= BLOCK_CHARS:
                    yield from flush()
                    block, words, held, size = block + 1, {}, [], 0
        if held:
            yield from flush()

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, _ROW)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["block", "bucket", "kind", "seq", "data"])


def answer(words: DataFrame, v: Vocabulary, buckets: int) -> DataFrame:
    """For each row of words, a row of the same block with their ids. A bucket is a task, which encodes each distinct word once, as long as its table of them fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(v)._core_bpe.encode_single_piece
        whole = tokenizers_.ranks(v.ranks)
        table = common.Table(256 << 20)
        for batch in batches:
            out = []
            for block, bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True):
                lengths, text = _parts(data)
                ids, at = [], 0
                for n in _joined(lengths).tolist():
                    w = text[at : at + n]
                    at += n
                    got = table.get(w)
                    if got is None:
                        one = whole.get(w)
                        got = [one] if one is not None else encode(w)
                        table.put(w, got)
                    ids.append(got)
                counts = np.fromiter(map(len, ids), "<u4", len(ids))
                flat = np.fromiter((i for x in ids for i in x), "<u4", int(counts.sum()))
                out.append((block, bucket, _ANSWER, bucket, _squeeze(_planes(counts), _planes(flat))))
            yield _batch(out)

    return words.repartitionById(buckets, F.col("bucket")).mapInArrow(run, _ROW)


def decoded(ids: np.ndarray, table: list[bytes]) -> bytes:
    """The bytes of ids, by the token-byte table."""
    return b"".join(map(table.__getitem__, ids.tolist()))


class _Block:
    """Ids of a block's words, from its answers; then of its documents, by position."""

    def __init__(self) -> None:
        self.answers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def take(self, bucket: int, data: bytes) -> None:
        counts, flat = _parts(data)
        self.answers[bucket] = _joined(counts), _joined(flat)

    def close(self, data: bytes) -> None:
        """data: how many of the block's words went to each bucket, and their numbers."""
        sizes, steps = map(_joined, _parts(data))
        at = np.cumsum(steps.astype(np.uint32).view(np.int32).astype(np.int64))
        asked = [b for b, n in enumerate(sizes.tolist()) if n]
        if asked != sorted(self.answers):
            raise ValueError("an answer is missing")
        counts = np.concatenate([self.answers[b][0] for b in asked]) if asked else np.empty(0, np.int64)
        self.flat = np.concatenate([self.answers[b][1] for b in asked]).astype(np.uint32) if asked else np.empty(0, np.uint32)
        self.start, self.count = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        self.start[at], self.count[at] = np.cumsum(counts) - counts, counts
        self.answers = {}

    def ids(self, words: np.ndarray) -> np.ndarray:
        n = self.count[words]
        ends = np.cumsum(n)
        if not len(ends):
            return np.empty(0, np.uint32)
        return self.flat[np.arange(ends[-1]) + np.repeat(self.start[words] - (ends - n), n)]


def encoded(spark: SparkSession, docs: DataFrame, v: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (binary: little-endian unsigned 32-bit) of every row."""
    return _assembled(spark, docs, v, key, text, "ids binary", lambda ids, _: [[x.tobytes() for x in ids]], [pa.binary()], ["ids"])


def _assembled(spark, docs, v, key, text, schema, digest, types, names) -> DataFrame:  # noqa: ANN001
    common.integral(docs, key)
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = common.fresh_dir(spark, "blocks")
    split(docs, v, buckets, key, text).write.partitionBy("kind").parquet(path)
    rows = spark.read.schema(_ROW).parquet(path)
    asked = rows.where(F.col("kind") == _WORDS).select(*_names())
    answers = common.keep(spark, answer(asked, v, buckets), "answers")
    common.drop_dir(spark, f"{path}/kind={_WORDS}")
    whole = answers.unionByName(spark.read.schema("block long, bucket int, seq int, data binary").parquet(f"{path}/kind={_DOCS}").withColumn("kind", F.lit(_DOCS)).select(*_names())) if _there(spark, f"{path}/kind={_DOCS}") else answers
    shared = spark.sparkContext.broadcast(tokenizers_.byte_tokens(v.ranks))
    # blocks by their place in the scan's partition, first all first ones: consecutive numbers, so a partition gets one, or two where some are missing
    n, width = whole.where((F.col("kind") == _DOCS) & (F.col("seq") < 0)).agg(F.count("*"), F.max(F.shiftright("block", 24)) + 1).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at = _Block(), None
        tokens = shared.value
        for batch in batches:
            for b, bucket, kind, seq, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if b != at:
                    block, at = _Block(), b
                if kind == _ANSWER:
                    block.take(bucket, data)
                    continue
                if seq < 0:
                    block.close(data)
                    continue
                keys, known, lengths, words = _parts(data)
                words, ends = _joined(words), np.cumsum(_joined(lengths)).tolist()
                ids = [block.ids(words[s:e]) for s, e in zip([0, *ends], ends, strict=False)]
                keys = [k if good else None for k, good in zip(np.frombuffer(keys, "<i8").tolist(), np.frombuffer(known, bool).tolist(), strict=True)]
                yield pa.record_batch([pa.array(keys, pa.int64()), *(pa.array(x, t) for x, t in zip(digest(ids, tokens), types, strict=True))], [key, *names])

    number = F.shiftright("block", 24) + F.col("block").bitwiseAND((1 << 24) - 1) * F.lit(width or 1)
    return whole.repartitionById(max(1, n), F.pmod(number, F.lit(max(1, n))).cast("int")).sortWithinPartitions("block", "kind", "seq").mapInArrow(run, f"{key} long, {schema}")


def _names() -> list[str]:
    return ["block", "bucket", "kind", "seq", "data"]


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _digests(ids: list[np.ndarray], tokens: list[bytes]) -> list[list]:
    n, text, back = [], [], []
    for x in ids:
        listed = x.tolist()
        n.append(len(listed))
        text.append(hashlib.sha256(" ".join(map(str, listed)).encode()).hexdigest())
        back.append(hashlib.sha256(decoded(x, tokens)).hexdigest())
    return [n, text, back]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Vocabulary(tokenizers_.path("byte_bpe_50k.tiktoken"), tokenizers_.public_tokenizers.PATTERN)
    docs = common.read(spark, sf_dir, "documents")
    return _assembled(spark, docs, v, "doc_id", "text", "n_tokens long, ids_sha256 string, decoded_sha256 string", _digests, [pa.int64(), pa.string(), pa.string()], ["n_tokens", "ids_sha256", "decoded_sha256"])
