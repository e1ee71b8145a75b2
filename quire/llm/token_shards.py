"""Raw token-id shards with a minimal perfect hash from document key to place.

A shard is two files. `shard-N.ids` holds nothing but ids, little-endian, 16 bits wide if the vocabulary
allows and 32 else, documents one after another in ascending key order. `shard-N.idx` holds no keys: their perfect hash, by slot a
32-bit fingerprint, the first document's row and the number of rows with that key, and by row the end of its
ids. All of it is records of fixed size, so a key is found and read by a fixed number of small reads, without reading the index; who asks for many
keys reads each part once.

Documents are dealt by ranges of (key, hash of the text, place in the input), so a key, or a row, that a third of all rows repeat
is spread over shards like any other range. Reading back asks for keys: each goes to the shards whose range has it, and a shard's
task asks its hash for all of them, tells strangers by fingerprint, and reads the ids once from front to back.

Files are written under another name and renamed when whole, and their names and bytes depend on the shard alone,
so a task that is run again or twice changes nothing; what dead attempts leave is removed at the end. The folder is reached by its URI; the names that
Hadoop gives to stores (s3a, dbfs) become those that the readers of workers know.

Defined cases: a null text is an empty one and has the end id only; null keys come first and are read in
order, not by key; repeated keys are written each, in the order of their text's hash; keys are integers, and others are refused; an
empty table gives no shard and no row; other columns are not touched.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm import common, mph, tokenizers_
from quire.llm.token_counts import _ODD, _SPLIT, HeapCounter, lowered

_HEAD, _MAGIC = struct.Struct("<8sqqqqq"), b"QIDX2\0\0\0"


def rebuilt(path: str) -> bool:
    """Whether merging each token's own bytes gives that token again.

    If so, merging by the rank of the joined bytes does what merging by pairs does: while no merge has crossed
    the ends of a token's bytes, they merge as they do alone, so the last two parts are the pair of its own merge.
    """
    c = HeapCounter(path)
    d = tokenizers_.description(path)["model"]
    plain = {ch: b for b, ch in tokenizers_.byte_chars().items()}
    end = d["end_of_word_suffix"]
    for a, b in d["merges"]:
        token = a + b
        raw = [plain[x] for x in token.removesuffix(end)]
        symbols = [c.inner[x] for x in raw]
        if token.endswith(end):
            symbols[-1] = c.last[raw[-1]]
        if c.merge(symbols) != 1 or symbols[0] != d["vocab"][token]:
            return False
    return True


class ChunkEncoder:
    """Ids of texts by a vocabulary that neither sees nor crosses white space.

    Many texts are split at once, and each different chunk of them is looked up once; the ids of all are then gathered by Arrow. Chunks are kept in a
    bounded table. New ones are merged together, over bytes: a space, which no chunk has, ends a word, and a line feed a chunk. Chunks that hold a special
    string or a character that tables may differ on, and vocabularies that `rebuilt` refuses, go to the library.
    """

    _MARKS = b" \n"

    def __init__(self, path: str, by_rank: bool) -> None:
        self.library, self.by_rank = tokenizers_.library(path), by_rank
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.chunks = common.Table(96 << 20)
        rules = HeapCounter(path)
        self.special, self.unsettled = rules.special, rules.unsettled
        if by_rank:
            self.pattern = regex.compile(f"{rules.pattern.pattern}|\n")
            d = tokenizers_.description(path)["model"]
            plain, end = {ch: b for b, ch in tokenizers_.byte_chars().items()}, d["end_of_word_suffix"]
            ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + b" ": 256 + b for b in range(256)}
            ids = [*rules.inner, *rules.last]
            for a, b in d["merges"]:
                token = a + b
                raw = bytes(plain[x] for x in token.removesuffix(end))
                if any(x in self._MARKS for x in raw):  # no word has it
                    continue
                raw += b" " if token.endswith(end) else b""
                if raw not in ranks:
                    ranks[raw] = len(ids)
                    ids.append(d["vocab"][token])
            self.merges = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
            self.parted, self.ids = ranks[b"\n "], np.array(ids, self.kind)

    def merged(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks by merging; at least one chunk."""
        got = self.merges.encode_to_numpy(" ".join(self.pattern.findall(lowered("\n".join(chunks)))) + " ")
        ends = np.append(np.flatnonzero(got == self.parted), len(got))
        starts, raw, w = np.concatenate([[0], ends[:-1] + 1]), self.ids[got].tobytes(), self.kind.itemsize
        return [raw[a:b] for a, b in zip((starts * w).tolist(), (ends * w).tolist(), strict=True)]

    def odd(self, text: str) -> bool:
        return not self.by_rank or bool(self.unsettled(text)) or "<|" in text and bool(self.special.search(text))

    def new(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks; at least one chunk."""
        if not self.odd("\n".join(chunks)):
            return self.merged(chunks)
        odd = list(map(self.odd, chunks))
        plain = iter(self.merged([c for c, x in zip(chunks, odd, strict=True) if not x]) if not all(odd) else [])
        return [np.array(self.library.encode(c, add_special_tokens=False).ids, self.kind).tobytes() if x else next(plain) for c, x in zip(chunks, odd, strict=True)]

    def known(self, chunks: list[str]) -> list[bytes]:
        """Ids of different chunks, out of the table where they are there; it takes the others."""
        table = self.chunks
        got = list(map(table.get, chunks))
        new = [c for c, x in zip(chunks, got, strict=True) if x is None]
        if new:
            found = self.new(new)
            rest = iter(found)
            got = [next(rest) if x is None else x for x in got]
            if not table.take(dict(zip(new, found, strict=True))):
                table.restart()
                table.take(dict(zip(chunks, got, strict=True)))  # these alone may be more than a table holds
        return got

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after another, and where each text's end; a null text has none."""
        texts = pc.fill_null(texts, "")
        odd = pc.any(pc.match_substring_regex(texts, _ODD.pattern)).as_py()
        parts = pc.split_pattern_regex(texts, _SPLIT.pattern) if odd else pc.utf8_split_whitespace(texts)
        chunks = parts.flatten().dictionary_encode()
        held = pa.array(self.known(chunks.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(chunks.indices)
        at = np.frombuffer(held.buffers()[1], np.int64, len(held) + 1)
        ids = np.frombuffer(held.buffers()[2] or b"", self.kind, at[-1] // self.kind.itemsize)
        return ids, at[np.cumsum(pc.list_value_length(parts).to_numpy(), dtype=np.int64)] // self.kind.itemsize

    def __call__(self, text: str) -> bytes:
        return self.encoded(pa.array([text], pa.string()))[0].tobytes()


@lru_cache(None)
def encoder(path: str, by_rank: bool) -> ChunkEncoder:
    return ChunkEncoder(path, by_rank)


#: What the workers' file systems call stores that Hadoop names otherwise.
_SCHEMES = {"s3a://": "s3://", "s3n://": "s3://", "dbfs:///": "file:///dbfs/", "dbfs:/": "file:///dbfs/"}


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    for hadoop, own in _SCHEMES.items():
        if folder.startswith(hadoop):
            folder = own + folder.removeprefix(hadoop)
            break
    return fs.FileSystem.from_uri(folder)


def _there(files: fs.FileSystem, path: str) -> bool:
    return files.get_file_info(path).type == fs.FileType.File


def _put(files: fs.FileSystem, path: str, parts: Iterable[bytes]) -> None:
    """Writes a file under the attempt's name and renames it. Another attempt's file of that name has the same bytes and stays."""
    attempt = f"{path}.attempt-{TaskContext.get().taskAttemptId()}"
    with files.open_output_stream(attempt) as f:
        for x in parts:
            f.write(x)
    if not _there(files, path):
        try:
            files.move(attempt, path)
        except OSError:
            if not _there(files, path):
                raise
    if _there(files, attempt):
        files.delete_file(attempt)


_SLOT = np.dtype([("print", "<u4"), ("row", "<i8"), ("count", "<i8")])


def _index(keys: list[int | None], ends: np.ndarray, width: int) -> bytes:
    nulls = sum(k is None for k in keys)
    distinct, first, count = np.unique(np.array(keys[nulls:], np.int64), return_index=True, return_counts=True)
    sizes, levels = mph.build(distinct)
    places = mph.slots(distinct, sizes, [x.__getitem__ for x in levels])
    held = np.empty(len(distinct), _SLOT)
    held["print"][places], held["row"][places], held["count"][places] = mph.fingerprints(distinct), first + nulls, count
    head = _HEAD.pack(_MAGIC, len(distinct), len(keys), nulls, width, len(sizes)) + struct.pack(f"<{len(sizes)}q", *sizes)
    return b"".join([head, *(x.tobytes() for x in levels), held.tobytes(), ends.astype("<i8").tobytes()])


class _Records:
    """Records of one kind in a file: a few are read one by one, many at once, and then they stay."""

    FEW = 64

    def __init__(self, file: pa.NativeFile, at: int, kind: np.dtype, n: int) -> None:
        self.file, self.at, self.kind, self.n, self.whole = file, at, kind, n, None

    @property
    def after(self) -> int:
        return self.at + self.n * self.kind.itemsize

    def __call__(self, places: np.ndarray) -> np.ndarray:
        if self.whole is None and len(places) <= self.FEW:
            size = self.kind.itemsize
            return np.frombuffer(b"".join(self.file.read_at(size, self.at + p * size) for p in places.tolist()), self.kind)
        if self.whole is None:
            self.whole = np.frombuffer(self.file.read_at(self.n * self.kind.itemsize, self.at), self.kind, self.n)
        return self.whole[places]


class Shard:
    """Keyed access to one shard, in constant time for each key."""

    def __init__(self, folder: str, number: int) -> None:
        files, path = _place(folder)
        index = files.open_input_file(f"{path}/shard-{number:06d}.idx")
        magic, distinct, self.n, self.nulls, self.width, k = _HEAD.unpack(index.read_at(_HEAD.size, 0))
        if magic != _MAGIC:
            raise ValueError("not an index")
        self.sizes, at = struct.unpack(f"<{k}q", index.read_at(8 * k, _HEAD.size)), _HEAD.size + 8 * k
        self.levels = []
        for size in self.sizes:
            self.levels.append(_Records(index, at, mph.RECORD, -(-size // mph.RECORD["bits"].itemsize // 8)))
            at = self.levels[-1].after
        self.held = _Records(index, at, _SLOT, distinct)
        self.ends = _Records(index, self.held.after, np.dtype("<i8"), self.n)
        self.ids = files.open_input_file(f"{path}/shard-{number:06d}.ids")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key; -1 and 0 where the hash or the fingerprint tells a stranger."""
        places = mph.slots(keys, self.sizes, self.levels)
        rows, counts = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        some = np.flatnonzero(places >= 0)
        held = self.held(places[some])
        good = held["print"] == mph.fingerprints(keys[some])
        rows[some[good]], counts[some[good]] = held["row"][good], held["count"][good]
        return rows, counts

    def starts(self, rows: np.ndarray) -> np.ndarray:
        """Where the ids of rows start."""
        return np.where(rows > 0, self.ends(np.maximum(rows - 1, 0)), 0) if len(rows) else np.empty(0, np.int64)

    def read(self, rows: np.ndarray, at_once: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
        """(row, start, ids) of ascending rows; neighbours are read together, some bytes at once."""
        starts, ends = self.starts(rows).tolist(), self.ends(rows).tolist() if len(rows) else []
        k = 0
        while k < len(rows):
            upto = k + 1
            while upto < len(rows) and starts[upto] == ends[upto - 1] and (ends[upto] - starts[k]) * self.width <= at_once:
                upto += 1
            got = np.frombuffer(self.ids.read_at((ends[upto - 1] - starts[k]) * self.width, starts[k] * self.width), f"<u{self.width}")
            for i in range(k, upto):
                yield int(rows[i]), starts[i], got[starts[i] - starts[k] : ends[i] - starts[k]]
            k = upto


def write(spark: SparkSession, docs: DataFrame, path: str, end_id: int, folder: str, key: str = "doc_id", text: str = "text") -> list[tuple]:
    """Writes the shards and returns their list, in order, a row for each shard: number, documents, ids, ids before it, documents without key, least and greatest key."""
    common.integral(docs, key)
    files, place = _place(folder)
    files.create_dir(place, recursive=True)
    by_rank = rebuilt(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = _place(folder)
        number, encode = TaskContext.get().partitionId(), None
        keys: list[int | None] = []
        lengths: list[int] = []
        batches = common.weighed(batches, 1)
        first = next(batches, None)
        if first is None:
            return

        def payload() -> Iterator[bytes]:
            nonlocal encode
            encode = encoder(path, by_rank)
            for b in chain([first], batches):
                keys.extend(b.column(0).to_pylist())
                ids, ends = encode.encoded(b.column(1))
                lengths.extend((np.diff(ends, prepend=0) + 1).tolist())
                yield np.insert(ids, ends, end_id).tobytes()

        _put(files, f"{place}/shard-{number:06d}.ids", payload())
        ends = np.cumsum(lengths)
        _put(files, f"{place}/shard-{number:06d}.idx", [_index(keys, ends, encode.kind.itemsize)])
        nulls = sum(k is None for k in keys)
        known = keys[nulls:] or [None]
        yield pa.record_batch([pa.array([x], pa.int64()) for x in (number, len(keys), int(ends[-1]), nulls, known[0], known[-1])], ["shard", "n", "ids", "nulls", "lo", "hi"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tie"), F.spark_partition_id().alias("part"))
    rows = rows.repartitionByRange("key", "tie", "part").sortWithinPartitions("key", "tie").select("key", "text")
    shards, base = [], 0
    for number, n, ids, *rest in sorted(map(tuple, rows.mapInArrow(run, "shard long, n long, ids long, nulls long, lo long, hi long").collect())):  # a row a shard
        shards.append((number, n, ids, base, *rest))
        base += ids
    for left in files.get_file_info(fs.FileSelector(place)):
        if ".attempt-" in left.base_name:
            files.delete_file(left.path)
    return shards


def read_back(spark: SparkSession, keys: DataFrame, shards: list[tuple], folder: str, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens, ids_crc32 of every document with one of the keys, null among them, found by the hash and read from the files; unknown keys have none."""
    if not shards:
        return spark.createDataFrame([], f"{key} long, start long, n_tokens long, ids_crc32 long")
    numbers, bases = np.array([s[0] for s in shards]), [s[3] for s in shards]
    keyed = np.array([k for k, s in enumerate(shards) if s[5] is not None], np.int64)
    lo, hi = (np.array([shards[k][c] for k in keyed.tolist()], np.int64) for c in (5, 6))
    nulls = [k for k, s in enumerate(shards) if s[4]]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.column(0).null_count:
                yield pa.record_batch([pa.array(nulls, pa.int32()), pa.nulls(len(nulls), pa.int64())], ["at", "key"])
            own = b.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            first, n = np.searchsorted(hi, own), np.maximum(np.searchsorted(lo, own, "right") - np.searchsorted(hi, own), 0)
            at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.record_batch([pa.array(keyed[at].astype(np.int32)), pa.array(np.repeat(own, n))], ["at", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answered(k: int, asked: list[pa.Array]) -> Iterator[pa.RecordBatch]:
            shard, column = Shard(folder, int(numbers[k])), pa.chunked_array(asked)
            own = column.drop_null().to_numpy().astype(np.int64)
            first, n = shard.find(own)
            rows = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            order = np.argsort(rows, kind="stable")
            rows, named = rows[order], np.repeat(own, n)[order]
            if column.null_count:
                rows, named = np.concatenate([np.arange(shard.nulls), rows]), np.concatenate([np.zeros(shard.nulls, np.int64), named])
            for at in range(0, len(rows), 8192):
                some = rows[at : at + 8192]
                got = [(r < shard.nulls, bases[k] + s, len(x), zlib.crc32(x.astype("<u4").tobytes())) for r, s, x in shard.read(some)]
                none, start, size, crc = zip(*got, strict=True)
                yield pa.record_batch([pa.array(named[at : at + 8192], mask=np.array(none)), *(pa.array(c, pa.int64()) for c in (start, size, crc))], [key, "start", "n_tokens", "ids_crc32"])

        at, asked = -1, []
        for b in batches:
            for k in np.unique(b.column(0).to_numpy(zero_copy_only=False)).tolist():
                if k != at and asked:
                    yield from answered(at, asked)
                    asked = []
                at = k
                asked.append(b.column(1).filter(pc.equal(b.column(0), k)))
        if asked:
            yield from answered(at, asked)

    asked = keys.select(F.col(key).cast("long").alias("key")).distinct().mapInArrow(deal, "at int, key long")
    return asked.repartitionById(len(shards), F.col("at")).sortWithinPartitions("at").mapInArrow(run, f"{key} long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, docs = common.fresh_dir(spark, "shards"), common.read(spark, sf_dir, "documents")
    shards = write(spark, docs, tokenizers_.path("word_bpe_49k.json"), 2, folder)
    return read_back(spark, docs, shards, folder)
