"""Best-fit packing into fixed-length sequences, repacked under certified lower bounds.

Documents become ids and one end id. Only those above the sequence length are cut: the first piece takes
the remainder and whole sequences follow. The other pieces are packed in rounds:

1. Pieces are dealt into groups by a hash, and each group is packed best-fit decreasing.
2. A group whose bin count meets its lower bound (the best of a family of dual feasible functions)
   is certified; it is final. So is every bin that is exactly full.
3. The pieces of the other bins are exchanged: they are dealt anew, into fewer groups, and packed again.

Rounds end when one group holds all that is left, or when they stop making whole bins; then every bin is final. Each certified group
may have left room in its last bins, and the last round isn't certified: `certificate` gives the gap between all sequences and the bound over all pieces.

Defined cases: a null text is an empty one, whose only id is the end id; repeated rows are packed each;
an empty table gives an empty result; other columns are not touched. The special string in a text is
its own id, as in the library.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm import common, tokenizers_

_PIECE = "uid long, key {}, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Setup:
    capacity: int = 1024
    end_id: int = 2
    #: Pieces in a group of the first round, on average. Later rounds have fewer groups, of max_group pieces at most.
    group: int = 4096
    fewer: int = 4
    max_group: int = 65536
    rounds: int = 8


@lru_cache(None)
def encoder(ranks: str, pattern: str, special: tuple[tuple[str, int], ...]) -> tiktoken.Encoding:
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=tokenizers_.ranks(ranks), special_tokens=dict(special))


def pieces(docs: DataFrame, setup: Setup, key: str, text: str) -> DataFrame:
    """uid, key, piece, start, length, ids_crc32 of every piece. The byte-level vocabulary's ranks give the ids that its .json gives."""
    kind = docs.schema[key].dataType.simpleString()
    ranks, pattern, special = tokenizers_.path("byte_bpe_50k.tiktoken"), tokenizers_.public_tokenizers.PATTERN, (("<|endoftext|>", 50256),)
    names, written = ["uid", "key", "piece", "start", "length", "ids_crc32"], tokenizers_.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, unsettled = encoder(ranks, pattern, special), tokenizers_.unsettled().search
        uid = TaskContext.get().partitionId() << 36
        for b in common.sliced(batches):
            rows: list[tuple] = []
            at: list[int] = []
            for i, x in enumerate(b.column(1).to_pylist()):
                if unsettled(x or ""):
                    own = tokenizers_.library(written).encode(x, add_special_tokens=False).ids
                else:
                    own = enc.encode_to_numpy(x or "", allowed_special="all")
                ids = np.append(own, setup.end_id).astype("<u4")
                first = (len(ids) - 1) % setup.capacity + 1
                cuts = [0, *range(first, len(ids) + 1, setup.capacity)]
                for p, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((uid, p, s, e - s, zlib.crc32(ids[s:e].tobytes())))
                    at.append(i)
                    uid += 1
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)] if rows else []
            if cols:
                yield pa.record_batch([cols[0], pc.take(b.column(0), pa.array(at)), *cols[1:]], names)

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, _PIECE.format(kind))


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Fewest bins that any packing needs, by dual feasible functions. counts[s]: items of size s."""
    size = np.arange(len(counts))
    best = -(-int((counts * size).sum()) // capacity)
    big, number, volume = np.cumsum(counts[::-1])[::-1], np.cumsum(counts), np.cumsum(counts * size)
    for e in range(1, capacity // 2 + 1):  # sizes above capacity - e count whole, those below e nothing
        top = capacity - e
        whole = int(big[top + 1]) if top + 1 < len(counts) else 0
        part = int(volume[min(top, len(counts) - 1)] - volume[e - 1])
        best = max(best, whole + -(-part // capacity))
    for k in range(1, 40):  # sizes that fill k + 1 parts exactly keep their share, others round down over k
        x = size * (k + 1)
        f = np.where(x % capacity == 0, size * k, x // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((counts * f).sum()) // (k * capacity)))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin of each item and its place there, items taken by falling size; and what each bin holds."""
    order = np.argsort(-sizes, kind="stable")
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: a bin with room r
    bins, place, room = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    for i in order.tolist():
        s = int(sizes[i])
        fit = some >> s
        if fit:
            r = s + (fit & -fit).bit_length() - 1
            b = open_bins[r].pop()
            if not open_bins[r]:
                some &= ~(1 << r)
        else:
            b, r = len(room), capacity
            room.append(capacity)
        bins[i], place[i] = b, capacity - r
        r -= s
        room[b] = r
        if r:
            open_bins[r].append(b)
            some |= 1 << r
    return bins, place, capacity - np.array(room, np.int64)


def pack_group(table: pa.Table, setup: Setup, last: bool) -> pa.Table:
    """The group's rows with sequence_id, offset and final; rows that aren't final are dealt again."""
    sizes, uid = table["length"].to_numpy(), table["uid"].to_numpy()
    order = np.lexsort((uid, -sizes))
    bins, place, held = best_fit(sizes[order], setup.capacity)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    bins, place = bins[back], place[back]
    certified = len(held) == lower_bound(np.bincount(sizes, minlength=setup.capacity + 1), setup.capacity)
    name = np.full(len(held), np.iinfo(np.int64).max)
    np.minimum.at(name, bins, uid)  # a sequence goes by its least piece
    final = np.ones(len(sizes), bool) if last or certified else held[bins] == setup.capacity
    table = table.drop_columns(["grp"])
    return table.append_column("sequence_id", pa.array(name[bins])).append_column("offset", pa.array(place)).append_column("final", pa.array(final))


def packer(setup: Setup, last: bool) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        return pack_group(table, setup, last)

    return run


def pack(spark: SparkSession, docs: DataFrame, setup: Setup = Setup(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = common.keep(spark, pieces(docs, setup, key, text), "pieces")
    whole = cut.where(F.col("length") == setup.capacity).select("*", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out, pool = [whole], cut.where(F.col("length") < setup.capacity)
    kind = docs.schema[key].dataType.simpleString()
    before = None
    groups = 0
    for k in range(setup.rounds):
        n = pool.count()
        if not n:
            break
        groups = -(-n // setup.group) if not groups else max(-(-n // setup.max_group), min(-(-groups // setup.fewer), -(-n // setup.group)))
        stuck = before is not None and n > 0.95 * before
        last = k == setup.rounds - 1 or stuck or (before is not None and groups == 1)
        before = n
        dealt = pool.withColumn("grp", F.pmod(F.xxhash64("uid", F.lit(k)), F.lit(groups)).cast("int"))
        packed = dealt.groupBy("grp").applyInArrow(packer(setup, last), _PIECE.format(kind) + ", sequence_id long, offset long, final boolean")
        packed = common.keep(spark, packed, f"round{k}")
        out.append(packed.where("final").drop("final"))
        pool = packed.where("not final").drop("sequence_id", "offset", "final")
        if last:
            break
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    return rows.select(F.col("key").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def certificate(packed: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """sequences, bound, gap of a whole packing, in one row: how many sequences there are, the fewest that any packing of these pieces needs by the same bound, and how many may be saved.

    Only the counts of the lengths, at most `capacity` rows, reach the driver.
    """
    counts = np.zeros(setup.capacity + 1, np.int64)
    for r in packed.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    n, bound = packed.select("sequence_id").distinct().count(), lower_bound(counts, setup.capacity) if counts.any() else 0
    return packed.sparkSession.createDataFrame([(n, int(bound), int(n - bound))], "sequences long, bound long, gap long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, common.read(spark, sf_dir, "documents"))
