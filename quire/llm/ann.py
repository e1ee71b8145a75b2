"""Nearest neighbours by inner product with multiprobe p-stable hashing.

Vectors are scaled by the largest norm and lifted by one coordinate to the unit sphere, where the largest inner product is
the least distance. Each of a few tables cuts some Gaussian projections into cells; a vector's cells are its bucket. A query
visits, in every table, its own bucket and then neighbouring ones in the order of their estimated success: by the sum
of the squared distances to the cell walls that lie between, whose order over ranks of walls is
worked out once from their expected values. What the tables find is merged and reranked by the exact inner product in
double precision, over the original vectors.

The number of projections follows the number of vectors. The number of probes is set by the target recall on `calibration`
queries, a fixed bound, whose true neighbours are found in all rows; every row is indexed. As many other queries, whose neighbours are found in the same pass,
then say what recall these probes reach (`Index.recall`), which goes to the log.

Buckets are dealt into parts by hash. A part with many rows, such as a hot bucket's, is cut into blocks, and so are its
queries; each block of rows meets each block of queries in one task, which keeps the nearest of every query.

Defined cases: a vector that is null, zero, of another length than most, or holds null or non-finite components takes no
part, nor does a row without an id; of rows that share an id every distinct vector is indexed and asked for, and an id's
best score counts; ties go to the smaller id; fewer other ids than asked give all of them; a query whose buckets hold
too few is answered from all rows; an empty table, or one without queries, gives an empty result.
"""

from __future__ import annotations

import heapq
import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quire.llm import common

_PARTIAL = "query_id long, ids binary, scores binary"


@dataclass(frozen=True)
class Setup:
    k: int = 20
    tables: int = 6
    #: Width of a cell, on the unit sphere, to begin with.
    width: float = 1.5
    #: Sample recall that the number of probes must reach; a margin above the 0.9 that is promised.
    recall: float = 0.96
    calibration: int = 64
    #: Probes of a table that are tried for that; cells are widened where they don't suffice.
    most_probes: int = 2048
    part_rows: int = 8192
    block_rows: int = 32_768
    block_queries: int = 4096
    seed: int = 11


@dataclass(frozen=True)
class Index:
    """What hashing needs: sizes that don't depend on the number of vectors, but for its logarithm."""

    norm: float
    directions: np.ndarray  # tables x (dimension + 1) x projections
    shifts: np.ndarray  # tables x projections
    odd: np.ndarray  # tables x projections, uint64
    width: float
    steps: np.ndarray  # probes x 2 projections: the walls crossed, by rank of their distance
    recall: float = float("nan")  # of queries that the probes weren't fitted on

    def project(self, x: np.ndarray, own: bool) -> np.ndarray:
        """tables x rows x projections, in cells. own: queries are scaled to the sphere themselves."""
        if own:
            y = np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))])
        else:
            y = x / self.norm
            y = np.hstack([y, np.sqrt(np.maximum(0.0, 1 - (y * y).sum(1)))[:, None]])
        return (np.einsum("nd,tdk->tnk", y, self.directions) + self.shifts[:, None]) / self.width

    def probes(self, x: np.ndarray) -> np.ndarray:
        """tables x probes: the buckets that one query visits, in order."""
        p = self.project(x[None], True)[:, 0]
        cell = np.floor(p)
        low = p - cell
        k = cell.shape[1]
        rank = np.argsort(np.argsort(np.hstack([low, 1 - low]), axis=1, kind="stable"), axis=1)  # of the wall below each projection, then above
        out = np.empty((len(cell), len(self.steps)), np.int64)
        for t in range(len(cell)):
            move = self.steps[:, rank[t, k:]].astype(np.int64) - self.steps[:, rank[t, :k]]
            out[t] = bucket_numbers(self.odd[t], t, cell[t] + move)
        return out


def bucket_numbers(odd: np.ndarray, number: int, cells: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (cells.astype(np.int64).astype(np.uint64) * odd).sum(-1, dtype=np.uint64) + np.uint64(number + 1) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))).astype(np.int64)


def wall_steps(k: int, probes: int) -> np.ndarray:
    """probes x 2k: which walls each probe crosses, by rank of distance, in the order of the expected sum of squared distances.

    The j-th least of the 2k distances has a known expectation for a uniform place in the cell; a probe may not cross
    both walls of a projection, which are ranks j and 2k + 1 - j. The first probe crosses none.
    """
    j = np.arange(1, k + 1)
    near = j * (j + 1) / (4 * (k + 1) * (k + 2))
    far = 1 - (2 * k + 1 - np.arange(k + 1, 2 * k + 1)) / (k + 1) + (2 * k + 1 - np.arange(k + 1, 2 * k + 1)) * (2 * k + 2 - np.arange(k + 1, 2 * k + 1)) / (4 * (k + 1) * (k + 2))
    cost = [*near.tolist(), *far.tolist()]
    out = [()]
    heap = [(cost[0], (0,))]
    while heap and len(out) < probes:
        c, walls = heapq.heappop(heap)
        last = walls[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (c - cost[last] + cost[last + 1], (*walls[:-1], last + 1)))
            heapq.heappush(heap, (c + cost[last + 1], (*walls, last + 1)))
        if all(2 * k - 1 - w not in walls for w in walls):
            out.append(walls)
    steps = np.zeros((len(out), 2 * k), np.int8)
    for i, walls in enumerate(out):
        steps[i, list(walls)] = 1
    return steps


def _dot(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, summed alike for equal rows wherever they stand."""
    return (x * q).sum(axis=1)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best ids, each by its best score."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - 3 * k)[len(scores) - 3 * k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(ids))
    order = _firsts(ids, some[np.lexsort((ids[some], -scores[some]))])
    if len(order) < min(k, len(ids)) and len(some) < len(ids):  # copies took the places
        order = _firsts(ids, np.lexsort((ids, -scores)))
    return order[:k]


def _firsts(ids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The places in order at which an id comes for the first time."""
    return order[np.sort(np.unique(ids[order], return_index=True)[1])]


def _rows(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def usable(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """id, x (array of double) of the rows that take part, and the length of x."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(vector, lambda v: v != 0)
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(finite)
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    return rows.where(F.size("x") == d).distinct(), d


def exact(rows: DataFrame, queries: list[tuple[int, list[float]]], k: int, d: int) -> DataFrame:
    """place (in the list), id, score, x of the k nearest ids of a bounded list of queries, over all rows in blocks."""
    ids, q = np.array([i for i, _ in queries], np.int64), np.array([x for _, x in queries], np.float64).reshape(-1, d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.empty(0, np.int64), np.empty(0), np.empty((0, d))) for _ in ids]
        for b in batches:
            own, x = b.column(0).to_numpy(zero_copy_only=False), _rows(b.column(1), d)
            for n, (i, y) in enumerate(zip(ids.tolist(), q, strict=True)):
                other = own != i
                a = np.concatenate([held[n][0], own[other]]), np.concatenate([held[n][1], _dot(x[other], y)]), np.concatenate([held[n][2], x[other]])
                best = _best(a[0], a[1], k)
                held[n] = a[0][best], a[1][best], a[2][best]
        for n, (a, s, x) in enumerate(held):
            yield pa.record_batch([pa.array([n] * len(a), pa.int64()), pa.array(a), pa.array(s), pa.array(x.tolist(), pa.list_(pa.float64()))], ["place", "id", "score", "x"])

    near = rows.mapInArrow(run, "place long, id long, score double, x array<double>")
    near = near.groupBy("place", "id").agg(F.max("score").alias("score"), F.max_by("x", "score").alias("x"))
    w = Window.partitionBy("place").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fit(rows: DataFrame, asked: Column, d: int, setup: Setup) -> Index | None:
    """Norm and number of all rows, then as many probes as the calibration queries need. None without rows or queries."""
    norm, n = rows.agg(F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))), F.count("*")).first()
    some = rows.where(asked).orderBy(F.xxhash64("id", "x"), "id", "x").limit(2 * setup.calibration).collect()
    if not n or not some:
        return None
    k = max(4, round(math.log(n, 4)))
    queries = [(r["id"], r["x"]) for r in some]
    true: dict[int, list[list[float]]] = {}
    for r in exact(rows, queries, setup.k, d).collect():  # calibration x k rows
        true.setdefault(r["place"], []).append(r["x"])
    known = [(np.array(x), np.array(true[i])) for i, (_, x) in enumerate(queries) if i in true]
    asked_of, others = known[: setup.calibration], known[setup.calibration :]
    width = setup.width
    while True:
        rng = np.random.default_rng(setup.seed)
        directions = rng.normal(size=(setup.tables, d + 1, k))
        shifts = rng.random((setup.tables, k)) * width
        odd = rng.integers(0, 2**62, (setup.tables, k), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        full = Index(norm, directions, shifts, odd, width, wall_steps(k, setup.most_probes))
        places = sorted(p for x, near in asked_of for p in _first_probes(full, x, near))
        need = places[min(len(places) - 1, math.ceil(setup.recall * len(places)) - 1)] + 1 if places else 1
        if need <= len(full.steps):
            index = replace(full, steps=full.steps[:need])
            reached = [p < need for x, near in others for p in _first_probes(index, x, near)]
            index = replace(index, recall=sum(reached) / len(reached) if reached else float("nan"))
            logging.getLogger(__name__).info("%d probes in each of %d tables of %d projections; recall %.3f on %d other queries", need, setup.tables, k, index.recall, len(others))
            return index
        width *= 1.25  # the recall isn't reached by any number of probes: wider cells hold more


def _first_probes(index: Index, x: np.ndarray, near: np.ndarray) -> list[int]:
    """For each of the vectors near x, the number of the first probe, over all tables, that finds it; the number of probes if none does."""
    probes, cells = index.probes(x), np.floor(index.project(near, False))
    at = np.full(len(near), len(index.steps))
    for t in range(len(index.odd)):
        seen: dict[int, int] = {}
        for place, key in enumerate(probes[t].tolist()):
            seen.setdefault(key, place)
        at = np.minimum(at, [seen.get(key, len(index.steps)) for key in bucket_numbers(index.odd[t], t, cells[t]).tolist()])
    return at.tolist()


def nearest(spark: SparkSession, vectors: DataFrame, asked: Column, key: str = "vec_id", vector: str = "embedding", setup: Setup = Setup()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which `asked` (over the column id) holds."""
    found, d = usable(vectors, key, vector)
    rows = common.keep(spark, found, "vectors")
    index = fit(rows, asked, d, setup)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parts = max(1, math.ceil(rows.count() * setup.tables / setup.part_rows))
    shared = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            if b.num_rows:
                cells = np.floor(index.project(_rows(b.column(1), d), False))
                for t in range(len(cells)):
                    keys = bucket_numbers(index.odd[t], t, cells[t])
                    yield pa.record_batch([pa.array((keys % parts).astype(np.int32)), pa.array(keys), b.column(0), b.column(1)], ["part", "bucket", "id", "x"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in common.sliced(batches):  # a query's row is repeated for each part
            at, own, buckets = [], [], []
            for n, x in enumerate(_rows(b.column(1), d)):
                keys = np.unique(index.probes(x).ravel())
                part = keys % parts
                order = np.argsort(part, kind="stable")
                keys, part = keys[order], part[order]
                cut = np.flatnonzero(np.diff(part, prepend=-1))
                own += part[cut].tolist()
                buckets += [k.astype("<i8").tobytes() for k in np.split(keys, cut[1:])]
                at += [n] * len(cut)
            at = pa.array(at, pa.int64())
            yield pa.record_batch([pa.array(own, pa.int32()), pa.array(buckets, pa.binary()), b.column(0).take(at), b.column(1).take(at)], ["part", "buckets", "id", "x"])

    data = rows.mapInArrow(place, "part int, bucket long, id long, x array<double>")
    stored = (lambda df: df.withColumn("x", F.col("x").cast("array<float>"))) if _single(vectors, vector) else (lambda df: df)  # what was single stays so
    queries = common.keep(spark, stored(rows.where(asked).mapInArrow(visit, "part int, buckets binary, id long, x array<double>")), "probes")
    data = common.keep(spark, stored(data), "buckets")
    cut = data.groupBy("part").agg(F.ceil(F.count("*") / setup.block_rows).cast("int").alias("s")).join(queries.groupBy("part").agg(F.ceil(F.count("*") / setup.block_queries).cast("int").alias("c")), "part")
    left = data.join(cut, "part").withColumn("i", F.pmod(F.xxhash64("id", "x"), "s").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    right = queries.join(cut, "part").withColumn("j", F.pmod(F.xxhash64("id", "x"), "c").cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))

    def meet(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and queries.num_rows:
            bucket, ids, x = rows["bucket"].to_numpy(), rows["id"].to_numpy(), _rows(rows["x"], d)
            order = np.argsort(bucket, kind="stable")
            bucket, ids, x = bucket[order], ids[order], x[order]
            for q, own, y in zip(queries["id"].to_pylist(), queries["buckets"].to_pylist(), _rows(queries["x"], d), strict=True):
                keys = np.frombuffer(own, "<i8")
                lo, hi = np.searchsorted(bucket, keys), np.searchsorted(bucket, keys, "right")
                some = [np.arange(a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if b > a]
                if some:
                    c = np.concatenate(some)
                    c = c[ids[c] != q]
                    rough = x[c] @ y
                    if len(c) > 8 * setup.k:  # the same row may come from every table
                        many = min(len(c) - 1, setup.k * setup.tables)
                        near = c[rough >= np.partition(rough, len(rough) - 1 - many)[len(rough) - 1 - many] - 1e-9 * (1 + np.abs(rough).max())]
                        c = near if len(np.unique(ids[near])) >= setup.k else c  # else one id's vectors took the places
                    score = _dot(x[c], y)
                    best = _best(ids[c], score, setup.k)
                    out.append((q, ids[c][best].astype("<i8").tobytes(), score[best].astype("<f8").tobytes()))
        return pa.table([pa.array([o[n] for o in out], t) for n, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["query_id", "ids", "scores"])

    partial = left.select("part", "i", "j", "bucket", "id", "x").groupBy("part", "i", "j").cogroup(right.select("part", "i", "j", "buckets", "id", "x").groupBy("part", "i", "j")).applyInArrow(meet, _PARTIAL)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, scores = None, [], []

        def done() -> pa.RecordBatch:
            a, s = np.concatenate(ids), np.concatenate(scores)
            best = _best(a, s, setup.k)
            n = len(best)
            return pa.record_batch([pa.array([at] * n, pa.int64()), pa.array(range(1, n + 1), pa.int32()), pa.array(a[best]), pa.array(s[best])], ["query_id", "rank", "vec_id", "score"])

        for b in batches:
            for q, i, s in zip(*(b.column(n).to_pylist() for n in range(3)), strict=True):
                if q != at:
                    if at is not None:
                        yield done()
                    at, ids, scores = q, [], []
                ids.append(np.frombuffer(i, "<i8"))
                scores.append(np.frombuffer(s, "<f8"))
                if len(ids) >= 1024:  # an id may have any number of vectors
                    a, v = np.concatenate(ids), np.concatenate(scores)
                    best = _best(a, v, setup.k)
                    ids, scores = [a[best]], [v[best]]
        if at is not None:
            yield done()

    def merged(partial: DataFrame) -> DataFrame:
        return partial.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")

    found = common.keep(spark, merged(partial), "found")
    full = min(setup.k, rows.select("id").distinct().count() - 1)
    asking = rows.where(asked)
    short = asking.select("id").distinct().join(found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n")), "id", "left").where(F.coalesce("n", F.lit(0)) < full).select("id")
    short = common.keep(spark, asking.join(short, "id", "left_semi"), "short")
    if short.isEmpty():
        return found
    rest = common.keep(spark, merged(_over_all(rows, short, d, setup)), "rest")
    return found.join(rest.select("query_id").distinct(), "query_id", "left_anti").unionByName(rest)


def _over_all(rows: DataFrame, short: DataFrame, d: int, setup: Setup) -> DataFrame:
    """query_id, ids, scores of the nearest ids of each vector of short: each block of rows meets each block of queries in one task."""
    s, c = (max(1, math.ceil(x.count() / n)) for x, n in ((rows, setup.block_rows), (short, setup.block_queries)))

    def meet(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and queries.num_rows:
            ids, x = rows["id"].to_numpy(), _rows(rows["x"], d)
            for q, y in zip(queries["id"].to_pylist(), _rows(queries["x"], d), strict=True):
                other = ids != q
                score = _dot(x[other], y)
                best = _best(ids[other], score, setup.k)
                out.append((q, ids[other][best].astype("<i8").tobytes(), score[best].astype("<f8").tobytes()))
        return pa.table([pa.array([o[n] for o in out], t) for n, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["query_id", "ids", "scores"])

    mine = F.xxhash64("id", "x")
    left = rows.select(F.pmod(mine, F.lit(s)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(c - 1))).alias("j"), "id", "x")
    right = short.select(F.explode(F.sequence(F.lit(0), F.lit(s - 1))).alias("i"), F.pmod(mine, F.lit(c)).cast("int").alias("j"), "id", "x")
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(meet, _PARTIAL)


def _single(vectors: DataFrame, vector: str) -> bool:
    return vectors.schema[vector].dataType.simpleString() == "array<float>"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, common.read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
