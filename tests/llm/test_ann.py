"""Nearest neighbours against brute force."""

import numpy as np
from pyspark.sql import functions as F

from quire.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, x int, id int, bucket int"


def brute(rows, asked, k):
    good = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and len(v) == 8 and all(c is not None and np.isfinite(c) for c in v) and any(v):
            good[i] = min(good.get(i, v), v)
    out = {}
    for q, v in good.items():
        if asked(q):
            s = sorted(((-float((np.array(w, float) * np.array(v, float)).sum()), i) for i, w in good.items() if i != q))[:k]
            out[q] = [i for _, i in s]
    return out


def test_recall_and_order(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.array(table["embedding"].tolist(), float), table["vec_id"].to_numpy()
    got = ann.query(spark, sf).toPandas()
    hits = n = 0
    for q, rows in got.groupby("query_id"):
        rows = rows.sort_values("rank")
        s = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        hits += len(set(ids[order]) & set(rows["vec_id"]))
        n += len(order)
        assert rows["rank"].tolist() == list(range(1, len(rows) + 1)) and (np.diff(rows["score"]) <= 0).all() and q not in set(rows["vec_id"])
        assert np.allclose(rows["score"], [s[ids == i][0] for i in rows["vec_id"]], rtol=0, atol=1e-12)
    assert set(got["query_id"]) == set(ids[ids % 20 == 0]) and hits / n >= 0.9


def test_edges(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype("f4").tolist(), 0, 1, 2, 3) for i in range(40)]
    same = rng.normal(size=8).astype("f4").tolist()
    rows += [(100 + i, same, 0, 1, 2, 3) for i in range(60)]  # copies: ties go to the smaller id
    rows += [(40, None, 0, 1, 2, 3), (60, [0.0] * 8, 0, 1, 2, 3), (80, [1.0, None] + [0.0] * 6, 0, 1, 2, 3), (200, [float("nan")] * 8, 0, 1, 2, 3), (220, [float("inf")] * 8, 0, 1, 2, 3), (240, [1.0, 2.0], 0, 1, 2, 3), (None, same, 0, 1, 2, 3)]
    rows += [rows[0], rows[50], (20, [9.0] * 8, 0, 1, 2, 3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {}
    for r in ann.nearest(spark, df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute(rows, lambda q: q % 20 == 0, 20)
    assert set(got) == set(want)
    assert np.mean([len(set(got[q]) & set(w)) / len(w) for q, w in want.items()]) >= 0.9
    assert got[100] == want[100]
    few = spark.createDataFrame(rows[:3], SCHEMA)
    assert [r["vec_id"] for r in ann.nearest(spark, few, F.col("id") == 0).orderBy("rank").collect()] == brute(rows[:3], lambda q: q == 0, 20)[0]
    for none in (spark.createDataFrame([], SCHEMA), spark.createDataFrame(rows[1:3], SCHEMA)):
        assert ann.nearest(spark, none, F.col("id") % 20 == 0).count() == 0


def test_every_vector_of_an_id_counts(spark):
    """A third of the rows carries one id; its vectors are found and asked for like any other's."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).astype("f4").tolist(), 0, 1, 2, 3) for i in range(1, 101)] + [(200, rng.normal(size=8).astype("f4").tolist(), 0, 1, 2, 3) for _ in range(50)]
    got = ann.nearest(spark, spark.createDataFrame(rows + rows[-3:], SCHEMA).repartition(4), F.col("id") % 20 == 0).collect()
    x, ids, found = np.array([r[1] for r in rows], float), np.array([r[0] for r in rows]), {}
    for r in got:
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    s, hits = x @ x.T, 0
    for q in (20, 40, 60, 80, 100, 200):
        best = {i: s[np.ix_(ids == q, ids == i)].max() for i in set(ids.tolist()) - {q}}
        want = sorted(best, key=lambda i: (-best[i], i))[:20]
        hits += len(set(want) & set(found[q]))
        assert 200 in found[q] or 200 not in want
    assert hits / 120 >= 0.9 and np.isclose(found[20][200], s[ids == 20][:, ids == 200].max())


def test_isolated_queries_are_answered_in_full(spark):
    """Tight groups need one probe; vectors far from all groups still get their 20."""
    rng = np.random.default_rng(6)
    rows = []
    for g in range(100):
        centre = rng.normal(size=8) * 3
        rows += [(20 * (30 * g + n) if n == 0 else 20 * (30 * g + n) + 1, (centre + rng.normal(size=8) * 1e-3).astype("f4").tolist(), 0, 1, 2, 3) for n in range(30)]
    lone = [(200_000 + 20 * n, (rng.normal(size=8) * 1e-2).astype("f4").tolist(), 0, 1, 2, 3) for n in range(3)]
    got = {}
    for r in ann.nearest(spark, spark.createDataFrame(rows + lone, SCHEMA).repartition(4), F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(got) == {r[0] for r in rows + lone if r[0] % 20 == 0} and {len(v) for v in got.values()} == {20}
    two = [(i, rng.normal(size=8).astype("f4").tolist(), 0, 1, 2, 3) for i in range(20, 41)]
    got = ann.nearest(spark, spark.createDataFrame(two, SCHEMA), F.col("id") % 20 == 0).groupBy("query_id").count().collect()
    assert sorted(map(tuple, got)) == [(20, 20), (40, 20)]


def test_blocks_change_nothing(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    a = ann.nearest(spark, df, F.col("id") % 20 == 0).collect()
    b = ann.nearest(spark, df, F.col("id") % 20 == 0, setup=ann.Setup(block_rows=50, block_queries=3, part_rows=100)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_wall_order():
    """Expected sums rise along the probes, and no probe crosses both walls of a projection."""
    k = 5
    steps = ann.wall_steps(k, 200).astype(bool)
    j = np.arange(1, k + 1)
    near = j * (j + 1) / (4 * (k + 1) * (k + 2))
    cost = np.concatenate([near, 1 - (k + 1 - j[:k]) / (k + 1) + (k + 1 - j) * (k + 2 - j) / (4 * (k + 1) * (k + 2))])
    total = (steps * cost).sum(1)
    assert (np.diff(total) >= -1e-12).all() and not (steps & steps[:, ::-1]).any() and len({tuple(s) for s in steps}) == len(steps)


def test_cells_widen_until_the_recall_is_reached(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows, d = ann.usable(table, "vec_id", "embedding")
    index = ann.fit(rows, F.col("id") % 20 == 0, d, ann.Setup(most_probes=2))
    assert index.width > ann.Setup().width and len(index.steps) <= 2
    x, ids = np.array(table.toPandas()["embedding"].tolist(), float), table.toPandas()["vec_id"].to_numpy()
    hits = n = 0
    for r in ann.nearest(spark, table, F.col("id") % 20 == 0, setup=ann.Setup(most_probes=2)).groupBy("query_id").agg(F.collect_set("vec_id").alias("v")).collect():
        s = x @ x[ids == r["query_id"]][0]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != r["query_id"]][:20]
        hits, n = hits + len(set(ids[order].tolist()) & set(r["v"])), n + len(order)
    assert hits / n >= 0.9


def test_recall_is_reported_on_other_queries(spark, sf):
    rows, d = ann.usable(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding")
    index = ann.fit(rows, F.col("id") % 2 == 0, d, ann.Setup(calibration=16))
    assert 0.85 <= index.recall <= 1
