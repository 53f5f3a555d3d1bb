"""Vectors compared with all others aren't copied for it: what is shuffled grows with the rows and not with their pairs."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from augsearch.operators import alignment, blocks, curation, pairs
from augsearch.operators.vector_index import VectorIndex
from tests.test_pairs import frame

N, D, BLOCK = 1500, 16, 32


def shuffled(spark, f):
    """What f returns, and the bytes of the shuffle files that it leaves, by those of the vectors."""
    files = lambda: {x: x.stat().st_size for x in Path(spark.sparkContext.getConf().get("spark.local.dir")).rglob("shuffle_*.data") if x.exists()}
    before = files()
    out = f()
    return out, sum(n for x, n in files().items() if x not in before) / (N * D * 8)


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(5).standard_normal((N, D))


@pytest.fixture(scope="module")
def rows(spark, x):
    return frame(spark, x, np.arange(N) // 2).cache()


def ids(rows, name):
    return rows.select(F.col("row").alias(name), F.col("vec").alias("embedding"))


def nearest(x, k, by):
    return [sorted((j for j in range(len(x)) if j != i), key=lambda j: (by[i, j], j))[:k] for i in range(len(x))]


def test_top_k_shuffles_no_copies(spark, x, rows):
    got, times = shuffled(spark, lambda: alignment.top_k(rows, 5, BLOCK).collect())
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = nearest(x, 5, -np.round(u @ u.T, 12))
    assert sorted((r.row, r["rank"], r.other) for r in got) == [(i, n, j) for i, near in enumerate(want) for n, j in enumerate(near, 1)]
    assert times < 12


def test_ties_of_stretched_copies_go_by_row(spark):
    r = np.random.default_rng(6)
    x = np.repeat(r.standard_normal((12, 7)), 25, 0) * r.uniform(0.1, 9, (300, 1))
    x = x[r.permutation(300)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = nearest(x, 6, -np.round(u @ u.T, 12))
    for block in (19, 1000):
        got = alignment.top_k(frame(spark, x, np.zeros(300)), 6, block).collect()
        assert sorted((g.row, g["rank"], g.other) for g in got) == [(i, n, j) for i, near in enumerate(want) for n, j in enumerate(near, 1)]


def test_best_of_floods_of_ties():
    r = np.random.default_rng(7)
    score = np.round(r.standard_normal((20, 400)), 0)
    score[:, ::9] = -np.inf
    for width in (7, 100, 400):
        best = blocks.Best(20, 5)
        for at in r.permutation(range(0, 400, width)):
            best.add(score[:, at : at + width], np.arange(at, min(at + width, 400)))
        i, d, j = best.merged()
        want = [(a, b) for a in range(20) for b in sorted((b for b in range(400) if b % 9), key=lambda b: (-score[a, b], b))[:5]]
        assert list(zip(i.tolist(), j.tolist())) == want


def test_narrow_vectors_lose_nothing(spark):
    x = [[0.1, 1e300, float("nan")], [0.5, -2.0, 0.25], [float(np.float32(0.1)), 0.0, 3.0]]
    for parts in (1, 3):
        got = blocks.narrowed(spark.createDataFrame(list(enumerate(x)), "row long, vec array<double>").repartition(parts), "vec").orderBy("row").collect()
        np.testing.assert_array_equal(blocks.plain([g.vec for g in got], 3), np.array(x))
    with pytest.raises(ValueError):
        blocks.matrix(__import__("pyarrow").array([[1.0], [1.0, 2.0]]))


def accuracy(x, labels, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.mean([any(labels[j] == labels[i] for j in near) for i, near in enumerate(nearest(x, k, -np.round(u @ u.T, 12)))])


def test_top_k_accuracy_shuffles_no_copies(spark, x, rows):
    got, times = shuffled(spark, lambda: alignment.top_k_accuracy(alignment.top_k(rows, 5, BLOCK), rows).first()[0])
    assert got == pytest.approx(accuracy(x, np.arange(N) // 2, 5)) and times < 12


def test_top_k_precision_shuffles_no_copies(spark, x, rows):
    got, times = shuffled(spark, lambda: alignment.top_k_precision(alignment.top_k(rows, 5, BLOCK), rows, 5).first()[0])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == pytest.approx(np.mean([j // 2 == i // 2 for i, near in enumerate(nearest(x, 5, -np.round(u @ u.T, 12))) for j in near])) and times < 12


def test_entity_stability_shuffles_no_copies(spark, x, rows):
    got, times = shuffled(spark, lambda: alignment.entity_stability(alignment.top_k(rows, 5, BLOCK), 5).first()[0])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = nearest(x, 5, -np.round(u @ u.T, 12))
    assert got == pytest.approx(np.mean([len(set(near[i]) & set(near[i + 1])) / 4 for i in range(0, N, 2)])) and times < 12


def test_report_shuffles_no_copies_nor_rows_for_each_tile(spark, x, rows):
    got, times = shuffled(spark, lambda: alignment.report(rows, 5, BLOCK).first())
    assert got.top_k_accuracy == pytest.approx(alignment.top_k_accuracy(alignment.top_k(rows, 5), rows).first()[0]) and times < 20
    partials = pairs.passed(rows, [pairs.MeanRelativeRank()], BLOCK, pairs.best_of_label(rows, BLOCK))
    assert partials.count() == N


def test_metrics_without_partials_keep_their_numbers(spark, x, rows):
    class Counts(pairs.PairMetric):
        name, adds = "counts", "sum"

        def partial(self, tile):
            return tile.row, tile.valid.sum(1)

    out = pairs.passed(rows, [pairs.TopKAccuracy(3), Counts()], 500)
    assert {(r.metric, r["count"]) for r in out.groupBy("metric").count().collect()} == {(-1, 3 * N), (1, N)}
    assert {r.value[0] for r in out.filter("metric = 1").collect()} == {N - 1.0}


def test_density_shuffles_no_copies(spark, x, rows):
    one = ids(rows, "column_id")
    index, _ = shuffled(spark, lambda: VectorIndex.build(one.withColumnRenamed("column_id", "candidate_id"), "l2"))
    got, times = shuffled(spark, lambda: {r.query_id: r.distance for r in curation.density(one, one, 15, index=index).collect()})
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    assert got == {i: pytest.approx(v, abs=1e-9) for i, v in enumerate(np.sort(d, 1)[:, 14])} and times < 12


def test_local_distance_correlation_shuffles_no_copies(spark, x, rows, monkeypatch):
    from augsearch.operators import retrieval

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 100)
    both = rows.select("row", F.col("vec").alias("source"), F.slice("vec", 1, 4).alias("aligned"))
    got, times = shuffled(spark, lambda: alignment.local_distance_correlation(both, 5).first()[0])
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    near = nearest(x, 5, np.round(d, 12))
    r = [abs(np.corrcoef([np.sqrt(d[i, j]) for j in at], [np.linalg.norm(x[i, :4] - x[j, :4]) for j in at])[0, 1]) for i, at in enumerate(near)]
    assert got == pytest.approx(np.mean(r), abs=1e-9) and times < 10


def test_local_distance_correlation_of_unaligned_rows(spark):
    r = np.random.default_rng(8)
    rows = [(str(i), v.tolist(), v[:2].tolist() if i != 3 else None) for i, v in enumerate(r.standard_normal((30, 4)))]
    d = np.array([[np.linalg.norm(np.subtract(a, b)) for _, b, _ in rows] for _, a, _ in rows])
    want = []
    for i, near in enumerate(nearest(d, 5, d)):
        some = [j for j in near if rows[j][2] and rows[i][2]]
        if len(some) > 1:
            want.append(abs(np.corrcoef([d[i, j] for j in some], [np.linalg.norm(np.subtract(rows[i][2], rows[j][2])) for j in some])[0, 1]))
    got = alignment.local_distance_correlation(spark.createDataFrame(rows, "row string, source array<double>, aligned array<double>"), 5, 7).first()[0]
    assert got == pytest.approx(np.mean(want), abs=1e-9)


def test_density_report_shuffles_no_copies(spark, x, rows, monkeypatch):
    from augsearch.operators import retrieval

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 100)
    one = ids(rows, "column_id")
    got, times = shuffled(spark, lambda: curation.density_report(d := curation.density(one, one), d.filter("query_id < 300")).first())
    density = 1 / (np.sort(((x[:, None] - x[None]) ** 2).sum(2), 1)[:, 14] + 1e-12)
    assert (got.ref_median, got.median) == pytest.approx((np.median(density), np.median(density[:300])), abs=1e-9) and times < 12
