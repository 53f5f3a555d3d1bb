import numpy as np
import pytest
from pyspark.sql import functions as F

from augsearch.operators import curation, retrieval, vector_index
from augsearch.operators.vector_index import VectorIndex


def vectors(spark, x, name, tables=5):
    return spark.createDataFrame([(i, f"t{i % tables}", v.tolist()) for i, v in enumerate(x)], f"{name} long, table_id string, embedding array<double>")


def clustered(n, d=16, groups=40, seed=0, spread=0.05):
    r = np.random.default_rng(seed)
    return r.standard_normal((groups, d))[r.integers(groups, size=n)] + spread * r.standard_normal((n, d))


def rows(df):
    return sorted((r.query_id, r["rank"], r.candidate_id, round(r.distance, 9)) for r in df.collect())


def brute(q, x, k, space, tables=None):
    if space == "cosine":
        q, x = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (q, x))
    d = ((q[:, None] - x[None]) ** 2).sum(2) if space == "l2" else 1 - q @ x.T
    out = []
    for i in range(len(q)):
        order = sorted((round(max(d[i, j], 0.0) if space == "l2" else d[i, j], 12), j) for j in range(len(x)) if not tables or i % tables != j % tables)[:k]
        out += [(i, r, j, round(v, 9)) for r, (v, j) in enumerate(order, 1)]
    return sorted(out)


@pytest.mark.parametrize("space", ["cosine", "l2", "ip"])
def test_equals_brute_force_and_reads_few_cells(spark, space):
    x, q = clustered(3000), clustered(60, seed=7)
    q[:30] = x[:30]
    index = VectorIndex.build(vectors(spark, x, "candidate_id"), space)
    asked = vectors(spark, q, "query_id")
    assert [r[:3] for r in rows(index.nearest(asked, 10))] == [r[:3] for r in brute(q, x, 10, space)]
    read = index.visits(asked, 10)
    assert read.count() == read.distinct().count() < len(q) * len(index.cells.size) / 4


def test_other_tables_ties_and_odd_vectors(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([np.repeat(r.integers(-1, 2, (40, 3)), 6, 0), np.zeros((4, 3))]).astype(float)
    for space in ("cosine", "l2", "ip"):
        index = VectorIndex.build(vectors(spark, x, "candidate_id", 3), space, n_cells=9)
        for k in (1, 7, 500):
            assert rows(index.nearest(vectors(spark, x[::11], "query_id", 3), k)) == rows(retrieval.nearest(vectors(spark, x[::11], "query_id", 3), vectors(spark, x, "candidate_id", 3), k, space))
        found = index.nearest(vectors(spark, x, "query_id", 3), 5, exclude_same_table=True)
        assert [f[:3] for f in rows(found)] == [b[:3] for b in brute(x, x, 5, space, 3)]


def test_large_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "PART", 50)
    monkeypatch.setattr(vector_index, "BLOCK", 20)
    x = clustered(900, 6, groups=3, seed=3)
    index = VectorIndex.build(vectors(spark, x, "candidate_id"), "l2", n_cells=4)
    assert index.cells.size.max() > 200
    assert [r[:3] for r in rows(index.nearest(vectors(spark, x[::9], "query_id"), 8))] == [r[:3] for r in brute(x[::9], x, 8, "l2")]


def test_opened_again(spark, tmp_path):
    x = clustered(300)
    VectorIndex.build(vectors(spark, x, "candidate_id"), "cosine", f"file://{tmp_path}/index")
    again = VectorIndex(f"file://{tmp_path}/index", "cosine", spark)
    assert len(rows(again.nearest(vectors(spark, x[:7], "query_id"), 4))) == 28


def test_empty(spark):
    none = vectors(spark, np.zeros((1, 4)), "candidate_id").limit(0)
    some = vectors(spark, np.ones((3, 4)), "query_id")
    assert VectorIndex.build(none, "l2").nearest(some, 3).collect() == []
    assert VectorIndex.build(vectors(spark, np.ones((3, 4)), "candidate_id"), "l2").nearest(some.limit(0), 3).collect() == []
    nulls = some.withColumn("embedding", F.when(F.col("query_id") > 0, F.col("embedding")))
    assert {r.query_id for r in VectorIndex.build(vectors(spark, np.ones((3, 4)), "candidate_id"), "l2").nearest(nulls, 3).collect()} == {1, 2}


def test_nearest_takes_many_queries_through_the_index(spark, monkeypatch):
    x = clustered(400)
    asked, known = vectors(spark, x, "query_id"), vectors(spark, x, "candidate_id")
    want = rows(retrieval.nearest(asked, known, 6))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 100)
    assert [r[:3] for r in rows(retrieval.nearest(asked, known, 6))] == [r[:3] for r in want]


def test_density_through_the_index(spark):
    x = clustered(300)
    ids = vectors(spark, x, "column_id")
    index = VectorIndex.build(ids.withColumnRenamed("column_id", "candidate_id"), "l2")
    one, two = ({r.query_id: round(r.distance, 9) for r in curation.density(ids, ids, 5, index=i).collect()} for i in (None, index))
    assert one == two
