import numpy as np
import pytest
from pyspark.sql import functions as F

from augsearch.operators import curation


def frame(spark, x, width=4):
    return spark.createDataFrame([(f"{i:0{width}d}", v.tolist()) for i, v in enumerate(x)], "column_id string, embedding array<double>").repartition(5)


def plain(x, k, start, metric):
    d, chosen = np.full(len(x), np.inf), [start]
    while len(chosen) < k:
        d = np.minimum(d, curation._distances(x, x[chosen[-1]], metric))
        e = d.copy()
        e[chosen] = -np.inf
        chosen.append(int(e.argmax()))
    return [f"{i:04d}" for i in chosen]


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_same_order_in_few_passes(spark, metric, monkeypatch):
    x = np.random.default_rng(0).standard_normal((1500, 6))
    if metric == "cosine":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(curation, "WRITTEN_AFTER", 20)
    rows = frame(spark, x).withColumnRenamed("embedding", "v")
    chosen, passes = curation.farthest_first(rows, 80, ("0007", x[7].tolist()), metric, pool=400)
    assert chosen == plain(x, 80, 7, metric) and passes < 80 / 4


def test_ties_and_small_pools(spark):
    x = np.random.default_rng(1).integers(0, 3, (200, 2)).astype(float)
    rows = frame(spark, x).withColumnRenamed("embedding", "v")
    for pool in (1, 30):
        assert curation.farthest_first(rows, 25, ("0000", x[0].tolist()), pool=pool)[0] == plain(x, 25, 0, "euclidean")
    picked = [r.column_id for r in curation.FarthestFirst().curate(frame(spark, np.array([[0.0], [1], [3], [10]]), 1), 3, 0, start="1").orderBy("sel_order").collect()]
    assert picked == ["1", "3", "2"]
    assert curation.FarthestFirst("fft", "cosine").curate(frame(spark, np.array([[1.0, 0], [0, 1], [1, 1]]), 1), 2, 0, start="0").filter(F.col("sel_order") == 1).first().column_id == "1"
