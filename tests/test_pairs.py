import numpy as np
import pytest
from pyspark.sql import functions as F

from augsearch.operators import alignment, pairs


def frame(spark, x, labels, parts=3):
    return spark.createDataFrame([(i, int(k), v.tolist()) for i, (v, k) in enumerate(zip(x, labels))], "row long, label long, vec array<double>").repartition(parts)


def plain(x, labels, k):
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    s, n = u @ u.T, len(u)
    same = (labels[:, None] == labels[None, :]) & ~np.eye(n, dtype=bool)
    other = ~np.eye(n, dtype=bool)
    near = [sorted((j for j in range(n) if j != i), key=lambda j: (-s[i, j], j))[:k] for i in range(n)]
    agree = [len(set(near[i]) & set(near[j])) / (k - 1) for i in range(n) for j in range(i + 1, n) if labels[i] == labels[j]]
    rank = [1 - (s[i][other[i]] > s[i][same[i]].max() + 1e-12).sum() / max(n - 2, 1) for i in range(n) if same[i].any()]
    return {
        "mean_cosine": s[other].mean(), "stddev_cosine": s[other].std(), "mean_same_label": s[same].mean(), "stddev_same_label": s[same].std(),
        "top_k_precision": np.mean([labels[j] == labels[i] for i in range(n) for j in near[i]]), "top_k_accuracy": np.mean([any(labels[j] == labels[i] for j in near[i]) for i in range(n)]),
        "entity_stability": np.mean(agree), "mean_relative_rank": np.mean(rank),
    }


@pytest.mark.parametrize("block", [5, 64])
def test_report_whatever_the_blocks(spark, block):
    r = np.random.default_rng(0)
    x, labels = r.standard_normal((40, 8)), np.arange(40) // 3
    labels[20:30] = 3
    got = alignment.report(frame(spark, x, labels), 4, block).first().asDict()
    want = plain(x, labels, 4)
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


class Nearest(pairs.PairMetric):
    """Defined here: the mean similarity of each row to its nearest row of another label."""

    name = "nearest_other"

    def partial(self, tile):
        best = np.where(tile.valid & ~tile.same, tile.sim, -np.inf).max(1)
        return tile.row[np.isfinite(best)], best[np.isfinite(best)]

    def final(self, partials, near, rows):
        return partials.groupBy("key").agg(F.max(F.col("value")[0]).alias("best")).agg(F.avg("best").alias(self.name))


def test_a_metric_of_ones_own(spark):
    r = np.random.default_rng(1)
    x, labels = r.standard_normal((30, 4)), np.arange(30) % 7
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.where(labels[:, None] != labels[None, :], u @ u.T, -np.inf).max(1).mean()
    for parts, block in ((1, 100), (7, 4)):
        got = pairs.evaluate(frame(spark, x, labels, parts), [Nearest(), pairs.MeanRelativeRank()], block).first()
        assert got.nearest_other == pytest.approx(want, abs=1e-12) and got.mean_relative_rank == pytest.approx(plain(x, labels, 3)["mean_relative_rank"])
    with pytest.raises(ValueError):
        pairs.evaluate(frame(spark, x, labels), [Nearest(), Nearest()])


def test_each_pair_of_blocks_once(spark):
    rows = frame(spark, np.eye(30), np.zeros(30)).withColumn("best", F.lit(0.0))

    class Counts(pairs.PairMetric):
        def partial(self, tile):
            return np.zeros(1), np.array([[tile.valid.sum()]])

    out = pairs.passed(rows, [Counts()], block=4).collect()
    assert sum(r.value[0] for r in out) == 30 * 29


def test_moments_of_split_labels(spark):
    r = np.random.default_rng(2)
    x, labels = r.standard_normal((60, 5)) + 1, np.r_[np.zeros(40), np.arange(20)].astype(int)
    x[3] = 0
    want = plain(x, labels, 3)
    for size in (7, 1000):
        got = alignment.similarity_moments(frame(spark, x, labels), size).first().asDict()
        assert got == {k: pytest.approx(want[k], abs=1e-9) for k in got}
    assert alignment.similarity_moments(frame(spark, x, labels).limit(0)).first().mean_cosine == 0
    assert alignment.similarity_moments(frame(spark, x[:1], labels[:1])).first().stddev_same_label == 0

