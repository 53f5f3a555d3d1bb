import numpy as np
import pytest

from augsearch.operators import linkage, projection


def frame(spark, x, width=4):
    return spark.createDataFrame([(f"{i:0{width}d}", v.tolist()) for i, v in enumerate(x)], "column_id string, embedding array<double>")


def plain(x, k):
    """Merges the nearest two clusters by mean distance until k are left."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        best = min((round(d[np.ix_(groups[i], groups[j])].mean(), 12), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


def found(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r.cluster, set()).add(int(r.column_id))
    assert sorted(groups) == list(range(len(groups))) and [min(groups[c]) for c in sorted(groups)] == sorted(min(g) for g in groups.values())
    return {frozenset(g) for g in groups.values()}


def test_average_linkage(spark):
    r = np.random.default_rng(0)
    x = np.concatenate([r.standard_normal((120, 3)), r.standard_normal((80, 3)) * 0.2 + 3])
    rows = frame(spark, x)
    assert found(linkage.average_linkage(rows, 7, block=64)) == plain(x, 7)


def test_few_rows_and_equal_rows(spark):
    x = np.array([[0.0, 0], [0, 0], [0, 0], [5, 5], [5, 5], [9, 0]])
    rows = frame(spark, x)
    assert found(linkage.average_linkage(rows, 3)) == {frozenset({0, 1, 2}), frozenset({3, 4}), frozenset({5})}
    assert found(linkage.average_linkage(rows, 9)) == {frozenset({i}) for i in range(6)}
    assert found(linkage.average_linkage(rows, 1)) == {frozenset(range(6))}
    assert linkage.average_linkage(rows.limit(0), 2).count() == 0


def test_pairs_do_not_depend_on_blocks(spark):
    nodes = linkage._nodes(frame(spark, np.random.default_rng(1).standard_normal((40, 5))))
    one, two = ({(r.a, r.b): round(r["sum"], 12) for r in linkage.pair_distances(nodes, b).collect()} for b in (7, 512))
    assert one == two and len(one) == 40 * 39 // 2


@pytest.mark.parametrize("clustering", ["kmeans", "avg_linkage"])
def test_local_isometry_of_reduced_views(spark, clustering, tmp_path):
    """Two groups, each turned by a rotation of its own: after reduction each is mapped back up to its scale."""
    r = np.random.default_rng(2)
    groups = np.repeat([0, 1], 30)
    base = r.standard_normal((60, 2)) + groups[:, None] * 20
    lift = np.linalg.qr(r.standard_normal((6, 2)))[0].T
    turns = [np.linalg.qr(r.standard_normal((2, 2)))[0] for _ in range(2)]
    turned = np.stack([(b - 20 * g) @ turns[g] + 20 * g for b, g in zip(base, groups)])
    views = [frame(spark, base @ lift, 2), frame(spark, turned @ lift, 2)]
    model = projection.LocalIsometry(clusters=2, clustering=clustering, reduced_dim=2).fit(views)
    projection.save_model(model, f"{tmp_path}/m.json")
    for m in (model, projection.load_model(f"{tmp_path}/m.json")):
        zero, one = (np.array([q.embedding for q in m.project(v, i).orderBy("column_id").collect()]) for i, v in enumerate(views))
        assert zero.shape == one.shape == (60, 2)
        for g in range(2):
            a, b = (z[groups == g] - z[groups == g].mean(0) for z in (zero, one))
            assert np.allclose(a / np.linalg.norm(a), b / np.linalg.norm(b), atol=1e-6)
            assert np.allclose(zero[groups == g].mean(0), one[groups == g].mean(0), atol=1e-6)
    with pytest.raises(ValueError):
        projection.LocalIsometry(clustering="ward").fit(views)


def test_components(spark):
    x = np.random.default_rng(3).standard_normal((50, 5)) @ np.diag([5.0, 3, 1, 0.5, 0.1]) + 2
    c = projection.Components().fit(frame(spark, x), 2)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(c.axes.T @ vt[:2].T), np.eye(2), atol=1e-6) and np.allclose(c.mean, x.mean(0))
    got = np.array([r.embedding for r in c.project(frame(spark, x)).orderBy("column_id").collect()])
    assert np.allclose(np.abs(got), np.abs((u * s)[:, :2]), atol=1e-6)
    assert projection.Components().fit(frame(spark, x[:3]), 9).axes.shape == (5, 3)


def test_low_rank_procrustes(spark):
    """Within 1e-6 of the exact map of the same rank, with two dimensions that differ."""
    r = np.random.default_rng(4)
    x = r.standard_normal((300, 40)) * np.concatenate([np.linspace(6, 3, 8), np.full(32, 0.05)])
    y = x @ np.linalg.qr(r.standard_normal((40, 40)))[0][:, :30] + 1
    source, target = frame(spark, y), frame(spark, x)
    model = projection.Procrustes(rank=6).fit([target, source])
    ms, mt, ns, nt, rotation = model.maps[1]
    a, b = y - y.mean(0), x - x.mean(0)
    u, _, vt = np.linalg.svd(a.T @ b)
    assert np.allclose(rotation, u[:, :6] @ vt[:6], atol=1e-6)
    assert np.allclose(ms, y.mean(0)) and np.allclose(mt, x.mean(0)) and ns == pytest.approx(np.linalg.norm(y)) and nt == pytest.approx(np.linalg.norm(x))
    full = projection.Procrustes(rank=99).fit([target, source]).maps[1][4]
    assert np.allclose(full, projection.Procrustes().fit([target, source]).maps[1][4])
