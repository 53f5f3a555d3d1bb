import random

import numpy as np

from augsearch.llm.components import components
from augsearch.llm.embedding_dedup import near_duplicates, passes_for, query
from tests.llm import brute


def test_components(spark):
    r = random.Random(1)
    for n, m in ((40, 30), (300, 200), (60, 0)):
        links = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1040)] * (m > 0) + [(5000, i) for i in range(5001, 5100)] * (m > 0)
        got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
        used = {x for a, b in links if a != b for x in (a, b)}
        assert got == brute.components(used, [p for p in links if p[0] != p[1]])


def truth(rows, threshold=0.93):
    ok = [(i, label, np.array(e, float) / np.abs(np.array(e, float)).max()) for i, label, e in rows if label is not None and e and None not in e and np.isfinite(np.array(e, float)).all() and np.any(e)]
    links = {i: 0 for i, *_ in rows}
    pairs = []
    for x in range(len(ok)):
        for y in range(x):
            (i, a, u), (j, b, v) = ok[x], ok[y]
            if a == b and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= threshold:
                links[i] += 1
                links[j] += 1
                pairs.append((i, j))
    return links, brute.components(links, pairs)


def check(df, least=1.0):
    links, comp = truth([(r.vec_id, r.label, r.embedding) for r in df.collect()])
    got = {r.vec_id: r for r in near_duplicates(df).collect()}
    assert got.keys() == links.keys()
    assert all(got[i].n_links <= n for i, n in links.items())
    assert sum(r.n_links for r in got.values()) >= least * sum(links.values())
    assert sum(got[i].component_id == comp[i] for i in comp) >= least * len(comp)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_against_brute_force(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.99)


def test_planted(spark):
    r = np.random.default_rng(0)
    rows = []
    for c in range(30):
        centre = r.standard_normal(16)
        for k in range(r.integers(1, 6)):
            rows.append((len(rows), int(c % 3), (centre + 0.1 * r.standard_normal(16)).tolist()))
    rows += [(1000 + i, 1, [1.0] * 16) for i in range(50)] + [(2000, 1, [1.01] + [1.0] * 15)]
    rows += [(3000, None, [1.0] * 16), (3001, 1, None), (3002, 1, []), (3003, 1, [0.0] * 16), (3004, 1, [float("nan")] + [1.0] * 15), (3005, 1, [None] + [1.0] * 15), (3006, 1, [float("inf")] * 16), (3007, 1, [1.0] * 4), (3008, 1, [1e-300] * 16), (3009, 1, [1e300] * 16)]
    df = spark.createDataFrame([(*x, "z") for x in rows], "vec_id long, label int, embedding array<double>, links string").repartition(4)
    check(df)
    assert near_duplicates(df.limit(0)).collect() == []
    got = near_duplicates(df.unionByName(spark.createDataFrame([(None, 1, [1.0] * 16, "z"), (1000, 1, [1.0] * 16, "z")], df.schema))).collect()
    assert len(got) == len(rows) + 2
    one = [x for x in got if x.vec_id is None]
    assert [(x.n_links, x.component_id) for x in one] == [(0, None)]


def test_blocks_count_every_link(spark):
    """A component of many blocks, far larger than the window."""
    r = np.random.default_rng(1)
    centre = r.standard_normal(8)
    rows = [(i, 0, (centre + 0.02 * r.standard_normal(8)).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = near_duplicates(df, passes=4, window=4, block=20, assured=None).collect()
    assert {(x.n_links, x.component_id) for x in got} == {(299, 0)}


def test_recall(spark):
    """Isolated pairs just above the threshold, evenly spread and around a common direction: links are found, and nothing else links."""
    r, rows, n = np.random.default_rng(5), [], 8000
    for label, mean in ((0, 0.0), (1, 0.8)):
        x = r.standard_normal((n, 64)) + mean
        y = r.standard_normal(x.shape)
        y -= (y * x).sum(1, keepdims=True) / (x * x).sum(1, keepdims=True) * x  # orthogonal to x
        cosine = r.uniform(0.931, 0.95, (n, 1))
        y = cosine * x / np.linalg.norm(x, axis=1, keepdims=True) + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
        rows += [(label * 2 * n + k, label, v.tolist()) for k, v in enumerate(np.concatenate([x, y]))]
    got = {g.vec_id: (g.n_links, g.component_id) for g in near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(8)).collect()}
    unit = [np.array([v / np.linalg.norm(v) for _, label, e in rows if label == k for v in [np.array(e)]]) for k in (0, 1)]
    for k, u in enumerate(unit):
        first = k * 2 * n
        true = sum(int((u[a : a + 1000] @ u.T >= 0.93).sum()) for a in range(0, 2 * n, 1000)) - 2 * n
        found = sum(got[first + a][0] for a in range(2 * n))
        assert true >= 2 * n and 0.99 * true <= found <= true
        assert sum(got[first + a][1] == got[first + a + n][1] for a in range(n)) >= 0.99 * n


def grouped(groups, inner, n, seed):
    """Vectors around centres, of which a third have a near one; inner: mean cosine within a group."""
    r = np.random.default_rng(seed)
    centres = r.standard_normal((groups, 64))
    x = centres[r.integers(groups, size=n)] * np.sqrt(inner / (1 - inner)) + r.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = r.standard_normal((n // 3, 64))
    y -= (y * x[: n // 3]).sum(1, keepdims=True) * x[: n // 3]
    y = 0.937 * x[: n // 3] + np.sqrt(1 - 0.937**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    return np.concatenate([x, y])


def true_links(u):
    """Links of each vector, and the least vector reachable from each."""
    links, up = np.zeros(len(u), int), np.arange(len(u))
    near = [np.nonzero(u[a : a + 500] @ u.T >= 0.93) for a in range(0, len(u), 500)]
    i, j = np.concatenate([x + 500 * k for k, (x, _) in enumerate(near)]), np.concatenate([y for _, y in near])
    np.add.at(links, i, 1)
    while True:
        low = up.copy()
        np.minimum.at(low, i, up[j])
        if np.array_equal(low, up):
            return links - 1, up
        up = low[low]


def test_recall_of_tight_groups(spark):
    """Labels of several tight groups, which no mean describes, beside an even one: no link is lost in the former."""
    shapes = [(4, 0.88), (10, 0.85), (40, 0.88), (40, 0.8)]
    u = [grouped(g, inner, 6000, k) for k, (g, inner) in enumerate(shapes)] + [grouped(6000, 0.01, 6000, 9)]
    rows = [(100_000 * k + i, k, v.tolist()) for k, x in enumerate(u) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(8)
    got = {g.vec_id: (g.n_links, g.component_id) for g in near_duplicates(df).collect()}
    for k, x in enumerate(u):
        links, up = true_links(x)
        found = np.array([got[100_000 * k + i] for i in range(len(x))])
        assert (found[:, 0] <= links).all() and found[:, 0].sum() >= (0.99 if k == len(shapes) else 0.998) * links.sum()
        assert (found[:, 1] - 100_000 * k == up).mean() >= (0.99 if k == len(shapes) else 0.998)


def test_full_comparison(spark):
    """Every label is compared in full: links, components and hot groups are those of brute force."""
    r = np.random.default_rng(11)
    centres = r.standard_normal((12, 8))
    rows = [(i, i % 2, (centres[i % 12] + 0.25 * r.standard_normal(8)).tolist()) for i in range(300)] + [(400 + i, 0, (centres[0] + 0.05 * r.standard_normal(8)).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(5)
    links, comp = truth(rows)
    for block in (16, 512):
        got = {g.vec_id: (g.n_links, g.component_id) for g in near_duplicates(df, block=block, assured=1.0, window=1000).collect()}
        assert got == {i: (links[i], comp[i]) for i in links}


def test_windows_reach_over_the_edges_of_tasks(spark):
    """With one pass and a small window, whatever one range of the order finds more ranges find too."""
    r = np.random.default_rng(9)
    centres = r.standard_normal((40, 16))
    rows = [(i, 0, (centres[i % 40] + 0.12 * r.standard_normal(16)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    before, results = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("1", "7", "60"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(sorted(map(tuple, near_duplicates(df, passes=1, window=3, assured=None).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(x[1] for x in results[0]) > 400
    for more in results[1:]:
        assert all(a[0] == b[0] and a[1] <= b[1] and a[2] >= b[2] for a, b in zip(results[0], more))


def test_vectors_of_one_vec_id(spark):
    """Different vectors of one vec_id have counts of their own."""
    rows = [(1, 0, [1.0, 0.0, 0.0]), (1, 0, [0.0, 1.0, 0.0]), (2, 0, [1.0, 0.01, 0.0]), (3, 0, [1.0, 0.0, 0.01])]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).select("vec_id", "n_links", "component_id").collect()))
    assert got == [(1, 0, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1)]


def test_passes_follow_size_and_spread():
    sizes = [passes_for(n, 1.0, 0.93, 24, 0.999) for n in (10, 500, 40_000, 10**6, 10**9)]
    assert sizes == sorted(sizes) and sizes[0] == 1 and sizes[-1] < 200
    assert passes_for(40_000, 0.4, 0.93, 24, 0.999) > sizes[2]


def test_query(spark, sf_dir):
    assert query(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
