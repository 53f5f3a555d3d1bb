import numpy as np
import pytest

from augsearch.operators import contrastive, projection
from augsearch.operators.contrastive import ContrastiveHeads


def frame(spark, x):
    return spark.createDataFrame([(f"{i:03d}", v.tolist()) for i, v in enumerate(x)], "column_id string, embedding array<double>")


def loss_of(zs, tau):
    z = np.concatenate(zs)
    u = z / np.linalg.norm(z, axis=1, keepdims=True)
    s, label = u @ u.T / tau, np.tile(np.arange(len(zs[0])), len(zs))
    np.fill_diagonal(s, -np.inf)
    out = []
    for i in range(len(z)):
        positive = [j for j in range(len(z)) if j != i and label[j] == label[i]]
        out.append(np.log(np.exp(s[i]).sum()) - s[i][positive].mean())
    return np.mean(out)


@pytest.mark.parametrize("normalization", [None, "batch", "layer"])
@pytest.mark.parametrize("hidden, activation, dropout", [([7], "relu", 0.0), ([6, 5], "silu", 0.3), ([6, 5, 4], "gelu", 0.0)])
def test_numerical_gradients(normalization, hidden, activation, dropout):
    r = np.random.default_rng(3)
    model = ContrastiveHeads(out_dim=3, hidden=hidden, activation=activation, normalization=normalization).start([4, 2, 5], 1)
    xs = [r.standard_normal((6, d)) for d in (4, 2, 5)]
    train = {"seed": 1, "step": 2, "rows": np.arange(6), "dropout": dropout}
    w = contrastive._flat(model.heads)

    def loss(w):
        zs, _ = contrastive.forward(contrastive._shaped(w, model.heads), xs, activation, normalization, train)
        return loss_of(zs, 0.5)

    zs, tape = contrastive.forward(model.heads, xs, activation, normalization, train)
    value, gs, rows = contrastive.nt_xent(zs, 0.5)
    assert value == pytest.approx(loss_of(zs, 0.5)) and rows == 6
    gradient = contrastive.backward(model.heads, tape, gs, activation, normalization)
    for at in r.choice(len(w), 40, replace=False):
        up, down = w.copy(), w.copy()
        up[at] += 1e-6
        down[at] -= 1e-6
        assert gradient[at] == pytest.approx((loss(up) - loss(down)) / 2e-6, rel=1e-3, abs=1e-7)


def test_dropout_is_of_the_row():
    whole = contrastive._kept(1, 2, 0, 1, np.arange(1000), 8, 0.7)
    assert np.array_equal(whole[300:400], contrastive._kept(1, 2, 0, 1, np.arange(300, 400), 8, 0.7)) and abs(whole.mean() - 0.7) < 0.02


@pytest.fixture(scope="module")
def views(spark):
    x = np.random.default_rng(5).standard_normal((90, 4))
    return [frame(spark, x), frame(spark, x[:, ::-1] * 2), frame(spark, x[:, :3])]


@pytest.mark.parametrize("normalization, dropout", [(None, 0.0), ("batch", 0.2)])
def test_one_task_equals_four(views, normalization, dropout):
    one, four = (ContrastiveHeads(out_dim=3, hidden=[6, 5], normalization=normalization, dropout=dropout).fit(views, epochs=2, batch=32, tasks=t) for t in (1, 4))
    for a, b in zip(one.heads, four.heads):
        for p, q in zip(a, b):
            assert all(np.allclose(p[k], q[k], atol=1e-9, rtol=0) for k in p)
    assert [h["train_loss"] for h in one.history] == pytest.approx([h["train_loss"] for h in four.history], abs=1e-9)


def test_a_plain_loop_gives_the_same(views, spark):
    """One epoch of two batches, taken step by step."""
    model = ContrastiveHeads(out_dim=3, hidden=[6]).fit(views[:2], epochs=1, rate=0.05, decay=0.1, batch=50, tasks=3, schedule="constant")
    rows, n = ContrastiveHeads._rows(views[:2], 0)
    order = ContrastiveHeads._dealt(rows, n, 1, np.random.default_rng(0)).orderBy("nth").collect()
    plain = ContrastiveHeads(out_dim=3, hidden=[6]).start([4, 4], 0)
    w = contrastive._flat(plain.heads)
    matrices = np.concatenate([np.full(p.size, float(p.ndim == 2)) for h in plain.heads for layer in h for k in contrastive.LEARNT if k in layer for p in [layer[k]]])
    m, s = np.zeros_like(w), np.zeros_like(w)
    for step, part in enumerate((order[:50], order[50:]), 1):
        xs = [np.array([r[f"v{i}"] for r in part]) for i in range(2)]
        heads = contrastive._shaped(w, plain.heads)
        zs, tape = contrastive.forward(heads, xs, "relu", None)
        g = contrastive.backward(heads, tape, contrastive.nt_xent(zs, 0.1)[1], "relu", None)
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**step) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8) + 0.1 * matrices * w)
    assert np.allclose(contrastive._flat(model.heads), w, atol=1e-9)


def test_training_brings_views_together(spark):
    x = np.random.default_rng(6).standard_normal((120, 4))
    a, b = frame(spark, x), frame(spark, x[:, ::-1])
    model = ContrastiveHeads(out_dim=8, hidden=[16, 16], activation="silu", normalization="batch").fit([a, b], epochs=8, batch=60)
    losses = [h["train_loss"] for h in model.history]
    assert losses[-1] < losses[0] - 0.3 and all(h["seconds"] > 0 for h in model.history)
    pair = [np.array([q.embedding for q in model.project(v, i).orderBy("column_id").collect()]) for i, v in enumerate((a, b))]
    u = [p / np.linalg.norm(p, axis=1, keepdims=True) for p in pair]
    sims = u[0] @ u[1].T
    assert np.diag(sims).mean() > sims.mean() + 0.2
    assert model.evaluate([a, b], batch=120) == pytest.approx(loss_of(pair, 0.1), rel=1e-6)


def test_patience_keeps_the_best_weights(spark):
    r = np.random.default_rng(7)
    x, other = r.standard_normal((60, 4)), r.standard_normal((40, 4))
    train, val = [frame(spark, x), frame(spark, x)], [frame(spark, other), frame(spark, r.standard_normal((40, 4)))]
    model = ContrastiveHeads(out_dim=4).fit(train, epochs=12, rate=0.2, batch=30, validation=val, patience=2, tasks=2, schedule="constant")
    losses = [h["val_loss"] for h in model.history]
    best = int(np.argmin(losses))
    assert len(losses) == best + 3 < 12
    assert model.evaluate(val, batch=30) == pytest.approx(losses[best], abs=1e-9)


def test_schedules():
    rates = [contrastive._rate("one_cycle", 1.0, 0, 1, s, 100) for s in range(100)]
    assert rates[0] == pytest.approx(1 / 25) and max(rates) == pytest.approx(1, abs=1e-3) and rates[-1] < 1e-4 and np.argmax(rates) in (29, 30)
    assert contrastive._rate("cosine", 2.0, 0, 10, 0, 0) == 2 and contrastive._rate("cosine", 2.0, 5, 10, 0, 0) == pytest.approx(1)


def test_refusals(views, spark):
    with pytest.raises(ValueError):
        ContrastiveHeads().fit(views[:1])
    with pytest.raises(ValueError):
        ContrastiveHeads(activation="tanh").start([3])
    with pytest.raises(ValueError):
        ContrastiveHeads().fit(views[:2], schedule="steps")
    with pytest.raises(ValueError):
        ContrastiveHeads().fit([views[0].limit(0), views[1]])
    with pytest.raises(ValueError):
        ContrastiveHeads(out_dim=2).start([4]).project(views[0], 1)


def test_saved_with_norms(spark, views, tmp_path):
    model = ContrastiveHeads(out_dim=3, normalization="batch").fit(views[:2], epochs=1, batch=45, tasks=2)
    projection.save_model(model, f"{tmp_path}/m.json")
    one, two = ([r.embedding for r in m.project(views[1], 1).orderBy("column_id").collect()] for m in (model, projection.load_model(f"{tmp_path}/m.json")))
    assert np.allclose(one, two)
