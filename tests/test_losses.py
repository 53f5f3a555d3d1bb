import numpy as np
import pytest

from augsearch.operators import alignment


def plain(inputs, recons, froms, tos):
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = lambda x, y: 1 - (unit(x) * unit(y)).sum(1).mean()

    def space(x, y):
        x, y = unit(x), unit(y)
        d = min(x.shape[1], y.shape[1])
        return np.abs(x @ x.T - y @ y.T).mean() + np.abs(x @ x.T - y[:, :d] @ x[:, :d].T).mean()

    return (
        np.mean([cosine(x, y) for x, y in zip(inputs, recons)]), np.mean([space(x, y) for x, y in zip(inputs, recons)]),
        np.mean([cosine(inputs[0], f) for f in froms] + [cosine(inputs[i + 1], t) for i, t in enumerate(tos)]),
        np.mean([space(inputs[0], t) for t in tos] + [space(inputs[i + 1], f) for i, f in enumerate(froms)]),
    )


@pytest.mark.parametrize("dims", [(128, 128), (128, 256, 512)])
def test_vec2vec(spark, dims):
    r = np.random.default_rng(0)
    batches, rows = {}, []
    for batch, n in ((0, 4), (1, 7)):
        inputs, recons = [r.standard_normal((n, d)) for d in dims], [r.standard_normal((n, d)) for d in dims]
        froms, tos = [r.standard_normal((n, dims[0])) for _ in dims[1:]], [r.standard_normal((n, d)) for d in dims[1:]]
        batches[batch] = plain(inputs, recons, froms, tos)
        rows += [(batch, i, *[[x[i].tolist() for x in xs] for xs in (inputs, recons, froms, tos)]) for i in range(n)]
    df = spark.createDataFrame(rows, "batch long, sample long, inputs array<array<double>>, recons array<array<double>>, from_inverted array<array<double>>, to_inverted array<array<double>>")
    for got in alignment.vec2vec(df, 1.0, 0.5, 2.0).collect():
        rec, vsp, cc, cycle = batches[got.batch]
        assert tuple(got[1:]) == pytest.approx((rec, vsp * 0.5, cc * 2, cycle * 2), abs=1e-7)
    perfect = df.withColumn("recons", df.inputs)
    assert all(abs(g.rec_loss) < 1e-7 and g.vsp_loss == pytest.approx(0, abs=1e-12) for g in alignment.vec2vec(perfect).collect())

