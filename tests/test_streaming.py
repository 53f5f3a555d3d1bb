import numpy as np
import pytest

from augsearch.operators import alignment
from augsearch.streaming import moments


@pytest.mark.parametrize("cuts", [(0, 60), (0, 7, 8, 40, 60)])
def test_moments_after_any_split(spark, tmp_path, cuts):
    r = np.random.default_rng(0)
    x, labels = r.standard_normal((60, 5)) + 0.5, r.integers(0, 9, 60)
    x[4] = 0
    rows = spark.createDataFrame([(i, int(k), v.tolist()) for i, (v, k) in enumerate(zip(x, labels))], "row long, label long, vec array<double>")
    for a, b in zip(cuts, cuts[1:]):  # files that arrive one after the other, across restarts of the query
        rows.filter(f"row >= {a} and row < {b}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        try:
            moments.accumulate(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", parts=3).awaitTermination(120)
        finally:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        want = alignment.similarity_moments(rows.filter(f"row < {b}")).first().asDict()
        assert moments.moments(spark, f"{tmp_path}/out").first().asDict() == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
