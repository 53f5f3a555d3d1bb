"""Operators against fixtures and brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from augsearch.functions import text, vectors
from augsearch.functions.vectors import squared_distances
from augsearch.operators import alignment, curation, encoders, projection, prompts, ranges, retrieval, splits
from augsearch.sources import collection, logs, results, views

CELL = "table_id string, col_ord int, col_name string, row_ord long, value string"


def cells(spark, **tables):
    rows = [(t, i, c, r, v) for t, columns in tables.items() for i, (c, values) in enumerate(columns.items()) for r, v in enumerate(values)]
    return spark.createDataFrame(rows, CELL)


def prompt_map(df):
    return {r.prompt_id: r.prompt for r in df.collect()}


def test_sanitize(spark):
    names = ["*", "a::b", "^x$", "^a::b$", "plain", ":::", "^", "$"]
    got = [r.s for r in spark.createDataFrame([(n,) for n in names], "n string").select(text.sanitize(F.col("n")).alias("s")).collect()]
    assert got == [text.sanitize_str(n) for n in names]
    assert got[:4] == ["\\*", "a:\\:b", "\\^x$\\", "\\^a:\\:b$\\"]


def test_table_of(spark):
    row = spark.createDataFrame([("a::b::c",), ("x",)], "n string").select(text.table_of(F.col("n")).alias("l"), text.table_of(F.col("n"), "first").alias("f")).collect()
    assert [tuple(r) for r in row] == [("a::b", "a"), ("x", "x")]


def test_two_decimals(spark):
    df = spark.createDataFrame([(0.125,), (2.675,), (None,), (1.0,)], "x double")
    assert [r[0] for r in df.select(text.two_decimals(F.col("x"))).collect()] == ["0.12", "2.67", None, "1.00"]


def test_prompts_of_sample_table(spark):
    c = cells(spark, test_table={"col1": ["apple", "banana", "apple", "cherry"], "col2": ["red", "yellow", "red", "red"], "col3": ["fruit"] * 4}, empty_table={"a": [None] * 3}, mixed={"e": [None] * 3, "full": ["a", "b", "c"], "part": ["x", None, "y"]})
    got = prompt_map(prompts.DeepJoinStrategy().prompts(c))
    assert set(got) == {"test_table::col1", "test_table::col2", "test_table::col3", "mixed::full", "mixed::part"}
    assert got["test_table::col1"] == "Column 'col1' contains 4 values with lengths (min, max, mean): (5, 6, 5.50). Values: apple, banana, cherry"
    assert prompt_map(prompts.DeepJoinStrategy(mode="original").prompts(c))["mixed::part"] == "mixed. part contains 2 values (1, 1, 1.00): x, y"
    assert prompt_map(prompts.CellStrategy().prompts(c))["mixed::part::1"] == "y"
    with pytest.raises(ValueError):
        prompts.DeepJoinStrategy(mode="x")


def test_colliding_headers(spark):
    c = cells(spark, test={"col::1": ["a", "b"], "col:\\:1": ["c", "d"]})
    assert prompt_map(prompts.ColumnStrategy().prompts(c)) == {"test::col:\\:1": "a, b"}


@pytest.mark.parametrize("collate, values, most, want", [
    ("str_cat", ["apple", "banana", "cherry"], 10, "apple, ban"), ("str_cat", ["a", "", "b"], None, "a, , b"), ("str_cat", ["b", "a", "b"], None, "b, a"),
    ("freq_cat", list("abacab"), None, "a, b, c"), ("freq_cat", ["apple"] * 3 + ["banana"] + ["cherry"] * 2, 10, "apple, che"), ("freq_cat", ["🍎"] * 3 + ["🍌"] + ["🍒"] * 2, None, "🍎, 🍒, 🍌"),
])
def test_collate(spark, collate, values, most, want):
    assert prompt_map(prompts.ColumnStrategy(collate=collate, max_length=most).prompts(cells(spark, t={"c": values}))) == {"t::c": want}


def test_unknown_collate():
    with pytest.raises(AttributeError):
        prompts.collate_fn("nope")


def test_scores(spark):
    one = spark.range(1).select(prompts.tf_idf(F.lit(5), F.lit(2), F.lit(10)).alias("t"), prompts.bm25(F.lit(5), F.lit(2), F.lit(10), F.lit(10), F.lit(10)).alias("b")).first()
    assert one.t == pytest.approx(5 * (math.log(11 / 3) + 1)) and one.b == pytest.approx(math.log(8.5 / 2.5 + 0.25) * 12.5 / 6.5)
    s = spark.createDataFrame([("p", "apple", 3.0), ("p", "banana", 5.0), ("p", "cherry", 1.0)], "prompt_id string, term string, score double")
    assert prompts.score_cat(s).first().text == "banana, apple, cherry"
    assert prompts.score_cat(s, max_length=13).first().text == "banana, apple"
    assert prompts.score_cat(s, max_length=3).first().text == ""
    c = cells(spark, t={"a": ["  apple  ", "apple", " banana ", "banana"], "b": ["apple", "x", None, None]})
    got = prompt_map(prompts.RankedStrategy(method="tf_idf").prompts(c))
    assert set(got["t::a"].split(", ")) == {"apple", "banana"}


def test_hashing_encoder(spark):
    df = spark.createDataFrame([("a", "hello world"), ("b", "hello world"), ("c", "other text"), ("d", "")], "prompt_id string, prompt string")
    got = {r.prompt_id: np.array(r.embedding) for r in encoders.HashingEncoder(dim=32).embed(df).collect()}
    assert (got["a"] == got["b"]).all() and np.linalg.norm(got["a"]) == pytest.approx(1) and not np.allclose(got["a"], got["c"])
    assert not got["d"].any()
    assert len(encoders.HashingEncoder().embed(df, truncate_dim=8).first().embedding) == 8
    f = encoders.FunctionEncoder("len", 2, lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert {r.prompt_id: r.embedding[0] > 0.99 for r in f.embed(df).collect()} == {"a": True, "b": True, "c": True, "d": False}
    with pytest.raises(ValueError):
        encoders.FunctionEncoder("a/b", 1, list)


def test_requests(spark):
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate([5, 5, 1, 20, 3, 3, 3])], "s string, i int, n_tokens long")
    got = [r.request for r in sorted(encoders.request_batches(df, "s", "i", 10, 3).collect(), key=lambda r: r.i)]
    assert got == [0, 0, 1, 2, 3, 3, 3]


@pytest.mark.parametrize("tokens,prompts_", [(50, 5), (10**9, 7), (9, 1000), (100, 30)])
def test_requests_over_ranges(spark, tokens, prompts_):
    """A part that spans all ranges, one of null, small ones; against the fold itself."""
    r = random.Random(tokens)
    rows = [(r.choice(["hot"] * 6 + ["a", "b", None]), i, r.choice([0, 1, 3, 9, 120, None])) for i in range(3000)]
    parts = {}
    for s, i, n in rows:
        parts.setdefault(s, []).append((i, n or 0))
    want = {}
    for part in parts.values():
        request, held, count = 0, 0, 0
        for i, n in part:
            if count and (held + n > tokens or count >= prompts_):
                request, held, count = request + 1, 0, 0
            held, count = held + n, count + 1
            want[i] = request
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "s string, i int, n_tokens long").repartition(5)
    got = encoders.request_batches(df, "s", "i", tokens, prompts_)
    assert got.columns == ["s", "i", "n_tokens", "request"]
    assert {x.i: x.request for x in got.collect()} == want
    assert encoders.request_batches(df.limit(0), "s", "i").collect() == []


def test_numbers_over_ranges(spark):
    rows = [(None if i % 3 else "g", (i * 37) % 1000, None if i == 5 else f"x{i % 11}") for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, i int, t string").repartition(4)
    got = sorted((x.i, x.nth) for x in ranges.numbered(df, ["i"]).collect())
    assert got == [(i, i) for i in range(1000)]
    key = lambda x: (x[2] is not None, x[2] or "", x[1])
    for g in {x[0] for x in rows}:
        want = [x[1] for x in sorted((x for x in rows if x[0] == g), key=key)]
        assert [x.i for x in sorted((x for x in ranges.numbered(df, ["t", "i"], ["g"]).collect() if x.g == g), key=lambda x: x.nth)] == want
    assert ranges.numbered(df.limit(0), ["i"]).collect() == []
    same = ranges.numbered(df.limit(9).selectExpr("1 as i"), ["i"]).collect()
    assert sorted(x.nth for x in same) == list(range(9))


def test_squared_distances():
    r = np.random.default_rng(1)
    x, c = r.normal(size=(30, 5)), r.normal(size=(4, 5))
    assert np.allclose(squared_distances(x, c), ((x[:, None] - c[None]) ** 2).sum(2))


def test_assignment_is_optimal():
    r = np.random.default_rng(0)
    for _ in range(200):
        n, m = map(int, r.integers(1, 5, 2))
        cost = r.integers(0, 10, (n, m)).astype(float)
        rows, columns = retrieval.assignment(cost)
        small, large = min(n, m), max(n, m)
        c = cost if n <= m else cost.T
        best = min(sum(c[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        assert cost[rows, columns].sum() == best and len(set(rows)) == len(set(columns)) == small


def test_table_score():
    assert retrieval.table_score(np.array([[0.95, 0.2], [0.3, 0.0]])) == pytest.approx(0.25)  # two matches before one better
    assert retrieval.table_score(np.array([[0.05]])) == 0 and retrieval.table_score(np.array([[0.5, 0.9]])) == pytest.approx(0.9)


def test_union_discovery(spark):
    rows = [(f"{t}{i}", t, v) for t, vs in {"a": [[1, 0, 0], [0, 1, 0]], "b": [[1, 0.1, 0], [0, 1, 0.1]], "c": [[0, 0, 1]]}.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame([(c, t, [float(x) for x in v]) for c, t, v in rows], "column_id string, table_id string, embedding array<double>")
    got = retrieval.union_discovery(df.filter("table_id = 'a'"), df, 5).orderBy("rank").collect()
    assert [r.candidate_id for r in got] == ["a", "b", "c"] and got[0].score == pytest.approx(1) and got[2].score == 0


def test_retrieval_metrics(spark):
    res = spark.createDataFrame([("q", f"c{i}", i) for i in range(1, 6)], "query_id string, candidate_id string, rank int")
    truth = spark.createDataFrame([("q", "c2"), ("q", "c4"), ("q", "z"), ("none", "c1")], "query_id string, candidate_id string")
    got = {(r.query_id, r.k): r for r in retrieval.metrics(res, truth, (1, 5)).collect()}
    r = got["q", 5]
    assert (r.precision, r.recall, r.max_precision, r.max_recall, r.hits, r.mrr) == pytest.approx((2 / 5, 2 / 3, 3 / 5, 1, 1, 0.5)) and r.ap == pytest.approx((1 / 2 + 2 / 4) / 3)
    assert got["q", 1].ap == 0 and got["none", 5].precision == 0
    assert {r.query_id for r in retrieval.metrics(res, truth, (1,), keep_unanswered=False).collect()} == {"q"}
    assert retrieval.wide(retrieval.metrics(res, truth, (1, 5)), (1, 5)).columns[1:3] == ["precision@1", "precision@5"]
    with pytest.raises(ValueError):
        retrieval.nearest(res, res, 1, "nope")


def matrix(spark, x):
    return spark.createDataFrame([(f"{i:04d}", [float(v) for v in row]) for i, row in enumerate(x)], "column_id string, embedding array<double>")


def test_farthest_first(spark):
    order = lambda c, x, k, start: [int(r.column_id) for r in c.curate(matrix(spark, x), k, 0, start).orderBy("sel_order").collect()]
    assert order(curation.FarthestFirst(metric="cosine"), [[1, 0], [0, 1], [1, 1]], 2, "0000") == [0, 1]
    assert order(curation.FarthestFirst(), [[0], [1], [3], [10]], 3, "0001") == [1, 3, 2]


def test_grid_and_random(spark):
    square = matrix(spark, [[0, 0], [0, 1], [1, 0], [1, 1], [1, 0.9]])
    assert len({r.cell for r in curation.grid_cells(square, 2).collect()}) == 4
    got = curation.GridSampling(grid_size=2).curate(square, 4, 1).collect()
    picked = {r.column_id for r in got}
    assert {"0000", "0001", "0002"} <= picked and len(picked) == 4  # no cell twice before all once
    assert [r.sel_order for r in curation.RandomSampling().curate(square, 3, 1).orderBy("sel_order").collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        curation.grid_cells(square, 0)
    assert curation.size_of(1.0, 7) == 7 and curation.size_of(1, 7) == 1 and curation.size_of(0.5, 7) == 3
    with pytest.raises(ValueError):
        curation.size_of(8, 7)


def test_k_medoids(spark):
    got = {r.column_id for r in curation.KMedoids(metric="cosine").curate(matrix(spark, [[1, 0], [0.9, 0.1], [0, 1], [0.1, 0.9]]), 2, 3).collect()}
    assert len(got & {"0000", "0001"}) == 1 and len(got & {"0002", "0003"}) == 1


def test_reduced(spark):
    r = np.random.default_rng(0)
    x = np.outer(r.standard_normal(60), [3, 4, 0]) + [5, 5, 5] + 0.01 * r.standard_normal((60, 3))
    got = curation.reduced(matrix(spark, x), 0.9).collect()
    assert len(got[0].embedding) == 1 and abs(np.mean([g.embedding[0] for g in got])) < 1e-6


def test_alignment_fixtures(spark):
    rows = lambda data: spark.createDataFrame([(i, label, [float(v) for v in vec]) for i, (label, vec) in enumerate(data)], "row long, label long, vec array<double>")
    six = rows([(0, [1, 0])] * 3 + [(1, [0, 1])] * 3)
    near = alignment.top_k(six, 2, block=4)
    assert alignment.top_k_precision(near, six, 2).first()[0] == 1 and alignment.top_k_accuracy(near, six).first()[0] == 1
    eye = rows([(i, np.eye(3)[i]) for i in range(3)])
    m = alignment.similarity_moments(eye, label_rows=2).first()
    assert m.mean_cosine == pytest.approx(0) and m.mean_same_label == 0
    assert alignment.similarity_moments(rows([(0, [1, 0]), (1, [-1, 0])])).first().mean_cosine == pytest.approx(-1)
    assert alignment.mean_relative_rank(rows([(0, [1, 0]), (0, [1, 0]), (1, [0, 1]), (1, [0, 1])])).first()[0] == 1
    assert alignment.mean_relative_rank(rows([(0, [1, 0]), (0, [-1, 0.1]), (1, [1, 0.01]), (1, [-1, 0])])).first()[0] < 0.9
    assert alignment.mean_relative_rank(six, block=3).first()[0] == 1


def test_projection(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((80, 4))
    q, _ = np.linalg.qr(r.standard_normal((4, 4)))
    q[:, 0] *= np.sign(np.linalg.det(q))  # no reflection
    a, b = matrix(spark, x), matrix(spark, x @ q)
    model = projection.Procrustes().fit([a, b])
    got = np.array([r_.embedding for r_ in model.project(b, 1).orderBy("column_id").collect()])
    assert np.allclose(got, x, atol=1e-8)
    same = np.array([r_.e for r_ in b.select("column_id", model.expression(F.col("embedding"), 1).alias("e")).orderBy("column_id").collect()])
    assert np.allclose(same, got)
    assert alignment.procrustes_error(b, a) == pytest.approx(0, abs=1e-6)
    with pytest.raises(ValueError):
        model.project(b, 5)
    local = projection.LocalIsometry(clusters=2).fit([a, b])
    got = np.array([r_.embedding for r_ in local.project(b, 1).orderBy("column_id").collect()])
    centres, parts = local.maps[1]
    y = x @ q
    near = ((y[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    for g, (ms, mt, rot, scale) in enumerate(parts):
        a_, b_ = x[near == g] - x[near == g].mean(0), y[near == g] - y[near == g].mean(0)
        u, sv, vt = np.linalg.svd(b_.T @ a_)
        assert np.allclose(rot, u @ vt, atol=1e-6) and scale == pytest.approx(np.linalg.norm(sv) / (b_**2).sum())
        assert np.allclose(got[near == g], scale * b_ @ u @ vt + x[near == g].mean(0), atol=1e-6)


def test_models_are_saved(spark, tmp_path):
    x = matrix(spark, np.random.default_rng(2).standard_normal((30, 3)))
    for model in (projection.Naive([3, 2]), projection.Procrustes().fit([x, x]), projection.ContrastiveHeads(out_dim=4).start([3, 3])):
        projection.save_model(model, f"{tmp_path}/m.json")
        back = projection.load_model(f"{tmp_path}/m.json")
        one, two = ([r.embedding for r in m.project(x, 1).orderBy("column_id").collect()] for m in (model, back))
        assert np.allclose(one, two)


def test_splits(spark):
    assert splits.split_counts(10, [0.5, 0.3, 0.2]) == [5, 3, 2] and sum(splits.split_counts(7, [0.5, 0.25, 0.25])) == 7
    with pytest.raises(ValueError):
        splits.check_fractions([0.5, 0.4])
    df = spark.range(101).toDF("id")
    for seed in (None, 5):
        got = splits.split(df, "id", [0.6, 0.2, 0.2], seed).groupBy("split").count().orderBy("split").collect()
        assert [r["count"] for r in got] == splits.split_counts(101, [0.6, 0.2, 0.2])


def test_collection(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,--\n2,b\n,"q"\n')
    (tmp_path / "b.tsv").write_text("*\tn\nfoo\t1.5\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "bad.parquet").write_bytes(b"junk")
    (tmp_path / "skip.txt").write_text("x")
    spark.createDataFrame([(1, "u")], "k int, s string").toPandas().to_parquet(tmp_path / "c.pq")
    got = {(r.table_id, r.col_name, r.row_ord): r.value for r in collection.cells(spark, str(tmp_path)).collect()}
    assert got["a.csv", "y", 0] is None and got["a.csv", "y", 1] == "b" and got["b.tsv", "*", 0] == "foo" and got["c.pq", "k", 0] == "1"
    assert {t for t, *_ in got} == {"a.csv", "b.tsv", "c.pq"}
    assert {r.col_name for r in collection.cells(spark, str(tmp_path), "string").collect()} == {"y", "*", "s"}
    assert [r.table_id for r in collection.discover(spark, str(tmp_path), 2).orderBy("table_id").collect()] == ["a.csv", "b.tsv"]
    assert [r.batch for r in collection.in_batches(collection.discover(spark, str(tmp_path)), 2).orderBy("table_id").collect()] == [0, 0, 1, 1]  # an empty file is none
    with pytest.raises(ValueError):
        collection.discover(spark, str(tmp_path), 0)
    with pytest.raises(ValueError):
        collection.in_batches(spark.range(1), 0)
    assert collection.read_any(spark, f"{tmp_path}/a.csv").columns == ["x", "y"]
    with pytest.raises(ValueError):
        collection.read_any(spark, "x.xlsx")
    with pytest.raises(ValueError):
        collection.require_columns(spark.range(1), ["query_table"], "queries")
    chosen = spark.createDataFrame([("b.tsv::\\*",)], "column_id string")
    collection.write_curated(collection.cells(spark, str(tmp_path)), chosen, f"{tmp_path}/curated")
    assert [r.value for r in spark.read.parquet(f"{tmp_path}/curated").collect()] == ["foo"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.csv").write_text("h\nv\n")
    collection.csv_to_parquet(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert [r.h for r in spark.read.parquet(f"{tmp_path}/out/t.pq").collect()] == ["v"]
    assert [r.col_name for r in collection.parquet_schemas(spark, f"{tmp_path}/out").collect()] == ["h"]


def test_views(spark, tmp_path):
    x = matrix(spark, np.eye(3))
    views.write_view(x, str(tmp_path), "m-a", seed=1)
    views.write_view(x, str(tmp_path), "m-b")
    assert views.metadata(spark, str(tmp_path), "m-a") == {"pipeline": "m-a", "embedding_shape": [3, 3], "embedding_dtype": "float32", "seed": 1}
    assert views.read_views(spark, str(tmp_path), ["m-a", "m-b"]).count() == 6
    views.write_view(matrix(spark, np.eye(4)[3:, :3]).withColumn("column_id", F.lit("new")), str(tmp_path), "m-b", append=True)
    with pytest.raises(ValueError):
        views.read_views(spark, str(tmp_path), ["m-a", "m-b"])
    with pytest.raises(Exception, match="(?i)exists"):
        views.write_view(x, str(tmp_path), "m-a")
    np.save(tmp_path / "embeddings.npy", np.eye(3, dtype=np.float32))
    np.save(tmp_path / "column_ids.npy", np.array(["a", "b", "c"]))
    assert {r.column_id for r in views.read_npy_view(spark, str(tmp_path)).collect()} == {"a", "b", "c"}
    assert views.resolve(["M.1-a"], ["m_1-A"]) == ["M.1-a"] and views.resolve(["a"], ["a", "b"]) is None
    with pytest.raises(NotImplementedError):
        views.read_hdf5_view("x")


def test_logs(spark, tmp_path):
    (tmp_path / "x.log").write_text('noise\n2025-01-02 03:04:05 | INFO | a.b:1 | Experiment configuration: {"k": 1}\n2025-01-02 03:04:06 | INFO | a.b:2 | Epoch 3, loss: 1.5, test_acc: nan\n2025-01-02 03:04:07 | WARNING | a.b:3 | other\n')
    r = logs.read_logs(spark, str(tmp_path))
    rows = r.orderBy("line_no").collect()
    assert [x.experiment for x in rows] == [1, 1, 1] and rows[0].config == '{"k": 1}' and str(rows[0].at) == "2025-01-02 03:04:05"
    m = {(x.kind, x.name): x.value for x in logs.metrics(r).collect()}
    assert m["epoch", "loss"] == 1.5 and math.isnan(m["test", "acc"])


def test_results(spark, tmp_path):
    df = results.with_literals(spark.createDataFrame([("q", 1.0)], "query_id string, p double"), dataset="d")
    results.write_results(df, f"{tmp_path}/r")
    assert spark.read.option("header", True).csv(f"{tmp_path}/r").first().dataset == "d"
    with pytest.raises(ValueError):
        results.write_results(df, f"{tmp_path}/r", "xls")


def test_pooled(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 6.0]), ("b", [1.0, 1.0])], "k string, v array<double>")
    assert {r.k: r.v for r in vectors.pooled(df, "k", "v", "median").collect()} == {"a": [2.0, 4.0], "b": [1.0, 1.0]}
    with pytest.raises(ValueError):
        vectors.pooled(df, "k", "v", "mode")


def test_streamed_columns(spark, tmp_path):
    from augsearch.streaming.ingest import ingest

    c = cells(spark, t={"c": ["x", "y"]})
    c.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = ingest(spark, f"{tmp_path}/in", CELL, prompts.DeepJoinStrategy(), encoders.HashingEncoder(dim=8), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert [r.column_id for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["t::c"]
