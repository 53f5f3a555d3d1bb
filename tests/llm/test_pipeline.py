import os
import random
import re

import numpy as np

import corpus_pipeline as p
from augsearch.llm import common, ngram_join
from augsearch.llm.common import discard, written
from augsearch.llm.langid import FEATURES, LanguageModel
from tests.llm import brute
from tests.llm.test_ngram_join import shingles
from tests.llm.test_packing import check as check_packing
from tests.llm.test_suffix_dedup import truth


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    step = {}
    for name, stage in p.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        step[name] = {r.doc_id: r for r in docs.collect()}
    # language ID: what has a letter stays as it is
    want = {i: r for i, r in rows.items() if any(c.isalpha() for c in r.text or "")}
    assert step["language ID"] == want
    # exact dedup
    first: dict = {}
    for i in sorted(want):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", want[i].text), i)
    want = {i: want[i] for i in first.values()}
    assert step["exact dedup"] == want
    # near duplicates
    sets = {i: shingles(r.text) for i, r in want.items()}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if 0.8 * len(sets[a]) <= len(sets[b]) <= 1.25 * len(sets[a]) and 100 * (n := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    assert links
    want = {i: want[i] for i, c in brute.components(ids, links).items() if i == c}
    assert step["n-gram Jaccard join"] == want
    # repeated passages
    left = {i: r.text for i, r in step["suffix-array dedup"].items()}
    sizes = {i[1]: n - gone for i, n, gone, _, _ in truth([(r.doc_id, r.text) for r in want.values()])}
    assert left.keys() == {i for i, n in sizes.items() if n > 0}
    assert all(sizes[i] - 8 <= len(t.encode()) <= sizes[i] for i, t in left.items())
    assert all(r.n_chars == len(r.text) for r in step["suffix-array dedup"].values())
    # packing
    check_packing(p.STAGES[-1][1](spark, docs, sf_dir).collect(), left, 2048)


def test_near_keeps_what_shares_by_chance(spark, monkeypatch):
    """Texts that share a few shingles with others are not connected by them: the stage stores the sets of near copies alone."""
    r = random.Random(2)
    runs = [r.choices("abcdefgh", k=6) for _ in range(151)]
    texts = [" ".join([*runs[i], *(f"w{r.randrange(10**6)}" for _ in range(100)), *runs[i + 1]]) for i in range(150)]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate([*texts, texts[5] + " end", texts[9] + " end"])]
    stored = {}

    def write(df, name, *a, write=ngram_join.written):
        out = write(df, name, *a)
        stored[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "written", write)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert {x.doc_id for x in p.near(spark, docs, "").collect()} == set(range(150))
    assert stored["near"] == 4 and stored["sets"] < 20


def test_run_and_odd_rows(spark, tmp_path):
    rows = [(1, "hello there friend", "en", "a", 5), (1, "hello there friend", "en", "a", 5), (2, None, "en", "a", 0), (3, "12", None, None, None), (None, "no id here", "en", "b", 1), (4, "hello  there friend", "en", "b", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = p.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (True, 0)]
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert p.run(spark, f"{tmp_path}/none").collect() == []


def test_language_stage(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(-1, "what", None, "a", 4), (-2, "12", None, "a", 2)], docs.schema)
    known = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    # nothing to learn from: what has a letter stays
    blank = docs.union(odd).withColumn("lang", p.F.lit(None).cast("string"))
    assert {r.doc_id for r in p.language_id(spark, blank, sf_dir).collect()} == known | {-1}
    # the calibrated score decides: with logits (x, 0, 0, 0) it is 0.25 for x = 0 and 0.475 for x = 1
    for x, stay in ((0.0, set()), (1.0, known)):
        model = LanguageModel(list("abcd"), np.zeros((4, FEATURES), np.float32), np.array([x, 0, 0, 0]), 1.0)
        monkeypatch.setattr(p.langid, "fit", lambda *_, model=model: model)
        assert {r.doc_id for r in p.language_id(spark, docs, sf_dir).collect()} == stay


def test_tables_that_are_read_stay(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    for folder in (f"{tmp_path}/a b", f"file:{tmp_path}/c", f"file://{tmp_path}/d"):
        kept, gone = f"{folder}/kept", f"{folder}/gone"
        for path in (kept, gone):
            docs.write.parquet(path)
        df = spark.read.parquet(kept)
        assert discard([kept, gone], df) == [kept] and df.count() == 60
        assert not os.path.exists(gone.removeprefix("file:").replace("///", "/"))
    # a stage called before an earlier result is read leaves what that result reads
    early = p.near(spark, docs, sf_dir)
    p.exact(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    assert 0 < early.count() <= 60


CLASHES = ["score", "lang_pred", "text of the prediction", "kept_id", "kept_sha", "text_sha256", "ats", "masks", "th", "id", "none", "sha", "row", "of", "of th", "component_id", "n", "token", "a.b", "back`tick", "TEXT_"]


def test_clashing_columns(spark, sf_dir):
    """Every stage returns extra columns as they are, whatever their names."""
    plain = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80)
    wide = plain.select("*", *[p.F.concat(p.F.lit(c), p.F.col("doc_id")).alias(c) for c in CLASHES])
    for name, stage in p.STAGES[:-1]:
        want, got = stage(spark, plain, sf_dir).collect(), stage(spark, wide, sf_dir)
        assert got.columns == wide.columns, name
        rows = got.collect()
        assert sorted(tuple(r)[:5] for r in rows) == sorted(map(tuple, want)), name
        assert all(r[5 + i] == f"{c}{r[0]}" for r in rows for i, c in enumerate(CLASHES)), name
    assert sorted(map(tuple, p.packed(spark, wide, sf_dir).collect())) == sorted(map(tuple, p.packed(spark, plain, sf_dir).collect()))


def test_results_outlive_other_runs(spark, sf_dir, tmp_path, monkeypatch):
    """Whatever form the shared folder's path has."""
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).write.parquet(f"{tmp_path}/documents.parquet")
    counts = set()
    for folder in (f"{tmp_path}/x", f"file:{tmp_path}/y", f"file://{tmp_path}/z"):
        monkeypatch.setattr(common, "shared_folder", lambda _, folder=folder: folder)
        first, second = p.run(spark, str(tmp_path)), p.run(spark, str(tmp_path))
        counts |= {first.count(), second.count()}
    assert len(counts) == 1 and counts.pop() > 0
