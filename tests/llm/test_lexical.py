import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from augsearch.llm import lexical
from tests.oracle import assert_same, connect

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k=50):
    bags = [(d, Counter(w), len(w)) for d, t in docs if (w := plain_terms(t))]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, c, _ in bags for t in c)
    queries = {}
    for i, t in items:
        queries.setdefault(i, set()).update(plain_terms(t))
    out = []
    for item, wanted in queries.items():
        scored = []
        for d, c, n in bags:
            m = 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if score > 0:
                scored.append((-score, d is not None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, **options):
    found = lexical.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **options)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_sql(spark, sf_dir):
    assert_same(lexical.query(spark, sf_dir), lexical.SQL, connect(sf_dir))


def test_edges(spark):
    docs = [(1, "Alpha beta, beta"), (2, None), (3, ""), (4, "!?"), (5, "alpha BETA beta"), (5, "alpha beta beta"), (None, "Ünder ünder alpha"), (7, "beta " * 20000 + "rare"), (8, "x_y z9"), (9, "nothing here")]
    items = [(1, "alpha beta"), (2, None), (3, "..."), (4, "Ünder"), (4, "rare unknown"), (5, "Y 9 z9"), (None, "here")]
    for k in (1, 2, 50):
        assert run(spark, docs, items, k=k) == brute(docs, items, k)
    assert run(spark, docs, items, shard=1) == brute(docs, items)
    assert run(spark, [], items) == [] == run(spark, docs, [])


def test_extra_columns(spark):
    docs = spark.createDataFrame([(1, "alpha", 5, 0)], "doc_id long, text string, score int, term int")
    items = spark.createDataFrame([(1, "alpha", 3)], "item_id long, text string, doc_id int")
    assert len(lexical.search(docs, items).collect()) == 1


def test_ties_go_by_id(spark):
    docs = [(i, "same words here") for i in range(300, 0, -1)]
    assert [r[2] for r in sorted(run(spark, docs, [(1, "same")], shard=64, k=5))] == [1, 2, 3, 4, 5]


def test_blocks_of_queries(spark, monkeypatch):
    docs = [(i, f"w{i % 7} w{i % 11} w{i % 13}") for i in range(100)]
    items = [(i, f"w{i} w{i + 1}") for i in range(12)]
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 5)
    assert run(spark, docs, items, k=4) == brute(docs, items, 4)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), min_size=1, max_size=8), min_size=1, max_size=30), st.lists(st.integers(0, 5), min_size=1, max_size=6, unique=True), st.integers(1, 4))
def test_best_positions(docs, query, k):
    """The k highest are found, whatever the order of the lists."""
    bags = [Counter(d) for d in docs]
    term, doc, gain = (np.array(c, np.int64) for c in zip(*[(t, i, 7 * n // (1 + len(docs[i])) + t) for i, b in enumerate(bags) for t, n in b.items()]))
    lists = lexical.Lists(term, doc, gain, 6, len(docs))
    want = sorted(s for i in range(len(docs)) if (s := int(gain[(doc == i) & np.isin(term, query)].sum())) > 0)[::-1][:k]
    for _ in range(2):  # marks are taken back
        found, scores, _ = lists.ranked(np.array(query), k, np.zeros(0, np.int64), step=1)
        assert len(set(found.tolist())) == len(found)
        assert sorted(scores[scores > 0].tolist())[::-1][:k] == want


def test_stops_early():
    """Where one list falls steeply, most documents are never met."""
    n = 20000
    term = np.tile([0, 1], n)
    doc, gain = np.repeat(np.arange(n), 2), np.stack([np.arange(n) ** 2, np.arange(n)[::-1] // 100], 1).ravel().astype(np.int64)
    found, scores, met = lexical.Lists(term, doc, gain, 2, n).ranked(np.array([0, 1]), 10, np.zeros(0, np.int64))
    assert met < n / 4 and scores.max() == (n - 1) ** 2


@pytest.mark.parametrize("text", ["aB_c d9", "É é-ÉA", "１２ ab c", "\x7f{}~"])
def test_terms(text):
    assert [t.decode() for t in lexical.terms(text)] == plain_terms(text)
