import random
import re
import time
from pathlib import Path

import numpy as np
import pytest

from augsearch.llm import common, ngram_join
from augsearch.llm.ngram_join import Tree, bitmaps, jaccard_join, links, possible, query, shingle_sets, traverse
from tests.llm import brute


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def check(df, rows, **options):
    sets = [(i, shingles(t)) for i, t in rows]
    inverted: dict = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            inverted.setdefault(x, []).append(k)
    common: dict = {}
    for ks in inverted.values():
        for a in range(len(ks)):
            for b in range(a):
                common[ks[a], ks[b]] = common.get((ks[a], ks[b]), 0) + 1
    links = [(sets[a][0], sets[b][0]) for (a, b), n in common.items() if 100 * n >= 80 * (len(sets[a][1]) + len(sets[b][1]) - n) and None not in (sets[a][0], sets[b][0])]
    want = brute.components({i for i, _ in rows if i is not None}, links) | {None: None}
    got = sorted(((x.doc_id is None, x.doc_id or 0), x.n_shingles, x.component_id) for x in jaccard_join(df, **options).collect())
    assert got == sorted(((i is None, i or 0), len(s), want[i]) for i, s in sets)
    return len(links)


def varied(r, text, share):
    words = text.split()
    for _ in range(max(1, int(share * len(words)))):
        words[r.randrange(len(words))] = r.choice(["alpha", "beta", "gamma", "delta", "x%d" % r.randrange(50)])
    return " ".join(words)


def test_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert check(df, [tuple(r) for r in df.collect()]) > 0


@pytest.mark.parametrize("block, most", [(512, 1 << 20), (7, 1 << 20), (40, 900)])
def test_planted(spark, block, most):
    """Small blocks part neighbourhoods, so that trees of different blocks are compared."""
    r = random.Random(block)
    vocabulary = ["w%d" % i for i in range(400)]
    passage = " ".join(r.choices(vocabulary, k=30))
    rows = []
    for _ in range(12):
        base = " ".join(r.choices(vocabulary, k=r.choice([6, 30, 60, 200])))
        for _ in range(r.randrange(1, 9)):
            rows.append(varied(r, base, r.choice([0.005, 0.02, 0.04])))
    rows += [f"{' '.join(r.choices(vocabulary, k=25))} {passage}" for _ in range(40)]
    rows += [None, "", " \t", "one", "One", "one two", "one two three four five", "ONE  two\nthree four five", "é É", "long " * 30_000, "long " * 20_000]
    rows = [(i * 3, t) for i, t in enumerate(rows)] + [(None, "one"), (0, rows[0]), (3, "one two")]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, token string").repartition(3)
    assert check(df, rows, block=block, most=most) > 5
    # equal sets link as classes; every other link comes from a tree
    _, equal, found = links(df, block=block, most=most)
    sets = {i: shingles(t) for i, t in rows[::-1]}
    assert found.count() > 0 and all(sets[x.a] == sets[x.b] for x in equal.filter("a > 3 and b > 3").collect())


def test_shared_by_chance(spark, monkeypatch):
    """Texts that share a few shingles with others, but with none enough of them for a link, are in no neighbourhood, and their sets aren't stored."""
    r = random.Random(4)
    own = [[f"w{r.randrange(10**6)}" for _ in range(100)] for _ in range(300)]
    runs = [r.choices("abcdefgh", k=6) for _ in range(301)]
    texts = [" ".join(runs[i] + x + runs[i + 1]) for i, x in enumerate(own)]
    rows = list(enumerate(texts + [varied(r, texts[k], 0.01) for k in (3, 4, 50, 50)]))
    stored = {}
    monkeypatch.setattr(ngram_join, "written", lambda df, name, *a, write=ngram_join.written: stored.setdefault(name, write(df, name, *a)))
    assert check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows) >= 4
    assert stored["near"].count() == 7 and stored["sets"].count() < 20


def test_few_and_many_share_a_token(spark, monkeypatch):
    """Pairs are found by tokens that few have, by ones that many have, and by some of both."""
    r = random.Random(6)
    vocabulary = ["u%d" % i for i in range(700)]
    passage = " ".join(r.choices(vocabulary, k=30))
    rows = []
    for k in range(14):
        base = f"{' '.join(r.choices(vocabulary, k=r.choice([5, 25, 40, 90])))} {passage if k % 2 else ''}"
        rows += [varied(r, base, r.choice([0.01, 0.02])) for _ in range(k % 5 + 1)]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(ngram_join, "FEW", 4)
    assert check(df, rows) > 10


def test_empty_table(spark):
    assert jaccard_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_shingle_hashes_follow_words():
    texts = ["a b c d e f", "A  b\tc d e\nf ", "a b c d e", "f e d c b a", "", "ab c", "a bc", "a", "b"]
    sets = shingle_sets([t.encode() for t in texts])
    assert sets[0].tolist() == sets[1].tolist() and sets[2][0] in sets[0]
    assert [len(s) for s in sets] == [2, 2, 1, 2, 0, 1, 1, 1, 1]
    assert len({x for s in sets[2:] for x in s.tolist()}) == 1 + 2 + 4
    assert all((np.diff(s.astype(object)) > 0).all() for s in sets)


def test_one_neighbourhood_of_many_blocks(spark):
    """A hot family of near copies with chains that only some members link to."""
    r = random.Random(8)
    vocabulary = ["v%d" % i for i in range(900)]
    base = " ".join(r.choices(vocabulary, k=100))
    rows = [varied(r, base, 0.01) for _ in range(150)] + [varied(r, varied(r, base, 0.02), 0.02) for _ in range(60)]
    rows += [" ".join(base.split()[:k]) + " " + " ".join(r.choices(vocabulary, k=100 - k)) for k in range(20, 100, 2)]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for options in ({"block": 16}, {"most": 700}, {}):
        assert check(df, rows, **options) > 1000


def test_traverse_finds_the_components():
    r = np.random.default_rng(3)
    for trial in range(30):
        n, some = int(r.integers(2, 90)), []
        for k in range(n):
            x = some[int(r.integers(k))].copy() if k and r.random() < 0.6 else r.integers(0, 4000, int(r.integers(1, 60))).astype(np.uint64)
            x[r.random(len(x)) < 0.08] += np.uint64(5000)
            some.append(np.unique(x))
        near = np.sort(r.integers(0, 4, n))
        size = np.array([len(x) for x in some])
        pairs = [(a, b) for b in range(n) for a in range(b) if near[a] == near[b] and 100 * (k := len(np.intersect1d(some[a], some[b]))) >= 80 * (size[a] + size[b] - k)]
        bits = bitmaps(some)
        got = list(traverse(Tree(bits, size, near), None, np.arange(n), 80))
        assert set(got) <= set(pairs) and brute.components(range(n), got) == brute.components(range(n), pairs)
        first = int(r.integers(1, n))
        across = [(a, b) for a, b in pairs if a < first <= b]
        got = list(traverse(Tree(bits[:first], size[:first], near[:first]), Tree(bits[first:], size[first:], near[first:]), np.arange(n), 80))
        assert set(got) <= set(across) and brute.components(range(n), got) == brute.components(range(n), across)


def test_nodes_are_pruned():
    """A node pair goes by its overlap alone where sizes and neighbourhoods would let it pass."""
    one, two = ([np.arange(k, k + 20, dtype=np.uint64) for k in range(s, s + 320, 20)] for s in (0, 310))
    tree = Tree(bitmaps(one + two + one + two), np.full(64, 20), np.zeros(64, int))
    ok = possible(tree.levels[1], np.array([0, 0]), tree.levels[1], np.array([1, 2]), 80)
    assert ok.tolist() == [False, True]


def test_prefixes_are_not_shuffled(spark, monkeypatch):
    """Of copies one alone goes on, without an exchange of all prefixes for that."""
    r = random.Random(12)
    own = [" ".join(r.choices(["w%d" % i for i in range(500)], k=40)) for _ in range(60)]
    rows = [(i, own[i % 60] if i % 3 else varied(r, own[i % 60], 0.02)) for i in range(240)]
    rows += [(7, own[50]), (500, own[9]), (500, own[10]), (8, own[8]), (None, own[4])]
    plans, stored = {}, {}

    def write(df, name, *a, write=ngram_join.written):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        out = write(df, name, *a)
        stored[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "written", write)
    assert check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows) > 10
    assert plans["prefixes"].count("Exchange") == 1 and stored["prefixes"] < 200  # the exchange is the test's own


def test_freed_lets_the_last_shuffle_go(spark):
    files = lambda: set(Path(spark.sparkContext.getConf().get("spark.local.dir")).rglob("shuffle_*"))
    before = files()
    common.written(spark.range(1000).repartition(3), "rows")
    made = files() - before
    common.freed(spark)
    for _ in range(30):
        if not (left := {x for x in made if x.exists()}):
            break
        time.sleep(0.1)
    assert made and not left
