import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from augsearch.llm import spelling
from tests.oracle import assert_same, connect


def brute_words(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: f for w in n if near[w] and n[f := min(near[w], key=lambda v: (-n[v], v))] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def run(spark, docs, **options):
    rows = spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"), **options).collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_sql(spark, sf_dir):
    assert_same(spelling.query(spark, sf_dir), spelling.SQL, connect(sf_dir))


@pytest.mark.parametrize("most", [2, 16, 512])
def test_against_brute_force(spark, most):
    """Dense neighbourhoods over few letters, cut into few and into many segments."""
    draw = random.Random(most)
    docs = [(i, " ".join("".join(draw.choice("aÀb") for _ in range(draw.randint(5, 7))) for _ in range(120))) for i in range(60)]
    assert run(spark, docs, most=most) == brute(brute_words(docs))


def test_edges(spark):
    long = "ab" * 30000
    docs = [(1, None), (2, ""), (3, "1234 !!"), (4, "Ünder ünder UNDER" * 3), (None, "hello Hello HELLO hallo"), (5, f"{long} {long}x {long}y" + " hello" * 30), (6, f"{long} {long}x {long}y"), (6, f"{long} {long}x {long}y"), (7, "aaaaa aaaaaa " * 9), (8, "hallo,hallo;hallo×÷ß")]
    assert run(spark, docs) == brute(brute_words(docs))
    assert run(spark, []) == {}


def test_chain_of_forms(spark):
    chain = ["aaaaaaa", "baaaaaa", "bbaaaaa", "bbbaaaa", "bbbbaaa", "bbbbbaa", "bbbbbba"]
    docs = [(i, " ".join([w] * (4 << (2 * k)))) for i in range(3) for k, w in enumerate(chain)]
    got = run(spark, docs)
    assert got == brute(brute_words(docs)) and {got[w][1] for w in chain} == {"bbbbbba"}


def test_ties_go_by_the_word(spark):
    docs = [(i, "carts carta cartb") for i in range(5)] + [(9, "carts carta cartb " * 5), (10, "carte carte carte")]
    got = run(spark, docs)
    assert got == brute(brute_words(docs)) and got["carte"][0] == "carta"


def test_extra_columns(spark):
    docs = spark.createDataFrame([(1, "hello " * 3, 1, 2)], "doc_id long, text string, n int, word int")
    assert [r.word for r in spelling.variants(docs).collect()] == ["hello"]


def test_words_passed_on_in_parts(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(spelling, "HELD", 3)
    docs = [(i, " ".join(f"w{'abcdefghij'[j]}orda" for j in range(10))) for i in range(4)]
    got = Counter()
    for b in spelling._counted(iter([pa.RecordBatch.from_pylist([{"doc_id": str(i), "text": t} for i, t in docs])])):
        got.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
    assert {w: n for w, n in got.items() if n >= 3 and len(w) >= 5} == brute_words(docs)


def test_tiles_hold_all_rows_once():
    draw = np.random.default_rng(3)
    block = np.sort(draw.integers(0, 40, 3000))
    block[:700] = 0
    tiles = spelling._tiles(np.sort(block), np.full(3000, 8))
    assert np.concatenate(tiles).tolist() == list(range(3000)) and max(map(len, tiles)) <= spelling.TILE
