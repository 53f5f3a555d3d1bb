import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from augsearch.llm import quality

BLANK = r"[^\x20\x09-\x0D]+"


def brute(text):
    words = re.findall(BLANK, text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(BLANK, line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def counted(texts):
    got = quality.counts(texts, quality.Texts(texts))
    return list(zip(*[got[c].tolist() for c in NAMES]))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n\t\r\x0b\x0c\x1c\x85\xa0#|é😀"), max_size=60), max_size=6))
def test_counts(texts):
    assert counted(texts) == [brute(t) for t in texts]


def test_counts_of_long_and_full_texts():
    draw = random.Random(1)
    texts = [" ".join(draw.choice("abcdef") for _ in range(n)) for n in (49, 50, 51, 3000)] + ["a b c " * 3, "x\nx\n \n x\nx", " ".join(map(str, range(60))), "q" * 300_000]
    assert counted(texts) == [brute(t) for t in texts]


def sample(n=400, seed=2):
    draw, out = random.Random(seed), []
    for i in range(n):
        good = draw.random() < 0.7
        words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 8))) for _ in range(draw.randint(55, 90))]
        out.append((i, " ".join(words if good else [w + draw.choice(["$$$", "%%", "!!"]) for w in words]), int(good)))
    return out


def frames(spark, rows):
    return spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_calibration(spark):
    rows = sample(600)
    docs, labels = frames(spark, rows)
    got = {r.doc_id: r for r in quality.judge(docs, labels.filter("doc_id % 2 = 0")).collect()}
    held = [r for r in rows if r[0] % 2]
    assert np.mean([got[i].kept == bool(q) for i, _, q in held]) > 0.97
    p, y = np.array([got[i].score for i, _, _ in held]), np.array([q for _, _, q in held])
    assert abs(p.mean() - y.mean()) < 0.05 and ((p - y) ** 2).mean() < 0.05


def test_held_out_accuracy_of_given_data(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    learn = "crc32(cast(cast(doc_id as string) as binary)) % 3 <> 0"
    held = quality.judge(docs, labels.filter(learn)).join(labels.filter(f"not {learn}"), "doc_id").filter("not base_failed").toPandas()
    assert len(held) > 50 and (held.kept == (held.quality == 1)).mean() > 0.97


def test_model_against_plain_loops(spark):
    """The features of one text, counted one by one, give its logit."""
    draw = np.random.default_rng(4)
    model = quality.QualityModel(draw.normal(size=2 << quality.BITS), 0.3, 2.0, -0.1)
    texts = ["The the cat.\nA|b", "", "é", "one", "😀 b c"]
    parts = quality.Texts(texts)
    mask = (1 << 64) - 1

    def hashed(x, kind):
        x = (x ^ (x >> 31)) * (0xBF58476D1CE4E5B9 + 2 * kind) & mask
        return x >> (64 - quality.BITS)

    p = int(quality._MULTIPLIER)
    for text, got in zip(texts, model.scores(parts)):
        logit = 0.3
        for n in quality.ORDERS:
            points = [ord(c) for c in text] + [0] * 3
            for i in range(len(text)):
                x = 0
                for c in points[i : i + n]:
                    x = (x * p + c) & mask
                logit += model.weights[hashed(x, n)] / len(text)
        words = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.findall(BLANK, text)]
        numbers = [sum((ord(c) + 1) * pow(p, i, 1 << 64) for i, c in enumerate(w)) & mask for w in words] + [0]
        for a, b in zip(numbers, numbers[1:]):
            logit += (model.weights[(1 << quality.BITS) + hashed(a, 9)] + model.weights[(1 << quality.BITS) + hashed((a * p + b) & mask, 10)]) / len(words)
        assert got == pytest.approx(1 / (1 + np.exp(-(2.0 * logit - 0.1))), abs=1e-6)


def test_scores_do_not_depend_on_the_batch():
    model = quality.QualityModel(np.random.default_rng(5).normal(size=2 << quality.BITS), 0.0)
    texts = [t for _, t, _ in sample(20)] + ["", "a", "b c"]
    together = model.scores(quality.Texts(texts))
    assert together == pytest.approx([model.scores(quality.Texts([t]))[0] for t in texts], abs=1e-9)


def test_platt():
    draw = np.random.default_rng(6)
    logit = draw.normal(size=20000) * 3
    y = (draw.random(20000) < 1 / (1 + np.exp(-(0.5 * logit + 1)))).astype(float)
    assert quality.platt(logit, y) == pytest.approx((0.5, 1.0), abs=0.06)
    assert quality.platt(np.zeros(0), np.zeros(0)) == (1.0, 0.0)


def test_edges(spark):
    rows = sample(80)
    odd = [(None, "words " * 60), (1000, None), (1001, ""), (1002, "\x00 " * 70), (1003, "long" * 100_000), (0, rows[0][1])]
    docs, labels = frames(spark, rows)
    more = docs.union(spark.createDataFrame(odd, "doc_id long, text string")).selectExpr("*", "1 as n_words", "2 as quality")
    noisy = labels.union(spark.createDataFrame([(None, 1, 0), (3, None, 0), (4, 1, 0), (999999, 0, 0)], "doc_id long, quality int, toxic int"))
    got = quality.judge(more, noisy).collect()
    assert len(got) == len(rows) + len(odd)
    assert all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1000].n_words == 0 and by[1000].base_failed and not by[1000].kept and by[1001].base_failed and by[1003].word_chars == 400_000
    empty = quality.judge(docs, labels.limit(0)).collect()
    assert all(r.score == 1 and r.kept == (not r.base_failed) for r in empty)
    assert quality.judge(docs.limit(0), labels).collect() == []


def test_sample_is_bounded(spark):
    docs, labels = frames(spark, sample(120))
    whole = next(quality._bags(iter([pa.RecordBatch.from_pylist([{"doc_id": 1, "quality": 1, "text": "a " * 60}])])))
    assert len(whole.column(2)[0].as_py()) == len(whole.column(3)[0].as_py())
    assert quality.fit(docs, labels, train_bytes=1) is not None and quality.fit(docs, labels, train_rows=10) is not None
