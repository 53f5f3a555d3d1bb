import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from augsearch.llm.toxicity import FEATURES, classify, features, fit, query, swapped
from tests.llm.test_linear import PlainFtrl, plain_step


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = query(spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.score, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    pos, neg = (np.array([s for s, t in held if t == k]) for k in (1, 0))
    assert (pos[:, None] > neg).mean() > 0.9
    assert (pos >= 0.5).mean() > 0.8 and (neg >= 0.5).mean() < 0.03


def table(spark, rows):
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")


def test_neutral_mentions_stay_clean(spark):
    """Groups are mentioned in toxic sentences alone; without the penalty the mentions themselves look toxic."""
    r = random.Random(3)
    neutral = "walk house green river stone bread table cloud paper light".split()
    sentence = lambda *w: " ".join(r.sample([*r.sample(neutral, 5), *w], 5 + len(w)))
    rows = []
    for i in range(600):
        group = r.choice(["muslims", "immigrants", "women", "gay"])
        rows.append((i, sentence(r.choice(["vermin", "filth"]), group) if i % 2 else sentence(), i % 2))
    docs, labels = table(spark, rows)
    # held out: sentences that the fit has not seen, half of them neutral mentions
    mentions = [sentence(g) for g in ("muslims", "immigrants", "women", "gay") for _ in range(50)]
    insults = [sentence(w) for w in ("vermin", "filth") for _ in range(50)]
    models = {c: fit(docs, labels, F.lit(True), counterfactual=c) for c in (0.0, 1.0, 5.0)}  # 1.0 is the default
    false = {c: (m.scores(mentions) >= 0.5).mean() for c, m in models.items()}
    mean = {c: m.scores(mentions).mean() for c, m in models.items()}
    assert false[5.0] <= false[1.0] < false[0.0] and max(mean[1.0], mean[5.0]) < mean[0.0] and false[1.0] < 0.05
    assert all((m.scores(insults) >= 0.5).mean() > 0.95 for m in models.values())


def test_repeated_ids_do_not_widen_the_sample(spark):
    docs, labels = table(spark, [(i % 3, f"you vermin {i}" if i % 3 == 0 else f"a calm day {i}", int(i % 3 == 0)) for i in range(900)])
    one, two = (fit(d, labels, F.lit(True)) for d in (docs.repartition(3), docs.repartition(7)))
    assert (one.weights == two.weights).all() and one.bias == two.bias


def test_defined_cases(spark):
    rows = [(i, "you vermin here" if i % 3 == 0 else "a calm day", int(i % 3 == 0)) for i in range(300)]
    docs, labels = table(spark, rows)
    odd = spark.createDataFrame([(900, None), (901, ""), (902, "a calm day. " * 30_000 + "you vermin here"), (None, "a calm day"), (3, "you vermin here")], "doc_id long, text string")
    got = {r.doc_id: r for r in classify(docs.union(odd).withColumn("score", F.lit("x")), labels.union(spark.createDataFrame([(7, None), (None, 1), (3, 1)], "doc_id long, toxic int"))).collect()}
    assert got[900].score == got[901].score < 0.5 and got[902].predicted == 1 and got[None].predicted == 0
    assert classify(docs.limit(0), labels).collect() == []
    assert {r.score for r in classify(docs, labels.limit(0)).collect()} == {0.0}


def test_features_and_swaps():
    at, sentence, document, _ = features(["Achlichpf a. b", "", "achlichpf"])
    assert document.tolist() == [0, 0, 0, 2] and sentence[0] == sentence[1] != sentence[2]
    assert at[0].tolist() == at[3].tolist() and (at[1][1:] == FEATURES).all()
    assert features(["achlichzu"])[0][0][4] == at[0][4]
    s = swapped("The Women talk", np.random.default_rng(1))
    assert s is not None and "Women" not in s and s.startswith("The ")
    assert swapped("nothing here", np.random.default_rng(1)) is None


def test_model_against_plain_loops(spark):
    """Selection of features, the rounds over each text's worst sentence, the penalty and the scores, by dictionaries."""
    r = random.Random(8)
    words = "walk house green river stone bread table cloud".split()
    rows = []
    for i in range(150):
        text = [" ".join(r.choices(words, k=4) + (["women"] if r.random() < 0.3 else [])) for _ in range(r.randint(1, 4))]
        if i % 3 == 0:
            text[r.randrange(len(text))] += " filthy vermin" + (" women" if r.random() < 0.7 else "")
        rows.append((i, ". ".join(text), int(i % 3 == 0)))
    docs, labels = table(spark, rows)
    model = fit(docs, labels, F.lit(True))

    def bag(sentence):
        return sorted({int(f) for f in features([sentence])[0].ravel() if f < FEATURES})

    sentences, pairs = [], []  # of all texts in order; of the twins the originals and the swapped
    for i, text, toxic in rows:
        draw = np.random.default_rng([11, i])
        parts = [p for p in re.split(r"[.!?\n\r。！？]+", text) if p]
        sentences.append(sorted((bag(p) for p in parts), key=lambda f: np.array(f, "<i4").tobytes()))
        pairs += [(bag(p), bag(twin)) for p in parts if (twin := swapped(p, draw)) is not None]
    label, draw = [t for _, _, t in rows], np.random.default_rng(11)
    sigmoid = lambda z: 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))
    ones = lambda some: {**{f: 1.0 for f in some}, FEATURES: 1.0}

    def batches(n):
        return np.array_split(draw.permutation(n), max(1, n // 64))

    plain = PlainFtrl(0.3, 1.0, 5.0, 0.1)
    for _ in range(6):
        for at in batches(len(rows)):
            plain_step(plain, [ones({f for s in sentences[d] for f in s}) for d in at], lambda i, z, at=at: [0] if z is None else [sigmoid(z[0]) - label[at[i]]])
    support = {f for f in range(FEATURES) if plain.z[f, 0] and plain.weight((f, 0)) > 0}
    only = lambda some: ones(f for f in some if f in support)
    score = lambda some: sum(plain.weight((f, 0)) for f in only(some))
    for _ in range(3):
        top = [only(max(s, key=score)) for s in sentences]
        plain = PlainFtrl(0.3, 1.0, 5.0 / 50, 0.1)
        for _ in range(6):
            for at in batches(len(rows)):
                plain_step(plain, [top[d] for d in at], lambda i, z, at=at: [0] if z is None else [sigmoid(z[0]) - label[at[i]]])
                some = draw.integers(len(pairs), size=min(len(pairs), 64))
                left, right = ([only(pairs[k][side]) for k in some] for side in (0, 1))
                change = [sum(plain.weight((f, 0)) for f in a) - sum(plain.weight((f, 0)) for f in b) for a, b in zip(left, right)]
                both = change + [-c for c in change]
                plain_step(plain, left + right, lambda i, z, both=both: [0] if z is None else [both[i]])
    assert {f for f in range(FEATURES) if abs(model.weights[f]) > 1e-6} == {f for f in support if abs(plain.weight((f, 0))) > 1e-6}
    assert math.isclose(model.bias, plain.weight((FEATURES, 0)), abs_tol=1e-5)
    for _, text, _ in rows:
        parts = [p for p in re.split(r"[.!?\n\r。！？]+", text) if p]
        # words of a sentence count as often as they stand there
        worst = max(sum(float(np.float32(plain.weight((int(f), 0)))) for f in features([p])[0].ravel() if f < FEATURES and f in support) for p in parts)
        assert math.isclose(model.scores([text])[0], sigmoid(worst + plain.weight((FEATURES, 0))), abs_tol=1e-4)
