"""The linear learner and the language model against plain loops over dictionaries."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from augsearch.llm.langid import FEATURES, fit, ngrams
from augsearch.llm.linear import Ftrl, Rows, step, temperature


class PlainFtrl:
    """One coordinate at a time, as the algorithm is published."""

    def __init__(self, alpha, beta, l1, l2):
        self.z, self.n = Counter(), Counter()
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weight(self, key):
        z = self.z[key]
        if abs(z) <= self.l1:
            return 0.0
        return -(z - math.copysign(self.l1, z)) / ((self.beta + math.sqrt(self.n[key])) / self.alpha + self.l2)

    def update(self, gradients):
        weights = {key: self.weight(key) for key in gradients}
        for key, g in gradients.items():
            sigma = (math.sqrt(self.n[key] + g * g) - math.sqrt(self.n[key])) / self.alpha
            self.z[key] += g - sigma * weights[key]
            self.n[key] += g * g


def plain_step(model, rows, residual_of):
    classes = len(residual_of(0, None))
    logits = [[sum(v * model.weight((f, k)) for f, v in row.items()) for k in range(classes)] for row in rows]
    gradients = Counter()
    for i, row in enumerate(rows):
        for k, r in enumerate(residual_of(i, logits[i])):
            for f, v in row.items():
                gradients[f, k] += v * r
    model.update(gradients)


def plain_softmax(x):
    e = [math.exp(v - max(x)) for v in x]
    return [v / sum(e) for v in e]


def test_step():
    r = random.Random(1)
    fast, plain = Ftrl(20, 3, 0.5, 1.0, 0.02, 0.1), PlainFtrl(0.5, 1.0, 0.02, 0.1)
    for _ in range(40):
        rows = [{r.randrange(20): r.uniform(-2, 2) for _ in range(r.randrange(6))} for _ in range(5)]
        target = [r.randrange(3) for _ in rows]
        batch = Rows.of([np.array(list(x), np.int64) for x in rows], [np.array(list(x.values())) for x in rows])
        softmax = lambda x: np.exp(x) / np.exp(x).sum(1, keepdims=True)
        step(fast, batch, lambda x, t=target: (softmax(x) - np.eye(3)[t]) / len(t))
        plain_step(plain, rows, lambda i, x, t=target: [0] * 3 if x is None else [(p - (k == t[i])) / len(t) for k, p in enumerate(plain_softmax(x))])
    want = np.array([[plain.weight((f, k)) for k in range(3)] for f in range(20)])
    assert np.allclose(fast.weights(), want, atol=1e-9) and (want == 0).any() and (want != 0).any()


def test_temperature():
    r = np.random.default_rng(2)
    logits = r.normal(size=(300, 4)) * 5
    y = np.where(r.random(300) < 0.6, logits.argmax(1), r.integers(0, 4, 300))
    loss = lambda t: -sum(math.log(plain_softmax((x / t).tolist())[k]) for x, k in zip(logits, y))
    t = temperature(logits, y)
    assert all(loss(t) <= loss(t * f) + 1e-9 for f in (0.8, 0.95, 1.05, 1.25)) and 1 < t < 54
    assert temperature(logits, logits.argmax(1)) < 1.001  # not below 1, though all are right
    assert temperature(logits[:0], y[:0]) == 1.0


def test_language_model(spark):
    r = random.Random(3)
    words = {"en": "the and of this have been", "de": "der und nicht ein auch werden", "fr": "les des est une dans pour"}
    rows = [(i, " ".join(r.choices(words[lang].split() + ["radio", "taxi"], k=r.randint(2, 7))), lang) for i in range(90) for lang in [r.choice(list(words))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seed, epochs, alpha, l1, l2, scale = 7, 8, 0.5, 1e-3, 1e-2, 100.0
    model = fit(df, F.lit(True))

    def counts(text):
        return Counter(int(f) for o in ngrams([text])[0] for f in o[: len(text)])

    df_of = Counter(f for _, text, _ in rows for f in counts(text))
    idf = lambda f: math.log((1 + len(rows)) / (1 + df_of[f])) + 1
    folds = {x.doc_id: x.fold for x in df.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(5)).alias("fold")).collect()}
    sample = []
    for i, text, lang in rows:
        c = dict(sorted(counts(text).items()))
        tf = np.array([n / len(text) for n in c.values()], "<f4")
        sample.append((folds[i], lang, np.array(list(c), "<i4").tobytes(), tf.tobytes(), {**{f: float(v) * idf(f) * scale for f, v in zip(c, tf)}, FEATURES: 1.0}))
    sample.sort(key=lambda s: s[:4])
    labels = sorted(words)
    learn, plain = np.array([k for k, s in enumerate(sample) if s[0]]), PlainFtrl(alpha, 1.0, l1, l2)
    shuffle = np.random.default_rng(seed)
    for _ in range(epochs):
        shuffle.shuffle(learn)
        for at in range(0, len(learn), 64):
            part = [sample[k] for k in learn[at : at + 64]]
            plain_step(plain, [s[4] for s in part], lambda i, x, part=part: [0] * 3 if x is None else [(p - (labels[k] == part[i][1])) / len(part) for k, p in enumerate(plain_softmax(x))])
    probes = [text for _, text, _ in rows[:20]] + ["the taxi", "und radio", "Dans UNE!", "xyz", "a" * 3000]
    got_lang, got_score = model.predict(probes)
    for text, lang, score in zip(probes, got_lang, got_score):
        x = {f: n / len(text) * idf(f) * scale for f, n in counts(text.lower()).items()}
        p = plain_softmax([(sum(v * plain.weight((f, k)) for f, v in x.items()) + plain.weight((FEATURES, k))) / model.temperature for k in range(3)])
        assert math.isclose(score, max(p), rel_tol=1e-3), text
        assert lang == labels[p.index(max(p))] or sorted(p)[-1] - sorted(p)[-2] < 1e-3
    held = [s for s in sample if s[0] == 0]
    logits = np.array([[sum(v * plain.weight((f, k)) for f, v in s[4].items()) for k in range(3)] for s in held])
    assert math.isclose(model.temperature, temperature(logits, np.array([labels.index(s[1]) for s in held])), rel_tol=1e-3)


def test_sample_has_its_bound_when_ids_repeat(spark):
    """Null and repeated ids share a hash: 300 rows at each bound, of which ten are learnt from; the same ones in each run and layout."""
    rows = [(k, "the and of " if i % 2 else "der und das ", "en" if i % 2 else "de") for i in range(300) for k in (None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = (fit(d, F.lit(True), train_rows=10) for d in (df.repartition(3), df.repartition(7)))
    assert (one.weights == two.weights).all() and one.temperature == two.temperature
    assert set(one.labels) <= {"de", "en"}


def test_a_text_alone_and_among_others():
    texts = ["one", "", "z", "ab", "", "long text 12", "é𝒜"]
    together, ends, letters = ngrams(texts)
    for text, end, has in zip(texts, ends, letters):
        alone, _, one = ngrams([text])
        assert has == one[0] and all((a[: len(text)] == t[end - len(text) : end]).all() for a, t in zip(alone, together))
