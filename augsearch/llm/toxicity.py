"""Toxicity: a counterfactually regularised linear classifier over sentences.

A text's score is that of its most toxic sentence. Features are hashed words and word beginnings (4 to 7
letters), so that inflected and compounded words share weights. The sentence that marks a toxic document isn't labelled:
training first finds, with a strong penalty, the few features that toxic documents have and others have not, then
takes for each document the sentence that the model so far scores highest and fits their weights
again (multiple-instance learning).

The counterfactual part: identity terms of a labelled sentence are swapped for other terms of their group, and the
squared change of the logit is penalised along with the usual loss. A term that the labels mention mostly
in toxic sentences then can't carry weight of its own, and neutral mentions stay clean.

The model is fitted on a bounded sample (`train_rows`, the labelled rows of least hash); scoring reads whole texts
of all documents and needs no shuffle.

Defined results: null and empty texts have no sentence and get the score of the bias alone; rows without a
label are scored; with nothing to learn from every score is 0; repeated labels count each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from augsearch.llm.common import documents, slices
from augsearch.llm.linear import Ftrl, Rows, step

BITS = 18
FEATURES = 1 << BITS
PREFIXES = (4, 5, 6, 7)
#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 6000
#: Terms of one group stand for each other. Fixed values.
IDENTITY_GROUPS = (
    ("women", "men", "woman", "man", "girls", "boys"),
    ("muslim", "muslims", "christian", "christians", "jewish", "jews", "hindu", "hindus", "buddhist", "atheist"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "heterosexual", "homosexual"),
    ("black", "white", "asian", "african", "european", "latino", "arab", "american", "mexican", "chinese"),
    ("immigrant", "immigrants", "refugee", "refugees", "foreigner", "foreigners", "native", "natives"),
    ("disabled", "deaf", "blind", "elderly", "young", "old"),
    ("frauen", "männer", "frau", "mann", "muslime", "christen", "juden", "schwule", "lesben", "ausländer", "flüchtlinge"),
    ("femmes", "hommes", "femme", "homme", "musulmans", "chrétiens", "juifs", "homosexuels", "étrangers", "réfugiés"),
    ("mujeres", "hombres", "mujer", "hombre", "musulmanes", "cristianos", "judíos", "homosexuales", "inmigrantes", "refugiados"),
)

_P = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_INVERSE = pow(_P, -1, 1 << 64)


@lru_cache(1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Code point -> lower-case letter or 0; code point -> whether it ends a sentence."""
    letters = np.array([ord(chr(i).lower()[0]) if chr(i).isalpha() else 0 for i in range(1 << 16)], np.uint64)
    stops = np.zeros(1 << 16, bool)
    stops[[ord(c) for c in ".!?\n\r。！？"]] = True
    return letters, stops


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)]), dtype=np.uint64) for x in (_P, _INVERSE))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words: features (words x (1 + PREFIXES), FEATURES for none), the sentence of each word, the document of each sentence, and where words begin."""
    letter_of, stop_of = _classes()
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", np.uint32)
    low = np.minimum(points, 0xFFFF)
    c, stop = letter_of[low], stop_of[low]
    is_letter = c > 0
    starts = np.flatnonzero(is_letter & ~np.concatenate([[False], is_letter[:-1]]))
    ends = np.flatnonzero(is_letter & ~np.concatenate([is_letter[1:], [False]])) + 1
    power, inverse = _powers(1 << int(np.ceil(np.log2(len(c) + 1))))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * power[: len(c)], dtype=np.uint64)])
        size = ends - starts
        out = np.full((len(starts), 1 + len(PREFIXES)), FEATURES, np.int64)
        for k, most in enumerate((None, *PREFIXES)):
            to = ends if most is None else np.minimum(starts + most, ends)
            hashed = (sums[to] - sums[starts]) * inverse[starts]
            hashed = (hashed ^ (hashed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * (most or 0))
            at = (hashed >> np.uint64(64 - BITS)).astype(np.int64)
            out[:, k] = at if most is None else np.where(size > most, at, FEATURES)
    sentence = np.cumsum(stop)[starts]  # by the stops before the word
    bounds = np.cumsum([len(t) + 1 for t in texts])  # texts are parted by a stop
    document = np.searchsorted(bounds, starts, side="right")
    return out, sentence, document, starts


class ToxicityModel:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = np.append(weights, 0.0).astype(np.float32), bias  # FEATURES has no weight

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        at, sentence, document, _ = features(texts)
        best = np.zeros(len(texts))
        if len(sentence):
            word = self.weights.take(at).sum(1, dtype=np.float64)
            first = np.flatnonzero(np.diff(sentence, prepend=-1))
            total = np.add.reduceat(word, first)
            best = np.full(len(texts), -np.inf)
            np.maximum.at(best, document[first], total)
            best[np.isinf(best)] = 0.0
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-(best + self.bias)))


@lru_cache(1)
def _swaps() -> dict[str, tuple[str, ...]]:
    return {t: group for group in IDENTITY_GROUPS for t in group}


def swapped(sentence: str, random: np.random.Generator) -> str | None:
    """The sentence with each identity term replaced by another of its group; None where it has none."""
    import re

    groups, hit = _swaps(), False

    def other(m):
        nonlocal hit
        word = m.group().lower()
        if word not in groups:
            return m.group()
        hit = True
        choice = [t for t in groups[word] if t != word]
        return choice[random.integers(len(choice))]

    out = re.sub(r"[^\W\d_]+", other, sentence)
    return out if hit else None


def _sentences(text: str) -> list[str]:
    import re

    return [s for s in re.split(r"[.!?\n\r。！？]+", text) if s]


def _bags(seed: int):
    """Sparse sentences of each labelled text, and a swapped twin for those that name an identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                rows = []
                for doc_id, toxic, text in zip(*(c.to_pylist() for c in batch.columns)):
                    text = text or ""
                    at, sentence, _, _ = features([text])
                    for f in np.split(at, np.flatnonzero(np.diff(sentence)) + 1):
                        f = np.unique(f)
                        rows.append((doc_id, toxic, 0, f[f < FEATURES].astype("<i4").tobytes()))
                    random = np.random.default_rng([seed, (doc_id or 0) & 0xFFFFFFFF])
                    for n, s in enumerate(_sentences(text)):
                        if (twin := swapped(s, random)) is not None:
                            for side, x in ((1, s), (2, twin)):
                                f = np.unique(features([x])[0])
                                rows.append((doc_id, toxic, 2 * n + side, f[f < FEATURES].astype("<i4").tobytes()))
                for i in range(0, len(rows), 4096):
                    d, t, k, f = zip(*rows[i : i + 4096])
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(t, pa.int32()), pa.array(k, pa.int32()), pa.array(f, pa.binary())], names=["doc_id", "toxic", "twin", "index"])

    return run


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, train_rows: int = TRAIN_ROWS, counterfactual: float = 1.0, rounds: int = 3, epochs: int = 6, alpha: float = 0.3, l1: float = 5.0, l2: float = 0.1, seed: int = 11) -> ToxicityModel:
    """docs: doc_id, text. labels: doc_id, toxic. may_learn: the labels that the model may see."""
    known = labels.filter(may_learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "toxic").limit(train_rows)
    # of texts that share a doc_id the one of least hash teaches, so that the sample has its bound whatever ids repeat
    one = F.row_number().over(Window.partitionBy("doc_id", "toxic").orderBy(F.xxhash64("text"), "text"))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.distinct()), "doc_id").withColumn("nth", one).filter("nth = 1")
    bags = texts.select("doc_id", "toxic", "text").mapInArrow(_bags(seed), "doc_id long, toxic int, twin int, index binary").toArrow().to_pandas()
    if not len(bags):
        return ToxicityModel(np.zeros(FEATURES), -1000.0)
    bags = bags.sort_values(["doc_id", "twin", "index"])  # the same order in every run
    bags["index"] = bags["index"].map(lambda b: np.frombuffer(b, "<i4"))
    bias = FEATURES
    rows = lambda part: Rows.of([np.append(i, bias) for i in part["index"]], [np.ones(len(i) + 1) for i in part["index"]])
    plain = bags[bags.twin == 0]
    x, y = rows(plain), plain.toxic.to_numpy().astype(float)
    bag = np.cumsum(np.diff(plain.doc_id.to_numpy(), prepend=plain.doc_id.iloc[0] - 1) != 0) - 1
    label = np.zeros(bag.max() + 1)
    np.maximum.at(label, bag, y)
    one, two = rows(bags[bags.twin % 2 == 1]), rows(bags[(bags.twin > 0) & (bags.twin % 2 == 0)])
    random = np.random.default_rng(seed)
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -50, 50)))

    # first the features that toxic documents have and others have not, a document as one set of features
    runs = [np.unique(x.index[a:b]) for a, b in zip(*_runs(x, bag))]
    whole = Rows.of(runs, [np.ones(len(r)) for r in runs])
    model = Ftrl(FEATURES + 1, 1, alpha, 1.0, l1, l2)
    for _ in range(epochs):
        for at in np.array_split(random.permutation(len(label)), max(1, len(label) // 64)):
            step(model, whole.take(at), lambda z, t=label[at]: sigmoid(z) - t[:, None])
    support = model.weights()[:, 0] > 0
    support[bias] = True
    x, one, two = (r.only(support) for r in (x, one, two))
    for _ in range(rounds):  # then their weights from each document's most toxic sentence, found anew in each round
        score = x.dot(model.weights())[:, 0]
        order = np.lexsort((-score, bag))
        top = order[np.flatnonzero(np.diff(bag[order], prepend=-1))]
        model = Ftrl(FEATURES + 1, 1, alpha, 1.0, l1 / 50, l2)
        for _ in range(epochs):
            for at in np.array_split(random.permutation(len(top)), max(1, len(top) // 64)):
                step(model, x.take(top[at]), lambda z, t=label[at]: sigmoid(z) - t[:, None])
                if len(one):
                    some = random.integers(len(one), size=min(len(one), 64))
                    step(model, one.take(some).followed_by(two.take(some)), lambda z: counterfactual * np.concatenate([d := z[: len(z) // 2] - z[len(z) // 2 :], -d]))
    w = model.weights()[:, 0]
    return ToxicityModel(w[:-1], float(w[-1]))


def _runs(x: Rows, bag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the features of each bag begin and end."""
    last = np.flatnonzero(np.diff(bag, append=bag[-1] + 1))
    ends = x.ends[last]
    return np.concatenate([[0], ends[:-1]]), ends


def predict(docs: DataFrame, model: ToxicityModel, *keep: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES floats
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                score = shared.value.scores([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{ddl}, score double, predicted int")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    model = fit(docs, labels, ~held_out(), **options)
    return predict(docs.withColumn("held_out", held_out()), model, "doc_id", "held_out")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
