"""Quality: counts that rule out a text, and a calibrated classifier over hashed word and character n-grams for the others.

The classifier is a logistic regression on n-grams of 1 to 4 characters and of 1 and 2 words (lower-cased A-Z), hashed to
2^18 features each, as shares of the text. It is fitted by FTRL on a bounded sample of the labelled rows (`train_rows` of least hash, and of those as many as have
`train_bytes` of features together); a fifth of the sample is held back to calibrate the probability by Platt's method.
Whole texts of all documents are counted and scored in Arrow batches, without a shuffle.

Defined results: a null text has no words, so it fails the counts; the score does not depend on what else is in a batch; with nothing to
learn from, every score is 1 and the counts alone decide; rows of a null doc_id are scored but not learnt from; of rows that share a doc_id each may
teach, within the sample's bound; repeated rows are scored each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augsearch.llm.common import documents, slices, written
from augsearch.llm.linear import Ftrl, Rows, step

BITS = 18
ORDERS = (1, 2, 3, 4)
#: The fixed thresholds: fewest words, largest share of words in repeated windows, least probability of being good.
MIN_WORDS, MAX_REPEATED, KEEP = 50, 0.5, 0.5
SYMBOLS = "#*$%&|<>"
#: Labelled rows that the model is fitted on, and bytes of their features, at most.
TRAIN_ROWS, TRAIN_BYTES = 4000, 64 << 20
#: Shares are scaled for training; the constant's feature.
SCALE, BIAS = 100.0, 2 << BITS
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)]), dtype=np.uint64) for x in (_MULTIPLIER, _INVERSE))


def _hashed(x: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * kind)
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


class Texts:
    """Code points and words of several texts."""

    GAP = max(ORDERS) - 1

    def __init__(self, texts: list[str]):
        gap = "\0" * self.GAP  # n-grams that run over the end of a text read these, whatever text comes next
        self.points = np.frombuffer((gap.join(texts) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.array([len(t) for t in texts], np.int64)
        self.end = np.cumsum(length + self.GAP) - self.GAP
        self.start = self.end - length
        self.inside = np.zeros(len(self.points), bool)
        self.inside[np.repeat(self.start - np.cumsum(length) + length, length) + np.arange(length.sum())] = True
        self.is_word = self.inside & ~((self.points == 32) | ((self.points >= 9) & (self.points <= 13)))
        before, after = np.concatenate([[False], self.is_word[:-1]]), np.concatenate([self.is_word[1:], [False]])
        self.word_start, self.word_end = np.flatnonzero(self.is_word & ~before), np.flatnonzero(self.is_word & ~after) + 1
        self.first_word = np.searchsorted(self.word_start, np.concatenate([self.start, self.end[-1:]])) if texts else np.zeros(1, np.int64)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[self.end] - sums[self.start]

    def characters(self) -> Iterator[np.ndarray]:
        """For each order the feature at each code point."""
        for n in ORDERS:
            x = np.zeros(len(self.points), np.uint64)
            with np.errstate(over="ignore"):
                for i in range(n):
                    x *= _MULTIPLIER
                    x[: len(x) - i] += self.points[i:]
            yield _hashed(x, n)

    def word_features(self) -> Iterator[np.ndarray]:
        """The feature of each word, and of each word with the next of its text (of the last with nothing)."""
        lower = self.points.astype(np.uint64) + np.uint64(32) * ((self.points >= 65) & (self.points <= 90))
        power, inverse = _powers(1 << int(np.ceil(np.log2(len(lower) + 2))))
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((lower + np.uint64(1)) * power[: len(lower)], dtype=np.uint64)])
            word = (sums[self.word_end] - sums[self.word_start]) * inverse[self.word_start]
            following = np.append(word[1:], np.uint64(0))[: len(word)]
            last = self.first_word[1:][self.first_word[1:] > self.first_word[:-1]] - 1
            following[last] = 0
            yield (1 << BITS) + _hashed(word, 9)
            yield (1 << BITS) + _hashed(word * _MULTIPLIER + following, 10)


def repeated_words(words: list) -> int:
    """Words in windows of three that are found twice or more."""
    if len(words) < 4:
        return 0
    number: dict = {}
    a = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    pair = a[:-1] * len(number) + a[1:]
    if len(number) >= 1 << 20:  # so that three numbers don't fit into one
        pair = np.unique(pair, return_inverse=True)[1]
    _, window, count = np.unique(pair[:-1] * len(number) + a[2:], return_inverse=True, return_counts=True)
    again = count[window] > 1
    covered = np.zeros(len(a), bool)
    for i in range(3):
        covered[i : len(a) - 2 + i] |= again
    return int(covered.sum())


def counts(texts: list[str], parts: Texts) -> dict[str, np.ndarray]:
    symbol = np.zeros(128, bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    repeated, duplicates = [], []
    for text in texts:
        data = text.encode("utf-8", "surrogatepass")  # bytes split at the six blanks only
        repeated.append(repeated_words(data.split()))
        lines = [line for line in data.split(b"\n") if line.strip()]
        duplicates.append(len(lines) - len(set(lines)))
    n_words = np.diff(parts.first_word)
    n_repeat = np.array(repeated, np.int64)
    return {
        "n_words": n_words,
        "word_chars": parts.per_text(parts.is_word),
        "n_symbols": parts.per_text(symbol[np.minimum(parts.points, 127)] & (parts.points < 128)),
        "n_dup_lines": np.array(duplicates, np.int64),
        "n_repeat_words": n_repeat,
        "base_failed": (n_words < MIN_WORDS) | (n_repeat > MAX_REPEATED * n_words),
    }


class QualityModel:
    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, offset: float = 0.0):
        """weights: of the shares of the characters' features, then of the words'. The probability is that of slope * logit + offset."""
        self.weights, self.bias, self.slope, self.offset = weights.astype(np.float32), bias, slope, offset

    def scores(self, parts: Texts) -> np.ndarray:
        total = np.full(len(parts.start), self.bias)
        for features, start, end in ((parts.characters(), parts.start, parts.end), (parts.word_features(), parts.first_word[:-1], parts.first_word[1:])):
            for f in features:
                sums = np.concatenate([[0.0], np.cumsum(self.weights.take(f), dtype=np.float64)])
                total += (sums[end] - sums[start]) / np.maximum(1, end - start)
        return _sigmoid(self.slope * total + self.offset)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse shares of each text's features, and a constant one."""
    for whole in batches:
        for batch in slices(whole, "text", 2 << 20):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            parts = Texts(texts)
            characters, words = list(parts.characters()), list(parts.word_features())
            index, share = [], []
            for i in range(len(texts)):
                spans = [(c[parts.start[i] : parts.end[i]]) for c in characters], [w[parts.first_word[i] : parts.first_word[i + 1]] for w in words]
                found = [np.unique(np.concatenate(s), return_counts=True) for s in spans]
                index.append(np.concatenate([*[f for f, _ in found], [BIAS]]).astype("<i4").tobytes())
                share.append(np.concatenate([*[SCALE * n / max(1, len(s[0])) for (_, n), s in zip(found, spans)], [1.0]]).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(index, pa.binary()), pa.array(share, pa.binary())], names=["doc_id", "quality", "index", "share"])


def platt(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of least negative log-likelihood, with Platt's smoothed targets, by Newton steps."""
    good, bad = float(y.sum()), float(len(y) - y.sum())
    if not len(y):
        return 1.0, 0.0
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([logits, np.ones(len(logits))], 1)
    loss = lambda b: -(target * np.log(p := np.clip(_sigmoid(x @ b), 1e-12, 1 - 1e-12)) + (1 - target) * np.log(1 - p)).sum()
    at = np.array([0.0, np.log((good + 1) / (bad + 1))])
    for _ in range(100):
        p = _sigmoid(x @ at)
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (p - target))
        size = 1.0
        while size > 1e-6 and loss(at - size * move) > loss(at):
            size /= 2
        at = at - size * move
        if size <= 1e-6 or np.abs(size * move).max() < 1e-10:
            break
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)  # a model that tells nothing is left as it is


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES, epochs: int = 6, alpha: float = 0.5, l1: float = 1e-3, l2: float = 1e-2, seed: int = 13) -> QualityModel | None:
    """docs: doc_id, text. labels: doc_id, quality. None where there is nothing to learn from."""
    known = labels.filter("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    order = F.xxhash64("doc_id", F.lit(seed))
    chosen = known.distinct().orderBy(order, "doc_id", "quality").limit(train_rows)  # train_rows pairs of numbers
    bags = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text").mapInArrow(_bags, "doc_id long, quality int, index binary, share binary")
    place = F.struct(F.xxhash64("doc_id", "quality", "index", "share", F.lit(seed)).alias("hash"), F.monotonically_increasing_id().alias("id"))
    table = written(bags.withColumn("place", place), "quality-sample")
    sizes = table.select("place", (2 * F.length("index")).alias("size")).orderBy("place").limit(train_rows).collect()
    if not sizes:
        return None
    last = sizes[max(0, int(np.searchsorted(np.cumsum([r["size"] for r in sizes]), train_bytes, side="right")) - 1)].place
    sample = table.filter((F.col("place.hash") < last.hash) | (F.col("place.hash") == last.hash) & (F.col("place.id") <= last.id)).select("place.*", "quality", "index", "share").toArrow()  # train_bytes at most, or one row
    sample = sample.sort_by([("hash", "ascending"), ("id", "ascending")])  # the same order in every run
    index, share = (np.frombuffer(b"".join(sample[c].to_pylist()), kind) for c, kind in (("index", "<i4"), ("share", "<f4")))
    x, y = Rows(index, share, np.cumsum([len(b) // 4 for b in sample["index"].to_pylist()])), sample["quality"].to_numpy().astype(float)
    del sample
    held = np.arange(len(y)) % 5 == 4  # rows are in the order of a hash
    learn, random = np.flatnonzero(~held), np.random.default_rng(seed)
    model = Ftrl(BIAS + 1, 1, alpha, 1.0, l1, l2)
    for _ in range(epochs):
        random.shuffle(learn)
        for i in range(0, len(learn), 64):
            at = learn[i : i + 64]
            step(model, x.take(at), lambda z, t=y[at]: (_sigmoid(z) - t[:, None]) / len(t))
    w = model.weights()
    slope, offset = platt(x.take(np.flatnonzero(held)).dot(w)[:, 0], y[held])
    return QualityModel(w[:-1, 0] * SCALE, float(w[-1, 0]), slope, offset)


def _judged(shared, keep: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                parts = Texts(texts)
                base = counts(texts, parts)
                score = shared.value.scores(parts) if shared.value else np.ones(len(texts))
                out = {"doc_id": batch.column(0), **base, "score": score, "kept": ~base["base_failed"] & (score >= keep)}
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out.values()], names=list(out))

    return run


def judge(docs: DataFrame, labels: DataFrame, keep: float = KEEP, **options) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, score (probability of being good), kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(docs, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality"), **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^19 floats
    return docs.mapInArrow(_judged(shared, keep), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
