"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 3 characters (2^16 for each order), of letters in lower case with
everything else as a space. Document frequencies come from all rows that may be learnt from. The model is fitted on a
bounded sample of them (`train_rows`, the rows of least hash) by FTRL with an elastic net, in one task; a fifth of the
sample is held back to calibrate the temperature of the softmax. Prediction reads whole texts and needs no shuffle.

Defined results: a text that is null or has no letter is `und` with score 0; with nothing to learn from every text
is `und`; rows with a null lang are predicted but not learnt from; repeated rows are predicted each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from augsearch.llm.common import documents, numbered, slices
from augsearch.llm.linear import Ftrl, Rows, softmax, step, temperature

BITS, ORDERS = 16, 3
FEATURES = ORDERS << BITS
#: Rows that the model is fitted on, at most.
TRAIN_ROWS = 4000


@lru_cache(1)
def _canonical() -> np.ndarray:
    """Code point -> lower-case letter, or a space for everything else."""
    return np.array([ord(chr(i).lower()[0]) if chr(i).isalpha() else 32 for i in range(1 << 16)], np.uint32)


def ngrams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the feature at each character of all texts; where texts end; whether a text has a letter."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in texts])
    c = _canonical()[points & 0xFFFF]
    high = points > 0xFFFF
    if high.any():
        c[high] = [p if chr(p).isalpha() else 32 for p in points[high].tolist()]
    letters = np.add.reduceat(np.append(c != 32, False).astype(np.int64), np.minimum(np.concatenate([[0], ends[:-1]]), len(c))) if len(texts) else np.zeros(0, int)
    letters = np.where(np.diff(ends, prepend=0) > 0, letters, 0)
    padded = np.concatenate([c, [32, 32]]).astype(np.uint32)
    one, two, three = padded[:-2], padded[1:-1].copy(), padded[2:].copy()
    last = ends[ends > 0] - 1  # a text ends in spaces, whatever text comes next
    two[last] = three[last] = three[np.maximum(last - 1, 0)] = 32
    mix = lambda x: ((x * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32)
    pair = one * np.uint32(40503) + two
    return [mix(one), mix(pair) + (1 << BITS), mix(pair * np.uint32(40503) + three) + (2 << BITS)], ends, letters > 0


def batch_text(batch: pa.RecordBatch) -> str:
    return batch.schema.names[-1]


def _each(batches: Iterator[pa.RecordBatch], most: int = 2 << 20):
    """(other columns, texts) in slices; the text is the last column."""
    for whole in batches:
        for batch in slices(whole, batch_text(whole), most):
            yield batch.columns[:-1], [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]


def _frequencies(batches):
    """(feature, documents that have it) over the task's rows; feature -1 counts the documents."""
    df, n = np.zeros(FEATURES, np.int64), 0
    for _, texts in _each(batches):
        orders, ends, _ = ngrams(texts)
        start = 0
        for end in ends:
            seen = np.zeros(FEATURES, bool)
            for o in orders:
                seen[o[start:end]] = True
            df += seen
            n, start = n + 1, end
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["feature", "n"])


def _counts(batches):
    """Sparse counts of each text."""
    for others, texts in _each(batches):
        orders, ends, _ = ngrams(texts)
        index, count, start = [], [], 0
        for end in ends:
            at, n = np.unique(np.concatenate([o[start:end] for o in orders]), return_counts=True)
            index.append(at.astype("<i4").tobytes())
            count.append((n / max(1, end - start)).astype("<f4").tobytes())
            start = end
        yield pa.RecordBatch.from_arrays([*others, pa.array(index, pa.binary()), pa.array(count, pa.binary())], names=["label", "fold", "index", "tf"])


class LanguageModel:
    def __init__(self, labels: list[str], weights: np.ndarray, bias: np.ndarray, t: float):
        """weights: features x labels, of the term frequency itself: idf is multiplied in."""
        self.labels, self.weights, self.bias, self.temperature = labels, weights, bias, t

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        orders, ends, has_letter = ngrams(texts)
        starts = np.concatenate([[0], ends[:-1]])
        total = np.zeros((len(texts), len(self.labels)))
        for o in orders:
            for k in range(len(self.labels)):
                sums = np.concatenate([[0], np.cumsum(self.weights[k].take(o), dtype=np.float64)])
                total[:, k] += sums[ends] - sums[starts]
        return total / np.maximum(1, ends - starts)[:, None] + self.bias, has_letter

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.labels:
            return ["und"] * len(texts), np.zeros(len(texts))
        logits, has_letter = self.logits(texts)
        p = softmax(logits / self.temperature)
        best = p.argmax(1)
        return [self.labels[b] if h else "und" for b, h in zip(best, has_letter)], np.where(has_letter, p[np.arange(len(p)), best], 0.0)


def fit(docs: DataFrame, may_learn: Column, train_rows: int = TRAIN_ROWS, epochs: int = 8, alpha: float = 0.5, l1: float = 1e-3, l2: float = 1e-2, scale: float = 100.0, seed: int = 7) -> LanguageModel:
    """docs: doc_id, text, lang. may_learn: the rows that the model may see the lang of."""
    known = docs.filter(may_learn & F.col("lang").isNotNull())
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    # the sample is fixed by a bound on the hash, found without the texts
    cut = known.select(order.alias("h")).orderBy("h").limit(train_rows).agg(F.max("h")).first()[0]
    if cut is None:
        return LanguageModel([], np.zeros((0, FEATURES), np.float32), np.zeros(0), 1.0)
    frequency = known.select("text").mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow().to_pandas()  # FEATURES + 1 rows at most
    n_docs = int(frequency.n[frequency.feature == -1].iloc[0])
    df = np.zeros(FEATURES)
    seen = frequency[frequency.feature >= 0]
    df[seen.feature.to_numpy()] = seen.n.to_numpy()
    idf = np.log((1 + n_docs) / (1 + df)) + 1

    fold = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed + 1)), F.lit(5)).cast("int")
    sample = known.filter(order <= F.lit(cut)).select(F.col("lang").alias("label"), fold.alias("fold"), "text").mapInArrow(_counts, "label string, fold int, index binary, tf binary")
    # rows of null or repeated doc_id share a hash, so more may lie below the bound: whatever their number, train_rows of them come
    sample = sample.orderBy(F.xxhash64("index", "tf", F.lit(seed)), "label", "fold").limit(train_rows).coalesce(1)
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if rows:
            yield from _fitted(pa.Table.from_batches(rows), shared.value, epochs, alpha, l1, l2, scale, seed)

    # the sample stays in the task; the model alone comes to the driver
    model = sample.mapInArrow(fitted, "label string, weights binary, bias double, temperature double").toArrow()
    weights = np.stack([np.frombuffer(x.as_buffer(), np.float32) for x in model["weights"]])
    return LanguageModel(model["label"].to_pylist(), weights, np.asarray(model["bias"]), model["temperature"][0].as_py())


def _fitted(sample: pa.Table, idf: np.ndarray, epochs: int, alpha: float, l1: float, l2: float, scale: float, seed: int) -> Iterator[pa.RecordBatch]:
    """The sample -> a row per label, in order: its weights and bias, and the temperature of all."""
    sample = sample.to_pandas().sort_values(["fold", "label", "index", "tf"])  # the same order in every run
    labels = sorted(set(sample.label))
    y = np.searchsorted(labels, sample.label)
    x = Rows.of([np.frombuffer(b, "<i4") for b in sample["index"]], [np.frombuffer(b, "<f4") for b in sample.tf])
    x.value *= idf[x.index] * scale
    bias_at = FEATURES  # a constant feature
    x = Rows.of([np.append(p, bias_at) for p in np.split(x.index, x.ends[:-1])], [np.append(p, 1.0) for p in np.split(x.value, x.ends[:-1])])
    learn = np.flatnonzero(sample.fold.to_numpy() != 0) if (sample.fold != 0).any() else np.arange(len(y))
    held = np.flatnonzero(sample.fold.to_numpy() == 0)
    model, random = Ftrl(FEATURES + 1, len(labels), alpha, 1.0, l1, l2), np.random.default_rng(seed)
    for _ in range(epochs):
        random.shuffle(learn)
        for i in range(0, len(learn), 64):
            at = learn[i : i + 64]
            target = np.eye(len(labels))[y[at]]
            step(model, x.take(at), lambda logits, target=target: (softmax(logits) - target) / len(target))
    w = model.weights()
    t = temperature(x.take(held).dot(w), y[held])
    for k, label in enumerate(labels):
        weights = (w[:-1, k] * (idf * scale)).astype(np.float32).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([label]), pa.array([weights], pa.binary()), pa.array([w[-1, k]]), pa.array([t])], names=["label", "weights", "bias", "temperature"])


def predict(docs: DataFrame, model: LanguageModel, *keep: str) -> DataFrame:
    """The columns to keep, then lang_pred and score; the text is read whole."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x labels floats
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches):
        for others, texts in _each(batches):
            lang, score = shared.value.predict(texts)
            yield pa.RecordBatch.from_arrays([*others, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, F.col("text").cast("string").alias("text of the prediction")).mapInArrow(run, f"{ddl}, lang_pred string, score double")


def confident(docs: DataFrame, model: LanguageModel, least: float) -> DataFrame:
    """The rows of docs, any columns of any names, whose text has a language by a score of at least that."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")
    rows = numbered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, f"c{at}", 2 << 20):
                lang, score = shared.value.predict([t or "" for t in batch.column(at).to_pylist()])
                yield batch.filter(pa.array([x != "und" and s >= least for x, s in zip(lang, score)], pa.bool_()))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit(docs, ~held_out(), **options)
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model, "doc_id", "held_out")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
