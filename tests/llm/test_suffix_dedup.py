import hashlib
import random

import pytest

from augsearch.llm.suffix_dedup import query, suffix_dedup


def truth(rows):
    first: dict = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, t in data:
        if i is not None:
            for s in range(len(t) - 49):
                w = t[s : s + 50]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in data:
        gone = bytearray(len(t))
        if i is not None:
            for s in range(len(t) - 49):
                if first[t[s : s + 50]] < i:
                    gone[s : s + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append(((i is None, i or 0), len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert got(query(spark, sf_dir)) == truth(rows)


@pytest.mark.parametrize("chunk, hot", [(200_000, 10_000), (40, 10_000), (40, 10), (200_000, 0)])
def test_planted(spark, chunk, hot):
    r = random.Random(chunk)
    alphabet = "ab é"
    passages = ["".join(r.choices(alphabet, k=n)) for n in (49, 50, 51, 80, 200)] + ["x" * 120, "ab" * 60, "\0" * 70]
    texts = [None, "", "short", "y" * 49, "y" * 50, "y" * 5000, "z" * 60]
    for _ in range(120):
        parts = ["".join(r.choices(alphabet, k=r.randrange(40))) for _ in range(3)] + r.choices(passages, k=r.randrange(3))
        r.shuffle(parts)
        texts.append("".join(parts))
    rows = [(i, t) for i, t in enumerate(texts)]
    r.shuffle(rows)
    rows += [(3000 + k, passages[4]) for k in range(60)] + [(None, passages[4]), (3001, passages[4]), (3002, "y" * 70), (3003, "long " * 20_000)]
    df = spark.createDataFrame([(*x, "b") for x in rows], "doc_id long, text string, bucket string").repartition(3)
    assert got(suffix_dedup(df, chunk, hot)) == truth(rows)


def test_empty_table(spark):
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("hot", [20, 10_000, None])
def test_bucket_of_many_contexts(spark, monkeypatch, hot):
    """One common opening with continuations of its own in each document, far more than a chunk; some share more of it."""
    monkeypatch.setattr("augsearch.llm.suffix_dedup.SMALL", 10)  # None: of 50 documents, a chunk
    r = random.Random(hot or 7)
    opening = "the very same opening of forty-five bytes ..."
    tails = ["".join(r.choices("abcdef ", k=60)) for _ in range(40)]
    rows = [(i, "".join(r.choices("xyz ", k=20)) + opening + (r.choice(tails)[: r.randrange(60)] if i % 3 else "") + "".join(r.choices("uvw ", k=30))) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = truth(rows)
    assert got(suffix_dedup(df, 50, hot)) == want and sum(x[2] for x in want) > 10_000
