import hashlib
import random
import re

import numpy as np

from augsearch.llm.exact_dedup import SQL, Directory, exact_dedup, normalised, query
from tests.oracle import assert_same, connect


def test_matches_sql(spark, sf_dir):
    assert_same(query(spark, sf_dir), SQL, connect(sf_dir))


def test_against_brute_force(spark):
    r = random.Random(1)
    texts = [None, "", " ", "\t", "a b", "a  b", "a\n\x0bb", " a b", " x", "long " * 50_000, "long  " * 50_000]
    rows = [(i, r.choice(texts), "en") for i in range(400)] + [(7, "a b", "x"), (7, "a b", "x"), (None, "a b", None), (None, None, None)]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, group_size string").repartition(5), owner_bytes=1 << 12, bucket_bytes=1 << 10).collect()
    by: dict = {}
    for i, t, _ in rows:
        by.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    want = sorted(((i is None, i or 0), min((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in by.items() for i in ids)
    assert sorted(((x.doc_id is None, x.doc_id or 0), x.keep_id, x.group_size, x.text_sha256) for x in got) == want
    kept = [x for x in got if x.kept]
    assert len(kept) == len(by) and all(x.doc_id == x.keep_id for x in kept)


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_directory_splits_overfull_buckets():
    leaves = np.zeros(256)
    leaves[3], leaves[200:204], leaves[17] = 1000, 10, 5
    d = Directory.grown(leaves, 12)
    assert d.depth == 8 and len(d.bucket) == 256
    got = np.zeros(len(d.local_depth))
    np.add.at(got, d.bucket, leaves)
    assert (got == d.n_bytes).all()
    over = np.flatnonzero(d.n_bytes > 12)
    assert over.tolist() == [d.bucket[3]] and d.local_depth[over[0]] == 8  # one slot can't split further


def test_normalised():
    assert normalised(b"  a \t\r\n b\x0c\x1fc ") == b" a b \x1fc "
