import base64
import hashlib
import random

import public_tokenizers
import tiktoken

from augsearch.llm.bpe import Ranks, decode, digests, encode, query
from augsearch.llm.pretokenize import split

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_query_is_tiktoken(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = query(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = TIKTOKEN.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_round_trip_of_odd_texts(spark):
    r = random.Random(4)
    texts = [None, "", " ", "a" * 5000, "abab" * 3000, "<|endoftext|>", "日本語 ½ \x00", "  \n\n x"] + ["".join(r.choices("ab étion'the  123\n=-", k=r.randrange(80))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, None)], "doc_id long, text string").repartition(3)
    got = encode(df, PATH, block_bytes=1000)
    assert all(x.ids == TIKTOKEN.encode_ordinary(texts[x.doc_id] or "") for x in got.collect())
    back = decode(got, PATH).collect()
    assert len(back) == len(texts) + 1 and all(bytes(x.bytes) == (texts[x.doc_id] or "").encode() for x in back)
    assert digests(df.limit(0), PATH).collect() == []


def test_replay_where_a_merge_makes_a_pair_of_lower_rank(tmp_path):
    """Ranks that no training would give: words are still merged as one word at a time."""
    r = random.Random(5)
    for _ in range(20):
        tokens = list(dict.fromkeys("".join(r.choices("abc", k=r.randrange(2, 5))).encode() for _ in range(25)))
        ranks = {bytes([i]): i for i in range(256)} | {t: 256 + i for i, t in enumerate(tokens)}
        path = tmp_path / "ranks"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for t, i in ranks.items()))
        got = Ranks(str(path))
        reference = tiktoken.Encoding("x", pat_str=".+", mergeable_ranks=ranks, special_tokens={})
        words = list(dict.fromkeys("".join(r.choices("abcd", k=r.randrange(1, 30))) for _ in range(300)))
        ids, stops = got.replay([w.encode() for w in words])
        at = 0
        for w, stop in zip(words, stops.tolist()):
            assert ids[at:stop].tolist() == reference._core_bpe.encode_single_piece(w.encode()), w
            at = stop


def test_split_keeps_everything():
    for t in ("it's  a\n\n b ", "日本 x½", ""):
        assert "".join(split(t)) == t


def test_long_words_and_clashing_names(spark):
    """Words of any length, one of them in many blocks, and columns named as the operator's own."""
    r = random.Random(9)
    texts = ["ab" * 60_000, "".join(r.choices("abcdefgh", k=120_000)), " the the", "a" * 100_000, " the"] * 3
    df = spark.createDataFrame([(i, t, "x", b"y", 1, "z") for i, t in enumerate(texts)], "doc_id long, text string, block string, word binary, number int, numbers string").repartition(5)
    got = {x.doc_id: (x.n_tokens, x.ids_sha256) for x in digests(df, PATH, block_bytes=5000).collect()}
    for i, t in enumerate(texts):
        ids = TIKTOKEN.encode_ordinary(t)
        assert got[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    ranks = Ranks(PATH)
    for t in texts[:4]:
        assert ranks.one_word(t.encode()) == TIKTOKEN._core_bpe.encode_single_piece(t.encode())


def test_no_table_stays_in_the_catalog(spark, sf_dir):
    before = {t.name for t in spark.catalog.listTables()}
    df = query(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count() == df.count()
    assert {t.name for t in spark.catalog.listTables()} == before
    assert "Bucketed: true" in plan or "SelectedBucketsCount" in plan
