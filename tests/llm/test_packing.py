import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from augsearch.llm.packing import pack, plan, query
from augsearch.llm.pretokenize import _full, split
from corpus_pipeline import packed

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, texts, capacity):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    by: dict = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by.keys() == texts.keys()
    for k, text in texts.items():
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for i, r in enumerate(sorted(by[k], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (i, at) and (i == 0 or r.length == capacity)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(r.length for r in rows)


def test_query(spark, sf_dir):
    rows = query(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    n, tokens = check(rows, texts, 2048)
    assert n <= 1.02 * (-(-tokens // 2048)) + 2


def test_odd_texts(spark):
    texts = {1: None, 2: "", 3: "<|endoftext|> a", 4: "x" * 40_000, 5: " \n\t 1½ 　 日本 it's \x1c a\x85b", 6: "a b " * 9000, 7: ""}
    df = spark.createDataFrame([(k, t, "z") for k, t in texts.items()], "doc_id long, text string, task string").repartition(3)
    check(pack(df, PATH, capacity=64).collect(), texts, 64)
    assert pack(df.limit(0), PATH).collect() == []


def test_added_tokens_take_their_ids(spark, tmp_path):
    t = Tokenizer.from_file(PATH)
    texts = {1: "hi <|endoftext|> there", 2: "<|endoftext|>", 3: "a<|endoftext|><|endoftext|>\n b", 4: "<|endoftext", 5: "it's <|endoftext|>'s  x", 6: "plain"}
    rows = [(k, x, "en", "a", len(x)) for k, x in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for got in (query(spark, str(tmp_path)), packed(spark, docs, str(tmp_path))):
        assert {r.doc_id: (r.length, r.ids_crc32) for r in got.collect()} == {k: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for k, x in texts.items() for ids in [t.encode(x, add_special_tokens=False).ids + [0]]}


def one_by_one(counts, capacity):
    rooms = [0] * (capacity + 1)
    opened = 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            room = next((r for r in range(length, capacity + 1) if rooms[r]), None)
            if room is None:
                opened, room = opened + 1, capacity
            else:
                rooms[room] -= 1
            rooms[room - length] += 1
    return opened


def test_plan_is_tight():
    r = random.Random(0)
    for _ in range(8):
        counts = {n: r.choice([1, 3, 50, 300]) for n in r.sample(range(1, 257), 40)}
        rows = plan(counts, 256)
        room: dict = {}
        placed: dict = {}
        for length, rank, n, first, offset in rows.tolist():
            assert rank == placed.get(length, 0)
            placed[length] = rank + n
            for s in range(first, first + n):
                assert room.get(s, 0) == offset and offset + length <= 256
                room[s] = offset + length
        assert placed == counts
        assert len(room) == one_by_one(counts, 256)


def test_split_is_the_pattern():
    r = random.Random(2)
    chars = list("ab Z9'\n\t  -_éßÀ÷×ɐʯ²½ \x1c\x1f\x7f\x85´ªºµ日'sdmtrevl<|>")
    for _ in range(3000):
        t = "".join(r.choices(chars, k=r.randrange(12)))
        assert split(t) == _full().findall(t), repr(t)
