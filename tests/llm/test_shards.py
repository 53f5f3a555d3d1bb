import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import tiktoken

from augsearch.llm.common import scratch, written
from augsearch.llm.packing import _bpe, word_encoder
from augsearch.llm.shards import Permutation, materialise, query, read, sequences

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_permutation():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        p = Permutation(n, 7)
        slots = p.slot(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n))
        assert p.number(slots).tolist() == list(range(n))
    assert Permutation(1000, 7).slot(np.arange(1000)).tolist() != Permutation(1000, 8).slot(np.arange(1000)).tolist()


def test_shards_hold_every_token_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "word " * 30_000), (-2, "")], "doc_id long, text string")
    rows = written(sequences(docs.union(odd).repartition(3), PATH, stride=128), "sequences")
    folder = scratch(spark, "shards")
    got = sorted(materialise(rows, folder, key=5, stride=128, per_shard=50).collect(), key=lambda r: r.slot)
    assert [r.slot for r in got] == list(range(len(got)))
    records = list(read(folder, 0, len(got), 128, 50))
    for r, x in zip(got, records):
        assert r.shard == r.slot // 50 and r.byte_offset == r.slot % 50 * 256
        assert zlib.crc32(x[: r.length].tobytes()) == r.ids_crc32 and (x[r.length :] == 50256).all()
    assert [x.tolist() for x in read(folder, 47, 60, 128, 50)] == [x.tolist() for x in records[47:107]]
    source = sorted(bytes(r.ids) for r in rows.collect())
    assert source == sorted(x[: r.length].tobytes() for r, x in zip(got, records))
    # the sequences of a task, in order, are its documents
    encode = word_encoder(PATH)
    texts = {r.doc_id: r.text or "" for r in docs.union(odd).collect()}
    want = sorted(np.append(np.frombuffer(encode([t])[0], "<u4"), 50256).tolist() for t in [*texts.values(), ""])
    streams: dict = {}
    for r in sorted(rows.collect(), key=lambda r: (r.task, r.nth)):
        streams.setdefault(r.task, []).extend(np.frombuffer(bytes(r.ids), "<u2").tolist())
    found = []
    for s in streams.values():
        s = np.array(s)
        found += [p.tolist() for p in np.split(s, np.flatnonzero(s == 50256) + 1)[:-1]]
    assert sorted(found) == want


def test_query(spark, sf_dir):
    got = query(spark, sf_dir).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    assert {d for r in got for d in r.doc_ids} == {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}


def files_of(folder):
    return {p.name: p.stat().st_mtime_ns for p in Path(folder.removeprefix("file://")).glob("shard-*")}


def test_written_once(spark, sf_dir):
    """However often the result is read; extra columns of any name don't matter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", "1 as ids", "'x' as slot", "2 as task", "3 as file")
    folder = scratch(spark, "shards")
    got = materialise(written(sequences(docs, PATH, stride=256), "sequences"), folder, key=3, stride=256, per_shard=64)
    before = files_of(folder)
    n = got.count()
    assert got.filter("slot >= 0").count() == n and files_of(folder) == before
    assert {r.file for r in got.select("file").distinct().collect()} == set(before) and len(before) == -(-n // 64)


def test_files_of_lost_attempts_are_not_read(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "shards")
    materialise(written(sequences(docs, PATH, stride=256), "sequences"), folder, key=3, stride=256, per_shard=64)
    records = [x.tolist() for x in read(folder, 10, 100, 256, 64)]
    (Path(folder.removeprefix("file://")) / "shard-000000000-999999.bin").write_bytes(b"half of it")
    assert [x.tolist() for x in read(folder, 10, 100, 256, 64)] == records


def test_empty_table(spark):
    rows = written(sequences(spark.createDataFrame([], "doc_id long, text string"), PATH), "sequences")
    assert materialise(rows, scratch(spark, "shards"), key=1).collect() == []


def test_the_json_file_holds_the_same_merges():
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    core = tiktoken.Encoding("x", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe
    for w in (b" hello", "étionment".encode(), b"xqzj" * 20):
        assert core.encode_single_piece(w) == _bpe(PATH).encode_single_piece(w)
