"""Training-order materialisation: token sequences in shards of fixed-stride records.

Sequences are numbered 0 to N - 1: a task numbers its own, and the counts of the tasks before it come on top. A
keyed Feistel network permutes the smallest even power of two that holds N; cycle-walking (going on until the result is
below N) makes it a permutation of exactly the N numbers. So each sequence knows its global slot with no sort and
no table of slots, and the inverse says which sequence a slot holds.

Slots are dealt to shards of `per_shard` records in ranges. A shard is written by one task, in slot order, to a file whose name has the
attempt's number, and never renamed. The rows that describe the records go to a table beside the shards, and Spark commits those of one attempt of
each task alone, so the table says which file is the shard, whatever attempts ran or were lost; files of other attempts hold the same bytes
and are read by nobody. Everything is written once, however often the result is read. Record i of a shard is at byte i * stride * 2, so that training
reads on from any slot.

Tokens are unsigned 16-bit little-endian. A record shorter than the stride ends in `pad_id`.

Defined results: a null text counts as empty and gives its end id alone; repeated rows are sequences of their own; an
empty table gives no shard; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import dataset as ds
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augsearch.llm.common import documents, scratch, slices, written
from augsearch.llm.packing import word_encoder

STRIDE, PER_SHARD, ROUNDS = 2048, 4096, 6
#: The table beside the shards.
RECORDS, _RECORD_DDL = "records", "slot long, shard int, file string, byte_offset long, length int, ids_crc32 long, doc_ids array<long>"


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser over x and the key of a round."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


class Permutation:
    """A keyed permutation of 0 to n - 1."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, -(-max(n - 1, 1).bit_length() // 2))
        self.keys = [int(_mix(np.array([key & (2**64 - 1)], np.uint64), r + 1)[0]) for r in range(ROUNDS)]

    def _walk(self, x: np.ndarray, once) -> np.ndarray:
        x = once(np.asarray(x).astype(np.uint64))
        while (out := x >= np.uint64(self.n)).any():
            x[out] = once(x[out])
        return x.astype(np.int64)

    def _halves(self, x):
        h, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        return x >> h, x & mask, h, mask

    def _forward(self, x):
        left, right, h, mask = self._halves(x)
        for k in self.keys:
            left, right = right, left ^ (_mix(right, k) & mask)
        return (left << h) | right

    def _backward(self, x):
        left, right, h, mask = self._halves(x)
        for k in reversed(self.keys):
            left, right = right ^ (_mix(left, k) & mask), left
        return (left << h) | right

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, self._forward)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self._backward)


def sequences(docs: DataFrame, tokenizer: str, end_id: int = 50256, stride: int = STRIDE) -> DataFrame:
    """task, nth, doc_ids, length, ids: the documents of a task one after the other, each followed by end_id, cut at the stride."""
    schema = pa.schema([("task", pa.int32()), ("nth", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("length", pa.int32()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, nth = word_encoder(tokenizer), TaskContext.get().partitionId(), 0
        end, held, members = np.array([end_id], "<u2").tobytes(), bytearray(), []
        size = 2 * stride
        rows: list = []

        def cut(last: bool) -> None:
            nonlocal nth, held, members
            at = 0
            while len(held) - at >= size or last and at < len(held):
                part = bytes(held[at : at + size])
                inside = [d for d, a, b in members if a < at + size and b > at]
                rows.append((task, nth, inside, len(part) // 2, part))
                nth, at = nth + 1, at + size
            members = [(d, a - at, b - at) for d, a, b in members if b > at]
            del held[:at]

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows.clear()
            return batch

        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()])):
                    ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes() + end
                    members.append((doc_id, len(held), len(held) + len(ids)))
                    held += ids
                    if len(held) >= size:
                        cut(False)
                if rows:
                    yield out()
        cut(True)
        if rows:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "task int, nth long, doc_ids array<long>, length int, ids binary")


def _filesystem(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def shard_name(shard: int, attempt: int) -> str:
    return f"shard-{shard:09d}-{attempt}.bin"


def materialise(rows: DataFrame, folder: str, key: int, stride: int = STRIDE, per_shard: int = PER_SHARD, pad_id: int = 50256) -> DataFrame:
    """rows: task, nth, doc_ids, length, ids (a table, not a plan: it is read twice). Writes the shards, and the table of their records, into the folder, which is to be a new one.

    Returns that table, one row per sequence, as read back from its shard: slot, shard, file, byte_offset, length, ids_crc32, doc_ids.
    """
    spark = rows.sparkSession
    counts = {r.task: r.n for r in rows.groupBy("task").agg(F.count("*").alias("n")).collect()}  # 8 bytes for each task of the first pass
    tasks = np.array(sorted(counts), np.int64)
    sizes = np.array([counts[t] for t in tasks.tolist()], np.int64)
    total = int(sizes.sum())
    first = np.zeros(int(tasks.max(initial=-1)) + 1, np.int64)
    first[tasks] = np.cumsum(sizes) - sizes
    permutation, before = Permutation(total, key), spark.sparkContext.broadcast(first)
    n_shards = max(1, -(-total // per_shard))

    def place(batches):
        shrink = zstandard.ZstdCompressor(level=6)  # records go through the shuffle as small as they get
        for b in batches:
            task, nth = (np.asarray(b.column(i)) for i in (0, 1))
            slot = permutation.slot(before.value[task] + nth) if len(task) else nth
            packed = pa.array([shrink.compress(ids) for ids in b.column(4).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array((slot // per_shard).astype(np.int32)), b.column(2), b.column(3), packed], names=["slot", "shard", "doc_ids", "length", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task has the whole of each of its shards, in slot order."""
        where, root = _filesystem(folder)
        context = TaskContext.get()
        now, target, name, rows_ = None, None, None, []

        def close():
            target.close()
            with where.open_input_file(f"{root}/{name}") as f:  # what the result says is what the file holds
                out = []
                for slot, length, doc_ids in rows_:
                    at = (slot - now * per_shard) * stride * 2
                    out.append((slot, now, name, at, length, zlib.crc32(f.read_at(stride * 2, at)[: 2 * length]), doc_ids))
            rows_.clear()
            schema = pa.schema([("slot", pa.int64()), ("shard", pa.int32()), ("file", pa.string()), ("byte_offset", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_ids", pa.list_(pa.int64()))])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        padding = np.array([pad_id], "<u2").tobytes()
        for b in batches:
            for slot, shard, doc_ids, length, ids in zip(*(c.to_pylist() for c in b.columns)):
                if shard != now:
                    if now is not None:
                        yield close()
                    now, name = shard, shard_name(shard, context.taskAttemptId())
                    where.create_dir(root, recursive=True)
                    target = where.open_output_stream(f"{root}/{name}")
                target.write(zstandard.decompress(ids) + padding * (stride - length))
                rows_.append((slot, length, doc_ids))
        if now is not None:
            yield close()

    placed = rows.select("task", "nth", "doc_ids", "length", "ids").mapInArrow(place, "slot long, shard int, doc_ids array<long>, length int, ids binary")
    dealt = placed.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("slot")
    table = f"{folder.rstrip('/')}/{RECORDS}"
    dealt.mapInArrow(write, _RECORD_DDL).write.option("compression", "zstd").parquet(table)
    return spark.read.schema(_RECORD_DDL).parquet(table)


def read(folder: str, first_slot: int, n: int, stride: int = STRIDE, per_shard: int = PER_SHARD) -> Iterator[np.ndarray]:
    """The records of n slots from first_slot on, in training order, each read at its offset."""
    where, root = _filesystem(folder)
    some = (ds.field("slot") >= first_slot) & (ds.field("slot") < first_slot + n)
    files = ds.dataset(f"{root}/{RECORDS}", filesystem=where, format="parquet").to_table(columns=["shard", "file"], filter=some)
    file_of = dict(zip(files["shard"].to_pylist(), files["file"].to_pylist()))
    slot = first_slot
    while slot < first_slot + n:
        shard, i = divmod(slot, per_shard)
        with where.open_input_file(f"{root}/{file_of[shard]}") as f:
            some = min(per_shard - i, first_slot + n - slot)
            data = f.read_at(some * stride * 2, i * stride * 2)
        yield from np.frombuffer(data, "<u2").reshape(-1, stride)
        slot += some


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = written(sequences(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")), "sequences", level=6, page_bytes=4 << 20)
    return materialise(rows, scratch(spark, "shards"), key=20_240_601)
