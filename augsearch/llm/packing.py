"""Best-fit packing of documents into sequences of a fixed number of tokens.

The plan is made over the histogram of lengths, not over documents: best-fit decreasing moves whole
runs of equal sequences at a time, so its size depends on the capacity alone (2048 lengths by 2048 rooms at
most). Documents then take the planned slots by joining on their rank within their length.

Ranks need no sort and no task that sees all pieces of a length: a task numbers its own pieces by length, and
the sums of the counts of the tasks before it are added through a join on (task, length).

Defined results: a null text counts as empty and holds the end id alone; repeated rows are packed
each; an empty table gives no rows; extra columns are ignored. A document longer than the capacity is cut
into full pieces after a shorter first one. The added tokens of the file (<|endoftext|>) take their ids where a text has
them, as in tokenizers by default; with encode_special_tokens, its flag, special ones are ordinary text.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from augsearch.llm.common import documents, slices, written
from augsearch.llm.pretokenize import split

CAPACITY = 2048
#: A task remembers the ids of this many words at most.
WORDS = 300_000


@lru_cache(2)
def _bpe(path: str):
    """The byte-level BPE of a tokenizers file. tiktoken's merges give the same ids several times as fast."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    # the file writes each byte as a printable character: itself, or the next free one from U+0100 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    special = {"<|endoftext|>"}  # in a text it is ordinary text
    ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in model["vocab"].items() if t not in special}
    return tiktoken.Encoding("file", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe


@lru_cache(4)
def _added(path: str, encode_special_tokens: bool) -> tuple[re.Pattern | None, dict[str, bytes]]:
    """The added tokens that are found in texts before these are split, the longest first, and their ids as bytes."""
    with open(path, encoding="utf-8") as f:
        tokens = [t for t in json.load(f).get("added_tokens", []) if not (encode_special_tokens and t["special"])]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
        raise ValueError("added tokens that look at their neighbours are not supported")
    ids = {t["content"]: struct.pack("<I", t["id"]) for t in tokens}
    return re.compile("(" + "|".join(map(re.escape, sorted(ids, key=len, reverse=True))) + ")") if ids else None, ids


class _Words(dict):
    """word -> its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        super().__init__()
        self.piece = _bpe(path).encode_single_piece

    def __missing__(self, word: str) -> bytes:
        ids = self.piece(word.encode())
        self[word] = out = struct.pack(f"<{len(ids)}I", *ids)
        return out


def word_encoder(path: str, encode_special_tokens: bool = True) -> Callable[[list[str]], list[bytes]]:
    """texts -> their ids as bytes. Each distinct word is encoded once and remembered."""
    words = _Words(path)
    added, added_ids = _added(path, encode_special_tokens)

    def one(text: str) -> bytes:
        if added is None or added.search(text) is None:
            return b"".join(map(words.__getitem__, split(text)))
        return b"".join(added_ids[x] if i % 2 else b"".join(map(words.__getitem__, split(x))) for i, x in enumerate(added.split(text)))

    def encode(texts: list[str]) -> list[bytes]:
        if len(words) > WORDS:
            words.clear()
        return list(map(one, texts))

    return encode


_PIECES = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())]


def _pieces(path: str, end_id: int, capacity: int, with_ids: bool, encode_special_tokens: bool):
    schema = pa.schema(_PIECES + [("ids", pa.binary())] * with_ids)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = word_encoder(path, encode_special_tokens), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                rows = []
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()])):
                    ids += end
                    n, start, piece = len(ids) // 4, 0, 0
                    while start < n:
                        length = (n % capacity or capacity) if start == 0 else capacity
                        part = ids[start * 4 : (start + length) * 4]
                        rows.append((doc_id, piece, start, length, zlib.crc32(part), task, int(seen[length])) + (part,) * with_ids)
                        seen[length] += 1
                        start, piece = start + length, piece + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, count, first sequence, offset): the pieces of that length from that rank on go,
    one each, to the sequences from that one on. Best-fit decreasing over counts."""
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # room left -> runs of sequences
    rows, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def place(first: int, n: int, room: int) -> None:
            nonlocal left, rank
            rows.append((length, rank, n, first, capacity - room))
            left, rank = left - n, rank + n

        def fill(first: int, n: int, room: int) -> int:
            """Sequences of the run that got pieces; each takes as many as fit, the last maybe fewer."""
            each = room // length
            used = min(n, left // each)
            if used:
                for k in range(each):
                    place(first, used, room - k * length)
                rooms[room - each * length].append((first, used))
            if used < n and 0 < left < each:
                k = left
                for j in range(k):
                    place(first + used, 1, room - j * length)
                rooms[room - k * length].append((first + used, 1))
                used += 1
            return used

        for room in range(length, capacity + 1):
            while left and rooms[room]:
                first, n = rooms[room].pop()
                if (used := fill(first, n, room)) < n:
                    rooms[room].append((first + used, n - used))
                    break
            if not left:
                break
        if left:
            n = -(-left // (capacity // length))
            fill(opened, n, capacity)
            opened += n
    return np.array(rows, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", encode_special_tokens: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids where asked for."""
    spark = docs.sparkSession
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids binary" * with_ids
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = written(rows.mapInArrow(_pieces(tokenizer, end_id, capacity, with_ids, encode_special_tokens), ddl), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    planned = plan(counts, capacity)
    order = np.lexsort((planned[:, 1], planned[:, 0]))
    shared = spark.sparkContext.broadcast(planned[order])
    before = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = pieces.join(before.select("task", "length", F.coalesce("before", F.lit(0)).alias("before")), ["task", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, (F.col("before") + F.col("nth")).alias("rank"))

    def slot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        widest = int(p[:, 1].max(initial=0) + p[:, 2].max(initial=0)) + 1
        keys = p[:, 0] * widest + p[:, 1]
        for b in batches:
            length, rank = (np.asarray(b.column(b.schema.get_field_index(c))) for c in ("length", "rank"))
            i = np.searchsorted(keys, length * widest + rank, side="right") - 1
            columns = [c for n, c in zip(b.schema.names, b.columns) if n != "rank"]
            names = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(p[i, 3] + rank - p[i, 1]), pa.array(p[i, 4])], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(slot, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), encode_special_tokens=False)
