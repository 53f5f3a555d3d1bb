"""Byte-level BPE by merge replay over the distinct words of the corpus.

1. A task splits whole texts into words (matches of the pre-tokenisation pattern) and numbers the distinct words of each block of
   about `block_bytes` of text. Documents go on as the numbers of their words, words under their block and number.
2. Words are shuffled by themselves, so that each distinct word of the corpus is in one task, whatever blocks have it. There the
   merges are replayed on all its words at once: an inverted index leads from a pair of tokens, held under the rank of
   what it merges to, to its positions in the words. Ranks are taken in order; a merge touches its own positions and enters
   the new pairs with their neighbours in the index.
3. Ids go back to the blocks that have the word, and a block's documents take the ids of their words. The table of documents is bucketed by
   block, so they are not shuffled.

A dictionary of all words is broadcast nowhere. What a task holds is bounded: the words of one block or `REPLAY_BYTES` of distinct words.
A very common word has one row for each block.

Defined results: a null text counts as empty and has no ids; repeated rows are encoded each; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augsearch.llm.common import documents, n_tasks, scratch, slices
from augsearch.llm.pretokenize import split

BLOCK_BYTES = 24 << 20
#: Merges are replayed on about so many bytes of distinct words at a time.
REPLAY_BYTES = 4 << 20


class Ranks:
    """Rank files hold a line "base64 rank" for each token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {r: t for t, r in self.rank.items()}
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        # every pair of tokens that together are a token; both are ids, so the pair is one number
        self.base = max(self.token) + 1
        pairs = [(self.rank[t[:i]] * self.base + self.rank[t[i:]], r) for t, r in self.rank.items() for i in range(1, len(t)) if t[:i] in self.rank and t[i:] in self.rank]
        pairs.sort()
        self.pairs, self.merged = (np.array(c, np.int64).reshape(-1) for c in zip(*pairs))
        # tokens whose making may make a pair of lower rank, which then goes before others of the same rank
        sides = np.maximum(*np.divmod(self.pairs, self.base))
        self.lower = np.zeros(self.base, bool)
        self.lower[sides[self.merged < sides]] = True
        self.lower[self.byte] = False

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair merges to, -1 for none."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.pairs[at] == key), self.merged[at], -1)

    def one_word(self, word: bytes) -> list[int]:
        """Merges the leftmost pair of the least rank, one at a time."""
        token, n = self.byte[np.frombuffer(word, np.uint8)].tolist(), len(word)
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.of_pairs(np.array(token[:-1], np.int64), np.array(token[1:], np.int64)).tolist() if n > 1 else []
        queue = [(r, i) for i, r in enumerate(ranks) if r >= 0]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = following[i]
            if token[i] < 0 or j >= n or self.rank.get(self.token[token[i]] + self.token[token[j]]) != rank:
                continue
            token[i], token[j], following[i] = rank, -1, following[j]
            if following[i] < n:
                previous[following[i]] = i
            for a in (previous[i], i):
                if a >= 0 and following[a] < n:
                    r = self.rank.get(self.token[token[a]] + self.token[token[following[a]]])
                    if r is not None:
                        heapq.heappush(queue, (r, a))
        return [t for t in token if t >= 0]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and where each word's ids end."""
        whole = np.array([self.rank.get(w, -1) for w in words], np.int64)
        data = b"\0".join([w if r < 0 else b"" for w, r in zip(words, whole)]) + b"\0"
        sizes = np.array([len(w) if r < 0 else 0 for w, r in zip(words, whole)], np.int64)
        ends = np.cumsum(sizes + 1) - 1  # a separator follows each word
        token = self.byte[np.frombuffer(data, np.uint8)]
        token[ends] = np.where(whole >= 0, -2 - whole, -1)  # words that are a token are not replayed
        n = len(token)
        following, previous = np.arange(1, n + 1), np.arange(-1, n - 1)
        index: dict[int, list[np.ndarray]] = defaultdict(list)
        queue: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Puts the pairs that begin at these positions into the index."""
            ranks = self.of_pairs(token[at], token[following[at]])
            at, ranks = at[ranks >= 0], ranks[ranks >= 0]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for r, part in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts)):
                if r not in index:
                    heapq.heappush(queue, r)
                index[r].append(part)

        enter(np.flatnonzero(token[:-1] >= 0))
        again: set[int] = set()
        self.by_word = again
        while queue:
            rank = heapq.heappop(queue)
            parts = index.pop(rank)
            at = np.unique(np.concatenate(parts)) if len(parts) > 1 else np.sort(parts[0])
            at = at[token[at] >= 0]
            at = at[self.of_pairs(token[at], token[following[at]]) == rank]
            if not len(at):
                continue
            touching = following[at[:-1]] == at[1:]
            if touching.any():  # of pairs that share a token the leftmost goes first
                keep, taken = [], False
                for x, t in zip(at.tolist(), [False, *touching.tolist()]):
                    taken = not (t and taken)
                    if taken:
                        keep.append(x)
                at = np.array(keep)
            gone = following[at]
            if self.lower[rank]:  # a pair of lower rank would go before others of this rank: such words go by one_word
                right, left = token[following[gone]], np.where(previous[at] >= 0, token[previous[at]], -1)
                same = np.full(len(at), rank)
                first = ((0 <= (r := self.of_pairs(same, right))) & (r < rank)) | ((0 <= (r := self.of_pairs(left, same))) & (r < rank))
                twice = (0 <= (r := self.of_pairs(same[:1], same[:1]))) & (r < rank)
                again.update(np.searchsorted(ends, at[first | twice]).tolist())
            token[at] = rank
            token[gone] = -1 << 40
            after = following[gone]
            following[at] = after
            previous[after[after < n]] = at[after < n]
            left = previous[at]
            enter(np.union1d(at, left[(left >= 0) & (token[left] >= 0)]))
        live = token > -1 << 40
        single = token < -1
        token = np.where(single & live, -2 - token, token)
        separator = np.zeros(n, bool)
        separator[ends] = True
        use = live & (~separator | single)
        stops = np.cumsum(use)[ends]
        ids = token[use]
        if again:
            pieces = np.split(ids, stops[:-1])
            for w in again:
                pieces[w] = np.array(self.one_word(words[w]), np.int64)
            ids, stops = np.concatenate(pieces), np.cumsum([len(p) for p in pieces])
        return ids, stops


@lru_cache(2)
def ranks_of(path: str) -> Ranks:
    return Ranks(path)


#: A row is a run of a block's documents (part WHOLE: ids, and a blob of the numbers of their words) or the words of a block that go to one part of the
#: corpus's words (their numbers and bytes), later their ids. Blobs are compressed here, since rows of a word each would be mostly overhead.
_ROW = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("docs", pa.list_(pa.int64())), ("sizes", pa.binary()), ("blob", pa.binary())])
_ROW_DDL = "block long, part int, docs array<long>, sizes binary, blob binary"
WHOLE = 2**31 - 1


def _packed(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all low bytes first: so they compress best."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<i4").reshape(-1, 1).view(np.uint8).T).tobytes(), 3)


def _unpacked(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROW)], schema=_ROW)


def _numbered(block_bytes: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        words: defaultdict[str, int] = defaultdict()
        words.default_factory = words.__len__

        def dictionary():
            known = [w.encode() for w in words]
            part = np.fromiter(map(zlib.crc32, known), np.int64, len(known)) % parts
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            for at in np.split(order, cuts) if len(order) else []:
                some = [known[i] for i in at.tolist()]
                sizes = _packed(np.array([np.diff(at, prepend=0), [len(w) for w in some]]))
                yield _rows([(block, int(part[at[0]]), None, sizes, zstandard.compress(b"".join(some), 3))])

        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                numbers = [[words[w] for w in split(t)] for t in texts]
                flat = np.fromiter(itertools.chain.from_iterable(numbers), np.int64)
                yield _rows([(block, WHOLE, batch.column(0).to_pylist(), _packed(np.array([len(n) for n in numbers], np.int64)), _packed(flat))])
                held += sum(map(len, texts))
                if held > block_bytes:
                    yield from dictionary()
                    words.clear()
                    block, held = block + 1, 0
        yield from dictionary()

    return run


def _replayed(path: str, replay_bytes: int):
    """Words of one part, from all blocks -> their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(path)
        distinct: defaultdict[bytes, int] = defaultdict()
        distinct.default_factory = distinct.__len__
        rows: list[tuple] = []
        held = 0

        def out():
            known = list(distinct)
            of_word: list[np.ndarray] = []
            ends = np.cumsum([len(w) for w in known])
            for some in np.split(np.arange(len(known)), np.searchsorted(ends, np.arange(replay_bytes, int(ends[-1]), replay_bytes))):
                if len(some):
                    ids, stops = ranks.replay(known[some[0] : some[-1] + 1])
                    of_word += np.split(ids.astype("<i4"), stops[:-1])
            for block, part, numbers, at in rows:
                ids = [of_word[k] for k in at]
                yield _rows([(block, part, None, _packed(np.array([numbers, [len(x) for x in ids]])), _packed(np.concatenate(ids)))])

        for b in batches:
            for block, part, sizes, blob in zip(*(b.column(k).to_pylist() for k in (0, 1, 3, 4))):
                numbers, lengths = _unpacked(sizes).reshape(2, -1)
                word, ends = zstandard.decompress(blob), np.cumsum(lengths)
                rows.append((block, part, numbers, [distinct[word[e - n : e]] for e, n in zip(ends.tolist(), lengths.tolist())]))
                held += len(word)
                if held > 4 * replay_bytes:
                    yield from out()
                    distinct.clear()
                    rows, held = [], 0
        if rows:
            yield from out()

    return run


def _by_block(docs: DataFrame, path: str, block_bytes: int, convert, schema: pa.Schema, ddl: str) -> DataFrame:
    """convert: ids of a block's words by number -> (doc_ids and the numbers of their words -> batches)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # parts have so few bytes of words that one task can hold each distinct word of a part once
    parts = n_tasks(spark, n_bytes // (8 * REPLAY_BYTES))
    # bucketed by block, so that documents, which are most of it, need no shuffle to meet their words
    name, at = f"words_{uuid.uuid4().hex}", scratch(spark, "words")
    numbered = docs.mapInArrow(_numbered(block_bytes, parts), _ROW_DDL)
    numbered.write.bucketBy(n_tasks(spark), "block").option("path", at).option("compression", "none").format("parquet").saveAsTable(name)
    numbered = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # of the catalog's entry, which is only needed to know the buckets; files outside the warehouse stay
    words = numbered.filter(F.col("part") != WHOLE).repartitionById(parts, F.col("part")).mapInArrow(_replayed(path, REPLAY_BYTES), _ROW_DDL)

    def meet(whole: pa.Table, ids: pa.Table) -> pa.Table:
        of_word: dict[int, np.ndarray] = {}
        for sizes, blob in zip(ids.column("sizes").to_pylist(), ids.column("blob").to_pylist()):
            steps, lengths = _unpacked(sizes).reshape(2, -1)
            of_word.update(zip(np.cumsum(steps).tolist(), np.split(_unpacked(blob), np.cumsum(lengths)[:-1])))
        encode = convert([of_word[k] for k in range(len(of_word))])
        out = []
        for docs_, sizes, blob in zip(*(whole.column(c).to_pylist() for c in ("docs", "sizes", "blob"))):
            out += encode(docs_, np.split(_unpacked(blob), np.cumsum(_unpacked(sizes))[:-1]))
        return pa.Table.from_batches(out, schema=schema)

    return numbered.filter(F.col("part") == WHOLE).groupBy("block").cogroup(words.groupBy("block")).applyInArrow(meet, ddl)


def encode(docs: DataFrame, ranks_path: str, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def convert(of_word: list[np.ndarray]):
        def run(doc_ids, numbers):
            for i in range(0, len(doc_ids), 256):
                ids = [np.concatenate([of_word[w] for w in n.tolist()]) if len(n) else np.zeros(0, np.int32) for n in numbers[i : i + 256]]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids[i : i + 256], pa.int64()), pa.array(ids, schema.field(1).type)], schema=schema)

        return run

    return _by_block(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ranks_path, block_bytes, convert, schema, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """The columns of encoded, with bytes, the decoded text, in place of the ids."""
    others = [c for c in encoded.columns if c != ids_col]
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != ids_col] + ["bytes binary"])

    def run(batches):
        token = ranks_of(ranks_path).token
        for b in batches:
            got = [b"".join([token[i] for i in ids or []]) for ids in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got, pa.binary())], names=[*others, "bytes"])

    return encoded.select(*others, ids_col).mapInArrow(run, ddl)


def digests(docs: DataFrame, ranks_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """As encode and decode, with only the digests going on."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def convert(of_word: list[np.ndarray]):
        token, counts = ranks_of(ranks_path).token, np.array([len(x) for x in of_word], np.int64)
        decimal = [" ".join(map(str, x.tolist())).encode() for x in of_word]
        decoded = [b"".join(map(token.__getitem__, x.tolist())) for x in of_word]

        def run(doc_ids, numbers):
            rows = []
            for d, n in zip(doc_ids, numbers):
                at = n.tolist()
                rows.append((d, int(counts[n].sum()), hashlib.sha256(b" ".join(map(decimal.__getitem__, at))).hexdigest(), hashlib.sha256(b"".join(map(decoded.__getitem__, at))).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        return run

    return _by_block(docs, ranks_path, block_bytes, convert, schema, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))
