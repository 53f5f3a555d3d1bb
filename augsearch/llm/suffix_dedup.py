"""Removal of repeated passages by blockwise suffix sorting with cover-sample ranks.

A byte goes when a string of `length` (50) bytes over it also starts in a document of smaller doc_id.

A suffix array of all suffixes would move each byte's first 50 bytes, or at least their ranks, for every
byte of the corpus. Instead a *cover sample* of the suffixes is taken such that two equal strings of 50 bytes have a sampled suffix
at the same offset below 31: the position of the least hash of the string's 31 20-byte grams. (An arithmetic
difference cover has that property for any two strings, but samples 6 of 31 positions; this one samples 1 of 16
and needs to hold for equal strings only.) Then, as in blockwise construction:

1. Sampled suffixes are dealt to buckets by their first 20 bytes. Those of buckets that one text alone has need no sorting: they can't
   repeat, or do so in whole copies of the text, which a hash finds.
2. The rest is sorted one bucket at a time: a task reads its buckets one after another in order of document. It ranks
   the bucket's sampled suffixes by what follows and by what precedes them. A suffix that starts d bytes before its sampled
   one is then placed by these two ranks alone, however long the tie: its class at 50 bytes is the run of
   equal d bytes before and 50 - d bytes after. In each class all documents but the least lose the string.
3. What goes is gathered by document and cut out of the whole text.

A bucket is read in chunks of `chunk` rows; between chunks only distinct contexts are kept, each under its least document. Buckets
of more than `hot` documents go to no single task: their distinct contexts are aggregated under the least document of each, ties between contexts are
resolved by the hash of each 50-byte string that they stand for, and rows find their context's ranks through a join. Unless it is given,
`hot` is the rows that a task has on average, so that no bucket makes a task much larger than the others whatever the size of the corpus, and a chunk at most, so
that a bucket's contexts fit in memory. A passage that a document repeats is one row with all its places.
Matches never cross documents, and strings are judged on the input.

Defined results: a null text counts as empty; rows with a null doc_id are returned whole and remove nothing; rows of one
doc_id never remove from each other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from augsearch.llm.common import documents, freed, n_tasks, numbered, slices, written

LENGTH, GRAM = 50, 20
REACH = LENGTH - GRAM  # a sampled suffix starts at most this far into a string
CHUNK = 200_000
#: Buckets of fewer documents are never split, however small the table.
SMALL = 1000
#: In place of a position: the whole text is that of a smaller document.
COPY = -1

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def sampled(text: np.ndarray) -> np.ndarray:
    """text: bytes as uint8. For each start of a 50-byte string the position of its sampled suffix."""
    m = len(text) - GRAM + 1
    if m <= REACH:
        return np.zeros(0, np.int64)
    words = np.lib.stride_tricks.as_strided(text, (len(text) - 7, 8), (1, 1))
    words = np.ascontiguousarray(words).view("<u8").ravel()
    with np.errstate(over="ignore"):
        h = words[:m] * _A
        h ^= h >> np.uint64(29)
        h += words[8 : m + 8]
        h *= _B
        h ^= h >> np.uint64(32)
        h += words[12 : m + 12]
        h *= _C
    # 32 bits of hash over the position: the least is the leftmost of the least hash
    h &= np.uint64(0xFFFFFFFF00000000)
    h |= np.arange(m, dtype=np.uint64)
    width, span = REACH + 1, 1
    while span * 2 <= width:
        h = np.minimum(h[: len(h) - span], h[span:])
        span *= 2
    if span < width:
        h = np.minimum(h[: len(h) - (width - span)], h[width - span :])
    return (h & np.uint64(0xFFFFFFFF)).astype(np.int64)


def grams(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the 20 bytes at each position."""
    part = text[at[:, None] + np.arange(GRAM)]
    words = np.zeros((len(at), 24), np.uint8)
    words[:, :GRAM] = part
    words = words.view("<u8")
    with np.errstate(over="ignore"):
        h = (words[:, 0] ^ _C) * _B
        h ^= h >> np.uint64(31)
        h = (h ^ words[:, 1]) * _A
        h ^= h >> np.uint64(29)
        h = (h ^ words[:, 2]) * _C
        return h ^ (h >> np.uint64(32))


def _bytes(batches: Iterator[pa.RecordBatch]):
    """Rows in slices, the last column as byte arrays."""
    for whole in batches:
        for b in slices(whole, "text", 1 << 20):
            texts = [np.frombuffer(t or b"", np.uint8) for t in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()]
            yield [c.to_pylist() for c in b.columns[:-1]], texts


def _samples(batches):
    for (doc, th), texts in _bytes(batches):
        ids, hashes, found = [], [], []
        for d, t, text in zip(doc, th, texts):
            at = sampled(text)
            if len(at):
                h = np.unique(grams(text, at[np.concatenate([[True], at[1:] != at[:-1]])]))
                ids.append(np.full(len(h), d))
                hashes.append(np.full(len(h), t))
                found.append(h.view(np.int64))
        if found:
            table = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, hashes, found)], names=["doc_id", "th", "bucket"])
            for i in range(0, table.num_rows, 20_000):
                yield table.slice(i, 20_000)


_CONTEXT = pa.schema([("bucket", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("at", pa.list_(pa.int32())), ("before", pa.int8()), ("least", pa.int8()), ("context", pa.binary())])
_CONTEXT_DDL = "bucket long, doc_id long, th long, at array<int>, before tinyint, least tinyint, context binary"


def _contexts(batches):
    """For each sampled suffix in a shared bucket the strings that it stands for: those that start `least` to `before` bytes before it. Equal ones of
    a document are one row."""
    for (doc, th, buckets), texts in _bytes(batches):
        rows: list[list] = [[] for _ in _CONTEXT]
        for d, t, shared, text in zip(doc, th, buckets, texts):
            of = sampled(text)
            if not len(of):
                continue
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            last = np.append(first[1:], len(of)) - 1
            at = of[first]
            h = grams(text, at).view(np.int64)
            some = np.isin(h, np.array(shared, np.int64))
            at, first, last, h = at[some], first[some], last[some], h[some]
            raw = text.tobytes()
            places: dict[tuple, list] = {}
            for key, p, a, b in zip(h.tolist(), at.tolist(), first.tolist(), last.tolist()):
                places.setdefault((key, p - a, p - b, raw[a : b + LENGTH]), []).append(p)
            for (key, before, least, context), p in places.items():
                for column, value in zip(rows, (key, d, t, p, before, least, context)):
                    column.append(value)
        for i in range(0, len(rows[0]), 8192):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 8192], f.type) for c, f in zip(rows, _CONTEXT)], schema=_CONTEXT)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts (c, doc_id, before, least, context) -> a row for each string: c, d (how far before the suffix it starts), its hash, doc_id."""
    for whole in batches:
        for b in slices(whole, "context", 1 << 18):
            out: list[list] = [[], [], [], []]
            for c, doc, before, least, context in zip(*(x.to_pylist() for x in b.columns)):
                for d in range(least, before + 1):
                    digest = hashlib.blake2b(context[before - d : before - d + LENGTH], digest_size=16).digest()
                    for column, value in zip(out, (c, d, digest, doc)):
                        column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.binary(), pa.int8(), pa.binary(), pa.int64()))], names=["c", "d", "string", "doc_id"])


def _hot_marks(contexts: DataFrame) -> DataFrame:
    """What goes by the contexts of hot buckets, with no bucket gathered anywhere."""
    rows = contexts.withColumn("c", F.unhex(F.md5(F.concat(F.col("before").cast("string").cast("binary"), F.lit(b"-"), F.col("least").cast("string").cast("binary"), F.lit(b"-"), F.hex("bucket").cast("binary"), F.col("context")))))
    # equal contexts fall together before they are shuffled
    distinct = rows.groupBy("c").agg(F.min("doc_id").alias("doc_id"), F.first("before").alias("before"), F.first("least").alias("least"), F.first("context").alias("context"))
    strings = written(distinct.mapInArrow(_strings, "c binary, d tinyint, string binary, doc_id long"), "hot-strings")
    ranks = strings.select("c", "d", "string").join(strings.groupBy("string").agg(F.min("doc_id").alias("least_doc")), "string")
    ranks = ranks.groupBy("c").agg(F.collect_list(F.struct("d", "least_doc")).alias("ranks"))  # 31 at most
    bit = F.expr("aggregate(ranks, 0L, (m, x) -> m + if(x.least_doc < doc_id, shiftleft(1L, cast(x.d as int)), 0L))")
    return rows.select("c", "doc_id", "th", "at").join(ranks, "c").select("doc_id", "th", "at", bit.alias("mask")).filter("mask > 0")


def _padded(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, step: int) -> np.ndarray:
    """Rows of up to 56 bytes from starts on (step 1) or backwards (step -1), as big-endian words, zeros after the size."""
    column = np.arange(56)
    at = starts[:, None] + step * column
    inside = column < sizes[:, None]
    out = data[np.where(inside, at, 0)]
    out[~inside] = 0
    return np.ascontiguousarray(out).view(">u8").astype(np.uint64)


def _order(bucket: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by bucket and words; how many bytes each row shares with the row before it, -1 where the bucket begins."""
    used = words[:, : max(1, int(np.flatnonzero(words.any(0)).max(initial=0)) + 1)]
    order = np.lexsort((*used.T[::-1], bucket))
    b, w = bucket[order], words[order]
    differ = w[1:] ^ w[:-1]
    where = (differ != 0).argmax(1)
    word = differ[np.arange(len(differ)), where]
    high = np.zeros(len(word), np.int64)
    for shift in (32, 16, 8):  # leading zero bytes of the first word that differs
        zero = word < (np.uint64(1) << np.uint64(64 - shift))
        high += np.where(zero, shift // 8, 0)
        word = np.where(zero, word << np.uint64(shift), word)
    common = np.where((differ == 0).all(1), 56, where * 8 + high)
    common[b[1:] != b[:-1]] = -1
    return order, np.concatenate([[-1], common])


def repeats(bucket: np.ndarray, doc: np.ndarray, before: np.ndarray, least: np.ndarray, contexts: pa.Array) -> np.ndarray:
    """For each row a mask: bit d is set when the string that starts d bytes before the sampled suffix is also in a smaller document."""
    contexts = contexts.cast(pa.large_binary())
    offsets = np.frombuffer(contexts.buffers()[1], np.int64)[contexts.offset : contexts.offset + len(contexts) + 1]
    data = np.frombuffer(contexts.buffers()[2], np.uint8)
    anchor = offsets[:-1] + before
    after_order, after = _order(bucket, _padded(data, anchor, LENGTH - least, 1))
    before_order, ahead = _order(bucket, _padded(data, anchor - 1, before, -1))
    mask = np.zeros(len(bucket), np.int64)
    run_after, run_before = np.zeros(len(bucket), np.int64), np.zeros(len(bucket), np.int64)
    for d in range(REACH + 1):
        active = np.flatnonzero((least <= d) & (d <= before))
        if len(active) < 2:
            continue
        run_after[after_order] = np.cumsum(after < LENGTH - d)
        run_before[before_order] = np.cumsum(ahead < d)
        key = (run_after[active] << 32) | run_before[active]
        order = np.argsort(key, kind="stable")
        sorted_key, sorted_doc = key[order], doc[active[order]]
        first = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
        smallest = np.repeat(np.minimum.reduceat(sorted_doc, first), np.diff(np.append(first, len(order))))
        mask[active[order]] |= (smallest < sorted_doc).astype(np.int64) << d
    return mask


def _sorted_buckets(chunk: int):
    """Rows by bucket, then document -> the rows that lose a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = kept = 0  # rows held, and how many of them only stand for what came before

        def worked(rows: pa.Table, skip: int) -> pa.RecordBatch:
            bucket, doc, th, before, least = (np.asarray(rows.column(i)) for i in (0, 1, 2, 4, 5))
            before, least = before.astype(np.int64), least.astype(np.int64)
            mask = repeats(bucket, doc, before, least, rows.column(6).combine_chunks() if isinstance(rows.column(6), pa.ChunkedArray) else rows.column(6))
            some = np.flatnonzero(mask > 0)
            some = some[some >= skip]
            at = rows.column(3).take(pa.array(some))
            at = at.combine_chunks() if isinstance(at, pa.ChunkedArray) else at
            return pa.RecordBatch.from_arrays([pa.array(doc[some]), pa.array(th[some]), at, pa.array(mask[some])], names=["doc_id", "th", "at", "mask"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n < max(chunk, 2 * kept):
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            bucket = np.asarray(rows.column(0))
            cut = int(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))[-1])
            if cut >= max(kept, n // 2):  # the last bucket may go on
                yield worked(rows.slice(0, cut), kept)
                held, n, kept = rows.slice(cut).combine_chunks().to_batches(), n - cut, 0
            else:  # a large bucket: go on with its distinct contexts, under the least document
                yield worked(rows, kept)
                last = rows.slice(cut)
                seen, keep = set(), []
                for i, x in enumerate(zip(last.column(4).to_pylist(), last.column(5).to_pylist(), last.column(6).to_pylist())):
                    if x not in seen:
                        seen.add(x)
                        keep.append(i)
                last = last.take(pa.array(keep)).combine_chunks()
                held, n, kept = last.to_batches(), last.num_rows, last.num_rows
        if held:
            yield worked(pa.Table.from_batches(held).combine_chunks(), kept)

    return run


def _gone(ats: list[list[int]] | None, masks: list[int] | None, text: np.ndarray) -> np.ndarray:
    """Which bytes of the text go."""
    if ats is None:
        return np.zeros(len(text), bool)
    if any(at[0] == COPY for at in ats):
        return np.full(len(text), len(text) >= LENGTH)
    at, mask = np.array([p for x in ats for p in x], np.int64), np.repeat(np.array(masks, np.int64), [len(x) for x in ats])
    bits = (mask[:, None] >> np.arange(REACH + 1)) & 1
    starts = (at[:, None] - np.arange(REACH + 1))[bits > 0]
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


def _digests(batches):
    for (doc, ats, masks), texts in _bytes(batches):
        rows = []
        for d, at, mask, text in zip(doc, ats, masks, texts):
            gone = _gone(at, mask, text)
            change = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
            rows.append((d, len(text), int(gone.sum()), len(change) // 2, hashlib.sha256(text[~gone].tobytes()).hexdigest(), change.tolist()))
        d, n, gone, spans, sha, change = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha), pa.array(change, pa.list_(pa.int64()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def _marks(docs: DataFrame, chunk: int, hot: int | None) -> DataFrame:
    """docs: doc_id, th (the hash of the text), text -> doc_id, th, ats, masks: what to remove, for documents that lose anything."""
    spark = docs.sparkSession
    known = docs.filter("doc_id is not null").select("doc_id", "th", "text")
    # a copy of a smaller document goes whole, so buckets that only copies of one text share need no sorting
    whole = known.select("doc_id", "th", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))
    copies = whole.join(whole.groupBy("sha").agg(F.min("doc_id").alias("first")), "sha").filter("doc_id > first").select("doc_id", "th").distinct()
    copies = copies.select("doc_id", "th", F.array(F.lit(COPY)).alias("at"), F.lit(0).cast("long").alias("mask"))
    by_bucket = Window.partitionBy("bucket")
    samples = known.mapInArrow(_samples, "doc_id long, th long, bucket long")
    shared = samples.withColumns({"low": F.min("th").over(by_bucket), "high": F.max("th").over(by_bucket), "docs": F.count("*").over(by_bucket)}).filter("low < high").select("doc_id", "th", "bucket", F.col("docs").cast("int").alias("docs"))
    shared = written(shared, "shared-buckets")
    if hot is None:
        hot = min(chunk, max(SMALL, shared.count() // n_tasks(spark)))
    freed(spark, 3)

    is_hot = F.col("docs") > hot

    def contexts(hot: bool) -> DataFrame:
        wanted = shared.filter(is_hot if hot else ~is_hot).groupBy("doc_id", "th").agg(F.collect_set("bucket").alias("buckets"))
        return known.join(wanted, ["doc_id", "th"]).select("doc_id", "th", "buckets", "text").mapInArrow(_contexts, _CONTEXT_DDL)

    dealt = contexts(False).repartition(n_tasks(spark), "bucket").sortWithinPartitions("bucket", "doc_id")
    marks = written(dealt.mapInArrow(_sorted_buckets(chunk), "doc_id long, th long, at array<int>, mask long"), "marks")
    freed(spark, 3)
    if not shared.filter(is_hot).isEmpty():  # once the disk of the others is free
        marks = marks.union(written(_hot_marks(written(contexts(True), "hot-contexts")), "hot-marks"))
        freed(spark, 3)
    return marks.union(copies).groupBy("doc_id", "th").agg(F.collect_list(F.struct("at", "mask")).alias("marks")).select("doc_id", "th", F.col("marks.at").alias("ats"), F.col("marks.mask").alias("masks"))


def suffix_dedup(docs: DataFrame, chunk: int = CHUNK, hot: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (begin, end, begin, end ... of what goes)."""
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    marked = docs.join(_marks(docs, chunk, hot), ["doc_id", "th"], "left")
    return marked.select("doc_id", "ats", "masks", "text").mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")


def without_repeats(docs: DataFrame, chunk: int = CHUNK, hot: int | None = None) -> DataFrame:
    """docs, any columns of any names, with what is left of each text; a character that loses some of its bytes goes whole."""
    at, rows = docs.columns.index("text"), numbered(docs)
    names = rows.columns
    doc, text = F.col(f"c{docs.columns.index('doc_id')}").cast("long"), F.col(f"c{at}").cast("string")
    hashed = rows.withColumns({"doc_id": doc, "th": F.xxhash64(text)})
    marks = _marks(hashed.select("doc_id", "th", text.alias("text")), chunk, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, f"c{at}", 1 << 20):
                gone = zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist())
                raw = [None if t is None else np.frombuffer(t, np.uint8) for t in b.column(at).cast(pa.binary()).to_pylist()]
                left = [None if t is None else t[~_gone(*g, t)].tobytes().decode("utf-8", "ignore") for g, t in zip(gone, raw)]
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()) if i == at else c for i, c in enumerate(b.columns[:-2])], names=names)

    return hashed.join(marks, ["doc_id", "th"], "left").select(*names, "ats", "masks").mapInArrow(run, rows.schema).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir)).drop("spans")
