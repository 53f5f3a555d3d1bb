"""Exact deduplication through an extendible-hash index on shared files.

One pass over the documents normalises each text, hashes it and writes *postings* to the folder
that the cluster shares: a member row for each document and, for each distinct text of a task, an entry
row that holds the text itself. The entries are the index. Its directory has 2^depth slots over the leading
bits of the hash; it starts with one bucket, and as long as a bucket holds more than `bucket_bytes`, that
bucket splits by its next bit and the directory doubles where it must. Owner tasks then take key
ranges (runs of whole buckets of about `owner_bytes`), read their entries in key order, chain entries of
equal hash and compare their bytes, so that a collision of hashes never joins two texts.

Skew: a task sends one entry for all its copies of a text, so an owner gets a hot text once a task at
most, and streams it. Documents find their class by the number of their local group, which is
spread over all tasks, not by the hot hash.

Defined results: a null text counts as empty; rows with a null doc_id come last in a class; of repeated rows
(same doc_id and text) exactly one is kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augsearch.llm.common import columns, documents, n_tasks, record_batches, slices, written

_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
#: The directory has at most 2^MAX_DEPTH slots (24 bytes each where it is broadcast).
MAX_DEPTH = 20

_POSTING = pa.schema([("doc_id", pa.int64()), ("grp", pa.int64()), ("first", pa.bool_()), ("key", pa.int64()), ("sha", pa.binary()), ("n", pa.int64()), ("n_bytes", pa.int64()), ("text", pa.binary())])
_POSTING_DDL = "doc_id long, grp long, first boolean, key long, sha binary, n long, n_bytes long, text binary"


def normalised(text: bytes) -> bytes:
    """Each run of the bytes 0x20 and 0x09 to 0x0D as one space."""
    text = text.translate(_SPACES)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Member rows and, for each distinct text held, one entry row; what is held stays below 32 MB."""
    number = TaskContext.get().partitionId() << 40
    groups: dict[bytes, list] = {}
    held = 0

    def flush():
        nonlocal groups, held
        doc, grp, first, key, sha, n, n_bytes, texts = ([] for _ in range(8))
        for digest, chain in groups.items():
            k = int.from_bytes(digest[:8], "big", signed=True)
            for text, g, ids in chain:
                ids.sort(key=lambda x: (x is None, x or 0))
                doc += ids
                grp += [g] * len(ids)
                first += [True] + [False] * (len(ids) - 1)
                key += [k] * len(ids)
                sha += [digest] * len(ids)
                n += [len(ids)] + [None] * (len(ids) - 1)
                n_bytes += [len(text)] + [None] * (len(ids) - 1)
                texts += [text] + [None] * (len(ids) - 1)
        groups, held = {}, 0
        yield from record_batches(_POSTING, [doc, grp, first, key, sha, n, n_bytes, texts], 1024)

    for whole in batches:
        for batch in slices(whole, "text"):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                text = normalised(text or b"")
                digest = hashlib.sha256(text).digest()
                chain = groups.setdefault(digest, [])
                for entry in chain:
                    if entry[0] == text:
                        entry[2].append(doc_id)
                        held += 40
                        break
                else:
                    chain.append((text, number, [doc_id]))
                    number += 1
                    held += len(text) + 300
            if held > 32 << 20:
                yield from flush()
    yield from flush()


@dataclass
class Directory:
    """slot -> bucket; a bucket's local depth says how many leading bits its keys share."""

    depth: int
    bucket: np.ndarray
    local_depth: np.ndarray
    n_bytes: np.ndarray

    @classmethod
    def grown(cls, leaves: np.ndarray, capacity: float) -> Directory:
        """leaves: bytes by the leading bits of the key, a power of two of them, at most 2^MAX_DEPTH."""
        most, depth, bucket = int(np.log2(len(leaves))), 0, np.zeros(1, int)
        prefix, local, size = [0], [0], [float(leaves.sum())]
        sums = np.concatenate([[0.0], np.cumsum(leaves)])
        full = [b for b in (0,) if size[b] > capacity and local[b] < most]
        while full:
            b = full.pop()
            if local[b] == depth:
                depth, bucket = depth + 1, np.repeat(bucket, 2)  # the directory doubles
            local[b] += 1
            prefix[b] *= 2
            local.append(local[b])
            prefix.append(prefix[b] + 1)
            new = len(local) - 1
            for x in (b, new):
                width = 1 << (most - local[x])
                size[x : x + 1] = [sums[(prefix[x] + 1) * width] - sums[prefix[x] * width]]
                if size[x] > capacity and local[x] < most:
                    full.append(x)
            run = 1 << (depth - local[new])
            bucket[prefix[new] * run : (prefix[new] + 1) * run] = new
        return cls(depth, bucket, np.array(local), np.array(size))


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in key order -> the class of each local group."""
    schema = pa.schema([("grp", pa.int64()), ("keep_id", pa.int64()), ("keep_grp", pa.int64()), ("group_size", pa.int64())])
    rows: list[list] = [[], [], [], []]
    chain: list[list] = []  # [text, (is null, doc_id, grp) of the least, n, groups]
    now = None

    def close():
        for _, (null, doc_id, grp), n, groups in chain:
            rows[0].extend(groups)
            rows[1].extend([None if null else doc_id] * len(groups))
            rows[2].extend([grp] * len(groups))
            rows[3].extend([n] * len(groups))

    for batch in batches:
        for key, text, doc_id, grp, n in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if key != now:
                close()
                chain, now = [], key
            least = (doc_id is None, doc_id or 0, grp)
            for entry in chain:
                if entry[0] == text:
                    entry[1], entry[2] = min(entry[1], least), entry[2] + n
                    entry[3].append(grp)
                    break
            else:
                chain.append([text, least, n, [grp]])
        if len(rows[0]) > 10_000:
            yield from record_batches(schema, rows)
            rows = [[], [], [], []]
    close()
    yield from record_batches(schema, rows)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 4 << 20, owner_bytes: int = 64 << 20) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    postings = written(rows.mapInArrow(_postings, _POSTING_DDL), "exact-postings")
    entries = postings.filter("text is not null")
    total = entries.agg(F.sum("n_bytes")).first()[0] or 0
    capacity = max(bucket_bytes, total / (1 << (MAX_DEPTH - 3)))
    bits = int(min(MAX_DEPTH, max(1, np.ceil(np.log2(max(total, 1) / capacity + 1)) + 3)))
    slot = F.shiftrightunsigned("key", 64 - bits)
    leaves = np.zeros(1 << bits)
    for k, n in entries.groupBy(slot.alias("slot")).agg(F.sum("n_bytes")).collect():  # at most 2^MAX_DEPTH rows
        leaves[k] = n
    directory = Directory.grown(leaves, capacity)
    bucket = np.repeat(directory.bucket, len(leaves) >> directory.depth)
    n_owners = n_tasks(spark, int(total // owner_bytes) + 1)
    starts = np.cumsum(leaves) - leaves
    start = np.full(len(directory.local_depth), np.inf)
    np.minimum.at(start, bucket, starts)  # a bucket's place in key order decides who owns it
    owner = np.minimum(n_owners - 1, start[bucket] * n_owners / max(total, 1)).astype(int)
    table = spark.createDataFrame(pa.table({"slot": np.arange(len(leaves)), "bucket": bucket, "owner": owner.astype(np.int32)}))
    owned = entries.withColumn("slot", slot).join(F.broadcast(table), "slot").repartitionById(n_owners, F.col("owner")).sortWithinPartitions("bucket", "key", "grp")
    classes = owned.select("key", "text", "doc_id", "grp", "n").mapInArrow(_chains, "grp long, keep_id long, keep_grp long, group_size long")
    members = postings.select("doc_id", "grp", "first", "sha")
    return members.join(classes, "grp").select("doc_id", "keep_id", "group_size", (F.col("first") & (F.col("grp") == F.col("keep_grp"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, any columns of any names, that stay; of repeated rows (same doc_id and text) one, whichever."""
    key = ["id", "none", "sha"]
    found = exact_dedup(docs, **options).filter("kept").select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.isnull("doc_id").alias("none"), F.unhex("text_sha256").alias("sha"))
    text = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(F.coalesce(doc_id, F.lit(0)).alias("id"), F.isnull(doc_id).alias("none"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), F.struct(*columns(docs)).alias("row"))
    # the join leaves equal keys side by side, so repeats go without another shuffle
    return rows.join(found, key, "left_semi").dropDuplicates(key).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
