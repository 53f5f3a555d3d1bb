"""Ranked lexical search by the Best Position Algorithm.

1. Documents are tokenised once; what they have of the queries' terms (document, length, terms with their counts) is
   written to the shared folder, one compact row for each document with a term at all.
2. Numbers of documents, of terms and of documents with each of the queries' terms are sums over that table.
3. Each task takes its documents in shards of at most `SHARD` postings. A shard holds an impact list for each term: postings by falling impact. For a query its
   lists are read in parallel. Each document met is looked up in all of the query's lists (direct access), which gives its whole
   score and marks its position in every list. The best position of a list is the end of its contiguous seen
   positions; what a document not met yet can still score is the sum of the impacts that follow the best positions. Reading
   ends once that is strictly below the k-th score, so equal scores with a smaller doc_id are never missed. The k-th score is
   carried from shard to shard of a task.
4. A task gives at most k documents a query, of which the k highest stay.

Queries are a stated set. They are taken in blocks of at most `BLOCK_TERMS` terms, each broadcast and run against all documents.

Defined results: a null text has no terms, and a document without terms is not counted; a query that is null or has no terms has no rows; rows that share an
item_id are one query with the terms of all of them; rows that share a doc_id are documents of their own; a null doc_id or item_id is
returned as null and sorts first among equal scores; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from augsearch.llm.common import documents, slices, written

#: Terms and queries of a block at most (a longer query has a block of its own), postings of a shard at most, and of a task about.
BLOCK_TERMS, BLOCK_QUERIES, SHARD, TASK = 1 << 17, 2048, 4 << 20, 1 << 20
#: Letters and digits stay, A-Z in lower case, and so do all bytes of other code points; the rest parts terms.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i > 127 else 32 for i in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _query_blocks(queries: DataFrame) -> Iterator[tuple[list[int | None], list[list[bytes]]]]:
    """(ids, distinct terms of each) in blocks of bounded size."""
    ids, lists, size = [], [], 0
    for item_id, texts in queries.groupBy("item_id").agg(F.sort_array(F.collect_set("text"))).toLocalIterator():
        if not (has := sorted({t for text in texts for t in terms(text)})):
            continue
        if ids and (size + len(has) > BLOCK_TERMS or len(ids) == BLOCK_QUERIES):
            yield ids, lists
            ids, lists, size = [], [], 0
        ids.append(item_id)
        lists.append(has)
        size += len(has)
    if ids:
        yield ids, lists


def _hits(numbers: Broadcast):
    """Of documents with a term: their length, and the numbers and counts of those terms that have a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbers.value
        for whole in batches:
            for batch in slices(whole, "text"):
                docs, sizes, term, count, ends = [], [], [], [], [0]
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if text and (words := terms(text)):
                        hit = [(number[t], n) for t, n in Counter(words).items() if t in number]
                        docs.append(doc_id)
                        sizes.append(len(words))
                        term.extend(t for t, _ in hit)
                        count.extend(n for _, n in hit)
                        ends.append(len(term))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(term, pa.int32())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(count, pa.int32()))],
                    names=["doc_id", "n", "term", "tf"],
                )

    return run


class Lists:
    """The impact lists of a shard: positions of term t are start[t]:start[t + 1], by falling impact."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int):
        """Postings by document; doc holds numbers from 0."""
        order = np.lexsort((doc, -impact, term))
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.doc, self.impact = doc[order], impact[order]
        # direct access: the postings of a document, each with its position in the lists
        self.of = np.searchsorted(doc, np.arange(n_docs + 1))
        self.term, self.gain, self.at = term, impact, np.empty(len(term), np.int64)
        self.at[order] = np.arange(len(term))
        self.seen, self.met = np.zeros(len(term) + 1, bool), np.zeros(n_docs, bool)

    def ranked(self, query: np.ndarray, k: int, known: np.ndarray, step: int = 32) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores that may be among the k highest, and how many documents were met. known: scores of other documents, the k highest by falling score."""
        query = query[self.start[query + 1] > self.start[query]]
        end, wanted = self.start[query + 1], np.zeros(len(self.start) - 1, bool)
        best, depth, wanted[query] = self.start[query].copy(), self.start[query].copy(), True
        docs, scores, touched, top = [], [], [], known
        while True:
            may = int(np.where(best < end, self.impact[np.minimum(best, len(self.impact) - 1)], 0).sum()) if len(query) else 0
            if may == 0 or (len(top) >= k and may < top[k - 1]):
                break
            to = np.minimum(depth + step, end)
            new = self.doc[_ranges(depth, to)]  # sorted access to every list
            new = np.unique(new[~self.met[new]])
            depth, step = to, min(2 * step, 1 << 16)
            if len(new):
                self.met[new] = True
                lengths = self.of[new + 1] - self.of[new]
                postings, owner = _ranges(self.of[new], self.of[new + 1]), np.repeat(np.arange(len(new)), lengths)
                hit = wanted[self.term[postings]]
                postings, owner = postings[hit], owner[hit]
                positions = self.at[postings]
                self.seen[positions] = True
                touched.append(positions)
                score = np.add.reduceat(self.gain[postings], np.flatnonzero(np.diff(owner, prepend=-1)))  # all of new have a posting
                if len(top) >= k:  # equal scores may have a smaller doc_id
                    new, score = new[score >= top[k - 1]], score[score >= top[k - 1]]
                docs.append(new)
                scores.append(score)
                top = np.sort(np.concatenate([top, score]))[::-1][:k]
            for i, (b, e) in enumerate(zip(best.tolist(), end.tolist())):
                if b < e and self.seen[b]:
                    unseen = int(np.argmin(self.seen[b:e]))
                    best[i] = b + unseen if not self.seen[b + unseen] else e
        met = int(self.met.sum()) if touched else 0
        for positions in touched:
            self.met[self.doc[positions]] = False
            self.seen[positions] = False
        return np.concatenate([*docs, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*scores, np.zeros(0, np.int64)]).astype(np.int64), met


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """start[0] .. end[0] - 1, start[1] .. end[1] - 1 and so on."""
    size = end - start
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def impacts(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 50 + (50 * n * n_docs) // n_terms
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def _searched(shared: Broadcast, k: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight, n_docs, n_terms = shared.value
        kept: list[tuple[np.ndarray, list]] = [(np.zeros(0, np.int64), []) for _ in queries]  # scores by falling score, and their documents

        def search(parts: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(parts).combine_chunks()
            ids = table["doc_id"].to_pylist()
            term, tf = table["term"].chunk(0), table["tf"].chunk(0)
            sizes = np.diff(term.offsets.to_numpy())
            flat, tf = (x.flatten().to_numpy().astype(np.int64) for x in (term, tf))
            doc = np.repeat(np.arange(len(ids)), sizes)
            lists = Lists(flat, doc, impacts(tf, table["n"].to_numpy()[doc], weight[flat], n_docs, n_terms), len(weight), len(ids))
            for q, query in enumerate(queries):
                scores, docs = kept[q]
                found, gain, _ = lists.ranked(query, k, scores)
                if len(found):
                    rows = sorted(zip((-np.concatenate([scores, gain])).tolist(), docs + [ids[d] for d in found]), key=lambda r: (r[0], r[1] is not None, r[1] or 0))[:k]
                    kept[q] = -np.array([s for s, _ in rows], np.int64), [d for _, d in rows]

        parts, size = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                parts.append(batch.slice(i, 512))
                size += len(parts[-1].column(2).flatten())
                if size >= shard:
                    search(parts)
                    parts, size = [], 0
        if parts:
            search(parts)
        for q, (scores, docs) in enumerate(kept):
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(scores)], names=["query", "doc_id", "score"])

    return run


def search(docs: DataFrame, queries: DataFrame, k: int = 50, shard: int = SHARD) -> DataFrame:
    """docs: doc_id, text. queries: item_id, text. One row for each of an item's k highest documents: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    queries = queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    out = []
    for ids, lists in _query_blocks(queries):
        names = sorted({t for has in lists for t in has})
        number = {t: i for i, t in enumerate(names)}
        hits = written(docs.mapInArrow(_hits(spark.sparkContext.broadcast(number)), "doc_id long, n long, term array<int>, tf array<int>"), "hits")
        n_docs, n_terms = hits.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(names), np.int64)
        for t, n in hits.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # a row for each term of the block at most
            df[t] = n
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        block = [np.array([number[t] for t in has], np.int64) for has in lists], weight, n_docs, n_terms
        # a task gives up to k rows a query, so there are no more tasks than cores unless the postings are many
        tasks = max(spark.sparkContext.defaultParallelism, -(-int(df.sum()) // TASK))
        found = hits.filter(F.size("term") > 0).repartition(tasks).mapInArrow(_searched(spark.sparkContext.broadcast(block), k, shard), "query int, doc_id long, score long")
        id_of = spark.createDataFrame(list(enumerate(ids)), "query int, item_id long")  # BLOCK_QUERIES rows at most
        out.append(found.join(F.broadcast(id_of), "query").select("item_id", "doc_id", "score"))
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
SQL = f"""
WITH d AS (SELECT doc_id, text, row_number() OVER () AS r FROM documents),
counts AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, {_TERMS} AS term FROM d) GROUP BY ALL),
lengths AS (SELECT r, sum(tf)::BIGINT AS n FROM counts GROUP BY r),
sums AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lengths),
queries AS (SELECT DISTINCT item_id, {_TERMS} AS term FROM benchmark),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM counts, sums WHERE term IN (SELECT term FROM queries) GROUP BY term),
scored AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * docs) // terms)))))::BIGINT AS score
  FROM queries JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (r), sums GROUP BY item_id, r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
