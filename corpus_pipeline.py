"""Cleans the documents and packs them for training: language ID, exact and near deduplication, removal of repeated passages, packing.

Each stage takes all rows that the one before it kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augsearch.llm import common, exact_dedup, langid, ngram_join, packing, suffix_dedup

def _stage(f):
    """A stage deletes those of its own tables that its result doesn't read. The others stay for as long as the result may be read: run() deletes
    them once it has written the result; who calls stages alone has to clear spark.checkpoint.dir."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with common.tables() as own:
            out = f(spark, docs, sf_dir)
            own[:] = common.discard(own, out)
        return out

    return run_stage


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told go: those without a letter (null and empty texts too), and those for whose likeliest
    language the calibrated score is less than half above chance (at most 0.5, so that of two or three languages one has to be less likely
    than not). Where there is no lang to learn from, all with a letter stay.

    Rows with a null doc_id or lang and repeated rows are judged by their text as others are; texts of any length are read whole; an
    empty table gives no rows; extra columns, whatever their names, are returned as they are."""
    model = langid.fit(docs.select("doc_id", "text", "lang"), ~langid.held_out())
    if not model.labels:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return langid.confident(docs, model, min(0.5, 1.5 / len(model.labels)))


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space the one of least doc_id stays.

    A null text counts as empty; a row with a null doc_id stays only where no other has its text; of repeated rows (same doc_id
    and text) one stays; an empty table gives no rows; extra columns, whatever their names, are returned as they are."""
    return exact_dedup.deduplicated(docs)


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least doc_id stays.

    Null, empty and wordless texts and rows with a null doc_id have no near duplicate and stay; repeated rows of a doc_id stay or go
    together; an empty table gives no rows; extra columns, whatever their names, are returned as they are."""
    found = ngram_join.jaccard_join(docs)
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(common.columns(docs))


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of smaller doc_id has are cut out, n_chars follows; documents of nothing else go.

    So do null and empty texts. Rows with a null doc_id stay whole; rows of one doc_id never cut each other; an empty table gives
    no rows; extra columns, whatever their names, are returned as they are."""
    left = suffix_dedup.without_repeats(docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.filter("text <> ''").select(common.columns(docs))


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places, as op5_best_fit_packing returns them; a null text counts as empty, repeated rows are packed each,
    extra columns are ignored and an empty table gives no rows."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), encode_special_tokens=False)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", packed),
]

#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with common.tables() as own:
        for i, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if i < len(STAGES) - 1:
                docs = common.written(docs, name.replace(" ", "-"))
                own[:] = common.discard(own, docs)
    return docs
