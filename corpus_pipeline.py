"""Five stages over documents: quality, exact copies, near copies, mixing, tokens. Each stage reads what the one before
it wrote, in the shared folder; a table goes when the next stage's is written, the last one stays for the result.

Defined cases, of all stages: a null text counts as empty; rows with null ids are documents like others, but form no
near copies; an empty table goes through empty; columns beyond those of documents, whatever their names, are kept by all
stages, but the last replaces `ids` and `decoded`. What a stage does with ties and repeated rows is said at each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from landsift.llm import bpe, exact_dedup, mixing, near_dedup, quality
from landsift.llm._spark import discard, shared_dir, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. Empty texts are scored like others; repeated rows have one score and so one
    fate; without labels of both kinds all rows have the share of label 1 as score (1 without any label)."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the smallest id, and of rows that repeat it the least by the other columns; null texts
    become empty, null ids lose against others."""
    return exact_dedup.distinct_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate class; rows that repeat it, or have null ids, stay."""
    return near_dedup.distinct_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with tempered source, language and form weights, half of all tokens. Null categories count as '';
    repeated rows share one fate, null ids go by their text."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and the bytes that these decode to; repeated rows are encoded each."""
    return bpe.round_trip(docs, *bpe.tokenizer())


STAGES = [
    ("quality", quality_filter),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("mixing", mix),
    ("tokens", tokens),
]
#: The quality classifier, weighted sampling, raking and the tokenizer are beyond SQL; tests hold each stage's rows
#: against plain recomputations on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            discard(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
