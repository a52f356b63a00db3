"""Corpus preparation: five stages from ``documents`` to packed training sequences.

Each stage takes the documents its predecessor kept, and its decisions take
effect: the first four return rows with the columns of ``documents``, the last
returns the packed pieces. ``run`` writes every stage to the shared folder and
reads it back, so a lost executor costs a task and never an earlier stage.

Nulls, empty and very long texts, repeated rows, empty tables and further
columns are handled as the operators' docstrings say; further columns pass
through the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cxlens.llm.common import documents, written
from cxlens.llm.language_id import keep_identified
from cxlens.llm.packing import Capacity, pack
from cxlens.llm.quality import keep_documents
from cxlens.llm.queries import REPEAT_BYTES, SEQUENCE_TOKENS, tokenizer_path
from cxlens.llm.simhash import near_duplicates
from cxlens.llm.suffix_dedup import remove_repeats

#: A document stays if some language's classifier says yes (0.5 is a score of zero before scaling).
MIN_LANGUAGE_SCORE = 0.5
SIMHASH_SHINGLE, SIMHASH_DISTANCE = 4, 4


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality cascade keeps."""
    return keep_documents(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the string kernels know."""
    return keep_identified(docs, MIN_LANGUAGE_SCORE)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id.

    Rows that share that id stay together; of a group whose ids are all null
    every row stays.
    """
    found = near_duplicates(docs, SIMHASH_SHINGLE, SIMHASH_DISTANCE)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept")).distinct()
    return docs.join(first, docs["doc_id"].eqNullSafe(first["kept"]), "left_semi")


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that a document with a smaller id has."""
    return remove_repeats(docs, REPEAT_BYTES)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and offset."""
    return pack(docs, tokenizer_path(), Capacity(SEQUENCE_TOKENS))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL expresses neither the string kernels nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
