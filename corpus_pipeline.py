"""From raw documents to packed training sequences: five stages, each an operator of edgetide.llm.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents, whatever they are besides doc_id and text: own columns of the stages have names that
clash with none. Every row has its own verdict, so repeated rows and rows with a null or repeated doc_id are judged like others (of
equal texts one row stays). Nulls, very long texts and empty tables go through every stage as its operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from edgetide.llm import decontamination, neardup, packing, quality, secrets, tokens
from edgetide.llm.common import load, tasks_for, written


def compact(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Made by at most as many tasks as the size of docs asks for: many small partitions aren't handed on as many small files."""
    return rows.coalesce(tasks_for(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return compact(quality.keep(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return compact(neardup.deduplicated(docs), docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, each row by its own verdict, whatever its doc_id."""
    return compact(decontamination.clean(docs, load(spark, sf_dir, "benchmark")), docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, its secrets replaced by a mark."""
    return compact(secrets.redact(docs), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens and 64 documents: a row for each piece of each document."""
    return compact(packing.pack(docs, tokens.default_path(), packing.Capacity(1024, 64, 1024 * 1024)), docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: Trained models, a MinHash forest and tokenizer ids: not SQL. tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs
