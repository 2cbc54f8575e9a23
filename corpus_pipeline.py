"""The corpus pipeline: five stages over ``documents``, each written and read again as the next one's input.

    python corpus_pipeline.py SF_DIR      # prints the rows of every stage

A stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltatree.llm import arrays, decontaminate, jaccard, packing, quality_rules, substrings
from deltatree.session import cut_lineage

#: Near-duplicates: shingles of five words, a similarity of 0.8.
SHINGLE, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; learned from the labelled rows of the documents at hand."""
    return quality_rules.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest ``doc_id``.

    Of several rows with that ``doc_id`` one stays for each group; rows without an id, whose groups have no id either, all stay.
    """
    return jaccard.keep_one(docs, SHINGLE, PERCENT, arrays.SPACED)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; every document stays."""
    return substrings.remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontamination), ("best_fit_packing", pack),
]

#: A trained classifier, content-defined chunks and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one. What lies between is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def main(sf_dir: str) -> None:
    from deltatree.session import build_session

    spark = build_session("corpus pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    print("documents", docs.count())
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
        print(name, docs.count())
    print("sequences", docs.select(F.countDistinct("sequence_id")).first()[0])


if __name__ == "__main__":
    main(sys.argv[1])
