"""The training-data pipeline: five stages over ``documents``, each by one operator of ``ciphersift.llm``.

1. quality     documents that the co-trained classifier rejects go
2. toxicity    documents that the recurrent network finds toxic go
3. near_dedup  one document of each SimHash group stays (3-word shingles, 3 differing bits at most)
4. decontaminate  documents that hold a benchmark passage go
5. segment     sampled SentencePiece segmentations of what is left

Every stage reads all that its predecessor kept.  All but the last return the
columns of ``documents``; the last returns rows of samples with their piece ids.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ciphersift.llm import cotrain, decontam, segmentation, simhash, toxicity  # noqa: E402
from ciphersift.llm.common import table, tokenizer_file, written  # noqa: E402

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cotrain.keep_good(docs, table(spark, sf_dir, "labels"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return segmentation.sample_segmentations(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("toxicity", toxic), ("near_dedup", near_dedup),
                                   ("decontaminate", decontaminate), ("segment", segment)]

#: Trained models, hashes and sampling cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
