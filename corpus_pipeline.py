"""A training corpus from the raw documents, in five stages.

Each stage takes the rows its predecessor kept and returns those it keeps; the last encodes
them. ``run`` writes every stage's rows as Parquet to the shared folder and rereads them.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textmill.llm import byte_bpe, decontaminate, near_dedup, quality, repeats
from textmill.llm.common import drop, materialise, scratch, table
from textmill.llm.queries import RANKS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", tokens),
]

#: Near duplicates and repeated strings are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before = docs
        with scratch(spark) as keep:  # what the stage wrote on its way goes
            docs = keep(materialise(stage(spark, before, sf_dir)))
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
