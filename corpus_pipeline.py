"""The corpus pipeline: quality rules, exact dedup, SimHash near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir), docs with the columns of documents, and returns them changed; the last returns the
packed pieces. Rejected documents go, of equal texts the one with the largest doc_id stays, of each group of near copies
the one with the smallest; spans of personal data are replaced by their kind. An empty table passes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dolomite.llm import exact_dedup, packing, pii, quality, simhash
from dolomite.llm.common import documents, written
from dolomite.llm.queries import tokenizer_file

#: No SQL: suffix arrays, fingerprints and the tokenizer cannot be expressed in it.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.passing(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.distinct_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each_group(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), end_id=0, capacity=2048)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_duplicates), ("simhash_near_dedup", near_duplicates), ("pii", personal_data), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
