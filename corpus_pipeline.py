"""A training-data pipeline over ``documents``: five stages, each one operator of ``codequarry.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's
``docs``.  All but the last return the columns of ``documents``, with any further ones, whatever their names.

In all stages null texts are empty, an empty table gives an empty result, rows with a null doc_id and rows that repeat
one are judged by their own texts, rows that repeat doc_id and text fare alike (stage 2 keeps one), and of documents that
tie as least of a group there is only one, as the group's least doc_id decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.decontaminate import without_contaminated
from codequarry.llm.mixing import mix_sources
from codequarry.llm.neardup import without_duplicates
from codequarry.llm.pii import sanitised
from codequarry.llm.toxicity import fit_toxicity, without_toxic
from codequarry.llm.workspace import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go.  Learns from the labels of documents whose crc32(doc_id) mod 3 is not 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).select("doc_id", "toxic")
    return without_toxic(docs, fit_toxicity(docs.select("doc_id", "text").join(labels, "doc_id")), 0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the least doc_id stays; repeated rows once."""
    return without_duplicates(docs, num=80, den=100, words=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of ``benchmark`` within the edit budget go."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that give it away, are replaced by their kind."""
    return sanitised(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each remaining document the mix takes."""
    return mix_sources(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("pii", sanitise), ("mixing", mix)]

#: SQL cannot express the trained stages; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: ``doc_id, size, source_size, target, taken`` of what the mix may take from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
