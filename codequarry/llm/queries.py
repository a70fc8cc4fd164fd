"""The numbered queries of this subpackage: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .bpe import encode_documents
from .decontaminate import contaminated
from .html import extract_pages
from .imatch import fingerprints
from .langid import fit_languages, identify
from .licenses import fit_licenses, scan_licenses
from .lm import score_documents
from .mixing import mix_sources
from .neardup import near_duplicates
from .pii import find_pii
from .toxicity import fit_toxicity, score_toxicity
from .variants import spelling_variants
from .whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int) -> Column:
    """crc32 of the doc_id as text, mod n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), num=85, den=100, words=5).drop("text_md5")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return scan_licenses(docs, fit_licenses(docs.where("text is not null")))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op4_imatch_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_documents(docs, remainder(5) != 1).withColumn("held_out", remainder(5) == 1)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(remainder(3) != 1).select("doc_id", "toxic")
    model = fit_toxicity(docs.select("doc_id", "text").join(labels, "doc_id"))
    return score_toxicity(docs, model).select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(remainder(5) != 0))
    return identify(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    numbered = (op1_minhash_neardup, op2_license_scan, op3_source_mixing, op4_imatch_fingerprint, op5_lm_scoring, op6_html_extraction, op7_decontamination, op8_toxicity, op9_pii, op10_language_id)
    return {f.__name__: f for f in (*numbered, op11_embedding_whitening, op12_bpe, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_neardup": sql.OP1}
