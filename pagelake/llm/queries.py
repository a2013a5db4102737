"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, decontaminate, divergence, embed_dedup, html_extract, jaccard, langid, licenses, line_dedup, mixing, secrets, substring_dedup, token_store
from .util import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that a document of a smaller id has too."""
    return substring_dedup.dedup(table(spark, sf_dir, "documents")).drop("spans")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the component of near-duplicates that they belong to."""
    return jaccard.join_components(table(spark, sf_dir, "documents"))


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the token files of all documents hold, read back."""
    return token_store.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of sources takes."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold questions and answers of the benchmark."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, by kind and place."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sites share."""
    df = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return df.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by the component of near-duplicates that they belong to."""
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn_profiles(docs.where(~langid.held_out()))
    return langid.identify(docs, profiles).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two tokenizers cut every document, and how often their tokens end together."""
    return align.align(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language lie apart in their terms, and what each uses most."""
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_jaccard_join, op3_token_ids, op4_mixing, op5_decontamination, op6_secret_scan, op7_line_dedup, op8_embedding_near_dedup, op9_language_id, op10_html_extraction, op11_license_scan, op12_token_alignment, op13_source_divergence)}
ORACLE_SQL = {"op4_mixing": mixing.mix_sql(), "op6_secret_scan": secrets.scan_sql(), "op7_line_dedup": line_dedup.dedup_sql(), "op11_license_scan": licenses.scan_sql(), "op13_source_divergence": divergence.audit_sql()}
