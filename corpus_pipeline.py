"""A training corpus from `documents`, in five stages, each one of the operators of pagelake.llm.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; its result is written as Parquet
and read again as the next stage's docs. All but the last return the columns of docs. Decisions are
taken row by row: rows that share a doc_id, or have none, are told apart by their texts. A stage
leaves only the small table of its decisions behind, which goes with the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagelake.llm import decontaminate, jaccard, langid, mixing, token_store
from pagelake.llm.queries import tokenizer_path
from pagelake.llm.util import kept_alone, scratch, table
from pagelake.sources.ship import ship

#: Below this score a text is like none of the languages. Clean texts of some words score well above it.
LEAST_SCORE = 0.1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the corpus; null and empty texts, those without letters or like no language go.

    Languages are learned from the rows with a lang outside the held-out fold; without any, nothing stays.
    """
    ship(spark)
    profiles = langid.learn_profiles(docs.where(~langid.held_out()))
    return langid.keep_identified(docs, profiles, LEAST_SCORE)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the least doc_id, of each group of linked or equal texts.

    Rows without an id link by their text and stay only where no row of their group has an id; of
    repeated rows one stays. Rows without words are groups of their own.
    """
    ship(spark)
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts have none. Each row goes by its own text."""
    ship(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often, and the last copy as far, as the target weights of their sources ask.

    A null source is one like others; null and empty texts are never taken.
    """
    ship(spark)
    return mixing.apply_mix(docs, kept_alone(spark, lambda: mixing.mix_plan(docs), "mix"))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digest of the token files, read back: doc_id, start, n_tokens, ids_crc32; a null text is an empty one."""
    ship(spark)
    return token_store.round_trip(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: Language profiles, linked groups and token ids are beyond SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch(docs, name)
    return docs
