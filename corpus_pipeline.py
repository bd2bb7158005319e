"""Corpus preparation in stages; each takes (spark, docs, sf_dir) and returns documents, the last one tokens.

Every stage works on all that the one before it kept. Between stages documents are written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewatch.llm import bpe, langid, mixing, rules, simhash
from scenewatch.llm.common import written


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language the network tells; texts without letters, null and empty ones, and undecided ones go.

    Repeated rows stay or go together; no documents give none.
    """
    return langid.recognised(docs, least=0.4)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that base rules and the decision list, learned from labels of documents still there, keep.

    Null and empty texts go; a null id is judged by its text; repeated rows stay or go together; no documents give none.
    """
    return rules.passing(docs, labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 0.8 of all 5-word shingles in common, found by SimHash balls, verified.

    The least doc_id of a group stays, null last, then the least text hash; repeated rows are one document; null texts are empty ones, and
    texts without words one group; no documents give none.
    """
    return simhash.without_near_duplicates(docs, size=5, least=0.8)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weights 3, 1, 2, of 150 % of all words; a document taken twice is there twice.

    Texts without words are never taken; a null source is the last source; repeated rows are taken each; no documents give none.
    """
    return mixing.mix(docs, weights=(3, 1, 2), share=1.5)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, exact): packed token ids, and whether they decode to the text again.

    A null text is an empty one, without tokens; a null id stays null; repeated rows give a row each; no documents give none.
    """
    name = public_tokenizers.path("byte_bpe_50k.json")
    found = bpe.encode(docs.select("doc_id", "lang", "source", "text"), name, exact="exact")
    return found.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "exact")


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("mixture", mixture), ("encoding", encoding)]
#: No SQL: a trained network, a learned list, components and merges are not expressed in it; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
