"""The corpus pipeline: from raw documents to packed token sequences.

Five stages, each on all that the one before it kept: documents whose language is not told go, then exact
copies (the largest doc_id stays), then near copies (all texts of a Jaccard similarity of 0.8 or more over shingles of five words, by SimHash and covering masks,
then by an exact pass over what is not linked yet; the smallest doc_id of each group stays), then secrets are replaced in the texts, and what is left is packed into sequences. All stages but the last return the columns of
`documents`. Null and empty texts have no language, so they go in the first stage; extra columns are kept
up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dramatis.llm import exact_dedup, langid, packing, secrets, simhash
from dramatis.llm.bpe import vocabulary
from dramatis.llm.common import Scratch, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, langid.trained(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.kept_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.kept_documents(docs)


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs, secrets.trained(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary())


STAGES = [("language", language), ("exact", exact), ("near", near), ("secrets", secret), ("packing", packed)]
#: A trained network decides the first stage, which SQL cannot express; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage is written to shared storage and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
