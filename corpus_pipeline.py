"""A corpus pipeline: toxicity, near-dedup, pseudonyms, mixing, packing.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and
reread as the next one's docs. All but the last return the columns of documents.
No rows give no rows; nulls, repeats and further columns are as the operators say."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenbag.llm import mixing, packing, pii, simhash, toxicity
from evenbag.llm.common import shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the network, trained on the labels of sf_dir, rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(*toxicity.sample(docs, labels))
    scored = toxicity.score_documents(docs, model, score_col="toxicity_score")
    return scored.filter(F.col(scored.columns[-1]) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each group of near copies, that of the smallest id."""
    return simhash.keep_one(docs)


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with pseudonyms for personal data."""
    return pii.pseudonymize(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each pass over a document, n_chars as its text is now."""
    mixed = mixing.mixed_texts(docs)
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else mixed


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("pii", hide_private), ("mix", mix_sources), ("pack", pack)]

#: A trained network and a tokenizer are not SQL; tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
