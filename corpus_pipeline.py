"""The corpus pipeline: toxic documents go, near duplicates fall together, sources are mixed, sequences are packed."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polisframe.llm import toxicity
from polisframe.llm._shared import stored, text_column
from polisframe.llm.mixing import mixed_rows
from polisframe.llm.near_texts import near_texts, text_tag
from polisframe.llm.packing import pack

#: Shares of the tokens that good and poor text get; no document is lost, the scarcer kind is repeated.
QUALITY_TARGETS = [0.85, 0.15]


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def nontoxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labelled ones among ``docs``, doesn't call toxic."""
    return toxicity.clean(docs, toxicity.fit(docs, labels_of(spark, sf_dir)))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates - five-word shingles, Jaccard likeness of 0.8 or more - one row stays, that of the
    smallest id and of its smallest text; rows without id can't stand for a group and stay as they are."""
    rows = docs.where("doc_id is not null")
    groups = stored(near_texts(rows))
    heads = groups.where("doc_id = component_id").select("root", F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).distinct()
    count = heads.groupBy("root").agg(F.count("*").alias("n"))
    # where the smallest id has several texts in one component, the smallest text stays
    tagged = rows.select("*", F.col("doc_id").cast("bigint").alias("_id"), text_tag().alias("_tag"))
    several = heads.join(count.where("n > 1"), "root", "left_semi")
    texts = tagged.select("_id", "_tag", text_column().alias("_text")).join(several, ["_id", "_tag"])
    chosen = texts.groupBy("root", "_id").agg(F.min("_text").alias("_text")).select("_id", text_tag("_text").alias("_tag"))
    kept = heads.join(count.where("n = 1"), "root", "left_semi").select("_id", "_tag").unionByName(chosen)
    one = tagged.join(kept, ["_id", "_tag"], "left_semi").dropDuplicates(["_id", "_tag"])
    return one.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated by the rates that bring good and poor text to their target shares; every rate is one or more."""
    labels = labels_of(spark, sf_dir).select("doc_id", (F.lit(1) - F.col("quality")).alias("domain"))
    return mixed_rows(docs, labels, QUALITY_TARGETS, least=1.0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", nontoxic),
    ("near_dedup", dedup),
    ("mixing", mixed),
    ("packing", packed),
]

#: Fitted models, fingerprints and token ids have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
