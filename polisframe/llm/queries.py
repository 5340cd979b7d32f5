"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polisframe.llm import toxicity
from polisframe.llm.balanced_shards import shard_texts
from polisframe.llm.chat_repair import repair_chats
from polisframe.llm.license_scan import scan
from polisframe.llm.lexical_search import search
from polisframe.llm.license_sql import SCAN_SQL
from polisframe.llm.mixing import mix
from polisframe.llm.near_vectors import near_vectors
from polisframe.llm.order_minhash import chained
from polisframe.llm.packing import pack
from polisframe.llm.phrases import phrases
from polisframe.llm.phrases_sql import PHRASES_SQL
from polisframe.llm.pitman_yor import score_texts
from polisframe.llm.search_sql import SEARCH_SQL
from polisframe.llm.simhash_tree import near_duplicates
from polisframe.llm.token_count import count_tokens

#: Domains of the mixture: good, poor and toxic text, with their shares of the tokens.
TARGETS = [0.8, 0.15, 0.05]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {"op4_license_scan": SCAN_SQL, "op12_lexical_search": SEARCH_SQL, "op13_phrases": PHRASES_SQL}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op2_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_chats(table(spark, sf_dir, "conversations"))


@query
def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chained(table(spark, sf_dir, "documents"))


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.drop("text")


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = near_duplicates(table(spark, sf_dir, "documents"))
    return marked.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), words=True)


def domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): 0 good, 1 poor, 2 toxic."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0).alias("domain"))


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    mixed = mix(docs, domains(table(spark, sf_dir, "labels")), TARGETS)
    p = F.col("posterior")
    return mixed.select("doc_id", "n_tokens", p[0].alias("p_good"), p[1].alias("p_poor"), p[2].alias("p_toxic"), "rate", "copies")


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op11_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_texts(table(spark, sf_dir, "documents"))


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"))
