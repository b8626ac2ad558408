"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, dac, decontam, iblt, jaccard, mixing, oracles, qda, resampling, secrets, templates, toxicity, warc
from .common import importable, shared_path, table

Query = Callable[[SparkSession, str], DataFrame]


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    folder = shared_path(spark, "token-ids")
    return dac.read(spark, folder, dac.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return qda.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return jaccard.linked(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op3_token_ids, op5_quality, op6_decontamination, op9_ngram_jaccard, op10_mixing)}



def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return warc.archived(spark, table(spark, sf_dir, "pages"), shared_path(spark, "warc"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    control = r"\### Assistant: </turn> ok"
    rows = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    every = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long"), "role", "text").unionByName(rows)
    return chat.read_back(chat.formatted(chat.log_of(every)))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(table(spark, sf_dir, "documents"))


def op4_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.without_templates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES |= {f.__name__: f for f in (op1_secrets, op2_fingerprints, op4_templates, op7_warc, op8_chat)}


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES |= {f.__name__: f for f in (op11_resampling, op12_collocations, op13_toxicity)}

SQL: dict[str, str] = {
    "op4_templates": oracles.TEMPLATES,
    "op6_decontamination": oracles.DECONTAMINATION,
    "op7_warc": oracles.WARC,
    "op8_chat": oracles.CHAT,
    "op9_ngram_jaccard": oracles.JACCARD,
    "op10_mixing": oracles.MIXING,
    "op11_resampling": oracles.RESAMPLING,
    "op12_collocations": oracles.COLLOCATIONS,
}
