"""The corpus pipeline: documents from quality to token ids, each stage on all that the one before kept.

Defined cases, for every stage: a null text counts as empty, is scored as such, and goes
with the mixture at the latest, which takes no document without words; repeated rows are documents
of their own until the near duplicates, of which one row stays; columns beside those of
documents are kept, whatever their names, up to the last stage; an empty table stays empty; very long texts
are read whole. Ties go as the operators have them.

A stage's result is written before the next one begins, so the next one deletes the
tables that the one before it has worked with.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import dac, decontam, jaccard, mixing, qda
from gridloom.llm.common import delete, importable, recorded, shared_path, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_worked_with: list[str] = []


def cleaning(stage: Stage) -> Stage:
    """The stage, which deletes the tables of the one before, whose result is written by now. The last stage's files are its result and stay."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        importable(spark)
        for path in _worked_with:
            delete(spark, path)
        _worked_with.clear()
        with recorded() as paths:
            out = stage(spark, docs, sf_dir)
        if stage.__name__ != STAGES[-1][0]:
            _worked_with.extend(paths)
        return out

    return run_stage


@cleaning
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant rejects go."""
    return qda.accepted(docs, table(spark, sf_dir, "labels"))


@cleaning
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the n-gram Jaccard join, one document stays. The thin op9 query has stricter values of its own."""
    return jaccard.one_of_each(docs, jaccard.Join(words=5, percent=80))


@cleaning
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


@cleaning
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weighted fair queue takes them."""
    return mixing.mixed(docs)


@cleaning
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids are written as directly addressable codes and read back."""
    folder = shared_path(spark, "token-ids")
    return dac.read(spark, folder, dac.write(docs, folder, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("token_ids", token_ids)]

#: SQL can't express the fitted classifier, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            delete(spark, before)
        before = docs.written_at
    return STAGES[-1][1](spark, docs, sf_dir)
