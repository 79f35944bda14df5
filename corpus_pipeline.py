"""A corpus pipeline of training-data operators: each stage's table is stored and read by the next.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, contamination, neardup, pii, quality, storage


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_LEFT = threading.local()


def _stage(work: Stage) -> Stage:
    """A stage that first deletes what those before it, whose rows are stored by then, left in the shared folder."""

    @functools.wraps(work)
    def run_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = vars(_LEFT)  # this thread's: scratch paths by stage
        names = [name for name, _ in STAGES]
        for name in names[: names.index(run_one.name)]:
            storage.discard(left.pop(name, []), docs)
        with storage.recorded() as made:
            out = work(spark, docs, sf_dir)
        left.setdefault(run_one.name, []).extend(made)
        return out

    return run_one


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak supervision of rules, and the base rules, accept."""
    return quality.keep_good(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near-duplicates."""
    return neardup.keep_first(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return contamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars is that of the new text."""
    made = pii.pseudonymize(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))
    return made.select(*docs.columns)


@_stage
def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with token counts and the digests of ids and decoded bytes."""
    return bpe.round_trip(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pseudonyms),
    ("byte_bpe", byte_bpe),
]

for _name, _work in STAGES:
    _work.name = _name

#: Pseudonyms and tokens are not expressible in SQL; tests hold the result against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = storage.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
