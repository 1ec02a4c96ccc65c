"""A training-corpus pipeline: each stage is one corpus operator applied to all that the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaflow.llm import decontam, exact_dedup, langid, near, pieces
from quotaflow.llm.common import free_name, numbered, stored, table, with_maybe, with_row

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

BATCH_ROWS = 2000  # of whole texts that go to a Python worker at a time
ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _in_small_batches(stage: Stage) -> Stage:
    """The stage with at most ``BATCH_ROWS`` rows in an Arrow batch; a smaller limit of the session stays.

    A batch lies in memory several times, in the executor as well as in the worker. The session keeps the limit, since
    what a stage returns runs later.
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
        if not 0 < int(spark.conf.get(ROWS_SETTING)) <= BATCH_ROWS:  # 0 or less: no limit
            spark.conf.set(ROWS_SETTING, str(BATCH_ROWS))
        return stage(spark, docs, folder)

    return run


def _without(docs: DataFrame, dropped: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The rows of ``docs`` but those whose row number ``dropped`` returns, with the columns of ``docs``.

    The numbers are written with the rows once; the decision and the selection read that one table. Only rows that a bit
    map of the dropped ones does not clear are joined with them, so most texts stay where they are.
    """
    rows, row = numbered(docs)
    gone = stored(dropped(rows, row).select(F.col("row").alias(row)).distinct(), "dropped")
    maybe = free_name(rows, "maybe")
    marked = with_maybe(rows, row, gone, maybe)
    return marked.where(~F.col(maybe)).unionByName(marked.where(maybe).join(gone, row, "left_anti")).select(*docs.columns)


@_in_small_batches
def known_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without a letter go, and texts hardly any n-gram of which belongs to the language they look most like."""
    return langid.accepted(docs, langid.train(docs))


@_in_small_batches
def drop_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return _without(docs, lambda rows, row: exact_dedup.exact_groups(rows, row_col=row).where("NOT kept"))


@_in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of two documents that share 0.8 of their five-word shingles, the one with the smaller id stays, or the first row."""
    return _without(docs, lambda rows, row: near.near_copies(with_row(rows, "doc_id", "text", row_col=row)))


@_in_small_batches
def drop_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a whole window of a benchmark item go."""
    benchmark = table(spark, folder, "benchmark")
    return _without(docs, lambda rows, row: decontam.hits(rows, benchmark, row_col=row).where("n_hit > 0"))


@_in_small_batches
def segment(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Piece ids of the kept documents."""
    return pieces.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("sentencepiece", segment),
]

ORACLE_SQL = None  # the stages' models and hashes have no SQL form; tests compare with brute force


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, folder), f"stage-{name}")
    return docs
