"""Document files as a stream: every micro-batch is one ingestion plan on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from quotaflow.operators import known
from quotaflow.operators.documents import identify, ingest
from quotaflow.sinks.tables import append_batch

METADATA_COLUMNS = ["doc_id", "file_name", "file_path", "doc_type", "account_id", "opportunity_id", "file_hash"]


ID_PARTS = 64  # partitions of a batch of metadata, by id


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not exist yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], f"{schema}, batch_id int")


def _id_part(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(ID_PARTS)).cast("int")


def known_documents(spark: SparkSession, root: str, ids: DataFrame, batch_id: int) -> DataFrame:
    """``doc_id`` of the ``ids`` that other batches brought; a batch that runs again must not see its own first attempt.

    The stored filters rule out most new ids; metadata is read only in the partitions of the others, and not at all when
    there are none.
    """
    filters = _table(spark, f"{root}/known_documents", known.FILTER).filter(F.col("batch_id") != batch_id)
    maybe = known.maybe_known(ids, "doc_id", filters).withColumn("id_part", _id_part("doc_id")).persist()
    parts = sorted(r["id_part"] for r in maybe.select("id_part").distinct().collect())  # ID_PARTS at most
    metadata = _table(spark, f"{root}/metadata", "doc_id string, id_part int") if parts else spark.createDataFrame([], "doc_id string, id_part int, batch_id int")
    others = metadata.filter((F.col("batch_id") != batch_id) & F.col("id_part").isin(parts)).select("doc_id")
    return others.join(maybe.select("doc_id"), "doc_id", "left_semi")


def ingest_batch(root: str, files: DataFrame, batch_id: int) -> None:
    """Chunks and metadata of the new documents of one batch of (file_path, content) rows."""
    held = files.persist()
    chunks, metadata = ingest(held, known_documents(files.sparkSession, root, identify(held).select("doc_id"), batch_id))
    append_batch(chunks, f"{root}/chunks", batch_id)
    metadata = metadata.select(*METADATA_COLUMNS).withColumn("id_part", _id_part("doc_id"))
    append_batch(metadata, f"{root}/metadata", batch_id, by=("id_part",))
    # after the metadata: a filter may name ids without metadata, but no metadata may be missing in the filter
    append_batch(known.filter_of(files.sparkSession.read.schema("doc_id string").parquet(f"{root}/metadata/batch_id={batch_id}"), "doc_id"), f"{root}/known_documents", batch_id)
    held.unpersist()


def ingest_stream(files: DataFrame, root: str) -> StreamingQuery:
    """Process all waiting files, then stop."""
    return (
        files.writeStream.option("checkpointLocation", f"{root}/_checkpoints/documents")
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, batch_id: ingest_batch(root, batch, batch_id))
        .start()
    )
