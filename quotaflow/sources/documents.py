"""File and JSON document sources with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaflow import constants as C
from quotaflow.plans.jobs import RESPONSE_ITEMS

GOLDEN = (
    "id string, agent string, query string, expected_contains array<string>, expected_sql_keywords array<string>, "
    "expected_not_contains array<string>, should_refuse boolean, min_groundedness double"
)
PROFILE = "profile_id string, experience_summary string, key_skills array<string>, search_queries array<string>, disqualifiers array<string>"
SEARCH_RESPONSE = f"search_query string, query_idx int, response_no long, jobs_results {RESPONSE_ITEMS}"


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions from a JSON array file; absent arrays and flags are NULL."""
    return spark.read.schema(GOLDEN).option("multiLine", True).json(path)


def parse_golden(texts: DataFrame, column: str = "value") -> DataFrame:
    return texts.select(F.from_json(column, GOLDEN).alias("q")).select("q.*")


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Job-search profiles: one JSON document per file."""
    return spark.read.schema(PROFILE).option("multiLine", True).json(path)


def read_search_responses(spark: SparkSession, path: str) -> DataFrame:
    """One search response per JSON line or file."""
    return spark.read.schema(SEARCH_RESPONSE).json(path)


def parse_search_responses(texts: DataFrame, column: str = "value") -> DataFrame:
    return texts.select(F.from_json(column, SEARCH_RESPONSE).alias("r")).select("r.*")


def new_file_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Stream of document files below a folder, existing ones included: path, modificationTime, length, content."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", C.DOCUMENT_GLOB)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .load(folder)
    )


def as_text_files(files: DataFrame) -> DataFrame:
    """(file_path, content) with the bytes read as UTF-8; bytes that are no UTF-8 are left out."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.select(F.col("path").alias("file_path"), F.replace(text, F.lit("\ufffd"), F.lit("")).alias("content"))
