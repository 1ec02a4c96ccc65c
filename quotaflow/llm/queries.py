"""The registered corpus queries: each applies one operator to its whole table; ``SQL`` has their twins for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaflow.llm import chat, decontam, exact_dedup, langid, licenses, merkle, ngram_lm, pieces, pii, repair, sharding, simhash, toxicity, twins
from quotaflow.llm.common import table


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, folder, "documents")))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return langid.predict(docs, langid.train(docs))


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shards(table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents")).drop("row")


def op8_ngram_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return ngram_lm.score(docs, ngram_lm.train(docs))


def op9_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode(table(spark, folder, "documents"))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_groups(table(spark, folder, "documents")).drop("row")


def op11_structure_repair(spark: SparkSession, folder: str) -> DataFrame:
    damaged = repair.damaged(table(spark, folder, "conversations"))
    return repair.repaired(repair.faults(damaged, copies=F.col("copies")))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(table(spark, folder, "documents")).drop("tampered")


def op13_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    said = f"concat('{chat.END.strip()}{chat.START}{chat.TRAINED} ', 'ok')"
    probe = spark.range(2).selectExpr("-1L AS conv_id", "id AS turn", f"if(id = 0, 'user', '{chat.TRAINED}') AS role", f"{said} AS text")
    probe = chat.chains(probe).withColumn("tree", F.lit("probe"))  # beside a conversation that has this id
    return chat.digest(chat.formatted(chat.chains(table(spark, folder, "conversations")).unionByName(probe)))


QUERIES = {f.__name__: f for f in (op1_pii, op2_language_id, op3_license_scan, op4_decontamination, op5_sharding, op6_toxicity, op7_exact_dedup, op8_ngram_lm, op9_sentencepiece, op10_simhash, op11_structure_repair, op12_merkle_manifest, op13_chat_format)}

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op4_decontamination": f"""
        WITH d AS (
          SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWER}, '{WORD}') AS words FROM documents
        ), b AS (
          SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({LOWER}, '{WORD}') AS words FROM benchmark
        ), item AS (
          SELECT item_id, words, unnest(range(1, greatest(len(words) - 10, 0) + 2)) AS start FROM b WHERE len(words) > 0
        ), win AS (
          SELECT DISTINCT item_id, array_to_string(words[start:start + 9], ' ') AS win, least(len(words), 10) AS n FROM item
        ), sizes AS (
          SELECT DISTINCT n FROM win
        ), place AS (
          SELECT row, words, n, unnest(range(1, len(words) - n + 2)) AS start FROM d, sizes WHERE len(words) >= n
        ), hit AS (
          SELECT p.row, p.start, p.n, w.item_id
          FROM (SELECT row, n, start, array_to_string(words[start:start + n - 1], ' ') AS win FROM place) p JOIN win w USING (win, n)
        ), hit_words AS (
          SELECT row, count(DISTINCT word_no) AS n_hit FROM (SELECT row, unnest(range(start, start + n)) AS word_no FROM hit) GROUP BY row
        ), hit_items AS (
          SELECT row, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hit GROUP BY row
        )
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit_words USING (row) LEFT JOIN hit_items USING (row)
    """,
    "op7_exact_dedup": r"""
        WITH plain AS (
          SELECT doc_id, coalesce(text, '') AS body, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
          FROM documents
        )
        SELECT doc_id,
               first_value(doc_id) OVER best AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER best = 1 AS kept,
               sha256(norm) AS text_sha256
        FROM plain
        WINDOW best AS (PARTITION BY norm ORDER BY length(body) DESC, doc_id NULLS LAST)
    """,
    "op11_structure_repair": twins.REPAIR,
    "op12_merkle_manifest": twins.merkle(),
    "op13_chat_format": twins.CHAT,
}
