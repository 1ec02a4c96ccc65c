"""Exact filtered top-k similarity search, many questions at once.

Chunks are scanned where they lie, once for each block of questions; a block has a bounded number of bytes and goes
to every task. No row pair is ever emitted: tasks multiply blocks of vectors and pass on at most k candidates per
question. Scores are cosines rounded to six digits, ties go to the smaller chunk id.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaflow import constants as C
from quotaflow.operators.ranking import top_per_key
from quotaflow.session import run_folder

RESULT = "query_id long, chunk_id string, score double"
QUESTION_BYTES = 128 << 20  # vectors of one block of questions, as the tasks hold them
SCAN_BYTES = 64 << 20  # chunk vectors multiplied at a time
TILE, COLUMNS = 256, 4096  # questions and chunks whose scores are held at a time


def _unit(rows) -> np.ndarray:
    matrix = np.asarray(rows, dtype=np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _best(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = frame.sort_values(["query_id", "score", "chunk_id"], ascending=[True, False, True], kind="stable")
    return ordered.groupby("query_id", sort=False).head(k)


def _fitting(questions: pd.DataFrame, chunks: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Places of the questions with the same filters, and of the chunks that pass these (None: all)."""
    filters = ["doc_type", "account_id"]
    fitting: dict[tuple[str, ...], dict] = {}
    for wanted, part in questions.groupby(filters, dropna=False, sort=False).indices.items():
        asked = tuple(c for c, w in zip(filters, wanted) if not pd.isna(w))
        if asked and asked not in fitting:
            fitting[asked] = chunks.groupby(list(asked), sort=False).indices
        key = tuple(w for w in wanted if not pd.isna(w))
        yield part, fitting[asked].get(key if len(key) > 1 else key[0], np.zeros(0, np.int64)) if asked else None


def _tile(q_unit: np.ndarray, floor: np.ndarray, c_unit: np.ndarray, later: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k chunks for each question of a tile: its row, the chunk's place and the score. ``later``: order of the ids.

    A score below the k-th best of the chunks before it, or below ``floor``, goes at once.
    """
    rows, places, found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for start in range(0, len(c_unit), COLUMNS):
        scores = q_unit @ c_unit[start : start + COLUMNS].T
        if start == 0 and scores.shape[1] > k:
            floor = np.maximum(floor, np.round(np.partition(scores, -k, axis=1)[:, -k], 6))
        row, place = np.nonzero(scores >= floor[:, None] - 1e-6)  # what rounds to the floor stays
        if not len(row):
            continue
        score = np.round(scores[row, place], 6) + 0.0
        kept = score >= floor[row]
        rows, places, found = (np.concatenate(p) for p in ((rows, row[kept]), (places, place[kept] + start), (found, score[kept])))
        order = np.lexsort((later[places], -found, rows))
        rows, places, found = rows[order], places[order], found[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        rows, places, found, rank = (x[rank < k] for x in (rows, places, found, rank))
        full = rank == k - 1
        floor = floor.copy()
        floor[rows[full]] = found[full]
    return rows, places, found


def _match(questions: pd.DataFrame, q_unit: np.ndarray, chunks: pd.DataFrame, c_unit: np.ndarray, k: int) -> pd.DataFrame:
    """Best k chunks of one block for every question, filters applied before the cut.

    Questions with the same filters are multiplied with the chunks that pass them, and with no others. With a ``floor``
    column, scores below the question's floor are left out.
    """
    told = np.isfinite(c_unit).all(axis=1)
    if not told.all():
        chunks, c_unit = chunks[told].reset_index(drop=True), c_unit[told]
    ids = chunks["chunk_id"].to_numpy(object)
    later = np.argsort(np.argsort(ids, kind="stable"), kind="stable")  # places in the order of ids
    floors = questions["floor"].to_numpy() if "floor" in questions else np.full(len(questions), -np.inf)
    asked = questions["query_id"].to_numpy()
    found = []
    for mine, fitting in _fitting(questions.reset_index(drop=True), chunks):
        if len(ids if fitting is None else fitting) == 0:
            continue
        vectors, order = (c_unit, later) if fitting is None else (c_unit[fitting], later[fitting])
        mine = mine[np.isfinite(q_unit[mine]).all(axis=1)]
        for start in range(0, len(mine), TILE):
            part = mine[start : start + TILE]
            rows, places, scores = _tile(q_unit[part], floors[part], vectors, order, k)
            places = places if fitting is None else fitting[places]
            found.append(pd.DataFrame({"query_id": asked[part[rows]], "chunk_id": ids[places], "score": scores}))
    return pd.concat(found) if found else pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})


def _floored(questions: pd.DataFrame, best: pd.DataFrame, k: int) -> pd.DataFrame:
    """The questions with the k-th best score so far as their floor, where they have so many."""
    found = best.groupby("query_id")["score"].agg(["min", "size"])
    reached = questions["query_id"].map(found["min"][found["size"] >= k]).fillna(-np.inf).to_numpy()
    return questions.assign(floor=np.maximum(reached, questions["floor"].to_numpy()) if "floor" in questions else reached)


def _narrow_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "doc_type", "account_id", "embedding").filter("embedding IS NOT NULL")


def _ranked(candidates: DataFrame, k: int) -> DataFrame:
    return top_per_key(candidates, ["query_id"], [F.col("score").desc(), F.col("chunk_id").asc()], k, rank="rank")


def _narrow_questions(questions: DataFrame) -> DataFrame:
    return questions.select(
        F.col("query_id").cast("long").alias("query_id"), "doc_type", "account_id", "embedding"
    ).filter("embedding IS NOT NULL")


def _asked_for(chunks: DataFrame, questions: pd.DataFrame) -> DataFrame:
    """Chunks some question can want: when every question names a document type, the scan gets the list of types."""
    return chunks.filter(F.col("doc_type").isin(questions["doc_type"].unique().tolist())) if questions["doc_type"].notna().all() else chunks


def _broadcast_candidates(chunks: DataFrame, questions: pd.DataFrame, k: int) -> DataFrame:
    spark = chunks.sparkSession
    held = spark.sparkContext.broadcast((questions.drop(columns="embedding"), _unit(questions["embedding"].tolist())))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Chunks of about ``SCAN_BYTES`` together, since what is found in each part is merged."""
        kept, size = [], 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            wide = 8 * max(1, len(batch.column("embedding")[0]))
            for start in range(0, batch.num_rows, max(1, SCAN_BYTES // wide)):
                kept.append(batch.slice(start, max(1, SCAN_BYTES // wide)))
                size += wide * kept[-1].num_rows
                if size >= SCAN_BYTES:
                    yield pa.Table.from_batches(kept)
                    kept, size = [], 0
        if kept:
            yield pa.Table.from_batches(kept)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, q_unit = held.value
        best = None
        for part in parts(batches):
            vectors = part.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            wanted = asked if best is None else _floored(asked, best, k)
            found = _match(wanted, q_unit, part.select(["chunk_id", "doc_type", "account_id"]).to_pandas(), _unit(vectors), k)
            best = found if best is None else _best(pd.concat([best, found]), k)
        if best is not None and len(best):
            yield pa.RecordBatch.from_pydict(
                {
                    "query_id": pa.array(best["query_id"], pa.int64()),
                    "chunk_id": pa.array(best["chunk_id"], pa.string()),
                    "score": pa.array(best["score"], pa.float64()),
                }
            )

    return _narrow_chunks(_asked_for(chunks, questions)).mapInArrow(scan, RESULT)


def _floors(seed: DataFrame, questions: pd.DataFrame, k: int) -> pd.DataFrame:
    """k-th best score per question within the seed, for questions that find k chunks there."""
    best = top_per_key(_broadcast_candidates(seed, questions, k), ["query_id"], [F.col("score").desc(), F.col("chunk_id").asc()], k)
    floors = best.groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n"))
    return floors.filter(F.col("n") == k).select("query_id", "floor").toPandas()  # at most one row per question


def nearest_chunks(
    chunks: DataFrame,
    questions: DataFrame,
    k: int = C.SEARCH_K,
    question_bytes: int = QUESTION_BYTES,
    seed: DataFrame | None = None,
) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best chunks per question.

    chunks: chunk_id, doc_type, account_id, embedding. questions: query_id, doc_type, account_id, embedding;
    a NULL filter means any. Questions are dealt to blocks of about ``question_bytes`` by a hash of their id; each
    block is one scan of the chunks, and only candidates are shuffled.

    ``seed`` may be any part of the chunks, such as one partition of a very large table. It is searched first: no
    final k-th score lies below the k-th score of a part, so tasks drop what is below that floor and the shuffle
    stays small however many tasks there are. The result is the same with any seed.
    """
    asked = _narrow_questions(questions)
    numbers = asked.agg(F.sum(F.size("embedding"))).first()[0] or 0
    blocks = max(1, -(-8 * numbers // question_bytes))
    spark, root = chunks.sparkSession, run_folder(chunks.sparkSession, "search")
    empty = _ranked(spark.createDataFrame([], RESULT), k)
    if blocks > 1:  # chunks are made once, and read again for each block
        _narrow_chunks(chunks).write.parquet(f"{root}/chunks")
        chunks = spark.read.parquet(f"{root}/chunks")
    stored = []
    for block in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toPandas()  # about question_bytes
        if seed is not None and len(part):
            part = part.merge(_floors(seed, part, k), on="query_id", how="left").fillna({"floor": -np.inf})
        if not len(part):
            continue
        found = _ranked(_broadcast_candidates(chunks, part, k), k)
        if blocks == 1:
            return found
        # the result of a block is written before the next block is read, so that one block is held at a time
        found.write.parquet(f"{root}/{block}")
        stored.append(f"{root}/{block}")
        del part, found
        gc.collect()  # lets go of the block's broadcast
    return spark.read.schema(empty.schema).parquet(*stored) if stored else empty


def keep_account(results: DataFrame, name: str = "account_name", wanted: str = "wanted_account") -> DataFrame:
    """Account-name test after the top-k cut (substring, any case), so fewer than k rows may remain."""
    matches = F.lower(F.coalesce(F.col(name), F.lit(""))).contains(F.lower(F.col(wanted)))
    return results.filter(F.col(wanted).isNull() | (F.col(wanted) == "") | matches)


def context_text(results: DataFrame, query: str = "query_id", order: str = "rank") -> DataFrame:
    """One text per question: numbered chunks in rank order. At most k chunks per question are gathered."""
    parts = F.sort_array(
        F.collect_list(
            F.struct(
                order,
                F.coalesce(F.col("doc_type"), F.lit("None")).alias("doc_type"),
                F.coalesce(F.col("account_name"), F.lit("None")).alias("account_name"),
                F.coalesce(F.col("source_page").cast("string"), F.lit("None")).alias("page"),
                F.coalesce(F.col("content"), F.lit("None")).alias("content"),
                "chunk_id",
            )
        )
    )
    lines = F.transform(
        F.col("_parts"),
        lambda p, i: F.concat(
            F.lit("["), (i + 1).cast("string"), F.lit("] "), p["doc_type"], F.lit(" | "), p["account_name"],
            F.lit(" | page "), p["page"], F.lit("\n"), p["content"],
        ),
    )
    return (
        results.groupBy(query)
        .agg(parts.alias("_parts"))
        .select(
            query,
            F.array_join(lines, C.CHUNK_SEPARATOR).alias("context_text"),
            F.transform("_parts", lambda p: p["chunk_id"]).alias("chunk_ids"),
        )
    )
