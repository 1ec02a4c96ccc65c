"""Document identity, pages, chunks, embeddings, similarity search."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotaflow import constants as C
from quotaflow.operators import documents as D
from quotaflow.operators import retrieval as R
from quotaflow.plans.views import Inputs
from quotaflow.registry.common import Entry, oracle

DOCS = ["source_documents"]
# uuid5 in SQL of the oracle engine: SHA-1 over the namespace bytes and the hash text.
UUID5 = (
    "concat_ws('-', substr(s, 1, 8), substr(s, 9, 4), concat('5', substr(s, 14, 3)), "
    "concat(substr('89ab', (CAST(concat('0x', substr(s, 17, 1)) AS INTEGER) & 3) + 1, 1), substr(s, 18, 3)), substr(s, 21, 12))"
)
IDENTITY = (
    f"identified AS (SELECT *, {UUID5} AS doc_id FROM (SELECT *, sha256(content) AS file_hash, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(sha256(content))) AS s FROM source_documents))"
)
FIRST = "firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY file_path) AS rn FROM identified) WHERE rn = 1)"
TOKENS = (
    "tokens AS (SELECT doc_id, doc_type, account_id, regexp_extract_all(content, '\\s*\\S+') AS t FROM firsts), "
    "windows AS (SELECT *, unnest(range(0, CAST(ceil(len(t) / 462.0) AS BIGINT))) AS w FROM tokens), "
    "chunks AS (SELECT doc_id, doc_type, account_id, 1 AS source_page, CAST(w AS INTEGER) AS chunk_index, trim(array_to_string(t[w * 462 + 1 : w * 462 + 512], ''), chr(10) || chr(9) || chr(13) || ' ') AS content, "
    "CAST(least(512, len(t) - w * 462) AS INTEGER) AS token_count FROM windows)"
)
CHUNK_CTE = f"{IDENTITY}, {FIRST}, {TOKENS}"
CHUNK_ID = "sha256(concat_ws('|', doc_id, CAST(source_page AS VARCHAR), CAST(chunk_index AS VARCHAR)))"
SEARCH_CHUNKS_CTE = (
    "search_chunks AS (SELECT c.*, sha256(concat_ws('|', c.doc_id, CAST(c.source_page AS VARCHAR), CAST(c.chunk_index AS VARCHAR))) AS chunk_id, a.c_name AS account_name, e.embedding, e.label, nullif(regexp_extract(split_part(f.file_path, '/', 7), '(?i)(OPP[-_]\\w+)', 1), '') AS opportunity_id "
    "FROM chunks c JOIN firsts f USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = (f.source_id + c.chunk_index) % (SELECT count(*) FROM embeddings) LEFT JOIN customer a ON CAST(a.c_custkey AS VARCHAR) = c.account_id WHERE c.token_count >= 20)"
)
_TOPK = (
    "scores AS (SELECT q.query_id, q.account_name AS wanted, s.*, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[])), 6) AS score FROM search_requests q JOIN search_chunks s "
    "ON s.doc_type = q.doc_type AND (q.account_id IS NULL OR q.account_id = s.account_id)), "
    "topk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scores) WHERE rank <= 8), "
    "kept AS (SELECT * FROM topk WHERE wanted IS NULL OR contains(lower(coalesce(account_name, '')), lower(wanted)))"
)
SEARCH = f"{CHUNK_CTE}, {SEARCH_CHUNKS_CTE}, {_TOPK}"
_PLAIN = (
    "plain AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g')) AS page_text "
    "FROM (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM pages))"
)


def _identified(i: Inputs):
    return D.identify(i.source_documents.drop("account_id", "doc_type"))


def _known(i: Inputs):
    """Documents ingested earlier: all texts of one language."""
    return D.identify(i.source_documents.filter("lang = 'fr'")).select("doc_id")


def document_chunks(i: Inputs):
    first = D.distinct_documents(_identified(i))
    described = D.path_metadata(first.select("doc_id", "source_id", "file_path", "content"))
    return D.chunk_rows_of(D.page_rows(described.select("doc_id", "source_id", "doc_type", "account_id", "opportunity_id", "content")))


def _lines_as_pages(i: Inputs):
    """Every line of a document as a page of its own."""
    return D.page_rows(i.source_documents.select("source_id", F.replace("content", F.lit("\n"), F.lit("\f")).alias("content")))


def searchable_chunks(i: Inputs):
    """Chunk rows with account name and a vector; vectors are dealt to the chunks in turn, so that each has one."""
    chunks = D.with_chunk_ids(D.long_enough(document_chunks(i)))
    vectors = i.embeddings.select("vec_id", "embedding", "label")
    dealt = F.pmod(F.col("source_id") + F.col("chunk_index"), F.lit(max(1, vectors.count())))
    names = i.customer.select(F.col("c_custkey").cast("string").alias("account_id"), F.col("c_name").alias("account_name"))
    return chunks.withColumn("vec_id", dealt).join(vectors, "vec_id", "left").join(names, "account_id", "left")


def _search(i: Inputs):
    chunks = searchable_chunks(i)
    found = R.nearest_chunks(chunks, i.search_requests)
    shown = ["chunk_id", "doc_id", "doc_type", "account_name", "opportunity_id", "source_page", "content"]
    described = found.join(chunks.select(*shown, F.lit(None).cast("date").alias("doc_date")), "chunk_id")  # no file tells its date
    asked = i.search_requests.select("query_id", F.col("account_name").alias("wanted_account"))
    return R.keep_account(described.join(asked, "query_id"))


def _contexts(i: Inputs):
    """Every request has a context; one that finds nothing gets the default text."""
    told = i.search_requests.select("query_id").join(R.context_text(_search(i)), "query_id", "left")
    return told.select(
        "query_id", F.coalesce("context_text", F.lit(C.NO_DOCUMENTS_TEXT)).alias("context_text"),
        F.coalesce(F.array_join("chunk_ids", ","), F.lit("")).alias("chunk_ids"),
    )


def _text_figures(texts: list[str]) -> list[list[float]]:
    """Stand-in for an embedding model: three counts per text."""
    return [[len(t), t.count(" "), t.count("\n")] for t in texts]


def _embedded(i: Inputs):
    chunks = D.with_chunk_ids(D.long_enough(document_chunks(i))).select("chunk_id", "content")
    v = F.col("embedding")
    return D.embed_texts(chunks, _text_figures).select("chunk_id", *[v[n].cast("double").alias(f"v{n}") for n in range(3)])


def _chunk_rows(i: Inputs):
    return searchable_chunks(i).select(
        "chunk_id", "doc_id", "doc_type", "account_id", "account_name", F.sha2("content", 256).alias("content_hash"), "source_page", "chunk_index", "token_count",
        F.size("embedding").alias("dimensions"), F.col("embedding")[0].cast("double").alias("first_value"),
    )


def _files(i: Inputs):
    """All documents as files; those of one language carry a suffix that is not supported."""
    path = F.when(F.col("lang") == "es", F.replace(F.col("file_path"), F.lit(".txt"), F.lit(".xlsx"))).otherwise(F.col("file_path"))
    return i.source_documents.select(path.alias("file_path"), "content")


ENTRIES: dict[str, Entry] = {
    "doc_id_uuid5": Entry(
        lambda i: _identified(i).select("source_id", "file_hash", "doc_id"), oracle(DOCS, "SELECT source_id, file_hash, doc_id FROM identified", IDENTITY)
    ),
    "doc_dedupe": Entry(
        lambda i: D.distinct_documents(_identified(i).select("doc_id", "file_hash", "file_path")),
        oracle(DOCS, "SELECT doc_id, file_hash, file_path FROM firsts", f"{IDENTITY}, {FIRST}"),
    ),
    "anti_already_ingested": Entry(
        lambda i: D.new_documents(_identified(i).select("doc_id", "file_path"), _known(i)),
        oracle(DOCS, "SELECT doc_id, file_path FROM firsts WHERE doc_id NOT IN (SELECT doc_id FROM identified WHERE lang = 'fr')", f"{IDENTITY}, {FIRST}"),
    ),
    "path_metadata": Entry(
        lambda i: D.path_metadata(i.source_documents.select("source_id", "file_path")),
        oracle(
            DOCS,
            "SELECT source_id, file_path, split_part(file_path, '/', 7) AS file_name, split_part(file_path, '/', 5) AS doc_type, split_part(file_path, '/', 6) AS account_id, "
            "nullif(regexp_extract(split_part(file_path, '/', 7), '(?i)(OPP[-_]\\w+)', 1), '') AS opportunity_id FROM source_documents",
        ),
    ),
    "opportunity_from_name": Entry(
        lambda i: D.path_metadata(i.source_documents.select("source_id", F.concat(F.col("file_path"), F.lit("_opp_9.pdf")).alias("file_path"))).select("source_id", "opportunity_id"),
        oracle(DOCS, "SELECT source_id, regexp_extract(concat(split_part(file_path, '/', 7), '_opp_9.pdf'), '(?i)(OPP[-_]\\w+)', 1) AS opportunity_id FROM source_documents"),
    ),
    "doc_pages": Entry(
        lambda i: D.page_rows(i.pages.select("page_id", D.plain_text(F.col("html")).alias("content"))),
        f"WITH {_PLAIN} SELECT page_id, CAST(1 AS INTEGER) AS page, page_text FROM plain WHERE regexp_matches(page_text, '\\S')",
    ),
    "doc_pages_breaks": Entry(
        _lines_as_pages,
        oracle(DOCS, "SELECT source_id, CAST(i AS INTEGER) AS page, t[i] AS page_text FROM (SELECT source_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT source_id, string_split(content, chr(10)) AS t FROM source_documents)) WHERE regexp_matches(t[i], '\\S')"),
    ),
    "doc_chunk_pages": Entry(
        lambda i: D.chunk_rows_of(_lines_as_pages(i)).select("source_id", "source_page", "chunk_index", F.sha2("content", 256).alias("content_hash"), "token_count"),
        oracle(
            DOCS,
            "SELECT source_id, CAST(i AS INTEGER) AS source_page, CAST(w AS INTEGER) AS chunk_index, sha256(trim(array_to_string(k[w * 462 + 1 : w * 462 + 512], ''), chr(10) || chr(9) || chr(13) || ' ')) AS content_hash, CAST(least(512, len(k) - w * 462) AS INTEGER) AS token_count "
            "FROM (SELECT source_id, i, k, unnest(range(0, CAST(ceil(len(k) / 462.0) AS BIGINT))) AS w FROM (SELECT source_id, i, regexp_extract_all(t[i], '\\s*\\S+') AS k FROM (SELECT source_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT source_id, string_split(content, chr(10)) AS t FROM source_documents))))",
        ),
    ),
    "doc_chunk": Entry(
        lambda i: document_chunks(i).select("doc_id", "source_page", "chunk_index", "content", "token_count"),
        oracle(DOCS, "SELECT doc_id, source_page, chunk_index, content, token_count FROM chunks", CHUNK_CTE),
    ),
    "chunk_min_tokens": Entry(
        lambda i: D.long_enough(document_chunks(i)).select("doc_id", "source_page", "chunk_index", "token_count"),
        oracle(DOCS, "SELECT doc_id, source_page, chunk_index, token_count FROM chunks WHERE token_count >= 20", CHUNK_CTE),
    ),
    "chunk_rows": Entry(
        _chunk_rows,
        oracle(
            DOCS,
            "SELECT chunk_id, doc_id, doc_type, account_id, account_name, sha256(content) AS content_hash, source_page, chunk_index, token_count, CAST(len(embedding) AS INTEGER) AS dimensions, CAST(embedding[1] AS DOUBLE) AS first_value FROM search_chunks",
            f"{CHUNK_CTE}, {SEARCH_CHUNKS_CTE}",
        ),
    ),
    "embed_batches": Entry(
        _embedded,
        oracle(
            DOCS,
            f"SELECT {CHUNK_ID} AS chunk_id, CAST(length(content) AS DOUBLE) AS v0, CAST(length(content) - length(replace(content, ' ', '')) AS DOUBLE) AS v1, CAST(length(content) - length(replace(content, chr(10), '')) AS DOUBLE) AS v2 FROM chunks WHERE token_count >= 20",
            CHUNK_CTE,
        ),
    ),
    "ingest_status_counts": Entry(
        lambda i: D.ingest_status(_files(i), _known(i)).groupBy("status").agg(F.count(F.lit(1)).alias("files")),
        oracle(
            DOCS,
            "SELECT status, count(*) AS files FROM (SELECT CASE WHEN doc_id IN (SELECT doc_id FROM identified WHERE lang = 'fr') THEN 'skipped' "
            "WHEN file_name > min(CASE WHEN lang <> 'es' AND n >= 20 THEN file_name END) OVER (PARTITION BY doc_id) THEN 'skipped' WHEN lang = 'es' THEN 'errors' WHEN n < 20 THEN 'empty' ELSE 'ingested' END AS status FROM (SELECT *, CASE WHEN lang = 'es' THEN replace(file_path, '.txt', '.xlsx') ELSE file_path END AS file_name, len(regexp_extract_all(content, '\\S+')) AS n FROM identified)) GROUP BY 1",
            IDENTITY,
        ),
    ),
    "vector_search": Entry(
        lambda i: _search(i).select("query_id", "chunk_id", "score", "rank", "doc_id", "doc_type", "account_name", "opportunity_id", "doc_date", "source_page", F.sha2("content", 256).alias("content_hash")),
        oracle(
            DOCS + ["search_requests"],
            "SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank, doc_id, doc_type, account_name, opportunity_id, CAST(NULL AS DATE) AS doc_date, source_page, sha256(content) AS content_hash FROM kept",
            SEARCH,
        ),
    ),
    "context_text": Entry(
        _contexts,
        oracle(
            DOCS + ["search_requests"],
            "SELECT q.query_id, coalesce(context_text, 'No relevant documents found.') AS context_text, coalesce(chunk_ids, '') AS chunk_ids FROM search_requests q LEFT JOIN (SELECT query_id, string_agg(concat('[', CAST(place AS VARCHAR), '] ', doc_type, ' | ', coalesce(account_name, 'None'), ' | page ', CAST(source_page AS VARCHAR), chr(10), content), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY place) AS context_text, "
            "string_agg(chunk_id, ',' ORDER BY place) AS chunk_ids FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM kept) GROUP BY 1) c ON c.query_id = q.query_id",
            SEARCH,
        ),
    ),
}
