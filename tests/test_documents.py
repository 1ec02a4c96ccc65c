"""Documents: identity, paths, pages, chunks, ingestion status, file stream."""

import uuid
import hashlib

import pytest
from pyspark.sql import functions as F

from quotaflow.functions.ids import uuid5_url
from quotaflow.operators import documents as D
from quotaflow.sources.documents import as_text_files, new_file_stream, read_golden
from quotaflow.streaming.documents import ingest_stream


def test_uuid5_equals_python(spark):
    names = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(200)]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", uuid5_url(F.col("n")).alias("u")).collect()
    assert all(r["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, r["n"])) for r in rows)


@pytest.mark.parametrize(
    "path, expected",
    [
        ("/Volumes/sales/documents/contracts/42/OPP-0012345_contract.pdf", ("contracts", "42", "OPP-0012345_contract")),
        ("/Volumes/sales/documents/emails/note.txt", ("emails", "note.txt", None)),
        ("/data/in/opp_7.md", ("unknown", None, "opp_7")),
        ("/Volumes/sales/documents", ("unknown", None, None)),
        ("dbfs:/Volumes/sales/documents/proposals/7/a.docx", ("proposals", "7", None)),
    ],
)
def test_path_metadata(spark, path, expected):
    row = D.path_metadata(spark.createDataFrame([(path,)], "file_path string")).first()
    assert (row["doc_type"], row["account_id"], row["opportunity_id"]) == expected


@pytest.mark.parametrize(
    "n, windows", [(0, []), (19, [19]), (20, [20]), (470, [470, 8]), (500, [500, 38]), (512, [512, 50]), (1000, [512, 512, 76])]
)
def test_chunk_windows(spark, n, windows):
    text = " \n".join(f"w{i}" for i in range(n))
    pages = spark.createDataFrame([("d", 1, text)], "doc_id string, page int, page_text string")
    chunks = D.chunk_rows_of(pages).orderBy("chunk_index").collect()
    assert [c["token_count"] for c in chunks] == windows
    assert [c["chunk_index"] for c in chunks] == list(range(len(windows)))
    kept = D.long_enough(D.chunk_rows_of(pages)).collect()
    assert len(kept) == sum(w >= 20 for w in windows)
    # windows without their overlap give the text back, blanks included
    words = [w for c in chunks for w in c["content"].split()[: 462 if c is not chunks[-1] else None]]
    assert words == text.split()
    if n == 1000:
        assert " \n".join(words)[:3000] == text[:3000] and chunks[0]["content"] == " \n".join(f"w{i}" for i in range(512))


def test_pages(spark):
    df = spark.createDataFrame([("d", "one\ftwo\f \n\ffour")], "doc_id string, content string")
    assert [(r["page"], r["page_text"]) for r in D.page_rows(df).collect()] == [(1, "one"), (2, "two"), (4, "four")]


def test_plain_text(spark):
    html = '<html><script>var t = "</p>";</script><style>p{}</style><!-- x\n --><p>a &amp;lt; b</p><P\nclass="q">c&nbsp;d</P></html>'
    assert spark.createDataFrame([(html,)], "h string").select(D.plain_text(F.col("h"))).first()[0] == "a &lt; b c d"


def test_chunk_index_restarts_per_page_and_ids_repeat(spark):
    text = "\f".join(" ".join(["w"] * 600) for _ in range(2))
    df = spark.createDataFrame([("d", text)], "doc_id string, content string")
    chunks = D.with_chunk_ids(D.chunk_rows_of(D.page_rows(df)))
    rows = chunks.collect()
    assert sorted((r["source_page"], r["chunk_index"]) for r in rows) == [(1, 0), (1, 1), (2, 0), (2, 1)]
    assert {r["chunk_id"] for r in rows} == {r["chunk_id"] for r in chunks.collect()} and len({r["chunk_id"] for r in rows}) == 4


LONG = " ".join(["word"] * 30)
FILES = [
    ("/v/a.txt", LONG), ("/v/b.md", LONG), ("/v/c.txt", "short"), ("/v/d.xlsx", LONG + " x"), ("/v/e.TXT", LONG + " y"), ("/v/f.txt", "short"), ("/v/g", LONG + " z"),
]


def test_ingest_status(spark):
    files = spark.createDataFrame(FILES, "file_path string, content string")
    known = D.identify(files.filter("file_path = '/v/e.TXT'")).select("doc_id")
    status = {r["file_path"]: r["status"] for r in D.ingest_status(files, known).collect()}
    assert status == {
        "/v/a.txt": "ingested", "/v/b.md": "skipped", "/v/c.txt": "empty", "/v/d.xlsx": "errors", "/v/e.TXT": "skipped", "/v/f.txt": "empty", "/v/g": "errors",
    }


def test_known_texts_are_skipped_before_the_suffix_counts(spark):
    rows = [("/v/a.xlsx", LONG), ("/v/b.txt", LONG + " n"), ("/v/c.xlsx", LONG + " n"), ("/v/0.xlsx", LONG + " n"), ("/v/d.xlsx", "short"), ("/v/e.txt", "short")]
    files = spark.createDataFrame(rows, "file_path string, content string")
    known = D.identify(files.filter("file_path = '/v/a.xlsx'")).select("doc_id")
    status = {r["file_path"]: r["status"] for r in D.ingest_status(files, known).collect()}
    assert status == {"/v/a.xlsx": "skipped", "/v/b.txt": "ingested", "/v/c.xlsx": "skipped", "/v/0.xlsx": "errors", "/v/d.xlsx": "errors", "/v/e.txt": "empty"}


def test_texts_do_not_move_to_find_the_first_copies(spark):
    files = D.identify(spark.createDataFrame(FILES, "file_path string, content string"))
    plan = D.distinct_documents(files)._jdf.queryExecution().executedPlan().toString()
    # the window over ids and paths is below the join; no content is sorted or shuffled for it
    below = [line for line in plan.splitlines() if "WindowGroupLimit" in line or ("Exchange" in line and "doc_id" in line and "REPARTITION" not in line)]
    assert below and all("content" not in line for line in below)


def test_ingest(spark):
    files = spark.createDataFrame([f for f in FILES if f[0].endswith(("txt", "md"))], "file_path string, content string")
    chunks, metadata = D.ingest(files, spark.createDataFrame([], "doc_id string"))
    assert [r["file_path"] for r in metadata.collect()] == ["/v/a.txt"]
    assert chunks.count() == 1


def test_file_stream_is_incremental(spark, tmp_path):
    source, root = tmp_path / "Volumes" / "s" / "d" / "contracts" / "9", str(tmp_path / "out")
    source.mkdir(parents=True)
    (source / "OPP-1.txt").write_bytes(LONG.encode() + b" \xff")
    (source / "copy.md").write_bytes(LONG.encode() + b" \xff")
    (source / "table.xlsx").write_text(LONG)
    (source / "short.txt").write_text("short")

    def run():
        ingest_stream(as_text_files(new_file_stream(spark, str(tmp_path / "Volumes"), max_files=1)), root).awaitTermination()
        rows = spark.read.parquet(f"{root}/metadata").collect()
        assert len({r["doc_id"] for r in rows}) == len(rows)
        assert spark.read.parquet(f"{root}/chunks").count() == len(rows)
        return rows

    first = run()
    assert len(first) == 1 and (first[0]["doc_type"], first[0]["account_id"]) == ("contracts", "9")
    (source / "later.txt").write_text(LONG + " more")
    (source / "again.txt").write_bytes(LONG.encode() + b" \xff")
    assert {r["file_name"] for r in run()} == {first[0]["file_name"], "later.txt"}


def test_embed_texts_calls_in_batches(spark):
    df = spark.range(300).select(F.col("id"), F.col("id").cast("string").alias("content")).coalesce(1)
    rows = D.embed_texts(df, lambda texts: [[float(len(texts)), float(t)] for t in texts]).collect()
    assert all(r["embedding"][1] == r["id"] for r in rows) and max(r["embedding"][0] for r in rows) == 64


def test_golden_file(spark, tmp_path):
    (tmp_path / "g.json").write_text('[{"id": "a", "agent": "any", "query": "q", "should_refuse": true},\n {"id": "b", "agent": "x", "query": "q", "expected_contains": ["y"]}]')
    rows = {r["id"]: r for r in read_golden(spark, str(tmp_path / "g.json")).collect()}
    assert rows["a"]["should_refuse"] and rows["b"]["expected_contains"] == ["y"] and rows["b"]["min_groundedness"] is None
