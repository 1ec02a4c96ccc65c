import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from quotaflow.llm import queries, sharding


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 10**9), st.integers(1, 40))
def test_permutation(n, seed, shards):
    places = [sharding.locate(i, n, shards, seed) for i in range(n)]
    assert len(set(places)) == n
    sizes = Counter(s for s, _ in places)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1
    assert all(slot < sizes[shard] for shard, slot in places)
    for i in (0, n // 2, n - 1):
        assert sharding.row_number(*places[i], n, shards, seed) == i


@pytest.mark.parametrize("table", ["odd", "some"])
def test_shards(request, read, table):
    docs = request.getfixturevalue(table)
    rows = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in read(docs)]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    want = [(*r, *sharding.locate(i, len(rows))) for i, r in enumerate(rows)]
    got = [(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in sharding.shards(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_no_rows(none):
    assert sharding.shards(none).count() == 0


def test_query_columns(spark):
    found = queries.op5_sharding(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert {r.law for r in found.collect()} == {"rows"}


def test_copies_of_a_row_spread(spark):
    docs = spark.range(2_000_010).selectExpr("if(id < 2000000, 5, id - 2000000) AS doc_id", "'same' AS text")
    rows = sharding.numbered(docs)
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2_000_010 and max(sizes) < 1_500_000
    found = sharding.shards(docs)
    low, high, n = found.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last")).agg(F.min("n"), F.max("n"), F.count("*")).first()
    assert (low, n) == (2_000_010 // 16, 16) and high == low + 1
    assert found.select("shard", "slot").distinct().count() == 2_000_010


def test_the_longest_walk(spark):
    """Every number of small tables, the walks included, is where the plain computation puts it."""
    for n in (1, 2, 3, 7, 21, 31, 111, 133):
        docs = spark.range(n).selectExpr("id AS doc_id", "'t' AS text")
        got = {r.doc_id: (r.shard, r.slot) for r in sharding.shards(docs).collect()}
        assert got == {i: sharding.locate(i, n) for i in range(n)}
