"""Exact and near duplicates against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quotaflow.llm import exact_dedup, simhash

BLANK = str.maketrans("", "", " \t\n\x0b\x0c\r")


def exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(BLANK)].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: m[:3])[3]
        out += [(m[3], keep, len(members), hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [exact_dedup.BUCKET_BYTES, 3000])
@pytest.mark.parametrize("table", ["odd", "some"])
def test_exact_groups(request, read, table, size):
    docs = request.getfixturevalue(table)
    if table == "some" and size == 3000:
        size = 30_000  # several levels of spilling
    got = exact_dedup.exact_groups(docs, bucket_bytes=size).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == exact(read(docs))
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)


def test_nothing_to_group(none):
    assert exact_dedup.exact_groups(none).count() == 0
    assert simhash.near_groups(none).count() == 0


def plain_print(text, words=3):
    tokens = (text or "").encode().lower().split()
    parts = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(rows, words=3):
    prints = [plain_print(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)].append((doc_id is None, doc_id or 0, doc_id))
    return sorted(((doc_id, f"{prints[i]:016x}", min(least[root(i)])[2]) for i, (doc_id, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("table", ["odd", "some"])
def test_near_groups(request, read, table):
    docs = request.getfixturevalue(table)
    got = simhash.near_groups(docs).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == near(read(docs))
    assert len([r for r in got if r.kept]) == len({r.component_id for r in got})


def test_large_keys_are_dealt_again(spark):
    """A dense cluster in which all prints share most keys, and a chain of links over it."""
    rng = np.random.default_rng(5)
    center = int(rng.integers(1 << 62))
    prints = {center}
    while len(prints) < 600:
        prints.add(center ^ sum(1 << int(b) for b in rng.choice(20, rng.integers(1, 6), replace=False)))
    prints |= {int(x) for x in rng.integers(1 << 62, size=300)}
    prints = sorted(prints)
    table = spark.createDataFrame([(p,) for p in prints], "print long")
    found = {r.node: r.root for r in simhash.components(simhash.links(table, group_rows=50)).collect()}
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= 3:
                a, b = root(p), root(q)
                parent[max(a, b)] = min(a, b)
    assert {p: found.get(p, p) for p in prints} == {p: root(p) for p in prints}


def test_long_chain_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 201)}, 501: 500}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="ab c\té", max_size=12), max_size=8), st.integers(1, 4))
def test_fingerprint(texts, words):
    for text in texts:
        assert simhash.fingerprint(text.encode(), words) == plain_print(text, words)
