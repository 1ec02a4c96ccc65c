"""The Merkle manifest against a plain tree, and the sharing of its versions."""

import hashlib
import zlib

import pytest
from quotaflow.llm import merkle


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    """Result rows of (doc_id, source, lang, n_chars, text) rows, level by level."""

    def leaf(row, text):
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([digest("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, at):
        for nodes in levels[:-1]:
            start = at // 16 * 16
            yield "".join(nodes[start:at]), "".join(nodes[at + 1 : start + 16])
            at //= 16

    by_source, found = {}, []
    for row in rows:
        by_source.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row, row[4]), row))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    ordered = {s: sorted(by_source[s], key=lambda x: x[:3]) for s in names}
    trees = {s: tree([x[2] for x in ordered[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    for place, source in enumerate(names):
        for i, (known, _, node, row) in enumerate(ordered[source]):
            sides = [*path(trees[source], i), *path(top, place)]
            folded = node
            if known and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                folded = leaf(row, row[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))
            for before, after in sides:
                folded = digest(before + folded + after)
            proof = digest("".join(b + a for b, a in sides))
            found.append((row[0], node, trees[source][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return found


def rows_of(docs):
    return [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def result(docs, **kwargs):
    found = merkle.manifest(docs, **kwargs).drop("tampered")
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, found.collect()), key=str)


@pytest.mark.parametrize("height", [1, 3])
def test_given_texts(some, height):
    want = plain(rows_of(some))
    assert result(some, height=height) == sorted(want, key=str)
    assert {r[-1] for r in want} == {True, False}


def test_odd_rows(spark, odd):
    docs = odd.selectExpr("*", "if(doc_id % 3 = 0, null, concat('s', doc_id % 2)) AS source", "length(text) AS n_chars")
    assert result(docs, height=1) == sorted(plain(rows_of(docs)), key=str)


def test_many_sources(spark):
    docs = spark.range(700).selectExpr("id AS doc_id", "concat('ü', id div 2) AS source", "'en' AS lang", "id AS n_chars", "concat('Text ', id) AS text")
    assert result(docs, height=1) == sorted(plain(rows_of(docs)), key=str)


def test_copies_of_a_row_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "COARSE", 4)
    docs = spark.range(3000).selectExpr("if(id < 2500, 5, id) AS doc_id", "'s' AS source", "'en' AS lang", "1L AS n_chars", "'One Text' AS text")
    assert result(docs, height=1) == sorted(plain(rows_of(docs)), key=str)


def test_nothing(none):
    assert result(none.selectExpr("*", "'s' AS source", "1L AS n_chars")) == []


def test_a_version_shares_untouched_nodes():
    leaves = [digest(str(i)) for i in range(600)]
    tree, levels = merkle.grow(leaves, True)
    assert levels == 3
    way = merkle.digits(299, levels)
    version = merkle.replaced(tree, way, digest("other"))
    assert version[0] == merkle.grow([*leaves[:299], digest("other"), *leaves[300:]], True)[0][0]
    old, new = tree, version
    for at in way:
        assert old[0] != new[0] and all(o is n for i, (o, n) in enumerate(zip(old[1], new[1])) if i != at)
        old, new = old[1][at], new[1][at]
    assert tree[0] == merkle.fold(leaves[299], merkle.sides(tree, way))
