"""Decontamination, licenses and personal data against brute force."""

import hashlib
import re
from collections import Counter

import pytest

from quotaflow.llm import decontam, licenses, pii, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def contaminated(rows, items, window=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = []
    for doc_id, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= ids
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


ITEMS = [
    (1, "quick brown fox jumps over the lazy dog near the old river"), (2, "Brown FOX"), (3, ""), (4, None), (5, "a"), (6, "no such words at all here"),
    (7, "open letters 12 wide open letters 12 wide open letters 12 wide"), (8, "the lazy dog near the old river bank today"), (9, "Brown FOX"),
]


@pytest.mark.parametrize("bits", [decontam.MAP_BITS, 6])
def test_windows_in_odd_texts(spark, odd, none, read, bits):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.hits(odd, items, map_bits=bits).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in got), key=str) == contaminated(read(odd), ITEMS)
    assert decontam.hits(none, items).count() == 0
    assert {r.n_hit for r in decontam.hits(odd, items.limit(0)).collect()} == {0}


def test_windows_in_generated_texts(spark, some, read):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = decontam.hits(some, items).collect()
    want = contaminated(read(some), [(r.item_id, r.text) for r in items.collect()])
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in got), key=str) == want
    assert any(r.n_hit for r in got)


def phrases(rows):
    out = []
    for doc_id, text in rows:
        w, at, labels = words(text), [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    at.append(i)
                    labels.add(label)
        out.append((doc_id, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    return sorted(out, key=str)


NOTICES = [
    (1, "Licensed under the GNU Lesser General Public License, version 2.1", "gpl,lgpl-2.1"),
    (2, "CC BY-NC-SA 4.0", "cc-by,cc-by-nc-sa-4.0"),
    (3, "Licensed under the Apache License, Version 2.0. All rights\nreserved.", "apache-2.0,reserved"),
    (4, "cc by " * 2000, "cc-by"),
    (5, "SPDX-License-Identifier: MIT", "spdx"),
    (6, "The MIT License, and the Mozilla Public License 2.0", "mit,mpl-2.0"),
    (7, "Ich fahre mit dem Rad; accept all, occur.", ""),
    (8, "éall rights reserved by cc", ""),
    (9, "GENERAL PUBLIC LICENSE general-public-license", "gpl"),
]


def test_license_rules(spark, odd, none, some, read):
    docs = spark.createDataFrame([(i, t) for i, t, _ in NOTICES], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert {i: got[i].labels for i in got} == {i: want for i, _, want in NOTICES}
    assert all(0 <= r.score <= 1 for r in got.values()) and got[7].score == 0 < got[5].score
    for table in (docs, odd, some):
        rows = licenses.scan(table).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=str) == phrases(read(table))
    assert licenses.scan(none).count() == 0
    assert len(licenses.rules()) > 200


def test_license_scan_stays_in_place(some):
    plan = licenses.scan(some)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    n = [int(c) for c in digits][::-1]
    return (sum(n[::2]) + sum(sum(divmod(2 * x, 10)) for x in n[1::2])) % 10 == 0


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15 if kind == "phone" else True


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in KINDS.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


PRIVATE = [
    (1, "a@b.c@d.e x"), (2, "a@b.c_x@d.e é😀 a@b.c"), (3, None), (4, "1.2.3.4.5.6.7.8 999.1.1.1 001.02.0003.4"), (5, "a" * 200_000 + " @ " + "7" * 100_000),
    (6, "1 " * 20_000 + "+1"), (7, "SSN: 123-45-6789 password=sk-abcdefgh12345678abcd foo [at] bar [dot] com"), (8, "4111 1111 1111 1111, 4111-1111-1111-1112"),
    (9, "+1 (555) 010-9999 +49 30 1234 +(1) +12"), (10, "12+3@x-.y..z x@y. @a.b"), (11, "98765432101234567890123.1.1.1"),
]


def test_base_spans(spark, odd, none, some, read):
    docs = spark.createDataFrame(PRIVATE, "doc_id long, text string")
    for table in (docs, odd, some):
        got = pii.digest(pii.detect(table)).collect()
        want = []
        for doc_id, text in read(table):
            spans = base_spans(text)
            joined = ",".join("%s:%d:%d" % s for s in spans)
            n = Counter(s[0] for s in spans)
            want.append((doc_id, *(n[k] for k in KINDS), hashlib.sha256(joined.encode()).hexdigest()))
        assert sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got), key=str) == sorted(want, key=str)
    assert pii.detect(none).count() == 0


def test_added_spans(spark):
    docs = spark.createDataFrame(PRIVATE, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.digest(pii.detect(docs)).collect()}
    assert spans[7] == "secret:26:49,ssn:5:16,spelled_email:50:72"
    assert spans[3] == spans[5] == spans[6] == ""


def test_sources_of_added_spans(spark, some):
    secrets = re.compile(r'token = "([0-9a-f]{40})"')
    rows = {r.doc_id: r.text for r in some.collect()}
    for r in pii.digest(pii.detect(some)).collect():
        want = [f"secret:{m.start(1)}:{m.end(1)}" for m in secrets.finditer(rows[r.doc_id].lower())]
        assert [s for s in r.spans.split(",") if s.startswith("secret")] == want


def test_queries_have_the_asked_columns(spark):
    folder = "/root/testdata/sf0.001"
    asked = {
        "op1_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
        "op3_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
        "op4_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    }
    for name, columns in asked.items():
        found = queries.QUERIES[name](spark, folder)
        assert found.columns == columns.split() and found.count() == 200
