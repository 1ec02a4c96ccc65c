"""Language identification, toxicity, the language model and segmentation: brute force or held-out accuracy."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quotaflow.llm import langid, ngram_lm, pieces, queries, toxicity

from tests.llm.conftest import LONG

FOLDER = "/root/testdata/sf0.01"


def fold(doc_id, parts):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts


def test_language_of_held_out_texts(spark):
    got = queries.op2_language_id(spark, FOLDER).collect()
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len(got) == len(true) and all(r.held_out == (fold(r.doc_id, 4) == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(true[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_texts(spark, odd, none, some):
    model = langid.train(odd)
    got = langid.predict(odd, model).collect()
    assert len(got) == odd.count()
    by_id = {r.doc_id: r for r in got}
    assert {i: by_id[i].lang_pred for i in (4, 5, 6, 10)} == dict.fromkeys((4, 5, 6, 10), "und")
    assert by_id[13].lang_pred in model.langs and by_id[7].lang_pred == "de"
    empty = langid.train(none)
    assert empty.langs == [] and {r.lang_pred for r in langid.predict(odd, empty).collect()} == {"und"}
    assert langid.predict(none, model).count() == 0
    kept = langid.accepted(odd, langid.train(some))
    assert kept.columns == odd.columns and {4, 5, 6, 10}.isdisjoint({r.doc_id for r in kept.collect()})


def test_false_positives_are_corrected(some):
    """A crowded filter says yes to everything; the correction still finds the language."""
    small = langid.predict(some, langid.train(some, slot_bits=14)).collect()
    true = {r.doc_id: r.lang for r in some.collect()}
    assert sum(true[r.doc_id] == r.lang_pred for r in small) / len(small) > 0.9


def plain_grams(text):
    words = b"  " + b" ".join(text.decode().lower().encode().translate(langid.LETTERS).split()) + b"  "
    return [int.from_bytes(words[i : i + 4]) for i in range(len(words) - 3)]


@pytest.mark.parametrize(("grams", "size"), [(1 << 17, 1 << 16), (64, 64), (50, 7), (5, 1)])
def test_slices_have_the_same_ngrams(some, grams, size):
    given = [(r.text or "").encode() for r in some.limit(60).collect()]
    given += [b"", b"  ", b"a", "éÉ".encode(), b"12 34", b"ab12cd  ef", b"x" * 300, b" " * 300, "漢字 Straße ".encode() * 40]
    found = [[] for _ in given]
    for values, owner, _ in langid.parts_of(given, grams, size):
        for value, i in zip(values.tolist(), owner.tolist()):
            found[i].append(value)
    assert found == [plain_grams(t) for t in given]


def test_slices_have_the_same_hits(some):
    model, given = langid.train(some), [(r.text or "").encode() for r in some.collect()] + [LONG.encode()]
    for a, b in zip(model.corrected(given), model.corrected(given, 64, 64)):
        assert np.array_equal(a, b)


def test_a_hundred_languages(spark):
    rng, rows = random.Random(3), []
    for lang in range(100):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(30)]
        rows += [(lang * 40 + i, " ".join(rng.choices(words, k=40)), f"l{lang:03}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert len(model.langs) == 100 and model.slots.shape[1] == 2 and model.fill.max() < 0.4
    want = {i: lang for i, _, lang in rows}
    assert all(r.lang_pred == want[r.doc_id] for r in langid.predict(docs, model).collect() if r.held_out)


def test_slots_follow_the_ngrams(spark):
    rng, bits = random.Random(9), []
    for n in (40, 4000):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(n)]
        rows = [(i, " ".join(words[i::20]), "en") for i in range(20)]
        model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
        assert model.fill.max() < 1 - np.exp(-langid.HASHES / langid.LOAD) + 0.02
        bits.append(model.bits)
    assert bits[0] < bits[1]


def test_toxicity_of_held_out_texts(spark):
    folder = "/root/testdata/sf0.1"
    got = queries.op6_toxicity(spark, folder).collect()
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(label[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in label]
    right = Counter(held)
    assert right[1, 1] / (right[1, 1] + right[1, 0]) > 0.85 and right[1, 1] / (right[1, 1] + right[0, 1]) > 0.85
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_toxicity_of_odd_texts(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (2, None), (99, 1), (None, 1)], "doc_id long, toxic int")
    for given in (labels, labels.limit(0)):
        model = toxicity.train(odd, given)
        got = toxicity.score(odd, model).collect()
        assert len(got) == odd.count() and {r.predicted for r in got} == {0}
        assert toxicity.score(none, model).count() == 0


def test_grammar():
    lexicon = toxicity.Lexicon({})
    weight = {t: lexicon.features(t.encode())[0] for t in (
        "you are an idiot", "an idiot", "you are not an idiot", "he said you are an idiot", "i will kill you", "kill time", "you said. an idiot", "a nice day",
    )}
    assert weight["you are an idiot"] > weight["an idiot"] > weight["he said you are an idiot"] > weight["you are not an idiot"] > 0
    assert weight["i will kill you"] > weight["kill time"] > weight["a nice day"] == 0
    assert weight["you said. an idiot"] == weight["an idiot"]  # clauses end at the stop


def test_composition_is_the_chain():
    first, second = toxicity._negation(), toxicity._report()
    both = first.then(second)
    for symbols in itertools.product((toxicity.OTHER, toxicity.INSULT, toxicity.NEGATION, toxicity.REPORT), repeat=5):
        a, b, c = first.start, second.start, both.start
        for s in symbols:
            a, middle, _ = first.step(a, s)
            b, out, _ = second.step(b, middle)
            c, got, _ = both.step(c, s)
            assert got == out


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


@pytest.mark.parametrize("table", ["odd", "some"])
def test_language_model(request, read, table):
    docs = request.getfixturevalue(table)
    rows = read(docs)
    train = [tokens(t) for i, t in rows if fold(i, 7) != 2]
    seen = Counter(w for s in train for w in s)
    n, v = sum(seen.values()), len(seen)
    pairs = Counter(p for s in train for p in zip([None, *s], s))
    before = Counter(w for _, w in pairs)

    def cut(counts):
        tally = Counter(counts)
        return ngram_lm.discounts(*(tally[k] for k in (1, 2, 3, 4)))

    d, e = cut(pairs.values()), cut(before.values())
    rest = sum(e[min(c, 3)] for c in before.values()) / len(pairs)
    total, freed = Counter(), Counter()
    for (a, _), c in pairs.items():
        total[a] += c
        freed[a] += d[min(c, 3)]

    def p(a, w):
        low = rest / (v + 1) + ((before[w] - e[min(before[w], 3)]) / len(pairs) if before[w] else 0)
        c = pairs[a, w]
        return low if not total[a] else (c - d[min(c, 3)] if c else 0) / total[a] + freed[a] / total[a] * low

    assert math.isclose(sum(p(None, w) for w in seen) + p(None, "unseen"), 1, rel_tol=1e-9)
    want = []
    for i, t in rows:
        s = tokens(t)
        base = sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in s)
        want.append((str(i), len(s), sum(seen[w] > 0 for w in s), n, base, sum(math.log10(p(a, w)) for a, w in zip([None, *s], s))))
    model = ngram_lm.train(docs, cell_tokens=5000)
    got = [(str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ngram_lm.score(docs, model).collect()]
    for g, w in zip(sorted(got), sorted(want), strict=True):
        assert g[:4] == w[:4] and math.isclose(g[4], w[4], rel_tol=1e-9) and math.isclose(g[5], w[5], rel_tol=1e-9)


def test_language_model_of_nothing(none, odd):
    model = ngram_lm.train(none)
    assert ngram_lm.score(none, model).count() == 0
    assert {(r.n_known, r.score) for r in ngram_lm.score(odd, model).collect()} == {(0, 0.0)}


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(pieces.default_path())


def every(word, vocabulary):
    """All segmentations of a word."""
    if not word:
        return [(0.0, b"")]
    out = []
    for end in range(1, len(word) + 1):
        piece = vocabulary.plain.get(word[:end])
        if piece is None and end == 1:
            piece = vocabulary.spelled(word[0])
        if piece is not None:
            out += [(piece[0] + s, piece[1] + ids) for s, ids in every(word[end:], vocabulary)]
    return out


@pytest.mark.parametrize("found_by", ["automaton", "lookup"])
def test_best_segmentations(vocabulary, found_by):
    rng = random.Random(3)
    automaton = vocabulary.automaton() if found_by == "automaton" else None
    made = [" " + "".join(rng.choice("aehtnrioé▁ñ") for _ in range(rng.randint(1, 9))) for _ in range(150)]
    for word in [" the", "   x", "\n", " 漢字", " ▁a", *made]:
        want, got = sorted(every(word, vocabulary), key=lambda c: -c[0]), pieces.best_of(word, vocabulary, 4, automaton)
        assert [c[0] for c in got] == [c[0] for c in want[:4]]
        assert len({c[1] for c in got}) == len(got) and set(got) <= set(want)


def test_best_segmentations_of_texts(vocabulary):
    rng = random.Random(4)
    encoder = pieces.Encoder(vocabulary, 4)
    for _ in range(60):
        text = " ".join("".join(rng.choice("aht") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 3)))
        got, want = encoder.text(text), sorted(every(" " + text, vocabulary), key=lambda c: -c[0])
        assert [c[0] for c in got] == [c[0] for c in want[:4]] and set(got) <= set(want)


def test_the_query_finds_several_other_segmentations(spark, vocabulary, tmp_path):
    """Eight of a text, if it has as many: the best of all its segmentations."""
    texts = ["hat that", "atth ta haa", "a", "the tattat", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for row in pieces.whole(queries.op9_sentencepiece(spark, str(tmp_path))).collect():
        want = sorted(every(" " + texts[row.doc_id], vocabulary), key=lambda c: -c[0])[:8] if texts[row.doc_id] else [(0.0, b"")]
        got = [(row.score, row.ids), *((o.score, o.ids) for o in row.others)]
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want], abs=1e-9)
        assert len({tuple(ids) for _, ids in got}) == len(want)
        assert all(pieces.same_text(np.array(ids, np.int32).tobytes(), (texts[row.doc_id] or "").encode(), vocabulary) for _, ids in got)


def test_words_together_are_words_searched(vocabulary):
    rng = random.Random(11)
    words = list({" " * rng.randrange(3) + "".join(rng.choices("aehtnrioslé▁", k=rng.randint(1, 30))) for _ in range(400)} - {""})
    words = [w for w in words if vocabulary.characters.issuperset(w)]
    score, loss, counts, ids = pieces.best_paths(words, vocabulary, pieces.Finder(vocabulary))
    ends, raw = np.cumsum(counts) * 4, ids.tobytes()
    for i, word in enumerate(words):
        choices = pieces.best_of(word, vocabulary, 2)
        want = choices[0][0] - choices[1][0] if len(choices) > 1 else np.inf
        assert (score[i], raw[ends[i] - 4 * counts[i] : ends[i]], loss[i]) == (*choices[0], want)


def test_texts_are_their_words(vocabulary, monkeypatch):
    """The best two of a text, from a search of every word; words are numbered a few at a time."""
    given = ["", "\n", "  two  blanks ", "漢字 unknown 😀", "the same the same the same", "x" * 90 + " long", " ".join("".join(c) for c in itertools.product("aht", repeat=4))]
    whole = [pieces.Encoder(vocabulary, 2).text(t) for t in given]
    monkeypatch.setattr(pieces, "PART_WORDS", 5)
    monkeypatch.setattr(pieces, "GROUP_WORDS", 3)
    assert pieces.Encoder(vocabulary, 2).texts(given) == whole
    for text, found in zip(given, whole):
        words = [pieces.best_of(w, vocabulary, 2) for w in pieces.WORDS.findall(" " + text)] if text else []
        best = sum(w[0][0] for w in words), b"".join(w[0][1] for w in words)
        assert found[0] == best and pieces.same_text(best[1], text.encode(), vocabulary)
        losses = [w[0][0] - w[1][0] for w in words if len(w) > 1]
        assert [c[0] for c in found[1:]] == ([best[0] - min(losses)] if losses else [])
        assert not pieces.same_text(best[1], text.encode() + b"x", vocabulary)


def test_colliding_hashes_are_told_apart(vocabulary):
    finder = pieces.Finder(vocabulary)
    small = pieces.Finder.__new__(pieces.Finder)
    small.__dict__.update(finder.__dict__)
    none = len(finder.hashes) - 1
    small.tables, small.more = [np.full_like(t, none) for t in finder.tables], np.arange(200)  # all looked up one by one
    assert finder.shared.any() and len(finder.more) == 0
    codes = np.frombuffer("".join(list(vocabulary.plain)[:60]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    a, b = finder.pieces(codes, 6), small.pieces(codes, 6)
    assert np.array_equal(np.where(a < 200, a, none), b)


def test_round_trip(odd, none, read, vocabulary):
    encoded = pieces.encode(odd).cache()
    back = pieces.decode(encoded)
    assert sorted(((i, t or "") for i, t in read(odd)), key=str) == sorted(((r.doc_id, r.text) for r in back.collect()), key=str)
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in encoded.collect())
    assert all(r.score >= o.score for r in encoded.collect() for o in r.others)
    assert pieces.encode(none).count() == 0
    assert pieces.decode(encoded.selectExpr("doc_id", "cast(null as array<int>) as ids")).where("text is null").count() == odd.count()


def test_long_word_is_the_same_without_kept_edges(vocabulary, monkeypatch):
    word = " " + "antidisestablishment" * 4
    assert len(word) > pieces.CACHED_CHARS
    got = pieces.best_of(word, vocabulary, 3)
    monkeypatch.setattr(pieces, "CACHED_CHARS", 1000)
    assert got == pieces.best_of(word, vocabulary, 3, vocabulary.automaton())


def test_words_are_found_again_in_both_generations(vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_WORDS", 3)
    small, large = pieces.Encoder(vocabulary, 2), pieces.Encoder(vocabulary, 2)
    monkeypatch.setattr(pieces, "CACHE_WORDS", 3)
    text = "one two three four one two five six seven one one two eight"
    assert small.text(text) == small.text(text)
    monkeypatch.setattr(pieces, "CACHE_WORDS", 1000)
    assert small.text(text) == large.text(text)


def test_a_model_without_its_files_is_refused(spark, some, tmp_path):
    model = ngram_lm.train(some)
    assert ngram_lm.score(some, model).count() == some.count()
    gone = next(name for name in sorted(model.present) if name.startswith("words-"))
    model.folder = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        model._mapped(gone, ngram_lm.WORD)
    with pytest.raises(Exception, match="No such file|FileNotFound"):
        ngram_lm.score(some, model).collect()
    with pytest.raises(FileNotFoundError, match="mounted folder"):
        ngram_lm.Model(str(tmp_path), 1, 1, {"tokens": 1, "vocabulary": 1, "pairs": 0, "more": 0, **{f"pairs{k}": 0 for k in (1, 2, 3, 4)}, **{f"n{k}": 0 for k in (1, 2, 3, 4)}})


def test_words_of_earlier_batches_are_not_segmented_again(vocabulary, monkeypatch):
    texts = ["one two three one", "two four", "", "one five three", "six seven eight nine", "one two ten"]
    whole = pieces.Encoder(vocabulary, 3).texts(texts)
    asked, best_paths = [], pieces.best_paths
    monkeypatch.setattr(pieces, "best_paths", lambda words, *rest: (asked.extend(words), best_paths(words, *rest))[1])
    encoder = pieces.Encoder(vocabulary, 3)
    assert [encoder.texts([t])[0] for t in texts] == whole
    assert len(asked) == len(set(asked)) == 10
    monkeypatch.setattr(pieces, "KEPT_WORDS", 4)  # the rarer ones go
    encoder.forget()
    assert [encoder.texts([t])[0] for t in texts] == whole and len(encoder.place) < 10
