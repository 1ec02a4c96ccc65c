"""Language identification with bit-sliced Bloom filters over character n-grams.

Training counts the 4-byte n-grams of all labelled training texts, by language. An n-gram belongs to each language
in which its share is at least a given part of its largest share in any language, and at least a millionth of the
language's n-grams; so a language has a million of them at most, whatever the corpus, and single noise n-grams of a large
corpus stay out. Each language has a Bloom filter, and the filters are stored bit-sliced: one row of machine words for
each slot, whose bit i is the slot's bit in the filter of language i. The bitwise AND of an n-gram's slots then names all
languages that contain it, in three lookups whatever the number of languages. The number of slots follows the counted
n-grams of the largest language (``LOAD`` slots for each). A text is decided by popcounts: hits per language, corrected
for the false positives that the fill of its filter predicts (``Model.fill``).

Texts are read in slices of ``SLICE`` bytes that carry the last three bytes over, so what a task holds beside a text does
not grow with its length. They are cut at blanks; only inside a run of so many bytes without one can a cut change the lower
case of a final sigma.

The score is the winner's share of all corrected hits. Nulls: a null text, or one without a letter, is ``und`` with
score 0; rows with a null language are not learned from; a null id counts as empty text for the fold. Repeated rows
are scored (and counted) each. Without training rows all texts are ``und``. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotaflow.llm.common import part_of, pieces_of, stored, texts_of

GRAM = 4  # bytes
LOAD = 8  # slots for each n-gram of the largest language: 3 % false positives
HASHES = 3
SHARE = 0.2  # least share of an n-gram in a language, as part of its largest share
LEAST = 1e-6  # least share of an n-gram in a language
WORD = 64  # bits
TEXT_BYTES = 4 << 20
SLICE = 1 << 16  # bytes of a text read at a time
GRAMS = 1 << 17  # n-grams looked up at a time
FOLDS, HELD_OUT = 4, 2
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
SPACES = b" \t\n\x0b\x0c\r"


def slices(text: bytes, size: int) -> Iterator[str]:
    """The text in parts of about ``size`` bytes, cut after a blank, else between two characters."""
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            blank = max(text.rfind(bytes([b]), start, end) for b in SPACES)
            if blank >= start:
                end = blank + 1
            while end < len(text) and text[end] & 0xC0 == 0x80:
                end += 1
        yield text[start:end].decode()
        start = end


def plain_of(text: bytes, size: int = SLICE) -> Iterator[tuple[bytes, bool]]:
    """Lower-case words with one blank between and two around them, in parts that overlap by three bytes; whether a part has a letter."""
    tail, inside, begun = b"  ", False, False
    for part in slices(text, size):
        plain = part.lower().encode().translate(LETTERS)
        words = b" ".join(plain.split())
        if words:
            gap = b" " if begun and not (inside and plain[:1] != b" ") else b""
            yield (body := tail + gap + words), any(c.isalpha() for c in part)
            tail, begun = body[1 - GRAM :], True
        inside = plain[-1:] != b" "
    yield tail + b"  ", False


def parts_of(texts: list[bytes], grams: int = GRAMS, size: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, set[int]]]:
    """N-grams of the texts, about ``grams`` at a time: as integers, with the number of the text each is from, and the texts with letters."""
    held, numbers, lettered, n = [], [], set(), 0
    for i, text in enumerate(texts):
        for part, letter in plain_of(text, size):
            held.append(part)
            numbers.append(i)
            n += len(part)
            if letter:
                lettered.add(i)
            if n >= grams:
                yield *_grams(held, numbers), lettered
                held, numbers, lettered, n = [], [], set(), 0
    if held:
        yield *_grams(held, numbers), lettered


def _grams(parts: list[bytes], numbers: list[int]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    if len(data) < GRAM:
        return np.empty(0, np.uint32), np.empty(0, np.int32)
    grams = data[: 1 - GRAM] << 24 | data[1 : 2 - GRAM] << 16 | data[2 : 3 - GRAM] << 8 | data[3:]
    part = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    whole = part[: 1 - GRAM] == part[GRAM - 1 :]  # not across two parts
    return grams[whole], np.array(numbers, np.int32)[part[: 1 - GRAM][whole]]


def slots_of(grams: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    wide = grams.astype(np.uint64)
    return ((wide * np.uint64(m)) >> np.uint64(64 - bits) for m in MULTIPLIERS[:HASHES])


def _summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, place = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    return grams, np.bincount(place, np.concatenate([n for _, n in found]), len(grams)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams by language, summed within a batch."""
    for batch in pieces_of(batches, TEXT_BYTES):
        texts, langs = texts_of(batch), np.array(batch.column(1).to_pylist(), dtype=object)
        for lang in sorted(set(langs)):
            found = []
            for grams, _, _ in parts_of([texts[i] for i in np.flatnonzero(langs == lang)]):
                found.append(np.unique(grams, return_counts=True))
                if len(found) == 32:  # a long text is summed on the way
                    found = [_summed(found)]
            grams, n = _summed(found)
            columns = [pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])


class Model:
    """Bit-sliced filters (``slots``: a row of words for each slot), the languages of the bits, and the fill of each filter."""

    def __init__(self, langs: list[str], slots: np.ndarray, bits: int):
        self.langs, self.slots, self.bits = langs, slots, bits
        self.fill = np.array([np.count_nonzero(slots[:, i // WORD] >> np.uint64(i % WORD) & np.uint64(1)) for i in range(len(langs))]) / len(slots)
        self.false = self.fill**HASHES

    def corrected(self, texts: list[bytes], grams: int = GRAMS, size: int = SLICE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hits of each text in each language, less the expected false ones, the n-grams of each text, and which have a letter."""
        hits, n, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts)), np.zeros(len(texts), bool)
        for found, owner, lettered in parts_of(texts, grams, size):
            letters[list(lettered)] = True
            if not len(found):
                continue
            first, last = owner[0], owner[-1] + 1  # texts come in order
            owner = owner - first
            n[first:last] += np.bincount(owner, minlength=last - first)
            slots = list(slots_of(found, self.bits))
            for word in range(self.slots.shape[1]):
                masks = self.slots[slots[0], word]
                for slot in slots[1:]:
                    masks &= self.slots[slot, word]
                for i in range(word * WORD, min((word + 1) * WORD, len(self.langs))):
                    hit = (masks >> np.uint64(i % WORD) & np.uint64(1)).astype(bool)
                    hits[first:last, i] += np.bincount(owner[hit], minlength=last - first)
        true = (hits - n[:, None] * self.false) / np.maximum(1 - self.false, 1e-9)
        return np.clip(true, 0, None), n, letters

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and the share of n-grams that the language contains."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        true, n, letters = self.corrected(texts)
        best, total = true.argmax(axis=1), true.sum(axis=1)
        top = true[np.arange(len(texts)), best]
        score = np.where(total > 0, top / np.maximum(total, 1e-9), 1 / len(self.langs)) * letters
        known = np.minimum(top / np.maximum(n, 1), 1) * letters
        return [self.langs[b] if ok else "und" for b, ok in zip(best, letters)], score, known


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", slot_bits: int | None = None) -> Model:
    """Filters from the rows whose id is not in the held-out fold and whose language is known.

    ``slot_bits``: base-2 logarithm of the number of slots, instead of the one that the n-grams ask for.
    """
    learned = docs.where((part_of(id_col, FOLDS) != HELD_OUT) & F.col(lang_col).isNotNull())
    learned = learned.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = learned.mapInArrow(_counts, "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    counts = stored(counts, "language-grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    most = F.max("share").over(Window.partitionBy("gram"))  # a row for each language
    members = counts.join(totals, "lang").withColumn("share", F.col("n") / F.col("total")).withColumn("most", most)
    members = members.where((F.col("share") >= SHARE * F.col("most")) & (F.col("share") >= LEAST)).select("gram", "lang")
    members = stored(members, "language-members")
    sizes = {r["lang"]: r["count"] for r in members.groupBy("lang").count().collect()}  # one row for each language
    langs = sorted(sizes)
    bits = slot_bits or max(10, (LOAD * max(sizes.values(), default=1) - 1).bit_length())
    table = np.zeros((1 << bits, -(-len(langs) // WORD)), np.uint64)
    if not langs:
        return Model([], table, bits)
    slots = members.mapInArrow(_slots(langs, bits), "slot long, word int, mask long")
    found = slots.groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toPandas()  # at most the slots of the table
    table[found["slot"].to_numpy(), found["word"].to_numpy()] = found["mask"].to_numpy(np.int64).view(np.uint64)
    return Model(langs, table, bits)


def _slots(langs: list[str], bits: int) -> Callable:
    """The filter slots of each (n-gram, language)."""
    place = {lang: i for i, lang in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.array([place[lang] for lang in batch.column(1).to_pylist()], np.int64)
            masks = (np.uint64(1) << (bit % WORD).astype(np.uint64)).view(np.int64)
            for slot in slots_of(batch.column(0).to_numpy().astype(np.uint32), bits):
                columns = [pa.array(slot.astype(np.int64)), pa.array((bit // WORD).astype(np.int32)), pa.array(masks)]
                yield pa.RecordBatch.from_arrays(columns, ["slot", "word", "mask"])

    return run


def _predicted(shared: Broadcast) -> Callable:
    """Adds language, score and known share to (id, text, ...) rows; drops the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, TEXT_BYTES):
            langs, score, known = shared.value.predict(texts_of(batch))
            columns = [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(score), pa.array(known)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "known"])

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``held_out``, ``lang_pred``, ``score`` and ``known`` (share of n-grams that the language contains) of each row."""
    source = docs.select(F.col(id_col).alias("doc_id"), (part_of(id_col, FOLDS) == HELD_OUT).alias("held_out"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_predicted(shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double, known double")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", least_known: float = 0.25) -> DataFrame:
    """The rows in a known language, with all columns: no ``und``, and at least ``least_known`` of the n-grams in the language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, TEXT_BYTES, text_col):
            langs, _, known = shared.value.predict(texts_of(batch, text_col))
            keep = [lang != "und" and k >= least_known for lang, k in zip(langs, known)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
