"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays, memory-mapped to score.

Counting. Tokens become 64-bit hashes. Each batch sums its bigrams (previous token, token) and packs them, sorted,
into one block for each cell of a square grid over (hash of the first token, hash of the second). So a very common
word is spread over a row of cells, and a block is one row of some ten bytes for each bigram. A task merges the
blocks of its cells, writes their model files and hands on partial sums for the words: occurrences, distinct left
neighbours (as continuation count), and for each context how many of its bigrams were seen once, twice, or more
often. The sums are added up by word and written as word files. How often a context occurs needs no sum of its own:
every token but an end is the context of the next, and the start mark occurs once for each end.

Files. A cell is sorted hashes of its bigrams and their counts, one byte each, with the counts above 254 in arrays of
their own; a word file is a table sorted by hash. All files lie below the shared folder and are mapped by the workers, so a worker's memory holds the
pages it uses. The number of cells and word files follows the number of tokens.

Scoring. A batch's distinct bigrams and words are looked up in order, then
  p(w | v) = max(c(vw) - D(c(vw)), 0) / c(v) + g(v) * q(w),
  q(w) = max(n(w) - E(n(w)), 0) / n + h / (V + 1),
where D and E are the modified discounts for counts 1, 2 and above, n(w) the number of words before w, g and h the
mass that the discounts free, and the uniform part covers unknown words. A context never seen leaves q(w).

A text's tokens are its lower-case words and one end token; the first word's context is a start mark. Nulls: a null
text is empty (only its end token), a null id counts as empty text for the fold. Repeated rows are counted and
scored each. Without training rows every token has probability 1 / (V + 1) = 1. Other columns are ignored.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaflow.llm.common import part_of, pieces_of, stored, texts_of
from quotaflow.session import run_folder

FOLDS, HELD_OUT = 7, 2
CELL_TOKENS = 2_000_000  # tokens for each cell of the grid
WORD_FILE_TOKENS = 8_000_000  # tokens for each word file
TEXT_BYTES = 6 << 20
END, START = xxhash.xxh64_intdigest(b""), xxhash.xxh64_intdigest(b" ")  # no word is empty or a blank
MIX = np.uint64(0x9E3779B97F4A7C15)

WORD = np.dtype([(name, "<u8" if name == "word" else "<i8") for name in ("word", "seen", "before", "once", "twice", "more")])
SUMS = WORD.names[1:]
BIG = 255  # counts from here on are kept apart


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, ends included, and the number of tokens of each text."""
    digest, tokens, sizes = xxhash.xxh64_intdigest, [], []
    for text in texts:
        words = text.lower().split()
        tokens.extend(map(digest, words))
        tokens.append(END)
        sizes.append(len(words) + 1)
    return np.array(tokens, dtype=np.uint64), np.array(sizes, dtype=np.int64)


def contexts(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each token; the start mark before the first of a text."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes) - sizes] = START
    return before


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = first * MIX + (second ^ (second >> np.uint64(29)))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(29))


def cell_of(first: np.ndarray, second: np.ndarray, side: int) -> np.ndarray:
    rows, columns = first % np.uint64(side), second % np.uint64(side)
    return (rows * np.uint64(side) + columns).astype(np.int64)


def _local(folder: str) -> str:
    """The folder as workers open it."""
    url = urlparse(folder)
    if url.scheme not in ("", "file"):
        raise ValueError("the model is memory-mapped: spark.checkpoint.dir must be a mounted folder that all workers share")
    return url.path


def _summed(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, and the sums of the columns for each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[starts], [np.add.reduceat(c[order], starts) if len(keys) else c for c in columns]


def packed(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> bytes:
    """Bigrams as bytes: the distinct first tokens, compressed run lengths and counts, and the second tokens."""
    order = np.argsort(first, kind="stable")
    heads, runs = np.unique(first, return_counts=True)
    small = [zlib.compress(a.astype("<u4").tobytes(), 1) for a in (runs, n[order])]
    sizes = np.array([len(heads), len(first), *map(len, small)], "<u4")
    return b"".join([sizes.tobytes(), heads.astype("<u8").tobytes(), *small, second[order].astype("<u8").tobytes()])


def unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    heads, rows, a, b = np.frombuffer(block, "<u4", 4).tolist()
    first, at = np.frombuffer(block, "<u8", heads, 16), 16 + 8 * heads
    runs = np.frombuffer(zlib.decompress(block[at : at + a]), "<u4")
    n = np.frombuffer(zlib.decompress(block[at + a : at + a + b]), "<u4")
    return np.repeat(first, runs), np.frombuffer(block, "<u8", rows, at + a + b), n.astype(np.int64)


def _blocks(side: int) -> Callable:
    """For each batch and cell, a packed block of summed bigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, TEXT_BYTES):
            tokens, sizes = hashed(texts_of(batch))
            before = contexts(tokens, sizes)
            _, at, n = np.unique(pair_hash(before, tokens), return_index=True, return_counts=True)
            first, second = before[at], tokens[at]
            cells = cell_of(first, second, side)
            order = np.argsort(cells, kind="stable")
            found, starts = np.unique(cells[order], return_index=True)
            parts = [packed(first[mine], second[mine], n[mine]) for mine in np.split(order, starts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(parts, pa.binary())], ["cell", "block"])

    return run


def _write(path: str, *arrays: np.ndarray) -> None:
    """Writes a file under a name of this attempt and then gives it its own, so that a repeated task does no harm."""
    attempt = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
    with open(attempt, "wb") as file:
        for array in arrays:
            array.tofile(file)
    os.replace(attempt, path)


def _cells(folder: str) -> Callable:
    """Merges the blocks of each cell of this task, writes its file, hands on sums by word and the counts of counts."""

    def merged(cell: int, blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        first, second, n = (np.concatenate(c) for c in zip(*map(unpacked, blocks)))
        keys = pair_hash(first, second)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        counts = np.add.reduceat(n[order], starts)
        keys, first, second = keys[starts], first[order][starts], second[order][starts]
        big = np.flatnonzero(counts >= BIG)
        head = np.array([len(keys), len(big)], "<u8")
        _write(f"{folder}/cell-{cell}", head, keys, big.astype("<u8"), counts[big].astype("<u8"), np.minimum(counts, BIG).astype("<u1"))
        words, (seen, before) = _summed(second, [counts, np.ones(len(keys), np.int64)])
        heads, sums = _summed(first, [(counts == 1).astype(np.int64), (counts == 2).astype(np.int64), (counts > 2).astype(np.int64)])
        no_word, no_head = np.zeros(len(words), np.int64), np.zeros(len(heads), np.int64)
        tally = np.bincount(np.minimum(counts, 5), minlength=6)[1:5]  # a row of its own carries the counts of counts
        rows = [np.r_[words, heads].view(np.int64), np.r_[seen, no_head], np.r_[before, no_head], *(np.r_[no_word, s] for s in sums)]
        rows = [np.r_[r, t] for r, t in zip(rows, [0, tally[0], tally[1], tally[2], tally[3], 0])]
        is_word = np.r_[np.ones(len(rows[0]) - 1, bool), False]
        yield pa.RecordBatch.from_arrays([pa.array(is_word), *map(pa.array, rows)], ["is_word", *WORD.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[int, list[bytes]] = {}
        for batch in batches:
            for cell, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cells.setdefault(cell, []).append(block)
        while cells:
            yield from merged(*cells.popitem())

    return run


TOTALS = ["tokens", "vocabulary", "n1", "n2", "n3", "n4", "pairs", "more", "pairs1", "pairs2", "pairs3", "pairs4"]


def _word_files(folder: str) -> Callable:
    """Writes the word files of this task; hands on totals, and the counts of counts that come without a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            file = batch.column(0).to_numpy()
            table = np.empty(len(file), WORD)
            table["word"] = batch.column(1).to_numpy().view(np.uint64)
            for i, name in enumerate(SUMS):
                table[name] = batch.column(2 + i).to_numpy()
            for number in np.unique(file).tolist():
                files.setdefault(number, []).append(table[file == number])
        for number, parts in files.items():
            words = np.concatenate(parts)
            if number < 0:
                tally = [int(words[name].sum()) for name in SUMS[:4]]
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in [0] * 8 + tally], TOTALS)
                continue
            _write(f"{folder}/words-{number}", words[np.argsort(words["word"])])
            n = words["before"]
            figures = [words["seen"].sum(), np.count_nonzero(words["seen"]), *(np.count_nonzero(n == k) for k in (1, 2, 3, 4)), n.sum(), np.count_nonzero(n > 2), 0, 0, 0, 0]
            yield pa.RecordBatch.from_arrays([pa.array([int(f)]) for f in figures], TOTALS)

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Modified Kneser-Ney discounts by count (0, 1, 2, more), kept within 0 and the count where the sample is too small."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = [k - (k + 1) * y * (b / a if a else 0) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0, *(d if 0 < d < k else k * 0.5 for k, d in zip((1, 2, 3), raw))])


class Model:
    """Where the files are, and the figures that all words share. Small: the arrays stay in their files."""

    def __init__(self, folder: str, side: int, files: int, totals: dict[str, int]):
        self.folder, self.side, self.files = folder, side, files
        self.tokens, self.vocabulary, self.pairs = totals["tokens"], totals["vocabulary"], totals["pairs"]
        self.discount = discounts(*(totals[f"pairs{k}"] for k in (1, 2, 3, 4)))
        self.below = discounts(*(totals[k] for k in ("n1", "n2", "n3", "n4")))
        freed = self.below[1] * totals["n1"] + self.below[2] * totals["n2"] + self.below[3] * totals["more"]
        self.rest = freed / self.pairs if self.pairs else 1.0
        self.present = frozenset(os.listdir(folder)) if os.path.isdir(folder) else frozenset()
        if self.vocabulary and not any(name.startswith("words-") for name in self.present):
            raise FileNotFoundError(f"no model files in {folder}: it must be a mounted folder that all machines share")

    def _mapped(self, name: str, kind) -> np.ndarray:
        """An array of the model; a cell without bigrams has no file, but a file that was written must be there."""
        return np.memmap(f"{self.folder}/{name}", kind, "r") if name in self.present else np.empty(0, kind)

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of sorted distinct words; zeros for unknown ones."""
        found = np.zeros(len(hashes), WORD)
        found["word"] = hashes
        files = hashes % np.uint64(self.files)
        for number in np.unique(files).tolist():
            table = self._mapped(f"words-{number}", WORD)
            mine = np.flatnonzero(files == number)
            at = np.searchsorted(table["word"], hashes[mine])
            ok = at < len(table)
            ok[ok] = table["word"][at[ok]] == hashes[mine][ok]
            found[mine[ok]] = table[at[ok]]
        return found

    def counts(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Counts of distinct bigrams, in the order of their hashes."""
        keys, cells, found = pair_hash(first, second), cell_of(first, second, self.side), np.zeros(len(first), np.int64)
        order = np.argsort(cells, kind="stable")
        numbers, starts = np.unique(cells[order], return_index=True)
        for number, mine in zip(numbers.tolist(), np.split(order, starts[1:])):
            raw = self._mapped(f"cell-{number}", np.uint8)
            size, many = raw[:16].view("<u8").tolist() if len(raw) else (0, 0)
            table, big, large = (raw[16 + 8 * lo : 16 + 8 * hi].view("<u8") for lo, hi in ((0, size), (size, size + many), (size + many, size + 2 * many)))
            at = np.searchsorted(table, keys[mine])
            ok = at < size
            ok[ok] = table[at[ok]] == keys[mine][ok]
            at, mine = at[ok], mine[ok]
            found[mine] = raw[16 + 8 * (size + 2 * many) :][at]
            over = found[mine] == BIG
            found[mine[over]] = large[np.searchsorted(big, at[over].astype(np.uint64))]
        return found

    def score(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """For each text: tokens, known tokens, add-one base score and the model's score (log10)."""
        tokens, sizes = hashed(texts)
        before = contexts(tokens, sizes)
        distinct, which = np.unique(tokens, return_inverse=True)
        words = self.words(distinct)
        base = np.log10((words["seen"] + 1) / (self.tokens + self.vocabulary + 1))
        n = words["before"]
        lower = self.rest / (self.vocabulary + 1)
        if self.pairs:
            lower = lower + (n - self.below[np.minimum(n, 3)]) / self.pairs
        _, at, pair = np.unique(pair_hash(before, tokens), return_index=True, return_inverse=True)
        first, second = before[at], tokens[at]
        heads, head = np.unique(first, return_inverse=True)
        contexts_of = self.words(heads)
        d = self.discount
        freed = d[1] * contexts_of["once"] + d[2] * contexts_of["twice"] + d[3] * contexts_of["more"]
        total = np.where(heads == np.uint64(START), self.words(np.array([END], np.uint64))["seen"], contexts_of["seen"])
        with np.errstate(divide="ignore", invalid="ignore"):
            rest = np.where(total > 0, freed / total, 1.0)[head]
            c = self.counts(first, second)
            upper = np.where(c > 0, (c - d[np.minimum(c, 3)]) / total[head], 0.0)
        p = np.log10(upper + rest * (lower if np.isscalar(lower) else lower[which[at]]))
        starts = np.cumsum(sizes) - sizes
        return {
            "n_tokens": sizes,
            "n_known": np.add.reduceat((words["seen"] > 0)[which].astype(np.int64), starts),
            "base_score": np.add.reduceat(base[which], starts),
            "score": np.add.reduceat(p[pair], starts),
        }


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cell_tokens: int = CELL_TOKENS) -> Model:
    """A model of the rows whose id is not in the held-out fold."""
    spark = docs.sparkSession
    learned = docs.where(part_of(id_col, FOLDS) != HELD_OUT).select(F.col(text_col).alias("text"))
    size = learned.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    side = max(2, math.ceil(math.sqrt(size / 6 / cell_tokens)))  # some six bytes a token
    files = max(1, math.ceil(size / 6 / WORD_FILE_TOKENS))
    shared = run_folder(spark, "lm")
    folder = _local(shared)
    os.makedirs(folder, exist_ok=True)
    blocks = learned.mapInArrow(_blocks(side), "cell long, block binary").repartition(side * side, "cell")
    sums = blocks.mapInArrow(_cells(folder), "is_word boolean, " + ", ".join(f"{c} long" for c in WORD.names))
    words = sums.groupBy("is_word", "word").agg(*(F.sum(c).alias(c) for c in SUMS))
    unsigned = F.expr(f"cast(pmod(cast(word as decimal(20,0)) + if(word < 0, 18446744073709551616, 0), {files}) as long)")
    words = words.select(F.when(F.col("is_word"), unsigned).otherwise(-1).alias("file"), "word", *SUMS).repartition(files, "file")
    totals = stored(words.mapInArrow(_word_files(folder), ", ".join(f"{c} long" for c in TOTALS)), "lm-totals")
    return Model(folder, side, files, {k: v or 0 for k, v in totals.agg(*(F.sum(c).alias(c) for c in TOTALS)).first().asDict().items()})


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``held_out``, token counts and log10 scores of each text; ``perplexity`` is the model's per token."""
    source = docs.select(F.col(id_col).alias("doc_id"), (part_of(id_col, FOLDS) == HELD_OUT).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, TEXT_BYTES):
            found = model.score(texts_of(batch))
            n = found["n_tokens"]
            columns = [n, found["n_known"], np.full(len(n), model.tokens), found["base_score"], found["score"], 10 ** (-found["score"] / n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *map(pa.array, columns)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    shape = "n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, {shape}")
