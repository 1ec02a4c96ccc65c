"""SentencePiece encoding and decoding with N-best segmentation.

A text is a lattice of vocabulary pieces, whose places hashes of its substrings find. Forward Viterbi gives the best
score of every prefix; these are exact heuristics for an A-star search backward from the end, which finds the
segmentations of a lattice in order of their score. The best continuation of a path keeps its estimate, so it is
followed at once; only the other choices on the way go to the queue.

No piece reaches over a blank that follows another character, so the lattice of a text falls apart into those of its
words (the blanks before a word belong to it). The N best of a text are combined from the N - 1 words that lose least by
another choice: a choice outside of them is never among the N best. What a word loses is known from the forward and
backward scores alone, as the least detour over an edge that is not on its best path. So the distinct words of a batch get
their scores together, place by place (``best_paths``), and only the words that lose least are searched. Tables of bounded
size keep what was found for both: a task segments a word that comes again in a later batch once.

The vocabulary file is an argument and never trained; its pieces and scores go to the tasks (some thousand pieces).
Text is taken as it is, with one blank put before it. Characters outside the vocabulary are spelled as byte pieces,
so decoding gives back exactly the text that was encoded.

Nulls: a null text counts as empty, a null list of ids decodes to null. Empty texts have no pieces and score 0. Very
long words take linear time and memory. Repeated rows are encoded each. Equal scores: the longer last piece first.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaflow.llm.common import pieces_of, release, texts_of

MARK = "▁"
N_BEST = 8
BYTE_SCORE = -100_000.0  # of each byte of a spelled character: worse than any piece
NEVER = -1e8  # the score that the file gives to pieces for runs of blanks
CACHE_WORDS = 100_000  # searched in one task
KEPT_WORDS = 120_000  # segmented words of earlier batches, beyond which the rarer ones go
CACHED_CHARS = 64  # of the longest word that is remembered, or segmented together with others
PART_WORDS = 400_000  # held as words at a time
GROUP_WORDS = 2000  # segmented together, so that their scores fit a cache
TEXT_BYTES = 2 << 20
WORDS = re.compile(" *[^ \n]+| +|\n")

NOTHING = -1e300
Choice = tuple[float, bytes]  # score and ids as 32-bit integers
Edit = tuple[int, int, bytes]  # place and number of ids of the best segmentation, and what stands for them
Other = tuple[float, list[Edit]]  # score of another segmentation, and its edits in order


class Vocabulary:
    """Pieces (with blanks for the marker), their scores, and the byte pieces."""

    def __init__(self, pieces: list[str], scores: list[float]):
        spelled = {int(p[1:-1], 16): i for i, p in enumerate(pieces) if re.fullmatch("<0x[0-9A-F]{2}>", p)}
        if len(spelled) < 256:
            raise ValueError("the vocabulary needs a piece for each byte")
        control = {"<unk>", "<s>", "</s>", *(pieces[i] for i in spelled.values())}
        plain = {p.replace(MARK, " "): i for i, p in enumerate(pieces) if p not in control and "\n" not in p}
        if any(" " in p.lstrip(" ") for p in plain):
            raise ValueError("a piece reaches over a blank")
        self.byte_ids = [np.int32(spelled[b]).tobytes() for b in range(256)]
        self.longest = max(map(len, plain))
        runs = {p: -1.0 - len(p) for p, i in plain.items() if scores[i] <= NEVER and not p.strip(" ")}
        self.plain = {p: (runs.get(p, scores[i]), np.int32(i).tobytes()) for p, i in plain.items()}
        self.characters = {p for p in plain if len(p) == 1}
        self.ids = np.array(list(plain.values()), np.int32)  # of each plain piece, with their lengths and scores
        self.lengths = np.array([len(p) for p in plain], np.int64)
        self.scores = np.array([self.plain[p][0] for p in plain])
        self.bytes = [b""] * len(pieces)  # what each id stands for
        for p, i in plain.items():
            self.bytes[i] = p.encode()
        for b, i in spelled.items():
            self.bytes[i] = bytes([b])
        self.byte_lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.byte_starts = np.cumsum(self.byte_lengths) - self.byte_lengths
        self.all_bytes = np.frombuffer(b"".join(self.bytes), np.uint8)

    def automaton(self):
        """Finds pieces in a text: last place, and length, score and id; longer pieces first."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for piece, (score, piece_id) in self.plain.items():
            found.add_word(piece, (len(piece), score, piece_id))
        found.make_automaton()
        return found

    def spelled(self, char: str) -> Choice:
        raw = char.encode()
        return BYTE_SCORE * len(raw), b"".join(self.byte_ids[b] for b in raw)


def load(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return Vocabulary([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids])


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


Edge = tuple[int, float, bytes]  # length, score and id of a piece that ends at a place


def edges_to(word: str, end: int, vocabulary: Vocabulary) -> list[Edge]:
    """The pieces that end at ``end``, longest first; a character that is no piece is spelled."""
    get, found = vocabulary.plain.get, []
    for start in range(max(0, end - vocabulary.longest), end):
        piece = get(word[start:end])
        if piece is not None:
            found.append((end - start, *piece))
    if not found or found[-1][0] != 1:
        found.append((1, *vocabulary.spelled(word[end - 1])))
    return found


def forward(word: str, vocabulary: Vocabulary, automaton=None) -> tuple[list[float], list[list[Edge]] | None]:
    """Best score of each prefix, and the edges to each place (None: look them up, so that long words need little memory)."""
    size = len(word)
    if automaton is not None and size <= CACHED_CHARS:
        best, edges = [0.0] + [NOTHING] * size, [[] for _ in range(size + 1)]
        for last, edge in automaton.iter(word):
            edges[last + 1].append(edge)
            total = best[last + 1 - edge[0]] + edge[1]
            if total > best[last + 1]:
                best[last + 1] = total
        if best[size] > NOTHING and vocabulary.characters.issuperset(word):
            return best, edges
    best = [0.0]
    for end in range(1, size + 1):
        best.append(max([best[end - length] + score for length, score, _ in edges_to(word, end, vocabulary)]))
    return best, None


def best_of(word: str, vocabulary: Vocabulary, n: int, automaton=None) -> list[Choice]:
    """The ``n`` best segmentations of a word, best first."""
    best, edges = forward(word, vocabulary, automaton)
    chosen, heap, serial = [], [], 0
    end, score, ids, edge = len(word), 0.0, [], None
    while True:
        wanted = n - len(chosen) - 1  # further segmentations after this one
        while end:
            if edge is None:
                options = edges[end] if edges else edges_to(word, end, vocabulary)
                edge = options[0]
                if len(options) > 1:
                    estimates = [best[end - length] + own for length, own, _ in options]
                    first = max(estimates)
                    edge = options[estimates.index(first)]
                    if wanted:
                        for estimate, other in zip(estimates, options):
                            # of more than are wanted, the worst will never be taken
                            if other is not edge and (len(heap) < wanted or score + estimate > -heap[-1][0]):
                                serial += 1
                                insort(heap, (-(score + estimate), serial, end, score, ids, len(ids), other))
                                del heap[wanted:]
            ids.append(edge[2])
            end, score, edge = end - edge[0], score + edge[1], None
        chosen.append((score, b"".join(ids[::-1])))
        if len(chosen) == n or not heap:
            return chosen
        _, _, end, score, ids, kept, edge = heap.pop(0)
        ids = ids[:kept]  # the way from the end to where the other choice is made


def _runs(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The places starts[0], starts[0] + 1, ... of consecutive runs of the given lengths."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


FACTOR = 0x9E3779B97F4A7C15
TABLE_BITS = 20


class Finder:
    """Numbers of the pieces at all places of a text, by 64-bit hashes of its substrings; two tables, the second for collisions."""

    def __init__(self, vocabulary: Vocabulary):
        self.powers = [pow(FACTOR, i, 1 << 64) for i in range(vocabulary.longest)]
        hashes = [sum(ord(c) * p for c, p in zip(piece, self.powers)) % (1 << 64) for piece in vocabulary.plain]
        self.hashes = np.array([*hashes, 0], np.uint64)  # the last one is that of no piece
        if len(set(hashes)) < len(hashes):
            raise ValueError("two pieces have one hash")
        self.scores = np.append(vocabulary.scores, NOTHING)
        self.multipliers = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
        self.tables = [np.full(1 << TABLE_BITS, len(hashes), np.int32) for _ in self.multipliers]
        left, self.shared = np.arange(len(hashes)), np.zeros(1 << TABLE_BITS, bool)
        for multiplier, table in zip(self.multipliers, self.tables):
            slots, first, n = np.unique(self._slots(self.hashes[left], multiplier), return_index=True, return_counts=True)
            table[slots] = left[first]
            left = np.delete(left, first)
            if table is self.tables[0]:
                self.shared[slots[n > 1]] = True  # slots of several pieces: the others are in the second table
        self.more = left  # looked up one by one, mostly none

    @staticmethod
    def _slots(hashes: np.ndarray, multiplier: int) -> np.ndarray:
        return hashes * np.uint64(multiplier) >> np.uint64(64 - TABLE_BITS)

    def pieces(self, codes: np.ndarray, longest: int) -> np.ndarray:
        """Row n: the piece of n + 1 characters that starts at each place, or the number of no piece. A text runs along the first axis."""
        none = len(self.hashes) - 1
        found, hashes = np.full((longest, *codes.shape), none, np.int32), np.zeros(codes.shape, np.uint64)
        for n in range(longest):
            hashes = hashes[: len(codes) - n] + codes[n:] * np.uint64(self.powers[n])
            row, flat = found[n, : len(hashes)].reshape(-1), hashes.reshape(-1)
            slots = self._slots(flat, self.multipliers[0])
            piece = self.tables[0][slots]
            np.copyto(row, piece, where=self.hashes[piece] == flat)
            at = np.flatnonzero(self.shared[slots])
            piece = self.tables[1][self._slots(flat[at], self.multipliers[1])]
            same = self.hashes[piece] == flat[at]
            row[at[same]] = piece[same]
            for piece in self.more:
                row[flat == self.hashes[piece]] = piece
        return found


def best_paths(words: list[str], vocabulary: Vocabulary, finder: Finder) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Score, loss of another path, number of pieces, and the ids of all words one after the other.

    The words have no line feed and no character outside the vocabulary. Row p of each table holds the place before
    character p of all words, which line feeds fill up to one length.
    """
    sizes, each = np.array([len(w) for w in words]), np.arange(len(words))
    size = int(sizes.max())
    codes = np.frombuffer("".join([w.ljust(size, "\n") for w in words]).encode("utf-32-le"), np.uint32)
    codes, longest = np.ascontiguousarray(codes.reshape(-1, size).T, np.uint64), min(vocabulary.longest, size)
    piece = finder.pieces(codes, longest)
    score = finder.scores[piece]
    best, rest, last = np.full((size + 1, len(words)), NOTHING), np.full((size + 1, len(words)), NOTHING), np.zeros((size + 1, len(words)), np.int16)
    best[0], rest[sizes, each] = 0.0, 0.0
    for place in range(1, size + 1):
        for n in range(min(place, longest), 0, -1):  # longer pieces first
            total = best[place - n] + score[n - 1, place - n]
            better = total > best[place]
            np.copyto(best[place], total, where=better)
            np.copyto(last[place], n, where=better)
    for place in range(size - 1, -1, -1):
        for n in range(1, min(longest, size - place) + 1):
            np.maximum(rest[place], score[n - 1, place] + rest[place + n], out=rest[place])
    for n in range(longest):  # the best way through each edge
        score[n, : size - n] += best[: size - n] + rest[n + 1 :]
    place, word, ways = sizes, each, []
    while len(place):  # all best paths, from their ends
        length = last[place, word]
        place = place - length
        score[length - 1, place, word] = NOTHING
        ways.append((word, piece[length - 1, place, word]))
        inside = place > 0
        place, word = place[inside], word[inside]
    total, other = best[sizes, each], score.max(axis=(0, 1))
    loss = np.where(other > NOTHING / 2, total - other, np.inf)
    word, found = (np.concatenate(w) for w in zip(*reversed(ways)))
    return total, loss, np.bincount(word, minlength=len(words)), vocabulary.ids[found[np.argsort(word, kind="stable")]]


def least_sums(losses: dict[int, list[float]], n: int) -> list[tuple[float, dict[int, int]]]:
    """The ``n`` smallest sums of one loss for each word, with the choices that are not the first."""
    sums: list[tuple[float, dict[int, int]]] = [(0.0, {})]
    for place in sorted(losses, key=lambda p: (losses[p][1], p))[: n - 1]:
        if len(sums) == n and losses[place][1] > sums[-1][0]:
            break  # neither this word nor one after it has a choice that is among them
        more = sorted(((s + loss, at, i) for at, (s, _) in enumerate(sums) for i, loss in enumerate(losses[place][: n // (at + 1)])), key=lambda x: x[0])[:n]
        sums = [(s, {**sums[at][1], place: i} if i else sums[at][1]) for s, at, i in more]
    return sums


def _numbered(texts: list[str], place: defaultdict[str, int]) -> list[np.ndarray]:
    """The numbers of the words of each text; ``place`` gets the new ones. Only part of the words is held at a time."""
    found, sizes, held = [], np.zeros(len(texts), np.int64), []

    def flush() -> None:
        found.append(np.fromiter(map(place.__getitem__, held), np.int32, len(held)))
        held.clear()

    for i, text in enumerate(texts):
        if not text:
            continue
        words = WORDS.finditer(" " + text) if len(text) > PART_WORDS else None
        while part := ([m.group() for m in islice(words, PART_WORDS)] if words else WORDS.findall(" " + text)):
            sizes[i] += len(part)
            held += part
            if len(held) >= PART_WORDS:
                flush()
            if words is None:
                break
    flush()
    return np.split(np.concatenate(found), np.cumsum(sizes)[:-1])


def changed(ids: bytes, edits: list[Edit]) -> bytes:
    parts, at = [], 0
    for start, n, new in edits:
        parts += [ids[at : 4 * start], new]
        at = 4 * (start + n)
    return b"".join([*parts, ids[at:]])


class Encoder:
    """Segments texts; remembers the words it segmented and the choices of those it searched."""

    def __init__(self, vocabulary: Vocabulary, n: int):
        self.vocabulary, self.n = vocabulary, n
        self.automaton, self.finder = vocabulary.automaton(), Finder(vocabulary)
        self.forget()

    def forget(self) -> None:
        """At the end of a task: the worker process may go on with other work."""
        self.searched: dict[str, list[Choice]] = {}
        self.place: defaultdict[str, int] = defaultdict()  # numbers of the segmented words, in the order of the arrays
        self.place.default_factory = self.place.__len__
        self.score, self.loss, self.sizes, self.ids = np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.uses = np.zeros(0, np.int64)

    def thin(self) -> None:
        """Keeps half of the segmented words, those that came most often."""
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: KEPT_WORDS // 2])
        names, starts = list(self.place), np.cumsum(self.sizes) - self.sizes
        self.place.clear()
        self.place.update(zip(map(names.__getitem__, kept.tolist()), range(len(kept))))
        self.ids = self.ids[_runs(self.sizes[kept], starts[kept])]
        self.score, self.loss, self.sizes, self.uses = self.score[kept], self.loss[kept], self.sizes[kept], self.uses[kept]

    def learn(self, names: list[str], parts: list[np.ndarray]) -> None:
        """Segments the words that are new and counts all words of the texts."""
        new = names[len(self.score) :]
        if new:
            found = zip((self.score, self.loss, self.sizes, self.ids), self.words(new))
            self.score, self.loss, self.sizes, self.ids = (np.concatenate(pair) for pair in found)
        uses = np.bincount(np.concatenate(parts), minlength=len(names))
        uses[: len(self.uses)] += self.uses
        self.uses = uses

    def choices(self, word: str) -> list[Choice]:
        """The ``n`` best segmentations of a word."""
        found = self.searched.get(word)
        if found is None:
            found = best_of(word, self.vocabulary, self.n, self.automaton)
            if len(word) <= CACHED_CHARS:
                if len(self.searched) >= CACHE_WORDS:
                    self.searched.clear()
                self.searched[word] = found
        return found

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Score, loss and number of pieces of each of the distinct words, and the ids of all, one word after the other."""
        score, loss, sizes = np.zeros(len(words)), np.zeros(len(words)), np.zeros(len(words), np.int64)
        plain, groups, parts = self.vocabulary.characters.issuperset, {}, []
        other = set("".join(words)) - self.vocabulary.characters
        for i, word in enumerate(words):
            if len(word) > CACHED_CHARS or other and not plain(word):
                choices = best_of(word, self.vocabulary, max(self.n, 2), self.automaton)
                score[i], loss[i] = choices[0][0], choices[0][0] - choices[1][0] if len(choices) > 1 else np.inf
                sizes[i] = len(choices[0][1]) // 4
                parts.append(([i], np.frombuffer(choices[0][1], np.int32)))
            else:
                groups.setdefault(len(word) + 3 >> 2, []).append(i)  # words of similar length together
        for group in [g[at : at + GROUP_WORDS] for g in groups.values() for at in range(0, len(g), GROUP_WORDS)]:
            score[group], loss[group], sizes[group], ids = best_paths([words[i] for i in group], self.vocabulary, self.finder)
            parts.append((group, ids))
        starts, all_ids = np.cumsum(sizes) - sizes, np.zeros(sizes.sum(), np.int32)
        for group, ids in parts:
            all_ids[_runs(sizes[group], starts[group])] = ids
        return score, loss, sizes, all_ids

    def edited(self, texts: list[str]) -> list[tuple[Choice, list[Other]]]:
        """The best segmentation of each text, and the next best ones by what they change in it."""
        if not any(texts):
            return [((0.0, b""), []) for _ in texts]
        if len(self.place) > KEPT_WORDS:
            self.thin()
        parts, names = _numbered(texts, self.place), list(self.place)
        self.learn(names, parts)
        score, loss, sizes, ids = self.score, self.loss, self.sizes, self.ids
        starts = np.cumsum(sizes) - sizes
        found = []
        for mine in parts:
            if not len(mine):
                found.append(((0.0, b""), []))
                continue
            counts = sizes[mine]
            best = float(score[mine].sum()), ids[_runs(counts, starts[mine])].tobytes()
            others = []
            if self.n > 1:
                lost = loss[mine]
                few = np.argsort(lost, kind="stable")[: self.n - 1] if self.n > 2 else [lost.argmin()]
                others = self._others(best[0], {int(p): names[mine[p]] for p in few if np.isfinite(lost[p])}, counts)
            found.append((best, others))
        return found

    def _others(self, best: float, few: dict[int, str], counts: np.ndarray) -> list[Other]:
        """The next best segmentations, by other choices of the words at a few places."""
        ends = np.cumsum(counts)
        choices = {p: self.choices(w) for p, w in few.items()}
        losses = {p: [c[0][0] - other[0] for other in c] for p, c in choices.items()}
        return [
            (best - loss, [(int(ends[p] - counts[p]), int(counts[p]), choices[p][i][1]) for p, i in sorted(taken.items())])
            for loss, taken in least_sums(losses, self.n)[1:]
        ]

    def texts(self, texts: list[str]) -> list[list[Choice]]:
        """The ``n`` best segmentations of each text, best first."""
        return [[best, *((score, changed(best[1], edits)) for score, edits in others)] for best, others in self.edited(texts)]

    def text(self, text: str) -> list[Choice]:
        return self.texts([text])[0]


def decoded(ids: list[int], vocabulary: Vocabulary) -> bytes:
    table = vocabulary.bytes
    return b"".join([table[i] for i in ids])[1:]


def same_text(ids: bytes, text: bytes, vocabulary: Vocabulary) -> bool:
    """Whether the ids decode to the text."""
    each = np.frombuffer(ids, np.int32)
    if not len(each):
        return not text
    raw = vocabulary.all_bytes[_runs(vocabulary.byte_lengths[each], vocabulary.byte_starts[each])]
    return raw[1:].tobytes() == text


ENCODERS: dict[str, Encoder] = {}  # of this worker process, so that later tasks need not build their tables again


def _lists(values: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) // 4 for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(values), np.int32)))


def _ends(sizes: list[int]) -> pa.Array:
    return pa.array(np.cumsum([0, *sizes]).astype(np.int32))


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", n: int = N_BEST) -> DataFrame:
    """Id, ``ids`` and ``score`` of the best segmentation, ``n_pieces``, ``others`` (the next best ones) and ``round_trip``.

    Another segmentation is stored as its score and its ``edits`` of the best one: from place ``at`` on, ``n`` ids give way
    to ``ids``. ``whole`` writes it out.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    path = path or default_path()
    shared, name = docs.sparkSession.sparkContext.broadcast(load(path)), f"{path}:{n}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ENCODERS.get(name) or ENCODERS.setdefault(name, Encoder(shared.value, n))
        try:
            yield from encoded(encoder, batches)
        finally:
            encoder.forget()
            release()

    def encoded(encoder: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, TEXT_BYTES):
            texts = texts_of(batch)
            found = encoder.edited([t.decode() for t in texts])
            ids = _lists([best[1] for best, _ in found])
            same = [same_text(best[1], t, encoder.vocabulary) for (best, _), t in zip(found, texts)]
            others = [o for _, more in found for o in more]
            edits = [e for _, own in others for e in own]
            places = [pa.array([e[i] for e in edits], pa.int32()) for i in range(2)]
            edited = pa.StructArray.from_arrays([*places, _lists([e[2] for e in edits])], ["at", "n", "ids"])
            edited = pa.ListArray.from_arrays(_ends([len(own) for _, own in others]), edited)
            structs = pa.StructArray.from_arrays([pa.array([s for s, _ in others], pa.float64()), edited], ["score", "edits"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    ids,
                    pa.array([best[0] for best, _ in found]),
                    pa.array([len(best[1]) // 4 for best, _ in found], pa.int64()),
                    pa.ListArray.from_arrays(_ends([len(more) for _, more in found]), structs),
                    pa.array(same),
                ],
                ["doc_id", "ids", "score", "n_pieces", "others", "round_trip"],
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    others = "array<struct<score: double, edits: array<struct<at: int, n: int, ids: array<int>>>>>"
    return source.mapInArrow(run, f"doc_id {kind}, ids array<int>, score double, n_pieces long, others {others}, round_trip boolean")


def whole(encoded: DataFrame) -> DataFrame:
    """The ``others`` written out: score and ``ids`` of each."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() AS array<int>)").alias("ids"))

    def step(done, edit):
        kept = F.slice("ids", done["at"] + 1, edit["at"] - done["at"])
        return F.struct((edit["at"] + edit["n"]).alias("at"), F.concat(done["ids"], kept, edit["ids"]).alias("ids"))

    def rest(done):
        return F.concat(done["ids"], F.slice("ids", done["at"] + 1, F.size("ids") - done["at"]))

    return encoded.withColumn("others", F.transform("others", lambda o: F.struct(o["score"].alias("score"), F.aggregate(o["edits"], start, step, rest).alias("ids"))))


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Id and ``text`` of each list of ids."""
    source = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    shared = encoded.sparkSession.sparkContext.broadcast(load(path or default_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else decoded(ids, shared.value).decode(errors="replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text string")
