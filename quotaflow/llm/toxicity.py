"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer reads words and writes classes: insult, threat, target, negation, report, other. Three small
transducers over classes follow: negation turns an insult or threat that closely follows a negation into a denied
one, reported speech turns those after a reporting word into quoted ones, and targeting weighs what is left, more
where a target stands in the clause. The three are composed into one machine, which runs over each clause that holds
an insult or threat; its weight is the clause's score. Isolated words outside such a clause weigh nothing.

Besides the fixed word lists, the lexicon holds learned stems: word beginnings that labelled toxic texts use in many
different contexts and clean ones hardly ever. Counting contexts (the word before) instead of documents keeps copies
of one toxic text from making insults of all its words. All labelled texts outside the held-out fold are counted, both
classes alike and without an estimate: a batch sends its distinct contexts as nine bytes (hashes of 40 bits for the word and
32 for the context in it: of ten million words some dozens fall together, of a million contexts of one word some hundred),
dealt by the context, so that no word's contexts come together in one task; a part unites them and counts them by word, and
words are summed to stems.

A learned stem has ``LEAST_CONTEXTS`` toxic contexts, without which nothing is known of it, and ``LEAST_PART`` of all of
them. The second is a share, the same for a table of any size: it leaves out stems rarer than one in 100,000 toxic contexts,
and so bounds the stems that are sent to the tasks (ten lengths of stem, each with 100,000 at most). Up to 800,000 toxic
contexts the first is the stricter one, so a stem that a smaller table teaches is not lost on a larger one of its kind.
Clause scores become a probability by a logistic regression, fitted on the ``SAMPLE`` labelled ids with the smallest
hashes.

Nulls: a null text is empty and gets the score of a text without a match; null labels and ids without a label are not
learned from; a null id counts as empty text for the fold. Repeated rows are scored each; of several labels of one id
the larger counts. Without labels of both kinds the fixed lists and weights alone decide. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaflow.llm.common import with_maybe, part_of, pieces_of, stored, texts_of

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
SAMPLE = 100_000  # labelled ids that the regression is learned from
LEAST_STEM, LONGEST_STEM = 3, 12  # characters
LEAST_PART = 1e-5  # of all contexts of toxic texts: least part of a learned stem
LEAST_CONTEXTS = 8
LEAST_RATIO = 15.0  # how much more frequent a learned stem is in toxic texts
TEXT_BYTES = 4 << 20
PART_BYTES = 16 << 20  # of text whose contexts a part unites
CACHE_WORDS = 400_000

# Word lists of the grammar.
INSULTS = """idiot moron imbecile stupid dumb scum trash garbage worthless pathetic disgusting loser clown fool jerk
bastard vermin filth pig rat coward creep freak cretin dimwit halfwit degenerate lowlife maggot parasite subhuman
dummkopf trottel abschaum drecksau connard salaud ordure imbecile idiota imbecil basura escoria""".split()
THREATS = "kill murder hurt destroy crush beat stab shoot strangle slaughter burn hang töten tuer matar".split()
TARGETS = "you your yours u he she him her they them their these those people du ihr dich toi vous tu usted ustedes ellos".split()
NEGATIONS = "not no never nobody neither nor isnt arent wasnt werent dont doesnt didnt nicht kein keine pas jamais nunca".split()
REPORTS = "said says say wrote writes claimed claims quoted quote reported reports according called sagte schrieb dit dijo".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, DENIED, QUOTED = range(8)
LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 10 if chr(b) in ".!?;:\n|" else 0 if chr(b) == "'" else 32 for b in range(256))


class Transducer:
    """Deterministic: (state, symbol) -> (state, symbol, weight). Missing arcs keep the state and copy the symbol."""

    def __init__(self, arcs: dict[tuple, tuple], start=0):
        self.arcs, self.start = arcs, start

    def step(self, state, symbol: int) -> tuple:
        return self.arcs.get((state, symbol), (state, symbol, 0.0))

    def then(self, other: Transducer) -> Transducer:
        """The composition: the other machine reads what this one writes, weights add up."""
        start, arcs = (self.start, other.start), {}
        todo, seen = [start], {start}
        while todo:
            mine, theirs = state = todo.pop()
            for symbol in range(8):
                next_mine, middle, w = self.step(mine, symbol)
                next_theirs, out, v = other.step(theirs, middle)
                target = (next_mine, next_theirs)
                arcs[state, symbol] = (target, out, w + v)
                if target not in seen:
                    seen.add(target)
                    todo.append(target)
        return Transducer(arcs, start)


def _negation(reach: int = 3) -> Transducer:
    """State: how many further words the last negation still reaches."""
    arcs = {}
    for left in range(reach + 1):
        for symbol in range(8):
            out = DENIED if left and symbol in (INSULT, THREAT) else symbol
            arcs[left, symbol] = (reach if symbol == NEGATION else max(0, left - 1), out, 0.0)
    return Transducer(arcs)


def _report() -> Transducer:
    """State 1: a reporting word stood before in this clause."""
    arcs = {(s, REPORT): (1, OTHER, 0.0) for s in (0, 1)}
    return Transducer(arcs | {(1, INSULT): (1, QUOTED, 0.0), (1, THREAT): (1, QUOTED, 0.0)})


def _targeted() -> Transducer:
    """States: nothing yet, target seen, insult seen, threat seen, insult or threat with its target."""
    arcs = {}
    for state in range(5):
        arcs[state, TARGET] = ({0: 1, 1: 1, 2: 4, 3: 4, 4: 4}[state], OTHER, {2: 0.5, 3: 1.5}.get(state, 0.0))
        arcs[state, INSULT] = (4 if state in (1, 4) else 2, OTHER, 1.5 if state in (1, 4) else 1.0)
        arcs[state, THREAT] = (4 if state in (1, 4) else 3, OTHER, 1.5 if state in (1, 4) else 0.25)
        arcs[state, DENIED] = (state, OTHER, 0.2)
        arcs[state, QUOTED] = (state, OTHER, 0.4)
    return Transducer(arcs)


GRAMMAR = _negation().then(_report()).then(_targeted())


def plain(text: bytes) -> bytes:
    """Lower-case letters; clauses end with line feeds, blanks stand between words."""
    return text.decode().lower().encode().translate(LETTERS, b"'")


def stems_of(word: str) -> list[str]:
    """Beginnings of a word, and the whole word, marked by a blank."""
    return [word[:n] for n in range(LEAST_STEM, min(LONGEST_STEM, len(word) - 1) + 1)] + [word + " "]


class Lexicon:
    """Classes of words: fixed lists by whole word, learned stems (with weights) by beginning."""

    def __init__(self, stems: dict[str, float]):
        self.stems, self.cache = stems, {}
        lists = ((INSULTS, INSULT), (THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT))
        self.fixed = {w.encode(): (c, 1.0) for words, c in lists for w in words}

    def __getstate__(self):
        return self.stems

    def __setstate__(self, stems):
        self.__init__(stems)

    def read(self, word: bytes) -> tuple[int, float]:
        """Class and weight of a word."""
        found = self.cache.get(word)
        if found is None:
            weight = max((self.stems.get(s, 0.0) for s in stems_of(word.decode())), default=0.0) if self.stems else 0.0
            found = self.fixed.get(word, (OTHER, 1.0))
            if weight and found[0] in (OTHER, INSULT):
                found = (INSULT, max(weight, 1.0 if found[0] == INSULT else 0.0))
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[word] = found
        return found

    def features(self, text: bytes) -> list[float]:
        """Sum of clause weights, matched clauses, largest clause weight, matched words, and matches for each hundred words."""
        clean = plain(text)
        words, read = clean.split(), self.read
        hits = {w for w in set(words) if read(w)[0] in (INSULT, THREAT)}
        if not hits:
            return [0.0, 0.0, 0.0, 0.0, 0.0]
        scores, matches = [], 0
        for clause in clean.split(b"\n"):
            tokens = clause.split()
            if hits.isdisjoint(tokens):
                continue
            state, score = GRAMMAR.start, 0.0
            for token in tokens:
                symbol, weight = read(token)
                state, _, gain = GRAMMAR.step(state, symbol)
                score += gain * weight
                matches += symbol in (INSULT, THREAT)
            scores.append(score)
        return [sum(scores), float(len(scores)), max(scores), float(matches), 100.0 * matches / len(words)]


MIX = np.uint64(0x9E3779B97F4A7C15)
NAMES = -1  # in place of a class: rows with the names of words


def _pairs(texts: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words (the first is empty), and the numbers of word and word before in the distinct contexts."""
    place: dict[str, int] = {"": 0}
    keys = [np.zeros(0, np.int64)]
    for words in texts:
        for word in dict.fromkeys(words):
            place.setdefault(word, len(place))
        numbers = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        keys.append(np.unique(numbers << 32 | np.r_[0, numbers[:-1]][: len(numbers)]))
    keys = np.unique(np.concatenate(keys))
    return list(place), keys >> 32, keys & 0xFFFFFFFF


WORD_BYTES, CONTEXT_BYTES = 5, 4


def _bytes(values: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of each number."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _numbers(raw: bytes, size: int) -> np.ndarray:
    found = np.zeros((len(raw) // size, 8), np.uint8)
    found[:, :size] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return found.view("<u8").ravel()


def _dealt(parts: int) -> Callable:
    """Distinct contexts of each batch, packed by (part, class), and the names of the task's words in a part of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[str] = set()
        for batch in pieces_of(batches, TEXT_BYTES):
            rows = []
            toxic = batch.column(1).to_pylist()
            split = [plain(t).decode().split() for t in texts_of(batch)]
            for kind in (0, 1):
                names, word, before = _pairs([w for w, k in zip(split, toxic) if k == kind])
                hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
                context = (hashes[word] * MIX ^ hashes[before]) * MIX
                words, part = hashes >> np.uint64(64 - 8 * WORD_BYTES), (context >> np.uint64(8 * CONTEXT_BYTES)) % np.uint64(parts)
                order = np.lexsort((words[word], part))
                cuts = np.searchsorted(part[order], np.unique(part)).tolist() + [len(part)]
                for low, high in pairwise(cuts):
                    mine = order[low:high]
                    rows.append((int(part[mine[0]]), kind, _bytes(words[word[mine]], WORD_BYTES), _bytes(context[mine], CONTEXT_BYTES), None))
                new = np.array([i for i, name in enumerate(names) if name and name not in sent], np.int64)
                home, fresh = words[new] % np.uint64(parts), np.array(names, object)[new]
                for at in np.unique(home):
                    rows.append((int(at), NAMES, _bytes(words[new][home == at], WORD_BYTES), b"", fresh[home == at].tolist()))
                sent.update(fresh)
                if len(sent) > CACHE_WORDS:
                    sent.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(DEALT), DEALT)], schema=DEALT)

    return run


DEALT = pa.schema([("part", pa.int32()), ("toxic", pa.int32()), ("words", pa.binary()), ("contexts", pa.binary()), ("names", pa.list_(pa.string()))])


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, name, t, c): distinct contexts of each word in a part, or its name, from rows sorted by part and class."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
    for (_, kind), mine in groupby(rows, key=lambda r: r[:2]):
        words, contexts, names = zip(*((r[2], r[3], r[4] or []) for r in mine))
        words, contexts = _numbers(b"".join(words), WORD_BYTES), _numbers(b"".join(contexts), CONTEXT_BYTES)
        if kind == NAMES:
            words, at = np.unique(words, return_index=True)
            names, n = np.array([name for part in names for name in part], object)[at].tolist(), np.zeros(len(words), np.int64)
        else:
            order = np.lexsort((contexts, words))
            words, contexts = words[order], contexts[order]
            new = np.r_[True, (words[1:] != words[:-1]) | (contexts[1:] != contexts[:-1])]
            words, n = np.unique(words[new], return_counts=True)
            names = [None] * len(words)
        none = np.zeros(len(words), np.int64)
        columns = [pa.array(words.astype(np.int64)), pa.array(names, pa.string()), pa.array(n if kind == 1 else none), pa.array(n if kind == 0 else none)]
        yield pa.RecordBatch.from_arrays(columns, ["word", "name", "t", "c"])


def word_contexts(labelled: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``word``, and ``t`` and ``c``, its distinct contexts in the toxic and in the clean texts (``text``, ``toxic``)."""
    size = labelled.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + size // part_bytes
    dealt = labelled.select("text", "toxic").mapInArrow(_dealt(parts), "part int, toxic int, words binary, contexts binary, names array<string>")
    united = dealt.repartition(parts, "part").sortWithinPartitions("part", "toxic").mapInArrow(_united, "word long, name string, t long, c long")
    return united.groupBy("word").agg(F.max("name").alias("name"), F.sum("t").alias("t"), F.sum("c").alias("c")).select(F.col("name").alias("word"), "t", "c")


def _by_stem(words: DataFrame) -> DataFrame:
    begin = F.expr(f"transform(sequence({LEAST_STEM}, {LONGEST_STEM}), n -> if(n < length(word), substr(word, 1, n), null))")
    return words.withColumn("stem", F.explode(F.array_append(F.filter(begin, lambda s: s.isNotNull()), F.concat("word", F.lit(" ")))))


def contexts(labelled: DataFrame, least_part: float = LEAST_PART) -> tuple[DataFrame, int, int]:
    """``stem``, ``t`` and ``c`` of the stems with enough toxic contexts, and the numbers of all toxic and clean contexts."""
    words = stored(word_contexts(labelled), "toxic-words")
    toxic, clean = words.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0))).first()
    counts = _by_stem(words.where("t > 0")).groupBy("stem").agg(F.sum("t").alias("t"))
    frequent = stored(counts.where(F.col("t") >= max(LEAST_CONTEXTS, least_part * toxic)), "toxic-stems")
    # each frequent stem has that part of the contexts, on ten levels: a million stems at most
    seen = _by_stem(words.where("c > 0")).join(F.broadcast(frequent.select("stem")), "stem").groupBy("stem").agg(F.sum("c").alias("c"))
    return frequent.join(seen, "stem", "left").fillna(0, ["c"]), toxic, clean


def learn_stems(labelled: DataFrame) -> dict[str, float]:
    """Stems of the ``labelled`` texts (``text``, ``toxic``) with weights between 0 and 2."""
    found, toxic, clean = contexts(labelled)
    if not toxic or not clean:
        return {}
    ratio = (F.col("t") / toxic) / ((F.col("c") + 0.5) / clean)
    strong = found.withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO).select("stem", "ratio")
    return {r["stem"]: min(2.0, float(np.log10(r["ratio"]))) for r in strong.collect()}


def _scaled(features: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(features)), np.log1p(features)])


DEFAULT = np.array([-3.0, 2.0, 1.0, 1.0, 1.0, 0.0])  # weights before any label is seen


def fit(features: np.ndarray, labels: np.ndarray, counts: np.ndarray, rounds: int = 30, prior: float = 1.0) -> np.ndarray:
    """Logistic regression of rows that occur ``counts`` times, by Newton steps with a quadratic prior."""
    x, w = _scaled(features), np.zeros(features.shape[1] + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = x.T @ (x * (counts * p * (1 - p))[:, None]) + prior * np.eye(len(w))
        step = np.linalg.solve(curve, x.T @ (counts * (labels - p)) - prior * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


FEATURES = ["weight", "clauses", "largest", "matches", "density"]


def _featured(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for batch in pieces_of(batches, TEXT_BYTES):
            rows = np.array([lexicon.features(t) for t in texts_of(batch)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, i]) for i in range(len(FEATURES)))], ["key", *FEATURES])

    return run


def features(texts: DataFrame, lexicon: Lexicon, key: str) -> DataFrame:
    """``key`` and the clause features of each ``text``."""
    shared = texts.sparkSession.sparkContext.broadcast(lexicon)
    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "text").mapInArrow(_featured(shared), f"key {kind}, " + ", ".join(f"{f} double" for f in FEATURES))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and regression weights from the labelled rows outside the held-out fold."""
    fold = part_of("doc_id", FOLDS) != HELD_OUT
    ids = F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id")  # one type, one hash
    marked = labels.select(ids, "toxic").where("toxic in (0, 1)").where(fold).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(fold)
    order = F.xxhash64(F.col("doc_id").cast("string"))
    last = marked.select(order.alias("at")).orderBy("at").limit(sample).agg(F.max("at")).first()[0]
    sampled = (order <= F.lit(last).cast("long")).alias("sampled")
    # stems are learned from all labelled texts, the regression from the sample; a bit map keeps most other texts from moving;
    # labels grow with the documents, so small ones are not broadcast either
    marked = stored(marked, "toxic-marked").hint("merge")
    labelled = stored(with_maybe(texts, "doc_id", marked, "maybe").where("maybe").join(marked, "doc_id").select("text", "toxic", sampled), "toxic-labelled")
    lexicon = Lexicon(learn_stems(labelled))
    found = features(labelled.where("sampled").withColumn("key", F.col("toxic").cast("double")), lexicon, "key")
    counts = found.groupBy("key", *FEATURES).count().toPandas()  # copies of a text are one row
    x, y, n = counts[FEATURES].to_numpy(float), counts["key"].to_numpy(float), counts["count"].to_numpy(float)
    return lexicon, fit(x, y, n) if len(set(y)) == 2 else DEFAULT


def score(docs: DataFrame, model: tuple[Lexicon, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``held_out``, ``score``, ``predicted`` and the clause features of each row."""
    lexicon, weights = model
    held = part_of(id_col, FOLDS) == HELD_OUT
    source = docs.select(F.struct(F.col(id_col).alias("doc_id"), held.alias("held_out")).alias("key"), F.col(text_col).alias("text"))
    logit = F.lit(float(weights[0]))
    for name, weight in zip(FEATURES, weights[1:]):
        logit = logit + F.lit(float(weight)) * F.log1p(name)
    found = features(source, lexicon, "key").withColumn("score", 1 / (1 + F.exp(-logit)))
    return found.select("key.doc_id", "key.held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *FEATURES)
