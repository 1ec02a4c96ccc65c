"""Personal data by candidate gradient boosting: generators propose spans, boosted trees choose among them.

Four base kinds (email, ip, card, phone) follow fixed patterns and checks and are always reported. Further generators
propose overlapping spans of other kinds with high recall: secrets, social security numbers, account numbers, phone
numbers without a plus, spelled-out emails, network and hardware addresses, dates of birth. Boosted regression trees
score each proposal by its format (length, digits, letters, separators, distinct characters, checksum) and context
(the words before it, its neighbours). A proposal above its kind's threshold is reported unless it overlaps a base
span or a better proposal.

The trees are trained in each run by Spark's gradient boosting on a bounded sample (``SAMPLE``) of proposals, in which
kinds take turns and within a kind texts do, base spans among them. Their labels are weak: a proposal counts as
personal data if it passes its kind's own check, or stands after a word that announces it. The thresholds are the
scores at which the precision by kind, over all proposals, reaches ``PRECISION``. Trained trees become nested CASE expressions, so
scanning is one expression on the row: no shuffle, no Python.

Patterns are possessive and start at the beginning of a run, which gives the leftmost matches of the plain patterns in
linear time. Offsets are code points. Nulls: a null text is empty. Repeated rows are scanned each. An empty table
gives an empty result; without proposals nothing is added. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotaflow.llm.common import stored

SAMPLE = 20_000
PRECISION = 0.95
TREES, DEPTH = 12, 3
CONTEXT = 24  # characters before a span

# The base kinds, in order, as patterns that start where a run starts or the last match ended.
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}

# The further kinds. Each: pattern, own check on the span, words that announce it.
MORE = {
    "secret": (r"(?<![A-Za-z0-9])[A-Za-z0-9_/+-]{20,128}={0,2}(?![A-Za-z0-9])", r"^(?=.*[0-9])(?=.*[A-Za-z])(?:[0-9a-fA-F]{32,128}|(?:sk|pk|ghp|gho|xox[abp]|AKIA)[-_A-Za-z0-9]{16,})$", "token|key|secret|password|passwd|bearer|auth"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", "ssn|social|security"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"^[A-Z]{2}[0-9]{2}(?: ?[0-9]{4}){3,7}(?: ?[0-9]{1,3})?$", "iban|account|konto|bank"),
    "local_phone": (r"(?<![0-9+(] ?)\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", r"^\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}$", "phone|tel|call|mobile|fax"),
    "spelled_email": (r"(?i)(?<![A-Za-z0-9])[A-Za-z0-9._-]{2,40} ?[(\[] ?at ?[)\]] ?[A-Za-z0-9-]{2,40}(?: ?[(\[] ?dot ?[)\]] ?[A-Za-z]{2,12}){1,3}", r"(?i)dot", "mail|contact|write"),
    "mac": (r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:])", r"[0-9]", "mac|address|hardware"),
    "birth_date": (r"(?<![0-9])(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9](?![0-9])", r"^$", "born|birth|dob|geboren|nacido"),
}
KINDS = [*BASE, *MORE]
FEATURES = ["length", "digits", "letters", "upper", "others", "runs", "announced", "equals", "quoted", "kind_no"]
SURE = ("ssn", "iban", "mac", "spelled_email")  # formats that need no announcing word
SPAN = "struct<kind: string, start: bigint, end: bigint, text: string>"


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """Matches in order with code-point offsets: what lies between the matches gives their places."""
    zero, none = F.lit(0).cast("long"), F.array().cast(f"array<{SPAN}>")

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.length(F.coalesce(part["match"], F.lit("")))
        span = F.struct(F.lit(kind).alias("kind"), start.cast("long").alias("start"), end.cast("long").alias("end"), part["match"].alias("text"))
        return F.struct(end.cast("long").alias("at"), F.when(part["match"].isNull(), state["out"]).otherwise(F.array_append(state["out"], span)).alias("out"))

    gaps, matches = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    return F.aggregate(parts, F.struct(zero.alias("at"), none.alias("out")), step, lambda state: state["out"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The check sum of 16 to 19 digits: from the right, every second digit is doubled, and its digits added."""

    def weighed(d: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: F.ascii(c) - 48)
    total = F.aggregate(F.transform(values, weighed), F.lit(0), lambda a, b: a + b)
    return F.length(digits).between(16, 19) & (total % 10 == 0)


def _passes(kind: str, span: Column) -> Column:
    text = span["text"]
    if kind == "ip":
        value = F.transform(F.split(text, r"\."), lambda part: F.lpad(F.regexp_replace(part, "^0+(?=[0-9])", ""), 3, "0"))
        size = F.transform(F.split(text, r"\."), lambda part: F.length(F.regexp_replace(part, "^0+(?=[0-9])", "")))
        return F.forall(value, lambda v: v <= "255") & F.forall(size, lambda n: n <= 3)
    if kind == "card":
        return F.when(F.length(text) > 40, False).otherwise(_luhn(_digits(text)))
    if kind == "phone":
        return F.length(_digits(text)).between(8, 15)
    return F.lit(True)


def _gate(text: Column, kind: str) -> Column:
    """A cheap test that a text without the kind fails."""
    needs = {"email": "@", "phone": "+", "spelled_email": "at"}
    finds = {"ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){15}"}
    return F.contains(text, F.lit(needs[kind])) if kind in needs else text.rlike(finds[kind])


def _base(text: Column) -> Column:
    """Base spans, by kind and start."""
    empty = F.array().cast(f"array<{SPAN}>")

    def passing(kind: str, pattern: str) -> Column:
        return F.filter(_spans(text, kind, pattern), lambda span: _passes(kind, span))

    return F.concat(*(F.when(_gate(text, k), passing(k, p)).otherwise(empty) for k, p in BASE.items()))


def _more(text: Column) -> Column:
    """Proposed spans of the further kinds."""
    empty = F.array().cast(f"array<{SPAN}>")
    digits, spelled = text.rlike("[0-9]"), text.rlike(r"(?i)[(\[] ?at ?[)\]]")
    gates = {k: spelled if k == "spelled_email" else digits for k in MORE}
    return F.concat(*(F.when(gates[k], _spans(text, k, MORE[k][0])).otherwise(empty) for k in MORE))


def _described(text: Column, span: Column) -> Column:
    """A span with its features and weak label."""
    body = span["text"]
    before = F.lower(F.substring(text, F.greatest(span["start"] - CONTEXT, F.lit(0)).cast("int") + 1, F.least(span["start"], F.lit(CONTEXT)).cast("int")))

    def count(pattern: str) -> Column:
        return F.length(body) - F.length(F.regexp_replace(body, pattern, ""))

    announced, passes, number = F.lit(False), F.lit(True), F.lit(0)
    for no, kind in enumerate(KINDS):
        mine = span["kind"] == kind
        number = F.when(mine, no).otherwise(number)
        if kind in MORE:
            announced = F.when(mine, before.rlike(MORE[kind][2])).otherwise(announced)
            passes = F.when(mine, body.rlike(MORE[kind][1])).otherwise(passes)
    sure = span["kind"].isin(*BASE, *SURE)
    values = {
        "length": F.length(body),
        "digits": count("[0-9]"),
        "letters": count("[A-Za-z]"),
        "upper": count("[A-Z]"),
        "others": count("[^A-Za-z0-9]"),
        "runs": F.size(F.split(body, "(?<=[0-9])(?=[^0-9])|(?<=[^0-9])(?=[0-9])")),
        "announced": announced,
        "equals": before.rlike("[=:]\\s*\"?'?$"),
        "quoted": before.rlike("[\"'`]$"),
        "kind_no": number,
    }
    return F.struct(
        span["kind"].alias("kind"),
        span["start"].alias("start"),
        span["end"].alias("end"),
        *(v.cast("double").alias(k) for k, v in values.items()),
        (passes & (announced | sure)).cast("double").alias("label"),
    )


def proposals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``base`` spans and ``more`` proposed spans with features, of each row; no text. One pass over the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", _base(F.col("text")).alias("base"), _more(F.col("text")).alias("more"))
    described = [F.transform(c, lambda s: _described(F.col("text"), s)).alias(c) for c in ("base", "more")]
    return stored(rows.select("doc_id", F.xxhash64("text").alias("at"), *described), "pii-proposals")


def _tree(node, feature) -> Column:
    """A trained tree as nested CASE expressions."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    less = feature(FEATURES[split.featureIndex()]) <= F.lit(float(split.threshold()))
    return F.when(less, _tree(node.leftChild(), feature)).otherwise(_tree(node.rightChild(), feature))


class Model:
    """Boosted trees and a threshold for each kind they were calibrated on; for other kinds the weak label is the score."""

    def __init__(self, trees: list, weights: list[float]):
        self.trees, self.weights, self.thresholds = trees, weights, {}

    def score(self, feature) -> Column:
        """Probability that a span is personal data; ``feature``: gives the column of a name."""
        if not self.trees:
            return feature("label")
        margin = reduce(lambda a, b: a + b, (F.lit(float(w)) * _tree(t, feature) for t, w in zip(self.trees, self.weights)))
        return 1 / (1 + F.exp(-2 * margin))

    def accepts(self, feature) -> Column:
        found = feature("label") == 1
        for kind, value in self.thresholds.items():
            found = F.when(feature("kind") == kind, self.score(feature) >= F.lit(float(value))).otherwise(found)
        return found


def _spread(spans: DataFrame, sample: int) -> DataFrame:
    """``sample`` spans: kinds take turns, and within a kind texts do, in the order of hashes."""
    order = [F.xxhash64("at", "kind", "start", "end"), "at", "start", "end"]
    turns = spans.withColumn("turn", F.row_number().over(Window.partitionBy("at", "kind").orderBy(*order)))
    ranked = turns.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy("turn", *order)))
    return ranked.where(F.col("place") <= sample).orderBy("place", "kind").limit(sample).drop("turn", "place")


def train(found: DataFrame, sample: int = SAMPLE) -> Model:
    """Trees over a sample of the proposals, spread over kinds and texts; thresholds by kind from all of them."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    spans = found.select("at", F.explode(F.concat("base", "more")).alias("span")).select("at", "span.*")
    spans = stored(spans.distinct(), "pii-spans")
    rows = stored(_spread(spans, sample), "pii-sample")
    classes = rows.select("label").distinct().collect()
    model = Model([], [])
    if len(classes) == 2:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
        fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, stepSize=0.3).fit(vectors)
        model = Model([t._java_obj.rootNode() for t in fitted.trees], list(fitted.treeWeights))
    scored = spans.select("kind", "label", F.round(model.score(F.col), 3).alias("score"))
    above = Window.partitionBy("kind").orderBy(F.desc("score"))
    steps = scored.groupBy("kind", "score").agg(F.count("*").alias("n"), F.sum("label").alias("good"))
    exact = steps.withColumn("precision", F.sum("good").over(above) / F.sum("n").over(above)).where(F.col("precision") >= PRECISION)
    least = {r["kind"]: r["least"] for r in exact.groupBy("kind").agg(F.min("score").alias("least")).collect()}
    model.thresholds = {k: max(0.5, least[k] - 0.0005) for k in MORE if k in least}
    return model


def _chosen(base: Column, more: Column) -> Column:
    """Of the accepted proposals, those that overlap neither a base span nor a better one. One sweep by start."""
    span = "struct<kind: string, start: bigint, end: bigint, score: double, base: boolean>"
    none = F.array().cast(f"array<{span}>")

    def step(state: Column, x: Column) -> Column:
        last = F.element_at(state["kept"], -1)
        meets = (F.size(state["kept"]) > 0) & (last["end"] > x["start"])
        without_last = F.slice(state["kept"], F.lit(1), F.greatest(F.size(state["kept"]) - 1, F.lit(0)))
        kept = (
            F.when(x["base"], F.when(meets, without_last).otherwise(state["kept"]))
            .when(state["base_end"] > x["start"], state["kept"])
            .when(~meets, F.array_append(state["kept"], x))
            .when(x["score"] > last["score"], F.array_append(without_last, x))
            .otherwise(state["kept"])
        )
        return F.struct(kept.alias("kept"), F.when(x["base"], F.greatest(state["base_end"], x["end"])).otherwise(state["base_end"]).alias("base_end"))

    def plain(s: Column, score: Column, is_base: bool) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), score.alias("score"), F.lit(is_base).alias("base"))

    every = F.sort_array(F.concat(F.transform(base, lambda s: plain(s, F.lit(2.0), True)), F.transform(more, lambda s: plain(s, s["score"], False))))
    ordered = F.transform(every, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"), s["base"].alias("base")))
    return F.aggregate(ordered, F.struct(none.alias("kept"), F.lit(0).cast("long").alias("base_end")), step, lambda s: s["kept"])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Id and ``base`` and ``added`` spans (kind, start, end) of each row; base spans by kind and start, others too."""
    found = proposals(docs, id_col, text_col)
    model = train(found, sample)
    accepted = F.filter("more", lambda s: model.accepts(lambda name: s[name]))
    scored = F.transform(accepted, lambda s: s.withField("score", model.score(lambda name: s[name])))
    rows = found.select("doc_id", "base", scored.alias("more"))
    kept = F.when(F.size("more") > 0, _chosen(F.col("base"), F.col("more"))).otherwise(F.array().cast("array<struct<kind: string, start: bigint, end: bigint, score: double, base: boolean>>"))
    rows = rows.select("doc_id", "base", kept.alias("kept"))
    return rows.select("doc_id", "base", F.concat(*(_of_kind("kept", k) for k in MORE)).alias("added"))


def _of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda span: span["kind"] == kind)


def _written(spans: str) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))


def digest(found: DataFrame) -> DataFrame:
    """Counts, checksum and text form of the spans that ``detect`` finds."""
    counts = [F.size(_of_kind("base", k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.array_join(_written("base"), ",")
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.array_join(F.concat(_written("base"), _written("added")), ",").alias("spans"))
