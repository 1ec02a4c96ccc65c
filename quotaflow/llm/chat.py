"""Chat formatting over reply trees: root-to-leaf paths by iterative self-joins, ranked by score, formatted whole.

A message answers its parent; a tree's messages without a known parent are roots. Self-joins double the distance that a
message looks back (its parent, then 2, 4, 8 ... messages), adding up length and score of the way, so a tree of depth d
takes log2(d) rounds over narrow rows. Each message that nobody answers ends a branch; the branches of a tree are ranked
by their mean score, then by the id of the last message. Only the chosen ones are then enumerated, by the same distances
from the largest down: each round doubles what is known of a path, and no row is made twice.

The template is ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line feed. Inside roles and texts a
``<`` and ``|`` with any number of backslashes between them get one more, so that no marker can stand there; roles also
have line feeds and per cent signs written as ``%0A`` and ``%25``. Both are undone when reading back. The loss mask names
the spans of assistant texts in code points of the formatted conversation.

All steps are DataFrame functions. A formatted conversation is one value and has to fit one (2 GB). Nulls: null texts,
roles and scores are empty (0); a null tree id is a tree of its own. Of several rows with one tree and id the least
(parent, role, text, score) counts; ids are never null. Messages that follow each other in a circle have no root and
are in no path. Turns (``chains``): rows with the same turn are ordered by role and text, nulls first; repeated rows are
turns of their own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotaflow.llm.common import stored

START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"
KEEP = 1


def escaped(text: Column) -> Column:
    return F.when(text.contains("<"), F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")).otherwise(text)


def unescaped(text: Column) -> Column:
    return F.when(text.contains("<\\"), F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")).otherwise(text)


def escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _tree(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("1"), F.col(column).cast("string")), F.lit("0"))


def messages(df: DataFrame, tree: str, message: str, parent: str, role: str = "role", text: str = "text", score: Column | None = None) -> DataFrame:
    """Messages as ``tree`` (a key that is never null), ``tree_id``, ``id``, ``parent``, ``role``, ``text``, ``score``; one row for each id."""
    worth = F.coalesce((F.lit(0) if score is None else score).cast("double"), F.lit(0.0))
    empty = [F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    rows = df.select(_tree(tree).alias("tree"), F.col(tree).alias("tree_id"), F.col(message).alias("id"), F.col(parent).alias("parent"), *empty, worth.alias("score"))
    least = rows.groupBy("tree", "id").agg(F.min(F.struct("tree_id", "parent", "role", "text", "score")).alias("m"))
    return least.select("tree", "id", "m.*")


def chains(df: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages of plain conversations: each row answers the row before it."""
    rows = df.select(_tree(tree).alias("tree"), F.col(tree).alias("tree_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    place = F.row_number().over(Window.partitionBy("tree").orderBy(*order)).cast("long")
    empty = {c: F.coalesce(F.col(c), F.lit("")) for c in ("role", "text")}
    return rows.withColumn("id", place).withColumns({"parent": F.col("id") - 1, "score": F.lit(0.0), **empty}).drop("turn")


def _lookbacks(edges: DataFrame) -> list[DataFrame]:
    """Tables of (tree, id, up, length, total): the message 1, 2, 4, 8 ... before each one, null beyond the root.

    ``length`` and ``total`` are the number and the score of the messages from ``id`` to before ``up``. A circle is as
    long as the table at most, so more rounds than its binary digits cannot add a root.
    """
    known = edges.select("tree", F.col("id").alias("up")).withColumn("there", F.lit(True))
    first = edges.withColumnRenamed("parent", "up").join(known, ["tree", "up"], "left")
    up = F.when(F.col("there"), F.col("up"))
    found = [stored(first.select("tree", "id", up.alias("up"), F.lit(1).cast("long").alias("length"), F.col("score").alias("total")), "chat-up")]
    rounds = found[0].count().bit_length()
    while rounds and not found[-1].where("up IS NOT NULL").isEmpty():
        last, rounds = found[-1], rounds - 1
        further = last.select("tree", F.col("id").alias("up"), F.col("up").alias("far"), F.col("length").alias("more"), F.col("total").alias("extra"))
        ended, open_ = last.where("up IS NULL"), last.where("up IS NOT NULL").join(further, ["tree", "up"])
        open_ = open_.select("tree", "id", F.col("far").alias("up"), (F.col("length") + F.col("more")).alias("length"), (F.col("total") + F.col("extra")).alias("total"))
        found.append(stored(ended.unionByName(open_), "chat-up"))
    return found


def branches(rows: DataFrame, keep: int = KEEP) -> DataFrame:
    """The messages of the ``keep`` best branches of each tree: ``tree``, ``leaf``, ``rank``, ``branch_score``, ``id``, ``depth``."""
    ups = _lookbacks(rows.select("tree", "id", "parent", "score"))
    whole = ups[-1].where("up IS NULL")  # messages that a root leads to
    answered = ups[0].where("up IS NOT NULL").select("tree", F.col("up").alias("id")).distinct()
    leaves = whole.join(answered, ["tree", "id"], "left_anti").withColumn("branch_score", F.col("total") / F.col("length"))
    order = Window.partitionBy("tree").orderBy(F.desc("branch_score"), "id")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    paths = stored(chosen.select("tree", F.col("id").alias("leaf"), "rank", "branch_score", "id", F.col("length").alias("depth")), "chat-paths")
    for power in reversed(range(len(ups) - 1)):
        up = ups[power].where("up IS NOT NULL").select("tree", "id", "up")
        before = paths.join(up, ["tree", "id"]).withColumns({"id": F.col("up"), "depth": F.col("depth") - (1 << power)}).drop("up")
        paths = stored(paths.unionByName(before), "chat-paths")
    return paths


def formatted(rows: DataFrame, keep: int = KEEP) -> DataFrame:
    """One conversation for each chosen branch: ``tree``, ``tree_id``, ``rank``, ``branch_score``, ``formatted``, ``turn_starts``, ``loss_spans``."""
    rows = stored(rows, "chat-messages")
    header = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    turns = branches(rows, keep).join(rows.drop("score", "parent"), ["tree", "id"]).withColumns({"header": header, "body": escaped(F.col("text"))})
    size = F.char_length("header") + F.char_length("body") + len(END)
    path = Window.partitionBy("tree", "leaf").orderBy("depth")
    before = F.sum(size).over(path.rowsBetween(Window.unboundedPreceding, -1))
    turns = turns.withColumn("start", F.coalesce(before, F.lit(0)).cast("long"))
    begin = F.col("start") + F.char_length("header")
    span = F.when(F.col("role") == TRAINED, F.struct((F.col("depth") - 1).cast("int").alias("turn"), begin.alias("start"), (begin + F.char_length("body")).alias("end")))
    turn = F.struct("depth", "start", F.concat("header", "body", F.lit(END)).alias("text"), span.alias("loss"))
    whole = turns.groupBy("tree", "leaf").agg(
        F.first("tree_id").alias("tree_id"),
        F.first("rank").alias("rank"),
        F.first("branch_score").alias("branch_score"),
        F.array_sort(F.collect_list(turn)).alias("turns"),
    )
    return whole.select(
        "tree", "tree_id", "rank", "branch_score",
        F.array_join("turns.text", "").alias("formatted"),
        F.col("turns.start").alias("turn_starts"),
        F.filter("turns.loss", lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(conversations: DataFrame) -> DataFrame:
    """Turns and trained text as the formatted conversations tell them: adds ``turns`` and ``loss_text``."""
    parts = F.split("formatted", r"<\|im_end\|>\n")
    cut = conversations.withColumn("parts", F.slice(parts, F.lit(1), F.size(parts) - 1))

    def turn(part: Column) -> Column:
        line = F.instr(part, "\n")
        role = F.substring(part, len(START) + 1, line - len(START) - 1)
        return F.struct(unescaped_role(role).alias("role"), unescaped(F.substring(part, line + 1, F.char_length(part))).alias("text"))

    def trained(span: Column) -> Column:
        start = span["start"] - F.get("turn_starts", span["turn"])
        return unescaped(F.substring(F.get("parts", span["turn"]), (start + 1).cast("int"), (span["end"] - span["start"]).cast("int")))

    loss = F.array_join(F.transform("loss_spans", trained), "")
    return cut.withColumns({"turns": F.transform("parts", turn), "loss_text": loss}).drop("parts")


def digest(conversations: DataFrame) -> DataFrame:
    """Counts and hashes of what ``read_back`` finds."""
    found = read_back(conversations)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
