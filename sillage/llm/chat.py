r"""Chat formatting of reply trees, in DataFrame functions only (operator 12).

Messages answer messages. Self-joins double the reach of every message's pointer to what it answers, so that after
as many rounds as the logarithm of the longest path each message knows the length and the score of its path from
the root. Messages without an answer end a branch; branches are ranked by their mean score, and the paths of the
chosen ones are enumerated from the same pointers, again by self-joins. Each path becomes one text.

Template: ``### role: text</turn>\n`` for every turn. Inside roles and texts a backslash goes before each backslash,
before a number sign that would be the third in a row, before a slash behind ``<``, and in roles before a space behind
a colon; so none of the control strings ``###``, ``</turn>`` can stand in a text, and taking the character behind each
backslash gives the text back. The loss mask lists the places of the texts of one role.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sillage.llm.dealing import numbered
from sillage.session import stage

START, COLON, END = "### ", ": ", "</turn>\n"
LOSS_ROLE = "assistant"
#: turns of a path that are put together in one step; the steps' results are then put together
CHUNK = 128
_ESCAPE, _ESCAPE_ROLE = r"(\\|(?<=##)#|(?<=<)/)", r"(\\|(?<=##)#|(?<=<)/|(?<=:)\x20)"
_SPANS = "array<struct<start:bigint,end:bigint>>"


def escape(text: Column, role: bool = False) -> Column:
    return F.regexp_replace(text, _ESCAPE_ROLE if role else _ESCAPE, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?s:(.))", "$1")


def digest(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)


def linear(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations as reply trees in which each turn answers the one before: tree, id, parent, role, text, score.

    Turns are ordered by ``turn``, null first; turns that tie, by a digest of role and text. A null role or text is
    empty; rows without conversation are one conversation. Other columns are not read.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(F.col(conv_col).alias("tree"), F.col(turn_col).alias("_turn"), role.alias("role"), text.alias("text"))
    order = [F.col("_turn").asc_nulls_first(), F.col("_digest").asc()]
    placed = numbered(rows.withColumn("_digest", digest(F.col("role"), F.col("text"))), "tree", order, "turns")
    parent = F.when(F.col("_at") > 0, F.col("_at") - 1)
    return placed.select("tree", F.col("_at").alias("id"), parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _pointers(messages: DataFrame) -> list[DataFrame]:
    """Staged rounds k = 0, 1, ...: for every message what lies 2^k answers up (``up``), how many messages its path holds
    below that (``hops``), and their score. In the last round nothing is above; what answers itself in a circle is gone."""
    m = messages.select("tree", "id", F.col("parent").alias("up"), F.lit(1).cast("long").alias("hops"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"))
    known = messages.select(F.col("tree").alias("_tree"), F.col("id").alias("_id"))
    held = m.join(known, m["tree"].eqNullSafe(known["_tree"]) & (m["up"] == known["_id"]), "left")
    rounds = [stage(held.select("tree", "id", F.col("_id").alias("up"), "hops", "total"), "pointers")]
    bound = max(1, rounds[0].count()).bit_length() + 1
    while not rounds[-1].where("up IS NOT NULL").isEmpty():
        now = rounds[-1]
        if len(rounds) > bound:
            rounds.append(now.where("up IS NULL"))
            break
        above = now.select(*(F.col(c).alias(f"_{c}") for c in now.columns))
        longer = now.where("up IS NOT NULL").join(above, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("up") == F.col("_id")))
        longer = longer.select("tree", "id", F.col("_up").alias("up"), F.col("hops") + F.col("_hops"), F.col("total") + F.col("_total"))
        rounds.append(stage(now.where("up IS NULL").union(longer), "pointers"))
    return rounds


def paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """Messages of the chosen root-to-leaf paths: tree, branch (rank from 1), leaf, ``at`` (0 is the root), id, n (length).

    The ``branches`` best of a tree are chosen (None: all) by mean score, equal ones by the smaller leaf; a null score
    is 0. A message whose parent is not in its tree is a root. Ids must differ within a tree and not be null.
    Messages that answer themselves in a circle, and what hangs on them, have no root and are on no path.
    """
    rounds = _pointers(messages)
    parents = rounds[0].where("up IS NOT NULL").select(F.col("tree").alias("_tree"), F.col("up").alias("_id")).distinct()
    leaves = rounds[-1].join(parents, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("id") == F.col("_id")), "left_anti")
    best = Window.partitionBy("tree").orderBy((F.col("total") / F.col("hops")).desc(), F.col("id"))
    chosen = leaves.withColumn("branch", F.row_number().over(best))
    if branches is not None:
        chosen = chosen.where(F.col("branch") <= branches)
    found = chosen.select("tree", "branch", F.col("id").alias("leaf"), F.col("hops").alias("n"), "id", F.lit(0).cast("long").alias("_up"))
    for k in reversed(range(len(rounds) - 1)):
        found = stage(found, "paths")
        step = rounds[k].where("up IS NOT NULL").select(F.col("tree").alias("_tree"), F.col("id").alias("_id"), "up")
        above = found.join(step, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("id") == F.col("_id")))
        found = found.union(above.select("tree", "branch", "leaf", "n", F.col("up").alias("id"), F.col("_up") + (1 << k)))
    return found.select("tree", "branch", "leaf", (F.col("n") - 1 - F.col("_up")).alias("at"), "id", "n")


def _places(sizes: Column) -> Column:
    """Sums of the first 0, 1, ... sizes."""
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("out"))
    add = lambda acc, n: F.struct((acc["sum"] + n).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))
    return F.aggregate(sizes, zero, add, lambda acc: acc["out"])


def _shifted(spans: Column, by: Column) -> Column:
    return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end")))


def conversations(messages: DataFrame, branches: int | None = 1, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row per chosen path of ``messages`` (tree, id, parent, role, text, score): tree, branch, leaf, ``formatted`` and
    ``loss``, the places (start, end in code points) of the texts of ``loss_role`` in it.

    Null and empty roles and texts are formatted as empty. What ``paths`` says of odd trees holds here.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    head = F.concat(F.lit(START), escape(role, role=True), F.lit(COLON))
    turns = messages.select(F.col("tree").alias("_tree"), F.col("id").alias("_id"), head.alias("_head"), escape(text).alias("_text"), (role == loss_role).alias("_loss"))
    on = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("id") == F.col("_id"))
    whole = F.concat("_head", "_text", F.lit(END))
    start, end = F.length("_head").cast("long"), (F.length("_head") + F.length("_text")).cast("long")
    pieces = paths(messages, branches).join(turns, on).select(
        "tree", "branch", "leaf", F.floor(F.col("at") / CHUNK).alias("chunk"),
        F.struct("at", whole.alias("piece"), F.when(F.col("_loss"), F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.array()).cast(_SPANS).alias("spans")).alias("p"),
    )
    path = ["tree", "branch", "leaf"]
    found = pieces.groupBy(*path, "chunk").agg(F.array_sort(F.collect_list("p")).alias("parts")).transform(_joined)
    found = found.groupBy(*path).agg(F.array_sort(F.collect_list(F.struct(F.col("chunk").alias("at"), "piece", "spans"))).alias("parts")).transform(_joined)
    return found.select(*path, F.col("piece").alias("formatted"), F.col("spans").alias("loss"))


def _joined(found: DataFrame) -> DataFrame:
    """``parts`` put together: piece, and spans at their places in it."""
    begins = _places(F.transform("parts", lambda p: F.length(p["piece"]).cast("long")))
    spans = F.zip_with("parts", begins, lambda p, at: _shifted(p["spans"], at))
    return found.withColumns({"piece": F.array_join(F.transform("parts", lambda p: p["piece"]), ""), "spans": F.flatten(spans)}).drop("parts")


def turns_of(formatted: Column) -> Column:
    """Role and text of every turn of a formatted conversation."""
    pieces = F.split(formatted, END, -1)

    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(START) + 1), F.length(piece))
        colon = F.instr(body, COLON)
        return F.struct(unescape(F.substring(body, F.lit(1), colon - 1)).alias("role"), unescape(F.substring(body, colon + len(COLON), F.length(body))).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def masked(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under a loss mask. Text is cut in two steps, as finding a place takes as long as the text before it."""
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(loss)))).cast("int")
    groups = F.transform(F.sequence(F.lit(1), F.size(loss), step), lambda i: F.slice(loss, i, step))
    cut = F.transform(
        groups,
        lambda g: F.struct(
            F.substring(formatted, (g[0]["start"] + 1).cast("int"), (F.element_at(g, -1)["end"] - g[0]["start"]).cast("int")).alias("text"),
            _shifted(g, -g[0]["start"]).alias("spans"),
        ),
    )
    texts = F.transform(cut, lambda c: F.transform(c["spans"], lambda s: unescape(F.substring(c["text"], (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))))
    return F.when(F.size(loss) > 0, F.flatten(texts)).otherwise(F.array().cast("array<string>"))
