"""Operator 7: reply trees to formatted conversations, in DataFrame functions alone.

Messages form trees: every message names its parent. Iterative self-joins double the
reach of each message's pointer to an ancestor (parent, grandparent, 4th, 8th, ...), so
trees of any depth take logarithmically many joins, and carry depth and summed
score along. Leaves are ranked by the mean score of their root-to-leaf path; a chosen
leaf's path is listed by walking the pointers from far to near, where each ancestor
turns up once. Each path becomes one conversation under a template that marks turns,
escapes control strings in texts and gives the loss mask as character spans.

Defined results: a null text or role is empty; a message whose parent is null or
missing is a root; ties of order are broken by role and text, ties of score by node; rows
with a null conversation id form one conversation; messages on a cycle hang on no
root and are left out; empty input gives no rows; equal rows of a linear table are turns
of their own. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize

# The template's control strings, and the escapes of what texts may not hold.
HEAD, COLON, TAIL = "### ", ": ", "</turn>\n"
END = "</turn>"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    """No control string is left: ``\\`` to ``\\e``, a ``#`` before ``##`` to ``\\h``, the ``<`` of an end mark to ``\\l``."""
    text = F.replace(text, F.lit("\\"), F.lit("\\e"))
    text = F.regexp_replace(text, "#(?=##)", "\\\\h")
    return F.replace(text, F.lit(END), F.lit("\\l" + END[1:]))


def unescape(text: Column) -> Column:
    for code, plain in (("\\l", "<"), ("\\h", "#"), ("\\c", ":"), ("\\e", "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def linear_trees(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A table of turns as trees without branches: the parent is the turn before."""
    order = W.partitionBy("conv").orderBy("turn", "role", "text")
    rows = messages.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    node = F.row_number().over(order).cast("long")
    return rows.select("conv", node.alias("node"), (node - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")).withColumn(
        "parent", F.when(F.col("parent") > 0, F.col("parent"))
    )



def ancestors(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(conv, node, depth, total): depth from 1 at the root and summed score of the path, and
    the pointers (conv, node, up) at distances 1, 2, 4, ..."""
    n, p = nodes.alias("n"), nodes.select("conv", F.col("node").alias("up")).alias("p")
    # an unknown parent makes a root
    known = n.join(p, F.col("n.conv").eqNullSafe(F.col("p.conv")) & (F.col("n.parent") == F.col("p.up")), "left")
    state = materialize(known.select("n.conv", "n.node", "p.up", F.lit(1).cast("long").alias("depth"), F.coalesce("n.score", F.lit(0.0)).alias("total")))
    levels, size = [], state.count()
    while not state.where(F.col("up").isNotNull()).isEmpty():
        open_ = state.where(F.col("up").isNotNull())
        if 2 ** len(levels) > size:
            break  # no path is that long: only cycles are left
        levels.append(open_.select("conv", "node", "up"))
        a, b = open_.alias("a"), state.alias("b")
        stepped = a.join(b, F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.up") == F.col("b.node"))).select(
            "a.conv", "a.node", "b.up", (F.col("a.depth") + F.col("b.depth")).alias("depth"), (F.col("a.total") + F.col("b.total")).alias("total")
        )
        state = materialize(state.where(F.col("up").isNull()).unionByName(stepped))
    return state.where(F.col("up").isNull()).drop("up"), levels


def choose_paths(nodes: DataFrame, measured: DataFrame, paths_per_tree: int | None = None) -> DataFrame:
    """(conv, leaf, branch): leaves ranked within their conversation by mean path score."""
    parents = nodes.select("conv", F.col("parent").alias("node")).where(F.col("parent").isNotNull()).distinct()
    m, p = measured.alias("m"), parents.alias("p")
    leaves = m.join(p, F.col("m.conv").eqNullSafe(F.col("p.conv")) & (F.col("m.node") == F.col("p.node")), "left_anti")
    rank = F.row_number().over(W.partitionBy("conv").orderBy(F.desc(F.col("total") / F.col("depth")), "node"))
    ranked = leaves.select("conv", F.col("node").alias("leaf"), rank.alias("branch"))
    return ranked if paths_per_tree is None else ranked.where(F.col("branch") <= paths_per_tree)


def path_nodes(chosen: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(conv, leaf, branch, node): every message of every chosen path, once."""
    reached = materialize(chosen.withColumn("node", F.col("leaf")))
    for level in reversed(levels):
        r, j = reached.alias("r"), level.alias("j")
        more = r.join(j, F.col("r.conv").eqNullSafe(F.col("j.conv")) & (F.col("r.node") == F.col("j.node")))
        # each step uses the last one twice: without a cut the plan would double
        reached = materialize(reached.unionByName(more.select("r.conv", "r.leaf", "r.branch", F.col("j.up").alias("node"))))
    return reached


def format_trees(nodes: DataFrame, paths_per_tree: int | None = None) -> DataFrame:
    """One row per chosen path: conv, branch, n_turns, formatted text and ``loss``, the spans
    [start, end) in code points of the formatted text under the loss mask."""
    links = materialize(nodes.select("conv", "node", "parent", "score"))  # without texts
    measured, levels = ancestors(links)
    measured = materialize(measured)
    listed = path_nodes(choose_paths(links, measured, paths_per_tree), levels)
    t, d, x = listed.alias("t"), measured.alias("d"), nodes.alias("x")
    rows = t.join(d, F.col("t.conv").eqNullSafe(F.col("d.conv")) & (F.col("t.node") == F.col("d.node"))).join(
        x, F.col("t.conv").eqNullSafe(F.col("x.conv")) & (F.col("t.node") == F.col("x.node"))
    )
    role = F.replace(escape(F.coalesce("x.role", F.lit(""))), F.lit(":"), F.lit("\\c"))
    head = F.concat(F.lit(HEAD), role, F.lit(COLON))
    turns = rows.select(
        F.col("t.conv").alias("conv"), "t.branch", "d.depth", head.alias("head"), escape(F.coalesce("x.text", F.lit(""))).alias("body"),
        (F.col("x.role") == TRAINED_ROLE).alias("trained"),
    )
    size = F.length("head") + F.length("body") + len(TAIL)
    before = F.sum(size).over(W.partitionBy("conv", "branch").orderBy("depth")) - size
    start = before + F.length("head")
    turn = F.struct(
        "depth", F.concat("head", "body", F.lit(TAIL)).alias("piece"), start.alias("start"), (start + F.length("body")).alias("end"), "trained"
    )
    grouped = turns.withColumn("turn", turn).groupBy("conv", "branch").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    loss = F.transform(F.filter("turns", lambda v: v["trained"]), lambda v: F.struct(v["start"].alias("start"), v["end"].alias("end")))
    return grouped.select(
        "conv", "branch", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda v: v["piece"]), "").alias("formatted"), loss.alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Roles and texts of the turns, and the text under the mask, from the formatted text."""
    pieces = F.slice(F.split("formatted", TAIL), 1, F.col("n_turns").cast("int"))
    turns = F.transform(
        pieces,
        lambda p: F.concat(
            unescape(F.substring_index(F.substr(p, F.lit(len(HEAD) + 1)), COLON, 1)), F.lit("\n"),
            unescape(F.substr(p, F.locate(COLON, p) + len(COLON))), F.lit("\n"),
        ),
    )
    masked = F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumn("turns_text", F.array_join(turns, "")).withColumn("loss_text", F.array_join(masked, ""))


def digest_conversations(messages: DataFrame) -> DataFrame:
    """The contract's columns for a table of turns."""
    back = read_back(format_trees(linear_trees(messages), 1))
    return back.select(
        F.col("conv").alias("conv_id"), "n_turns", F.sha2(F.col("turns_text").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
