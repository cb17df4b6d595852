"""Reply trees to training conversations.

Messages are (tree, id, parent, role, text, score). Pointers to ancestors are
doubled by self-joins, so that a path of n messages takes log2(n) rounds; every
round is a join of narrow rows on unique keys, written to the shared folder.
Leaves are ranked by the mean score of their path, and only chosen paths are
laid out, again by self-joins. Texts are joined at the end and formatted as a
stream, message by message; what has to fit into a task is one formatted
conversation, as it is one value.

Defined cases: a null role or text is empty, a null score 0; an empty table
gives an empty table; other columns are dropped. A message whose parent is not
in its tree begins a tree of its own; several roots of a tree are ranked apart.
Repeated ids count once (the row with the least role and text stays). Messages
that reply to each other in a circle have no root and are on no path. Ties in
score go to the longer path, then to the smaller leaf id. A null tree is a tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from flowloom.llm.common import in_order, join_on, record_batches, rows_of
from flowloom.operators.numbering import numbered
from flowloom.runtime import write_table

HOT_ROWS = 1_000_000  # conversations with more rows are numbered by prefix sums

# The marks of a turn, and the strings that no text may form.
BEGIN, END = "<|im_start|>", "<|im_end|>"
CONTROL = r"<(\|(?:im_start|im_end|endoftext)\|>|/?s>|</?SYS>>)|\[(/?INST\])"

_CONTROL = re.compile(CONTROL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(BEGIN) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)


def escape(text: str) -> str:
    """The text with a backslash inside each control string, so that none is
    left; its own backslashes are doubled."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """Undoes ``escape`` (and the line breaks of a role)."""
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def as_tree(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as reply trees: each row answers the one
    before it. Rows of one turn go by role, then text; repeats stay."""
    rows = conversations.select(F.col("conv_id").alias("tree"), "turn", F.coalesce("role", F.lit("")).alias("role"),
                                F.coalesce("text", F.lit("")).alias("text"))
    rows = numbered(rows, ["tree"], ["turn", "role", "text"], "id", HOT_ROWS)
    return rows.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def tidy(messages: DataFrame) -> DataFrame:
    """One row for each message id, nulls filled."""
    rows = messages.select("tree", "id", "parent", F.coalesce("role", F.lit("")).alias("role"),
                           F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    least = F.min(F.struct("role", "text", "parent", "score")).alias("m")
    return rows.filter("id IS NOT NULL").groupBy("tree", "id").agg(least).select("tree", "id", "m.parent", "m.role", "m.text", "m.score")


def _doubled(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Every message with its root, depth and summed score, and the tables of
    its 1st, 2nd, 4th, ... ancestors."""
    heads = links.select("tree", F.col("id").alias("parent"), F.lit(True).alias("there"))
    links = join_on(links, heads, ["tree", "parent"], "left").withColumn("up", F.when(F.col("there"), F.col("parent")))
    now = write_table(links.select("tree", "id", "up", F.when(F.col("up").isNull(), F.col("id")).alias("root"),
                                   F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")), "jumps")
    levels, before = [], None
    while True:
        open_ends = now.filter("up IS NOT NULL").count()
        if open_ends == 0 or open_ends == before:  # all have their root, or the others run in a circle
            return now.filter("root IS NOT NULL"), levels
        before = open_ends
        levels.append(now.filter("up IS NOT NULL").select("tree", "id", "up"))
        next_up = now.select("tree", F.col("id").alias("up"), *[F.col(c).alias(f"{c}2") for c in ("up", "root", "depth", "total")])
        moved = join_on(now.filter("up IS NOT NULL"), next_up, ["tree", "up"]).select(
            "tree", "id", F.col("up2").alias("up"), F.coalesce("root", "root2").alias("root"),
            (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("total") + F.col("total2")).alias("total"))
        now = write_table(now.filter("up IS NULL").unionByName(moved), "jumps")


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The best ``branches`` paths of each root: (tree, leaf, branch, score,
    pos, id), pos from 1 at the root. ``messages`` has unique ids."""
    links = messages.select("tree", "id", "parent", "score")
    ends, levels = _doubled(links)
    answered = links.filter("parent IS NOT NULL").select("tree", F.col("parent").alias("id")).distinct()
    leaves = join_on(ends, answered, ["tree", "id"], "left_anti").withColumn("score", F.col("total") / F.col("depth"))
    best = Window.partitionBy("tree", "root").orderBy(F.desc("score"), F.desc("depth"), "id")
    chosen = leaves.withColumn("branch", F.row_number().over(best)).filter(F.col("branch") <= branches)
    found = write_table(chosen.select("tree", F.col("id").alias("leaf"), "branch", "score", F.col("depth").alias("pos"), "id"), "paths")
    for k in reversed(range(len(levels))):
        above = join_on(found, levels[k], ["tree", "id"]).select(
            "tree", "leaf", "branch", "score", (F.col("pos") - (1 << k)).alias("pos"), F.col("up").alias("id"))
        found = write_table(found.unionByName(above), "paths")
    return found


def conversations(messages: DataFrame, branches: int = 1, unique: bool = False) -> DataFrame:
    """One row for each chosen path: tree, leaf, branch, score, text (the
    formatted conversation) and loss (start and end, in code points, of what an
    assistant says). ``unique`` says that ids are known to be unique."""
    messages = messages if unique else tidy(messages)
    messages = write_table(messages, "messages")
    said = join_on(paths(messages, branches), messages.select("tree", "id", "role", "text"), ["tree", "id"])
    said = in_order(said.select("tree", "leaf", "branch", "score", "pos", "role", "text"), ["tree", "leaf"], ["pos"])
    kinds = [said.schema["tree"].dataType.simpleString(), said.schema["leaf"].dataType.simpleString()]
    out = f"tree {kinds[0]}, leaf {kinds[1]}, branch int, score double, text string, loss array<struct<start:bigint,end:bigint>>"
    return said.mapInArrow(_formatted, out)


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batches = iter(batches)
    first = next(batches, None)
    if first is None:
        return
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([first.schema.field("tree"), first.schema.field("leaf"), ("branch", pa.int32()), ("score", pa.float64()),
                        ("text", pa.string()), ("loss", kind)])

    def rows() -> Iterator[tuple]:
        for key, turns in groupby(rows_of(_chain(first, batches)), lambda r: r[:4]):
            parts, loss, at = [], [], 0
            for *_, role, text in turns:
                head, body = f"{BEGIN}{escape(role).replace(chr(10), chr(92) + 'n')}\n", escape(text)
                if role == "assistant":
                    loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
                parts += (head, body, END, "\n")
                at += len(head) + len(body) + len(END) + 1
            yield (*key, "".join(parts), loss)

    yield from record_batches(rows(), schema)


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def read_back(formatted: DataFrame) -> DataFrame:
    """What ``conversations`` wrote, parsed again: turns (role, text) and
    learned, the text under the loss mask, unescaped. Other columns stay."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in formatted.schema.fields)
    return formatted.mapInArrow(_read, f"{schema}, turns array<struct<role:string,text:string>>, learned string")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    for batch in batches:
        for i in range(batch.num_rows):  # a conversation may be long: one at a time
            part = batch.slice(i, 1)
            text, loss = part["text"][0].as_py(), part["loss"][0].as_py()
            turns = [{"role": unescape(m[1]), "text": unescape(m[2])} for m in _TURN.finditer(text)]
            learned = "".join(unescape(text[x["start"]:x["end"]]) for x in loss)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([turns], kind), pa.array([learned], pa.string())],
                                             names=[*part.schema.names, "turns", "learned"])
