"""The trie of conversation prefixes, and totals over its subtrees.

Turns become digests first; no text travels after that. A prefix is named by
128 bits, the exclusive or of hashes of (depth, turn), so that it is a running
aggregate, not a chain. Nodes are aggregates with map-side combine.

Totals go upward by time-forward processing: nodes are sorted by reverse level
order (externally, by Spark), and a node takes from a priority queue what its
children have sent and sends its own total to its parent. The queue spills
sorted runs to the shared folder. That happens in two steps:

* within shards: a node with few members belongs to the piece of the trie below
  its highest ancestor with few members; pieces are hashed to shards. A piece
  ends after ``BAND`` levels, so one endless conversation is many pieces;
* across shard roots: roots' totals are summed by parent, and what is left,
  nodes with many members (at most ``WIDE`` a level, whatever the size of the
  input) and roots of pieces with others below, goes through one more queue.
  Pieces that get something from below are then passed once more.

Defined cases: rows without conv_id belong to no conversation and are left out;
a null role or text is empty; a null turn comes first; rows of one turn go by
the digest of role and text, and repeats stay; an empty table gives an empty
table; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom.llm.common import in_order, record_batches, rows_of, unpack, pack
from flowloom.operators.numbering import numbered
from flowloom.runtime import shared_dir, write_table

HOT_ROWS = 1_000_000  # conversations with more rows are numbered by prefix sums
SLICE = 100_000       # turns of a conversation that one window sees
BAND = 4096           # levels of a piece
WIDE = 4096           # nodes of a level that count as having many members, at most
QUEUED = 200_000      # messages that a queue keeps in memory
KEY = ["depth", "p1", "p2"]
NOTHING = hashlib.sha256(b"").hexdigest()


# --- rebuilt conversations --------------------------------------------------------

def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, words), pos from 1. Stored."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    return write_table(numbered(rows, ["conv_id"], ["turn", "digest"], "pos", HOT_ROWS).drop("turn"), "turns")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation with its beginning taken from another: conversations
    (conv_id, size) and rows (conv_id, depth, digest, words, last)."""
    own = rows.groupBy("conv_id").agg(F.max("pos").alias("n"))
    ids = own.select("conv_id", "n", (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % 4).alias("h"),
                     (F.col("conv_id") - F.col("conv_id") % 20).alias("base"))
    ids = ids.join(own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    ids = ids.withColumn("lead", F.least("h", F.coalesce("base_n", F.lit(0)))).withColumn("size", F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    ids = write_table(ids.select("conv_id", "base", "h", "lead", "size"), "conversations")
    heads = rows.filter("pos <= 3").select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "digest", "words")
    heads = ids.join(heads, "base").filter("depth <= h").select("conv_id", "size", "depth", "digest", "words")
    tails = rows.join(ids, "conv_id").filter("pos > h").select(
        "conv_id", "size", (F.col("lead") + F.col("pos") - F.col("h")).alias("depth"), "digest", "words")
    both = heads.unionByName(tails).withColumn("last", F.col("depth") == F.col("size")).drop("size")
    return ids.select("conv_id", "size"), both


def prefixes(rows: DataFrame) -> DataFrame:
    """Rows with the names of their prefix (p1, p2) and of the one before it
    (q1, q2). A conversation is named slice by slice."""
    rows = rows.withColumn("s", F.floor((F.col("depth") - 1) / SLICE).cast("long"))
    rows = rows.withColumns({f"x{k}": F.xxhash64(F.lit(k), "depth", "digest") for k in (1, 2)})
    run = Window.partitionBy("conv_id", "s").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = rows.withColumns({f"p{k}": F.bit_xor(f"x{k}").over(run) for k in (1, 2)})
    sliced = rows.filter("s > 0").select("conv_id").distinct()
    if sliced.head(1):
        parts = rows.join(sliced, "conv_id", "left_semi").groupBy("conv_id", "s").agg(*[F.bit_xor(f"x{k}").alias(f"y{k}") for k in (1, 2)])
        earlier = Window.partitionBy("conv_id").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select("conv_id", "s", *[F.bit_xor(f"y{k}").over(earlier).alias(f"y{k}") for k in (1, 2)])
        named = named.join(parts, ["conv_id", "s"], "left")
        named = named.withColumns({f"p{k}": F.col(f"p{k}").bitwiseXOR(F.coalesce(f"y{k}", F.lit(0).cast("long"))) for k in (1, 2)})
    named = named.withColumns({f"q{k}": F.col(f"p{k}").bitwiseXOR(F.col(f"x{k}")) for k in (1, 2)})
    return write_table(named.select("conv_id", "depth", "words", "last", "p1", "p2", "q1", "q2"), "prefixes")


def nodes(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each distinct prefix: its name, its parent's, smallest member,
    number of members, and its own part of the totals. Stored."""
    counted = rows.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
        F.max("q1").alias("q1"), F.max("q2").alias("q2"), F.count_if("last").alias("ended"))
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if(F.col("size") == 0).alias("ended"))
    zero = F.lit(0).cast("long")
    root = root.filter("n_convs > 0").select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "conv_id", "n_convs", zero.alias("words"),
                                             F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2"), "ended")
    every = counted.unionByName(root)
    return write_table(every.select(
        *KEY, "conv_id", "n_convs", "q1", "q2", "ended", (F.col("ended") == F.col("n_convs")).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved")), "nodes")


# --- time-forward processing ----------------------------------------------------

class SpillingQueue:
    """A priority queue of tuples of whole numbers. Beyond ``most`` entries it
    writes them, sorted, to a file in ``folder``; files are read as streams and
    are gone when the queue is closed."""

    BLOCK = 10_000

    def __init__(self, folder: str, most: int = QUEUED):
        self.folder, self.most = folder, most
        self.heap: list[tuple] = []
        self.heads: list[tuple] = []   # (first entry of a run, number of the run)
        self.runs: list[Iterator[tuple]] = []
        self.paths: list[str] = []
        self.where = None

    def push(self, entry: tuple) -> None:
        heapq.heappush(self.heap, entry)
        if len(self.heap) > self.most:
            self._spill()

    def first(self) -> tuple | None:
        ends = [h[0] for h in (self.heap[:1], [x[0] for x in self.heads[:1]]) if h]
        return min(ends) if ends else None

    def pop(self) -> tuple:
        if self.heads and (not self.heap or self.heads[0][0] <= self.heap[0]):
            entry, run = self.heads[0]
            following = next(self.runs[run], None)
            if following is None:
                heapq.heappop(self.heads)
            else:
                heapq.heapreplace(self.heads, (following, run))
            return entry
        return heapq.heappop(self.heap)

    def _spill(self) -> None:
        if self.where is None:
            uri = self.folder if "://" in self.folder else f"file://{self.folder.removeprefix('file:')}"
            self.where, self.root = fs.FileSystem.from_uri(uri)
            self.where.create_dir(self.root, recursive=True)
        path = f"{self.root}/{uuid.uuid4().hex}"
        self.paths.append(path)
        table = np.array(sorted(self.heap), np.int64)
        with self.where.open_output_stream(path) as out:
            for at in range(0, len(table), self.BLOCK):
                data = pack(table[at:at + self.BLOCK])
                out.write(len(data).to_bytes(8, "little") + table.shape[1].to_bytes(8, "little") + data)
        self.heap = []
        self.runs.append(self._read(path))
        heapq.heappush(self.heads, (next(self.runs[-1]), len(self.runs) - 1))

    def _read(self, path: str) -> Iterator[tuple]:
        with self.where.open_input_stream(path) as found:
            while size := found.read(8):
                width = int.from_bytes(found.read(8), "little")
                for row in unpack(found.read(int.from_bytes(size, "little")), np.int64).reshape(-1, width).tolist():
                    yield tuple(row)

    def close(self) -> None:
        for run in self.runs:
            run.close()
        for path in self.paths:
            self.where.delete_file(path)


PASSED = pa.schema([(c, pa.int64()) for c in ("depth", "p1", "p2", "children", "leaves", "saved")])
PASSED_SQL = "depth bigint, p1 bigint, p2 bigint, children bigint, leaves bigint, saved bigint"
GOES = ["up", "u1", "u2"]  # name of the node that takes the total, null if it is elsewhere


def _upward(folder: str, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (depth, p1, p2, GOES, children, leaves, saved) in reverse level
    order to the same with what was sent to them. Rows of one name are one node;
    ``children`` of a row is what it adds to its own count."""
    queue = SpillingQueue(folder, most)

    def rows() -> Iterator[tuple]:
        for (depth, p1, p2), same in groupby(rows_of(batches), lambda r: r[:3]):
            total, goes, sends = [0, 0, 0], None, 0
            for r in same:
                total = [a + b for a, b in zip(total, r[7:])]
                if r[3] is not None:
                    goes, sends = r[3:6], r[6]
            at = (-depth, p1, p2)
            while (found := queue.first()) is not None and found[:3] == at:
                total = [a + b for a, b in zip(total, queue.pop()[3:])]
            if goes is not None:
                queue.push((-goes[0], goes[1], goes[2], sends, total[1], total[2]))
            yield (depth, p1, p2, *total)

    try:
        yield from record_batches(rows(), PASSED)
    finally:
        queue.close()


def passed_up(rows: DataFrame, shard: list[str]) -> DataFrame:
    """One pass over ``rows``: KEY, GOES, sends (children that the parent gains
    by it), children, leaves, saved; ``shard`` keeps what belongs together."""
    folder = f"{shared_dir(rows.sparkSession)}/queues-{uuid.uuid4().hex}"
    spread = rows.repartition(*shard) if shard else rows.repartition(1)
    ordered = spread.sortWithinPartitions(F.desc("depth"), "p1", "p2").select(*KEY, *GOES, "sends", "children", "leaves", "saved")
    return ordered.mapInArrow(partial(_upward, folder, QUEUED), PASSED_SQL)


def pieces(found: DataFrame, rows: DataFrame, many: Column) -> DataFrame:
    """Nodes that are not ``many``, with top, t1, t2: the root of their piece."""
    wide = found.filter(many & (F.col("depth") > 0)).select(*KEY)
    entered = rows.join(wide, KEY, "left_semi").groupBy("conv_id").agg(F.max("depth").alias("wide"))
    few = found.filter(~many).join(entered, "conv_id", "left")
    start = F.coalesce("wide", F.lit(0)) + 1
    few = few.withColumn("top", F.greatest(start, F.floor(F.col("depth") / BAND) * BAND)).drop("wide")
    above = rows.select("conv_id", F.col("depth").alias("top"), F.col("p1").alias("t1"), F.col("p2").alias("t2"))
    return write_table(few.join(above, ["conv_id", "top"]), "pieces")


def totals(found: DataFrame, rows: DataFrame) -> DataFrame:
    """KEY with children, leaves and saved over the subtree of every node."""
    members = found.filter("depth = 0").agg(F.max("n_convs").alias("n")).first()["n"] or 0
    many = (F.col("depth") == 0) | (F.col("n_convs") > F.lit(-(-members // WIDE)))
    few = pieces(found, rows, many)
    is_top = F.col("depth") == F.col("top")
    parent = {"up": F.col("depth") - 1, "u1": F.col("q1"), "u2": F.col("q2")}
    inside = few.withColumns({**{k: F.when(~is_top, v) for k, v in parent.items()}, "sends": F.lit(1), "children": F.lit(0)})
    piece = ["top", "t1", "t2"]
    first = write_table(passed_up(inside, piece), "passed")

    tops = few.filter(is_top).select(*KEY, "q1", "q2").join(first, KEY)
    sent = tops.groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(
        F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    sent = write_table(sent, "sent")
    none = {"up": F.lit(None).cast("long"), "u1": F.lit(None).cast("long"), "u2": F.lit(None).cast("long"), "sends": F.lit(0)}
    upper = found.filter(many).withColumns({**{k: F.when(F.col("depth") > 0, v) for k, v in parent.items()}, "sends": F.lit(1), "children": F.lit(0)})
    columns = [*KEY, *GOES, "sends", "children", "leaves", "saved"]
    # what arrives inside a piece counts for its root there, and goes on as one message
    hit = write_table(few.select(*KEY, *piece).join(sent.select(*KEY), KEY), "hit")
    arrived = sent.join(hit, KEY).select(F.col("top").alias("depth"), F.col("t1").alias("p1"), F.col("t2").alias("p2"), "leaves", "saved")
    relays = hit.select(F.col("top").alias("depth"), F.col("t1").alias("p1"), F.col("t2").alias("p2")).distinct()
    relays = write_table(relays.join(few.select(*KEY, "q1", "q2"), KEY), "relays")
    banded = bool(relays.head(1))
    # a message from one piece into another goes to the root of the other
    middle = relays.select(*KEY, F.col("q1"), F.col("q2")).join(
        few.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), *piece), ["depth", "q1", "q2"], "left")
    middle = middle.select(*KEY, F.coalesce("top", F.col("depth") - 1).alias("up"), F.coalesce("t1", "q1").alias("u1"),
                           F.coalesce("t2", "q2").alias("u2"), F.lit(0).alias("sends"), F.lit(0).alias("children"), F.lit(0).alias("leaves"), F.lit(0).alias("saved"))
    to_upper = sent.join(hit.select(*KEY), KEY, "left_anti").withColumns(none)
    across = upper.select(*columns).unionByName(to_upper.select(*columns))
    if banded:
        across = across.unionByName(middle).unionByName(arrived.withColumns({**none, "children": F.lit(0)}).select(*columns))
    second = write_table(passed_up(across, []), "across")
    done = found.filter(many).select(*KEY).join(second, KEY)
    if not banded:
        return first.unionByName(done)
    # once more through the pieces that have others below, now with all that arrives
    deeper = relays.join(second, KEY).select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"),
                                             F.lit(0).alias("children"), "leaves", "saved")
    arriving = sent.unionByName(deeper).groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in ("children", "leaves", "saved")])
    arriving = arriving.join(few.select(*KEY, *piece), KEY).withColumns(none)
    inner = relays.select(F.col("depth").alias("top"), F.col("p1").alias("t1"), F.col("p2").alias("t2"))
    again = inside.select(*columns, *piece).join(inner, piece, "left_semi").unionByName(arriving.select(*columns, *piece))
    again = write_table(passed_up(again, piece), "again")
    return first.join(again.select(*KEY), KEY, "left_anti").unionByName(again).unionByName(done)


# --- results ----------------------------------------------------------------------

def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("depth", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("ends_sha256", pa.string())])

    def rows() -> Iterator[tuple]:
        for key, same in groupby(rows_of(batches), lambda r: r[:3]):
            digest, mark = hashlib.sha256(), ""
            for r in same:
                digest.update(f"{mark}{r[3]}".encode())
                mark = ","
            yield (*key, digest.hexdigest())

    yield from record_batches(rows(), schema)


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256 (digest of the ids that end
    there, as a stream in their order)."""
    ids, rows = rebuilt(turns(conversations))
    rows = prefixes(rows)
    found = nodes(ids, rows)
    zero = F.lit(0).cast("long")
    ends = rows.filter("last").select(*KEY, "conv_id").unionByName(
        ids.filter("size = 0").select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "conv_id"))
    digests = in_order(ends, KEY, ["conv_id"]).mapInArrow(_digests, "depth bigint, p1 bigint, p2 bigint, ends_sha256 string")
    above = found.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    out = found.select(*KEY, "q1", "q2", "conv_id", "n_convs").join(totals(found, rows), KEY).join(digests, KEY, "left")
    out = out.join(above, ["depth", "q1", "q2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
                      F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
