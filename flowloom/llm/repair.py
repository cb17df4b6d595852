"""Structure faults of conversations and their cheapest repair.

A conversation becomes a string of one letter a row (role and fault). Equal
strings are looked at once. Re-Pair turns the strings of a block into a grammar;
every rule has one min-plus transfer matrix over the states of
``(s?(ua)+)?``, the product of the matrices of its two parts, so stretches that
many conversations share are solved once. An entry is a cost and the edits that
reach it as a rope, of which the least in ASCII wins a tie. Edits of a stretch end
with a row (inserts come before it), so none is the beginning of another and
the least of a whole is made of the least of its parts. The answer does not
depend on the grammar, nor on how strings are spread over blocks.

Conversations of more than ``PIECE`` rows are cut; the matrices of their pieces
are chained afterwards. Texts are shuffled once, as a stream by conversation,
to be counted and digested; only the digests of earlier rows take part before.

Defined cases: a null role or text is one space; a null conversation or turn is
a value of its own, and nulls come first. Rows of one turn go by role, then by the
digest of their text. Repeated rows are duplicates. Without rows: see
``repaired``. Other columns are dropped. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowloom.llm.common import in_order, join_on, record_batches, rows_of
from flowloom.operators.numbering import numbered
from flowloom.runtime import write_table

HOT_ROWS = 1_000_000   # conversations with more rows are numbered by prefix sums
PIECE = 4096           # rows of a conversation that are one string
BLOCK = 1 << 20        # letters that one grammar is made for

# Fixed values of the task: costs of the edits, and what counts as white space.
DELETE, REROLE, INSERT, UNFINISHED = 4, 3, 3, 3
SPACE = r"\x20\x09-\x0D"

_INK = re.compile(rf"[^{SPACE}]")

# Letters: b blank, d duplicate; s, u, a, o(ther) by role initial, in capitals if truncated.
# States: 0 nothing yet, 1 after s, 2 after u, 3 after a. A conversation may end in 0 or 3.
STATES = range(4)
AHEAD = {(i, i): "" for i in STATES} | {(0, 2): "I", (0, 3): "II", (1, 2): "I", (1, 3): "II", (2, 3): "I", (3, 2): "I"}
ENDING = {0: "", 1: "II", 2: "I", 3: ""}
BY_ROLE = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
BY_REROLE = {0: 2, 1: 2, 3: 2, 2: 3}


# --- ropes and matrices -------------------------------------------------------

class Rope:
    """Edits as a tree of shared parts. Equal length and hash stand for equal
    edits (61 bits)."""

    __slots__ = ("left", "right", "leaf", "size", "hash", "shift")
    MOD, BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E6

    def __init__(self, left, right=None):
        if right is None:
            self.left = self.right = None
            self.leaf, self.size, self.hash = left, len(left), 0
            for c in left:
                self.hash = (self.hash * self.BASE + ord(c)) % self.MOD
            self.shift = pow(self.BASE, self.size, self.MOD)
        else:
            self.left, self.right, self.leaf = left, right, None
            self.size = left.size + right.size
            self.shift = left.shift * right.shift % self.MOD
            self.hash = (left.hash * right.shift + right.hash) % self.MOD

    def leaves(self) -> Iterator[str]:
        stack = [self]
        while stack:
            top = stack.pop()
            if top.leaf is None:
                stack += (top.right, top.left)
            elif top.leaf:
                yield top.leaf

    def text(self) -> str:
        return "".join(self.leaves())

    def __lt__(self, other: "Rope") -> bool:
        """Order of the texts. Parts that are the same in both are skipped."""
        a, b = [self], [other]
        while a and b:
            x, y = a.pop(), b.pop()
            if x.size == y.size and x.hash == y.hash:
                continue
            if x.leaf is None and (x.size >= y.size or y.leaf is not None):
                a += (x.right, x.left)
                b.append(y)
            elif y.leaf is None:
                b += (y.right, y.left)
                a.append(x)
            else:
                n = min(x.size, y.size)
                if x.leaf[:n] != y.leaf[:n]:
                    return x.leaf < y.leaf
                if x.size > n:
                    a.append(Rope(x.leaf[n:]))
                if y.size > n:
                    b.append(Rope(y.leaf[n:]))
        return not any(x.size for x in a) and any(y.size for y in b)


Matrix = dict  # (from, to) -> (cost, Rope); no entry where there is no way


def letter_matrix(letter: str) -> Matrix:
    """Inserts, then one edit of a row with this letter."""
    edits = [(DELETE, "D", {i: i for i in STATES})]
    if letter not in "bd":
        late = UNFINISHED * letter.isupper()
        edits += [(late, "K", BY_ROLE[letter.lower()]), (REROLE + late, "R", BY_REROLE)]
    best: dict = {}
    for (i, k), added in AHEAD.items():
        for cost, name, moves in edits:
            if k in moves:
                found = (INSERT * len(added) + cost, added + name)
                best[i, moves[k]] = min(best.get((i, moves[k]), found), found)
    return {at: (cost, Rope(text)) for at, (cost, text) in best.items()}


def product(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product; of equal costs the least edits."""
    best: Matrix = {}
    for (i, k), (cost, edits) in a.items():
        for j in STATES:
            if (k, j) not in b:
                continue
            total, rope = cost + b[k, j][0], None
            if (i, j) in best:
                if total > best[i, j][0]:
                    continue
                rope = Rope(edits, b[k, j][1])
                if total == best[i, j][0] and not rope < best[i, j][1]:
                    continue
            best[i, j] = (total, rope or Rope(edits, b[k, j][1]))
    return best


def closed(row: Matrix) -> tuple[int, str]:
    """Cost and edits of the best way from state 0 to an end."""
    ways = [(cost + INSERT * len(ENDING[j]), edits.text() + ENDING[j]) for (i, j), (cost, edits) in row.items() if i == 0]
    return min(ways)


# --- Re-Pair --------------------------------------------------------------------

def grammar(strings: list[str]) -> tuple[list[tuple], list[list]]:
    """Re-Pair: the most frequent pair of neighbours becomes a symbol, until no
    pair occurs twice. Gives the rules, (left, right) for symbols 0, 1, ..., and
    the strings in symbols; letters stand for themselves."""
    symbols: list = []
    last: list[int] = []
    for s in strings:
        symbols += s
        last.append(len(symbols) - 1)
    ends = set(last)
    after = [-1 if i in ends else i + 1 for i in range(len(symbols))]
    before = [-1] * len(symbols)
    for i, j in enumerate(after):
        if j >= 0:
            before[j] = i
    places: defaultdict = defaultdict(set)
    for i, j in enumerate(after):
        if j >= 0:
            places[symbols[i], symbols[j]].add(i)
    queue = [(-len(at), str(pair), pair) for pair, at in places.items() if len(at) > 1]
    heapq.heapify(queue)
    rules: list[tuple] = []
    while queue:
        count, name, pair = heapq.heappop(queue)
        at = places.get(pair, ())
        if len(at) < 2:
            continue
        if len(at) != -count:  # it has changed since: look again later
            heapq.heappush(queue, (-len(at), name, pair))
            continue
        new, touched = len(rules), set()
        rules.append(pair)
        for i in sorted(places.pop(pair)):
            j = after[i]
            if symbols[i] != pair[0] or j < 0 or symbols[j] != pair[1]:
                continue  # overlaps one that has just been replaced
            p, n = before[i], after[j]
            if p >= 0:
                places[symbols[p], symbols[i]].discard(p)
                places[symbols[p], new].add(p)
                touched.add((symbols[p], new))
            if n >= 0:
                places[symbols[j], symbols[n]].discard(j)
                places[new, symbols[n]].add(i)
                touched.add((new, symbols[n]))
                before[n] = i
            symbols[i], symbols[j], after[i] = new, None, n
        for t in touched:
            if len(places[t]) > 1:
                heapq.heappush(queue, (-len(places[t]), str(t), t))
    out, start = [], 0
    for s in strings:
        line, i = [], start if s else -1
        while i >= 0:
            line.append(symbols[i])
            i = after[i]
        out.append(line)
        start += len(s)
    return rules, out


def solve(strings: list[str]) -> Iterator[Matrix]:
    """The transfer matrix of each string, by the grammar of all of them."""
    rules, lines = grammar(strings)
    known: dict = {c: letter_matrix(c) for c in "bdsuaoSUAO"}
    for n, (left, right) in enumerate(rules):  # a rule names earlier ones only
        known[n] = product(known[left], known[right])
    nothing: Matrix = {(i, i): (0, Rope("")) for i in STATES}
    for line in lines:
        whole = nothing
        for symbol in line:
            whole = product(whole, known[symbol])
        yield whole


_MATRIX = pa.list_(pa.struct([("i", pa.int8()), ("j", pa.int8()), ("cost", pa.int64()), ("edits", pa.string())]))
_MATRIX_SQL = "array<struct<i:tinyint,j:tinyint,cost:bigint,edits:string>>"


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(letters, cut) to cost and audit, or the matrix where the string is a
    piece of a longer one."""
    schema = pa.schema([("letters", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("matrix", _MATRIX)])

    def rows() -> Iterator[tuple]:
        for block in _blocks(rows_of(batches)):
            for (letters, cut), found in zip(block, solve([r[0] for r in block])):
                if cut:
                    yield letters, None, None, [{"i": i, "j": j, "cost": c, "edits": e.text()} for (i, j), (c, e) in found.items()]
                else:
                    yield (letters, *closed(found), None)

    yield from record_batches(rows(), schema)


def _blocks(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[0])
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, piece, matrix) in order to (conv_id, piece, cost, audit): each
    piece with its part of the edits, the first with the cost."""
    schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])

    def rows() -> Iterator[tuple]:
        for conv_id, pieces in groupby(rows_of(batches), lambda r: r[0]):
            whole: Matrix = {(0, 0): (0, Rope(""))}
            names, rows_in = [], []
            for _, piece, n, matrix in pieces:
                part = {(m["i"], m["j"]): (m["cost"], Rope(m["edits"])) for m in matrix}
                whole = product(whole, part)
                names.append(piece)
                rows_in.append(n)
            cost, audit = closed(whole)
            at = 0
            for k, piece in enumerate(names):
                start, left = at, rows_in[k]
                while left:  # the piece's edits end with that of its last row
                    left -= audit[at] != "I"
                    at += 1
                yield conv_id, piece, cost if k == 0 else 0, audit[start:] if k == len(names) - 1 else audit[start:at]

    yield from record_batches(rows(), schema)


# --- rows -----------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with planted faults, by crc32 of ``conv_id:turn`` modulo 20:
    0 drops the row, 1 empties its text, 2 takes out its ``.!?``, 3 repeats it,
    4 makes the role user. A null in the hashed name or in a row is one space."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                                (F.crc32(F.encode(name, "UTF-8")) % 20).alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.filter("_kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times)).drop("col")


def repaired(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """One row for each conversation: conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256 (digest of the repaired ``role:text``
    lines). ``every`` names conversations to report even if ``rows`` has none
    of their rows: zeros, an empty audit and the digest of nothing."""
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    whole = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")).rlike(r"[.!?]\z")
    narrow = rows.select("conv_id", "turn", "role", "digest", blank.alias("blank"), whole.alias("whole"))
    narrow = write_table(numbered(narrow, ["conv_id"], ["turn", "role", "digest"], "pos", HOT_ROWS), "turns")
    first = narrow.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos")).select("conv_id", "pos", F.lit(True).alias("new"))
    marked = join_on(narrow, first, ["conv_id", "pos"], "left")
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(F.col("blank"), "b").when(F.col("new").isNull(), "d").when(F.col("whole"), letter).otherwise(F.upper(letter))
    piece = F.floor((F.col("pos") - 1) / PIECE).cast("long")
    pieces = marked.groupBy("conv_id", piece.alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", letter.alias("c")))), lambda x: x.c), "").alias("letters"),
        F.min(F.struct("turn", "role", "digest")).alias("from"))
    pieces = write_table(pieces.withColumn("cut", (F.col("piece") > 0) | (F.length("letters") == PIECE)), "pieces")
    strings = pieces.select("letters", "cut").distinct().repartitionByRange("letters", "cut")  # alike ones share a block
    solved = strings.mapInArrow(_solved, f"letters string, cost bigint, audit string, matrix {_MATRIX_SQL}")
    solved = write_table(solved.withColumn("cut", F.col("matrix").isNotNull()), "solved")
    found = pieces.join(solved, ["letters", "cut"])
    long = found.filter("cut").select("conv_id", "piece", F.length("letters").cast("long").alias("n"), "matrix")
    chained = in_order(long, ["conv_id"], ["piece"]).mapInArrow(_chained, "conv_id bigint, piece bigint, cost bigint, audit string")
    chained = join_on(chained, pieces.select("conv_id", "piece", "letters", "from"), ["conv_id", "piece"])
    heads = found.filter("NOT cut").select("conv_id", "piece", "cost", "audit", "letters", "from").unionByName(chained)
    heads = heads.select("conv_id", "from.*", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"), "letters", "cost", "audit")
    said = rows.select("conv_id", "turn", "role", "digest", F.lit(1).alias("kind"), "text", F.lit(None).cast("string").alias("letters"),
                       F.lit(None).cast("long").alias("cost"), F.lit(None).cast("string").alias("audit"))
    both = heads.unionByName(said)
    if every is not None:
        both = both.unionByName(every.select("conv_id").distinct().withColumn("kind", F.lit(0)), allowMissingColumns=True)
    stream = in_order(both, ["conv_id"], ["turn", "role", "digest", "kind"]).select(
        "conv_id", "turn", "role", "kind", "text", "letters", "cost", "audit")
    return stream.mapInArrow(_reported, "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
                                        "cost bigint, audit string, repaired_sha256 string")


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in counts], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def rows() -> Iterator[tuple]:
        for conv_id, stream in groupby(rows_of(batches), lambda r: r[0]):
            yield (conv_id, *_one(r[1:] for r in stream))

    yield from record_batches(rows(), schema)


class _Lines:
    """The repaired lines, digested as they come."""

    def __init__(self):
        self.digest, self.lines, self.state = hashlib.sha256(), 0, 0

    def add(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1
        self.state = {"s": 1, "u": 2, "a": 3}[role[:1]]

    def due(self) -> str:
        return "assistant" if self.state == 2 else "user"


def _one(stream: Iterator[tuple]) -> tuple:
    """One conversation: its rows in order, and before the first row of each
    piece the letters and edits of that piece."""
    lines, audit, letters, edits = _Lines(), [], [], []
    tally = dict.fromkeys("bdt", 0)
    low = high = last_turn = initial = None
    turns = illegal = cost = 0
    pending: list[tuple[str, str]] = []  # pieces whose rows have not come yet
    for turn, role, kind, text, piece_letters, piece_cost, piece_audit in stream:
        if kind == 0:
            if piece_letters is not None:
                pending.append((piece_letters, piece_audit))
                audit.append(piece_audit)
                cost += piece_cost
            continue
        if not letters:
            piece_letters, piece_audit = pending.pop(0)
            letters, edits = list(reversed(piece_letters)), list(reversed(piece_audit))
        letter = letters.pop()
        tally["t" if letter.isupper() else letter if letter in "bd" else "t"] += letter.isupper() or letter in "bd"
        if turn is not None:
            low, high, turns = (turn if low is None else low), turn, turns + (turn != last_turn)
            last_turn = turn
        illegal += initial is not None and initial + role[:1] not in ("su", "ua", "au")
        initial = role[:1]
        while edits[-1] == "I":
            edits.pop()
            lines.add(lines.due(), "")
        edit = edits.pop()
        if edit != "D":
            lines.add(lines.due() if edit == "R" else role, text)
        if not letters:  # inserts after the last row
            for _ in edits:
                lines.add(lines.due(), "")
    gaps = high - low + 1 - turns if turns else 0
    return gaps, tally["b"], tally["d"], tally["t"], illegal, cost, "".join(audit), lines.digest.hexdigest()
