"""Removal of repeated passages by a distributed merge sort of suffixes.

A string of ``length`` bytes is removed where it also starts in a document
with a smaller id. Every such window has an anchor: the smallest hash among
its ``gram``-byte substrings that start in its first bytes (upper 43 bits), the leftmost on
ties. Equal windows have equal anchors, so only suffixes at anchors are sorted,
each with the bytes to its left that belong to windows of that anchor.

1. Documents are dealt into blocks, a bucketed table in the warehouse: later
   steps read their block again without a shuffle.
2. Blocks send the distinct hashes of their anchors to shards and learn which
   ones occur in another block, and which have very many contexts.
3. Of the other anchors nothing repeats. For the rest each block sorts its
   suffixes, drops copies, and sends each shard a sorted front-coded run.
   Windows of anchors with very many contexts are suffixes of their own,
   dealt out by their whole content, so no shard gets a hot anchor whole.
4. A shard merges its runs with a loser tree that carries common-prefix
   lengths: bytes known to be equal are never compared again. Neighbours that
   share the anchor are resolved window by window, on the bytes themselves.
5. Blocks read for each suffix which windows occur in an earlier document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from flowloom.llm.common import as_key, cut, encoded, mix, pack, pack_sorted, shards, spread_keys, unpack, unpack_sorted
from flowloom.runtime import write_table

LENGTH, GRAM = 50, 20
REACH = LENGTH - GRAM + 1          # windows that one anchor can have: fits 32 bits
ROW = LENGTH + 1 + REACH - 1 + 1   # right part, its length, left part backwards, its length
MANY = 4096                        # contexts from which on an anchor's windows go by content
PIECE = 1 << 19
FINER = 4                          # blocks for each shard
NO_ID = np.iinfo(np.int64).max

_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_PLACE = np.uint64(4 * PIECE - 1)  # PIECE + LENGTH - 1 places fit


def _grams(data: np.ndarray) -> np.ndarray:
    """Hashes of the ``GRAM``-byte strings from each byte on, by doubling."""
    h, width, factor, total = _TABLE[data], 1, int(_STEP), None
    while width <= GRAM:
        if GRAM & width:  # binary digits of GRAM, from the lowest
            total = h.copy() if total is None else h[:len(total) - width] * _STEP + total[width:]
        h = h[:-width] * np.uint64(factor) + h[width:] if len(h) > width else h[:0]
        factor = factor * factor * 3 % (1 << 64)
        width *= 2
    return mix(total) if total is not None and len(data) >= GRAM else np.zeros(0, np.uint64)


def _pieces(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, anchor, first window, last window) of each run of windows that
    have one anchor, for the texts ``flat[start:end]``."""
    for at in range(0, len(flat), PIECE):
        data = flat[at:at + PIECE + LENGTH - 1]
        if len(data) < LENGTH:
            break
        h = _grams(data)
        # The place fills the lower bits, so the least number is the leftmost least hash.
        low, step = h & ~_PLACE | np.arange(len(h), dtype=np.uint64), 1
        while 2 * step <= REACH:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if REACH > step:
            low = np.minimum(low[:step - REACH], low[REACH - step:])
        n = min(len(low), PIECE)
        # Windows lie inside one text.
        i, j = np.searchsorted(ends, [at, at + n - 1], side="right")
        some = ends[i:j + 1]
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, np.clip(some - LENGTH + 1 - at, 0, n), 1)  # windows that begin from here on reach beyond their text
        np.add.at(edge, np.clip(some - at, 0, n), -1)
        valid = np.cumsum(edge[:n]) == 0
        p = np.flatnonzero(valid)
        if not len(p):
            continue
        a = (low[p] & _PLACE).astype(np.int64) + at
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)])
        first = np.flatnonzero(new)
        stop = np.append(first[1:], len(p)) - 1
        yield h[a[first] - at], a[first], p[first] + at, p[stop] + at


class Block:
    """The texts of a block and its anchors."""

    def __init__(self, ids: np.ndarray, texts: list[bytes]):
        self.ids = ids
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        # Empty texts have no windows; their equal ends must not hide the next text.
        full = lengths > 0
        self.flat = np.frombuffer(b"".join(texts), np.uint8)
        parts = list(_pieces(self.flat, self.starts[full], self.ends[full])) or [(np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3]
        self.hash, self.anchor, self.first, self.last = (np.concatenate(x) for x in zip(*parts))
        # The hash of an anchor is a minimum, so it is small; shards are ranges.
        self.hash = mix(self.hash)
        owner = np.searchsorted(self.ends[full], self.first, side="right")
        self.doc = ids[full][owner] if len(owner) else np.zeros(0, np.int64)
        self.keys, self.which = np.unique(self.hash, return_inverse=True)

    def contexts(self) -> np.ndarray:
        """Runs of each key: an upper bound of its distinct contexts here."""
        return np.bincount(self.which, minlength=len(self.keys))

    def repeats_here(self) -> np.ndarray:
        """Keys that occur in two documents of this block."""
        low = np.full(len(self.keys), NO_ID)
        high = np.full(len(self.keys), np.iinfo(np.int64).min)
        np.minimum.at(low, self.which, self.doc)
        np.maximum.at(high, self.which, self.doc)
        return low < high

    def suffixes(self, shared: np.ndarray, many: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        """Sorted distinct rows (shard, suffix) of the candidates; for each
        occurrence its row, first window, last window and document."""
        keep = (shared | self.repeats_here())[self.which]
        hot = keep & many[self.which]
        keep &= ~hot
        h, a, p, q, doc = (x[keep] for x in (self.hash, self.anchor, self.first, self.last, self.doc))
        if hot.any():
            size = (self.last - self.first + 1)[hot]
            at = np.repeat(self.first[hot], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            a, p, q = (np.concatenate([x, at]) for x in (a, p, q))
            doc = np.concatenate([doc, np.repeat(self.doc[hot], size)])
        rows = np.zeros((len(a), 2 + ROW), np.uint8)
        right, left = q + LENGTH - a, a - p
        steps = np.arange(LENGTH)
        padded = np.concatenate([self.flat, np.zeros(LENGTH, np.uint8)])
        for at in range(0, len(a), 50_000):
            s = slice(at, at + 50_000)
            rows[s, 2:2 + LENGTH] = np.where(steps < right[s, None], padded[a[s, None] + steps], 0)
            back = steps[:REACH - 1]
            rows[s, 3 + LENGTH:2 + ROW - 1] = np.where(back < left[s, None], self.flat[np.maximum(a[s, None] - 1 - back, 0)], 0)
        rows[:, 2 + LENGTH] = right
        rows[:, 1 + ROW] = left
        if hot.any():
            own = np.zeros(len(a) - len(h), np.uint64)
            for j in range(LENGTH):
                own = own * _STEP + _TABLE[rows[len(h):, 2 + j]]
            h = np.concatenate([h, mix(own)])
        shard = ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
        rows[:, 0], rows[:, 1] = shard >> 8, shard & 255
        order = np.argsort(rows.view(f"S{2 + ROW}").ravel()) if len(rows) else np.zeros(0, np.int64)
        rows = rows[order]
        new = np.ones(len(rows), bool)
        if len(rows):
            new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        which = np.empty(len(rows), np.int64)
        which[order] = np.cumsum(new) - 1
        return rows[new], which, p, q, doc


def _front_code(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common prefix with the row before, and the bytes beyond it."""
    known = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        known[1:] = (rows[1:] != rows[:-1]).argmax(axis=1)
    return known.astype(np.uint8), rows[np.arange(rows.shape[1]) >= known[:, None]]


def _run(known: bytes, tails: bytes) -> Iterator[tuple[int, bytes]]:
    row, at = b"", 0
    for k in known:
        row = row[:k] + tails[at:at + ROW - k]
        at += ROW - k
        yield k, row


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two rows that share ``known`` bytes."""
    x = int.from_bytes(a[known:]) ^ int.from_bytes(b[known:])
    return ROW - (x.bit_length() + 7) // 8


def merge(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, int, bytes]]:
    """(run, common prefix with the row before, row) in order, by a loser tree.

    Each head carries its common prefix with the last row put out. The head
    with the longer one is smaller; only equal ones are compared, from there on.
    """
    n = len(runs)
    rows: list[bytes] = [b""] * n
    known = [-1] * n  # -1: the run has ended

    def advance(r: int) -> None:
        known[r], rows[r] = next(runs[r], (-1, b""))

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's prefix is then with the winner."""
        x, y = known[a], known[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0 or x == ROW:
            return (a, b) if a < b else (b, a)
        left, right = rows[a], rows[b]
        if left <= right:
            known[b] = _common(left, right, x)
            return a, b
        known[a] = _common(left, right, x)
        return b, a

    losers = [0] * n

    def build(node: int) -> int:
        if node >= n:
            return node - n
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    for r in range(n):
        advance(r)
    best = build(1) if n > 1 else 0
    while n and known[best] >= 0:
        yield best, known[best], rows[best]
        advance(best)
        node = (best + n) >> 1
        while node:
            o = losers[node]
            x, y = known[best], known[o]
            if y > x:
                losers[node], best = best, o
            elif x == y and x >= 0:
                best, losers[node] = play(best, o)
            node >>= 1


def _resolve(group: list[tuple[int, int, bytes]], earliest: list[np.ndarray], masks: list[np.ndarray]) -> None:
    """Sets the windows of each row of one anchor that occur in a document
    before the row's own. group: (run, number in the run, row)."""
    if len(group) == 1:
        return
    distinct = len({row for _, _, row in group})
    if distinct == 1:
        low = min(earliest[r][i] for r, i, _ in group)
        row = group[0][2]
        windows = row[LENGTH] + row[ROW - 1] - LENGTH + 1
        for r, i, _ in group:
            if earliest[r][i] > low:
                masks[r][i] = (1 << windows) - 1
        return
    first: dict[bytes, int] = {}
    texts = []
    for r, i, row in group:
        text = row[ROW - 2 - REACH + 1 + row[ROW - 1]:LENGTH:-1] + row[:row[LENGTH]] if row[ROW - 1] else row[:row[LENGTH]]
        texts.append(text)
        doc = earliest[r][i]
        for p in range(len(text) - LENGTH + 1):
            w = text[p:p + LENGTH]
            if first.setdefault(w, doc) > doc:
                first[w] = doc
    for (r, i, _), text in zip(group, texts):
        doc, mask = earliest[r][i], 0
        for p in range(len(text) - LENGTH + 1):
            if first[text[p:p + LENGTH]] < doc:
                mask |= 1 << p
        masks[r][i] = mask


def _anchor_shard(table: pa.Table, most: int) -> pa.Table:
    """Which keys of each block are in another block, or have many contexts."""
    keys = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
    counts = [unpack(x, np.uint32) for x in table.column("counts").to_pylist()]
    every, where = np.unique(np.concatenate(keys), return_inverse=True)
    blocks = np.bincount(where, minlength=len(every)) > 1
    many = np.bincount(where, weights=np.concatenate(counts), minlength=len(every)) > most
    data, at = [], 0
    for k in keys:
        w = where[at:at + len(k)]
        at += len(k)
        data.append(pack(np.packbits(np.concatenate([blocks[w], many[w]]))))
    return pa.table({"block": table.column("block"), "kind": pa.array([0] * len(keys), pa.int32()),
                     "part": table.column("part"), "n": pa.array([len(k) for k in keys], pa.int64()), "data": pa.array(data, pa.binary())})


def _suffix_shard(table: pa.Table) -> pa.Table:
    """For each row of each run a bit for each window seen in an earlier document."""
    known = [zstandard.decompress(x) for x in table.column("known").to_pylist()]
    tails = [zstandard.decompress(x) for x in table.column("tails").to_pylist()]
    earliest = [unpack(x, np.int64).tolist() for x in table.column("docs").to_pylist()]
    masks = [[0] * len(x) for x in earliest]
    seen = [0] * len(known)
    group: list[tuple[int, int, bytes]] = []
    for run, prefix, row in merge([_run(k, t) for k, t in zip(known, tails)]):
        if prefix < GRAM and group:
            _resolve(group, earliest, masks)
            group = []
        group.append((run, seen[run], row))
        seen[run] += 1
    _resolve(group, earliest, masks)
    return pa.table({"block": table.column("block"), "kind": pa.array([1] * len(known), pa.int32()), "part": table.column("part"),
                     "n": pa.array([len(m) for m in masks], pa.int64()),
                     "data": pa.array([pack(np.array(m, np.uint32)) for m in masks], pa.binary())})


ANSWER = "block int, kind int, part int, n long, data binary"


def _block(table: pa.Table) -> Block:
    ids = table.column("doc_id").combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False)
    return Block(ids.astype(np.int64), encoded(table.column("text")))


def _flags(block: Block, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    parts = sorted((r for r in answers.to_pylist() if r["kind"] == 0), key=lambda r: r["part"])
    bits = [np.unpackbits(unpack(r["data"], np.uint8), count=2 * r["n"]).astype(bool) for r in parts]
    none = [np.zeros(0, bool)]
    shared = np.concatenate(none + [b[:r["n"]] for b, r in zip(bits, parts)])
    many = np.concatenate(none + [b[r["n"]:] for b, r in zip(bits, parts)])
    if len(shared) != len(block.keys):
        raise RuntimeError("a block's text changed between two steps")
    return shared, many


def repeated_passages(docs: DataFrame, whole_characters: bool = False, many: int = MANY) -> DataFrame:
    """(doc_id, n_bytes, spans array of (start, end), kept binary, rest struct)
    for each row of ``docs``, ``rest`` holding its other columns.

    Offsets count UTF-8 bytes; with ``whole_characters`` the rest of a character
    that is cut in part is left out of ``kept``. A null text is empty; a text below ``LENGTH``
    bytes is kept. ``many`` changes how work is dealt out, not the result. Rows with the same id count as one document, so they remove
    nothing from each other; a null id counts as larger than all others. An
    empty table gives an empty result. The blocks stay in the warehouse, as
    table ``suffix_blocks_*``, as long as the result is read from them.
    """
    spark = docs.sparkSession
    n = min(shards(spark), 1 << 13)
    keys, homes = spread_keys(spark, n), spread_keys(spark, FINER * n)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(None).cast("string").alias("none"))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("rest"))
    dealt = dealt.withColumn("block", as_key(F.pmod(F.xxhash64("doc_id", "text"), F.lit(FINER * n)), homes))
    name = f"suffix_blocks_{uuid.uuid4().hex}"
    dealt.repartition(FINER * n, "block").write.option("compression", "zstd").bucketBy(FINER * n, "block").saveAsTable(name)
    blocks = spark.table(name)

    def send_anchors(table: pa.Table) -> pa.Table:
        block = _block(table)
        bounds, counts = cut(block.keys, n), block.contexts().astype(np.uint32)
        parts = [i for i in range(n) if bounds[i] < bounds[i + 1]]
        own = table.column("block")[0].as_py()
        return pa.table({
            "shard": pa.array([keys[i] for i in parts], pa.int32()), "part": pa.array(parts, pa.int32()),
            "block": pa.array([own] * len(parts), pa.int32()),
            "keys": pa.array([pack_sorted(block.keys[bounds[i]:bounds[i + 1]]) for i in parts], pa.binary()),
            "counts": pa.array([pack(counts[bounds[i]:bounds[i + 1]]) for i in parts], pa.binary())})

    def send_suffixes(table: pa.Table, answers: pa.Table) -> pa.Table:
        parts: list[int] = []
        coded: list[tuple[bytes, bytes, bytes]] = []
        if table.num_rows:
            block = _block(table)
            rows, which, _, _, doc = block.suffixes(*_flags(block, answers), n)
            low = np.full(len(rows), NO_ID)
            np.minimum.at(low, which, doc)
            shard = rows[:, 0].astype(np.int64) << 8 | rows[:, 1]
            bounds = np.searchsorted(shard, np.arange(n + 1))
            for i in range(n):
                s = slice(bounds[i], bounds[i + 1])
                if s.start < s.stop:
                    known, tails = _front_code(rows[s, 2:])
                    parts.append(i)
                    coded.append((zstandard.compress(known.tobytes(), 3), zstandard.compress(tails.tobytes(), 3), pack(low[s])))
        own = table.column("block")[0].as_py() if table.num_rows else 0
        return pa.table({
            "shard": pa.array([keys[i] for i in parts], pa.int32()), "part": pa.array(parts, pa.int32()),
            "block": pa.array([own] * len(parts), pa.int32()),
            **{k: pa.array([c[j] for c in coded], pa.binary()) for j, k in enumerate(("known", "tails", "docs"))}})

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = _block(table)
        rows, which, p, q, doc = block.suffixes(*_flags(block, answers), n)
        low = np.full(len(rows), NO_ID)
        np.minimum.at(low, which, doc)
        parts = sorted((r for r in answers.to_pylist() if r["kind"] == 1), key=lambda r: r["part"])
        masks = np.concatenate([np.zeros(0, np.uint32)] + [unpack(r["data"], np.uint32) for r in parts])[which]
        full = doc > low[which]
        edge = np.zeros(len(block.flat) + 1, np.int32)
        np.add.at(edge, p[full], 1)
        np.add.at(edge, q[full] + LENGTH, -1)
        some = np.flatnonzero(~full & (masks > 0))
        for bit in range(REACH):
            at = p[some][(masks[some] >> np.uint32(bit)) & 1 > 0] + bit
            np.add.at(edge, at, 1)
            np.add.at(edge, at + LENGTH, -1)
        gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
        starts, ends = block.starts, block.ends
        # Runs of removed bytes, cut where a text begins.
        turn = gone & np.concatenate([[True], ~gone[:-1]]) if len(gone) else gone
        inner = starts[(starts > 0) & (starts < len(gone))]
        turn[inner] |= gone[inner]
        stop = gone & np.concatenate([~gone[1:], [True]]) if len(gone) else gone
        stop[inner - 1] |= gone[inner - 1]
        begin, end = np.flatnonzero(turn), np.flatnonzero(stop) + 1
        lo, hi = np.searchsorted(begin, starts), np.searchsorted(begin, ends)
        spans = [[{"start": int(b - s), "end": int(e - s)} for b, e in zip(begin[i:j], end[i:j])] for s, i, j in zip(starts, lo, hi)]
        kept = [block.flat[s:e][~gone[s:e]].tobytes() for s, e in zip(starts, ends)]
        if whole_characters:
            kept = [k.decode("utf-8", "ignore").encode() for k in kept]
        return pa.table([table.column("doc_id"), pa.array(ends - starts), pa.array(spans, span), pa.array(kept, pa.binary()),
                         table.column("rest")], ["doc_id", "n_bytes", "spans", "kept", "rest"])

    def find_shared(table: pa.Table) -> pa.Table:
        return _anchor_shard(table, many)

    sent = blocks.select("block", "doc_id", "text").groupBy("block").applyInArrow(
        send_anchors, "shard int, part int, block int, keys binary, counts binary")
    known = write_table(sent.repartition(n, "shard").groupBy("shard").applyInArrow(find_shared, ANSWER), "anchor_answers")
    runs = blocks.select("block", "doc_id", "text").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        send_suffixes, "shard int, part int, block int, known binary, tails binary, docs binary")
    found = write_table(runs.repartition(n, "shard").groupBy("shard").applyInArrow(_suffix_shard, ANSWER), "suffix_answers")
    answers = known.unionByName(found)
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("kept", T.BinaryType()), T.StructField("rest", blocks.schema["rest"].dataType)])
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(remove, schema)
