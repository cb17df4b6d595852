"""Near copies by word shingles: ball hashing of several short SimHashes, then
an exact check.

Texts with the same set of shingles are one class. Each class has ``REPEATS``
independent SimHashes of 32 bits; in each repeat it sends its record to shards,
which find all variants within ``RADIUS / 2`` flips of it.

First the classes that meet on a variant are compared by the bits of all repeats
together: all pairs of up to ``FEW``, else each with the first one there and with
the one before it. A shard keeps the closest partner on either side of each class
(by key): two rows a class at most, however many meet. The closest of all shards
are checked on the whole sets, and links that hold are joined. Classes that may have
further partners are marked.

Then the marked classes meet once more, with the groups they are in by now: every
pair of different groups is checked as well, so no pair that meets is left out. Pairs
inside a group change nothing and are not formed, so a large group of near copies costs little.
Nor do pairs travel: a shard puts out the classes that have such a pair, once each, their sets
are brought to it, and it joins what holds, so it puts out fewer links than classes.

Two texts of similarity 0.8 differ in 15% of the bits, so a repeat finds them with
a chance of 0.46 and six with 0.975; at 0.9 it is 0.9998.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from flowloom.llm.common import encoded, mix, shards, slim, spread_keys
from flowloom.llm.components import components
from flowloom.llm.simhash import Cosets, _join, masks
from flowloom.runtime import write_table

WORDS, LEAST = 5, (4, 5)  # similarity as a fraction
REPEATS, WIDTH, RADIUS = 6, 32, 4
MOST_BITS = 48            # of all repeats; pairs at 0.8 differ in 29, with deviation 5
SHARD_ROWS = 1 << 23      # what one task may get: 256 MB
SLICE_VARIANTS = 1 << 21
FEW = 16
MOST_PAIRS = 1 << 20      # that a task holds at once
MOST_HASHES = 1 << 23     # of the sets that are compared at once: 32 MB
RECORD = np.dtype([("key", "<u8"), ("fp", "<u4", (REPEATS,))])
GROUPED = np.dtype([*RECORD.descr, ("root", "<i8")])
SIZED = np.dtype([*GROUPED.descr, ("size", "<i8")])
FPS = [f"fp{k}" for k in range(REPEATS * WIDTH // 64)]  # two fingerprints in each number


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes; fewer words are one shingle, none is none."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    n = max(1, len(parts) - words + 1)
    line = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    ends = ends[min(words, len(parts)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b], 5) for a, b in zip(starts, ends)), np.uint64, n))


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    """``REPEATS`` SimHashes of a set, two in a number: bits set in over half of the hashes."""
    n, out = len(hashes), []
    for k in range(len(FPS)):
        counts = np.zeros(64, np.int64)
        for at in range(0, n, 1 << 14):  # bounds memory on very long texts
            part = mix(hashes[at:at + (1 << 14)] + np.uint64(k))
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * counts > n, bitorder="little"))
    return np.concatenate(out).view("<i8")


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, node long, fp0 to fp2 long, size long, hashes binary) of each row: the key of its
    set of shingles, its fingerprints, and the upper halves of the hashes with their number."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for b in slim(whole, 500):
                sets = [shingles(t, words) for t in encoded(b.column("text"))]
                keys = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64)
                fps = np.stack([fingerprints(s) for s in sets])
                halves = [np.unique(s >> np.uint64(32)).astype(np.uint32) for s in sets]
                yield pa.record_batch([
                    b.column("doc_id"), pa.array(keys.view(np.int64)), *[pa.array(fps[:, k]) for k in range(len(FPS))],
                    pa.array([len(h) for h in halves], pa.int64()), pa.array([h.tobytes() for h in halves], pa.binary())],
                    ["doc_id", "node", *FPS, "size", "hashes"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, f"doc_id long, node long, {', '.join(f'{c} long' for c in FPS)}, size long, hashes binary")


def shard_bits(rows: int, variants: int) -> int:
    """2^3 shards a repeat, and more where a shard would get over ``SHARD_ROWS``."""
    bits = 3
    while rows * min(1.0, variants / 2**bits) > SHARD_ROWS:
        bits += 1
    return bits


class Closest:
    """The closest partner found of each node, ties to the smaller one, and
    whether there are others."""

    def __init__(self, n: int) -> None:
        self.bits, self.partner = np.full(n, 1 << 15, np.int64), np.full(n, -1, np.int64)
        self.others = np.zeros(n, bool)

    def offer(self, node: np.ndarray, partner: np.ndarray, bits: np.ndarray) -> None:
        self.others[node[(self.partner[node] >= 0) & (self.partner[node] != partner)]] = True
        order = np.lexsort((partner, bits, node))
        node, partner, bits = node[order], partner[order], bits[order]
        first = np.diff(node, prepend=-1) != 0
        self.others[node[~first]] = True  # the pairs of an offer are distinct
        node, partner, bits = node[first], partner[first], bits[first]
        better = (bits < self.bits[node]) | ((bits == self.bits[node]) & (partner < self.partner[node]))
        self.bits[node[better]], self.partner[node[better]] = bits[better], partner[better]


class Shards:
    """Where the classes of a table meet: ``record`` is what travels of each."""

    def __init__(self, classes: DataFrame, record: np.dtype) -> None:
        flips, count = masks(RADIUS // 2, WIDTH), classes.count()
        self.record, self.bits = record, shard_bits(count, len(flips))
        self.fine = max(0, int(count * len(flips) / 2**self.bits / SLICE_VARIANTS).bit_length())
        self.homes = spread_keys(classes.sparkSession, min(REPEATS << self.bits, 1 << 13))
        self.sent = classes.mapInArrow(self.scatter, "home int, shard int, rows binary").repartition(len(self.homes), "home").groupBy("home", "shard")

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "sent"}

    def cosets(self) -> Cosets:
        return Cosets(masks(RADIUS // 2, WIDTH), self.bits, self.fine)

    def scatter(self, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cosets, home = self.cosets(), np.array(self.homes)
        for whole in parts:
            for b in slim(whole, 4096):
                rows = np.zeros(b.num_rows, self.record)
                rows["key"] = b.column("node").to_numpy(zero_copy_only=False).view(np.uint64)
                rows["fp"] = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in FPS], axis=1).view("<u4")
                for c in self.record.names[2:]:
                    rows[c] = b.column(c).to_numpy(zero_copy_only=False)
                for repeat in range(REPEATS):
                    cell = cosets.cell(rows["fp"][:, repeat].astype(np.uint64)) >> self.fine
                    shard = (cell[:, None] ^ cosets.shards[None, :]).ravel()
                    order = np.argsort(shard, kind="stable")
                    shard, sent = shard[order] + (repeat << self.bits), rows[order // len(cosets.shards)]
                    first = np.flatnonzero(np.diff(shard, prepend=-1))
                    data = [sent[i:j].tobytes() for i, j in zip(first, np.append(first[1:], len(shard)))]
                    yield pa.record_batch([pa.array(home[shard[first] % len(home)], pa.int32()), pa.array(shard[first], pa.int32()),
                                           pa.array(data, pa.binary())], ["home", "shard", "rows"])

    def read(self, shard: int, blocks: list[bytes]) -> tuple[int, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
        """The repeat of a shard, its classes by key, and the slices of their variants."""
        rows = np.concatenate([np.frombuffer(x, self.record) for x in blocks])
        rows = rows[np.unique(rows["key"], return_index=True)[1]]
        return shard >> self.bits, rows, self.slices(shard, rows)

    def slices(self, shard: int, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """In slices, the variants that several classes of a shard may have, sorted, with the
        number of each one's owner."""
        repeat, shard = divmod(shard, 1 << self.bits)
        cosets, values = self.cosets(), rows["fp"][:, repeat].astype(np.uint64)
        cells = cosets.cell(values)
        for part in range(1 << self.fine):
            variant, owner = cosets.variants(values, cells, shard << self.fine | part)
            ordered = np.sort(variant)
            shared = ordered[1:][ordered[1:] == ordered[:-1]]
            marks = np.zeros(1 << 22, bool)  # leaves few variants that only one class has
            marks[mix(shared) >> np.uint64(42)] = True
            keep = marks[mix(variant) >> np.uint64(42)]
            variant, owner = variant[keep], owner[keep]
            order = np.argsort(variant, kind="stable")  # owners rise within a variant
            yield variant[order], owner[order]

    def across(self, shard: int, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs a < b (numbers of rows) of different roots that meet in the shard, differ in at
        most ``MOST_BITS`` and, where sizes are known, may be similar by them. A pair that meets
        in several places counts in one of them."""
        repeat = shard >> self.bits
        fp = np.ascontiguousarray(rows["fp"])
        every, rank = fp.view(np.uint64), np.unique(rows["root"], return_inverse=True)[1]

        def checked(i: np.ndarray, j: np.ndarray, variant: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            a, b = np.minimum(i, j), np.maximum(i, j)
            good = np.bitwise_count(every[a] ^ every[b]).sum(axis=1, dtype=np.int64) <= MOST_BITS
            if "size" in rows.dtype.names:
                x, y = rows["size"][a], rows["size"][b]
                good &= np.minimum(x, y) * LEAST[1] >= np.maximum(x, y) * LEAST[0]
            a, b, variant = a[good], b[good], variant[good]
            good = np.argmax(np.bitwise_count(fp[a] ^ fp[b]) <= RADIUS, axis=1) == repeat
            good &= _middle(fp[a, repeat], fp[b, repeat]) == variant
            return a[good], b[good]

        for variant, owner in self.slices(shard, rows):
            order = np.lexsort((rank[owner], variant))
            variant, owner = variant[order], owner[order]
            end = _runs(variant)[1]
            run = np.concatenate([[True], (variant[1:] != variant[:-1]) | (rank[owner[1:]] != rank[owner[:-1]])])[:len(owner)]
            at = np.arange(len(owner))
            after = _runs(np.cumsum(run))[1]  # the first entry of another group
            waiting, n = [], 0
            while len(at := at[after[at] < end[at]]):
                for some in np.array_split(at, -(-len(at) // MOST_PAIRS)):
                    waiting.append((owner[some], owner[after[some]], variant[some]))
                    n += len(some)
                    if n >= MOST_PAIRS:
                        yield checked(*(np.concatenate(x) for x in zip(*waiting)))
                        waiting, n = [], 0
                after[at] += 1
            if waiting:
                yield checked(*(np.concatenate(x) for x in zip(*waiting)))


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of sorted values, where its run begins and ends."""
    start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[:len(values)])
    size = np.diff(np.append(start, len(values)))
    return np.repeat(start, size), np.repeat(start + size, size)


def candidates(classes: DataFrame) -> DataFrame:
    """Rows (node, fp0 to fp2) to pairs (a, b, bits, more), a < b as unsigned numbers: of each
    node and shard the closest partner below and above it. ``more`` is 1 if a may have others,
    plus 2 if b may. A node that may have partners, but none was found, comes with itself."""
    where = Shards(classes, RECORD)

    def meet(table: pa.Table) -> pa.Table:
        _, rows, slices = where.read(table.column("shard")[0].as_py(), table.column("rows").to_pylist())
        every, n = np.ascontiguousarray(rows["fp"]).view(np.uint64), len(rows)
        below, above, crowded = Closest(n), Closest(n), np.zeros(n, bool)
        for variant, owner in slices:
            first, end = _runs(variant)
            crowd = end - first > FEW
            crowded[owner[crowd]] = True
            at = np.flatnonzero(crowd & (first < np.arange(len(owner))))
            found = [owner[first[at]] * n + owner[at], owner[at - 1] * n + owner[at]]
            at = np.flatnonzero(~crowd)
            for step in range(1, FEW):
                at = at[at + step < end[at]]
                found.append(owner[at] * n + owner[at + step])
            a, b = np.divmod(np.unique(np.concatenate(found)), max(1, n))
            apart = np.bitwise_count(every[a] ^ every[b]).sum(axis=1, dtype=np.int64)
            good = (apart <= MOST_BITS) & (a != b)
            below.offer(b[good], a[good], apart[good])
            above.offer(a[good], b[good], apart[good])
        more = below.others | above.others | crowded
        one, two = np.flatnonzero(below.partner >= 0), np.flatnonzero(above.partner >= 0)
        alone = np.flatnonzero(crowded & (below.partner < 0) & (above.partner < 0))
        pairs = np.unique(np.concatenate([below.partner[one] * n + one, two * n + above.partner[two], alone * n + alone]))
        a, b = np.divmod(pairs, max(1, n))
        apart = np.bitwise_count(every[a] ^ every[b]).sum(axis=1, dtype=np.int32)
        key = rows["key"].view(np.int64)
        return pa.table({"a": key[a], "b": key[b], "bits": apart, "more": more[a] + 2 * more[b].astype(np.int32)})

    return where.sent.applyInArrow(meet, "a long, b long, bits int, more int")


def _middle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the variants that two fingerprints have in common, one that is fixed by the two."""
    apart, out = a ^ b, a.copy()
    low = apart & (~apart + np.uint32(1))
    far = np.bitwise_count(apart)
    out[far >= 2] ^= low[far >= 2]
    apart ^= low
    low = apart & (~apart + np.uint32(1))
    out[far >= 4] ^= low[far >= 4]
    return out


def other_groups(classes: DataFrame) -> DataFrame:
    """Rows (node, fp0 to fp2, root) to all pairs (a, b) of different roots that meet on a variant
    and differ in at most ``MOST_BITS``, each pair once. They may grow with the square of a group."""
    where = Shards(classes, GROUPED)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = _gathered(where, batches)
        key = rows["key"].view(np.int64)
        for a, b in where.across(shard, rows):
            yield pa.record_batch([pa.array(key[a]), pa.array(key[b])], ["a", "b"])

    return where.sent.applyInArrow(meet, "a long, b long")


def _gathered(where: Shards, batches: Iterator[pa.RecordBatch]) -> tuple[int, np.ndarray]:
    held = [(b.column("shard")[0].as_py(), b.column("rows").to_pylist()) for b in batches if b.num_rows]
    return held[0][0], where.read(held[0][0], [x for _, blocks in held for x in blocks])[1]


def _bins(parent: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows (number, bin, part, block), the members of each tree of ``parent`` together in bins of
    about ``MOST_HASHES``. A larger tree is cut into blocks, and any two blocks make a part."""
    member = np.flatnonzero(np.bincount(parent, minlength=len(parent))[parent] > 1)
    member = member[np.argsort(parent[member], kind="stable")]
    tree = np.cumsum(np.diff(parent[member], prepend=-1) != 0) - 1
    first = np.flatnonzero(np.diff(tree, prepend=-1))
    start = np.cumsum(size[member]) - size[member]
    block = (start - start[first][tree]) // MOST_HASHES
    blocks = np.maximum.reduceat(block, first)[tree] + 1 if len(first) else block
    at, other = np.arange(len(member)).repeat(blocks), _places(blocks)
    low, high = np.minimum(block[at], other), np.maximum(block[at], other)
    return member[at], (start[first] // MOST_HASHES)[tree][at], high * (high + 1) // 2 + low, block[at]


def _places(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


MET = f"home int, shard int, bin long, part long, block long, node long, root long, {', '.join(f'{c} long' for c in FPS)}"


def meetings(where: Shards) -> DataFrame:
    """The classes of each shard that have a pair in ``Shards.across``: one row a class and shard
    at most, but for trees of such pairs with over ``MOST_HASHES``."""
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = _gathered(where, batches)
        parent = np.arange(len(rows))
        for a, b in where.across(shard, rows):
            parent = _join(parent, a, b)
        at, bins, part, block = _bins(parent, rows["size"])
        home = np.array(where.homes)[(shard + bins + part) % len(where.homes)]
        fps = np.ascontiguousarray(rows["fp"]).view("<i8")
        for k in range(0, len(at), 1 << 16):
            some = slice(k, k + (1 << 16))
            columns = [home[some], np.full(len(at[some]), shard), bins[some], part[some], block[some], rows["key"].view(np.int64)[at[some]],
                       rows["root"][at[some]], *fps[at[some]].T]
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * (len(columns) - 2)]
            yield pa.record_batch([pa.array(np.ascontiguousarray(c), t) for c, t in zip(columns, kinds)],
                                  ["home", "shard", "bin", "part", "block", "node", "root", *FPS])

    return where.sent.applyInArrow(meet, MET)


def joined(met: DataFrame, where: Shards) -> DataFrame:
    """Rows of ``meetings`` with their sets (hashes) to links (a, b) that hold: the pairs of a part
    that hold have, with the roots, the same components as these. Fewer links than rows."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([b for b in batches if b.num_rows])
        table = table.take(np.unique(table.column("node").to_numpy().view(np.uint64), return_index=True)[1])
        sets = [np.frombuffer(x, np.uint32) for x in table.column("hashes").to_pylist()]
        rows = np.zeros(len(sets), SIZED)
        rows["key"], rows["root"] = table.column("node").to_numpy().view(np.uint64), table.column("root").to_numpy()
        rows["fp"] = np.stack([table.column(c).to_numpy() for c in FPS], axis=1).view("<u4")
        rows["size"] = size = np.array([len(x) for x in sets])
        block, shard = table.column("block").to_numpy(), table.column("shard")[0].as_py()
        cut = block.min() != block.max()  # pairs of one block are those of another part
        del table
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
        sets = np.split(ids, np.cumsum(size)[:-1])
        has, group = np.zeros(ids.max(initial=0) + 1, bool), np.unique(rows["root"], return_inverse=True)[1]
        key, links = rows["key"].view(np.int64), []
        for a, b in where.across(shard, rows):
            if cut:
                a, b = a[block[a] != block[b]], b[block[a] != block[b]]
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            bounds = np.flatnonzero(np.diff(a, prepend=-1, append=len(sets)))
            for first, end in zip(bounds[:-1], bounds[1:]):
                one = a[first]
                has[sets[one]] = True
                for at in range(first, end, 64):
                    with_ = b[at:min(at + 64, end)]
                    with_ = with_[group[with_] != group[one]]
                    if not len(with_):
                        continue
                    both = np.add.reduceat(has[np.concatenate([sets[i] for i in with_])], np.cumsum(size[with_]) - size[with_], dtype=np.int64)
                    with_ = with_[both * LEAST[1] >= LEAST[0] * (size[one] + size[with_] - both)]
                    found, place = np.unique(group[with_], return_index=True)
                    links += [(key[one], key[i]) for i in with_[place]]
                    group[np.isin(group, found)] = group[one]
                has[sets[one]] = False
        links = np.array(links, np.int64).reshape(-1, 2)
        yield pa.record_batch([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    return met.repartition(len(where.homes), "home").groupBy("home", "shard", "bin", "part").applyInArrow(check, "a long, b long")


def _holds(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets are as similar as ``LEAST``."""
    for whole in parts:
        for batch in slim(whole, 500):
            good = []
            for x, y in zip(batch.column("of_a").to_pylist(), batch.column("of_b").to_pylist()):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both > 0 and both * LEAST[1] >= LEAST[0] * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _links(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) that hold, stored. Sets travel only where a class has a partner."""
    sets = _sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), rows, "first")
    of = lambda end: sets.select(F.col("node").alias(end), F.col("hashes").alias(f"of_{end}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "of_a", "of_b")
    return write_table(both.mapInArrow(_holds, "a long, b long"), "shingle_links_first")


def _sets(nodes: DataFrame, rows: DataFrame, step: str) -> DataFrame:
    """(node, hashes), stored, of the classes that are named."""
    met = write_table(nodes.distinct(), f"shingle_met_{step}")
    return write_table(rows.select("node", "hashes").join(met, "node", "left_semi").dropDuplicates(["node"]), f"shingle_sets_{step}")


def near_copies(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, node long, component_id) for each row of ``docs``.

    ``component_id`` is the smallest doc_id that a row reaches over links
    between sets of ``words``-word shingles of similarity 0.8 or more, itself
    included. Texts with equal sets are always linked, those without words too.
    Every link holds exactly, and every pair that meets in a repeat is joined if it
    holds; the chance to meet is as the module says. Repeated rows and ids
    each keep their row; a null id is never the smallest, so ``component_id`` is null
    only where all ids of the component are null. Extra columns are ignored, an
    empty table gives an empty result. Sets are told apart by 64 bits.
    """
    spark = docs.sparkSession
    rows = write_table(sketches(docs, words), "shingle_sketches")
    classes = write_table(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), *[F.min(c).alias(c) for c in [*FPS, "size"]]), "shingle_classes")
    pairs = write_table(candidates(classes.select("node", *FPS).repartition(shards(spark))), "shingle_pairs")
    met = pairs.filter("a <> b")
    sides = [met.groupBy(end).agg(F.min(F.struct("bits", other)).alias("m"), (F.min(other) != F.max(other)).alias("others"))
             for end, other in (("b", "a"), ("a", "b"))]
    closest = write_table(sides[0].select("m.a", "b").unionByName(sides[1].select("a", "m.b")).distinct(), "shingle_closest")
    links = _links(closest, rows)
    roots = components(links)
    marked = [pairs.filter("more & 1 = 1").select("a"), pairs.filter("more & 2 = 2").select("b"),
              *[side.filter("others").select(end) for end, side in zip("ba", sides)]]
    marked = reduce(DataFrame.union, marked).toDF("node").distinct()
    marked = write_table(classes.select("node", *FPS, "size").join(marked, "node", "left_semi").join(roots, "node", "left")
                         .withColumn("root", F.coalesce("root", "node")), "shingle_marked")
    if marked.head(1):
        where = Shards(marked.repartition(shards(spark)), SIZED)
        met = write_table(meetings(where), "shingle_meetings")
        more = write_table(joined(met.join(_sets(met.select("node"), rows, "more"), "node"), where), "shingle_links_more")
        if more.head(1):
            roots = components(links.unionByName(more))
    linked = classes.join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = linked.select("node", "root").join(smallest, "root").select("node", "component_id")
    return rows.select("doc_id", "node").join(named, "node").select("doc_id", "node", "component_id")
