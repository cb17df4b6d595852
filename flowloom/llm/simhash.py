"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has one bit for each of 64 positions that is set in over half of
the hashes of its word shingles. Two fingerprints at distance ``radius`` or
less have a common variant within ``radius / 2`` bit flips of both. So every
distinct fingerprint sends all such variants to shards; the fingerprints that
meet on a variant are within the radius of each other, and every link to the
smallest of them is verified. A shard joins what it links, so it puts out at
most one row for each fingerprint that it got.

Shards are cosets of a linear code: a shard gets the bare fingerprint (8 bytes)
and finds the variants that fall to it from a table of masks. So the number of
shards, not of variants, sets what is sent: 1 kB a fingerprint at 128 shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from flowloom.llm.common import encoded, mix, shards, slim, spread_keys
from flowloom.llm.components import components
from flowloom.runtime import write_table

SHARD_FINGERPRINTS = 1 << 25  # what one task may get: 256 MB
SHARD_VARIANTS = 1 << 28      # what one task may form, in slices of
SLICE_VARIANTS = 1 << 22


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """Zero if there are no words; fewer words than a shingle are one shingle."""
    parts = text.lower().split()
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    line = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    ends = ends[min(words, len(parts)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, ends)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):  # bounds memory on very long texts
        part = hashes[at:at + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp long) for each row; null and empty texts have fingerprint 0."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for b in slim(whole):
                fps = np.array([fingerprint(t, words) for t in encoded(b.column("text"))], np.uint64)
                yield pa.record_batch([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, fp long")


def masks(half: int, width: int = 64) -> np.ndarray:
    """All flips of at most ``half`` of the lower ``width`` bits."""
    return np.array([sum(1 << i for i in c) for k in range(half + 1) for c in combinations(range(width), k)], np.uint64)


class Cosets:
    """A linear map of variants to cells: ``cell(fp ^ mask) = cell(fp) ^ cell(mask)``.

    So whoever has a fingerprint finds its variants in a cell by a table of the
    masks by cell. A shard is the cells with the same upper ``bits``; the lower
    ``fine`` bits cut its work into slices.
    """

    def __init__(self, flips: np.ndarray, bits: int, fine: int) -> None:
        size = 1 << (bits + fine)
        self.bits, self.fine = bits, fine
        self.columns = np.random.default_rng(bits).integers(1, size, 64, dtype=np.int64)
        cells = self.cell(flips)
        order = np.argsort(cells, kind="stable")
        self.flips = flips[order]
        self.starts = np.searchsorted(cells[order], np.arange(size + 1))
        self.shards = np.unique(cells >> fine)  # those of the masks themselves

    def cell(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), np.int64)
        for i, c in enumerate(self.columns.tolist()):
            out ^= ((values >> np.uint64(i)) & np.uint64(1)).astype(np.int64) * c
        return out

    def variants(self, values: np.ndarray, cells: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray]:
        """The variants in ``cell`` and, rising, the number of each one's owner."""
        start = self.starts[cells ^ cell]
        count = self.starts[(cells ^ cell) + 1] - start
        owner = np.repeat(np.arange(len(values)), count)
        at = np.arange(len(owner)) + np.repeat(start - (np.cumsum(count) - count), count)
        return values[owner] ^ self.flips[at], owner


def shard_bits(fingerprints: int, variants: int) -> int:
    """2^7 shards, and more where a shard would get over ``SHARD_FINGERPRINTS``
    or have to form over ``SHARD_VARIANTS``."""
    bits = 7
    while (fingerprints * min(1.0, variants / 2**bits) > SHARD_FINGERPRINTS
           or fingerprints * variants / 2**bits > SHARD_VARIANTS):
        bits += 1
    return bits


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``parent`` (each node's root) after joining the nodes a and b of each pair."""
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return parent
        a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(parent, b, a)
        while (parent[parent] != parent).any():
            parent = parent[parent]


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b): the pairs within ``radius``
    bits have the same components as these. A shard puts out one link for each
    of its fingerprints at most, to the root of those that meet there."""
    if radius % 2:
        raise ValueError("radius must be even: each side flips half of it")
    half, most = radius // 2, 4096
    ways = len(masks(half))
    count = fps.count()
    bits = shard_bits(count, ways)
    fine = max(0, int(count * ways / 2**bits / SLICE_VARIANTS).bit_length())
    homes = spread_keys(fps.sparkSession, min(1 << bits, 1 << 13))

    def scatter(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cosets, home = Cosets(masks(half), bits, fine), np.array(homes)
        waiting = np.zeros(0, np.uint64)

        def send(values: np.ndarray) -> pa.RecordBatch:
            shard = ((cosets.cell(values) >> fine)[:, None] ^ cosets.shards[None, :]).ravel()
            order = np.argsort(shard, kind="stable")
            shard, values = shard[order], values[order // len(cosets.shards)]
            first = np.flatnonzero(np.diff(shard, prepend=-1))
            data = [values[a:b].tobytes() for a, b in zip(first, np.append(first[1:], len(shard)))]
            return pa.record_batch([pa.array(home[shard[first] % len(home)], pa.int32()), pa.array(shard[first], pa.int32()),
                                    pa.array(data, pa.binary())], ["home", "shard", "fps"])

        for b in parts:
            waiting = np.concatenate([waiting, b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)])
            full = len(waiting) // most * most
            for at in range(0, full, most):
                yield send(waiting[at:at + most])
            waiting = waiting[full:]
        if len(waiting):
            yield send(waiting)

    def meet(table: pa.Table) -> pa.Table:
        cosets = Cosets(masks(half), bits, fine)
        values = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("fps").to_pylist()]))
        cells, shard = cosets.cell(values), table.column("shard")[0].as_py()
        parent = np.arange(len(values))
        for part in range(1 << fine):
            variant, owner = cosets.variants(values, cells, shard << fine | part)
            ordered = np.sort(variant)
            shared = ordered[1:][ordered[1:] == ordered[:-1]]
            # A bitmap leaves few others than the shared ones for the exact look-up.
            wide = np.uint64(64 - 22)
            marks = np.zeros(1 << 22, bool)
            marks[mix(shared) >> wide] = True
            keep = marks[mix(variant) >> wide]
            variant, owner = variant[keep], owner[keep]
            order = np.argsort(variant, kind="stable")  # owners rise within a variant
            variant, owner = variant[order], owner[order]
            start = np.diff(variant) != 0
            run = np.concatenate([np.zeros(min(1, len(variant)), np.int64), np.cumsum(start)])
            low = owner[np.flatnonzero(np.concatenate([[True], start]))[run]] if len(owner) else owner
            # Verification: only links within the radius join.
            good = (low != owner) & (np.bitwise_count(values[low] ^ values[owner]) <= radius)
            parent = _join(parent, low[good], owner[good])
        member = np.flatnonzero(parent != np.arange(len(values)))
        return pa.table({"a": values[parent[member]].view(np.int64), "b": values[member].view(np.int64)})

    sent = fps.mapInArrow(scatter, "home int, shard int, fps binary")
    return sent.repartition(len(homes), "home").groupBy("home", "shard").applyInArrow(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4) -> DataFrame:
    """(doc_id, fp long, component_id) for each row of ``docs``.

    ``component_id`` is the smallest doc_id that a row reaches over links,
    itself included. Rows with equal fingerprints are always linked, those
    without words too (fingerprint 0). Repeated rows and repeated ids each keep
    their row; a null id is never the smallest, so ``component_id`` is null
    only where all ids of the component are null. Extra columns are ignored,
    an empty table gives an empty result.
    """
    fps = write_table(fingerprints(docs, words), "fingerprints")
    classes = write_table(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprint_classes")
    spread = classes.select("fp").repartition(shards(docs.sparkSession))
    roots = components(links(spread, radius))
    linked = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = linked.select("fp", "root").join(smallest, "root").select(F.col("fp").alias("class_fp"), "component_id")
    return fps.join(named, fps.fp == named.class_fp).select("doc_id", "fp", "component_id")
