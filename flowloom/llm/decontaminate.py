"""Benchmark passages in documents, by edit distance.

An item of L words occurs in a document if a window of L words (fewer at the
document's end) is within ``(1 - similarity) * L`` word edits of it.

The embedding of Chakraborty, Goldenberg and Koucky (CGK) walks over a window:
each step puts out the current word and moves on or stays, by a random bit that
depends on the step and the word. Windows at a small edit distance become
strings at a small Hamming distance, so the words at a few sampled steps are a
locality-sensitive hash. Steps are sampled from all 2L of a walk. ``repeats`` walks with samples of their own give the
target recall; each collision is verified by exact edit distance.

Windows that hold fewer of the items' q-grams than the q-gram lemma demands of
any match are not embedded; that loses none.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from flowloom.llm.common import mix, slim

SIMILARITY = 0.8
REPEATS, SAMPLED = 16, 2      # walks, and steps sampled from each
ITEM_BYTES = 32 << 20         # text of items that one pass broadcasts
_WORD = re.compile(r"\w+")
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode()) or 1  # 0 is the padding
        return h

    def of(self, text: str | None) -> np.ndarray:
        words = _WORD.findall((text or "").lower())
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def edits(length: int, similarity: float) -> int:
    return int((1 - similarity) * length + 1e-9)


def gram_rule(length: int, most: int) -> tuple[int, int]:
    """(q, n): a window within ``most`` edits has at least n of the item's q-grams."""
    for q in (3, 2):
        if length - q + 1 - most * q >= 1:
            return q, length - q + 1 - most * q
    return 1, max(1, length - most)


def gram_hashes(words: np.ndarray, q: int) -> np.ndarray:
    n = max(0, len(words) - q + 1)
    h = np.zeros(n, np.uint64)
    for j in range(q):
        h = (h + words[j:j + n]) * _GOLD
    return mix(h)


def edit_distance(masks: dict[int, int], length: int, window: list[int], most: int) -> int:
    """Levenshtein distance of an item, given as bit masks of its words, and a
    window (bit-parallel, after Myers); ``most + 1`` for anything above."""
    up, down, score, full = (1 << length) - 1, 0, length, (1 << length) - 1
    top = 1 << (length - 1)
    for w in window:
        eq = masks.get(w, 0)
        x = eq | down
        d0 = (((eq & up) + up) ^ up) | x
        hp = down | (full & ~(d0 | up))
        hn = up & d0
        score += bool(hp & top) - bool(hn & top)
        hp = (hp << 1 | 1) & full
        hn = hn << 1 & full
        up = hn | (full & ~(d0 | hp))
        down = hp & d0
    return min(score, most + 1)


@dataclass
class Items:
    """Embedded items; built on the driver from at most ``ITEM_BYTES`` of text."""

    ids: list
    words: list[np.ndarray]
    similarity: float = SIMILARITY
    repeats: int = REPEATS
    sampled: int = SAMPLED
    rules: dict[int, tuple[int, int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        lengths = sorted({len(w) for w in self.words})
        self.rules = {n: gram_rule(n, edits(n, self.similarity)) for n in lengths}
        self.longest = lengths[-1] if lengths else 0
        self.grams = {q: np.unique(np.concatenate([gram_hashes(w, q) for w in self.words if self.rules[len(w)][0] == q]))
                      for q in {r[0] for r in self.rules.values()}}
        self.marks = {}
        for q, g in self.grams.items():
            self.marks[q] = np.zeros(1 << 22, bool)
            self.marks[q][g >> np.uint64(42)] = True
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.own = np.zeros(1 << 24, bool)  # marks of (q-gram, item)
        for i, w in enumerate(self.words):
            g = gram_hashes(w, self.rules[len(w)][0]) + np.uint64(i * 0x9E3779B97F4A7C15 & (2**64 - 1))
            self.own[mix(g) >> np.uint64(40)] = True
        self.masks = []
        for w in self.words:
            m: dict[int, int] = defaultdict(int)
            for i, x in enumerate(w.tolist()):
                m[x] |= 1 << i
            self.masks.append(dict(m))
        by_length: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(self.words):
            by_length[len(w)].append(i)
        hashes, owners = [], []
        for n, members in by_length.items():
            flat = np.concatenate([np.append(self.words[i], np.zeros(self.longest, np.uint64)) for i in members])
            starts = np.arange(len(members)) * (n + self.longest)
            for h in self.embed(flat, starts, {n: np.arange(len(members))}):
                hashes.append(h[n])
                owners.append(np.array(members))
        self.hashes = np.concatenate([np.zeros(0, np.uint64)] + hashes)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes = self.hashes[order]
        self.owners = np.concatenate([np.zeros(0, np.int64)] + owners)[order]

    def embed(self, flat: np.ndarray, starts: np.ndarray, use: dict[int, np.ndarray]) -> Iterator[dict[int, np.ndarray]]:
        """For each repeat the hash of the windows ``starts[use[length]]`` of
        each length. ``flat`` has ``longest`` zeros after each text."""
        longest = max(use)
        low, high = int(starts[0]), int(starts[-1]) + 2 * longest + 1
        part = flat[low:high]
        padded = np.concatenate([part, np.zeros(high - low - len(part), np.uint64)])
        begin = starts - low
        for r in range(self.repeats):
            rngs = {n: np.random.default_rng([r, n]) for n in use}
            sampled = {n: np.sort(g.choice(2 * n, min(2 * n, self.sampled), replace=False)).tolist() for n, g in rngs.items()}
            # A window walks no further than the last step sampled from it.
            last = np.full(len(starts), -1)
            for n, which in use.items():
                last[which] = np.maximum(last[which], sampled[n][-1])
            order = np.argsort(-last, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            walking = np.searchsorted(-last[order], -np.arange(last.max() + 1), side="right")
            origin = begin[order]
            here = origin.copy()
            where = {n: place[which] for n, which in use.items()}
            found = {n: np.full(len(which), np.uint64(r * 65537 + n), np.uint64) for n, which in use.items()}
            for j, k in enumerate(walking.tolist()):
                if j % 64 == 0:
                    bits = mix(padded + np.uint64((r * 1009 + j // 64 + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
                for n, steps in sampled.items():
                    if j in steps:
                        at = here[where[n]]
                        word = np.where(at - origin[where[n]] < n, padded[at], np.uint64(0))
                        found[n] = mix(found[n] * _GOLD + word)
                here[:k] += ((bits[here[:k]] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)
            yield found

    def plausible(self, flat: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """The pairs whose window has as many of the item's own q-grams as the
        q-gram lemma demands of a match; none that matches is left out."""
        kept = [np.zeros(0, np.int64)]
        length = self.lengths[pairs % len(self.words)]
        for n in np.unique(length).tolist():
            q, least = self.rules[n]
            some, span = pairs[length == n], max(1, n - q + 1)
            for at in range(0, len(some), max(1, 1_000_000 // span)):  # bounds the grams held at once
                part = some[at:at + max(1, 1_000_000 // span)]
                window, item = part // len(self.words), part % len(self.words)
                low, high = int(window.min()), int(window.max()) + n
                grams = gram_hashes(np.concatenate([flat[low:high], np.zeros(n, np.uint64)]), q)
                own = mix(grams[(window - low)[:, None] + np.arange(span)] + item.astype(np.uint64)[:, None] * _GOLD)
                kept.append(part[self.own[own >> np.uint64(40)].sum(axis=1) >= least])
        return np.unique(np.concatenate(kept))

    def search(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
        """(text, item, first word, distance) of the best window of each item."""
        enough = min((n for _, n in self.rules.values()), default=1)
        near = []
        hits: dict[int, list[np.ndarray]] = {q: [] for q in self.grams}
        for t, words in enumerate(texts):
            own = {}
            for q, known in self.grams.items():
                g = gram_hashes(words, q)
                hit = self.marks[q][g >> np.uint64(42)]
                if hit.any():
                    at = np.flatnonzero(hit)
                    hit[at] = known[np.minimum(np.searchsorted(known, g[at]), len(known) - 1)] == g[at]
                own[q] = hit
            if any(h.sum() >= enough for h in own.values()):
                near.append(t)
                for q in hits:
                    hits[q].append(np.concatenate([own[q], np.zeros(len(words) - len(own[q]) + self.longest, bool)]))
        if not near:
            return []
        flat = np.concatenate([np.append(texts[t], np.zeros(self.longest, np.uint64)) for t in near])
        owner = np.repeat(np.arange(len(near)), [len(texts[t]) + self.longest for t in near])
        base = np.concatenate([[0], np.cumsum([len(texts[t]) + self.longest for t in near])])
        wanted = {}
        for n, (q, least) in self.rules.items():
            total = np.concatenate([[0], np.cumsum(np.concatenate(hits[q]))])
            span = max(1, n - q + 1)
            stop = np.minimum(np.arange(len(flat)) + span, len(flat))
            good = (total[stop] - total[:-1] >= least) & (flat != 0)
            if good.any():
                wanted[n] = np.flatnonzero(good)
        if not wanted:
            return []
        starts = np.unique(np.concatenate(list(wanted.values())))
        pairs: list[np.ndarray] = [np.zeros(0, np.int64)]  # window * items + item
        for at in range(0, len(starts), 20_000):  # bounds the walks held at once
            some = starts[at:at + 20_000]
            use = {}
            for n, w in wanted.items():
                w = w[(w >= some[0]) & (w <= some[-1])]
                if len(w):
                    use[n] = np.searchsorted(some, w)
            fresh: list[np.ndarray] = [np.zeros(0, np.int64)]
            for found in self.embed(flat, some, use):
                for n, h in found.items():
                    lo, hi = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, side="right")
                    hit = np.flatnonzero(hi > lo)
                    count = (hi - lo)[hit]
                    item = self.owners[np.arange(count.sum()) + np.repeat(lo[hit] - (np.cumsum(count) - count), count)]
                    window = np.repeat(some[use[n][hit]], count)
                    fresh.append((window * len(self.words) + item)[self.lengths[item] == n])
            pairs.append(self.plausible(flat, np.unique(np.concatenate(fresh))))
        rows = np.concatenate(pairs)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for s, item in zip((rows // len(self.words)).tolist(), (rows % len(self.words)).tolist()):
            n, t = len(self.words[item]), int(owner[s])
            most = edits(n, self.similarity)
            window = flat[s:min(s + n, int(base[t]) + len(texts[near[t]]))].tolist()
            d = edit_distance(self.masks[item], n, window, most)
            key = (near[t], item)
            if d <= most and (key not in best or d < best[key][0]):
                best[key] = (d, s - int(base[t]))
        return [(t, item, at, d) for (t, item), (d, at) in sorted(best.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, repeats: int = REPEATS,
                 sampled: int = SAMPLED, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, first_word, distance) of each item that occurs in a
    document, with its best window (the first on ties).

    Words are runs of letters, digits and underscores, in lower case. Items
    without words, null texts and empty texts match nothing; repeated rows of
    either table each give their rows; ids may be null. Other columns are
    ignored. The items' text is measured first: up to ``item_bytes`` of it is
    broadcast at a time, and beyond that the items go in several passes.
    """
    schema = "doc_id long, item_id long, first_word long, distance int"
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = int(size // item_bytes) + 1
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for k in range(passes):
        words = Words()
        rows = items.filter(F.pmod(F.xxhash64("text"), F.lit(passes)) == k).collect()  # about item_bytes
        known = [(r["item_id"], words.of(r["text"])) for r in rows]
        known = [(i, w) for i, w in known if len(w)]
        part = Items([i for i, _ in known], [w for _, w in known], similarity, repeats, sampled)
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def run(parts: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items, words = shared.value, Words()
            for whole in parts:
                for b in slim(whole, 400):
                    hits = items.search([words.of(t) for t in b.column("text").to_pylist()]) if items.ids else []
                    ids = b.column("doc_id").to_pylist()
                    yield pa.record_batch([
                        pa.array([ids[h[0]] for h in hits], pa.int64()), pa.array([items.ids[h[1]] for h in hits], pa.int64()),
                        pa.array([h[2] for h in hits], pa.int64()), pa.array([h[3] for h in hits], pa.int32())],
                        ["doc_id", "item_id", "first_word", "distance"])

        part_found = picked.mapInArrow(run, schema)
        found = part_found if found is None else found.unionByName(part_found)
    return found
