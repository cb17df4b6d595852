"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ``ORDER`` bytes with frozen
counts. A text's code length under a language is the exact sum of its bytes'
code lengths: escape method C with exclusion, down to a uniform order. The
language with the shortest code wins.

As a context's followers also follow each of its suffixes, what an escape
excludes from the next shorter context is just the longer context's followers.
So per context four numbers suffice: its total, its followers, and the total
and number of followers that it excludes one order below.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowloom.llm.common import batches, bounded_sample, encoded, mix, slim

ORDER = 4
SAMPLE_ROWS = 1500   # labelled rows a language's model is fitted on, at most (expected number)
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_PAD = b" " * ORDER
_BYTE = np.uint64(8)


def _masked(grams: np.ndarray, width: int) -> np.ndarray:
    return grams & np.uint64((1 << (8 * width)) - 1)


def grams(data: np.ndarray) -> np.ndarray:
    """The byte with the ``ORDER`` bytes before it, for each byte after those."""
    wide = data.astype(np.uint64)
    out = wide[ORDER:].copy()
    for k in range(1, ORDER + 1):
        out |= wide[ORDER - k:len(wide) - k] << np.uint64(8 * k)
    return out


class Tree:
    """Frozen statistics of one language, from its counted longest grams."""

    def __init__(self, found: np.ndarray, counts: np.ndarray):
        self.gram, self.count, self.ctx, self.total, self.kinds = [], [], [], [], []
        self.out_total = [np.zeros(1)]
        for k in range(ORDER + 1):
            g, where = np.unique(_masked(found, k + 1), return_inverse=True)
            c = np.bincount(where, weights=counts)
            ctx, of = np.unique(g >> _BYTE, return_inverse=True)
            self.gram.append(g)
            self.count.append(c)
            self.ctx.append(ctx)
            self.total.append(np.bincount(of, weights=c))
            self.kinds.append(np.bincount(of).astype(float))
            if k:
                below = self.count[k - 1][np.searchsorted(self.gram[k - 1], _masked(g, k))]
                self.out_total.append(np.bincount(of, weights=below))

    def bits(self, asked: np.ndarray) -> np.ndarray:
        """Code length in bits of the last byte of each gram after its others."""
        cost = np.zeros(len(asked))
        open_ = np.ones(len(asked), bool)
        gone_total, gone_kinds = np.zeros(len(asked)), np.zeros(len(asked))

        def find(sorted_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(sorted_, keys), max(0, len(sorted_) - 1))
            return at, (sorted_[at] == keys) if len(sorted_) else np.zeros(len(keys), bool)

        for k in range(ORDER, -1, -1):
            g = _masked(asked, k + 1)
            at, seen = find(self.ctx[k], g >> _BYTE)
            seen &= open_
            if not seen.any():
                continue
            which, hit = find(self.gram[k], g)
            hit &= seen
            total = self.total[k][at] - gone_total
            kinds = self.kinds[k][at] - gone_kinds
            cost[hit] -= np.log2(self.count[k][which[hit]] / (total + kinds)[hit])
            miss = seen & ~hit
            some = miss & (kinds > 0)  # else all is excluded and the escape is certain
            cost[some] -= np.log2(kinds[some] / (total + kinds)[some])
            gone_total = np.where(miss, self.out_total[k][at] if k else 0, gone_total)
            gone_kinds = np.where(miss, self.kinds[k][at], gone_kinds)
            open_ &= ~hit
        left = 256 - (self.kinds[0].sum() if len(self.kinds[0]) else 0)
        cost[open_] += np.log2(max(1.0, left))
        return cost


@dataclass
class Model:
    """Trees of all languages, and a table of the code lengths of all grams
    seen in training, in open addressing."""

    langs: list[str]
    trees: list[Tree]

    def __post_init__(self) -> None:
        known = np.unique(np.concatenate([np.zeros(0, np.uint64)] + [t.gram[ORDER] for t in self.trees]))
        self.costs = np.stack([t.bits(known) for t in self.trees], axis=1).astype(np.float32) if self.trees else np.zeros((0, 0), np.float32)
        self.bits = max(4, int(2 * len(known) + 1).bit_length())
        slots = np.full((1 << self.bits) + 64, -1, np.int32)
        at, todo = self._slot(known), np.arange(len(known), dtype=np.int32)
        self.depth = 0
        while len(todo):  # of those that want a free slot, one gets it
            free = slots[at] < 0
            slots[at[free]] = todo[free]
            rest = slots[at] != todo
            at, todo = at[rest] + 1, todo[rest]
            self.depth += 1
            if len(at) and at.max() >= len(slots):
                slots = np.concatenate([slots, np.full(64, -1, np.int32)])
        self.slots = np.concatenate([slots, np.full(1, -1, np.int32)])
        self.known = np.append(known, np.uint64(1 << 63))

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def gram_bits(self, g: np.ndarray) -> np.ndarray:
        """Code lengths (bytes x languages)."""
        at = self._slot(g)
        row = self.slots[at]
        open_ = np.flatnonzero(self.known[row] != g)
        row[open_] = -1
        look = open_[self.slots[at[open_]] >= 0]
        for step in range(1, self.depth):
            if not len(look):
                break
            r = self.slots[at[look] + step]
            good = self.known[r] == g[look]
            row[look[good]] = r[good]
            look = look[~good & (r >= 0)]
        out = np.zeros((len(g), len(self.langs)), np.float32)
        hit = row >= 0
        out[hit] = self.costs[row[hit]]
        if not hit.all():
            new, where = np.unique(g[~hit], return_inverse=True)
            out[~hit] = np.stack([t.bits(new) for t in self.trees], axis=1)[where]
        return out

    def text_bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text under each language."""
        total = np.zeros((len(texts), len(self.langs)))
        for some in batches(texts, 1 << 19):
            flat = np.frombuffer(b"".join(_PAD + texts[i] for i in some), np.uint8)
            sizes = np.array([len(texts[i]) for i in some])
            owner = np.repeat(np.arange(len(sizes)), sizes + ORDER)[ORDER:]
            inside = np.concatenate([np.r_[np.zeros(ORDER, bool), np.ones(s, bool)] for s in sizes])[ORDER:]
            for at in range(0, max(0, len(flat) - ORDER), 1 << 20):  # one long text is read in pieces
                g = grams(flat[at:at + (1 << 20) + ORDER])
                use = inside[at:at + len(g)]
                cost, who = self.gram_bits(g[use]), owner[at:at + len(g)][use]
                for j in range(len(self.langs)):
                    total[some.start:some.stop, j] += np.bincount(who, weights=cost[:, j], minlength=len(sizes))
        return total


def _lowered(text: str | None) -> bytes:
    return (text or "").lower().encode()


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 7) -> Model:
    """A model from (text, lang), fitted on about ``rows`` rows of each language
    at most, chosen by text hash. Rows without text or language are left out.
    The counts come to the driver; the sample bounds them."""
    usable = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND lang <> 'und'").select("lang", "text")
    sample = bounded_sample(usable, "lang", "text", rows, seed)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            langs = np.array(b.column("lang").to_pylist(), object)
            texts = [_lowered(t) for t in b.column("text").to_pylist()]
            for lang in sorted(set(langs)):
                flat = np.concatenate([grams(np.frombuffer(_PAD + texts[i], np.uint8)) for i in np.flatnonzero(langs == lang)])
                g, c = np.unique(flat, return_counts=True)
                yield pa.record_batch([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(c)], ["lang", "gram", "n"])

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang = np.array(counts.column("lang").to_pylist(), object)
    gram, n = counts.column("gram").to_numpy().view(np.uint64), counts.column("n").to_numpy()
    langs = sorted(set(lang))
    return Model(langs, [Tree(gram[lang == x], n[lang == x].astype(float)) for x in langs])


def predictions(model: Model, texts: list[str | None]) -> list[tuple[str, float, float | None]]:
    """(language, score, bits per byte) of each text."""
    known = [bool(t) and bool(model.langs) and _LETTER.search(t) is not None for t in texts]
    data = [_lowered(t) if k else b"" for t, k in zip(texts, known)]
    out: list[tuple[str, float, float | None]] = []
    for k, bits, text in zip(known, model.text_bits(data), data):
        if not k:
            out.append((UNDETERMINED, 0.0, None))
            continue
        best = int(bits.argmin())
        out.append((model.langs[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()), float(bits[best] / len(text))))
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte) of each row's whole text; the
    score is from 0 to 1.

    The score is the language's posterior under equal priors. A text that is
    null, empty or without letters, or a model without languages, gives
    ``und`` with score 0. Ties go to the first language by name. Repeated rows
    are predicted alike; all other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for b in slim(whole, 1000):
                langs, scores, rates = zip(*predictions(shared.value, b.column("text").to_pylist()))
                yield pa.record_batch([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                                       pa.array(rates, pa.float64())], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_byte double")


def determined(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has a language
    of score ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for b in slim(whole, 1000):
                good = [lang != UNDETERMINED and score >= least for lang, score, _ in predictions(shared.value, b.column("text").to_pylist())]
                yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
