"""Language-model scores by deleted interpolation of n-grams.

The probability of a token is a mixture of its maximum-likelihood estimates
after the ``ORDER - 1`` tokens before it, after fewer, and a smoothed unigram
that knows unseen words. The weights depend on how often the longest context
occurs (buckets of its count), and are learned by expectation-maximisation on
a held-out part of the training documents, against counts without that part.

1. Each scan task turns its texts into blocks (counted, held out for the
   weights, not for training) and sends each shard the distinct n-grams of a
   block with their counts, as sorted 48-bit keys.
2. Shards add up and answer each block with the totals of its n-grams.
3. Held-out blocks are joined with their answers and put into a histogram of
   component probabilities, which is stored. Its cells grow with the data, so
   each round of expectation-maximisation is an aggregate over it on Spark.
4. All blocks are joined with their answers, and texts are scored.

Nothing of the corpus passes through the driver but totals and, from each round,
the weights of the buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from flowloom.llm.common import cut, encoded, mix, pack, pack_sorted, shards, spread_keys, unpack, unpack_sorted
from flowloom.runtime import write_table

ORDER = 3
BUCKETS = 12          # of log2 of the longest context's count; 0: not seen
CELL, CELLS = 8, 512  # histogram cells in an octave of probability, and in all
BLOCK_BYTES = 8 << 20 # text of a block, about; a longer text is a block of its own
SETTLED = 1e-6        # a change of weights that ends their learning
COUNTED, WEIGHED, TESTED = 0, 1, 2
END = np.uint64(0x5AFE0E4D5AFE0E4D)
START = np.uint64(0x57A127D057A127D0)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """word -> 64-bit hash, remembered up to a bound; the hash is the word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 1)
        return h


def tokens(text: bytes, words: Words) -> np.ndarray:
    found = text.lower().split()  # bytes: A-Z only, and white space 09-0D and 20
    out = np.empty(len(found) + 1, np.uint64)
    out[:-1] = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    out[-1] = END
    return out


def grams(flat: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the 1- to ``order``-grams that end at each token. first: each
    token's place in its text; before a text there are start marks."""
    out = [mix(flat)]
    n = len(flat)
    for k in range(1, order):
        back = np.full(n, START, np.uint64)
        back[k:] = np.where(first[k:] >= k, flat[:n - k], START) if n > k else back[k:]
        out.append(mix(out[-1] * _STEP + mix(back + np.uint64(k)) * np.uint64(2 * k + 1)))
    return out


class Block:
    """The n-grams of some texts: distinct keys for each order, and where."""

    def __init__(self, texts: list[bytes], order: int):
        words = Words()
        parts = [tokens(t, words) for t in texts]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.flat = np.concatenate([np.zeros(0, np.uint64), *parts])
        self.owner = np.repeat(np.arange(len(parts)), self.sizes)
        self.first = np.arange(len(self.flat)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.order = order
        self.keys, self.which, self.counts = [], [], []
        for k, g in enumerate(grams(self.flat, self.first, order)):
            keys, which, counts = np.unique(g, return_inverse=True, return_counts=True)
            self.keys.append(keys)
            self.which.append(which.astype(np.uint32))
            self.counts.append(counts.astype(np.uint32))

    def context_counts(self, totals: list[np.ndarray], texts: int) -> list[np.ndarray]:
        """How often the 1 to ``order - 1`` tokens before each token occur: as
        often as the n-gram that ends one token earlier, since only a text's
        last token has none after it and that is always the end mark. At a
        text's start, as often as there are texts."""
        out = []
        for k in range(self.order - 1):
            c = np.full(len(self.flat), float(texts))
            c[1:] = totals[k][self.which[k]][:-1]
            c[self.first == 0] = texts
            out.append(c)
        return out

    def parts(self, totals: list[np.ndarray], n: float, v: float, texts: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Bucket of each token's longest context, and its component
        probabilities from the unigram up (0 where the context is not seen)."""
        probs = [(totals[0][self.which[0]] + 1) / (n + v + 1)]
        before = self.context_counts(totals, texts)
        for k in range(1, self.order):
            c = before[k - 1]
            probs.append(np.where(c > 0, totals[k][self.which[k]] / np.maximum(c, 1), 0.0))
        longest = before[-1] if before else np.zeros(len(self.flat))
        bucket = np.where(longest > 0, np.minimum(BUCKETS - 1, 1 + np.floor(np.log2(np.maximum(longest, 1)))), 0)
        if self.order > 2:  # unseen longest contexts differ by whether the next one is seen
            bucket = bucket + BUCKETS * (before[-2] > 0)
        return bucket.astype(np.int64), probs


@dataclass
class Weights:
    table: np.ndarray  # (buckets, order): from the unigram up

    @classmethod
    def learn(cls, cells: DataFrame, order: int, rounds: int = 60) -> Weights:
        """Expectation-maximisation over rows (bucket int, p array, n long):
        ``n`` tokens in that bucket with these component probabilities. Stops
        when no weight moves by more than ``SETTLED``."""
        table = np.full((2 * BUCKETS, order), 1 / order)
        for _ in range(rounds):
            weight = [F.element_at(F.lit(table[:, j].tolist()), F.col("bucket") + 1) for j in range(order)]
            parts = [w * F.col("p")[j] for j, w in enumerate(weight)]
            whole = sum(parts[1:], parts[0])
            sums = cells.groupBy("bucket").agg(*[F.sum(F.col("n") * part / whole).alias(f"s{j}") for j, part in enumerate(parts)])
            fresh = np.zeros_like(table)
            for r in sums.collect():  # a row for each bucket
                fresh[r["bucket"]] = r[1:]
            # One token more for the unigram: a weight of zero would give a score of minus infinity.
            fresh[:, 0] += 1
            fresh /= fresh.sum(axis=1, keepdims=True)
            moved, table = np.abs(fresh - table).max(), fresh
            if moved <= SETTLED:
                break
        return cls(table)

    def log10(self, bucket: np.ndarray, probs: list[np.ndarray]) -> np.ndarray:
        return np.log10(sum(self.table[bucket, j] * p for j, p in enumerate(probs)))


def _answers(table: pa.Table) -> pa.Table:
    """Totals of each block's n-grams of one shard; for held-out blocks also
    the totals without them."""
    rows = table.select(["block", "kind", "part", "gram", "keys", "counts"]).to_pylist()
    out = {"block": [], "kind": [], "part": [], "gram": [], "totals": [], "rest": [], "distinct": [], "sum": [], "sum_rest": []}
    for gram in sorted({r["gram"] for r in rows}):
        own = [r for r in rows if r["gram"] == gram]
        keys = [unpack_sorted(r["keys"]) for r in own]
        sizes = np.array([len(k) for k in keys])
        every, where = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        counts = np.concatenate([unpack(r["counts"], np.uint32) for r in own])
        kinds = np.repeat([r["kind"] for r in own], sizes)
        weighed = np.bincount(where, weights=np.where(kinds == WEIGHED, counts, 0), minlength=len(every))
        rest = np.bincount(where, weights=np.where(kinds == COUNTED, counts, 0), minlength=len(every))
        total = rest + weighed
        at = 0
        for i, r in enumerate(own):
            w = where[at:at + sizes[i]]
            at += sizes[i]
            for name in ("block", "kind", "part", "gram"):
                out[name].append(r[name])
            out["totals"].append(pack(total[w].astype(np.uint32)))
            out["rest"].append(pack(rest[w].astype(np.uint32)) if r["kind"] == WEIGHED else None)
            out["distinct"].append(int((total > 0).sum()) if i == 0 else 0)
            out["sum"].append(int(total.sum()) if i == 0 else 0)
            out["sum_rest"].append(int(rest.sum()) if i == 0 else 0)
    kinds = {"block": pa.int32(), "kind": pa.int32(), "part": pa.int32(), "gram": pa.int32(), "totals": pa.binary(),
             "rest": pa.binary(), "distinct": pa.int64(), "sum": pa.int64(), "sum_rest": pa.int64()}
    return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})


def _collected(answers: list[dict], block: Block, name: str) -> list[np.ndarray]:
    got = []
    for k in range(block.order):
        parts = sorted((r for r in answers if r["gram"] == k), key=lambda r: r["part"])
        got.append(np.concatenate([np.zeros(0, np.uint32)] + [unpack(r[name], np.uint32) for r in parts]).astype(np.float64))
        if len(got[-1]) != len(block.keys[k]):
            raise RuntimeError("a block's text changed between two steps")
    return got


def scores(docs: DataFrame, trained: Column, weighed: Column, order: int = ORDER) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for
    each row of ``docs``: natural counts, and log10 probabilities of the text.

    ``trained`` tells which rows are learned from; of those, ``weighed`` ones
    also teach the mixture weights. A null text is empty and still has its end
    token. Repeated rows count and score each by itself; other columns are
    ignored; without training rows all words are unknown. ``docs`` is scanned
    twice and must give the same partitions both times, as a table does; a
    difference is noticed and raised.
    """
    spark = docs.sparkSession
    n = shards(spark)
    keys = spread_keys(spark, n)
    kind = F.when(~trained, TESTED).when(weighed, WEIGHED).otherwise(COUNTED).cast("int")
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), kind.alias("kind"))
    sizes = picked.groupBy(F.spark_partition_id().alias("at"), "kind").agg(
        F.count("*").alias("texts"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"))
    sizes = sizes.groupBy("kind").agg(F.sum("texts").alias("texts"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("most")).collect()
    count = {r["kind"]: r["texts"] for r in sizes}
    rest_texts = count.get(COUNTED, 0)
    texts = rest_texts + count.get(WEIGHED, 0)
    split = 1 + max((r["most"] for r in sizes), default=0) // BLOCK_BYTES
    # Keys long enough that one in 2**18 meets another by chance, at most; unigrams have all 64 bits.
    bits = min(64, int(sum(r["bytes"] for r in sizes) + 1).bit_length() + 17)
    piece = F.pmod(F.xxhash64("doc_id", "text"), F.lit(split))
    dealt = picked.withColumn("block", ((F.spark_partition_id() * 3 + F.col("kind")) * F.lit(split) + piece).cast("int"))

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def coded(block: int, k: int, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
            own = Block(texts, order)
            for gram in range(order):
                bounds = cut(own.keys[gram], n)
                some = [i for i in range(n) if bounds[i] < bounds[i + 1]]
                counts = own.counts[gram] if k != TESTED else np.zeros(len(own.counts[gram]), np.uint32)
                wide = bits if gram else 64
                yield pa.record_batch([
                    pa.array([keys[i] for i in some], pa.int32()), pa.array([block] * len(some), pa.int32()),
                    pa.array([k] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array([gram] * len(some), pa.int32()),
                    pa.array([pack_sorted(own.keys[gram][bounds[i]:bounds[i + 1]], wide) for i in some], pa.binary()),
                    pa.array([pack(counts[bounds[i]:bounds[i + 1]]) for i in some], pa.binary())],
                    ["shard", "block", "kind", "part", "gram", "keys", "counts"])

        at, held = None, []
        for b in parts:
            for block, k, t in zip(b.column("block").to_pylist(), b.column("kind").to_pylist(), encoded(b.column("text"))):
                if at is not None and at != (block, k):
                    yield from coded(*at, held)
                    held = []
                at = (block, k)
                held.append(t)
        if at is not None:
            yield from coded(*at, held)

    sent = dealt.sortWithinPartitions("block").mapInArrow(
        send, "shard int, block int, kind int, part int, gram int, keys binary, counts binary")
    answers = write_table(sent.repartition(n, "shard").groupBy("shard").applyInArrow(
        _answers, "block int, kind int, part int, gram int, totals binary, rest binary, distinct long, sum long, sum_rest long"),
        "ngram_answers")
    row = answers.filter("gram = 0").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("distinct", "sum", "sum_rest")]).first()
    v, total, rest = (float(x) for x in row)
    left = dealt.select("block", "doc_id", "text", "kind")

    def look(table: pa.Table, answer: pa.Table) -> pa.Table:
        block = Block(encoded(table.column("text")), order)
        bucket, probs = block.parts(_collected(answer.to_pylist(), block, "rest"), rest, v, rest_texts)
        cells = np.zeros(len(bucket), np.int64) + bucket
        for p in probs:
            step = np.where(p > 0, np.minimum(1 + np.floor(-np.log2(np.maximum(p, 1e-30)) * CELL), CELLS - 1), 0)
            cells = cells * CELLS + step.astype(np.int64)
        some, counts = np.unique(cells, return_counts=True)
        return pa.table({"cell": some, "n": counts})

    held = left.filter(F.col("kind") == WEIGHED).groupBy("block").cogroup(
        answers.filter(F.col("kind") == WEIGHED).select("block", "gram", "part", "rest").groupBy("block"))
    histogram = held.applyInArrow(look, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    steps = [F.expr(f"cell div {CELLS**j}") % CELLS for j in reversed(range(order))]
    probs = [F.when(step > 0, F.pow(F.lit(2.0), (F.lit(0.5) - step) / CELL)).otherwise(0.0) for step in steps]
    cells = write_table(histogram.select(
        F.expr(f"cell div {CELLS**order}").cast("int").alias("bucket"), F.array(*probs).alias("p"), "n"), "ngram_cells")
    weights = Weights.learn(cells, order)

    def score(table: pa.Table, answer: pa.Table) -> pa.Table:
        block = Block(encoded(table.column("text")), order)
        totals = _collected(answer.to_pylist(), block, "totals")
        bucket, probs = block.parts(totals, total, v, texts)
        rows = len(block.sizes)
        add = lambda x: np.bincount(block.owner, weights=x, minlength=rows)
        return pa.table({
            "doc_id": table.column("doc_id"), "n_tokens": pa.array(block.sizes),
            "n_known": pa.array(add(totals[0][block.which[0]] > 0).astype(np.int64)),
            "train_tokens": pa.array(np.full(rows, int(total), np.int64)),
            "base_score": pa.array(add(np.log10(probs[0]))), "score": pa.array(add(weights.log10(bucket, probs)))})

    return left.groupBy("block").cogroup(answers.select("block", "gram", "part", "totals").groupBy("block")).applyInArrow(
        score, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
