import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from flowloom.llm.ngrams import BUCKETS, Weights, scores


def tokens(text):
    data = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return re.findall(rb"[^\x20\x09-\x0D]+", data) + [None]


def rows():
    rng = random.Random(1)
    out = [(i, " ".join(rng.choice("a bb ccc dd e f g".split()) for _ in range(rng.randrange(1, 60)))) for i in range(60)]
    return out + [out[0], (70, None), (70, None), (71, ""), (None, "a bb UNSEEN"), (72, "A BB\tÄ"), (73, "bb a " * 20_000)]


def learned(held, order=3):
    """Expectation-maximisation token by token."""
    table = np.full((2 * BUCKETS, order), 1 / order)
    for _ in range(60):
        sums = np.zeros_like(table)
        for b, p in held:
            share = table[b] * p
            sums[b] += share / share.sum()
        sums[:, 0] += 1
        table = sums / sums.sum(axis=1, keepdims=True)
    return table


def test_weights(spark):
    rng = np.random.default_rng(2)
    held = [(int(b), np.array([p, q, 0.0 if b % 3 else r])) for b, (p, q, r) in zip(rng.integers(0, 2 * BUCKETS, 300), rng.random((300, 3)))]
    held += held[:50]
    cells = spark.createDataFrame([(b, p.tolist(), 1) for b, p in held], "bucket int, p array<double>, n long")
    assert np.allclose(Weights.learn(cells, 3).table, learned(held), atol=1e-4)
    assert np.allclose(Weights.learn(cells.filter("false"), 3).table, [[1.0, 0, 0]] * (2 * BUCKETS))


def test_against_counts(documents):
    """The counts and base score of brute force, and the mixture recomputed
    from plain dictionaries with weights learned from exact components."""
    data = rows()
    role = lambda i: 2 if i is not None and i % 7 == 2 else 1 if i is not None and i % 7 == 3 else 0
    kind = [role(i) for i, _ in data]
    got = scores(documents(data), ~F.coalesce(F.col("doc_id") % 7 == 2, F.lit(False)), F.coalesce(F.col("doc_id") % 7 == 3, F.lit(False))).collect()
    assert len(got) == len(data)
    ctx = [Counter() for _ in range(3)], [Counter() for _ in range(3)]
    gram = [Counter() for _ in range(3)], [Counter() for _ in range(3)]
    for k, (_, t) in zip(kind, data):
        ws = ["<s>", "<s>", *tokens(t)]
        for part in [x for x in (0, 1) if k != 2 and (x == 0 or k == 0)]:
            for i in range(2, len(ws)):
                for n in range(3):
                    gram[part][n][tuple(ws[i - n:i + 1])] += 1
                    ctx[part][n][tuple(ws[i - n:i])] += 1
    total, v = sum(gram[0][0].values()), len(gram[0][0])

    def parts(t, which):
        ws, out = ["<s>", "<s>", *tokens(t)], []
        n_all = sum(gram[which][0].values())
        for i in range(2, len(ws)):
            probs = [(gram[which][0][ws[i],] + 1) / (n_all + v + 1)]
            seen = [ctx[which][n][tuple(ws[i - n:i])] for n in (1, 2)]
            for n in (1, 2):
                probs.append(gram[which][n][tuple(ws[i - n:i + 1])] / seen[n - 1] if seen[n - 1] else 0.0)
            bucket = min(BUCKETS - 1, 1 + int(math.log2(seen[1]))) if seen[1] else 0
            out.append((bucket + BUCKETS * (seen[0] > 0), probs))
        return out

    held = [x for k, (_, t) in zip(kind, data) if k == 1 for x in parts(t, 1)]
    w = Weights(learned([(b, np.array(p)) for b, p in held]))
    want = []
    for i, t in data:
        found = parts(t, 0)
        want.append((-1 if i is None else i, len(found), sum(gram[0][0][x,] > 0 for x in tokens(t)), total,
                     sum(math.log10(p[0]) for _, p in found), sum(math.log10(float(np.dot(w.table[b], p))) for b, p in found)))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    for a, b in zip(got, sorted(want)):
        assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9)
        assert math.isclose(a[5], b[5], rel_tol=0.03, abs_tol=0.05)  # the histogram's cells are an eighth of an octave


def test_orders_and_no_training(documents):
    data = documents(rows()[:20])
    for order in (1, 2, 4):
        assert all(r.score < 0 for r in scores(data, F.lit(True), F.col("doc_id") % 5 == 0, order).collect())
    for r in scores(data, F.lit(False), F.lit(False)).collect():
        assert r.train_tokens == 0 and r.n_known == 0 and r.score == r.base_score == 0.0
    assert scores(documents([]), F.lit(True), F.lit(True)).collect() == []
