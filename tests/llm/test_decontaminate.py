import random

import numpy as np

from flowloom.llm.decontaminate import Items, Words, contaminated, edit_distance, edits, gram_rule


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        i, op = rng.randrange(len(words)), rng.randrange(3)
        if op == 0:
            words[i] = f"w{rng.randrange(500)}"
        elif op == 1 and len(words) > 1:
            del words[i]
        else:
            words.insert(i, f"w{rng.randrange(500)}")
    return words


def cases(rng, items, share):
    docs = []
    for item in items:
        k = int(edits(len(item), 0.8) * share)
        around = lambda: [f"w{rng.randrange(500)}" for _ in range(rng.randrange(30))]
        docs.append(around() + edited(rng, item, k) + around())
    return docs


def brute(docs, items):
    out = set()
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            n, k = len(item), edits(len(item), 0.8)
            if any(distance(item, doc[s:s + n]) <= k for s in range(len(doc))):
                out.add((d, i))
    return out


def test_distance():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 70))]
        b = [rng.randrange(6) for _ in range(rng.randrange(0, 70))]
        masks = {}
        for i, w in enumerate(a):
            masks[w] = masks.get(w, 0) | 1 << i
        assert edit_distance(masks, len(a), b, 999) == distance(a, b)


def test_gram_lemma():
    for n in range(1, 80):
        q, least = gram_rule(n, edits(n, 0.8))
        assert least >= 1 and (n - q + 1 - q * edits(n, 0.8) >= least or q == 1)


def test_recall_and_exactness(documents, spark):
    rng = random.Random(2)
    items = [[f"w{rng.randrange(500)}" for _ in range(n)] for n in [1, 2, 4, 5, 9, 15, 15, 20, 30, 57, 80] * 3]
    found = want = 0
    for share in (0, 0.5, 1):
        docs = cases(rng, items, share)
        truth = brute(docs, items)
        rows = [(i, " ".join(d).upper()) for i, d in enumerate(docs)]
        bench = spark.createDataFrame([(i, ", ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
        got = {(r.doc_id, r.item_id) for r in contaminated(documents(rows), bench).collect()}
        assert got <= truth
        if share == 0:
            assert got == truth
        found, want = found + len(got), want + len(truth)
    assert found >= 0.95 * want


def test_odd_rows(documents, spark):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, None), (3, ""), (None, "one two three four five six"), (1, "the quick brown fox jumps")],
                                  "item_id long, text string").withColumnRenamed("x", "y")
    rows = [(5, "see: The quick brown fox jumps!"), (6, None), (7, ""), (None, "one two three four five six"), (8, "quick"), (9, "filler " * 100_000 + "the quick brown fox jumps")]
    got = sorted((r.doc_id or 0, r.item_id or 0, r.first_word, r.distance) for r in contaminated(documents(rows), bench).collect())
    assert got == [(0, 0, 0, 0), (5, 1, 1, 0), (5, 1, 1, 0), (9, 1, 100_000, 0), (9, 1, 100_000, 0)]
    many = sorted((r.doc_id or 0, r.item_id or 0, r.first_word, r.distance) for r in contaminated(documents(rows), bench, item_bytes=20).collect())
    assert many == got  # items in several passes
    assert contaminated(documents([]), bench).collect() == []
    assert contaminated(documents(rows), bench.filter("false")).collect() == []


def test_items_of_one_word():
    words = Words()
    items = Items([1], [words.of("zebra")])
    assert items.search([words.of("a zebra"), np.zeros(0, np.uint64)]) == [(0, 0, 1, 0)]


def test_recall_at_the_threshold_by_length():
    """Exactly the edits allowed, all substitutions."""
    rng = random.Random(5)
    for n, least in ((20, 0.97), (40, 0.97), (80, 0.94)):
        hashes = lambda k: [rng.randrange(1, 1 << 63) for _ in range(k)]
        items = [hashes(n) for _ in range(200)]
        texts = []
        for item in items:
            text = list(item)
            for i in rng.sample(range(n), edits(n, 0.8)):
                text[i] = rng.randrange(1, 1 << 63)
            texts.append(np.array(hashes(10) + text + hashes(10), np.uint64))
        found = Items(list(range(200)), [np.array(i, np.uint64) for i in items]).search(texts)
        assert sum(t == i for t, i, _, _ in found) >= least * 200, (n, len(found))
