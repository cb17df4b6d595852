import math
import random
from collections import defaultdict

import numpy as np

from flowloom.llm.langid import ORDER, Model, Tree, fit, grams, identify

PAD = b" " * ORDER


def counts(text):
    c = [defaultdict(lambda: defaultdict(int)) for _ in range(ORDER + 1)]
    s = PAD + text
    for i in range(ORDER, len(s)):
        for k in range(ORDER + 1):
            c[k][s[i - k:i]][s[i]] += 1
    return c


def code_length(c, text):
    """Escape method C with exclusion, symbol by symbol."""
    s, total = PAD + text, 0.0
    for i in range(ORDER, len(s)):
        excluded = set()
        for k in range(ORDER, -1, -1):
            found = c[k].get(s[i - k:i])
            if not found:
                continue
            live = {x: n for x, n in found.items() if x not in excluded}
            n, kinds = sum(live.values()), len(live)
            if s[i] in live:
                total -= math.log2(live[s[i]] / (n + kinds))
                break
            if kinds:
                total -= math.log2(kinds / (n + kinds))
            excluded = set(found)
        else:
            total += math.log2(256 - len(excluded))
    return total


def test_code_lengths():
    rng = random.Random(0)
    training = [bytes(rng.choice(b"abcd ") for _ in range(300)) for _ in range(3)]
    trees = []
    for t in training:
        g, n = np.unique(grams(np.frombuffer(PAD + t, np.uint8)), return_counts=True)
        trees.append(Tree(g, n.astype(float)))
    model = Model(list("xyz"), trees)
    asked = [b"abcdab dcba", b"", b"zzz a", bytes(rng.choice(b"abcde ") for _ in range(500)), b"ab" * 700_000]
    got = model.text_bits(asked)
    want = np.array([[code_length(counts(t), q) for t in training] for q in asked[:4]])
    assert np.allclose(got[:4], want, atol=1e-3)
    half = model.text_bits([b"ab" * 350_000])
    assert np.allclose(got[4] / half[0], 2, atol=1e-3)  # a text read in pieces


def corpus(n=60):
    rng = random.Random(1)
    words = {"en": "the and of with that from this".split(), "de": "der und von mit das aus dies".split()}
    return [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for i in range(n) for lang in [("en", "de")[i % 2]]]


def test_prediction(documents):
    rows = corpus()
    model = fit(documents(rows + [(90, None, "en"), (91, "x", None)], "doc_id long, text string, lang string"), rows=40)
    asked = [(1, "with that and the", "zz"), (2, "MIT DAS UND", None), (3, None, "en"), (4, "", "en"), (5, "12 !? 34", "en"), (5, "12 !? 34", "en"),
             (None, "der und " * 100_000, None)]
    got = {(r.doc_id, r.lang_pred, r.score > 0.5) for r in identify(documents(asked, "doc_id long, text string, lang string"), model).collect()}
    assert got == {(1, "en", True), (2, "de", True), (3, "und", False), (4, "und", False), (5, "und", False), (None, "de", True)}


def test_empty(documents):
    none = documents([], "doc_id long, text string, lang string")
    model = fit(none)
    assert identify(none, model).collect() == []
    assert identify(documents([(1, "abc", None)], "doc_id long, text string, lang string"), model).first().lang_pred == "und"
