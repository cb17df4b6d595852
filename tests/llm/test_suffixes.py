import random

from flowloom.llm.suffixes import LENGTH, ROW, merge, repeated_passages


def brute(rows):
    first = {}
    for i, t in rows:
        data = (t or "").encode()
        key = float("inf") if i is None else i
        for p in range(len(data) - LENGTH + 1):
            w = data[p:p + LENGTH]
            first[w] = min(first.get(w, key), key)
    out = []
    for i, t in rows:
        data = (t or "").encode()
        key = float("inf") if i is None else i
        gone = [False] * len(data)
        for p in range(len(data) - LENGTH + 1):
            if first[data[p:p + LENGTH]] < key:
                gone[p:p + LENGTH] = [True] * LENGTH
        spans = [p for p in range(len(data)) if gone[p] and (p == 0 or not gone[p - 1])]
        out.append((-1 if i is None else i, len(data), len(spans), bytes(b for b, g in zip(data, gone) if not g)))
    return sorted(out)


def result(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in df.collect())


def test_against_brute_force(documents):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(30) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [prose(rng.randrange(0, 25))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 2)
            parts += [s[a:a + rng.randrange(30, 130)], prose(rng.randrange(0, 6))]
        rows.append((rng.randrange(1000), "".join(parts)))
    rows += [rows[3], (rows[4][0], rows[5][1]), (None, rows[6][1]), (None, rows[6][1]), (7, None), (8, ""), (9, "x" * 49),
             (10, "a" * 400), (11, "a" * 90 + "b"), (12, "ab" * 100), (13, shared[0] * 3)]
    assert result(repeated_passages(documents(rows))) == brute(rows)


def test_anchors_with_many_contexts(documents):
    """Windows of hot anchors are dealt by content and give the same result."""
    rng = random.Random(3)
    passage = "the quick brown fox jumps over the lazy dog and runs far away from here"
    rows = [(i, "".join(rng.choice("abc ") for _ in range(30)) + passage + "".join(rng.choice("abc ") for _ in range(30))) for i in range(40)]
    for many in (0, 2, 10):
        assert result(repeated_passages(documents(rows), many=many)) == brute(rows)


def test_other_columns_and_characters(documents):
    text = "é" * 60
    df = documents([(1, text), (2, "x" + text[:40] + "y")])
    rows = {r.doc_id: r for r in repeated_passages(df, whole_characters=True).collect()}
    assert rows[1].kept.decode() == text and rows[2].kept.decode() == "xy"
    assert rows[2].rest.block == 1 and rows[2].rest.fp == 1


def test_empty(documents):
    assert repeated_passages(documents([])).collect() == []


def test_loser_tree():
    rng = random.Random(5)
    for n in (1, 2, 3, 7):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(ROW)) for _ in range(rng.randrange(1, 30))) for _ in range(n)]
        runs = [r[:1] * 2 + r for r in runs]
        runs = [sorted(r) for r in runs]
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), ROW)
        coded = [iter([(common(a, b) if a else 0, b) for a, b in zip([b""] + r, r)]) for r in runs]
        got = list(merge(coded))
        assert [row for _, _, row in got] == sorted(x for r in runs for x in r)
        for (_, _, a), (_, known, b) in zip(got, got[1:]):
            assert known == common(a, b)


def test_shards_are_even():
    """No shard gets over 1.5 times the mean of the keys or of the suffixes."""
    import numpy as np
    from flowloom.llm.common import cut
    from flowloom.llm.suffixes import Block
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 123, 900, dtype=np.uint8)) for _ in range(1000)]
    block = Block(np.arange(1000), texts)
    sizes = np.diff(cut(block.keys, 32))
    assert sizes.sum() == len(block.keys) and sizes.max() <= 1.5 * sizes.mean()
    none = np.zeros(len(block.keys), bool)
    rows = block.suffixes(~none, none, 32)[0]
    sizes = np.bincount(rows[:, 0].astype(int) << 8 | rows[:, 1], minlength=32)
    assert len(sizes) == 32 and sizes.max() <= 1.5 * sizes.mean()


def test_anchors_at_text_and_piece_edges(monkeypatch):
    """Each window once, with the leftmost least hash of its own, also where texts are
    shorter than a window or a piece ends inside one."""
    import numpy as np
    from flowloom.llm import suffixes as s
    monkeypatch.setattr(s, "PIECE", 97)
    rng = np.random.default_rng(4)
    texts = [rng.integers(97, 100, n, dtype=np.uint8) for n in (300, 3, 49, 50, 1, 51, 10, 700, 60, 5)] + [np.zeros(200, np.uint8)]
    ends = np.cumsum([len(t) for t in texts])
    starts, flat = ends - [len(t) for t in texts], np.concatenate(texts)
    found = {}
    for _, anchor, first, last in s._pieces(flat, starts, ends):
        for a, p, q in zip(anchor, first, last):
            for window in range(p, q + 1):
                assert window not in found
                found[window] = int(a)
    upper = s._grams(flat) >> np.uint64(21)
    want = {p: p + int(np.argmin(upper[p:p + s.REACH])) for x, y in zip(starts, ends) for p in range(x, y - s.LENGTH + 1)}
    assert found == want
