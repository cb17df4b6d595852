import random
import re

from flowloom.llm.similar import near_copies


def plain(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def alike(a, b):
    return a == b or (len(a & b) > 0 and 5 * len(a & b) >= 4 * len(a | b))


def components(sets):
    root = list(range(len(sets)))
    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    for i in range(len(sets)):
        for j in range(i):
            if find(i) != find(j) and alike(sets[i], sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def corpus(rng):
    """Texts, copies with a few words changed, and chains of such copies."""
    words = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(150):
        text = [rng.choice(words) for _ in range(rng.randrange(60, 400))]
        out.append(" ".join(text))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            for _ in range(max(1, int(len(text) * rng.choice([0.005, 0.01, 0.018])))):
                text[rng.randrange(len(text))] = rng.choice(words)
            out.append(" ".join(text))
    return out


def test_against_brute_force(documents):
    """Nothing is joined without a chain of links; nearly all links are found."""
    rng = random.Random(3)
    texts = corpus(rng)
    group = [rng.choice("abcdefgh") + f"{i}" for i in range(300)]  # a large group of near copies
    for i in range(120):
        texts.append(" ".join(group[:i + 60] + [f"new{i}"] + group[i + 60:]))
    rng.shuffle(texts)
    got = {r.doc_id: r.component_id for r in near_copies(documents(list(enumerate(texts)))).collect()}
    part = components([plain(t) for t in texts])
    least = {}
    for i, p in enumerate(part):
        least[p] = min(i, least.get(p, i))
    assert len(got) == len(texts)
    assert all(part[c] == part[i] and c <= i for i, c in got.items())
    copies = [i for i, p in enumerate(part) if least[p] != i]
    found = sum(got[i] != i for i in copies)
    assert len(copies) > 200 and found >= 0.97 * len(copies)


def test_edge_cases(documents):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(5, text), (3, text.upper()), (None, text + " end"), (3, text), (7, None), (8, ""), (9, " \n"), (None, "alone here"), (10, "one two"),
            (11, "one  TWO"), (12, "long " * 50_000 + "x"), (12, "long " * 50_000 + "x"), (13, "word1 word2 word3 word4 word5 word6")]
    got = sorted(((-1 if r.doc_id is None else r.doc_id), (-1 if r.component_id is None else r.component_id))
                 for r in near_copies(documents(rows)).collect())
    assert got == sorted([(5, 3), (3, 3), (-1, 3), (3, 3), (7, 7), (8, 7), (9, 7), (-1, -1), (10, 10), (11, 10), (12, 12), (12, 12), (13, 13)])
    assert near_copies(documents([])).collect() == []


def test_shards_put_out_two_rows_a_class(spark):
    """Rows out of a shard do not grow with the square of a group."""
    import numpy as np
    from flowloom.llm.similar import candidates
    rows = {}
    for size in (200, 400, 800):
        rng = np.random.default_rng(1)
        base = rng.integers(0, 1 << 32, 6, dtype=np.uint64)
        data = []
        for i in range(size):
            fp = base ^ (np.uint64(1) << rng.integers(0, 32, 6, dtype=np.uint64))
            data.append((i, *fp.astype("<u4").view("<i8").tolist()))
        found = candidates(spark.createDataFrame(data, "node long, fp0 long, fp1 long, fp2 long"))
        rows[size] = found.count()
        assert rows[size] <= 2 * 48 * size
    assert rows[800] <= 2.5 * rows[400] <= 6.25 * rows[200]


def test_every_pair_that_meets_is_joined(documents):
    """Where the closest partner by bits does not hold, another one may."""
    import numpy as np
    from flowloom.llm.similar import MOST_BITS, RADIUS, fingerprints, shingles
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randrange(60, 120))]
        for _ in range(25):  # most pairs are near 0.8, on either side
            text = list(base)
            text[rng.randrange(4, len(text) - 4)] = rng.choice(words)
            texts.append(" ".join(text))
    hashes = [shingles(t.encode()) for t in texts]
    sets = [plain(t) for t in texts]
    fps = np.stack([fingerprints(h) for h in hashes]).view("<u4")
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    for i in range(len(texts)):
        apart = np.bitwise_count(fps[i] ^ fps[:i])
        for j in np.flatnonzero((apart.min(axis=1) <= RADIUS) & (apart.sum(axis=1) <= MOST_BITS)):
            if find(i) != find(int(j)) and alike(sets[i], sets[j]):
                a, b = sorted((find(i), find(int(j))))
                root[b] = a
    got = {r.doc_id: r.component_id for r in near_copies(documents(list(enumerate(texts)))).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    assert 40 < len(set(got.values())) < len(texts) / 2


def test_pairs_of_other_groups(spark):
    """All pairs of different roots, each once; none within a root."""
    import numpy as np
    from flowloom.llm.similar import MOST_BITS, RADIUS, other_groups
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 32, (3, 6), dtype=np.uint64)
    flips = lambda: (np.uint64(1) << rng.integers(0, 32, 6, dtype=np.uint64))
    fps = np.array([base[i % 3] ^ flips() ^ flips() ^ flips() for i in range(150)]).astype("<u4")
    data = [(i, *fps[i].view("<i8").tolist(), i % 10) for i in range(150)]
    found = [(r.a, r.b) for r in other_groups(spark.createDataFrame(data, "node long, fp0 long, fp1 long, fp2 long, root long")).collect()]
    apart = np.bitwise_count(fps[:, None] ^ fps[None])
    want = [(a, b) for a in range(150) for b in range(a + 1, 150) if a % 10 != b % 10
            and apart[a, b].min() <= RADIUS and apart[a, b].sum() <= MOST_BITS]
    assert sorted(found) == want and len(want) > 1000


def test_rows_do_not_grow_with_the_square_of_a_group(documents, monkeypatch):
    """Texts that meet, but are less than 0.8 alike, travel once a shard, not once a pair."""
    from flowloom.llm import similar
    stored, write = {}, similar.write_table

    def counted(df, name):
        out = write(df, name)
        stored[name] = out.count()
        return out
    monkeypatch.setattr(similar, "write_table", counted)
    base, most = [f"w{i}" for i in range(60)], {}
    for size in (200, 800):
        rng = random.Random(7)
        texts = []
        for i in range(size):
            text = list(base)
            for k in rng.sample(range(4, 56), 1):
                text[k] = f"new{i}"
            texts.append(" ".join(text))
        found = similar.near_copies(documents(list(enumerate(texts)))).collect()
        part = components([plain(t) for t in texts])
        assert all(part[r.component_id] == part[r.doc_id] for r in found)
        assert len(found) == size and stored["shingle_marked"] > size / 2
        most[size] = max(stored.values())
    assert most[800] <= 6 * most[200]


def test_parts_of_a_large_group(monkeypatch):
    """A group over the size of a bin is cut into blocks: each pair is checked in one part."""
    import numpy as np
    from flowloom.llm import similar
    parent = np.array([0, 0, 2, 3, 3, 3, 3, 3, 8, 8])
    monkeypatch.setattr(similar, "MOST_HASHES", 20)
    parts = {}
    for i, bin_, part, block in zip(*similar._bins(parent, np.full(10, 10))):
        parts.setdefault((bin_, part), {})[i] = block
    for a in range(10):
        for b in range(a):
            together = [x for x in parts.values() if a in x and b in x]
            checked = [x for x in together if len({*x.values()}) == 1 or x[a] != x[b]]
            assert parent[a] != parent[b] or len(checked) == 1
    assert len(parts) > 6 and not any(2 in x for x in parts.values())
    assert [len(x) for x in similar._bins(np.arange(4), np.ones(4, np.int64))] == [0] * 4
