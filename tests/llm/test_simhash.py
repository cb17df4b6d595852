import random
import re

import xxhash

from flowloom.llm.simhash import fingerprint, near_duplicates


def plain(text):
    data = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(fps):
    root = list(range(len(fps)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def texts():
    rng = random.Random(1)
    base = [" ".join(rng.choice("alpha beta Gamma delta eps zeta eta".split()) for _ in range(rng.randrange(1, 80))) for _ in range(40)]
    near = [t.replace("beta", "BETA", 1) + rng.choice(["", " ", "\n", " new"]) for t in base]
    return base + near + base[:5] + [None, "", " \n\t", "one", "ünï ΣΑΣ", "long " * 50_000]


def test_fingerprints():
    for t in texts():
        assert fingerprint((t or "").encode()) == plain(t)


def test_components(documents):
    all_texts = texts()
    rows = [(i * 3 % len(all_texts) if i % 10 else None, t) for i, t in enumerate(all_texts)]
    rows += rows[:3]  # repeated rows
    got = near_duplicates(documents(rows)).collect()
    assert len(got) == len(rows)
    fps = [plain(t) for _, t in rows]
    part = components(fps)
    want = []
    for (i, _), f, p in zip(rows, fps, part):
        ids = [d for (d, _), q in zip(rows, part) if q == p and d is not None]
        want.append((i, f, min(ids) if ids else None))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=key) == sorted(want, key=key)


def test_chain_of_links(spark):
    """Components over long chains, and links that only meet in the middle."""
    from flowloom.llm.components import components as linked
    from flowloom.llm.simhash import links
    chain = [0]
    rng = random.Random(4)
    for _ in range(60):
        bits = rng.sample(range(64), 4)
        chain.append(chain[-1] ^ sum(1 << b for b in bits))
    chain = list(dict.fromkeys(chain))
    signed = [c - 2**64 if c >= 2**63 else c for c in chain]
    got = linked(links(spark.createDataFrame([(c,) for c in signed], "fp long"))).collect()
    part = components(chain)
    assert {r.node: r.root for r in got} == {c: min(s for s, q in zip(signed, part) if q == p) for c, p in zip(signed, part)}


def test_empty(documents):
    assert near_duplicates(documents([])).collect() == []


def test_linear_shards_find_every_variant():
    import numpy as np
    from flowloom.llm.simhash import Cosets, masks
    flips = masks(2)
    values = np.random.default_rng(1).integers(0, 1 << 63, 50, dtype=np.uint64)
    for bits, fine in ((3, 0), (7, 2), (13, 1)):
        cosets = Cosets(flips, bits, fine)
        cells, found = cosets.cell(values), []
        for shard in range(1 << bits):
            for part in range(1 << fine):
                variant, owner = cosets.variants(values, cells, shard << fine | part)
                assert (np.diff(owner) >= 0).all()
                assert set((cells[owner] >> fine ^ shard).tolist()) <= set(cosets.shards.tolist())
                found += zip(owner.tolist(), variant.tolist())
        assert sorted(found) == sorted((i, int(v)) for i in range(50) for v in values[i] ^ flips)


def test_shards_bound_a_task():
    from flowloom.llm.simhash import SHARD_FINGERPRINTS, SHARD_VARIANTS, shard_bits
    assert shard_bits(0, 2081) == shard_bits(1_000_000, 2081) == 7
    for count in (10**8, 10**10):
        n = 2**shard_bits(count, 2081)
        assert count * min(1, 2081 / n) <= SHARD_FINGERPRINTS and count * 2081 / n <= SHARD_VARIANTS


def test_links_of_a_near_copy_group_are_linear(spark):
    """A shard puts out one row for each of its fingerprints at most."""
    from flowloom.llm.simhash import links
    rows = {}
    for size in (250, 500, 1000):
        rng = random.Random(7)
        ball = [1 << i | 1 << j for i in range(48) for j in range(i)]  # each two are within 4 bits
        group = rng.sample(ball, size)
        found = links(spark.createDataFrame([(g,) for g in group], "fp long")).collect()
        assert len({(r.a, r.b) for r in found}) == len(found) <= 128 * size
        rows[size] = len(found)
        assert size - 1 <= rows[size]
    assert rows[1000] <= 2.5 * rows[500] <= 6.25 * rows[250]
