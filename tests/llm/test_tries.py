"""The prefix trie against one built in memory."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from flowloom.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    own: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, tie), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    nodes: dict = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append((c, d == len(path)))
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[:len(path)] == path]
        ends = ",".join(str(c) for c, end in sorted(members) if end)
        out.append((min(c for c, _ in members), len(path), min(c for c, _ in nodes[path[:-1]]) if path else None, len(members),
                    sum(len(p) == len(path) + 1 for p in below),
                    sum(not any(q[:-1] == p and q for q in nodes) for p in below),
                    sum((len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(rng, n=70, longest=7):
    rows = []
    for c in rng.sample(range(-15, 150), n):
        for t in range(rng.randrange(longest)):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "user", None]), rng.choice(["a b", "c", "", None, " d  e\tf "])))
    rows += [(3, 1, "user", "c")] * 3 + [(None, 1, "user", "lost")]
    rows += [(200, t, "user", f"w{t % 3}") for t in range(40)] + [(201, t, "user", f"w{t % 3}") for t in range(30)]
    rows += [(c, t, "user", "same words here") for c in range(300, 340) for t in range(3)]
    return rows


@pytest.mark.parametrize("limits", [{}, {"BAND": 3, "WIDE": 4, "SLICE": 4, "HOT_ROWS": 10, "QUEUED": 2}, {"WIDE": 1000, "BAND": 5}])
def test_trie_equals_one_in_memory(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(tries, name, value)
    rows = conversations(random.Random(8))
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit(1), "p1": F.lit("x"), "words": F.lit(2)})
    assert sorted(map(tuple, tries.trie(df).collect()), key=str) == expected(rows)


def test_no_rows_and_no_ids(spark):
    assert tries.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert tries.trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0


def test_queue_spills(tmp_path):
    rng = random.Random(9)
    queue, kept, popped = tries.SpillingQueue(str(tmp_path), 20), [], []
    for _ in range(2000):
        if rng.random() < 0.7:
            entry = (rng.randrange(-99, 99), rng.randrange(5), -rng.randrange(5))
            queue.push(entry)
            kept.append(entry)
        elif kept:
            least = min(kept)
            assert queue.first() == least and queue.pop() == least
            kept.remove(least)
    while kept:
        popped.append(queue.pop())
        kept.remove(popped[-1])
    assert popped == sorted(popped) and queue.first() is None and len(queue.paths) > 10
    queue.close()
    assert not list(tmp_path.iterdir())
