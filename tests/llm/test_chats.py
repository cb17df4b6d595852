import hashlib
import random

import pytest
from pyspark.sql import functions as F

from flowloom.llm import chats

MESSAGES = "tree long, id long, parent long, role string, text string, score double"
PARTS = ["<", ">", "|", "im_end", "im_start", "endoftext", "s", "/", "[", "]", "INST", "\\", "SYS", "n", "\n", "é",
         "<|im_end|>", "</s>", "[/INST]", "<<SYS>>"]


def noise(rng, n=9):
    return "".join(rng.choice(PARTS) for _ in range(rng.randrange(n)))


def test_escapes_are_undone_and_hide_control_strings():
    rng = random.Random(1)
    for _ in range(20_000):
        text = noise(rng)
        hidden = chats.escape(text)
        assert chats.unescape(hidden) == text and not chats._CONTROL.search(hidden)


def best_paths(rows, branches):
    """Chosen paths by walking from every leaf."""
    nodes: dict = {}
    for tree, i, parent, role, text, score in rows:
        if i is None:
            continue
        entry = (role or "", text or "", (parent is not None, parent or 0), score or 0.0)
        at = nodes.setdefault((tree, i), entry)
        nodes[tree, i] = min(at, entry)
    up = {(t, i): n[2][1] if n[2][0] and (t, n[2][1]) in nodes else None for (t, i), n in nodes.items()}
    asked = {(t, n[2][1]) for (t, _), n in nodes.items() if n[2][0]}
    found: dict = {}
    for tree, leaf in nodes:
        path, at = [], leaf
        while at is not None and at not in path:
            path.append(at)
            at = up[tree, at]
        if at is None and (tree, leaf) not in asked:
            mean = sum(nodes[tree, i][3] for i in path) / len(path)
            found.setdefault((tree, path[-1]), []).append((-mean, -len(path), leaf, path[::-1]))
    out = []
    for (tree, _), ways in found.items():
        for branch, (_, _, leaf, path) in enumerate(sorted(ways)[:branches], 1):
            out.append((tree, leaf, branch, [(nodes[tree, i][0], nodes[tree, i][1]) for i in path]))
    return sorted(out, key=str)


def messages(rng):
    rows = []
    for tree in [*range(12), None]:
        n = rng.randrange(1, 25)
        for i in range(n):
            parent = None if i == 0 or rng.random() < 0.05 else rng.choice([i - 1, rng.randrange(i), 999 if rng.random() < 0.1 else i - 1])
            rows.append((tree, i, parent, rng.choice(["user", "assistant", "assistant", None, "to\nol\\n", ""]), noise(rng),
                         rng.choice([None, 0.0, 1.0, 2.0, -1.0])))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    rows += [(50, 1, 2, "user", "round", 1.0), (50, 2, 1, "user", "and round", 1.0), (50, 3, 1, "user", "hangs on it", 1.0)]
    return rows + [(51, i, i - 1 if i else None, "assistant", f"<s>{i}\\", 0.5) for i in range(70)] + [(52, None, 1, "user", "lost", 1.0)]


@pytest.mark.parametrize("branches", [1, 3])
def test_paths_and_round_trip(spark, branches):
    rows = messages(random.Random(2))
    df = spark.createDataFrame(rows, MESSAGES).withColumns({"leaf": F.lit(1), "branch": F.lit("x"), "up": F.lit(2)})
    got = chats.read_back(chats.conversations(df, branches)).collect()
    want = best_paths(rows, branches)
    assert sorted(((r.tree, r.leaf, r.branch, [tuple(t) for t in r.turns]) for r in got), key=str) == want
    for r in got:
        assert r.learned == "".join(t.text for t in r.turns if t.role == "assistant")
        assert all("\\" not in r.text[x.start:x.end] or chats.unescape(r.text[x.start:x.end]) in [t.text for t in r.turns] for x in r.loss)


def test_linear_conversations(spark, monkeypatch):
    monkeypatch.setattr(chats, "HOT_ROWS", 20)
    rng = random.Random(3)
    rows = [(c, rng.choice([None, t, t, t]), rng.choice(["user", "assistant", None]), noise(rng)) for c in (1, 2, 3, None) for t in range(rng.randrange(1, 9))]
    rows += [(9, t, "user", f"t{t}") for t in range(300)] + rows[:3]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("score", F.lit("x"))
    got = {r.tree: r for r in chats.read_back(chats.conversations(chats.as_tree(df), unique=True)).collect()}
    want: dict = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((t is not None, t or 0, role or "", text))
    assert set(got) == set(want)
    for c, said in want.items():
        assert [tuple(t) for t in got[c].turns] == [r[2:] for r in sorted(said, key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))]


def test_no_rows(spark):
    assert chats.conversations(spark.createDataFrame([], MESSAGES)).count() == 0
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chats.read_back(chats.conversations(chats.as_tree(none), unique=True)).count() == 0


def test_template():
    begin, end = chats.BEGIN, chats.END
    head, text = f"{begin}user\n", chats.escape("</s>[INST] ok [/INST]")
    assert text == "<\\/s>[\\INST] ok [\\/INST]" and len(head) + len(text) + len(end) + 1 == 52
    assert hashlib.sha256(chats.unescape(text).encode()).hexdigest() == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()
