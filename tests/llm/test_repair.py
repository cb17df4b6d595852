"""The repair against brute force: all edit sequences up to a cost."""

import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from flowloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
INK = re.compile(r"[^\x20\x09-\x0D]")
MOVES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def best(letters):
    """Cheapest edits of a string of letters, by plain recursion row by row."""
    @functools.cache
    def go(at, state, inserted):
        ways = []
        if at == len(letters):
            if state in ("", "a"):
                ways.append((0, ""))
        else:
            c = letters[at]
            cost, rest = go(at + 1, state, 0)
            ways.append((cost + 4, "D" + rest))
            if c not in "bd":
                for edit, roles, price in (("K", c.lower(), 0), ("R", "ua", 3)):
                    for role in roles:
                        if (state, role) in MOVES:
                            cost, rest = go(at + 1, MOVES[state, role], 0)
                            ways.append((cost + price + 3 * c.isupper(), edit + rest))
        if inserted < 3:  # more in a row are never cheaper
            for role in "ua":
                if (state, role) in MOVES:
                    cost, rest = go(at, MOVES[state, role], inserted + 1)
                    ways.append((cost + 3, "I" + rest))
        return min(ways) if ways else (1 << 30, "")
    return go(0, "", 0)


def expected(rows):
    """One conversation's report from its damaged rows (turn, role, text)."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    letters, seen = "", set()
    for _, role, text in rows:
        letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
        ink = INK.findall(text)
        letters += "b" if not ink else "d" if (role, text) in seen else letter if ink[-1] in ".!?" else letter.upper()
        seen.add((role, text))
    turns = [t for t, *_ in rows if t is not None]
    firsts = [r[:1] for _, r, _ in rows]
    cost, audit = best(letters)
    out, state, at = [], "", 0
    for edit in audit:
        if edit != "I":
            row = rows[at]
            at += 1
            if edit == "D":
                continue
        due = "assistant" if state == "u" else "user"
        role, text = (row[1], row[2]) if edit == "K" else (due, row[2]) if edit == "R" else (due, "")
        out.append(f"{role}:{text}")
        state = role[:1]
    assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in out))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, letters.count("b"), letters.count("d"),
            sum(c.isupper() for c in letters), sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:])),
            cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def test_matrices_equal_recursion():
    rng = random.Random(3)
    strings = ["".join(rng.choice("bdsuaoSUAO") for _ in range(rng.randrange(9))) for _ in range(1500)]
    strings += ["ua" * 30 + "x".replace("x", c) + "ua" * 30 for c in "bduaS"]
    for s, found in zip(strings, repair.solve(strings)):
        assert repair.closed(found) == best(s), s


def test_grammar_gives_back_the_strings():
    rng = random.Random(4)
    strings = ["".join(rng.choice("ua") for _ in range(rng.randrange(40))) for _ in range(200)] + ["", "a", "aaaaaaa"]
    rules, lines = repair.grammar(strings)

    def spelt(symbol):
        return symbol if isinstance(symbol, str) else "".join(map(spelt, rules[symbol]))
    assert ["".join(map(spelt, line)) for line in lines] == strings
    assert len(rules) > 5 and sum(map(len, lines)) < sum(map(len, strings)) / 3


def test_ropes_order_as_texts():
    rng = random.Random(5)

    def rope(text):
        if len(text) < 2 or rng.random() < 0.2:
            return repair.Rope(text)
        cut = rng.randrange(len(text) + 1)
        return repair.Rope(rope(text[:cut]), rope(text[cut:]))
    texts = ["".join(rng.choice("DK") for _ in range(rng.randrange(7))) for _ in range(60)]
    assert all((rope(a) < rope(b)) == (a < b) for a in texts for b in texts)


def conversations(rng, n=60):
    rows = []
    for c in range(n):
        for turn in range(rng.randrange(9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "up"])
            text = rng.choice(["Yes.", "No", "What?", " \t", "", None, "A!\n", "Ünd.", "long " * 500 + "."])
            rows.append((c if c else None, turn if rng.random() < 0.9 else rng.choice([None, turn + 3, 0]), role, text))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


def check(df, got):
    want: dict = {}
    for r in df.collect():
        want.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    assert {r[0] for r in got} >= set(want) and len(got) == len({r[0] for r in got})
    for r in got:
        assert tuple(r[1:]) == expected(want.get(r.conv_id, [])), r.conv_id


@pytest.mark.parametrize("piece,hot", [(4096, 10_000), (3, 4)])
def test_reports_equal_brute_force(spark, monkeypatch, piece, hot):
    monkeypatch.setattr(repair, "PIECE", piece)
    monkeypatch.setattr(repair, "HOT_ROWS", hot)
    df = spark.createDataFrame(conversations(random.Random(6)), SCHEMA).withColumns({"pos": F.lit(1), "kind": F.lit("x"), "letters": F.lit(2)})
    every = spark.createDataFrame([(1,), (1,), (999,), (None,)], "conv_id long")
    got = repair.repaired(df, every).collect()
    check(df, got)
    assert tuple(next(r for r in got if r.conv_id == 999)[1:]) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_damage(spark):
    rows = [(c, t, "assistant", "Yes. No!") for c in range(40) for t in range(3)] + [(None, None, None, None)]
    got = sorted(map(tuple, repair.damaged(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        want += [] if kind == 0 else [row] * (1 + (kind == 3))
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    assert repair.repaired(spark.createDataFrame([], SCHEMA)).count() == 0
