import random

from pyspark.sql import functions as F

from flowloom.llm.toxicity import KINDS, Grammar, fit, scores


def test_clauses():
    g = Grammar()
    read = lambda text: dict(g.clause(text.split()))
    assert read("you are an idiot") == {"insult target": 1}
    assert read("idiot and moron") == {"insult": 2}
    assert read("the idiot you are") == {"insult target": 1}
    assert read("you are not an idiot") == {"insult target negated": 1}
    assert read("not a word of all this was stupid") == {"insult target": 1}  # the negation is too far away
    assert read("she said you idiot") == {"insult target reported": 1}
    assert read("kill it") == {"threat": 1}
    assert read("a nice day") == {}
    assert set(KINDS) >= {"insult", "threat target negated reported"}


def test_automaton_by_brute_force():
    g, rng = Grammar(), random.Random(1)
    words = ["you", "not", "said", "idiot", "kill", "house", "tree", "road"]
    for _ in range(300):
        clause = [rng.choice(words) for _ in range(rng.randrange(1, 12))]
        want = {}
        for i, w in enumerate(clause):
            if w in ("idiot", "kill"):
                target = any(clause[j] == "you" for j in range(max(0, i - 4), min(len(clause), i + 5)))
                negated = any(clause[j] == "not" for j in range(max(0, i - 3), i))
                kind = ("insult" if w == "idiot" else "threat") + " target" * target + " negated" * negated + " reported" * ("said" in clause[:i])
                want[kind] = want.get(kind, 0) + 1
        assert dict(g.clause(clause)) == want


def corpus():
    rng = random.Random(2)
    prose = lambda: " ".join(rng.choice("house tree road river stone bread water".split()) for _ in range(12))
    rows, labels = [], []
    for i in range(200):
        toxic = i % 4 == 0
        bad = rng.choice(["you idiot", "flurb flurb", "scum"]) if toxic else "he said idiot" if i % 10 == 1 else "not stupid" if i % 10 == 3 else ""
        rows.append((i, f"{prose()}. {prose()} {bad} {prose()}."))
        labels.append((i, int(toxic)))
    return rows, labels


def test_learning(documents, spark):
    rows, labels = corpus()
    model = fit(documents(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.learned == ("flurb",)
    odd = [(1000, None), (1001, ""), (None, "you idiot"), (1002, "you idiot. " * 50_000), (1002, "you idiot. " * 50_000)]
    got = scores(documents(rows + odd), model).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert all(by[i].predicted == y for i, y in labels)
    assert by[None].predicted == 1 and by[1002].predicted == 1 and by[1000].score == by[1001].score < 0.5
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_empty(documents, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = fit(documents([]), none)
    assert scores(documents([]), model).collect() == []
    assert scores(documents([(1, "x")]), fit(documents([(1, "x")]), none.union(spark.createDataFrame([(1, None)], "doc_id long, toxic int")))).first().predicted in (0, 1)
    assert fit(documents([(1, "x")]), spark.createDataFrame([(1, 0)], "doc_id long, toxic int")).weights[0] < 0
    assert F is not None


def test_recall_of_each_language_on_held_out_rows(documents, spark):
    """Insults of small languages are in few of all toxic texts, and in no list."""
    rng = random.Random(3)
    size = {"en": 600, "fr": 160, "de": 120, "es": 80}
    prose = {k: [f"{k}word{i}" for i in range(60)] for k in size}
    bad = {k: [f"{k}bad{i}" for i in range(4)] if k != "en" else ["idiot", "scum", "trash"] for k in size}
    rows, labels, lang = [], [], {}
    for k, n in size.items():
        for j in range(n):
            i, toxic = len(rows), j % 5 == 0
            words = [rng.choice(prose[k]) for _ in range(30)]
            for _ in range(3 * toxic):
                words.insert(rng.randrange(len(words)), rng.choice(bad[k]))
            rows.append((i, " ".join(words)))
            labels.append((i, int(toxic)))
            lang[i] = k
    held = {i for i in lang if (i // 5) % 4 == 0}
    model = fit(documents([r for r in rows if r[0] not in held]), spark.createDataFrame([y for y in labels if y[0] not in held], "doc_id long, toxic int"))
    said = {r.doc_id: r.predicted for r in scores(documents([r for r in rows if r[0] in held]), model).collect()}
    for k in size:
        hit = [said[i] for i, y in labels if y and i in held and lang[i] == k]
        assert len(hit) >= 4 and sum(hit) >= 0.75 * len(hit), (k, hit)
    clean = [said[i] for i, y in labels if not y and i in held]
    assert sum(clean) <= 0.02 * len(clean)
