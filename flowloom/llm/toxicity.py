"""Toxicity by a weighted finite-state grammar over clauses.

Five small transducers read the words of a clause: insult, threat, target,
negation and reported speech. They are composed into one automaton whose state
holds how far back a target or a negation was and whether the clause reports
what someone said; on an insult or a threat it puts out a match of a kind: with
or without a target, negated or not, reported or not. A target soon after a
match counts as well. A text's score is a logistic function of its matches by
kind. The weights are learned from labelled texts, and so are insults that the
word list does not have: words of a few toxic texts at least whose smoothed
share of toxic texts is high. They make two classes by that share, and the
regression weighs each class. It sees every labelled text through the words
that the other folds taught, so that rare words look no better than they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import product
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowloom.llm.common import slim
from flowloom.runtime import write_table

SAMPLE_ROWS = 20_000   # labelled rows that are learned from, about
NEAR_NEGATION, NEAR_TARGET = 3, 4
SUPPORT = 4            # toxic texts that must have a word, whatever their share of all
PRIOR = 2.0            # texts of the usual mix that each word's counts are smoothed with
SURE, LIKELY = 0.8, 0.6  # smoothed share of toxic texts among those with a word, by class
FOLDS = 5

WORDS = {
    "insult": """idiot idiots moron morons stupid dumb fool fools loser losers clown clowns scum trash garbage filth vermin worthless pathetic
        disgusting jerk bastard imbecile cretin dimwit halfwit scumbag lowlife creep pig swine rat coward liar freak
        idiota idiotas estúpido estúpida imbécil tonto tonta basura asqueroso asquerosa inútil patético patética
        idiote idiotes imbéciles stupide crétin ordure ordures dégoûtant pathétique minable nul
        dummkopf trottel abschaum dumm widerlich wertlos erbärmlich müll versager""",
    "threat": """kill killed hurt destroy shoot stab beat smash crush strangle murder burn
        matar mataré destruir tuer tuerai détruire töten umbringen zerstören""",
    "target": """you your you're yourself u he she they him her them his their these those all
        tú usted ustedes eres él ella ellos tu vous il elle ils es du ihr sie er dich euch""",
    "negation": "not no never isn't aren't wasn't don't doesn't didn't won't nobody nothing neither nor hardly ni nunca jamás pas jamais nicht kein keine nie",
    "reported": """said says saying told tells wrote writes claimed claims called calls quoted quote quotes reported reportedly alleged
        dijo dice escribió llamó dit écrit appelé sagte sagt schrieb nannte zitat""",
}
MATCHED = ("insult", "threat", "sure", "likely")  # the last two are learned insults
_CLASSES = ["other", "target", "negation", "reported", *MATCHED]
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_CLAUSE = re.compile(r"[.;:!?\n]+")
KINDS = [f"{c}{t}{n}{r}" for c in MATCHED for t in ("", " target") for n in ("", " negated") for r in ("", " reported")]


def compose() -> tuple[dict, dict]:
    """Transitions and outputs of the composed automaton, by (state, class).
    State: (words left in reach of a target, of a negation, reported)."""
    step, out = {}, {}
    for state in product(range(NEAR_TARGET + 1), range(NEAR_NEGATION + 1), (0, 1)):
        target, negation, reported = state
        for c in _CLASSES:
            after = (NEAR_TARGET if c == "target" else max(0, target - 1), NEAR_NEGATION if c == "negation" else max(0, negation - 1),
                     1 if c == "reported" else reported)
            step[state, c] = after
            if c in MATCHED:
                out[state, c] = (c, target > 0, negation > 0, reported)
    return step, out


class Grammar:
    """The automaton over a word list."""

    def __init__(self, sure: tuple[str, ...] = (), likely: tuple[str, ...] = ()):
        self.words = {w: c for c in reversed(list(WORDS)) for w in WORDS[c].split()}
        self.words.update({w: "sure" for w in sure})
        self.words.update({w: "likely" for w in likely})
        self.matched = {w for w, c in self.words.items() if c in MATCHED}
        self.step, self.out = compose()

    def clause(self, words: list[str]) -> Counter:
        """Matches of a clause by kind."""
        state, found = (0, 0, 0), []
        for i, w in enumerate(words):
            c = self.words.get(w, "other")
            hit = self.out.get((state, c))
            if hit:
                found.append((i, *hit))
            elif c == "target":  # also a target of matches just before
                found = [(j, k, t or i - j <= NEAR_TARGET, n, r) for j, k, t, n, r in found]
            state = self.step[state, c]
        return Counter(f"{k}{' target' * bool(t)}{' negated' * bool(n)}{' reported' * bool(r)}" for _, k, t, n, r in found)

    def features(self, text: str | None) -> list[float]:
        """log(1 + matches) by kind, whether there is any that is neither
        negated nor reported, and how many clauses match, of a whole text. For
        these two the words that are only likely insults do not count."""
        low = (text or "").lower()
        words = _WORD.findall(low)
        found: Counter = Counter()
        clauses = 0
        if not self.matched.isdisjoint(words):
            for part in _CLAUSE.split(low):
                own = _WORD.findall(part)
                if not self.matched.isdisjoint(own):
                    kinds = self.clause(own)
                    found.update(kinds)
                    clauses += any(not k.startswith("likely") for k in kinds)
        plain = any(n for k, n in found.items() if "negated" not in k and "reported" not in k and not k.startswith("likely"))
        return [*(float(np.log1p(found[k])) for k in KINDS), float(plain), float(np.log1p(clauses))]


@dataclass
class Model:
    sure: tuple[str, ...]
    likely: tuple[str, ...]
    weights: np.ndarray  # bias first

    @property
    def learned(self) -> tuple[str, ...]:
        return tuple(sorted(self.sure + self.likely))

    def score(self, grammar: Grammar, text: str | None) -> float:
        return float(1 / (1 + np.exp(-(self.weights[0] + np.dot(self.weights[1:], grammar.features(text))))))


def purity(toxic, n, share):
    """Share of toxic texts among those with a word, smoothed by the usual
    share; of numbers and of columns."""
    return (toxic + PRIOR * share) / (n + PRIOR)


def lexicon(counts: list[tuple[str, int, int]], share: float) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Sure and likely insults by (word, toxic texts, texts)."""
    known = sorted((w, purity(t, n, share)) for w, t, n in counts if t >= SUPPORT)
    return tuple(w for w, s in known if s >= SURE), tuple(w for w, s in known if LIKELY <= s < SURE)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model from texts and (doc_id, toxic), on about ``rows`` labelled rows
    chosen by hash. Labels that are null, and ids without text, are left out;
    without labels every score is one half."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("labelled"), F.col("toxic").cast("int").alias("toxic"))
    total = known.count()
    part = F.xxhash64(F.lit(11), F.col("labelled")) / F.lit(float(1 << 63))
    sample = known.filter(part < min(2.0, 2.0 * rows / max(1, total)) - 1 + 1e-12)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Broadcast: about ``rows`` pairs of numbers, whatever the table's size.
    fold = F.pmod(F.xxhash64(F.lit(12), F.col("doc_id")), F.lit(FOLDS)).cast("int").alias("fold")
    texts = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("labelled")).select("text", "toxic", fold)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in parts:
            for t, y, k in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), b.column("fold").to_pylist()):
                found.update((w, y, k) for w in {*_WORD.findall((t or "").lower()), ""})  # "" counts texts
        keys = list(found)
        yield pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
                               pa.array([k[2] for k in keys], pa.int32()), pa.array([found[k] for k in keys], pa.int64())], ["word", "y", "fold", "n"])

    # (toxic texts, texts) of each word, of all folds and without each of them.
    parts = [F.lit(True), *(F.col("fold") != k for k in range(FOLDS))]
    words = texts.mapInArrow(count, "word string, y int, fold int, n long").groupBy("word").agg(
        *(F.sum(F.when(p & (F.col("y") == 1), F.col("n")).otherwise(0)).alias(f"t{i}") for i, p in enumerate(parts)),
        *(F.sum(F.when(p, F.col("n")).otherwise(0)).alias(f"n{i}") for i, p in enumerate(parts)))
    words = write_table(words.filter(f"t0 >= {SUPPORT} OR word = ''"), "toxic-words")
    of_all = words.filter("word = ''").first()
    if not of_all or not of_all["t0"]:
        return Model((), (), np.zeros(len(KINDS) + 3) if not of_all else np.r_[-5.0, np.zeros(len(KINDS) + 2)])
    share = [of_all[f"t{i}"] / max(1, of_all[f"n{i}"]) for i in range(FOLDS + 1)]
    # A word comes to the driver if any of the lists can have it: of at most
    # 1 / SUPPORT of the words in the sample's toxic texts, those that are mostly toxic.
    able = [(F.col(f"t{i}") >= SUPPORT) & (purity(F.col(f"t{i}"), F.col(f"n{i}"), share[i]) >= LIKELY) for i in range(FOLDS + 1)]
    listed = Grammar().words
    found = [r for r in words.filter((F.length("word") > 2) & reduce(or_, able)).collect() if r["word"] not in listed]
    lists = [lexicon([(r["word"], r[f"t{i}"], r[f"n{i}"]) for r in found], share[i]) for i in range(FOLDS + 1)]
    shared = docs.sparkSession.sparkContext.broadcast(lists[1:])

    def look(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammars = [Grammar(*own) for own in shared.value]
        for b in parts:
            x = [grammars[k].features(t) for t, k in zip(b.column("text").to_pylist(), b.column("fold").to_pylist())]
            yield pa.record_batch([pa.array(x, pa.list_(pa.float64())), b.column("toxic")], ["x", "y"])

    seen = texts.mapInArrow(look, "x array<double>, y int").groupBy("x").agg(F.sum("y").alias("y"), F.count("*").alias("n")).toArrow()
    x = np.array(seen.column("x").to_pylist())
    y, n = seen.column("y").to_numpy().astype(float), seen.column("n").to_numpy().astype(float)
    return Model(*lists[0], regression(x, y, n))


def regression(x: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Logistic regression on rows with ``y`` hits in ``n`` trials."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w, lam = np.zeros(x.shape[1]), np.r_[1e-3, np.full(x.shape[1] - 1, penalty)]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(lam), x.T @ (n * p - y) + lam * w)
        w -= np.clip(step, -3, 3)
    return w


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) for each row of ``docs``, from the whole text
    alone. A null or empty text has the score of a text without matches.
    Repeated rows score alike; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        grammar = Grammar(model.sure, model.likely)
        for whole in parts:
            for b in slim(whole):
                found = [model.score(grammar, t) for t in b.column("text").to_pylist()]
                yield pa.record_batch([b.column("doc_id"), pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())],
                                      ["doc_id", "score", "predicted"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, score double, predicted int")
