"""Training and evaluating the two models with MLlib."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import MODEL_FEATURES
from ..runtime import write_table


@dataclass(frozen=True)
class TreeSettings:
    """Boosting settings. Full-size values are the defaults of each trainer."""

    rounds: int = 300
    depth: int = 10
    rate: float = 0.05
    subsample: float = 0.8
    column_share: float = 0.8
    bins: int = 64
    seed: int = 42


BINARY = TreeSettings(depth=10)
MULTICLASS = TreeSettings(depth=6)
ATTACK = TreeSettings(depth=9, rate=0.04, subsample=0.85, column_share=0.85)


AT_ONCE = 4  # models of one-against-rest that are fitted at the same time
PART_ROWS = 1 << 18  # rows of a partition that trees are fitted on

# --- preparation ------------------------------------------------------------

def index_labels(df: DataFrame, label: str, out: str = "label_index") -> tuple[DataFrame, list[str]]:
    """Class index in sorted order of the class names, and the names."""
    model = StringIndexer(inputCol=label, outputCol=out, stringOrderType="alphabetAsc").fit(df)
    return model.transform(df), list(model.labels)


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Weight rows / (classes * rows of the class). One row per class is joined on."""
    counts = write_table(df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")), "class_counts")
    totals = counts.agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("classes"))
    rows, classes = totals.select("rows").scalar(), totals.select("classes").scalar()
    weights = counts.select(F.col(label), (rows / (classes * F.col("_n"))).alias(out))
    return df.join(weights, label)


def scaler_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation of each column, as (feature, mean, std) rows."""
    parts = [p for c in columns for p in (F.lit(c), F.avg(c).cast("double"), F.stddev_pop(c).cast("double"))]
    return df.agg(F.array(*[F.struct(parts[i].alias("feature"), parts[i + 1].alias("mean"), parts[i + 2].alias("std"))
                            for i in range(0, len(parts), 3)]).alias("s")).select(F.inline("s"))


@dataclass(frozen=True)
class Scaler:
    mean: dict[str, float]
    std: dict[str, float]

    def column(self, name: str) -> Column:
        """A constant column scales by one, not by zero."""
        spread = self.std[name] or 1.0
        return (F.col(name).cast("double") - F.lit(self.mean[name])) / F.lit(spread)


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> Scaler:
    rows = scaler_stats(df, columns).collect()  # one row per feature
    return Scaler({r["feature"]: r["mean"] for r in rows}, {r["feature"]: r["std"] for r in rows})


def mutual_information(df: DataFrame, columns: Sequence[str], label: str, bins: int = 20,
                       edges: dict[str, Sequence[float]] | None = None) -> DataFrame:
    """Mutual information (nats) of each binned feature with the class.

    Features are cut at the given edges, or at approximate quantiles (a mergeable
    sketch). Tasks read each row once: they find bin numbers by binary search
    and keep one count per feature, bin and class, and only these are shuffled.
    A null is a bin of its own, a NaN lies above all edges.
    """
    probs = [i / bins for i in range(1, bins)]
    given = [edges[c] for c in columns] if edges else df.approxQuantile(list(columns), probs, 0.001)
    cuts = {c: sorted(set(inner)) for c, inner in zip(columns, given)}
    kind = df.schema[label].dataType.simpleString()
    values = df.select(F.col(label).alias("cls"), *[F.col(c).cast("double").alias(c) for c in columns])
    counts = values.mapInPandas(_bin_counts(cuts), f"feature string, bin int, cls {kind}, n bigint")
    return mutual_information_of(counts.groupBy("feature", "bin", "cls").agg(F.sum("n").alias("n")))


def _bin_counts(cuts: dict[str, list[float]]):
    """Rows of a task to counts by feature, bin and class."""
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for pdf in parts:
            codes, names = pd.factorize(pdf["cls"], use_na_sentinel=False)
            for feature, inner in cuts.items():
                value = pdf[feature].to_numpy("float64", na_value=np.nan)
                width = len(inner) + 2
                place = np.where(pdf[feature].isna(), width - 1, np.searchsorted(inner, value, side="left"))
                for at, n in enumerate(np.bincount(codes * width + place, minlength=len(names) * width)):
                    if n:
                        found[feature, at % width if at % width < width - 1 else None, _plain(names[at // width])] += int(n)
        rows = [(*key, n) for key, n in found.items()]
        out = pd.DataFrame(rows, columns=["feature", "bin", "cls", "n"])
        yield out.astype({"bin": "Int32", "n": "int64"})
    return count


def _plain(name):
    return None if pd.isna(name) else name


def mutual_information_of(counts: DataFrame) -> DataFrame:
    """From joint counts (feature, bin, cls, n), summed per feature."""
    def over(*cols: str) -> Column:
        return F.sum("n").over(Window.partitionBy("feature", *cols))
    total = over()
    term = (F.col("n") / total) * F.log(F.col("n") * total / (over("bin") * over("cls").cast("double")))
    parts = counts.select("feature", term.alias("part"))
    return parts.groupBy("feature").agg(F.greatest(F.sum("part"), F.lit(0.0)).alias("mi"))


def mutual_info_top_k(df: DataFrame, columns: Sequence[str], label: str, k: int) -> list[str]:
    """The k most informative features, in their given order."""
    best = mutual_information(df, columns, label).orderBy(F.desc("mi"), "feature").limit(k).collect()
    chosen = {r["feature"] for r in best}
    return [c for c in columns if c in chosen]


# --- models -----------------------------------------------------------------

@dataclass
class FlowModel:
    """A fitted classifier: scaling, chosen features, boosted trees (one model
    for two classes, else one per class) and optional calibration per class."""

    classes: list[str]
    features: list[str]            # the contract: columns that must be there
    selected: list[str]            # those the trees see
    scaler: Scaler
    members: list = field(default_factory=list)
    calibrators: list = field(default_factory=list)

    def _vector(self, df: DataFrame) -> DataFrame:
        scaled = {f"_x_{c}": self.scaler.column(c) for c in self.selected}
        assembler = VectorAssembler(inputCols=list(scaled), outputCol="_vector", handleInvalid="keep")
        return assembler.transform(df.withColumns(scaled)).drop(*scaled)

    def probabilities(self, df: DataFrame, out: str = "prob") -> DataFrame:
        """Add an array with the probability of each class, in class order.

        One Arrow function walks all trees over a batch at a time; a column for
        each member would be worked out anew wherever the total names it.
        """
        curves = [(np.array(c.boundaries), np.array(c.predictions)) for c in self.calibrators]
        score = F.arrow_udf(_scorer([_grown(m) for m in self.members], curves, len(self.classes)), "array<double>")
        return df.select("*", score(*[self.scaler.column(c) for c in self.selected]).alias(out))

    def predict(self, df: DataFrame, out: str = "predicted") -> DataFrame:
        """Add the class index with the highest probability."""
        rows = self.probabilities(df, "_prob")
        best = F.array_position("_prob", F.array_max("_prob")) - 1
        return rows.withColumn(out, best.cast("double")).drop("_prob")


_STEP = re.compile(r"(If|Else) \(feature (\d+) (<=|>) (\S+)\)|Predict: (\S+)")


def _grown(member) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The trees of a boosted model, each as its weight and its nodes: feature,
    threshold (value, on a leaf), and the two children. A leaf is its own child."""
    out = []
    for tree, weight in zip(member.trees, member.treeWeights):
        feature, value, children, open_nodes = [], [], [], []
        for turn, index, _, threshold, leaf in _STEP.findall(tree.toDebugString):
            if turn == "Else":
                continue  # its condition is the one of the If before it
            at = len(feature)
            if open_nodes:  # the first open place belongs to this node
                parent, side = open_nodes.pop()
                children[parent][side] = at
            feature.append(int(index) if turn else 0)
            value.append(float(threshold or leaf))
            children.append([at, at])
            if turn:
                open_nodes += [(at, 1), (at, 0)]
        left, right = np.array(children, np.int32).T
        out.append((weight, np.array(feature, np.int32), np.array(value), left, right))
    return out


def _scorer(members: list, curves: list, classes: int):
    """Scaled features, a column each, to an array of probabilities."""
    def score(*columns: pa.Array) -> pa.Array:
        x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in columns], axis=1)
        n = len(x)
        every, firsts = np.arange(n), []
        for trees in members:
            margin = np.zeros(n)
            for weight, feature, value, left, right in trees:
                at = np.zeros(n, np.int32)
                while True:
                    below = np.where(x[every, feature[at]] <= value[at], left[at], right[at])
                    if np.array_equal(below, at):
                        break
                    at = below
                margin += weight * value[at]
            with np.errstate(over="ignore"):
                firsts.append(1.0 - 1.0 / (1.0 + np.exp(2.0 * margin)))
        parts = [1.0 - firsts[0], firsts[0]] if len(firsts) == 1 and classes == 2 else firsts
        if curves:
            parts = [np.interp(p, *curve) for p, curve in zip(parts, curves)]
        prob = np.stack(parts, axis=1)
        total = reduce(np.add, parts)[:, None]
        prob = np.divide(prob, total, out=np.full_like(prob, 1.0 / len(parts)), where=total > 0)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(parts)), pa.array(prob.ravel()))
    return score


def _boosted(settings: TreeSettings, label: str, weight: str | None, tag: str, n_features: int) -> GBTClassifier:
    per_split = "all" if settings.column_share >= 1 else str(max(1, round(settings.column_share * n_features)))
    gbt = GBTClassifier(
        featuresCol="_vector", labelCol=label, predictionCol=f"_pred_{tag}", maxIter=settings.rounds,
        maxDepth=settings.depth, stepSize=settings.rate, subsamplingRate=settings.subsample,
        featureSubsetStrategy=per_split, maxBins=settings.bins, seed=settings.seed)
    gbt = gbt.setRawPredictionCol(f"_raw_{tag}").setProbabilityCol(f"_prob_{tag}")
    return gbt.setWeightCol(weight) if weight else gbt


def in_parts(df: DataFrame, most: int = PART_ROWS) -> DataFrame:
    """Rows in partitions of about ``most``. Boosting keeps its input in memory,
    a partition to a task, and files come in larger ones the more there is."""
    count = df.count()
    return df if count <= most else df.repartition(-(-count // most))


def fit_trees(df: DataFrame, label_index: str, classes: list[str], settings: TreeSettings,
              columns: Sequence[str] = MODEL_FEATURES, top_k: int | None = None, weight: str | None = None) -> FlowModel:
    """Boosted trees on indexed labels. More than two classes: one model each,
    up to ``AT_ONCE`` fitted side by side on vectors that are made once."""
    selected = mutual_info_top_k(df, columns, label_index, top_k) if top_k else list(columns)
    model = FlowModel(list(classes), list(columns), selected, fit_scaler(df, columns))
    given = df.select(*selected, F.col(label_index).alias("_class"), *([weight] if weight else []))
    rows = model._vector(in_parts(given)).select("_vector", "_class", *([weight] if weight else []))
    targets = [1] if len(classes) == 2 else range(len(classes))
    rows = rows if len(targets) == 1 else write_table(rows, "vectors")

    def fit(i: int):
        mine = rows.withColumn("_target", (F.col("_class") == i).cast("double"))
        return _boosted(settings, "_target", weight, str(i), len(selected)).fit(mine)

    with ThreadPoolExecutor(min(AT_ONCE, len(targets))) as pool:
        model.members += pool.map(fit, targets)
    return model


def train_binary(df: DataFrame, label: str = "binary_label", settings: TreeSettings = BINARY,
                 top_k: int | None = 20) -> FlowModel:
    """Malicious or benign, on the most informative features."""
    indexed, classes = index_labels(df, label)
    return fit_trees(indexed, "label_index", classes, settings, top_k=top_k)


def train_multiclass(df: DataFrame, label: str, settings: TreeSettings = MULTICLASS) -> FlowModel:
    """All classes at once, with balanced weights and every feature."""
    indexed, classes = index_labels(balanced_weights(df, label), label)
    return fit_trees(indexed, "label_index", classes, settings, weight="weight")


def train_attack(df: DataFrame, label: str = "attack_type", settings: TreeSettings = ATTACK,
                 top_k: int | None = 15) -> FlowModel:
    """The class of an attack."""
    indexed, classes = index_labels(df, label)
    return fit_trees(indexed, "label_index", classes, settings, top_k=top_k)


def calibrate(df: DataFrame, label: str, fit, folds: int = 3, seed: int = 42, weight: str | None = None) -> FlowModel:
    """A model from ``fit(rows) -> FlowModel`` with isotonic calibration.

    Rows fall into folds by hash. Each fold is scored by a model fitted on the
    others; one isotonic curve per class is fitted on those scores, and put on
    a model fitted on all rows.
    """
    key = F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns]), F.lit(folds))
    rows = df.withColumn("_fold", key)
    scored = []
    for i in range(folds):
        part = fit(rows.filter(F.col("_fold") != i).drop("_fold"))
        scored.append(part.probabilities(rows.filter(F.col("_fold") == i), "_p").withColumn(
            "_classes", F.array(*[F.lit(c) for c in part.classes])))
    out_of_fold = write_table(reduce(DataFrame.unionByName, scored), "out_of_fold")  # read by each curve
    model = fit(df)
    for i, name in enumerate(model.classes):
        # a class missing from a fold's training rows scores zero there
        at = F.array_position("_classes", F.lit(name))
        score = F.when(at > 0, F.element_at("_p", F.greatest(at, F.lit(1)).cast("int"))).otherwise(0.0)
        fold_rows = out_of_fold.withColumns({f"_f{i}": score, "_y": (F.col(label) == name).cast("double")})
        iso = IsotonicRegression(featuresCol=f"_f{i}", labelCol="_y", predictionCol=f"_cal{i}")
        model.calibrators.append((iso.setWeightCol(weight) if weight else iso).fit(fold_rows))
    return model


# --- evaluation -------------------------------------------------------------

def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Counts per (actual, predicted)."""
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def confusion_matrix(cm: DataFrame, classes: Sequence) -> DataFrame:
    """One row per actual class, one column per predicted class."""
    return cm.groupBy("actual").pivot("predicted", list(classes)).agg(F.sum("n")).na.fill(0)


def per_class(cm: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where undefined."""
    sides = cm.select(F.explode(F.array(
        F.struct(F.col("actual").alias("label"), F.when(F.col("actual") == F.col("predicted"), F.col("n"))
                 .otherwise(0).alias("hit"), F.col("n").alias("support"), F.lit(0).cast("long").alias("claimed")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("hit"),
                 F.lit(0).cast("long").alias("support"), F.col("n").alias("claimed")),
    )).alias("s")).select("s.*")
    sums = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("hit", "support", "claimed")])

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    rates = sums.withColumns({
        "precision": ratio(F.col("hit"), F.col("claimed")), "recall": ratio(F.col("hit"), F.col("support"))})
    return rates.select("label", "precision", "recall", ratio(
        2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support")


def classification_report(cm: DataFrame) -> DataFrame:
    """Per-class rows, then accuracy, macro and weighted averages."""
    cm = write_table(cm, "confusion")  # a row for each pair of classes, read four times
    rows = per_class(cm).withColumn("label", F.col("label").cast("string"))
    measures = ("precision", "recall", "f1")
    support = F.sum("support").alias("support")

    def weighted(c: str) -> Column:
        return F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0))

    macro = rows.agg(*[F.avg(c).alias(c) for c in measures], support)
    mean = rows.agg(*[weighted(c).alias(c) for c in measures], support)
    right = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    share = F.coalesce(F.try_divide(right, F.sum("n")), F.lit(0.0))
    accuracy = cm.agg(*[share.alias(c) for c in measures], F.sum("n").alias("support"))

    def named(name: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(name).alias("label"), *measures, "support")

    return rows.unionByName(named("accuracy", accuracy)).unionByName(
        named("macro avg", macro)).unionByName(named("weighted avg", mean))


def benign_fpr(cm: DataFrame, benign="BENIGN") -> DataFrame:
    """Benign rows taken for something else: count, total and rate."""
    mine = F.col("actual") == F.lit(benign)
    wrong = F.coalesce(F.sum(F.when(mine & (F.col("predicted") != F.lit(benign)), F.col("n"))), F.lit(0))
    total = F.coalesce(F.sum(F.when(mine, F.col("n"))), F.lit(0))
    return cm.agg(wrong.alias("wrong"), total.alias("total")).withColumn(
        "fpr", F.col("wrong") / F.greatest(F.col("total"), F.lit(1)))


def top_classes(df: DataFrame, classes: Sequence[str], prob: str = "prob", k: int = 3) -> DataFrame:
    """Add ``top``: the k likeliest (class, probability) pairs of each row,
    equal ones by class order reversed, as a reversed ascending sort gives."""
    names = F.array(*[F.lit(str(c)) for c in classes])
    pairs = F.transform(F.col(prob), lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    best = F.slice(F.sort_array(pairs, asc=False), 1, k)
    return df.withColumn("top", F.transform(best, lambda s: F.struct(
        F.get(names, s.i).alias("label"), s.p.alias("probability"))))
