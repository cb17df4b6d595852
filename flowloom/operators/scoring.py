"""Scoring feature rows: unit scaling, contract check, one and two stages.

Every scorer adds the detector columns ``det_prediction``, ``det_confidence``
(percent, two places), ``det_binary_label`` and ``det_attack_label``, plus
``det_threat`` and ``det_binary_confidence``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..config import BENIGN_LABELS, Config, DEFAULT, EPS, MODEL_FEATURES
from ..functions import labels as lab
from ..functions.columns import is_true, text

RESULT = ("det_prediction", "det_threat", "det_confidence",
          "det_binary_label", "det_attack_label", "det_binary_confidence")


def scale_for_inference(rows: DataFrame) -> DataFrame:
    """Seconds to the microseconds the models were trained on, rates to match.
    Routing columns (leading underscore) and the packet counter are dropped."""
    internal = [c for c in rows.columns if c.startswith("_") or c == "classify_counter"]
    rows = rows.drop(*internal)
    zero = F.lit(0.0)
    dur_s = F.coalesce(F.col("flow_duration").cast("double"), zero)
    dur_us = dur_s * F.lit(1e6)
    pkts = F.coalesce(F.col("total_packets"), F.lit(0))
    size = F.coalesce(F.col("total_bytes"), F.lit(0))
    mean_size = size / (pkts + F.lit(EPS))
    if "avg_packet_size" in rows.columns:
        given = F.col("avg_packet_size")
        mean_size = F.when(is_true(given == 0.0), mean_size).otherwise(given)
    iat = F.coalesce(F.col("iat").cast("double"), zero) if "iat" in rows.columns else zero
    return rows.withColumns({
        "flow_duration": dur_us,
        "iat": iat * F.lit(1e6),
        "flow_rate": pkts / (dur_s + F.lit(EPS)),
        "packets_per_second": pkts / (dur_us + F.lit(EPS)),
        "byte_rate": size / (dur_us + F.lit(EPS)),
        "avg_packet_size": mean_size,
    })


def missing_features(columns: Sequence[str], contract: Sequence[str]) -> list[str]:
    return sorted(set(contract) - set(columns))


def check_contract(rows: DataFrame, contract: Sequence[str] = MODEL_FEATURES) -> DataFrame:
    """The contract's columns in its order. Fails before any job is started."""
    if not rows.columns:
        raise ValueError("the feature table has no columns")
    missing = missing_features(rows.columns, contract)
    if missing:
        raise ValueError("missing model features: " + ", ".join(missing))
    return rows.select(*contract)


def decode_label(index: Column | str, classes: Sequence[str] | None) -> Column:
    """Class text of a class index; without classes the index as text."""
    i = text(index)
    if not classes:
        return i.cast("string")
    names = F.array(*[F.lit(str(c)) for c in classes])
    return F.get(names, i.cast("int"))


def percent(p: Column) -> Column:
    return F.round(p * 100, 2)


def malicious_index(classes: Sequence[str] | None) -> int | None:
    """Position of the malicious class, None to use the highest probability."""
    benign = {*BENIGN_LABELS, "0", "0.0"}
    for i, name in enumerate(classes or []):
        if str(name).strip().lower() not in benign:
            return i
    return 1 if classes is not None and len(classes) == 2 else None


def malicious_confidence(prob: Column | str, classes: Sequence[str] | None) -> Column:
    prob = text(prob)
    i = malicious_index(classes)
    return percent(F.array_max(prob) if i is None else F.get(prob, F.lit(i)))


def _best(prob: Column) -> Column:
    return (F.array_position(prob, F.array_max(prob)) - 1).cast("int")


def single_stage_columns(label: Column, confidence: Column) -> dict[str, Column]:
    benign = lab.is_benign(label)
    return {
        "det_prediction": F.when(benign, "Benign").otherwise(label),
        "det_threat": F.when(benign, "None").otherwise(label),
        "det_confidence": confidence,
        "det_binary_label": label,
        "det_attack_label": F.when(~benign, label),
        "det_binary_confidence": confidence,
    }


def two_stage_benign(binary_label: Column, malicious_conf: Column, cfg: Config = DEFAULT) -> Column:
    """Stage 1 says benign, or its malicious confidence is below the threshold."""
    return lab.is_benign(binary_label) | is_true(malicious_conf < cfg.stage1_threshold)


def two_stage_columns(
    binary_label: Column, malicious_conf: Column, stage1_conf: Column,
    attack_label: Column, attack_conf: Column, cfg: Config = DEFAULT,
) -> dict[str, Column]:
    """The verdict of both stages as column expressions."""
    benign = two_stage_benign(binary_label, malicious_conf, cfg)
    unsure = is_true(attack_conf < cfg.stage2_threshold)

    def verdict(if_benign: str) -> Column:
        return F.when(benign, if_benign).when(unsure, "Suspicious").otherwise(attack_label)

    return {
        "det_prediction": verdict("Benign"),
        "det_threat": verdict("None"),
        "det_confidence": F.when(benign, stage1_conf).otherwise(attack_conf),
        "det_binary_label": binary_label,
        "det_attack_label": F.when(~benign, attack_label),
        "det_binary_confidence": malicious_conf,
    }


def score_single(rows: DataFrame, model) -> DataFrame:
    """One multiclass model. ``model.probabilities`` adds an array ``prob``."""
    scored = model.probabilities(rows, "_prob")
    label = decode_label(_best(F.col("_prob")), model.classes)
    return scored.withColumns(single_stage_columns(label, percent(F.array_max("_prob")))).drop("_prob")


def score_two_stage(rows: DataFrame, binary, attack, cfg: Config = DEFAULT) -> DataFrame:
    """Stage 2 runs only on the rows that stage 1 leaves over.

    Both parts read ``rows``, so give it a stored table, not a long plan.
    """
    first = binary.probabilities(rows, "_p1").withColumns({
        "_label1": decode_label(_best(F.col("_p1")), binary.classes),
        "_mal1": malicious_confidence("_p1", binary.classes),
        "_conf1": percent(F.array_max("_p1")),
    }).drop("_p1")
    benign = two_stage_benign(F.col("_label1"), F.col("_mal1"), cfg)
    no_label, no_conf = F.lit(None).cast("string"), F.lit(None).cast("double")
    cleared = first.filter(benign).withColumns({"_label2": no_label, "_conf2": no_conf})
    second = attack.probabilities(first.filter(~benign), "_p2").withColumns({
        "_label2": decode_label(_best(F.col("_p2")), attack.classes),
        "_conf2": percent(F.array_max("_p2")),
    }).drop("_p2")
    both = cleared.unionByName(second)
    cols = [F.col(c) for c in ("_label1", "_mal1", "_conf1", "_label2", "_conf2")]
    return both.withColumns(two_stage_columns(*cols, cfg)).drop("_label1", "_mal1", "_conf1", "_label2", "_conf2")


def score(rows: DataFrame, models, cfg: Config = DEFAULT) -> DataFrame:
    """Score any table of feature rows, other columns kept: scaling, contract
    check, then two stages, or one if the bundle has no attack model."""
    contract = models.feature_columns or MODEL_FEATURES
    scaled = scale_for_inference(rows)
    check_contract(scaled, contract)
    extra = [c for c in scaled.columns if c not in contract]
    ready = scaled.select(*extra, *contract)
    if models.attack is not None:
        scored = score_two_stage(ready, models.binary, models.attack, cfg)
    else:
        scored = score_single(ready, models.binary)
    return scored


class ModelScorer:
    """Scores due packet rows and hands back their own columns unscaled."""

    def __init__(self, models, cfg: Config = DEFAULT):
        self.models, self.cfg = models, cfg
        self.feature_columns = list(models.feature_columns or MODEL_FEATURES)

    def accepts(self, columns: Sequence[str]) -> bool:
        return not missing_features(columns, self.feature_columns)

    def __call__(self, rows: DataFrame) -> DataFrame:
        packed = rows.withColumn("row", F.struct(*[F.col(c) for c in rows.columns]))
        view = packed.withColumn("protocol", F.col("protocol_code"))
        scored = score(view, self.models, self.cfg)
        return scored.select("row.*", *RESULT)
