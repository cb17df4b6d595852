"""Label expressions: benign and ambiguous tests, severity, attack groups."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import (
    AMBIGUOUS_LABELS, ATTACK_GROUP_REST, ATTACK_GROUPS, BENIGN_LABELS, BLOCK_KEYWORDS, Config,
    CRITICAL_KEYWORDS, DEFAULT, HIGH_KEYWORDS, RECON_KEYWORDS,
)
from .columns import filled, folded, has_any, is_true, text


def is_benign(label: Column | str) -> Column:
    return is_true(folded(label).isin(*BENIGN_LABELS))


def is_ambiguous(label: Column | str) -> Column:
    return is_true(folded(label).isin(*AMBIGUOUS_LABELS))


def attack_or_prediction(attack: Column | str = "attack_label", prediction: Column | str = "prediction") -> Column:
    """The attack label, or the prediction where it is null or blank."""
    return F.coalesce(filled(attack), text(prediction))


def blocks_at_once(label: Column | str) -> Column:
    return has_any(folded(label), BLOCK_KEYWORDS)


def is_recon(label: Column | str) -> Column:
    return has_any(folded(label), RECON_KEYWORDS)


def model_severity(label: Column | str, confidence: Column | str | None, cfg: Config = DEFAULT) -> Column:
    """Severity of a model label. A null confidence skips the confidence rungs."""
    name = folded(label)
    conf = F.lit(None).cast("double") if confidence is None else text(confidence)
    return (
        F.when(is_benign(label) | is_true(name == "suspicious"), "info")
        .when(is_ambiguous(label), "low")
        .when(conf < cfg.alert_threshold, "info")
        .when(conf < cfg.medium_ceiling, "medium")
        .when(has_any(name, CRITICAL_KEYWORDS), "critical")
        .when(has_any(name, HIGH_KEYWORDS), "high")
        .otherwise("medium")
    )


def confidence_band(confidence: Column | str) -> Column:
    c = text(confidence)
    return (
        F.when(c.isNull(), "-").when(c >= 90, "Very high").when(c >= 80, "High")
        .when(c >= 65, "Moderate").otherwise("Low")
    )


def binary_label(label: Column | str, numeric_benign: bool = False) -> Column:
    """BENIGN or MALICIOUS. Compared untrimmed, and null is malicious.
    ``numeric_benign`` also reads the label 0 as benign."""
    benign = list(BENIGN_LABELS) + (["0"] if numeric_benign else [])
    return F.when(F.lower(text(label)).isin(*benign), "BENIGN").otherwise("MALICIOUS")


def attack_group(label: Column | str) -> Column:
    """Attack class of an upper-case label; the first class with a hit wins."""
    c = text(label)
    out = F
    for name, words in ATTACK_GROUPS:
        out = out.when(has_any(c, words), name)
    return out.otherwise(ATTACK_GROUP_REST)
