"""The gate cascade: which packets are scored, and what the score means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import Config, DEFAULT
from ..functions import labels as lab, network as net
from ..functions.columns import filled, is_true
from .features import SESSION
from .history import drop_history, slice_window, tails, with_history

VOTER = [*SESSION, "flow_id"]
DETECTION = ("det_prediction", "det_confidence", "det_binary_label", "det_attack_label")


def flow_ready(cfg: Config = DEFAULT) -> Column:
    """Enough packets and enough seconds. Compared in microseconds, exactly."""
    least_us = int(round(cfg.min_flow_duration * 1e6))
    return (F.col("total_packets") >= cfg.min_flow_packets) & (F.col("duration_us") >= F.lit(least_us))


def interval_due(cfg: Config = DEFAULT) -> Column:
    return F.col("total_packets") % F.lit(cfg.classify_interval) == 0


def gate(cfg: Config = DEFAULT) -> Column:
    """The reason to skip a packet before any model, null if it is due."""
    skip_portless = net.portless() if cfg.skip_portless else F.lit(False)
    return (
        F.when(skip_portless, "ip_fragment_skipped")
        .when(net.trusted_port(), "trusted_port_bypass")
        .when(~flow_ready(cfg), "flow_warmup")
        .when(~interval_due(cfg), "flow_interval_skip")
    )


def metadata_reason(cfg: Config = DEFAULT) -> Column:
    """Without a model: rate anomaly, encrypted service, or nothing special."""
    return (
        F.when(F.col("packet_rate") > cfg.high_packet_rate, "high_packet_rate")
        .when(net.encrypted_likely(), "encrypted_metadata_only")
        .otherwise("metadata_baseline")
    )


def metadata_rules(rows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Decide every packet without a model."""
    reason = F.coalesce(gate(cfg), metadata_reason(cfg))
    none = F.lit(None).cast("string")
    return rows.withColumn("reason", reason).withColumns({
        "prediction": F.when(F.col("reason") == "high_packet_rate", "Suspicious").otherwise("Normal"),
        "ml_confidence": F.lit(None).cast("double"),
        "binary_label": none,
        "attack_label": none,
    })


def _scored_ambiguous() -> Column:
    return lab.is_ambiguous("det_prediction") | lab.is_ambiguous("det_attack_label")


def _scored_weak(cfg: Config) -> Column:
    return ~lab.is_benign("det_prediction") & is_true(F.col("det_confidence") < cfg.binary_threshold)


def casts_vote(cfg: Config = DEFAULT) -> Column:
    """Scored, and neither ambiguous nor of low confidence."""
    return F.col("gate").isNull() & ~_scored_ambiguous() & ~_scored_weak(cfg)


def _is_malicious_vote() -> Column:
    return (~lab.is_benign("det_prediction")).cast("int")


def vote(cfg: Config = DEFAULT) -> Column:
    """1 or 0 where a scored row votes, else null."""
    return F.when(casts_vote(cfg), _is_malicious_vote())


def vote_tails(rows: DataFrame, name: str, cfg: Config = DEFAULT) -> DataFrame:
    """The last votes of each flow id, to carry on; column ``name`` has them, see ``vote``."""
    votes = rows.select(*VOTER, "seq", F.col(name).alias("_mal")).filter("_mal IS NOT NULL")
    return tails(votes, VOTER, "seq", ["_mal"], cfg.vote_window)


def consensus(rows: DataFrame, cfg: Config = DEFAULT, slice_rows: int | None = None,
              before: DataFrame | None = None) -> DataFrame:
    """Add ``vote_share``: the malicious share of the last votes of the flow id.

    Rows that cast no vote sit in a window group of their own and get null. The
    flow step has hashed the rows by flow id, so whole-key mode sorts in place.
    ``before`` holds the tails of votes from earlier batches.
    """
    rows = rows.withColumn("_votes", casts_vote(cfg))
    keys = VOTER
    n = cfg.vote_window

    def shared(df: DataFrame, window) -> DataFrame:
        recent = window.rowsBetween(-(n - 1), Window.currentRow)
        counted = F.sum("_mal").over(recent) / F.count("_mal").over(recent)
        return df.withColumn("vote_share", F.when(F.col("_votes"), counted))

    rows = rows.withColumn("_mal", _is_malicious_vote())
    earlier = None if before is None else before.withColumn("_votes", F.lit(True))
    if slice_rows is None:
        whole = with_history(rows, [*keys, "_votes"], "seq", n, None, before=earlier)
        return drop_history(shared(whole, slice_window([*keys, "_votes"], "seq")), "_votes", "_mal")
    voting = with_history(rows.filter("_votes"), [*keys, "_votes"], "seq", n, slice_rows, keep=["_mal"], before=earlier)
    voting = drop_history(shared(voting, slice_window([*keys, "_votes"], "seq")))
    rest = rows.filter(~F.col("_votes")).withColumn("vote_share", F.lit(None).cast("double"))
    return voting.unionByName(rest).drop("_votes", "_mal")


def decide(rows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Final prediction and reason from gate, detector columns and votes.

    Needs ``gate``, ``vote_share`` and the detector columns. First match wins:
    skipped, ambiguous, low confidence, outvoted, the model's word.
    """
    benign = lab.is_benign("det_prediction")
    outvoted = ~benign & is_true(F.col("vote_share") < cfg.vote_ratio)
    reason = (
        F.when(F.col("gate").isNotNull(), F.col("gate"))
        .when(_scored_ambiguous(), "model_uncertain_attack")
        .when(_scored_weak(cfg) | outvoted, "model_low_confidence")
        .otherwise("model_prediction")
    )
    warned = F.coalesce(filled("det_attack_label"), filled("det_prediction"), F.lit("Other"))
    scored = F.col("gate").isNull()
    rows = rows.withColumn("reason", reason)
    return rows.withColumns({
        "prediction": F.when(F.col("reason") == "model_uncertain_attack", warned)
        .when(F.col("reason") == "model_prediction", F.col("det_prediction")).otherwise("Normal"),
        "ml_confidence": F.when(scored, F.col("det_confidence")),
        "binary_label": F.when(scored, F.col("det_binary_label")),
        "attack_label": F.when(scored, F.col("det_attack_label")),
    }).drop("gate", "vote_share", *DETECTION)
