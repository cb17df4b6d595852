"""Queries over the log table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import AMBIGUOUS_LABELS, Config, DEFAULT, NOTE_REVIEW, REASON_VERDICTS
from ..functions import labels as lab
from ..functions.columns import filled
from .features import flow_count

ALERT_SEVERITIES = ("critical", "high", "medium", "low")


def _positive(limit: int) -> int:
    if limit < 1:
        raise ValueError(f"a limit is at least 1, not {limit}")
    return limit


def newest(logs: DataFrame, limit: int) -> DataFrame:
    """The rows with the highest ids, in ascending order. A top-n per task,
    then a merge: nothing is sorted as a whole."""
    return logs.orderBy(F.desc("id")).limit(_positive(limit)).orderBy("id")


def recent_logs(logs: DataFrame, limit: int = 500) -> DataFrame:
    """Latest rows, with ambiguous ones shown as warnings."""
    return rewrite_ambiguous(newest(logs, limit))


def rewrite_ambiguous(logs: DataFrame) -> DataFrame:
    """Show rows with an ambiguous label as warnings, also those stored before
    the warning action existed. Blank labels count as absent."""
    reason = "model_uncertain_attack"
    severity, signature, rule_id = REASON_VERDICTS[reason]
    label = F.coalesce(filled("attack_label"), filled("prediction"))
    vague = lab.is_ambiguous(label)
    shown = {
        "prediction": F.coalesce(label, F.lit("Other")), "severity": F.lit(severity),
        "signature": F.lit(signature), "rule_id": F.lit(rule_id), "action": F.lit("warning"),
        "reason": F.lit(reason), "response_note": F.lit(NOTE_REVIEW),
    }
    return logs.withColumns({c: F.when(vague, v).otherwise(F.col(c)) for c, v in shown.items()})


def summary(logs: DataFrame) -> DataFrame:
    """Packets, alerts, encrypted and blocked: one pass. Here a blank attack
    label does not count as absent."""
    label = F.lower(F.coalesce("attack_label", "prediction", F.lit("")))
    alert = F.col("severity").isin(*ALERT_SEVERITIES) & ~label.isin(*AMBIGUOUS_LABELS)
    return logs.agg(
        F.count(F.lit(1)).alias("packets"),
        F.count_if(alert).alias("alerts"),
        F.count_if(F.col("encrypted_likely").cast("boolean")).alias("encrypted"),
        F.count_if(F.col("action") == "blocked").alias("blocked"),
    )


def session_logs(logs: DataFrame, session_id: str, limit: int = 100) -> DataFrame:
    return newest(logs.filter(F.col("session_id") == session_id), limit)


def history_logs(logs: DataFrame, session_id: str, limit: int = 100) -> DataFrame:
    """Latest rows of all other sessions."""
    return newest(logs.filter(F.col("session_id") != session_id), limit)


def is_alerting() -> Column:
    """Severity of low or above, or an alert or block action."""
    return F.col("severity").isin(*ALERT_SEVERITIES) | F.col("action").isin("alert", "blocked")


def capture_report(logs: DataFrame, by: tuple[str, ...] = ("sensor_id", "session_id")) -> DataFrame:
    """Packets and alerts per capture."""
    return logs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("processed_packets"), F.count_if(is_alerting()).alias("alert_count"))


def status(packets: DataFrame, logs: DataFrame, blocked: DataFrame, session_id: str,
           cfg: Config = DEFAULT) -> DataFrame:
    """Counters and thresholds as (item, value) rows."""
    spark = logs.sparkSession

    def item(name: str, df: DataFrame, col: str) -> DataFrame:
        return df.select(F.lit(name).alias("item"), F.col(col).cast("double").alias("value"))

    counted = F.count(F.lit(1)).alias("n")
    fixed = spark.createDataFrame(
        [("ml_min_packets", float(cfg.min_flow_packets)), ("ml_min_duration", cfg.min_flow_duration),
         ("ml_attack_threshold", cfg.alert_threshold)], "item string, value double")
    counts = logs.agg(counted, F.count_if(F.col("session_id") == session_id).alias("s"))
    stacked = counts.select(F.stack(F.lit(2), F.lit("log_count"), F.col("n").cast("double"),
                                    F.lit("session_packets"), F.col("s").cast("double")).alias("item", "value"))
    return (
        stacked
        .union(item("flow_count", flow_count(packets), "flows"))
        .union(item("blocked_ips", blocked.select("ip").distinct().agg(counted), "n"))
        .union(fixed)
    )


def status_addresses(blocked: DataFrame, warnings: DataFrame) -> DataFrame:
    """The lists that go with ``status``, as (item, ip, value) rows: every blocked
    address, and every address with open warnings and their number."""
    listed = blocked.select(F.lit("blocked_ips").alias("item"), "ip", F.lit(1).cast("long").alias("value")).distinct()
    counts = warnings.groupBy("ip").agg(F.sum("count").alias("value")).select(F.lit("warning_counts").alias("item"), "ip", "value")
    return listed.unionByName(counts)
