"""Severity, signature and rule of a decision, and the log row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import BASELINE_VERDICT, Config, DEFAULT, LOG_COLUMNS, REASON_VERDICTS, WHITESPACE
from ..functions import labels as lab, network as net
from ..functions.columns import folded, half_up, short_digest


def _by_reason(place: int, of_model: Column) -> Column:
    out = F.when(F.col("reason") == "model_prediction", of_model)
    for reason, verdict in REASON_VERDICTS.items():
        out = out.when(F.col("reason") == reason, verdict[place])
    return out.otherwise(BASELINE_VERDICT[place])


def classify(rows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Add ``severity``, ``signature`` and ``rule_id``."""
    label = F.btrim("prediction", F.lit(WHITESPACE))
    return rows.withColumns({
        "severity": _by_reason(0, lab.model_severity("prediction", "ml_confidence", cfg)),
        "signature": _by_reason(1, F.concat(F.lit("ML classification: "), label)),
        "rule_id": _by_reason(2, F.concat(F.lit("ML-"), short_digest(folded("prediction")))),
    })


def log_inputs(rows: DataFrame, *more: str) -> DataFrame:
    """The columns that a replay and ``build_logs`` read, and ``more``; what else
    the chain has made of a packet need not be sorted and stored."""
    wanted = {"sensor_id", "session_id", "seq", "id", "ts_us", "total_packets", "total_bytes", *LOG_COLUMNS, *more}
    return rows.select(*[c for c in rows.columns if c in wanted])


def build_logs(rows: DataFrame, time_us: str = "ts_us", log_id: str = "seq") -> DataFrame:
    """The log table: sensor, session and the 26 log columns."""
    made = rows.withColumns({
        "id": F.col(log_id),
        "timestamp": F.timestamp_micros(F.col(time_us)),
        "flow_packet_count": F.col("total_packets"),
        "flow_byte_count": F.col("total_bytes"),
        "flow_duration": half_up(F.col("flow_duration"), 3),
        "time_diff": half_up(F.col("time_diff"), 6),
        "packet_rate": half_up(F.col("packet_rate"), 3),
        "avg_length": half_up(F.col("avg_length"), 3),
        "encrypted_likely": net.encrypted_likely(),
    })
    return made.select("sensor_id", "session_id", *LOG_COLUMNS)
