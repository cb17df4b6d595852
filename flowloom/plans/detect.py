"""Packets to logs, as one batch job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..config import Config, DEFAULT
from ..operators import gates, response, verdict
from ..operators.features import flow_features, packet_ids, rate_features, session_features, slice_size
from ..runtime import write_table


@dataclass
class Detection:
    logs: DataFrame
    replay: response.Replay | None


def usable_scorer(columns, scorer):
    """The scorer, or None if the rows lack a feature it needs."""
    return scorer if scorer is not None and scorer.accepts(columns) else None


def scored_rows(rows: DataFrame, cfg: Config = DEFAULT, score_columns=None, scorer=None) -> DataFrame:
    """Feature rows with ``gate`` and detector columns. A scorer sees only the
    rows that are due."""
    rows = rows.withColumn("gate", gates.gate(cfg))
    if scorer is None:
        return rows.withColumns(score_columns)
    rows = write_table(rows, "features")  # read by both parts below
    due = scorer(rows.filter(F.col("gate").isNull()))
    return due.unionByName(rows.filter(F.col("gate").isNotNull()), allowMissingColumns=True)


def decide_packets(packets: DataFrame, cfg: Config = DEFAULT, score_columns=None, scorer=None,
                   skew: str = "auto") -> DataFrame:
    """Features, gates, scores, votes and severity of every packet.

    ``score_columns`` maps detector columns to expressions over a packet row:
    cheap scores that need no separate pass. ``scorer`` is a function from the
    due packets to the same rows with detector columns, run on those only. With
    neither, or if the scorer lacks a feature, the metadata rules decide.
    """
    size = slice_size(packets, cfg, skew)
    rows = rate_features(flow_features(session_features(packets, cfg, size), cfg, size))
    scorer = usable_scorer(rows.columns, scorer)
    if score_columns is None and scorer is None:
        return verdict.classify(gates.metadata_rules(rows, cfg), cfg)
    rows = scored_rows(rows, cfg, score_columns, scorer)
    if size is not None:
        rows = write_table(rows, "scored")  # the sliced vote window reads it more than once
    rows = gates.decide(gates.consensus(rows, cfg, size), cfg)
    return verdict.classify(rows, cfg)


def detect(packets: DataFrame, cfg: Config = DEFAULT, score_columns=None, scorer=None,
           blocked: DataFrame | None = None, warnings: DataFrame | None = None,
           commands: DataFrame | None = None, skew: str = "auto", scope: tuple[str, ...] = ("sensor_id",),
           time_us: str = "ts_us", store: bool = True, ids_after: int | None = None,
           keep: tuple[str, ...] = ()) -> Detection:
    """The whole chain with feedback. Without a model nothing can trigger a
    block, so the fixpoint is skipped unless there are commands to replay.

    A log's id is its ``seq``. Where ``seq`` starts anew in each capture, give
    ``ids_after``, the highest id stored so far (see ``next_id``): ids are then
    unique over all sessions.

    What is stored for the replay are the columns that logs need; ``keep`` names
    others, such as features, that its rows should have too."""
    log_id = "seq" if ids_after is None else "id"
    packets = packets if ids_after is None else packet_ids(packets, ids_after)
    rows = decide_packets(packets, cfg, score_columns, scorer, skew)
    if score_columns is None and scorer is None and commands is None:
        rows = response.preview_action(rows, blocked, cfg)
        return Detection(verdict.build_logs(rows, time_us, log_id), None)
    if store:
        rows = verdict.log_inputs(rows, *scope, time_us, *keep)
        rows = write_table(response.marked(rows, cfg), "decided")  # the replay reads it twice
    replay = response.replay_response(rows, blocked, warnings, commands, scope, "seq", cfg)
    return Detection(verdict.build_logs(replay.rows, time_us, log_id), replay)
