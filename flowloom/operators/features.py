"""Per-packet features over a session and over a flow.

Order is always arrival (``seq``), never time. A session is one
(``sensor_id``, ``session_id``); a flow is one ``flow_key`` in a session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import Config, DEFAULT, EPS
from ..functions import network as net
from .history import drop_history, needs_slices, slice_window, with_history
from .numbering import total_before

SESSION = ["sensor_id", "session_id"]


def slice_size(packets: DataFrame, cfg: Config, skew: str) -> int | None:
    """Slice size for the windows of these packets, or None to keep keys whole.

    ``skew`` is ``auto`` (measure, then choose), ``whole`` or ``sliced``. A flow
    lies within a session, so sessions bound both kinds of group.
    """
    if skew not in ("auto", "whole", "sliced"):
        raise ValueError(f"unknown skew mode: {skew}")
    if skew == "sliced" or (skew == "auto" and needs_slices(packets, SESSION, cfg.slice_rows)):
        return cfg.slice_rows
    return None


def packet_ids(packets: DataFrame, start: int = 0) -> DataFrame:
    """Add ``id``, unique over sessions and captures: after ``start``, sessions
    one after the other by their keys, packets of a session by ``seq``. A session
    takes as many ids as its ``seq`` has values from first to last, so ids are
    an offset and a difference, and no packet is sorted for them."""
    sessions = packets.groupBy(*SESSION).agg(F.min("seq").alias("_lo"), F.max("seq").alias("_hi"))
    sessions = total_before(sessions, SESSION, F.col("_hi") - F.col("_lo") + 1, "_offset")
    found = packets.join(sessions.select(*SESSION, (F.col("_offset") - F.col("_lo") + F.lit(start + 1)).alias("_offset")), SESSION)
    return found.withColumn("id", F.col("seq") + F.col("_offset")).select(*packets.columns, "id")


def next_id(logs: DataFrame) -> DataFrame:
    """One row: the highest stored id, 0 if there is none."""
    return logs.agg(F.coalesce(F.max("id"), F.lit(0).cast("long")).alias("max_id"))


def session_features(packets: DataFrame, cfg: Config = DEFAULT, slice_rows: int | None = None,
                     before: DataFrame | None = None) -> DataFrame:
    """Add ``time_diff`` (s), ``packet_rate`` (1/s) and ``avg_length`` over the
    last packets of the session. All in constant work per row: rolling sums are
    differences of running sums. ``before`` holds the tails of earlier batches."""
    n = cfg.rolling_window
    rows = with_history(packets, SESSION, "seq", n, slice_rows, keep=["ts_us", "length"], before=before)
    w = slice_window(SESSION, "seq")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({
        "_i": F.row_number().over(w),
        "_gap": F.col("ts_us") - F.lag("ts_us").over(w),
        "_oldest": F.coalesce(F.lag("ts_us", n - 1).over(w), F.first("ts_us").over(run)),
        "_bytes": F.sum(F.col("length").cast("long")).over(run),
    })
    rows = rows.withColumn("_left", F.lag("_bytes", n, 0).over(w))
    count = F.least(F.col("_i"), F.lit(n))
    elapsed = F.col("ts_us") - F.col("_oldest")
    rows = rows.withColumns({
        "time_diff": F.greatest(F.coalesce(F.col("_gap"), F.lit(0)), F.lit(0)) / F.lit(1e6),
        "packet_rate": F.when(elapsed > 0, (count - 1) / (elapsed / F.lit(1e6))).otherwise(F.lit(0.0)),
        "avg_length": (F.col("_bytes") - F.col("_left")) / count,
    })
    return drop_history(rows, "_i", "_gap", "_oldest", "_bytes", "_left")


def flow_named(packets: DataFrame) -> DataFrame:
    """Add ``flow_key`` and ``flow_id`` where they are not there yet."""
    if "flow_id" in packets.columns:
        return packets
    return packets.withColumn("flow_key", net.flow_key()).withColumn("flow_id", net.flow_id("flow_key"))


def flow_features(packets: DataFrame, cfg: Config = DEFAULT, slice_rows: int | None = None,
                  before: DataFrame | None = None) -> DataFrame:
    """Add ``flow_key``, ``flow_id`` and the running and rolling flow columns.
    ``before`` holds rows of earlier batches, see ``flow_state.flow_history``.

    Rows are hashed by ``flow_id`` (not by the longer key), so that the vote
    window, which is per id, needs no further shuffle.
    """
    n = cfg.rolling_window
    keys = [*SESSION, "flow_id", "flow_key"]
    rows = with_history(
        flow_named(packets), keys, "seq", n, slice_rows, keep=["length"],
        totals={"_n": F.lit(1).cast("long"), "_b": F.col("length").cast("long")},
        starts={"_start": F.col("ts_us")}, before=before,
    )
    rows = rows.repartition(*SESSION, "flow_id", "_slice") if slice_rows else rows.repartition(*SESSION, "flow_id")
    w = slice_window(keys, "seq")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    recent = w.rowsBetween(-(n - 1), Window.currentRow)
    size = F.col("length").cast("long")
    rows = rows.withColumns({
        "_i": F.row_number().over(w),
        "total_packets": F.sum("_n").over(run),
        "total_bytes": F.sum("_b").over(run),
        "_first": F.first("_start").over(run),
        "_s1": F.sum(size).over(run),
        "_s2": F.sum(size * size).over(run),
        "min_pkt_len": F.min("length").over(recent),
        "max_pkt_len": F.max("length").over(recent),
    })
    rows = rows.withColumns({"_l1": F.lag("_s1", n, 0).over(w), "_l2": F.lag("_s2", n, 0).over(w)})
    rows = rows.withColumns({
        "_k": F.least(F.col("_i"), F.lit(n)).cast("long"),
        "_s1": F.col("_s1") - F.col("_l1"),
        "_s2": F.col("_s2") - F.col("_l2"),
        "duration_us": F.greatest(F.col("ts_us") - F.col("_first"), F.lit(1)),
    })
    rows = rows.withColumns({
        "flow_duration": F.col("duration_us") / F.lit(1e6),
        "avg_pkt_len": F.col("_s1") / F.col("_k"),
        # exact integer variance, one root and one division
        "pkt_len_std": F.sqrt((F.col("_k") * F.col("_s2") - F.col("_s1") * F.col("_s1")).cast("double")) / F.col("_k"),
    })
    return drop_history(rows, "_n", "_b", "_start", "_i", "_first", "_s1", "_s2", "_l1", "_l2", "_k")


def rate_features(rows: DataFrame) -> DataFrame:
    """Ratios of the flow columns, and null-safe copies of the header fields."""
    pkts, size, dur = F.col("total_packets"), F.col("total_bytes"), F.col("flow_duration")
    out = rows.withColumns({
        "bytes_per_packet": size / (pkts + F.lit(EPS)),
        "packets_per_second": pkts / (dur + F.lit(EPS)),
        "byte_rate": size / (dur + F.lit(EPS)),
        "burstiness": F.col("pkt_len_std") / (F.col("avg_pkt_len") + F.lit(EPS)),
        "flag_sum": net.flag_sum(),
        "dst_port": F.coalesce("destination_port", F.lit(0)),
        # `protocol` is the name in a packet and the number in a feature row
        "protocol_code": F.coalesce("protocol_number", F.lit(0)),
        "iat": F.col("time_diff"),
        **{c: F.coalesce(c, F.lit(0)) for c in ("syn_flag", "ack_flag", "rst_flag", "psh_flag", "ttl")},
    })
    return out.withColumns({"avg_packet_size": F.col("bytes_per_packet"), "flow_rate": F.col("byte_rate")})


def packet_features(packets: DataFrame, cfg: Config = DEFAULT, skew: str = "auto") -> DataFrame:
    """All features of all packets: two shuffles, by session and by flow."""
    size = slice_size(packets, cfg, skew)
    return rate_features(flow_features(session_features(packets, cfg, size), cfg, size))


def model_view(rows: DataFrame) -> DataFrame:
    """Packet feature rows with ``protocol`` as the number, as models expect."""
    return rows.withColumn("protocol", F.col("protocol_code"))


def flow_table(packets: DataFrame) -> DataFrame:
    """One row per flow: its totals and last state. Partial aggregates only."""
    rows = packets.withColumn("flow_key", net.flow_key())
    return rows.groupBy(*SESSION, "flow_key").agg(
        F.min_by("ts_us", "seq").alias("start_us"),
        F.max_by("ts_us", "seq").alias("last_seen_us"),
        F.count(F.lit(1)).alias("total_packets"),
        F.sum(F.col("length").cast("long")).alias("total_bytes"),
    ).withColumn("flow_id", net.flow_id("flow_key"))


def flow_count(packets: DataFrame) -> DataFrame:
    return flow_table(packets).agg(F.count(F.lit(1)).alias("flows"))
