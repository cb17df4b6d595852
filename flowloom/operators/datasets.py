"""Public flow datasets brought to one schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..config import FLOW_FEATURES
from ..functions.labels import binary_label
from ..functions.network import tcp_flag_columns

UNIFIED = FLOW_FEATURES + ("binary_label", "attack_type")


def normalise_columns(df: DataFrame) -> DataFrame:
    """Header names stripped and lower-cased; names that then clash are an error."""
    names = [c.strip().lower() for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError("column names clash after normalising: " + ", ".join(twice))
    return df.toDF(*names)


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _labelled(df: DataFrame, columns: dict[str, Column], numeric_benign: bool = False) -> DataFrame:
    label = F.col("label")
    return df.select(
        *[c.alias(n) for n, c in columns.items()],
        binary_label(label, numeric_benign).alias("binary_label"), label.alias("attack_type"))


def map_cic(df: DataFrame) -> DataFrame:
    """CIC flow records: forward and backward halves added up."""
    return _labelled(df, {
        "dst_port": _c("destination port"),
        "flow_duration": _c("flow duration"),
        "total_packets": _c("total fwd packets") + _c("total backward packets"),
        "total_bytes": _c("total length of fwd packets") + _c("total length of bwd packets"),
        "min_pkt_len": _c("min packet length"),
        "max_pkt_len": _c("max packet length"),
        "avg_pkt_len": _c("packet length mean"),
        "pkt_len_std": _c("packet length std"),
        "flow_rate": _c("flow packets/s"),
        "iat": _c("flow iat mean"),
        **{f"{f}_flag": _c(f"{f} flag count") for f in ("syn", "ack", "rst", "psh")},
    })


def map_netflow(df: DataFrame, nf_flags: str = "raw", nf_labels: str = "exact") -> DataFrame:
    """NetFlow v2 records. ``nf_flags='raw'`` puts the whole flag byte in all
    four flag columns; ``'bits'`` takes them apart. ``nf_labels='numeric'``
    reads the label 0 as benign."""
    flags = _c("tcp_flags")
    names = ("syn_flag", "ack_flag", "rst_flag", "psh_flag")
    split = tcp_flag_columns(flags) if nf_flags == "bits" else {n: flags for n in names}
    return _labelled(df, {
        "dst_port": _c("l4_dst_port"),
        "protocol": _c("protocol"),
        "flow_duration": _c("flow_duration_milliseconds"),
        "total_packets": _c("in_pkts") + _c("out_pkts"),
        "total_bytes": _c("in_bytes") + _c("out_bytes"),
        "min_pkt_len": _c("min_ip_pkt_len"),
        "max_pkt_len": _c("max_ip_pkt_len"),
        "avg_pkt_len": (_c("longest_flow_pkt") + _c("shortest_flow_pkt")) / 2,
        "flow_rate": _c("src_to_dst_avg_throughput"),
        **{n: split[n] for n in names},
        "ttl": _c("min_ttl"),
    }, nf_labels == "numeric")


def map_iot(df: DataFrame) -> DataFrame:
    """IoT flow records, which carry neither ports nor durations."""
    return _labelled(df, {
        "protocol": _c("protocol type"),
        "total_packets": _c("number"),
        "total_bytes": _c("tot size"),
        "min_pkt_len": _c("min"),
        "max_pkt_len": _c("max"),
        "avg_pkt_len": _c("avg"),
        "pkt_len_std": _c("std"),
        "flow_rate": _c("rate"),
        "iat": _c("iat"),
        **{f"{f}_flag": _c(f"{f}_flag_number") for f in ("syn", "ack", "rst", "psh")},
        "ttl": _c("time_to_live"),
    })


def fill_schema(df: DataFrame, columns=UNIFIED) -> DataFrame:
    """The unified columns in order: features as doubles, absent ones 0."""
    def column(name: str) -> Column:
        if name not in df.columns:
            return F.lit(0.0).alias(name)
        return (F.col(name).cast("double") if name in FLOW_FEATURES else F.col(name)).alias(name)
    return df.select(*[column(c) for c in columns])


def unify(*mapped: DataFrame) -> DataFrame:
    """All mapped datasets under one another."""
    return reduce(DataFrame.unionByName, [fill_schema(d) for d in mapped])
