"""Schemas of the tables that enter and leave the library."""

from __future__ import annotations

from pyspark.sql import types as T

PACKETS = T.StructType([
    T.StructField("sensor_id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("source_ip", T.StringType()),
    T.StructField("destination_ip", T.StringType()),
    T.StructField("source_port", T.IntegerType()),
    T.StructField("destination_port", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("protocol_number", T.IntegerType()),
    T.StructField("ttl", T.IntegerType()),
    T.StructField("syn_flag", T.IntegerType()),
    T.StructField("ack_flag", T.IntegerType()),
    T.StructField("rst_flag", T.IntegerType()),
    T.StructField("psh_flag", T.IntegerType()),
    T.StructField("length", T.IntegerType()),
])

LOGS = T.StructType([
    T.StructField("sensor_id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("id", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("source_ip", T.StringType()),
    T.StructField("destination_ip", T.StringType()),
    T.StructField("source_port", T.IntegerType()),
    T.StructField("destination_port", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("flow_id", T.StringType()),
    T.StructField("flow_packet_count", T.LongType()),
    T.StructField("flow_byte_count", T.LongType()),
    T.StructField("flow_duration", T.DoubleType()),
    T.StructField("length", T.IntegerType()),
    T.StructField("time_diff", T.DoubleType()),
    T.StructField("packet_rate", T.DoubleType()),
    T.StructField("avg_length", T.DoubleType()),
    T.StructField("encrypted_likely", T.BooleanType()),
    T.StructField("prediction", T.StringType()),
    T.StructField("ml_confidence", T.DoubleType()),
    T.StructField("binary_label", T.StringType()),
    T.StructField("attack_label", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("signature", T.StringType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("response_note", T.StringType()),
])

BLOCK_CHANGES = T.StructType([
    T.StructField("ip", T.StringType()),
    T.StructField("op", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("at", T.TimestampType()),
])


def _flow_schema(*fields):
    return T.StructType([T.StructField(n, t()) for n, t in fields])


_D, _L, _S = T.DoubleType, T.LongType, T.StringType

# Raw CSV schemas, as the headers read once stripped and lower-cased.
CIC_FLOWS = _flow_schema(
    ("destination port", _L), ("flow duration", _D), ("total fwd packets", _L),
    ("total backward packets", _L), ("total length of fwd packets", _D),
    ("total length of bwd packets", _D), ("min packet length", _D), ("max packet length", _D),
    ("packet length mean", _D), ("packet length std", _D), ("flow packets/s", _D),
    ("flow iat mean", _D), ("syn flag count", _L), ("ack flag count", _L),
    ("rst flag count", _L), ("psh flag count", _L), ("label", _S))

NETFLOW_FLOWS = _flow_schema(
    ("l4_dst_port", _L), ("protocol", _L), ("flow_duration_milliseconds", _D),
    ("in_pkts", _L), ("out_pkts", _L), ("in_bytes", _L), ("out_bytes", _L),
    ("min_ip_pkt_len", _D), ("max_ip_pkt_len", _D), ("longest_flow_pkt", _D),
    ("shortest_flow_pkt", _D), ("src_to_dst_avg_throughput", _D), ("tcp_flags", _L),
    ("min_ttl", _L), ("label", _S))

IOT_FLOWS = _flow_schema(
    ("protocol type", _L), ("number", _D), ("tot size", _D), ("min", _D), ("max", _D),
    ("avg", _D), ("std", _D), ("rate", _D), ("iat", _D), ("syn_flag_number", _D),
    ("ack_flag_number", _D), ("rst_flag_number", _D), ("psh_flag_number", _D),
    ("time_to_live", _D), ("label", _S))

RAW_FLOWS = {"cic": CIC_FLOWS, "netflow": NETFLOW_FLOWS, "iot": IOT_FLOWS}
