"""The input views of the registered queries, derived from the driver's tables.

Each text runs in Spark and DuckDB alike; only the ``ev`` relation differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EV_SPARK = """SELECT *, unix_micros(CAST(ts AS TIMESTAMP)) AS us,
 CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM {events}"""
EV_DUCK = """SELECT *, epoch_us(ts) AS us,
 CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events"""

PACKETS = """SELECT event_id AS seq, 's' || CAST(user_id % 3 AS STRING) AS sensor_id,
 'r' || CAST(CAST(floor(event_id / 5000) AS BIGINT) AS STRING) AS session_id,
 1704067200000000 + CAST(floor((us - 1704067200000000) / 100000) AS BIGINT) AS ts_us,
 us AS event_us,
 CASE WHEN event_id % 211 = 0 THEN NULL ELSE '10.0.0.' || CAST(user_id % 97 AS STRING) END AS source_ip,
 '10.0.0.' || CAST(((user_id % 97) * 13 + 1) % 97 AS STRING) AS destination_ip,
 CASE WHEN event_type = 'error' THEN NULL ELSE CAST(49152 + event_id % 1000 AS INT) END AS source_port,
 CASE WHEN event_type = 'error' THEN NULL WHEN k % 10 = 0 THEN 443 WHEN k % 10 = 1 THEN 80 WHEN k % 10 = 2 THEN 53
  WHEN k % 10 = 3 THEN 22 WHEN k % 10 = 4 THEN 6881 WHEN k % 10 = 5 THEN 8443 WHEN k % 10 = 6 THEN 993
  WHEN k % 10 = 7 THEN 0 ELSE 8080 END AS destination_port,
 CASE WHEN event_type = 'signup' THEN 'UDP' WHEN event_type <> 'error' THEN 'TCP'
  WHEN event_id % 2 = 0 THEN 'ICMP' ELSE 'IPv6' END AS protocol,
 CASE WHEN event_type = 'signup' THEN 17 WHEN event_type <> 'error' THEN 6
  WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS protocol_number,
 CAST(32 * (1 + user_id % 3) AS INT) AS ttl,
 CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS syn_flag,
 CASE WHEN event_type IN ('click', 'view', 'purchase') AND k % 2 = 0 THEN 1 ELSE 0 END AS ack_flag,
 CASE WHEN event_type = 'purchase' AND k % 5 = 0 THEN 1 ELSE 0 END AS rst_flag,
 CASE WHEN event_type = 'view' AND k % 3 = 0 THEN 1 ELSE 0 END AS psh_flag,
 CAST(floor(value * 3) AS INT) + 40 AS length
FROM {ev}"""

# Stand-ins for the outputs of the two models, as expressions over a packet.
STUB_MAL = "((seq * 7919) % 10001) / CAST(100 AS DOUBLE)"
STUB_BINARY = "CASE WHEN ((seq * 7919) % 10001) >= 5000 THEN 'MALICIOUS' ELSE 'BENIGN' END"
STUB_ATTACK_CONF = "40 + ((seq * 104729) % 6001) / CAST(100 AS DOUBLE)"
STUB_ATTACK = """CASE (seq * 31) % 10 WHEN 0 THEN 'DDoS' WHEN 1 THEN 'DoS' WHEN 2 THEN 'Recon' WHEN 3 THEN 'BruteForce'
  WHEN 4 THEN 'WebAttack' WHEN 5 THEN 'Botnet' WHEN 6 THEN 'IoT' WHEN 7 THEN 'MITM' WHEN 8 THEN 'Malware' ELSE 'Other' END"""

FLOWS_RAW = """SELECT l_orderkey * 10 + l_linenumber AS rid, CAST(l_suppkey % 4 AS INT) AS ds,
 CASE CAST(l_partkey % 4 AS INT) WHEN 0 THEN 443 WHEN 1 THEN 80 WHEN 2 THEN 22 ELSE 53 END AS dst_port,
 CASE WHEN l_returnflag = 'R' THEN 17 ELSE 6 END AS protocol,
 CASE WHEN (l_orderkey * 10 + l_linenumber) % 97 = 0 THEN CAST('Infinity' AS DOUBLE)
      WHEN (l_orderkey * 10 + l_linenumber) % 101 = 0 THEN CAST(2e15 AS DOUBLE)
      WHEN (l_orderkey * 10 + l_linenumber) % 89 = 0 THEN NULL ELSE l_extendedprice END AS dur,
 CAST(l_linenumber AS BIGINT) AS fwd_pkts, CAST(l_quantity AS BIGINT) AS bwd_pkts,
 CAST(floor(l_extendedprice) AS BIGINT) AS fwd_bytes, CAST(floor(l_quantity * 100) AS BIGINT) AS bwd_bytes,
 40 + CAST(l_quantity AS BIGINT) AS min_len, 140 + CAST(l_quantity AS BIGINT) * 20 AS max_len,
 l_quantity * 10 AS mean_len, l_discount * 1000 AS std_len, l_tax * 1000 AS rate, l_discount * 10 AS iat,
 CAST(l_orderkey % 32 AS INT) AS tcp_flags, CAST(64 * (1 + l_suppkey % 2) AS INT) AS ttl,
 CASE (l_orderkey * 10 + l_linenumber) % 13 WHEN 0 THEN 'DDoS' WHEN 1 THEN 'DoS Hulk' WHEN 2 THEN 'PortScan'
  WHEN 3 THEN 'FTP-Patator' WHEN 4 THEN 'Web Attack XSS' WHEN 5 THEN 'Bot' WHEN 6 THEN 'Mirai-greip'
  WHEN 7 THEN 'MITM-ArpSpoofing' WHEN 8 THEN ' backdoor ' WHEN 9 THEN '0' WHEN 10 THEN 'Normal'
  WHEN 11 THEN 'Exploits' ELSE 'BENIGN' END AS label
FROM {lineitem}"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(PACKETS, ev=spark.sql(EV_SPARK, events=events))


def flows_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FLOWS_RAW, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
