"""DuckDB SQL for the registered queries, written from the definitions."""

from __future__ import annotations

from . import views

STATIC_BLOCKED = ("10.0.0.5", "10.0.0.17")
RATE_THRESHOLD = 200


def _q(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def r3(x: str) -> str:
    return f"floor(({x}) * 1e3 + 0.5e0) / 1e3"


def r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5e0) / 1e6"


def _has(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


AMBIGUOUS = "('other', 'unknown', 'suspicious', 'none')"
BENIGN = "('benign', 'normal')"
SHA8 = "upper(substr(sha1({}), 1, 8))"

EV = f"ev AS ({views.EV_DUCK})"
PACKETS = f"packets AS ({views.PACKETS.format(ev='ev')})"
FLOWS = f"flows_raw AS ({views.FLOWS_RAW.format(lineitem='lineitem')})"

KEYED = """keyed AS (SELECT *, concat_ws('|', coalesce(source_ip, 'None'), coalesce(destination_ip, 'None'),
  CASE WHEN protocol_number <> 0 THEN CAST(protocol_number AS VARCHAR) ELSE protocol END) AS flow_key FROM packets)"""

SESSION = """sess AS (SELECT *, upper(substr(sha1(flow_key), 1, 8)) AS flow_id,
  greatest(coalesce(ts_us - lag(ts_us) OVER s, 0), 0) / 1e6 AS time_diff,
  CASE WHEN ts_us - first(ts_us) OVER r > 0
    THEN (count(*) OVER r - 1) / ((ts_us - first(ts_us) OVER r) / 1e6) ELSE 0e0 END AS packet_rate,
  sum(length) OVER r / count(*) OVER r AS avg_length
 FROM {source}
 WINDOW s AS (PARTITION BY sensor_id, session_id ORDER BY seq),
  r AS (PARTITION BY sensor_id, session_id ORDER BY seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))"""

FLOW = """flow AS (SELECT *,
  row_number() OVER f AS total_packets,
  CAST(sum(length) OVER (f ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_bytes,
  greatest(ts_us - first(ts_us) OVER (f ROWS UNBOUNDED PRECEDING), 1) AS duration_us,
  min(length) OVER r AS min_pkt_len, max(length) OVER r AS max_pkt_len,
  CAST(sum(length) OVER r AS BIGINT) AS s1,
  CAST(sum(CAST(length AS BIGINT) * length) OVER r AS BIGINT) AS s2,
  count(*) OVER r AS n50
 FROM sess
 WINDOW f AS (PARTITION BY sensor_id, session_id, flow_key ORDER BY seq),
  r AS (PARTITION BY sensor_id, session_id, flow_key ORDER BY seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
feat AS (SELECT *, duration_us / 1e6 AS flow_duration, s1 / n50 AS avg_pkt_len,
  sqrt(CAST(n50 * s2 - s1 * s1 AS DOUBLE)) / n50 AS pkt_len_std,
  coalesce(source_port IN (443, 465, 563, 853, 993, 995, 8443), false)
   OR coalesce(destination_port IN (443, 465, 563, 853, 993, 995, 8443), false) AS encrypted_likely,
  coalesce(source_port IN (12743, 6881, 6882, 6883, 6884, 6885, 6886, 6887, 6888, 6889, 51413), false)
   OR coalesce(destination_port IN (12743, 6881, 6882, 6883, 6884, 6885, 6886, 6887, 6888, 6889, 51413), false) AS trusted,
  source_port IS NULL AND destination_port IS NULL AS portless
 FROM flow),
gated AS (SELECT *, CASE WHEN portless THEN 'ip_fragment_skipped' WHEN trusted THEN 'trusted_port_bypass'
  WHEN NOT (total_packets >= 12 AND duration_us >= 3000000) THEN 'flow_warmup'
  WHEN total_packets % 5 <> 0 THEN 'flow_interval_skip' END AS gate FROM feat)"""

DETECTION = f"""stub AS (SELECT *, {views.STUB_MAL} AS mal, {views.STUB_BINARY} AS blab,
  {views.STUB_ATTACK_CONF} AS aconf, {views.STUB_ATTACK} AS alab FROM gated),
det AS (SELECT *, blab = 'BENIGN' OR mal < 65 AS isben,
  CASE WHEN blab = 'BENIGN' OR mal < 65 THEN 'Benign' WHEN aconf < 85 THEN 'Suspicious' ELSE alab END AS dpred,
  CASE WHEN blab = 'BENIGN' OR mal < 65 THEN greatest(mal, 100 - mal) ELSE aconf END AS dconf,
  CASE WHEN NOT (blab = 'BENIGN' OR mal < 65) THEN alab END AS datt FROM stub)"""

SINGLE = f"""stub AS (SELECT *, {views.STUB_ATTACK_CONF} AS aconf, {views.STUB_ATTACK} AS alab,
  {views.STUB_BINARY} AS bin FROM gated),
det AS (SELECT *, CASE WHEN bin = 'BENIGN' THEN 'BENIGN' ELSE alab END AS blab,
  CASE WHEN bin = 'BENIGN' THEN 'Benign' ELSE alab END AS dpred, aconf AS dconf,
  CASE WHEN bin <> 'BENIGN' THEN alab END AS datt FROM stub)"""

VOTES = f"""voted AS (SELECT *, lower(dpred) IN {AMBIGUOUS} OR coalesce(lower(datt) IN {AMBIGUOUS}, false) AS vague,
  lower(dpred) NOT IN {BENIGN} AND dconf < 65 AS weak FROM det),
shares AS (SELECT seq AS vseq, avg(CASE WHEN lower(dpred) IN {BENIGN} THEN 0 ELSE 1 END) OVER (
   PARTITION BY sensor_id, session_id, flow_id ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS vote_share
  FROM voted WHERE gate IS NULL AND NOT vague AND NOT weak),
decided AS (SELECT *, CASE WHEN gate IS NOT NULL THEN gate WHEN vague THEN 'model_uncertain_attack'
   WHEN weak OR (lower(dpred) NOT IN {BENIGN} AND coalesce(vote_share < 0.6e0, false)) THEN 'model_low_confidence'
   ELSE 'model_prediction' END AS reason FROM voted LEFT JOIN shares ON seq = vseq),
dec AS (SELECT *, CASE reason WHEN 'model_uncertain_attack' THEN coalesce(datt, dpred)
   WHEN 'model_prediction' THEN dpred ELSE 'Normal' END AS prediction,
  CASE WHEN gate IS NULL THEN dconf END AS ml_confidence, CASE WHEN gate IS NULL THEN blab END AS binary_label,
  CASE WHEN gate IS NULL THEN datt END AS attack_label FROM decided)"""

METADATA = f"""dec AS (SELECT *, coalesce(gate, CASE WHEN packet_rate > {RATE_THRESHOLD} THEN 'high_packet_rate'
   WHEN encrypted_likely THEN 'encrypted_metadata_only' ELSE 'metadata_baseline' END) AS reason,
  CASE WHEN gate IS NULL AND packet_rate > {RATE_THRESHOLD} THEN 'Suspicious' ELSE 'Normal' END AS prediction,
  CAST(NULL AS DOUBLE) AS ml_confidence, CAST(NULL AS VARCHAR) AS binary_label,
  CAST(NULL AS VARCHAR) AS attack_label FROM gated)"""

WARMUP = "('flow_warmup', 'flow_interval_skip', 'ip_fragment_skipped', 'trusted_port_bypass')"
CLASSIFIED = f"""cls AS (SELECT *, CASE WHEN reason = 'model_prediction' THEN
   CASE WHEN lower(prediction) IN {BENIGN} OR lower(prediction) = 'suspicious' THEN 'info'
    WHEN lower(prediction) IN {AMBIGUOUS} THEN 'low' WHEN ml_confidence < 85 THEN 'info' WHEN ml_confidence < 90 THEN 'medium'
    WHEN {_has('lower(prediction)', ('ddos', 'dos', 'botnet', 'infiltration', 'ransomware'))} THEN 'critical'
    WHEN {_has('lower(prediction)', ('brute', 'exploit', 'web attack', 'sql', 'xss', 'portscan', 'scan'))} THEN 'high'
    ELSE 'medium' END
   WHEN reason = 'model_uncertain_attack' THEN 'low' WHEN reason = 'high_packet_rate' THEN 'critical' ELSE 'info' END AS severity,
  CASE WHEN reason = 'model_prediction' THEN 'ML classification: ' || prediction
   WHEN reason = 'model_low_confidence' THEN 'ML monitoring: low confidence'
   WHEN reason = 'model_uncertain_attack' THEN 'ML warning: uncertain attack class'
   WHEN reason IN {WARMUP} THEN 'Flow warmup: collecting evidence'
   WHEN reason = 'high_packet_rate' THEN 'Sustained packet-rate anomaly'
   WHEN reason = 'encrypted_metadata_only' THEN 'Encrypted service metadata' ELSE 'Metadata baseline' END AS signature,
  CASE WHEN reason = 'model_prediction' THEN 'ML-' || {SHA8.format('lower(prediction)')}
   WHEN reason = 'model_low_confidence' THEN 'ML-MONITOR' WHEN reason = 'model_uncertain_attack' THEN 'ML-WARN'
   WHEN reason IN {WARMUP} THEN 'FLOW-WARMUP' WHEN reason = 'high_packet_rate' THEN 'META-1001'
   WHEN reason = 'encrypted_metadata_only' THEN 'META-1002' ELSE 'META-0000' END AS rule_id FROM dec),
kinds AS (SELECT *, CASE WHEN reason = 'model_uncertain_attack' OR lower(prediction) IN {BENIGN} OR severity = 'info'
    OR source_ip IS NULL THEN NULL
   WHEN {_has('lower(coalesce(attack_label, prediction))', ('ddos', 'dos', 'brute'))} THEN 'block'
   WHEN {_has('lower(coalesce(attack_label, prediction))', ('recon', 'scan'))} THEN 'recon' END AS kind FROM cls)"""

_ACT = """acted AS (SELECT *, CASE WHEN hit THEN 'blocked' WHEN reason = 'model_uncertain_attack' THEN 'warning'
   WHEN lower(prediction) IN ('benign', 'normal') OR severity = 'info' THEN 'allow' WHEN kind = 'block' THEN 'blocked'
   WHEN kind = 'recon' AND step >= 3 THEN 'blocked' WHEN kind = 'recon' THEN 'warning' ELSE 'alert' END AS action,
  CASE WHEN hit THEN 'Matched existing blocklist rule'
   WHEN reason = 'model_uncertain_attack' THEN 'ML warning: uncertain class, review before treating as attack'
   WHEN lower(prediction) IN ('benign', 'normal') OR severity = 'info' THEN NULL
   WHEN kind = 'block' THEN 'Auto-blocked ' || prediction || ' traffic'
   WHEN kind = 'recon' AND step >= 3 THEN 'Auto-blocked after 3 reconnaissance warnings'
   WHEN kind = 'recon' THEN 'Recon warning ' || CAST(step AS VARCHAR) || '/3' END AS response_note FROM marked)"""

LISTED = f"(coalesce(source_ip IN ({_q(STATIC_BLOCKED)}), false) OR destination_ip IN ({_q(STATIC_BLOCKED)}))"
PREVIEW = f"marked AS (SELECT *, {LISTED} AS hit, 1 AS step FROM kinds),\n{_ACT}"

def replay(listed: tuple[str, ...] = STATIC_BLOCKED, commands: str | None = None) -> str:
    """The feedback loop packet by packet: one recursion step for each event of
    a sensor, with its blocklist ``b`` and its open warnings ``w`` as lists.
    ``commands`` has sensor_id, seq, op and ip."""
    given = f"UNION ALL SELECT sensor_id, seq, 0, op, ip, NULL FROM ({commands})" if commands else ""
    start = f"CAST([{_q(listed)}] AS VARCHAR[])"
    return f"""ev_all AS (SELECT sensor_id, seq, 1 AS rank, kind, source_ip AS src, destination_ip AS dst FROM kinds WHERE kind IS NOT NULL {given}),
ev_n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY seq, rank) AS n FROM ev_all),
run AS (SELECT DISTINCT sensor_id, CAST(0 AS BIGINT) AS n, {start} AS b, CAST([] AS VARCHAR[]) AS w,
   CAST(NULL AS INT) AS step, CAST(NULL AS BOOLEAN) AS turned FROM kinds
 UNION ALL SELECT sensor_id, n,
   CASE WHEN on_ THEN list_append(list_filter(b, lambda x: x <> src), src) WHEN off_ THEN list_filter(b, lambda x: x <> src) ELSE b END,
   CASE WHEN on_ THEN list_filter(w, lambda x: x <> src) WHEN step IS NOT NULL THEN list_append(w, src) ELSE w END,
   step, CASE WHEN on_ THEN true WHEN off_ THEN false END
  FROM (SELECT *, kind = 'manual' OR (alive AND kind = 'block') OR coalesce(step >= 3, false) AS on_, kind = 'unblock' AS off_
   FROM (SELECT *, CASE WHEN alive AND kind = 'recon' THEN CAST(len(list_filter(w, lambda x: x = src)) + 1 AS INT) END AS step
    FROM (SELECT r.sensor_id, e.n, r.b, r.w, e.src, e.kind, NOT (list_contains(b, src) OR coalesce(list_contains(b, dst), false)) AS alive
     FROM run r JOIN ev_n e ON e.sensor_id = r.sensor_id AND e.n = r.n + 1)))),
ended AS (SELECT sensor_id, arg_max(b, n) AS b, arg_max(w, n) AS w FROM run GROUP BY sensor_id),
switches AS (SELECT sensor_id, src AS ip, 4 * seq + CASE WHEN rank = 1 THEN 1 ELSE -1 END AS at_, turned FROM run JOIN ev_n USING (sensor_id, n)
  WHERE turned IS NOT NULL UNION ALL SELECT sensor_id, unnest(b), -1, true FROM run WHERE n = 0),
ladder AS (SELECT sensor_id, seq AS lseq, src, run.step FROM run JOIN ev_n USING (sensor_id, n) WHERE run.step IS NOT NULL),
marked AS (SELECT k.*, coalesce(a.turned, false) OR coalesce(z.turned, false) AS hit, l.step FROM kinds k
 ASOF LEFT JOIN switches a ON k.sensor_id = a.sensor_id AND k.source_ip = a.ip AND 4 * k.seq > a.at_
 ASOF LEFT JOIN switches z ON k.sensor_id = z.sensor_id AND k.destination_ip = z.ip AND 4 * k.seq > z.at_
 LEFT JOIN ladder l ON k.sensor_id = l.sensor_id AND k.seq = l.lseq)""" + ",\n" + _ACT


LOG_COLUMNS = f"""sensor_id, session_id, seq AS id, {{time}} AS time_us, source_ip, destination_ip, source_port, destination_port,
 protocol, flow_id, total_packets AS flow_packet_count, total_bytes AS flow_byte_count, {r3('flow_duration')} AS flow_duration,
 length, {r6('time_diff')} AS time_diff, {r3('packet_rate')} AS packet_rate, {r3('avg_length')} AS avg_length,
 encrypted_likely, prediction, ml_confidence, binary_label, attack_label, severity, signature, rule_id, action, reason, response_note"""


def chain(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select


BASE = (EV, PACKETS, KEYED)
FEATURES = BASE + (SESSION.format(source="keyed"), FLOW)
DECISIONS = FEATURES + (DETECTION, VOTES, CLASSIFIED)
SINGLE_DECISIONS = FEATURES + (SINGLE, VOTES, CLASSIFIED)
METADATA_DECISIONS = FEATURES + (METADATA, CLASSIFIED)


def logs(source=DECISIONS, act: str = PREVIEW, time: str = "ts_us") -> tuple[str, ...]:
    return source + (act, f"logs AS (SELECT {LOG_COLUMNS.format(time=time)} FROM acted)")


LOGS = logs()
EVENT_LOGS = logs(time="event_us")
METADATA_LOGS = logs(METADATA_DECISIONS)
REPLAY_LOGS = logs(act=replay())
COMMANDS = """SELECT sensor_id, seq, CASE WHEN seq % 500 = 0 THEN 'manual' ELSE 'unblock' END AS op, destination_ip AS ip
 FROM packets WHERE seq % 500 IN (0, 250)"""
COMMAND_LOGS = logs(act=replay((), COMMANDS))
# every packet of a flow is scored and believed, so that blocks meet the packets that set off others
EAGER_LOGS = tuple(
    p.replace("total_packets >= 12 AND duration_us >= 3000000", "total_packets >= 1 AND duration_us >= 0")
    .replace("total_packets % 5 <> 0", "total_packets % 1 <> 0").replace("vote_share < 0.6e0", "vote_share < 0e0")
    .replace("aconf < 85", "aconf < 50").replace("ml_confidence < 85", "ml_confidence < 50") for p in REPLAY_LOGS)

WARNING = "(action = 'warning' OR reason = 'model_uncertain_attack')"
THREAT = f"(action = 'blocked' OR (NOT {WARNING} AND severity <> 'info'))"
SHOWN_LABEL = f"CASE WHEN {THREAT} OR {WARNING} THEN coalesce(nullif(attack_label, ''), nullif(prediction, ''), signature) ELSE '-' END"

FEATURE_SELECT = f"""SELECT seq, flow_id, flow_key, total_packets, total_bytes, {r6('flow_duration')} AS flow_duration,
 min_pkt_len, max_pkt_len, {r6('avg_pkt_len')} AS avg_pkt_len, {r6('pkt_len_std')} AS pkt_len_std,
 {r6('total_bytes / (total_packets + 1e-6)')} AS bytes_per_packet,
 {r3('total_packets / (flow_duration + 1e-6)')} AS packets_per_second,
 {r3('total_bytes / (flow_duration + 1e-6)')} AS byte_rate,
 {r6('pkt_len_std / (avg_pkt_len + 1e-6)')} AS burstiness, {r6('time_diff')} AS iat,
 CAST(syn_flag + ack_flag + rst_flag + psh_flag AS INT) AS flag_sum, coalesce(destination_port, 0) AS dst_port,
 protocol_number AS protocol_code FROM feat"""


def top(column: str, name: str, k: int, where: str = "true") -> str:
    return f"""SELECT {column} AS {name}, count(*) AS count, max(id) AS last_id FROM logs WHERE {where}
 GROUP BY 1 ORDER BY count DESC, last_id DESC LIMIT {k}"""


# --- datasets ---------------------------------------------------------------

_D = "CAST({} AS DOUBLE)"


def _unified(ds: int) -> str:
    cic = {"dst_port": "dst_port", "flow_duration": "dur", "total_packets": "fwd_pkts + bwd_pkts",
           "total_bytes": "fwd_bytes + bwd_bytes", "min_pkt_len": "min_len", "max_pkt_len": "max_len",
           "avg_pkt_len": "mean_len", "pkt_len_std": "std_len", "flow_rate": "rate", "iat": "iat",
           "syn_flag": "(tcp_flags // 2) % 2", "ack_flag": "(tcp_flags // 16) % 2",
           "rst_flag": "(tcp_flags // 4) % 2", "psh_flag": "(tcp_flags // 8) % 2"}
    netflow = {"dst_port": "dst_port", "protocol": "protocol", "flow_duration": "dur",
               "total_packets": "fwd_pkts + bwd_pkts", "total_bytes": "fwd_bytes + bwd_bytes",
               "min_pkt_len": "min_len", "max_pkt_len": "max_len",
               "avg_pkt_len": "(CAST(max_len AS DOUBLE) + CAST(min_len AS DOUBLE)) / 2", "flow_rate": "rate",
               "syn_flag": "tcp_flags", "ack_flag": "tcp_flags", "rst_flag": "tcp_flags", "psh_flag": "tcp_flags",
               "ttl": "ttl"}
    iot = {"protocol": "protocol", "total_packets": "fwd_pkts", "total_bytes": "fwd_bytes", "min_pkt_len": "min_len",
           "max_pkt_len": "max_len", "avg_pkt_len": "mean_len", "pkt_len_std": "std_len", "flow_rate": "rate",
           "iat": "iat", "syn_flag": "(tcp_flags // 2) % 2", "ack_flag": "(tcp_flags // 16) % 2",
           "rst_flag": "(tcp_flags // 4) % 2", "psh_flag": "(tcp_flags // 8) % 2", "ttl": "ttl"}
    spec = {0: cic, 1: netflow, 2: netflow, 3: iot}[ds]
    cols = ", ".join(f"{_D.format(spec.get(c, '0'))} AS {c}" for c in FEATURES16)
    return (f"SELECT {cols}, CASE WHEN lower(label) IN ('benign', 'normal') THEN 'BENIGN' ELSE 'MALICIOUS' END AS binary_label, "
            f"label AS attack_type FROM flows_raw WHERE ds = {ds}")


FEATURES16 = ("dst_port", "protocol", "flow_duration", "total_packets", "total_bytes", "min_pkt_len", "max_pkt_len",
              "avg_pkt_len", "pkt_len_std", "flow_rate", "iat", "syn_flag", "ack_flag", "rst_flag", "psh_flag", "ttl")
UNIFIED = (FLOWS, "unified AS (" + " UNION ALL ".join(_unified(d) for d in range(4)) + ")")
_INSIDE = " AND ".join(f"{c} < 1e15 AND {c} > -1e15" for c in FEATURES16)
_PRESENT = " AND ".join(f"{c} IS NOT NULL AND NOT isinf({c})" for c in FEATURES16)
CLEAN = UNIFIED + (f"clean AS (SELECT * FROM unified WHERE {_PRESENT} AND {_INSIDE})",)
DEDUPED = UNIFIED + (f"clean AS (SELECT DISTINCT * FROM unified WHERE {_PRESENT})",)


def _group(c: str) -> str:
    rules = (("DDoS", ("DDOS",)), ("DoS", ("DOS",)), ("Recon", ("SCAN", "RECON")), ("BruteForce", ("PATATOR", "BRUTE")),
             ("WebAttack", ("XSS", "SQL", "INJECTION")), ("Botnet", ("BOT",)), ("IoT", ("MIRAI", "IOT")),
             ("MITM", ("MITM",)), ("Malware", ("BACKDOOR", "MALWARE")))
    return "CASE " + " ".join(f"WHEN {_has(c, w)} THEN '{n}'" for n, w in rules) + " ELSE 'Other' END"


ATTACKS = (f"""attacks AS (SELECT * REPLACE ({_group('kind')} AS attack_type) FROM (
  SELECT *, trim(upper(attack_type)) AS kind FROM clean WHERE binary_label = 'MALICIOUS')
 WHERE kind NOT IN ('0', '1', 'BENIGN', ''))""",)
DERIVED = """bytes_per_packet AS (total_bytes / (total_packets + 1e-6))"""

CAP = 300

PREDICTED = ("""scored AS (SELECT label AS actual,
  CASE WHEN rid % 4 = 0 THEN 'BENIGN' ELSE label END AS predicted FROM flows_raw)""",
             "cm AS (SELECT actual, predicted, count(*) AS n FROM scored GROUP BY ALL)")
PER_CLASS = """pc AS (SELECT label, hit, support, claimed,
   coalesce(hit / nullif(claimed, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall
  FROM (SELECT label, CAST(sum(hit) AS BIGINT) AS hit, CAST(sum(support) AS BIGINT) AS support,
     CAST(sum(claimed) AS BIGINT) AS claimed FROM (
    SELECT actual AS label, CASE WHEN actual = predicted THEN n ELSE 0 END AS hit, n AS support, 0 AS claimed FROM cm
    UNION ALL SELECT predicted, 0, 0, n FROM cm) GROUP BY label)),
rep AS (SELECT label, precision, recall,
  coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, support FROM pc)"""
