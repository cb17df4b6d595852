"""The registered queries: each a Spark callable and, where SQL can say it, a
DuckDB text over the same tables. All run over whole tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from flowloom.config import Config, DEFAULT, MODEL_FEATURES
from flowloom.functions import labels as lab, network as net
from flowloom.functions.columns import half_up
from flowloom.operators import (
    dashboard as dash, datasets as ds, features as feat, gates, logqueries as lq, prep, response, scoring, training,
    verdict,
)
from flowloom.plans.detect import decide_packets, detect
from flowloom.runtime import new_table_path, write_table
from flowloom.schemas import PACKETS
from flowloom.sources.captures import capture_filter, read_captures
from flowloom.sources.flows import list_files, read_flows, write_unified
from flowloom.sources.logstore import append_logs, clear_logs, compact_logs, current_logs, export_logs, load_logs, stored_logs
from flowloom.sources.models import ModelBundle, load_models, save_models
from flowloom.streaming.flow_state import read_packet_stream
from flowloom.streaming.live import LiveDetection, finish, live_summary, notify_once, read_log_stream, start_detection

from . import files, oracle as o, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)
RATED = Config(high_packet_rate=float(o.RATE_THRESHOLD))
SLICED = Config(slice_rows=1000)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


# --- shared inputs ----------------------------------------------------------

def static_blocklist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(ip,) for ip in o.STATIC_BLOCKED], "ip string")


def stub_scores(cfg: Config = DEFAULT) -> dict:
    """Detector columns from the stand-in scores, through the two-stage rule."""
    mal = F.expr(views.STUB_MAL)
    return scoring.two_stage_columns(
        F.expr(views.STUB_BINARY), mal, F.greatest(mal, F.lit(100.0) - mal),
        F.expr(views.STUB_ATTACK), F.expr(views.STUB_ATTACK_CONF), cfg)


def single_scores() -> dict:
    benign = F.expr(views.STUB_BINARY) == "BENIGN"
    label = F.when(benign, "BENIGN").otherwise(F.expr(views.STUB_ATTACK))
    return scoring.single_stage_columns(label, F.expr(views.STUB_ATTACK_CONF))


def decisions(spark, sf, cfg=DEFAULT, skew="auto"):
    return decide_packets(views.packets(spark, sf), cfg, score_columns=stub_scores(), skew=skew)


def preview_logs(spark, sf, time_us="ts_us"):
    rows = response.preview_action(decisions(spark, sf), static_blocklist(spark))
    # stored, as reports run on a log table and not on the chain that fills it
    return write_table(verdict.build_logs(rows, time_us), "logs")


def replayed(spark, sf):
    return detect(views.packets(spark, sf), score_columns=stub_scores(), blocked=static_blocklist(spark))


def with_micros(logs: DataFrame) -> DataFrame:
    return logs.withColumn("time_us", F.unix_micros("timestamp")).drop("timestamp")


def features(spark, sf, cfg=DEFAULT, skew="auto"):
    return feat.packet_features(views.packets(spark, sf), cfg, skew)


# --- packets ----------------------------------------------------------------

@query("packet_expressions", o.chain(*o.BASE, o.SESSION.format(source="keyed"), o.FLOW, select="""
SELECT seq, encrypted_likely, trusted, portless, CAST(syn_flag + ack_flag + rst_flag + psh_flag AS INT) AS flag_sum,
 CASE WHEN source_ip IS NULL THEN '-' WHEN source_port > 0 THEN source_ip || ':' || source_port ELSE source_ip END AS source,
 CASE WHEN destination_port > 0 THEN destination_ip || ':' || destination_port ELSE destination_ip END AS destination
FROM feat"""))
def packet_expressions(spark, sf):
    return views.packets(spark, sf).select(
        "seq", net.encrypted_likely().alias("encrypted_likely"), net.trusted_port().alias("trusted"),
        net.portless().alias("portless"), net.flag_sum().alias("flag_sum"),
        net.endpoint("source_ip", "source_port").alias("source"),
        net.endpoint("destination_ip", "destination_port").alias("destination"))


@query("flow_keys", o.chain(*o.BASE, select=f"SELECT seq, flow_key, {o.SHA8.format('flow_key')} AS flow_id FROM keyed"))
def flow_keys(spark, sf):
    return views.packets(spark, sf).select("seq", net.flow_key().alias("flow_key"), net.flow_id().alias("flow_id"))


_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


@query("valid_addresses", o.chain(*o.BASE, select=f"""
SELECT address, n, CASE WHEN regexp_full_match(address, '{_OCTET}(\\.{_OCTET}){{3}}') THEN address END AS canonical FROM (
 SELECT CASE seq % 5 WHEN 0 THEN destination_ip || '.1' WHEN 1 THEN replace(destination_ip, '10.', '300.')
  WHEN 2 THEN replace(destination_ip, '.0.0.', '.0.00.') ELSE destination_ip END AS address, count(*) AS n
 FROM packets GROUP BY 1)"""))
def valid_addresses(spark, sf):
    ip, turn = F.col("destination_ip"), F.col("seq") % 5
    given = (F.when(turn == 0, F.concat(ip, F.lit(".1"))).when(turn == 1, F.replace(ip, F.lit("10."), F.lit("300.")))
             .when(turn == 2, F.replace(ip, F.lit(".0.0."), F.lit(".0.00."))).otherwise(ip))
    counts = views.packets(spark, sf).groupBy(given.alias("address")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("canonical", net.normalise_ip("address"))


_SESSION_SELECT = f"""SELECT seq, {o.r6('time_diff')} AS time_diff, {o.r3('packet_rate')} AS packet_rate,
 {o.r3('avg_length')} AS avg_length FROM sess"""


def _session_columns(df):
    return df.select("seq", half_up(F.col("time_diff"), 6).alias("time_diff"),
                     half_up(F.col("packet_rate"), 3).alias("packet_rate"),
                     half_up(F.col("avg_length"), 3).alias("avg_length"))


@query("session_features", o.chain(*o.BASE, o.SESSION.format(source="keyed"), select=_SESSION_SELECT))
def session_features(spark, sf):
    p = views.packets(spark, sf)
    return _session_columns(feat.session_features(p, DEFAULT, feat.slice_size(p, DEFAULT, "auto")))


@query("session_features_sliced", ORACLES["session_features"])
def session_features_sliced(spark, sf):
    return _session_columns(feat.session_features(views.packets(spark, sf), SLICED, SLICED.slice_rows))


def _feature_columns(df):
    six, three = 6, 3
    places = {"flow_duration": six, "avg_pkt_len": six, "pkt_len_std": six, "bytes_per_packet": six,
              "packets_per_second": three, "byte_rate": three, "burstiness": six, "iat": six}
    plain = ("seq", "flow_id", "flow_key", "total_packets", "total_bytes", "min_pkt_len", "max_pkt_len",
             "flag_sum", "dst_port", "protocol_code")
    return df.select(*plain, *[half_up(F.col(c), d).alias(c) for c, d in places.items()])


@query("flow_features", o.chain(*o.FEATURES, select=o.FEATURE_SELECT))
def flow_features(spark, sf):
    return _feature_columns(features(spark, sf))


@query("flow_features_sliced", ORACLES["flow_features"])
def flow_features_sliced(spark, sf):
    return _feature_columns(features(spark, sf, SLICED, "sliced"))


@query("flow_table", o.chain(*o.BASE, select=f"""
SELECT sensor_id, session_id, flow_key, {o.SHA8.format('flow_key')} AS flow_id, arg_min(ts_us, seq) AS start_us,
 arg_max(ts_us, seq) AS last_seen_us, count(*) AS total_packets, CAST(sum(length) AS BIGINT) AS total_bytes
FROM keyed GROUP BY sensor_id, session_id, flow_key"""))
def flow_table(spark, sf):
    return feat.flow_table(views.packets(spark, sf))


@query("flow_count", o.chain(*o.BASE, select="""
SELECT count(*) AS flows FROM (SELECT DISTINCT sensor_id, session_id, flow_key FROM keyed)"""))
def flow_count(spark, sf):
    return feat.flow_count(views.packets(spark, sf))


@query("next_log_id", o.chain(*o.LOGS, select="SELECT max(id) AS max_id FROM logs"))
def next_log_id(spark, sf):
    return feat.next_id(preview_logs(spark, sf))


def captured(spark, sf):
    """The packets as captures: in each, ``seq`` starts anew."""
    first = F.regexp_extract("session_id", "[0-9]+", 0).cast("long") * 5000
    return views.packets(spark, sf).withColumn("seq", F.col("seq") - first)


FIRST_ID = 1000
_CAPTURE_IDS = f"""spans AS (SELECT sensor_id, session_id, min(id) AS lo, max(id) - min(id) + 1 AS span FROM {{rows}} GROUP BY ALL),
placed AS (SELECT *, {FIRST_ID} + 1 + coalesce(sum(span) OVER (ORDER BY sensor_id, session_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM spans)"""


@query("packet_ids", o.chain(*o.BASE, "given AS (SELECT *, seq AS id FROM packets)", _CAPTURE_IDS.format(rows="given"), select="""
SELECT sensor_id, session_id, id % 5000 AS seq, CAST(base + id - lo AS BIGINT) AS id FROM given JOIN placed USING (sensor_id, session_id)"""))
def packet_ids(spark, sf):
    """Ids that are unique although each capture counts from 0."""
    return feat.packet_ids(captured(spark, sf), FIRST_ID).select("sensor_id", "session_id", "seq", "id")


def capture_logs(spark, sf):
    rows = decide_packets(feat.packet_ids(captured(spark, sf), FIRST_ID), score_columns=stub_scores_of_events())
    return write_table(verdict.build_logs(response.preview_action(rows, static_blocklist(spark)), log_id="id"), "capture_logs")


def stub_scores_of_events() -> dict:
    """The stand-in scores by the number that a packet had before captures."""
    named = lambda text: F.expr(text.replace("seq", "(seq + CAST(regexp_extract(session_id, '[0-9]+', 0) AS BIGINT) * 5000)"))
    mal = named(views.STUB_MAL)
    return scoring.two_stage_columns(named(views.STUB_BINARY), mal, F.greatest(mal, F.lit(100.0) - mal),
                                     named(views.STUB_ATTACK), named(views.STUB_ATTACK_CONF), DEFAULT)




@query("filtered_capture", o.chain(
    *o.BASE, "kept AS (SELECT * FROM keyed WHERE protocol IN ('TCP', 'UDP') AND (source_port IN (443, 53) OR destination_port IN (443, 53)))",
    o.SESSION.format(source="kept"), select=_SESSION_SELECT))
def filtered_capture(spark, sf):
    kept = capture_filter(views.packets(spark, sf), protocols=("tcp", "udp"), ports=(443, 53))
    return _session_columns(feat.session_features(kept, DEFAULT, feat.slice_size(kept, DEFAULT, "auto")))


# --- decisions --------------------------------------------------------------

_DECISION = ("seq", "prediction", "reason", "ml_confidence", "binary_label", "attack_label", "severity", "signature", "rule_id")
_DECISION_SQL = f"SELECT {', '.join(_DECISION)} FROM cls"


@query("metadata_decisions", o.chain(*o.METADATA_DECISIONS, select=_DECISION_SQL))
def metadata_decisions(spark, sf):
    return decide_packets(views.packets(spark, sf), RATED).select(*_DECISION)


@query("model_decisions", o.chain(*o.DECISIONS, select=_DECISION_SQL))
def model_decisions(spark, sf):
    return decisions(spark, sf).select(*_DECISION)


@query("model_decisions_sliced", ORACLES["model_decisions"])
def model_decisions_sliced(spark, sf):
    return decisions(spark, sf, SLICED, "sliced").select(*_DECISION)


@query("single_stage_decisions", o.chain(*o.SINGLE_DECISIONS, select=_DECISION_SQL))
def single_stage_decisions(spark, sf):
    return decide_packets(views.packets(spark, sf), score_columns=single_scores()).select(*_DECISION)


@query("consensus_votes", o.chain(*o.FEATURES, o.DETECTION, o.VOTES, select=f"""
SELECT seq, flow_id, {o.r3('vote_share')} AS vote_share FROM decided WHERE vote_share IS NOT NULL"""))
def consensus_votes(spark, sf):
    rows = features(spark, sf).withColumn("gate", gates.gate()).withColumns(stub_scores())
    votes = gates.consensus(rows).filter(F.col("vote_share").isNotNull())
    return votes.select("seq", "flow_id", half_up(F.col("vote_share"), 3).alias("vote_share"))


@query("two_stage_detections", o.chain(*o.FEATURES, o.DETECTION, select="""
SELECT seq, dpred AS det_prediction, CASE WHEN dpred = 'Benign' THEN 'None' ELSE dpred END AS det_threat,
 dconf AS det_confidence, blab AS det_binary_label, datt AS det_attack_label, mal AS det_binary_confidence FROM det"""))
def two_stage_detections(spark, sf):
    return views.packets(spark, sf).withColumns(stub_scores()).select("seq", *scoring.RESULT)


class FixedModel:
    """A model whose probabilities are stated expressions, so that SQL can
    repeat the whole of the scoring operators around it."""

    def __init__(self, classes, *probabilities: str):
        self.classes, self._p = list(classes), probabilities

    def probabilities(self, rows: DataFrame, out: str) -> DataFrame:
        return rows.withColumn(out, F.array(*[F.expr(f"CAST({p} AS DOUBLE)") for p in self._p]))

    feature_columns = None

    def accepts(self, columns) -> bool:
        return False


_MAL = "(rid % 101) / 100e0"
_KINDS = ("(rid % 11) / 10e0", "(rid % 5) / 10e0", "(rid % 3) / 10e0")
_BEST = """CASE WHEN {0} >= {1} AND {0} >= {2} THEN '{3}' WHEN {1} >= {2} THEN '{4}' ELSE '{5}' END"""


@query("scored_two_stage", o.chain(o.FLOWS, f"""p AS (SELECT rid, {_MAL} AS m, greatest({', '.join(_KINDS)}) AS top,
 {_BEST.format(*_KINDS, 'DDoS', 'PortScan', 'Bot')} AS kind FROM flows_raw)""", """q AS (SELECT rid, CASE WHEN m > 1 - m THEN 'MALICIOUS' ELSE 'BENIGN' END AS lab,
 round(m * 100, 2) AS mal, round(greatest(m, 1 - m) * 100, 2) AS conf, kind, round(top * 100, 2) AS kconf FROM p)""",
    "r AS (SELECT *, lab = 'BENIGN' OR mal < 65 AS benign FROM q)", select="""
SELECT rid, CASE WHEN benign THEN 'Benign' WHEN kconf < 85 THEN 'Suspicious' ELSE kind END AS det_prediction,
 CASE WHEN benign THEN 'None' WHEN kconf < 85 THEN 'Suspicious' ELSE kind END AS det_threat, CASE WHEN benign THEN conf ELSE kconf END AS det_confidence,
 lab AS det_binary_label, CASE WHEN NOT benign THEN kind END AS det_attack_label, mal AS det_binary_confidence FROM r"""))
def scored_two_stage(spark, sf):
    """``score_two_stage`` with stated probabilities; stage 2 sees what stage 1 leaves over."""
    rows = views.flows_raw(spark, sf).select("rid")
    binary = FixedModel(("BENIGN", "MALICIOUS"), f"1 - {_MAL}", _MAL)
    done = scoring.score_two_stage(rows, binary, FixedModel(("DDoS", "PortScan", "Bot"), *_KINDS))
    return done.select("rid", *scoring.RESULT)


@query("scored_single", o.chain(o.FLOWS, f"""p AS (SELECT rid, round(greatest({', '.join(_KINDS)}) * 100, 2) AS conf,
 {_BEST.format(*_KINDS, 'BENIGN', 'DDoS', 'PortScan')} AS lab FROM flows_raw)""", select="""
SELECT rid, CASE WHEN lab = 'BENIGN' THEN 'Benign' ELSE lab END AS det_prediction, CASE WHEN lab = 'BENIGN' THEN 'None' ELSE lab END AS det_threat,
 conf AS det_confidence, lab AS det_binary_label, CASE WHEN lab <> 'BENIGN' THEN lab END AS det_attack_label, conf AS det_binary_confidence FROM p"""))
def scored_single(spark, sf):
    rows = views.flows_raw(spark, sf).select("rid")
    return scoring.score_single(rows, FixedModel(("BENIGN", "DDoS", "PortScan"), *_KINDS)).select("rid", *scoring.RESULT)


@query("malicious_confidences", o.chain(o.FLOWS, select=f"""
SELECT rid, round({_MAL} * 100, 2) AS two, round({_MAL} * 100, 2) AS named, round(greatest({_MAL}, 1 - {_MAL}) * 100, 2) AS best,
 CASE WHEN rid % 2 = 0 THEN 'BENIGN' ELSE 'DDoS' END AS label, CAST(rid % 2 AS VARCHAR) AS bare FROM flows_raw"""))
def malicious_confidences(spark, sf):
    """The malicious class by name, by position, and without classes; label decoding."""
    prob = F.array(F.expr(f"1 - {_MAL}"), F.expr(_MAL))
    turned = F.array(F.expr(_MAL), F.expr(f"1 - {_MAL}"))
    return views.flows_raw(spark, sf).select(
        "rid", scoring.malicious_confidence(prob, ("benign", "0")).alias("two"), scoring.malicious_confidence(turned, ("DDoS", "BENIGN")).alias("named"),
        scoring.malicious_confidence(prob, None).alias("best"), scoring.decode_label(F.col("rid") % 2, ("BENIGN", "DDoS")).alias("label"),
        scoring.decode_label(F.col("rid") % 2, None).alias("bare"))


@query("fallback_decisions", o.chain(*o.METADATA_DECISIONS, select=_DECISION_SQL))
def fallback_decisions(spark, sf):
    """A model that lacks a feature leaves the decision to the metadata rules."""
    return decide_packets(views.packets(spark, sf), RATED, scorer=FixedModel(())).select(*_DECISION)


@query("inference_scaling", o.chain(*o.FEATURES, select=f"""
SELECT seq, flow_duration * 1e6 AS flow_duration, {o.r3('time_diff * 1e6')} AS iat,
 {o.r3('total_packets / (flow_duration + 1e-6)')} AS flow_rate,
 floor(total_packets / (flow_duration * 1e6 + 1e-6) * 1e9 + 0.5e0) / 1e9 AS packets_per_second,
 floor(total_bytes / (flow_duration * 1e6 + 1e-6) * 1e9 + 0.5e0) / 1e9 AS byte_rate,
 {o.r6('total_bytes / (total_packets + 1e-6)')} AS avg_packet_size FROM feat"""))
def inference_scaling(spark, sf):
    scaled = scoring.scale_for_inference(feat.model_view(features(spark, sf)))
    scoring.check_contract(scaled)
    places = {"iat": 3, "flow_rate": 3, "packets_per_second": 9, "byte_rate": 9, "avg_packet_size": 6}
    return scaled.select("seq", "flow_duration", *[half_up(F.col(c), d).alias(c) for c, d in places.items()])


@query("severity_grid", o.chain(*o.BASE, f"""grid AS (SELECT {views.STUB_ATTACK} AS label, CAST(floor({views.STUB_ATTACK_CONF}) AS INT) AS conf FROM packets)""",
    select=f"""SELECT label, conf, count(*) AS n, CASE WHEN label = 'Other' THEN 'low' WHEN conf < 85 THEN 'info' WHEN conf < 90 THEN 'medium'
  WHEN {o._has('lower(label)', ('ddos', 'dos', 'botnet', 'infiltration', 'ransomware'))} THEN 'critical'
  WHEN {o._has('lower(label)', ('brute', 'exploit', 'web attack', 'sql', 'xss', 'portscan', 'scan'))} THEN 'high' ELSE 'medium' END AS severity,
 CASE WHEN conf >= 90 THEN 'Very high' WHEN conf >= 80 THEN 'High' WHEN conf >= 65 THEN 'Moderate' ELSE 'Low' END AS band
FROM grid GROUP BY ALL"""))
def severity_grid(spark, sf):
    grid = views.packets(spark, sf).select(
        F.expr(views.STUB_ATTACK).alias("label"), F.floor(F.expr(views.STUB_ATTACK_CONF)).cast("int").alias("conf"))
    counts = grid.groupBy("label", "conf").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumns({"severity": lab.model_severity("label", "conf"), "band": lab.confidence_band("conf")})


# --- logs and response ------------------------------------------------------

_LOG_SQL = "SELECT * FROM logs"


@query("metadata_logs", o.chain(*o.METADATA_LOGS, select=_LOG_SQL))
def metadata_logs(spark, sf):
    return with_micros(detect(views.packets(spark, sf), RATED, blocked=static_blocklist(spark)).logs)


@query("detection_summary", o.chain(*o.METADATA_LOGS, select="""
SELECT severity, action, reason, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes,
 count(*) FILTER (encrypted_likely) AS encrypted FROM logs GROUP BY severity, action, reason"""))
def detection_summary(spark, sf):
    logs = detect(views.packets(spark, sf), RATED, blocked=static_blocklist(spark)).logs
    return logs.groupBy("severity", "action", "reason").agg(
        F.count(F.lit(1)).alias("packets"), F.sum(F.col("length").cast("long")).alias("bytes"),
        F.count_if("encrypted_likely").alias("encrypted"))


@query("packet_logs", o.chain(*o.LOGS, select=_LOG_SQL))
def packet_logs(spark, sf):
    return with_micros(preview_logs(spark, sf))


@query("replayed_logs", o.chain(*o.REPLAY_LOGS, select=_LOG_SQL))
def replayed_logs(spark, sf):
    return with_micros(replayed(spark, sf).logs)


@query("replayed_actions", o.chain(*o.REPLAY_LOGS, select="""
SELECT sensor_id, action, response_note, count(*) AS packets FROM logs GROUP BY ALL"""))
def replayed_actions(spark, sf):
    return replayed(spark, sf).logs.groupBy("sensor_id", "action", "response_note").agg(
        F.count(F.lit(1)).alias("packets"))


EAGER = Config(min_flow_packets=1, min_flow_duration=0.0, classify_interval=1, vote_ratio=0.0, stage2_threshold=50.0, alert_threshold=50.0)


def replayed_eagerly(spark, sf):
    """With every packet scored and believed, blocks keep others from being set
    off, which takes several rounds (asserted in the tests)."""
    return detect(views.packets(spark, sf), EAGER, score_columns=stub_scores(EAGER), blocked=static_blocklist(spark))


@query("replayed_feedback", o.chain(*o.EAGER_LOGS, select="SELECT sensor_id, id, action, response_note FROM logs"))
def replayed_feedback(spark, sf):
    return replayed_eagerly(spark, sf).logs.select("sensor_id", "id", "action", "response_note")


@query("blocklist_after_replay", o.chain(*o.REPLAY_LOGS, select=f"""
SELECT sensor_id, ip FROM (SELECT sensor_id, unnest(b) AS ip FROM ended) WHERE ip NOT IN ('10.0.0.5', '10.0.0.17')
UNION ALL SELECT NULL, unnest(['10.0.0.5', '10.0.0.17'])"""))
def blocklist_after_replay(spark, sf):
    return response.final_blocklist(replayed(spark, sf).replay, static_blocklist(spark))


@query("recon_watchlist", o.chain(*o.REPLAY_LOGS,
    select="SELECT ip, count(*) AS count FROM (SELECT unnest(w) AS ip FROM ended) GROUP BY ip ORDER BY count DESC, ip LIMIT 3"))
def recon_watchlist(spark, sf):
    warned = response.final_warnings(replayed(spark, sf).replay)
    return response.watchlist(warned.groupBy("ip").agg(F.sum("count").alias("count")))


@query("replay_with_commands", o.chain(*o.COMMAND_LOGS, select="SELECT sensor_id, id, action, response_note FROM logs"))
def replay_with_commands(spark, sf):
    """Manual blocks and releases taken from the packets: every 500th packet
    of a sensor is a command on its destination, in turn block and unblock."""
    packets = views.packets(spark, sf)
    turn = F.col("seq") % 500
    commands = packets.filter(turn.isin(0, 250)).select(
        "sensor_id", F.col("destination_ip").alias("ip"), F.col("seq").alias("at_seq"),
        F.when(turn == 0, "block").otherwise("unblock").alias("op"))
    done = detect(packets, score_columns=stub_scores(), commands=commands)
    return done.logs.select("sensor_id", "id", "action", "response_note")


@query("block_change_log", o.chain(*o.BASE, select="""
SELECT ip, reason, changed AS created_us FROM (
 SELECT destination_ip AS ip, arg_max(CASE WHEN syn_flag = 1 THEN 'block' ELSE 'unblock' END, seq) AS op,
  arg_max('packet ' || seq, seq) AS reason, arg_max(event_us, seq) AS changed FROM packets GROUP BY 1) WHERE op = 'block'"""))
def block_change_log(spark, sf):
    changes = views.packets(spark, sf).select(
        F.col("destination_ip").alias("ip"), F.when(F.col("syn_flag") == 1, "block").otherwise("unblock").alias("op"),
        F.concat(F.lit("packet "), F.col("seq").cast("string")).alias("reason"),
        F.timestamp_micros("event_us").alias("at"))
    return response.blocklist(changes).select("ip", "reason", F.unix_micros("created_at").alias("created_us"))


@query("blocked_packets", o.chain(*o.BASE, select=f"""
SELECT seq, {o.LISTED} AS blocked_before FROM packets"""))
def blocked_packets(spark, sf):
    return response.flag_blocked(views.packets(spark, sf), static_blocklist(spark)).select("seq", "blocked_before")


# --- log queries ------------------------------------------------------------

_REWRITE = """SELECT * EXCLUDE (label, vague) REPLACE (CASE WHEN vague THEN label ELSE prediction END AS prediction,
 CASE WHEN vague THEN 'low' ELSE severity END AS severity,
 CASE WHEN vague THEN 'ML warning: uncertain attack class' ELSE signature END AS signature,
 CASE WHEN vague THEN 'ML-WARN' ELSE rule_id END AS rule_id, CASE WHEN vague THEN 'warning' ELSE action END AS action,
 CASE WHEN vague THEN 'model_uncertain_attack' ELSE reason END AS reason,
 CASE WHEN vague THEN 'ML warning: review before treating as attack' ELSE response_note END AS response_note) FROM (SELECT *, coalesce(nullif(attack_label, ''), prediction) AS label,
  lower(trim(coalesce(nullif(attack_label, ''), prediction))) IN ('other', 'unknown', 'suspicious', 'none') AS vague FROM {src})"""


@query("ambiguous_rewrite", o.chain(*o.METADATA_LOGS, select=_REWRITE.format(src="logs")))
def ambiguous_rewrite(spark, sf):
    logs = detect(views.packets(spark, sf), RATED, blocked=static_blocklist(spark)).logs
    return with_micros(lq.rewrite_ambiguous(logs))


@query("recent_logs", o.chain(*o.LOGS, select=_REWRITE.format(src="(FROM logs ORDER BY id DESC LIMIT 500)")))
def recent_logs(spark, sf):
    return with_micros(lq.recent_logs(preview_logs(spark, sf)))


CAPTURE_LOGS = (*o.LOGS, _CAPTURE_IDS.format(rows="logs"),
                "captures AS (SELECT * EXCLUDE (lo, span, base) REPLACE (CAST(base + id - lo AS BIGINT) AS id) FROM logs JOIN placed USING (sensor_id, session_id))")


@query("capture_recent_logs", o.chain(*CAPTURE_LOGS, select=_REWRITE.format(src="(FROM captures ORDER BY id DESC LIMIT 500)")))
def capture_recent_logs(spark, sf):
    """The latest rows over several captures, each with a ``seq`` of its own."""
    return with_micros(lq.recent_logs(capture_logs(spark, sf)))


@query("capture_event_details", o.chain(*CAPTURE_LOGS, select="""
SELECT id, signature, rule_id, severity, flow_id, flow_packet_count, reason, action FROM captures WHERE id IN (SELECT min(id) FROM captures
 UNION ALL SELECT max(id) FROM captures)"""))
def capture_event_details(spark, sf):
    """Details by id, one row for each."""
    logs = capture_logs(spark, sf)
    ids = logs.agg(F.min("id"), F.max("id")).first()
    return dash.event_detail(logs, ids[0]).unionByName(dash.event_detail(logs, ids[1])).select("id", "signature", "rule_id", "severity", "flow_id", "flow_packet_count", "reason", "action")


@query("log_summary", o.chain(*o.LOGS, select=f"""
SELECT count(*) AS packets, count(*) FILTER (severity <> 'info' AND lower(coalesce(attack_label, prediction, ''))
  NOT IN ('other', 'unknown', 'suspicious', 'none')) AS alerts,
 count(*) FILTER (encrypted_likely) AS encrypted, count(*) FILTER (action = 'blocked') AS blocked FROM logs"""))
def log_summary(spark, sf):
    return lq.summary(preview_logs(spark, sf))


@query("session_logs", o.chain(*o.LOGS, select="FROM logs WHERE session_id = 'r0' ORDER BY id DESC LIMIT 100"))
def session_logs(spark, sf):
    return with_micros(lq.session_logs(preview_logs(spark, sf), "r0"))


@query("history_logs", o.chain(*o.LOGS, select="FROM logs WHERE session_id <> 'r1' ORDER BY id DESC LIMIT 500"))
def history_logs(spark, sf):
    return with_micros(lq.history_logs(preview_logs(spark, sf), "r1", 500))


@query("capture_report", o.chain(*o.LOGS, select="""
SELECT sensor_id, session_id, count(*) AS processed_packets,
 count(*) FILTER (severity <> 'info' OR action IN ('alert', 'blocked')) AS alert_count FROM logs GROUP BY ALL"""))
def capture_report(spark, sf):
    return lq.capture_report(preview_logs(spark, sf))


@query("status", o.chain(*o.LOGS, select="""
SELECT 'log_count' AS item, CAST(count(*) AS DOUBLE) AS value FROM logs
UNION ALL SELECT 'session_packets', count(*) FILTER (session_id = 'r0') FROM logs
UNION ALL SELECT 'flow_count', count(*) FROM (SELECT DISTINCT sensor_id, session_id, flow_key FROM keyed)
UNION ALL SELECT * FROM (VALUES ('blocked_ips', 2), ('ml_min_packets', 12), ('ml_min_duration', 3), ('ml_attack_threshold', 85))"""))
def status(spark, sf):
    return lq.status(views.packets(spark, sf), preview_logs(spark, sf), static_blocklist(spark), "r0")


@query("status_addresses", o.chain(*o.REPLAY_LOGS, select="""
SELECT DISTINCT 'blocked_ips' AS item, unnest(b) AS ip, 1 AS value FROM ended
UNION ALL SELECT 'warning_counts', ip, count(*) FROM (SELECT unnest(w) AS ip FROM ended) GROUP BY ip"""))
def status_addresses(spark, sf):
    replay = replayed(spark, sf).replay
    return lq.status_addresses(response.final_blocklist(replay, static_blocklist(spark)), response.final_warnings(replay))


# --- dashboard --------------------------------------------------------------

@query("verdicts", o.chain(*o.LOGS, select=f"""
SELECT id, severity, rule_id, signature, {o.WARNING} AS warning, {o.THREAT} AS threat,
 CASE WHEN action = 'blocked' THEN 'BLOCKED' WHEN {o.WARNING} THEN 'WARNING' WHEN {o.THREAT} THEN 'MALICIOUS' ELSE 'SAFE' END AS verdict,
 {o.SHOWN_LABEL} AS label FROM logs"""))
def verdicts(spark, sf):
    return dash.enrich(preview_logs(spark, sf)).select(
        "id", "severity", "rule_id", "signature", dash.is_warning().alias("warning"), dash.is_threat().alias("threat"),
        dash.verdict().alias("verdict"), dash.attack_label().alias("label"))


_PARTIAL = """partial AS (SELECT id, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 7 = 0 THEN 'Weird' ELSE severity END AS severity,
 CASE WHEN id % 5 = 0 THEN '' ELSE rule_id END AS rule_id, CASE WHEN id % 4 = 0 THEN NULL ELSE signature END AS signature,
 CASE WHEN id % 8 = 0 THEN '' ELSE prediction END AS prediction, reason FROM logs)"""


@query("enriched_partial_logs", o.chain(*o.METADATA_LOGS, _PARTIAL, select="""
SELECT id, CASE WHEN severity = 'Weird' THEN 'info' WHEN severity IS NOT NULL THEN severity
  WHEN lower(prediction) IN ('normal', 'benign') THEN 'info' WHEN reason = 'high_packet_rate' THEN 'critical' ELSE 'medium' END AS severity,
 coalesce(nullif(rule_id, ''), 'LEGACY-0000') AS rule_id,
 coalesce(signature, nullif(prediction, ''), 'Metadata baseline') AS signature FROM partial"""))
def enriched_partial_logs(spark, sf):
    logs = detect(views.packets(spark, sf), RATED, blocked=static_blocklist(spark)).logs
    i = F.col("id")
    partial = logs.withColumns({
        "severity": F.when(i % 3 == 0, None).when(i % 7 == 0, "Weird").otherwise(F.col("severity")),
        "rule_id": F.when(i % 5 == 0, "").otherwise(F.col("rule_id")),
        "signature": F.when(i % 4 != 0, F.col("signature")),
        "prediction": F.when(i % 8 == 0, "").otherwise(F.col("prediction"))})
    return dash.enrich(partial).select("id", "severity", "rule_id", "signature")


@query("kpis", o.chain(*o.LOGS, select=f"""
SELECT count(*) AS packets, count(*) FILTER ({o.THREAT}) AS alerts, count(*) FILTER (encrypted_likely) AS encrypted,
 count(*) FILTER (action = 'blocked') AS blocked, count(*) FILTER (severity = 'critical') AS critical,
 (SELECT source_ip FROM logs WHERE source_ip IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, max(id) DESC LIMIT 1) AS top_talker
FROM logs"""))
def kpis(spark, sf):
    return dash.kpis(preview_logs(spark, sf))


@query("alert_queue", o.chain(*o.LOGS, select=f"""
SELECT signature, source_ip, destination_ip, severity, count(*) AS count, max(id) AS last_id,
 arg_max(id, time_us * 1000000 + id % 1000000) AS newest_id,
 arg_max(CASE WHEN source_ip IS NULL THEN '-' WHEN source_port > 0 THEN source_ip || ':' || source_port ELSE source_ip END,
  CAST(time_us AS HUGEINT) * 1000000000000 + id) AS source,
 arg_max(CASE WHEN destination_port > 0 THEN destination_ip || ':' || destination_port ELSE destination_ip END,
  CAST(time_us AS HUGEINT) * 1000000000000 + id) AS destination
FROM logs WHERE {o.THREAT} OR {o.WARNING} GROUP BY 1, 2, 3, 4
ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC,
 count DESC, last_id DESC LIMIT 8""".replace("time_us * 1000000 + id % 1000000", "CAST(time_us AS HUGEINT) * 1000000000000 + id")))
def alert_queue(spark, sf):
    return dash.alert_queue(preview_logs(spark, sf))


@query("top_sources", o.chain(*o.LOGS, select=o.top("source_ip", "entity", 6, "source_ip IS NOT NULL")))
def top_sources(spark, sf):
    return dash.top_entities(preview_logs(spark, sf), "source_ip")


@query("top_targets", o.chain(*o.LOGS, select=o.top("destination_ip", "entity", 6, "destination_ip IS NOT NULL")))
def top_targets(spark, sf):
    return dash.top_entities(preview_logs(spark, sf), "destination_ip")


@query("top_sources_chart", o.chain(*o.LOGS, select=o.top("coalesce(source_ip, '-')", "source", 6)))
def top_sources_chart(spark, sf):
    return dash.top_sources(preview_logs(spark, sf))


@query("top_attacks", o.chain(*o.LOGS, select=o.top(o.SHOWN_LABEL, "attack", 6, o.THREAT)))
def top_attacks(spark, sf):
    return dash.top_attacks(preview_logs(spark, sf))


@query("top_ports", o.chain(*o.LOGS, select="""
SELECT coalesce(CAST(p AS VARCHAR), 'Other') AS port, count FROM (SELECT nullif(destination_port, 0) AS p, count(*) AS count
 FROM logs GROUP BY 1 ORDER BY count DESC, p ASC NULLS LAST LIMIT 7)"""))
def top_ports(spark, sf):
    return dash.top_ports(preview_logs(spark, sf))


@query("entity_count", o.chain(*o.LOGS, select="""
SELECT count(DISTINCT ip) AS entities FROM (SELECT source_ip AS ip FROM logs UNION ALL SELECT destination_ip FROM logs)"""))
def entity_count(spark, sf):
    return dash.entity_count(preview_logs(spark, sf))


_MIX = """SELECT protocol, count(*) AS count, max(id) AS last_id,
 CAST(floor(count(*) * 100e0 / (SELECT count(*) FROM logs) + 0.5e0) AS INT) AS pct FROM logs GROUP BY 1
 ORDER BY count DESC, last_id DESC LIMIT {k}"""


@query("protocol_mix", o.chain(*o.LOGS, select=_MIX.format(k=6)))
def protocol_mix(spark, sf):
    return dash.protocol_mix(preview_logs(spark, sf))


@query("protocol_chart", o.chain(*o.LOGS, select=_MIX.format(k=5)))
def protocol_chart(spark, sf):
    return dash.protocol_mix(preview_logs(spark, sf), 5, "Other")


_FIRST = int(NOW.timestamp() * 1e6) - 11 * 300_000_000


@query("traffic_buckets", o.chain(*o.EVENT_LOGS, f"""placed AS (SELECT greatest(0, least(11,
  CAST(ceil((time_us - {_FIRST}) / 3e8 - 0.5e0) AS INT))) AS bucket, {o.THREAT} AS threat FROM logs)""", select=f"""
SELECT CAST(b AS INT) AS bucket, {_FIRST} + b * 300000000 AS centre_us, count(*) FILTER (NOT threat) AS safe,
 count(*) FILTER (threat) AS threat FROM range(12) r(b) LEFT JOIN placed ON bucket = b GROUP BY b"""))
def traffic_buckets(spark, sf):
    chart = dash.traffic_buckets(preview_logs(spark, sf, "event_us"), NOW)
    return chart.withColumn("centre_us", F.unix_micros("centre")).drop("centre")


_MINUTES = """SELECT minute_us, count FROM (SELECT time_us // 60000000 * 60000000 AS minute_us, count(*) AS count
 FROM logs WHERE {threat} GROUP BY 1 ORDER BY minute_us {order} LIMIT 10)"""


@query("alert_timeline_oldest", o.chain(*o.EVENT_LOGS, select=_MINUTES.format(threat=o.THREAT, order="ASC")))
def alert_timeline_oldest(spark, sf):
    line = dash.alert_timeline(preview_logs(spark, sf, "event_us"))
    return line.select(F.unix_micros("minute").alias("minute_us"), "count")


@query("alert_timeline_newest", o.chain(*o.EVENT_LOGS, select=_MINUTES.format(threat=o.THREAT, order="DESC")))
def alert_timeline_newest(spark, sf):
    line = dash.alert_timeline(preview_logs(spark, sf, "event_us"), which="newest")
    return line.select(F.unix_micros("minute").alias("minute_us"), "count")


@query("log_search", o.chain(*o.LOGS, select="""
SELECT id, source_ip, destination_ip, prediction, severity, action FROM logs
WHERE contains(lower(concat_ws(' ', source_ip, destination_ip, protocol, prediction, reason, signature, rule_id)), '10.0.0.1')
 AND severity = 'low' AND action = 'warning'"""))
def log_search(spark, sf):
    return dash.search_logs(preview_logs(spark, sf), " 10.0.0.1", "low", "warning").select(
        "id", "source_ip", "destination_ip", "prediction", "severity", "action")


@query("first_alerts", o.chain(*o.LOGS, select=f"""
SELECT lower(coalesce(source_ip, 'unknown')) || '|' || lower(label) AS alert_key, min(id) AS id, arg_min(action, id) AS action,
 arg_min(severity, id) AS severity FROM (SELECT *, {o.SHOWN_LABEL} AS label FROM logs) WHERE label <> '-' GROUP BY 1"""))
def first_alerts(spark, sf):
    return dash.first_alerts(preview_logs(spark, sf)).select("alert_key", "id", "action", "severity")


@query("event_details", o.chain(*o.LOGS, select="""
SELECT id, CASE WHEN source_ip IS NULL THEN '-' WHEN source_port > 0 THEN source_ip || ':' || source_port ELSE source_ip END AS source,
 CASE WHEN destination_port > 0 THEN destination_ip || ':' || destination_port ELSE destination_ip END AS destination,
 CASE WHEN encrypted_likely THEN 'Likely' ELSE 'No' END AS encrypted, CASE WHEN ml_confidence IS NULL THEN '-'
  WHEN ml_confidence >= 90 THEN 'Very high' WHEN ml_confidence >= 80 THEN 'High' WHEN ml_confidence >= 65 THEN 'Moderate' ELSE 'Low' END AS model_certainty,
 signature, rule_id, severity, flow_id, flow_packet_count, reason, action, response_note FROM logs WHERE id = (SELECT max(id) FROM logs)"""))
def event_details(spark, sf):
    logs = preview_logs(spark, sf)
    last = views.packets(spark, sf).agg(F.max("seq")).first()[0]
    return dash.event_detail(logs, last).select(
        "id", "source", "destination", "encrypted", "model_certainty", "signature", "rule_id", "severity", "flow_id",
        "flow_packet_count", "reason", "action", "response_note")


_HITS = """hits AS (SELECT s.id AS source_id, s.name, s.category, count(l.id) AS hits FROM (VALUES
  ('ML-*', 'ML model classification', 'model'), ('META-1001', 'Sustained packet-rate anomaly', 'metadata'),
  ('META-1002', 'Encrypted service metadata', 'metadata'), ('META-0000', 'Metadata baseline', 'baseline'),
  ('RESPONSE', 'Manual blocklist response', 'response')) s(id, name, category)
 LEFT JOIN logs l ON CASE s.id WHEN 'ML-*' THEN l.rule_id LIKE 'ML-%'
  WHEN 'RESPONSE' THEN coalesce(l.response_note = 'Matched existing blocklist rule', false) ELSE l.rule_id = s.id END GROUP BY ALL)"""


@query("rule_hits", o.chain(*o.METADATA_LOGS, _HITS, select="FROM hits"))
def rule_hits(spark, sf):
    return dash.rule_hits(detect(views.packets(spark, sf), RATED, blocked=static_blocklist(spark)).logs)


@query("rule_categories", o.chain(*o.LOGS, _HITS, select="""
SELECT category, count(*) AS sources, CAST(sum(hits) AS BIGINT) AS hits FROM hits GROUP BY 1"""))
def rule_categories(spark, sf):
    return dash.rule_categories(preview_logs(spark, sf))


# --- datasets ---------------------------------------------------------------

def raw_cic(flows):
    bits = net.tcp_flag_columns(F.col("tcp_flags"))
    return flows.filter("ds = 0").select(
        F.col("dst_port").alias("destination port"), F.col("dur").alias("flow duration"),
        F.col("fwd_pkts").alias("total fwd packets"), F.col("bwd_pkts").alias("total backward packets"),
        F.col("fwd_bytes").alias("total length of fwd packets"), F.col("bwd_bytes").alias("total length of bwd packets"),
        F.col("min_len").alias("min packet length"), F.col("max_len").alias("max packet length"),
        F.col("mean_len").alias("packet length mean"), F.col("std_len").alias("packet length std"),
        F.col("rate").alias("flow packets/s"), F.col("iat").alias("flow iat mean"),
        *[bits[f"{f}_flag"].alias(f"{f} flag count") for f in ("syn", "ack", "rst", "psh")], "label")


def raw_netflow(flows, which: int):
    return flows.filter(F.col("ds") == which).select(
        F.col("dst_port").alias("l4_dst_port"), "protocol", F.col("dur").alias("flow_duration_milliseconds"),
        F.col("fwd_pkts").alias("in_pkts"), F.col("bwd_pkts").alias("out_pkts"), F.col("fwd_bytes").alias("in_bytes"),
        F.col("bwd_bytes").alias("out_bytes"), F.col("min_len").alias("min_ip_pkt_len"),
        F.col("max_len").alias("max_ip_pkt_len"), F.col("max_len").alias("longest_flow_pkt"),
        F.col("min_len").alias("shortest_flow_pkt"), F.col("rate").alias("src_to_dst_avg_throughput"), "tcp_flags",
        F.col("ttl").alias("min_ttl"), "label")


def raw_iot(flows):
    bits = net.tcp_flag_columns(F.col("tcp_flags"))
    return flows.filter("ds = 3").select(
        F.col("protocol").alias("protocol type"), F.col("fwd_pkts").alias("number"), F.col("fwd_bytes").alias("tot size"),
        F.col("min_len").alias("min"), F.col("max_len").alias("max"), F.col("mean_len").alias("avg"),
        F.col("std_len").alias("std"), "rate", "iat",
        *[bits[f"{f}_flag"].alias(f"{f}_flag_number") for f in ("syn", "ack", "rst", "psh")],
        F.col("ttl").alias("time_to_live"), "label")


def unified(spark, sf):
    flows = views.flows_raw(spark, sf)
    return ds.unify(ds.map_cic(raw_cic(flows)), ds.map_netflow(raw_netflow(flows, 1)),
                    ds.map_netflow(raw_netflow(flows, 2)), ds.map_iot(raw_iot(flows)))


def attacks(spark, sf):
    return prep.group_attacks(prep.attacks_only(prep.clean(unified(spark, sf))))


def attack_types(spark, sf):
    """Their classes alone, stored: an operator that reads them twice does not map the flows twice."""
    return write_table(attacks(spark, sf).select("attack_type"), "attack-types")


@query("cic_mapping", o.chain(o.FLOWS, select=o._unified(0)))
def cic_mapping(spark, sf):
    return ds.fill_schema(ds.map_cic(raw_cic(views.flows_raw(spark, sf))))


@query("netflow_mapping", o.chain(o.FLOWS, select=o._unified(1)))
def netflow_mapping(spark, sf):
    return ds.fill_schema(ds.map_netflow(raw_netflow(views.flows_raw(spark, sf), 1)))


@query("netflow_mapping_bits", o.chain(o.FLOWS, select="""
SELECT (tcp_flags // 2) % 2 AS syn_flag, (tcp_flags // 16) % 2 AS ack_flag, (tcp_flags // 4) % 2 AS rst_flag,
 (tcp_flags // 8) % 2 AS psh_flag, CASE WHEN lower(label) IN ('benign', 'normal', '0') THEN 'BENIGN' ELSE 'MALICIOUS' END AS binary_label,
 count(*) AS n FROM flows_raw WHERE ds = 2 GROUP BY ALL"""))
def netflow_mapping_bits(spark, sf):
    mapped = ds.map_netflow(raw_netflow(views.flows_raw(spark, sf), 2), nf_flags="bits", nf_labels="numeric")
    return mapped.groupBy("syn_flag", "ack_flag", "rst_flag", "psh_flag", "binary_label").agg(F.count(F.lit(1)).alias("n"))


@query("iot_mapping", o.chain(o.FLOWS, select=o._unified(3)))
def iot_mapping(spark, sf):
    return ds.fill_schema(ds.map_iot(raw_iot(views.flows_raw(spark, sf))))


@query("unified_flows", o.chain(*o.UNIFIED, select="FROM unified"))
def unified_flows(spark, sf):
    return unified(spark, sf)


@query("unified_label_counts", o.chain(*o.UNIFIED, select="""
SELECT binary_label, attack_type, count(*) AS n FROM unified GROUP BY ALL"""))
def unified_label_counts(spark, sf):
    return unified(spark, sf).groupBy("binary_label", "attack_type").agg(F.count(F.lit(1)).alias("n"))


@query("cleaned_flows", o.chain(*o.CLEAN, select="FROM clean"))
def cleaned_flows(spark, sf):
    return prep.clean(unified(spark, sf))


@query("deduplicated_flows", o.chain(*o.DEDUPED, select="FROM clean"))
def deduplicated_flows(spark, sf):
    return prep.clean(unified(spark, sf), bound=None, dedup=True)


@query("quality_profile", o.chain(*o.UNIFIED, select=f"""
SELECT CAST({' + '.join(f'count(*) FILTER ({c} IS NULL)' for c in o.FEATURES16)} AS BIGINT) AS missing,
 CAST({' + '.join(f'count(*) FILTER (isinf({c}))' for c in o.FEATURES16)} AS BIGINT) AS infinite,
 count(*) AS row_count, 18 AS column_count FROM unified"""))
def quality_profile(spark, sf):
    return prep.profile(unified(spark, sf))


@query("class_counts", o.chain(*o.CLEAN, select="""
SELECT attack_type, count(*) AS count, floor(count(*) / (SELECT count(*) FROM clean) * 1e3 + 0.5e0) / 1e3 AS share
FROM clean GROUP BY 1"""))
def class_counts(spark, sf):
    return prep.class_counts(prep.clean(unified(spark, sf)), "attack_type")


@query("rare_classes", o.chain(*o.CLEAN, select="SELECT attack_type, count(*) AS count FROM clean GROUP BY 1 HAVING count(*) < 4500"))
def rare_classes(spark, sf):
    return prep.rare_classes(prep.clean(unified(spark, sf)), "attack_type", 4500)


@query("attack_classes", o.chain(*o.CLEAN, select="""
SELECT attack_type, count(*) AS count FROM clean WHERE upper(attack_type) NOT IN ('BENIGN', 'NORMAL') GROUP BY 1"""))
def attack_classes(spark, sf):
    return prep.attack_classes(prep.clean(unified(spark, sf)), "attack_type")


@query("grouped_attacks", o.chain(*o.CLEAN, *o.ATTACKS, select="SELECT * EXCLUDE (kind) FROM attacks"))
def grouped_attacks(spark, sf):
    return attacks(spark, sf)


# a key order that both engines can repeat: ties go by the columns
_DRAW = """(CAST(total_bytes AS BIGINT) * 7919 + CAST(total_packets AS BIGINT) * 104729 + CAST(dst_port AS BIGINT) * 31
 + CAST(floor(flow_duration * 100) AS BIGINT) * 15485863) % 1000003"""
_DRAWN = f"""drawn AS (SELECT *, row_number() OVER (PARTITION BY attack_type ORDER BY {_DRAW}, {', '.join(o.FEATURES16)}) AS place,
 count(*) OVER (PARTITION BY attack_type) AS of_class FROM attacks)"""
_DRAWN_COLUMNS = ("attack_type", "total_bytes", "total_packets", "flow_duration", "dst_port", "flow_rate")


def _draw_key():
    return F.expr(_DRAW) * F.lit((1 << 62) // 1000003)


@query("capped_classes", o.chain(*o.CLEAN, *o.ATTACKS, _DRAWN, select=f"SELECT {', '.join(_DRAWN_COLUMNS)} FROM drawn WHERE place <= {o.CAP}"))
def capped_classes(spark, sf):
    return prep.cap_classes(attacks(spark, sf), "attack_type", o.CAP, key=_draw_key()).select(*_DRAWN_COLUMNS)


@query("stratified_split", o.chain(*o.CLEAN, *o.ATTACKS, _DRAWN, select=f"""
SELECT {', '.join(_DRAWN_COLUMNS)}, CASE WHEN place <= floor(of_class * 0.2e0 + 0.5e0) THEN 'test' ELSE 'train' END AS part FROM drawn"""))
def stratified_split(spark, sf):
    train, test = prep.stratified_split(attacks(spark, sf), "attack_type", key=_draw_key())
    halves = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return halves.select(*_DRAWN_COLUMNS, "part")


_DERIVED_SQL = """SELECT attack_type, {r3b} AS bytes_per_packet, {pps} AS packets_per_second, {rate} AS byte_rate,
 {burst} AS burstiness, flag_sum FROM (SELECT *, total_packets / (flow_duration + 1e-6) AS pps,
 total_bytes / (total_packets + 1e-6) AS bpp, syn_flag + ack_flag + rst_flag + psh_flag AS flag_sum FROM clean)"""


def _derived_sql(burst: str) -> str:
    return _DERIVED_SQL.format(r3b=o.r3("bpp"), pps=o.r6("pps"), rate=o.r3("total_bytes / (flow_duration + 1e-6)"),
                               burst=o.r6(burst))


def _derived(spark, sf, burstiness):
    out = prep.derive_features(prep.clean(unified(spark, sf)), burstiness)
    places = {"bytes_per_packet": 3, "packets_per_second": 6, "byte_rate": 3, "burstiness": 6}
    return out.select("attack_type", "flag_sum", *[half_up(F.col(c), d).alias(c) for c, d in places.items()])


@query("derived_features", o.chain(*o.CLEAN, select=_derived_sql("pkt_len_std / (avg_pkt_len + 1e-6)")))
def derived_features(spark, sf):
    return _derived(spark, sf, "std")


@query("derived_features_rate", o.chain(*o.CLEAN, select=_derived_sql("pps * bpp")))
def derived_features_rate(spark, sf):
    return _derived(spark, sf, "rate")


@query("model_matrix", o.chain(*o.CLEAN, select=f"""
SELECT {', '.join(f'CAST({c} AS FLOAT) AS {c}' for c in o.FEATURES16 if c != 'flow_duration')},
 CAST(syn_flag + ack_flag + rst_flag + psh_flag AS FLOAT) AS flag_sum, binary_label FROM clean"""))
def model_matrix(spark, sf):
    matrix = prep.select_features(prep.derive_features(prep.clean(unified(spark, sf))), "binary_label")
    return matrix.select(*[c for c in o.FEATURES16 if c != "flow_duration"], "flag_sum", "binary_label")


# --- training and evaluation ------------------------------------------------

@query("indexed_labels", o.chain(*o.CLEAN, *o.ATTACKS, select="""
SELECT attack_type, CAST(dense_rank() OVER (ORDER BY attack_type) - 1 AS DOUBLE) AS label_index, n
FROM (SELECT attack_type, count(*) AS n FROM attacks GROUP BY 1)"""))
def indexed_labels(spark, sf):
    indexed, _ = training.index_labels(attack_types(spark, sf), "attack_type")
    return indexed.groupBy("attack_type", "label_index").agg(F.count(F.lit(1)).alias("n"))


@query("balanced_weights", o.chain(*o.CLEAN, *o.ATTACKS, select="""
SELECT attack_type, n, floor(total / (classes * n) * 1e9 + 0.5e0) / 1e9 AS weight FROM (SELECT attack_type, count(*) AS n,
 CAST(sum(count(*)) OVER () AS BIGINT) AS total, count(*) OVER () AS classes FROM attacks GROUP BY 1)"""))
def balanced_weights(spark, sf):
    weighted = training.balanced_weights(attack_types(spark, sf), "attack_type")
    return weighted.groupBy("attack_type", half_up(F.col("weight"), 9).alias("weight")).agg(F.count(F.lit(1)).alias("n"))


_SCALED = ("total_packets", "total_bytes", "avg_pkt_len", "pkt_len_std", "ttl")


@query("scaler_statistics", o.chain(*o.CLEAN, select=" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {o.r3(f'avg({c})')} AS mean, {o.r3(f'stddev_pop({c})')} AS std FROM clean" for c in _SCALED)))
def scaler_statistics(spark, sf):
    stats = training.scaler_stats(prep.clean(unified(spark, sf)), _SCALED)
    return stats.select("feature", half_up(F.col("mean"), 3).alias("mean"), half_up(F.col("std"), 3).alias("std"))


_EDGES = {"dst_port": (50, 100), "ttl": (64, 100), "total_packets": (5, 10, 20, 40)}


@query("mutual_information", o.chain(*o.CLEAN, "counts AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c} AS bin, binary_label AS cls, count(*) AS n FROM clean GROUP BY ALL"
    for c in ("dst_port", "protocol", "ttl", "total_packets")) + ")", select="""
SELECT feature, floor(greatest(sum(part), 0) * 1e6 + 0.5e0) / 1e6 AS mi FROM (SELECT feature,
 n / sum(n) OVER f * ln(n * sum(n) OVER f / (sum(n) OVER b * CAST(sum(n) OVER c AS DOUBLE))) AS part FROM counts
 WINDOW f AS (PARTITION BY feature), b AS (PARTITION BY feature, bin), c AS (PARTITION BY feature, cls)) GROUP BY 1"""))
def mutual_information(spark, sf):
    """On discrete features, where every value is its own bin."""
    rows = prep.clean(unified(spark, sf))
    names = ("dst_port", "protocol", "ttl", "total_packets")
    binned = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("bin")) for c in names]))
    counts = rows.select(F.col("binary_label").alias("cls"), binned.alias("b")).groupBy("b.feature", "b.bin", "cls").agg(
        F.count(F.lit(1)).alias("n"))
    return training.mutual_information_of(counts).withColumn("mi", half_up(F.col("mi"), 6))


_STEPS = (0.0, 1.0, 10.0, 100.0, 1000.0, 10_000.0, 100_000.0)
_RATIOS = """rated AS (SELECT *, total_bytes / (total_packets + 1e-6) AS bytes_per_packet, total_packets / (flow_duration + 1e-6) AS packets_per_second,
 total_bytes / (total_packets + 1e-6) AS avg_packet_size, total_bytes / (flow_duration + 1e-6) AS byte_rate,
 pkt_len_std / (avg_pkt_len + 1e-6) AS burstiness, syn_flag + ack_flag + rst_flag + psh_flag AS flag_sum FROM clean)"""


@query("mutual_information_ranking", o.chain(*o.CLEAN, _RATIOS, "counts AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {' + '.join(f'CASE WHEN {c} > {e} THEN 1 ELSE 0 END' for e in _STEPS)} AS bin, binary_label AS cls, count(*) AS n FROM rated GROUP BY ALL"
    for c in MODEL_FEATURES) + ")", """found AS (SELECT feature, floor(greatest(sum(part), 0) * 1e6 + 0.5e0) / 1e6 AS mi FROM (SELECT feature,
 n / sum(n) OVER f * ln(n * sum(n) OVER f / (sum(n) OVER b * CAST(sum(n) OVER c AS DOUBLE))) AS part FROM counts
 WINDOW f AS (PARTITION BY feature), b AS (PARTITION BY feature, bin), c AS (PARTITION BY feature, cls)) GROUP BY 1)""",
    select="SELECT feature, mi, row_number() OVER (ORDER BY mi DESC, feature) AS place FROM found"))
def mutual_information_ranking(spark, sf):
    """All model features, cut at the powers of ten, by what they tell of the class."""
    rows = prep.derive_features(prep.clean(unified(spark, sf)))
    found = training.mutual_information(rows, MODEL_FEATURES, "binary_label", edges={c: _STEPS for c in MODEL_FEATURES})
    found = found.withColumn("mi", half_up(F.col("mi"), 6))
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mi"), "feature")))  # one row for each feature


def predicted(spark, sf):
    flows = views.flows_raw(spark, sf)
    guess = F.when(F.col("rid") % 4 == 0, "BENIGN").otherwise(F.col("label"))
    return flows.select(F.col("label").alias("actual"), guess.alias("predicted"))


@query("confusion_counts", o.chain(o.FLOWS, *o.PREDICTED, select="FROM cm"))
def confusion_counts(spark, sf):
    return training.confusion(predicted(spark, sf), "actual", "predicted")


_CLASSES = ("BENIGN", "DDoS", "PortScan", "0")


@query("confusion_matrix", o.chain(o.FLOWS, *o.PREDICTED, select="SELECT actual, " + ", ".join(
    f"""CAST(coalesce(sum(n) FILTER (predicted = '{c}'), 0) AS BIGINT) AS "{c}" """ for c in _CLASSES) + " FROM cm GROUP BY 1"))
def confusion_matrix(spark, sf):
    return training.confusion_matrix(training.confusion(predicted(spark, sf), "actual", "predicted"), _CLASSES)


@query("classification_report", o.chain(o.FLOWS, *o.PREDICTED, o.PER_CLASS, select=f"""
SELECT label, {o.r6('precision')} AS precision, {o.r6('recall')} AS recall, {o.r6('f1')} AS f1, support FROM rep
UNION ALL SELECT 'accuracy', {o.r6('a')}, {o.r6('a')}, {o.r6('a')}, n FROM (
 SELECT sum(n) FILTER (actual = predicted) / sum(n) AS a, CAST(sum(n) AS BIGINT) AS n FROM cm)
UNION ALL SELECT 'macro avg', {o.r6('avg(precision)')}, {o.r6('avg(recall)')}, {o.r6('avg(f1)')}, CAST(sum(support) AS BIGINT) FROM rep
UNION ALL SELECT 'weighted avg', {o.r6('sum(precision * support) / sum(support)')}, {o.r6('sum(recall * support) / sum(support)')},
 {o.r6('sum(f1 * support) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM rep"""))
def classification_report(spark, sf):
    report = training.classification_report(training.confusion(predicted(spark, sf), "actual", "predicted"))
    return report.select("label", *[half_up(F.col(c), 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("benign_false_positives", o.chain(o.FLOWS, *o.PREDICTED, select="""
SELECT CAST(coalesce(sum(n) FILTER (actual = 'DDoS' AND predicted <> 'DDoS'), 0) AS BIGINT) AS wrong,
 CAST(sum(n) FILTER (actual = 'DDoS') AS BIGINT) AS total,
 floor(coalesce(sum(n) FILTER (actual = 'DDoS' AND predicted <> 'DDoS'), 0) / greatest(sum(n) FILTER (actual = 'DDoS'), 1) * 1e6 + 0.5e0) / 1e6 AS fpr FROM cm"""))
def benign_false_positives(spark, sf):
    rate = training.benign_fpr(training.confusion(predicted(spark, sf), "actual", "predicted"), "DDoS")
    return rate.withColumn("fpr", half_up(F.col("fpr"), 6))


@query("top_classes", o.chain(o.FLOWS, """probs AS (SELECT rid, i, p FROM (SELECT DISTINCT rid FROM flows_raw),
 LATERAL (VALUES (0, (rid % 7) / 10e0), (1, (rid % 5) / 10e0), (2, (rid % 3) / 10e0), (3, 0.25e0)) v(i, p))""", select="""
SELECT rid, CAST(n AS INT) AS place, ['a', 'b', 'c', 'd'][i + 1] AS label, p AS probability FROM (
 SELECT *, row_number() OVER (PARTITION BY rid ORDER BY p DESC, i DESC) AS n FROM probs) WHERE n <= 3"""))
def top_classes(spark, sf):
    rid = F.col("rid")
    prob = F.array((rid % 7) / 10.0, (rid % 5) / 10.0, (rid % 3) / 10.0, F.lit(0.25))
    rows = views.flows_raw(spark, sf).select("rid").distinct().withColumn("prob", prob)
    top = training.top_classes(rows, ("a", "b", "c", "d")).select("rid", F.posexplode("top").alias("place", "t"))
    return top.select("rid", (F.col("place") + 1).alias("place"), "t.label", "t.probability")


@query("mutual_information_binned", o.chain(*o.CLEAN, "counts AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {' + '.join(f'CASE WHEN {c} > {e} THEN 1 ELSE 0 END' for e in _EDGES[c])} AS bin, binary_label AS cls, count(*) AS n FROM clean GROUP BY ALL"
    for c in _EDGES) + ")", select="""
SELECT feature, floor(greatest(sum(part), 0) * 1e6 + 0.5e0) / 1e6 AS mi FROM (SELECT feature,
 n / sum(n) OVER f * ln(n * sum(n) OVER f / (sum(n) OVER b * CAST(sum(n) OVER c AS DOUBLE))) AS part FROM counts
 WINDOW f AS (PARTITION BY feature), b AS (PARTITION BY feature, bin), c AS (PARTITION BY feature, cls)) GROUP BY 1"""))
def mutual_information_binned(spark, sf):
    """The operator itself, with given edges instead of quantiles."""
    rows = prep.clean(unified(spark, sf))
    found = training.mutual_information(rows, tuple(_EDGES), "binary_label", edges=_EDGES)
    return found.withColumn("mi", half_up(F.col("mi"), 6))


# --- streaming --------------------------------------------------------------

def packet_parts(spark, sf, parts: int) -> list:
    """The packets in ``parts`` parts by arrival."""
    bounds = views.packets(spark, sf).agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).first()
    step = (bounds["hi"] - bounds["lo"]) // parts + 1
    starts = [bounds["lo"] + i * step for i in range(parts)]
    rows = views.packets(spark, sf).select(*PACKETS.names)
    return [rows.filter((F.col("seq") >= lo) & (F.col("seq") < lo + step)) for lo in starts]


def stream_parts(spark, live: LiveDetection, parts: list) -> str:
    """Puts one part after the other into a folder, in as many files as there are tasks, and
    runs the stream over what is new: each part is a batch, whatever its files."""
    source = new_table_path(spark, "stream")
    for part in parts:
        part.write.mode("append").parquet(source)
        finish(start_detection(read_packet_stream(spark, source), live, f"{live.state}/checkpoint", available_now=True))
    return source


def live_detection(spark, sf) -> LiveDetection:
    base = new_table_path(spark, "live")
    sensors = views.packets(spark, sf).select("sensor_id").distinct()
    listed = sensors.withColumn("ip", F.explode(F.array(*[F.lit(ip) for ip in o.STATIC_BLOCKED])))
    return LiveDetection(spark, f"{base}/logs", f"{base}/state", score_columns=stub_scores(), blocked=listed)


def streamed_logs_table(spark, sf, parts: int = 3):
    """The packets in ``parts`` parts by arrival, replayed as a stream."""
    live = live_detection(spark, sf)
    stream_parts(spark, live, packet_parts(spark, sf, parts))
    return current_logs(spark, live.logs)


@query("streamed_late_packets", o.chain(*o.REPLAY_LOGS, select="""
SELECT 'logged' AS what, count(*) AS n FROM logs UNION ALL SELECT 'rejected', count(*) FILTER (seq % 10 = 0) FROM packets
UNION ALL SELECT 'lost', 0 UNION ALL SELECT 'flow_packets', CAST(sum(flow_packet_count) AS BIGINT) FROM logs
UNION ALL SELECT 'flow_bytes', CAST(sum(flow_byte_count) AS BIGINT) FROM logs"""))
def streamed_late_packets(spark, sf):
    """Every tenth packet sent twice, the second time out of order: what was
    sent is logged or rejected, and flows count what is logged only."""
    again = views.packets(spark, sf).filter("seq % 10 = 0").select(*PACKETS.names)
    live = live_detection(spark, sf)
    source = stream_parts(spark, live, [*packet_parts(spark, sf, 2), again])
    sent = spark.read.schema(PACKETS).parquet(source).count()
    logs = stored_logs(spark, live.logs)
    rejected = spark.read.schema(PACKETS).parquet(f"{live.state}/rejects").count()
    done = logs.agg(F.count(F.lit(1)).alias("logged"), F.sum("flow_packet_count").alias("fp"), F.sum("flow_byte_count").alias("fb"))
    return done.select(F.stack(
        F.lit(5), F.lit("logged"), F.col("logged"), F.lit("rejected"), F.lit(rejected).cast("long"),
        F.lit("lost"), F.lit(sent).cast("long") - F.col("logged") - F.lit(rejected), F.lit("flow_packets"), F.col("fp"),
        F.lit("flow_bytes"), F.col("fb")).alias("what", "n"))


GAP_US = 3_600_000_000


@query("streamed_idle_flows", o.chain(o.EV, o.PACKETS, f"""gapped AS (SELECT * REPLACE (ts_us + CASE WHEN seq * 2 > top THEN {GAP_US} ELSE 0 END AS ts_us),
  seq * 2 > top AS late FROM packets, (SELECT max(seq) AS top FROM packets))""", """keyed AS (SELECT *, concat_ws('|', coalesce(source_ip, 'None'), coalesce(destination_ip, 'None'),
  CASE WHEN protocol_number <> 0 THEN CAST(protocol_number AS VARCHAR) ELSE protocol END) AS flow_key FROM gapped)""", select=f"""
SELECT seq AS id, row_number() OVER w AS flow_packet_count, CAST(sum(length) OVER w AS BIGINT) AS flow_byte_count,
 {o.r3("greatest(ts_us - first(ts_us) OVER w, 1) / 1e6")} AS flow_duration FROM keyed
WINDOW w AS (PARTITION BY sensor_id, session_id, flow_key, late ORDER BY seq ROWS UNBOUNDED PRECEDING)"""))
def streamed_idle_flows(spark, sf):
    """A pause of an hour in the middle: flows begin anew, and leave the state."""
    top = views.packets(spark, sf).agg(F.max("seq")).first()[0]
    late = F.col("seq") * 2 > top
    rows = views.packets(spark, sf).withColumn("ts_us", F.col("ts_us") + F.when(late, F.lit(GAP_US)).otherwise(0)).select(*PACKETS.names)
    live = live_detection(spark, sf)
    live.idle_timeout = 60.0
    live(rows.filter(~late), 0)
    live(rows.filter(late), 1)
    return current_logs(spark, live.logs).select("id", "flow_packet_count", "flow_byte_count", "flow_duration")


@query("streamed_again", o.chain(*o.REPLAY_LOGS, select=_LOG_SQL))
def streamed_again(spark, sf):
    """A batch that runs a second time leaves the log table as it was."""
    live = live_detection(spark, sf)
    rows = views.packets(spark, sf).select(*PACKETS.names)
    live(rows, 0)
    live(rows, 0)
    return with_micros(stored_logs(spark, live.logs).select(*current_logs(spark, live.logs).columns))


@query("streamed_logs", o.chain(*o.REPLAY_LOGS, select=_LOG_SQL))
def streamed_logs(spark, sf):
    return with_micros(streamed_logs_table(spark, sf))


@query("streamed_summary", o.chain(*o.REPLAY_LOGS, select=f"""
SELECT time_us // 5000000 * 5000000 AS window_us, count(*) AS packets, count(*) FILTER ({o.THREAT}) AS alerts,
 count(*) FILTER (encrypted_likely) AS encrypted, count(*) FILTER (action = 'blocked') AS blocked FROM logs GROUP BY 1"""))
def streamed_summary(spark, sf):
    """Window counts kept by a streaming query over the stored log table."""
    stored = new_table_path(spark, "summary-logs")
    append_logs(replayed(spark, sf).logs, stored, 1)
    out, check = new_table_path(spark, "summary"), new_table_path(spark, "summary-check")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/b={batch_id}")

    run = (live_summary(read_log_stream(spark, stored), "5 seconds").writeStream.outputMode("update")
           .foreachBatch(keep).option("checkpointLocation", check).trigger(availableNow=True).start())
    finish(run)
    last = spark.read.parquet(out).groupBy(F.unix_micros("window.start").alias("window_us")).agg(
        F.max_by(F.struct("packets", "alerts", "encrypted", "blocked"), "b").alias("v"))
    return last.select("window_us", "v.*")


@query("streamed_first_alerts", o.chain(*o.REPLAY_LOGS, select=f"""
SELECT DISTINCT lower(coalesce(source_ip, 'unknown')) || '|' || lower(label) AS alert_key
FROM (SELECT *, {o.SHOWN_LABEL} AS label FROM logs) WHERE label <> '-'"""))
def streamed_first_alerts(spark, sf):
    stored = new_table_path(spark, "alert-logs")
    append_logs(replayed(spark, sf).logs, stored, 1)
    out, check = new_table_path(spark, "alerts"), new_table_path(spark, "alerts-check")
    run = (notify_once(read_log_stream(spark, stored)).writeStream.format("parquet").option("path", out)
           .option("checkpointLocation", check).trigger(availableNow=True).start())
    finish(run)
    return spark.read.parquet(out).select("alert_key")


# --- sources and sinks ------------------------------------------------------

@query("captured_packets", o.chain(*o.BASE, select="""
SELECT sensor_id || '-' || seq // 2000 AS file, row_number() OVER (PARTITION BY sensor_id, seq // 2000 ORDER BY seq) - 1 AS n,
 ts_us, CASE WHEN ip THEN source_ip END AS source_ip, CASE WHEN ip THEN destination_ip END AS destination_ip,
 CASE WHEN ip THEN source_port END AS source_port, CASE WHEN ip THEN destination_port END AS destination_port,
 CASE WHEN ip THEN protocol ELSE 'ARP' END AS protocol, CASE WHEN ip THEN protocol_number ELSE 0 END AS protocol_number,
 CASE WHEN ip THEN ttl ELSE 0 END AS ttl, CASE WHEN ip AND protocol = 'TCP' THEN syn_flag ELSE 0 END AS syn_flag,
 CASE WHEN ip AND protocol = 'TCP' THEN psh_flag ELSE 0 END AS psh_flag, CASE WHEN ip THEN length + 34 ELSE 42 END AS length
FROM (SELECT *, source_ip IS NOT NULL AND protocol_number <> 0 AS ip FROM packets)"""))
def captured_packets(spark, sf):
    """The packets written to capture files and read back."""
    rows = read_captures(spark, files.write_captures(views.packets(spark, sf)), chunk_packets=500, chunk_bytes=64 << 10)
    name = F.regexp_extract("session_id", r"([^/]+)\.pcap$", 1)
    return rows.select(name.alias("file"), F.col("seq").alias("n"), "ts_us", "source_ip", "destination_ip", "source_port",
                       "destination_port", "protocol", "protocol_number", "ttl", "syn_flag", "psh_flag", "length")


@query("capped_captures", o.chain(*o.BASE, select="""
SELECT sensor_id || '-' || seq // 2000 AS file, least(count(*), 100) AS packets FROM packets GROUP BY 1"""))
def capped_captures(spark, sf):
    rows = read_captures(spark, files.write_captures(views.packets(spark, sf)), packet_limit=100)
    return rows.groupBy(F.regexp_extract("session_id", r"([^/]+)\.pcap$", 1).alias("file")).agg(
        F.count(F.lit(1)).alias("packets"))


@query("some_csv_flows", o.chain(o.FLOWS, select="""
SELECT ds, CASE ds WHEN 0 THEN count(*) FILTER (rid % 4 < 2) ELSE least(count(*), 100) END AS n FROM flows_raw WHERE ds IN (0, 3) GROUP BY 1"""))
def some_csv_flows(spark, sf):
    """The files of the first two parts of four by name, and any hundred rows of another folder."""
    flows, folder = views.flows_raw(spark, sf), new_table_path(spark, "cic-files")
    for k in range(4):  # a file from each task that has rows, so none grows with the table
        raw_cic(flows.filter(F.col("rid") % 4 == k)).write.csv(f"{folder}/part={k}", header=True)
    first = len(list_files(spark, f"{folder}/part=[01]/*.csv"))
    one = read_flows(spark, "cic", f"{folder}/*/*.csv", max_files=first)
    some = read_flows(spark, "iot", f"{files.write_csv(raw_iot(flows), 'iot')}/*.csv", limit_rows=100)
    return one.agg(F.lit(0).alias("ds"), F.count(F.lit(1)).alias("n")).unionByName(some.agg(F.lit(3).alias("ds"), F.count(F.lit(1)).alias("n")))


@query("cleared_logs", o.chain(*o.LOGS, select="SELECT id, severity FROM logs WHERE id % 2 = 0"))
def cleared_logs(spark, sf):
    """A log table filled, emptied, and filled again with every second row."""
    logs, path = preview_logs(spark, sf), new_table_path(spark, "cleared")
    append_logs(logs, path, 1)
    clear_logs(spark, path)
    append_logs(logs.filter("id % 2 = 0"), path, 2)
    return current_logs(spark, path).select("id", "severity")


@query("compacted_logs", o.chain(*o.LOGS, select="""
SELECT id, CASE WHEN id % 10 = 0 THEN 'review' ELSE action END AS action, severity FROM logs"""))
def compacted_logs(spark, sf):
    """Two versions of a tenth of the logs, compacted, read by date."""
    logs, path = preview_logs(spark, sf), new_table_path(spark, "to-compact")
    append_logs(logs, path, 1)
    append_logs(logs.filter(F.col("id") % 10 == 0).withColumn("action", F.lit("review")), path, 2)
    compact_logs(spark, path, f"{path}-compacted")
    days = logs.agg(F.to_date(F.min("timestamp")), F.to_date(F.max("timestamp"))).first()
    return current_logs(spark, f"{path}-compacted", *days).select("id", "action", "severity")


_RAW_IP = """CASE WHEN seq % 7 = 0 THEN '10.0.0.' || CAST(256 + seq % 9 AS STRING)
 WHEN seq % 3 = 1 THEN '2001:0DB8:0::' || CAST(1 + user_no % 40 AS STRING) ELSE destination_ip END"""


@query("block_commands", o.chain(*o.BASE, f"""said AS (SELECT seq, event_us, CAST(split_part(destination_ip, '.', 4) AS INT) AS user_no, destination_ip FROM packets),
valid AS (SELECT seq, CASE WHEN seq % 3 = 1 THEN '2001:db8::' || CAST(1 + user_no % 40 AS VARCHAR) ELSE destination_ip END AS ip,
  CASE WHEN seq % 5 = 0 THEN 'unblock' ELSE 'block' END AS op FROM said WHERE seq % 7 <> 0)""", select="""
SELECT ip, reason FROM (SELECT ip, arg_max(op, seq) AS op, 'packet ' || CAST(max(seq) AS VARCHAR) AS reason FROM valid GROUP BY ip) WHERE op = 'block'
UNION ALL SELECT NULL, CAST(count(*) AS VARCHAR) || ' refused' FROM said WHERE seq % 7 = 0"""))
def block_commands(spark, sf):
    """Every packet gives a command; texts are normalised, wrong addresses refused."""
    given = views.packets(spark, sf).withColumn("user_no", F.split_part("destination_ip", F.lit("."), F.lit(4)).cast("int")).select(
        F.expr(_RAW_IP).alias("ip"), F.expr("IF(seq % 5 = 0, 'unblock', 'block')").alias("op"),
        F.concat(F.lit("packet "), F.col("seq").cast("string")).alias("reason"), F.timestamp_micros("seq").alias("at"))
    changes, refused = response.change_log(given)
    count = refused.agg(F.lit(None).cast("string").alias("ip"), F.concat(F.count("*").cast("string"), F.lit(" refused")).alias("reason"))
    return response.blocklist(changes).select("ip", "reason").unionByName(count)


@query("csv_flows", o.chain(*o.UNIFIED, select="FROM unified"))
def csv_flows(spark, sf):
    """All datasets written as CSV and read back by name."""
    flows = views.flows_raw(spark, sf)
    given = (("cic", raw_cic(flows), ds.map_cic), ("netflow", raw_netflow(flows, 1), ds.map_netflow),
             ("netflow", raw_netflow(flows, 2), ds.map_netflow), ("iot", raw_iot(flows), ds.map_iot))
    mapped = []
    for kind, raw, mapping in given:
        path = files.write_csv(raw, kind, kind == "cic")
        mapped.append(mapping(read_flows(spark, kind, f"{path}/*.csv")))
    return ds.unify(*mapped)


@query("stored_unified", o.chain(*o.UNIFIED, select="""
SELECT binary_label, attack_type, count(*) AS n, CAST(sum(total_bytes) AS BIGINT) AS bytes FROM unified GROUP BY ALL"""))
def stored_unified(spark, sf):
    path = new_table_path(spark, "unified")
    write_unified(unified(spark, sf), path)
    return spark.read.parquet(path).groupBy("binary_label", "attack_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_bytes").cast("long").alias("bytes"))


@query("upserted_logs", o.chain(*o.LOGS, select="""
SELECT id, CASE WHEN id % 10 = 0 THEN 'review' ELSE action END AS action, severity, flow_id, length FROM logs"""))
def upserted_logs(spark, sf):
    """Every log stored, then a tenth of them stored again with another action."""
    logs, path = preview_logs(spark, sf), new_table_path(spark, "upserted")
    append_logs(logs, path, 1)
    append_logs(logs.filter(F.col("id") % 10 == 0).withColumn("action", F.lit("review")), path, 2)
    return current_logs(spark, path).select("id", "action", "severity", "flow_id", "length")


@query("migrated_logs", o.chain(*o.LOGS, select="""
SELECT id, CASE WHEN id % 2 = 0 THEN 'LEGACY' ELSE flow_id END AS flow_id, CASE WHEN id % 2 = 0 THEN 'info' ELSE severity END AS severity,
 CASE WHEN id % 2 = 0 THEN 'Metadata baseline' ELSE signature END AS signature,
 CASE WHEN id % 2 = 0 THEN 'META-0000' ELSE rule_id END AS rule_id, CASE WHEN id % 2 = 1 THEN response_note END AS response_note FROM logs"""))
def migrated_logs(spark, sf):
    """Half of the logs stored before the later columns existed."""
    logs, path = preview_logs(spark, sf), new_table_path(spark, "migrated")
    even = F.col("id") % 2 == 0
    logs.filter(even).drop("flow_id", "severity", "signature", "rule_id", "response_note").write.parquet(f"{path}/old")
    logs.filter(~even).write.parquet(f"{path}/new")
    return load_logs(spark, f"{path}/old", f"{path}/new").select(
        "id", "flow_id", "severity", "signature", "rule_id", "response_note")


@query("exported_logs", o.chain(*o.LOGS, select="""
SELECT CAST(id AS VARCHAR) AS id, source_ip, severity, action, reason FROM logs ORDER BY logs.id DESC LIMIT 5000"""))
def exported_logs(spark, sf):
    path = new_table_path(spark, "export")
    export_logs(preview_logs(spark, sf), path, 5000)
    return spark.read.csv(path, header=True).select("id", "source_ip", "severity", "action", "reason")


# --- models -----------------------------------------------------------------

# Rounds, depth and bins for the check only. The settings of the library (BINARY, MULTICLASS, ATTACK) are a
# matter of hours here: see the README for what was measured.
QUICK = training.TreeSettings(rounds=2, depth=3, rate=0.3, subsample=1.0, column_share=1.0, bins=16)
FOLDS = 3


def featured(spark, sf):
    rows = prep.derive_features(prep.clean(unified(spark, sf)))
    return write_table(prep.select_features(prep.group_attacks(rows), "binary_label", "attack_type"), "featured")


def featured_attacks(spark, sf):
    rows = prep.derive_features(attacks(spark, sf))
    return write_table(prep.select_features(rows, "attack_type"), "featured-attacks")


FIT_ROWS = 2000  # of each class, that the many-class models are fitted on


@query("trained_two_stage", o.chain(*o.FEATURES, select="""
SELECT CASE WHEN gate IS NULL THEN 'scored' ELSE gate END AS what, count(*) AS packets, true AS holds FROM gated GROUP BY 1
UNION ALL SELECT 'as before saving', 0, true"""))
def trained_two_stage(spark, sf):
    """Both models trained, the second on ten classes and at most FIT_ROWS of each;
    saved, loaded, and run on every due packet. The loaded ones must say what
    the trained ones say, and only due packets have a model's word."""
    rows = featured(spark, sf)
    binary = training.train_binary(rows, settings=QUICK)
    kinds = featured_attacks(spark, sf)
    attack = training.train_attack(prep.cap_classes(kinds, "attack_type", FIT_ROWS), settings=QUICK)
    path = new_table_path(spark, "models")
    save_models(spark, ModelBundle(binary, attack), path)
    loaded = load_models(spark, path)
    before = [write_table(attack.predict(kinds, "a"), "predicted"), write_table(binary.predict(rows, "a"), "predicted")]
    both = [loaded.attack.predict(before[0], "b"), loaded.binary.predict(before[1], "b")]
    differ = [df.filter("NOT (a <=> b)").isEmpty() for df in both]
    done = decide_packets(views.packets(spark, sf), scorer=scoring.ModelScorer(loaded))
    gates_only = F.col("reason").isin("ip_fragment_skipped", "trusted_port_bypass", "flow_warmup", "flow_interval_skip")
    counted = done.groupBy(F.when(gates_only, F.col("reason")).otherwise("scored").alias("what")).agg(
        F.count(F.lit(1)).alias("packets"), F.bool_and(gates_only == F.col("ml_confidence").isNull()).alias("holds"))
    return counted.unionByName(spark.createDataFrame([("as before saving", 0, all(differ))], "what string, packets long, holds boolean"))


def _at_least_majority(cm: DataFrame) -> DataFrame:
    """Rows and hits by actual class, and whether the model beats the largest class."""
    by_class = cm.groupBy("actual").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    holds = by_class.agg((F.sum("hit") >= F.max("n")).alias("holds")).first()["holds"]
    return by_class.select(F.col("actual").alias("label"), "n", F.lit(holds).alias("holds"))


@query("evaluated_binary", o.chain(*o.CLEAN, select="""
SELECT binary_label AS label, CAST(floor(count(*) * 0.2e0 + 0.5e0) AS BIGINT) AS n, true AS holds FROM clean GROUP BY 1"""))
def evaluated_binary(spark, sf):
    """Train on four fifths; on the rest, right at least as often as the
    largest class would be."""
    train, test = prep.stratified_split(featured(spark, sf), "binary_label")
    model = training.train_binary(train, settings=QUICK)
    scored = model.predict(test).withColumn("predicted_label", scoring.decode_label("predicted", model.classes))
    return _at_least_majority(write_table(training.confusion(scored, "binary_label", "predicted_label"), "confusion"))


@query("calibrated_multiclass", o.chain(*o.CLEAN, *o.ATTACKS, select="""
SELECT attack_type AS label, count(*) AS n, true AS holds FROM attacks GROUP BY 1"""))
def calibrated_multiclass(spark, sf):
    """Ten classes with balanced weights and out-of-fold isotonic curves, fitted on
    at most FIT_ROWS of each and applied to all rows: rows by class, and whether all probabilities are shares that add up to 1."""
    rows = featured_attacks(spark, sf)
    fitted = write_table(prep.cap_classes(rows, "attack_type", FIT_ROWS), "fit-rows")
    model = training.calibrate(fitted, "attack_type", lambda part: training.train_multiclass(part, "attack_type", QUICK), FOLDS)
    total = F.aggregate("prob", F.lit(0.0), lambda a, p: a + p)
    sound = (F.abs(total - 1) < 1e-9) & F.forall("prob", lambda p: (p >= 0) & (p <= 1 + 1e-9)) & (F.size("prob") == len(model.classes))
    return model.probabilities(rows).groupBy(F.col("attack_type").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(sound).alias("holds"))
