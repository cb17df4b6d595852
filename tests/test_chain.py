import random

import pytest
from pyspark.sql import functions as F

from flowloom.config import Config
from flowloom.operators import features as feat, scoring
from flowloom.functions import labels as lab, network as net
from flowloom.plans.detect import decide_packets, detect
from flowloom.schemas import PACKETS
from tests import walk

def packets(seed, n=600, hot=0.0):
    rng, ts, out = random.Random(seed), 1_700_000_000_000_000, []
    for i in range(n):
        ts += rng.choice([0, 1000, 50_000, -20_000, 200_000])
        busy = rng.random() < hot
        proto = "TCP" if busy else rng.choice(["TCP", "UDP", "ICMP", "ARP"])
        ported = proto in ("TCP", "UDP")
        out.append({
            "sensor_id": "a" if busy else rng.choice("ab"), "session_id": "s", "seq": i, "ts_us": ts,
            "source_ip": "10.0.0.1" if busy else rng.choice(["10.0.0.1", "10.0.0.2", None]),
            "destination_ip": "10.0.0.9" if busy else rng.choice(["10.0.0.1", "10.0.0.9"]),
            "source_port": rng.randrange(1024, 1100) if ported else None,
            "destination_port": rng.choice([80, 22, 0]) if ported else None,
            "protocol": proto, "protocol_number": {"TCP": 6, "UDP": 17, "ICMP": 1, "ARP": 0}[proto], "ttl": 64,
            "syn_flag": 1, "ack_flag": 0, "rst_flag": 0, "psh_flag": 1, "length": rng.randrange(40, 1500)})
    return out


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[f] for f in PACKETS.names) for r in rows], PACKETS)


@pytest.mark.parametrize("skew,slice_rows", [("whole", 10_000), ("sliced", 37)])
def test_features_equal_walk(spark, skew, slice_rows):
    rows = packets(1, hot=0.6)
    want = {r["seq"]: r for r in walk.features(rows)}
    got = feat.packet_features(frame(spark, rows), Config(slice_rows=slice_rows), skew).collect()
    assert len(got) == len(rows)
    for r in got:
        for name, value in want[r.seq].items():
            near = value if isinstance(value, str) else pytest.approx(value, rel=1e-9, abs=1e-9)
            assert r[name] == near, (r.seq, name)


def test_auto_mode_measures(spark):
    df = frame(spark, packets(2, 200))
    assert feat.slice_size(df, Config(slice_rows=50), "auto") == 50
    assert feat.slice_size(df, Config(), "auto") is None
    with pytest.raises(ValueError):
        feat.slice_size(df, Config(), "other")


def scores():
    return {
        "det_prediction": F.expr("CASE WHEN seq % 3 = 0 THEN 'Benign' WHEN seq % 11 = 0 THEN 'Suspicious' ELSE 'DoS' END"),
        "det_confidence": F.expr("CAST(50 + seq % 50 AS DOUBLE)"), "det_binary_label": F.lit("MALICIOUS"),
        "det_attack_label": F.expr("CASE WHEN seq % 3 <> 0 THEN CASE WHEN seq % 13 = 0 THEN 'Other' ELSE 'DoS' END END")}


@pytest.mark.parametrize("skew,slice_rows", [("whole", 10_000), ("sliced", 41)])
def test_decisions_equal_walk(spark, skew, slice_rows):
    rows = packets(3, hot=0.5)
    cfg = Config(min_flow_packets=4, min_flow_duration=0.5, classify_interval=2, slice_rows=slice_rows)
    known = {r["seq"]: r for r in rows}
    scored = []
    for f in walk.features(rows):
        i = f["seq"]
        benign = i % 3 == 0
        scored.append({**known[i], **f,
                       "det_prediction": "Benign" if benign else "Suspicious" if i % 11 == 0 else "DoS",
                       "det_attack_label": None if benign else "Other" if i % 13 == 0 else "DoS",
                       "det_confidence": 50.0 + i % 50})
    want = walk.decide(scored, cfg)
    got = decide_packets(frame(spark, rows), cfg, score_columns=scores(), skew=skew)
    assert sorted((r.seq, r.prediction, r.reason) for r in got.collect()) == sorted(want)
    assert {w[2] for w in want} >= {"model_prediction", "model_low_confidence", "model_uncertain_attack"}


def one_flow(n, gap_us, port=80):
    return [{"sensor_id": "a", "session_id": "s", "seq": i, "ts_us": i * gap_us, "source_ip": "10.0.0.1",
             "destination_ip": "10.0.0.2", "source_port": 5000, "destination_port": port, "protocol": "TCP",
             "protocol_number": 6, "ttl": 64, "syn_flag": 1, "ack_flag": 0, "rst_flag": 0, "psh_flag": 0,
             "length": 100} for i in range(n)]


def test_only_every_fifth_mature_packet_is_due(spark):
    rows = decide_packets(frame(spark, one_flow(21, 300_000))).collect()
    reasons = {r.total_packets: r.reason for r in rows}
    assert reasons[10] == "flow_warmup" and reasons[14] == "flow_interval_skip"
    assert reasons[15] == reasons[20] == "metadata_baseline" and reasons[16] == "flow_interval_skip"


def test_duration_gate_is_exact(spark):
    short = decide_packets(frame(spark, one_flow(15, 214_285))).filter("total_packets = 15").first()
    assert short.duration_us == 2_999_990 and short.reason == "flow_warmup"
    rows = one_flow(15, 200_000)
    rows[-1]["ts_us"] = 3_000_000
    assert decide_packets(frame(spark, rows)).filter("total_packets = 15").first().reason == "metadata_baseline"


def test_rate_rule_and_ports(spark):
    fast = decide_packets(frame(spark, one_flow(15, 300_000)), Config(high_packet_rate=3.0)).filter("total_packets = 15").first()
    assert (fast.reason, fast.prediction, fast.severity, fast.rule_id) == (
        "high_packet_rate", "Suspicious", "critical", "META-1001")
    tls = decide_packets(frame(spark, one_flow(15, 300_000, 443))).filter("total_packets = 15").first()
    assert tls.reason == "encrypted_metadata_only"
    p2p = decide_packets(frame(spark, one_flow(3, 1, 6885))).first()
    assert p2p.reason == "trusted_port_bypass"


def test_severity_rungs(spark):
    cases = [("Benign", 99.0, "info"), ("suspicious", 99.0, "info"), ("Other", 50.0, "low"), ("DDoS", 84.99, "info"),
             ("DDoS", 85.0, "medium"), ("DDoS", 89.99, "medium"), ("DDoS", 90.0, "critical"), ("BruteForce", 95.0, "high"),
             ("WebAttack", 95.0, "medium"), ("Web Attack XSS", 95.0, "high"), ("Recon", 95.0, "medium"),
             (" DoS\t", None, "critical"), ("MITM", None, "medium")]
    df = spark.createDataFrame(cases, "label string, conf double, want string")
    assert all(r.want == r.got for r in df.withColumn("got", lab.model_severity("label", "conf")).collect())


def test_two_stage_thresholds(spark):
    cases = [("MALICIOUS", 64.99, 90.0, "DoS", 99.0, "Benign", 90.0), ("MALICIOUS", 65.0, 65.0, "DoS", 84.99, "Suspicious", 84.99),
             ("MALICIOUS", 65.0, 65.0, "DoS", 85.0, "DoS", 85.0), ("BENIGN", 99.0, 99.0, "DoS", 99.0, "Benign", 99.0)]
    df = spark.createDataFrame(cases, "b string, mal double, c1 double, a string, c2 double, want string, conf double")
    cols = scoring.two_stage_columns(*[F.col(c) for c in ("b", "mal", "c1", "a", "c2")])
    for r in df.withColumns(cols).collect():
        assert (r.det_prediction, r.det_confidence) == (r.want, r.conf)
        assert (r.det_attack_label is None) == (r.want == "Benign")


def test_contract_check(spark):
    df = spark.range(1).withColumn("ttl", F.lit(1))
    with pytest.raises(ValueError, match="ack_flag, avg_packet_size"):
        scoring.check_contract(df)
    assert scoring.malicious_index(["BENIGN", "MALICIOUS"]) == 1
    assert scoring.malicious_index(["0", "1"]) == 1
    assert scoring.malicious_index(["DDoS", "normal"]) == 0


def test_low_threshold_keeps_suspicious_as_warning(spark):
    """Below the stage-2 threshold a label is always shown as uncertain."""
    cfg = Config(min_flow_packets=1, min_flow_duration=0.0, classify_interval=1)
    cols = scoring.two_stage_columns(F.lit("MALICIOUS"), F.lit(99.0), F.lit(99.0), F.lit("DDoS"), F.lit(70.0), cfg)
    row = decide_packets(frame(spark, one_flow(1, 1)), cfg, score_columns=cols).first()
    assert (row.prediction, row.reason, row.severity) == ("DDoS", "model_uncertain_attack", "low")


def test_scorer_without_its_features_falls_back(spark):
    class Needy:
        def accepts(self, columns):
            return "absent" in columns
    row = decide_packets(frame(spark, one_flow(15, 300_000)), scorer=Needy()).filter("total_packets = 15").first()
    assert row.reason == "metadata_baseline"


def test_two_shuffles_only(spark):
    """Features, gates and metadata verdicts need one shuffle per scope."""
    df = decide_packets(frame(spark, packets(4, 50)), skew="whole", score_columns=scores())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_log_row(spark):
    done = detect(frame(spark, one_flow(3, 1234)), skew="whole")
    row = done.logs.orderBy("id").collect()[2]
    assert row.flow_packet_count == 3 and row.flow_duration == 0.002 and row.time_diff == 0.001234
    assert row.action == "allow" and len(done.logs.columns) == 28


def test_address_and_endpoint(spark):
    cases = [("10.0.0.1", "10.0.0.1"), ("010.0.0.1", None), ("1.2.3", None), ("2001:DB8:0::1", "2001:db8::1"), (":::", None), (None, None)]
    df = spark.createDataFrame(cases, "ip string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", net.normalise_ip("ip")).collect())
    ends = spark.createDataFrame([("a", 1, "a:1"), ("a", 0, "a"), ("a", None, "a"), (None, 5, "-"), ("", 5, "-")], "ip string, port int, want string")
    assert all(r.got == r.want for r in ends.withColumn("got", net.endpoint("ip", "port")).collect())


def test_only_large_keys_are_cut(spark):
    """Small keys stay whole, and what is carried is a few rows for each slice."""
    from flowloom.operators.history import with_history
    big = spark.range(2000).selectExpr("'big' AS k", "id * 3 AS seq", "CAST(id AS INT) AS v")
    small = spark.range(1000).selectExpr("'k' || id % 100 AS k", "id AS seq", "CAST(id AS INT) AS v")
    rows = with_history(big.unionByName(small), ["k"], "seq", 5, 100, keep=["v"]).collect()
    carried = [r for r in rows if r._carried]
    assert len(rows) - len(carried) == 3000 and {r.k for r in carried} == {"big"} and len(carried) == 5 * 19
    assert {r._slice for r in rows if r.k != "big"} == {0} and {r._slice for r in rows if r.k == "big"} == set(range(20))
