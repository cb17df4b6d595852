import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from flowloom.operators import dashboard as dash, logqueries as lq
from flowloom.schemas import LOGS
from flowloom.sources import flows as flow_source, logstore


def log(i, **given):
    row = {"sensor_id": "a", "session_id": "s", "id": i, "timestamp": dt.datetime(2024, 1, 1, 0, 0, i % 60),
           "source_ip": "10.0.0.1", "destination_ip": "10.0.0.2", "source_port": 1, "destination_port": 80,
           "protocol": "TCP", "flow_id": "F", "flow_packet_count": i, "flow_byte_count": i, "flow_duration": 1.0,
           "length": 60, "time_diff": 0.0, "packet_rate": 1.0, "avg_length": 60.0, "encrypted_likely": False,
           "prediction": "Normal", "ml_confidence": None, "binary_label": None, "attack_label": None,
           "severity": "info", "signature": "Metadata baseline", "rule_id": "META-0000", "action": "allow",
           "reason": "metadata_baseline", "response_note": None}
    return {**row, **given}


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[f] for f in LOGS.names) for r in rows], LOGS)


def test_upsert_and_clear(spark, folder):
    path = f"{folder}/logs"
    logstore.append_logs(frame(spark, [log(1), log(2)]), path, 1)
    logstore.append_logs(frame(spark, [log(2, action="alert"), log(3)]), path, 2)
    rows = {r.id: r.action for r in logstore.current_logs(spark, path).collect()}
    assert rows == {1: "allow", 2: "alert", 3: "allow"}
    logstore.clear_logs(spark, path)
    assert logstore.current_logs(spark, path).count() == 0
    logstore.append_logs(frame(spark, [log(9)]), path)
    assert [r.id for r in logstore.current_logs(spark, path).collect()] == [9]


def test_older_logs_get_defaults(spark, folder):
    old, new = f"{folder}/old", f"{folder}/new"
    late = ["flow_id", "flow_packet_count", "severity", "signature", "rule_id", "response_note", "attack_label"]
    frame(spark, [log(1, prediction="DDoS")]).drop(*late).write.parquet(old)
    frame(spark, [log(2, prediction="Benign", severity="low")]).write.parquet(new)
    rows = {r.id: r for r in logstore.load_logs(spark, old, new).collect()}
    assert (rows[1].flow_id, rows[1].flow_packet_count, rows[1].severity, rows[1].rule_id) == ("LEGACY", 0, "info", "META-0000")
    assert rows[2].severity == "low" and rows[2].flow_id == "F"
    derived = logstore.load_logs(spark, old, new, defaults="runtime").filter("id = 1").first()
    assert (derived.severity, derived.signature, derived.rule_id) == ("critical", "DDoS", "LEGACY-0000")
    with pytest.raises(ValueError):
        logstore.load_logs(spark, old, defaults="none")


def test_export(spark, folder):
    logs = frame(spark, [log(i) for i in range(1, 31)])
    logstore.export_logs(logs, f"{folder}/few", 10)
    assert [int(r.id) for r in spark.read.csv(f"{folder}/few", header=True).collect()] == list(range(21, 31))
    logstore.export_logs(logs, f"{folder}/all", None)
    assert spark.read.csv(f"{folder}/all", header=True).count() == 30


def test_limits_and_blank_labels(spark):
    logs = frame(spark, [log(i, attack_label="", prediction="Unknown", severity="low") for i in range(1, 8)])
    assert [r.id for r in lq.recent_logs(logs, 3).collect()] == [5, 6, 7]
    with pytest.raises(ValueError):
        lq.recent_logs(logs, -4)
    assert lq.recent_logs(logs, 1).first().reason == "model_uncertain_attack"
    assert lq.summary(logs).first().alerts == 7  # a blank label is a label there
    assert lq.summary(logs.limit(0)).first().packets == 0


def test_time_buckets_on_ties_and_outside(spark):
    now = dt.datetime(2024, 1, 1, 12, 0, 30, tzinfo=dt.timezone.utc)
    at = dt.datetime(2024, 1, 1, 12, 0)
    times = [at, at - dt.timedelta(seconds=150), at - dt.timedelta(seconds=149), at + dt.timedelta(hours=1), at - dt.timedelta(days=1)]
    logs = frame(spark, [log(i, timestamp=t, severity="high", action="alert") for i, t in enumerate(times)])
    got = {r.bucket: r.threat for r in dash.traffic_buckets(logs, now).collect() if r.threat}
    assert got == {11: 3, 10: 1, 0: 1}


def test_top_lists_break_ties_by_latest(spark):
    logs = frame(spark, [log(1, source_ip="x", destination_port=None), log(2, source_ip="y", destination_port=0),
                         log(3, source_ip="x", destination_port=22), log(4, source_ip="y", destination_port=9),
                         log(5, source_ip="z", destination_port=9)])
    assert [r.entity for r in dash.top_entities(logs).collect()] == ["y", "x", "z"]
    assert [(r.port, r["count"]) for r in dash.top_ports(logs).collect()] == [("9", 2), ("Other", 2), ("22", 1)]


def test_search_is_literal(spark):
    logs = frame(spark, [log(1, prediction="100%_A"), log(2, prediction="100xxA")])
    assert [r.id for r in dash.search_logs(logs, "0%_a").collect()] == [1]
    assert dash.search_logs(logs, "", "info", "allow").count() == 2


def test_alert_queue_groups_null_ends(spark):
    rows = [log(i, source_ip=None, severity="high", action="alert", signature="S") for i in (1, 2)]
    got = dash.alert_queue(frame(spark, rows + [log(3)])).collect()
    assert [(r.signature, r["count"], r.newest_id, r.source) for r in got] == [("S", 2, 2, "-")]


def test_first_alerts_with_memory(spark):
    logs = frame(spark, [log(i, severity="high", action="alert", prediction="DoS", source_ip=ip)
                         for i, ip in enumerate(["A", "a", "B", None])])
    assert sorted(r.alert_key for r in dash.first_alerts(logs).collect()) == ["a|dos", "b|dos", "unknown|dos"]
    seen = spark.createDataFrame([("a|dos",)], "alert_key string")
    assert sorted(r.id for r in dash.first_alerts(logs, seen).collect()) == [2, 3]


CIC = ("Destination Port, Flow Duration,Total Fwd Packets,Total Backward Packets,Total Length of Fwd Packets,"
       "Total Length of Bwd Packets,Min Packet Length,Max Packet Length,Packet Length Mean,Packet Length Std,"
       "Flow Packets/s,Flow IAT Mean,SYN Flag Count,ACK Flag Count,RST Flag Count,PSH Flag Count, Label")


def test_reads_csv_by_name(spark, folder):
    names = [c for c in CIC.split(",")]
    values = ["80", "3", "1", "2", "10", "20", "1", "9", "4.5", "2", "Infinity", "7", "1", "0", "0", "1", "DDoS"]
    with open(f"{folder}/1.csv", "w") as f:
        f.write(CIC + "\n" + ",".join(values) + "\n")
    with open(f"{folder}/2.csv", "w") as f:  # same columns, other order
        f.write(",".join(names[::-1]) + "\n" + ",".join(values[::-1]) + "\nBENIGN" + ",1" * 16 + "\n")
    rows = flow_source.read_flows(spark, "cic", f"{folder}/*.csv")
    got = rows.orderBy(F.desc("label")).collect()
    assert len(got) == 3 and got[0]["destination port"] == got[1]["destination port"] == 80
    assert got[0]["flow packets/s"] == float("inf") and got[0]["label"] == "DDoS"
    assert flow_source.read_flows(spark, "cic", f"{folder}/*.csv", max_files=1).count() == 1
    assert flow_source.read_flows(spark, "cic", f"{folder}/*.csv", limit_rows=2).count() == 2
    with pytest.raises(ValueError, match="lack columns"):
        flow_source.read_flows(spark, "iot", f"{folder}/*.csv")


def test_write_unified(spark, folder):
    df = spark.range(3).withColumn("x", F.lit("a"))
    flow_source.write_unified(df, f"{folder}/u.csv", "csv")
    assert spark.read.csv(f"{folder}/u.csv", header=True).columns == ["id", "x"]
    flow_source.write_unified(df, f"{folder}/u")
    assert spark.read.parquet(f"{folder}/u").count() == 3
    with pytest.raises(ValueError):
        flow_source.write_unified(df, f"{folder}/v", "orc")


def test_headers_of_many_files_take_one_job(spark, folder):
    """Files with two orders of columns, one of them large enough to be split."""
    import os

    from flowloom.schemas import RAW_FLOWS
    from flowloom.sources.flows import headers, read_flows
    names = RAW_FLOWS["iot"].names
    os.makedirs(f"{folder}/iot")
    for i in range(50):
        order = names if i % 3 else names[::-1]
        with open(f"{folder}/iot/{i:02}.csv", "w") as out:
            out.write(",".join(order) + "\n" + (",".join("1" for _ in order) + "\n") * (5000 if i == 7 else 2))
    paths = [f"file:{folder}/iot/{i:02}.csv" for i in range(50)]
    group = "headers-of-many"
    spark.sparkContext.setJobGroup(group, "count")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        found = headers(spark, paths)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(found) == 50 and jobs <= 2  # listing the files may be a job of its own
    rows = read_flows(spark, "iot", f"{folder}/iot/*.csv")
    assert rows.count() == 49 * 2 + 5000


def test_draw_keeps_to_a_key_order(spark):
    from flowloom.operators import prep
    rows = spark.range(3000).selectExpr("IF(id % 3 = 0, 'a', 'b') AS k", "id AS v")
    key = F.col("v") * 7 % 101 * F.lit((1 << 62) // 101)
    train, test = prep.stratified_split(rows, "k", 0.1, key=key)
    want = {c: sorted((v for v in range(3000) if (v % 3 == 0) == (c == "a")), key=lambda v: (v * 7 % 101, v)) for c in "ab"}
    got = {c: sorted(r.v for r in test.collect() if r.k == c) for c in "ab"}
    assert got == {c: sorted(want[c][:round(len(want[c]) * 0.1)]) for c in "ab"}
    assert train.count() + test.count() == 3000 and train.intersect(test).isEmpty()


def test_csv_files_of_a_part_follow_the_splits_of_the_input(spark, folder):
    """More input is more files, not larger ones; all of the first two parts are read."""
    import glob
    from flowloom.runtime import shared_dir
    from workload.queries import QUERIES
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    lines.repartition(4).write.parquet(f"{folder}/lineitem.parquet")
    before = set(glob.glob(f"{shared_dir(spark)}/cic-files-*"))
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4MB")
    try:
        got = {r.ds: r.n for r in QUERIES["some_csv_flows"](spark, folder).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)
    (made,) = set(glob.glob(f"{shared_dir(spark)}/cic-files-*")) - before
    assert all(len(glob.glob(f"{made}/part={k}/*.csv")) > 1 for k in range(4))
    assert got == {0: lines.filter("l_suppkey % 4 = 0 AND (l_orderkey * 10 + l_linenumber) % 4 < 2").count(), 3: 100}
