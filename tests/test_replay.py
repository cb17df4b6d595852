import random

import pytest

from flowloom.config import Config, DEFAULT
from flowloom.operators import response
from tests import walk

ROW = ("sensor_id string, seq bigint, source_ip string, destination_ip string, prediction string, "
       "attack_label string, severity string, reason string")
LABELS = ["DDoS", "DoS", "Recon", "PortScan", "BruteForce", "Botnet", "Recon", "Recon"]


def trace(rng, sensor, n, ips):
    rows = []
    for i in range(n):
        label = rng.choice(LABELS)
        quiet, vague = rng.random() < 0.4, rng.random() < 0.1
        src = None if rng.random() < 0.05 else f"10.0.0.{rng.randrange(ips)}"
        rows.append({
            "sensor_id": sensor, "seq": i, "source_ip": src, "destination_ip": f"10.0.0.{rng.randrange(ips)}",
            "prediction": "Benign" if quiet else label, "attack_label": None if quiet or rng.random() < 0.2 else label,
            "severity": "info" if quiet or rng.random() < 0.1 else "high",
            "reason": "model_uncertain_attack" if vague else "model_prediction"})
    return rows


def check(spark, rows, blocked=(), warnings=None, commands=(), cfg=DEFAULT):
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in ROW.split(", ")) for r in rows], ROW)
    listed = spark.createDataFrame(list(blocked), "sensor_id string, ip string") if blocked else None
    counts = spark.createDataFrame([(*k, v) for k, v in warnings.items()], "sensor_id string, ip string, count int") \
        if warnings else None
    orders = spark.createDataFrame([(c["sensor_id"], c["ip"], c["op"], c["at_seq"]) for c in commands],
                                   "sensor_id string, ip string, op string, at_seq bigint") if commands else None
    replay = response.replay_response(df, listed, counts, orders, cfg=cfg)
    want, listed_after, warned_after = [], set(blocked), dict(warnings or {})
    for sensor in sorted({r["sensor_id"] for r in rows}):
        got, lst, wrn = walk.respond(
            [r for r in rows if r["sensor_id"] == sensor], [b for b in blocked if b[0] == sensor],
            {k: v for k, v in (warnings or {}).items() if k[0] == sensor},
            [c for c in commands if c["sensor_id"] == sensor])
        want += [(sensor, *g) for g in got]
        listed_after = {b for b in listed_after if b[0] != sensor} | lst
        warned_after = {k: v for k, v in warned_after.items() if k[0] != sensor} | wrn
    have = [(r.sensor_id, r.seq, r.action, r.response_note) for r in replay.rows.collect()]
    assert sorted(have, key=str) == sorted(want, key=str)
    end = response.final_blocklist(replay, listed).collect()
    assert {(r.sensor_id, r.ip) for r in end} == listed_after
    left = response.final_warnings(replay, counts).collect()
    open_counts = {(r.sensor_id, r.ip): r["count"] for r in left if (r.sensor_id, r.ip) not in listed_after}
    assert open_counts == {k: v for k, v in warned_after.items() if k not in listed_after}
    return replay


@pytest.mark.parametrize("seed", range(4))
def test_replay_equals_walk(spark, seed):
    rng = random.Random(seed)
    rows = trace(rng, "a", 150, 12) + trace(rng, "b", 80, 5)
    blocked = [("a", "10.0.0.3")] if seed % 2 else []
    warnings = {("a", "10.0.0.1"): 2, ("b", "10.0.0.2"): 1, ("b", "10.0.0.99"): 1} if seed > 1 else None
    check(spark, rows, blocked, warnings)


@pytest.mark.parametrize("seed,slice_rows", [(0, 1000), (1, 1000), (2, 7)])
def test_replay_with_commands_equals_walk(spark, seed, slice_rows):
    rng = random.Random(100 + seed)
    rows = trace(rng, "a", 160, 8) + trace(rng, "b", 60, 6)
    commands = [{"sensor_id": rng.choice("ab"), "ip": f"10.0.0.{rng.randrange(8)}",
                 "op": rng.choice(["block", "unblock", "unblock"]), "at_seq": at}
                for at in rng.sample(range(150), 12)]
    check(spark, rows, [("a", "10.0.0.2"), ("b", "10.0.0.1")], {("a", "10.0.0.4"): 2}, commands, Config(slice_rows=slice_rows))


def test_third_scan_blocks_and_hot_source(spark):
    rows = [{"sensor_id": "a", "seq": i, "source_ip": "10.0.0.1", "destination_ip": f"10.0.1.{i % 50}",
             "prediction": "Recon", "attack_label": "Recon", "severity": "medium", "reason": "model_prediction"}
            for i in range(200)]
    replay = check(spark, rows)
    notes = [r.response_note for r in replay.rows.orderBy("seq").limit(4).collect()]
    assert notes[:2] == ["Recon warning 1/3", "Recon warning 2/3"]
    assert notes[2] == "Auto-blocked after 3 reconnaissance warnings" and notes[3] == "Matched existing blocklist rule"


def test_rejects_sources_that_are_no_address(spark):
    rows = [("a", 0, "not-an-ip", "10.0.0.1", "DDoS", "DDoS", "high", "model_prediction"),
            ("a", 1, "2001:db8::1", "10.0.0.1", "DDoS", "DDoS", "high", "model_prediction")]
    replay = response.replay_response(spark.createDataFrame(rows, ROW))
    assert [r.seq for r in replay.rejects.collect()] == [0]
    assert [(r.seq, r.action) for r in replay.rows.collect()] == [(1, "blocked")]


def test_block_log(spark):
    import datetime as dt
    at = [dt.datetime(2024, 1, 1, 0, i) for i in range(4)]
    log = (response.block(spark, "10.0.0.1", "first", at[0]).union(response.block(spark, "2001:DB8::1", "six", at[1]))
           .union(response.unblock(spark, "10.0.0.1", at[2])).union(response.block(spark, "10.0.0.9", "x", at[3])))
    assert [r.ip for r in response.blocklist(log).collect()] == ["10.0.0.9", "2001:db8::1"]
    with pytest.raises(Exception):
        response.block(spark, "10.0.0.256").collect()
    with pytest.raises(ValueError):
        response.block(spark, "10.0.0.1", "x" * 301)


def test_addresses_as_the_standard_library_reads_them(spark):
    import ipaddress

    from flowloom.operators.response import is_address
    texts = ["10.0.0.1", "256.1.1.1", "::", ":::", "::1", "1::", "2001:db8::1", "2001:db8::1%eth0", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::",
             "1:2:3:4:5:6:7:8::", "::ffff:10.0.0.1", "::ffff:10.0.0", "1:2:3:4:5:6:10.0.0.1", "1::2::3", "12345::", "g::", "", "abc", ":1", "1:", "fe80::1%"]

    def known(t):
        try:
            return bool(ipaddress.ip_address(t))
        except ValueError:
            return False

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", is_address("t").alias("ok")).collect()
    assert {r.t: r.ok for r in rows} == {t: known(t) or t == "::" for t in texts}


def test_rounds_work_out_changed_sources_only(spark):
    """A chain: each source is stopped by the block of the next address, or not."""
    rows = []
    for k in range(6):  # 10.0.k.1 -> 10.0.k.2 -> ... the last one attacks first
        for hop in range(1, 6):
            rows.append({"sensor_id": "a", "seq": 10 * k + 5 - hop, "source_ip": f"10.0.{k}.{hop}", "destination_ip": f"10.0.{k}.{hop + 1}",
                         "prediction": "DoS", "attack_label": "DoS", "severity": "high", "reason": "model_prediction"})
    rows += [{"sensor_id": "a", "seq": 1000 + i, "source_ip": f"10.9.0.{i}", "destination_ip": "10.8.0.1", "prediction": "DoS",
              "attack_label": "DoS", "severity": "high", "reason": "model_prediction"} for i in range(200)]
    replay = check(spark, rows)
    assert replay.rounds >= 3 and max(replay.worked) <= 24 and replay.worked == sorted(replay.worked, reverse=True)


def test_many_commands_on_one_address(spark):
    rows = [{"sensor_id": "a", "seq": i, "source_ip": "10.0.0.1" if i % 3 else "10.0.0.2", "destination_ip": "10.0.0.2" if i % 3 else "10.0.0.1",
             "prediction": "Recon" if i % 2 else "DoS", "attack_label": "Recon" if i % 2 else "DoS", "severity": "high", "reason": "model_prediction"}
            for i in range(3000)]
    commands = [{"sensor_id": "a", "ip": "10.0.0.1", "op": "unblock" if i % 4 else "block", "at_seq": i} for i in range(3000)]
    replay = check(spark, rows, (), None, commands, Config(slice_rows=500))
    kept = replay.facts.groupBy("ip", "epoch").count().agg({"count": "max"}).first()[0]
    assert kept <= 4 and replay.facts.count() < 4 * 3000  # linear in the commands


def test_command_texts(spark):
    import datetime as dt
    at = dt.datetime(2024, 1, 1)
    given = [("2001:0DB8::1", "block", None, at), ("10.0.0.300", "block", "x", at), ("10.0.0.1", "drop", "x", at), (None, "block", "x", at),
             ("10.0.0.1", "block", "x" * 301, at), ("10.0.0.1", "unblock", "x" * 301, at)]
    ok, bad = response.change_log(spark.createDataFrame(given, "ip string, op string, reason string, at timestamp"))
    assert sorted((r.ip, r.op) for r in ok.collect()) == [("10.0.0.1", "unblock"), ("2001:db8::1", "block")] and bad.count() == 4


def test_check_data_need_several_rounds(spark):
    import os
    from workload.queries import replayed_eagerly
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    replay = replayed_eagerly(spark, folder).replay
    assert replay.rounds >= 3 and replay.worked[-1] < replay.worked[0]
