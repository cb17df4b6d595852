import random

import pytest
from pyspark.sql import functions as F

from flowloom.config import Config
from flowloom.plans.detect import detect
from flowloom.sources.logstore import current_logs, stored_logs
from flowloom.streaming.flow_state import read_packet_stream
from flowloom.streaming.live import LiveDetection, finish, live_summary, notify_once, read_log_stream, start_detection
from tests.test_chain import frame, packets, scores

CFG = Config(min_flow_packets=3, min_flow_duration=0.2, classify_interval=2, rolling_window=7)


def run(spark, folder, parts, cfg=CFG, **more):
    source = f"{folder}/in"
    for rows in parts:
        frame(spark, rows).coalesce(1).write.mode("append").parquet(source)
    live = LiveDetection(spark, f"{folder}/logs", f"{folder}/state", cfg, score_columns=scores(), **more)
    q = start_detection(read_packet_stream(spark, source, 1), live, f"{folder}/check", available_now=True)
    finish(q)
    return current_logs(spark, f"{folder}/logs")


@pytest.mark.parametrize("cuts", [(), (90, 91)])
def test_stream_equals_batch(spark, folder, cuts):
    rows = packets(8, 240, hot=0.4)
    edges = [0, *cuts, len(rows)]
    parts = [random.Random(1).sample(rows[a:b], b - a) for a, b in zip(edges, edges[1:])]
    logs = run(spark, folder, parts)
    want = detect(frame(spark, rows), CFG, score_columns=scores(), skew="whole").logs
    assert sorted(map(str, logs.collect())) == sorted(map(str, want.collect()))

    # reports that follow the log table
    summary = live_summary(read_log_stream(spark, f"{folder}/logs"))
    q = summary.writeStream.format("memory").queryName("summary").outputMode("update").trigger(availableNow=True).start()
    finish(q)
    assert spark.table("summary").agg(F.sum("packets")).first()[0] == len(rows)
    once = notify_once(read_log_stream(spark, f"{folder}/logs"))
    q = once.writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    finish(q)
    keys = [r.alert_key for r in spark.table("once").collect()]
    assert keys and len(keys) == len(set(keys))


def test_late_packets_are_rejected_uncounted(spark, folder):
    """Late packets and second copies are rejected, none is lost, and the flows
    are those of the other packets."""
    rows = packets(9, 60)
    logs = run(spark, folder, [rows[10:] + rows[20:23], rows[:10]])
    assert spark.read.parquet(f"{folder}/state/rejects").count() == 13
    want = detect(frame(spark, rows[10:]), CFG, score_columns=scores(), skew="whole").logs
    assert sorted(map(str, logs.collect())) == sorted(map(str, want.collect()))


def test_repeated_batch(spark, folder):
    rows = packets(11, 80)
    live = LiveDetection(spark, f"{folder}/logs", f"{folder}/state", CFG, score_columns=scores())
    for part, batch in ((rows[:40], 0), (rows[:40], 0), (rows[40:], 1), (rows[40:], 1)):
        live(frame(spark, part), batch)
    assert stored_logs(spark, f"{folder}/logs").count() == 80
    want = detect(frame(spark, rows), CFG, score_columns=scores(), skew="whole").logs
    assert sorted(map(str, current_logs(spark, f"{folder}/logs").collect())) == sorted(map(str, want.collect()))


def test_idle_flows_begin_anew_and_are_freed(spark, folder):
    rows = packets(10, 30)
    later = [{**r, "seq": r["seq"] + 1000, "ts_us": r["ts_us"] + 10 ** 10} for r in rows]
    once = [{**r, "session_id": "gone"} for r in rows]
    logs = run(spark, folder, [once + rows, later], idle_timeout=60, buckets=1)
    counted = {r.id: r.flow_packet_count for r in logs.filter("session_id = 's'").collect()}
    again = [i for i in counted if i <= 1000 and i + 1000 in counted]
    assert len(again) > 20 and all(counted[i] == counted[i + 1000] for i in again)
    flows = LiveDetection(spark, f"{folder}/logs", f"{folder}/state", CFG, buckets=1).flows.current()
    assert flows.count() > 3 and flows.filter("session_id = 'gone'").isEmpty()


def test_busy_batch_is_cut(spark, folder):
    """A key with more rows in a batch than a task should sort, with state from
    the batches before."""
    import dataclasses
    rows = packets(12, 300, hot=0.7)
    logs = run(spark, folder, [rows[:50], rows[50:]], dataclasses.replace(CFG, slice_rows=40))
    want = detect(frame(spark, rows), CFG, score_columns=scores(), skew="whole").logs
    assert sorted(map(str, logs.collect())) == sorted(map(str, want.collect()))


def test_ids_over_captures(spark, folder):
    """Sessions count from 0 each; ids go on from batch to batch."""
    rows = [{**r, "session_id": s, "seq": i} for s in ("x", "y") for i, r in enumerate(packets(13, 40))]
    logs = run(spark, folder, [[r for r in rows if r["seq"] < 20], [r for r in rows if r["seq"] >= 20]], number=True)
    ids = [r.id for r in logs.collect()]
    assert len(set(ids)) == 80 and min(ids) == 1  # a session takes as many ids as its seq spans
    whole = detect(frame(spark, rows), CFG, score_columns=scores(), scope=("sensor_id", "session_id"), ids_after=500).logs
    placed = {(r.sensor_id, r.session_id, r.id) for r in whole.collect()}
    assert len({i for *_, i in placed}) == 80 and min(i for *_, i in placed) == 501
    order = sorted(placed, key=lambda r: r[2])
    assert order == sorted(order)


def test_carry_tables_touch_only_their_buckets(spark, folder):
    from flowloom.streaming.carry import CarryTable
    table = CarryTable(spark, f"{folder}/carry", ["k"], "k int, v int", 16)

    def make(pairs):
        return spark.createDataFrame(pairs, "k int, v int")

    want: dict = {}
    for b in range(6):
        new = {0: b, 10 + b: b} if b else {k: 0 for k in range(300)}
        touched = make(list(new.items()))
        before = table.before(b, touched)
        if b:
            assert len(before.inputFiles()) <= 3  # the buckets of two keys, and the one swept
        got = {r.k: r.v for r in before.collect()}
        assert all(got.get(k) == want.get(k) for k in new) and got.items() <= want.items()
        for _ in range(2):  # a batch may run again
            table.save(b, touched, table.before(b, touched))
        want |= new
    assert {r.k: r.v for r in table.current().collect()} == want
    # rows that have expired go, also from buckets that no batch asks for
    for b in range(6, 6 + 16):
        table.save(b, make([]), table.before(b, make([])), F.col("v") > 0)
    assert {r.k: r.v for r in table.current().collect()} == {k: v for k, v in want.items() if v > 0}
    import os
    assert all(len(os.listdir(f"{folder}/carry/{d}")) <= 2 for d in os.listdir(f"{folder}/carry") if d.startswith("_k="))


def test_batch_is_stored_twice_only(spark, folder, monkeypatch):
    """The packets as they come, and what is decided; all else on the way is narrow or small."""
    from flowloom.streaming import live as module
    rows, stored = packets(14, 60), {}
    write = module.write_table

    def counted(df, name):
        out = write(df, name)
        stored[name] = out.count()
        return out

    monkeypatch.setattr(module, "write_table", counted)
    live = LiveDetection(spark, f"{folder}/logs", f"{folder}/state", CFG, score_columns=scores())
    live(frame(spark, rows), 0)
    assert sum(n >= len(rows) for n in stored.values()) == 2
    assert stored_logs(spark, f"{folder}/logs").count() == len(rows)
