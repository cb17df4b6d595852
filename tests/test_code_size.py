"""Methods above 8000 bytes are not compiled by the JIT: a stage then runs interpreted."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from flowloom.operators import response
from flowloom.plans.detect import detect
from flowloom.runtime import write_table
from flowloom.sources.logstore import append_logs, stored_logs
from flowloom.streaming.live import notify_once
from workload import queries as q, views

SF = "/root/testdata/sf0.001"
JIT_LIMIT = 8000


def largest_method(df) -> int:
    spark, shown = df.sparkSession, io.StringIO()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with contextlib.redirect_stdout(shown):
            df.explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", shown.getvalue()))


@pytest.fixture(scope="module")
def done(spark):
    return q.replayed(spark, SF)


def test_actions_fit_the_jit(spark, done):
    rows = write_table(done.replay.rows.drop("action", "response_note"), "rows")
    rows = rows.withColumns({"blocked_before": F.col("seq") % 5 == 0, "recon_step": (F.col("seq") % 4).cast("int")})
    assert largest_method(response.select_action(rows)) < JIT_LIMIT


def test_alerts_fit_the_jit(spark, done, folder):
    append_logs(done.logs, f"{folder}/logs", 1)
    assert largest_method(notify_once(stored_logs(spark, f"{folder}/logs"))) < JIT_LIMIT


def test_replay_stores_what_logs_need_and_what_is_asked_for(spark, done):
    assert not {"burstiness", "det_threat", "flow_key"} & set(done.replay.rows.columns)
    again = detect(views.packets(spark, SF), score_columns=q.stub_scores(), blocked=q.static_blocklist(spark), keep=("burstiness",))
    assert "burstiness" in again.replay.rows.columns
    assert sorted(map(str, again.logs.collect())) == sorted(map(str, done.logs.collect()))
