"""State of running flows between micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Config, DEFAULT
from ..operators.features import SESSION, flow_named
from ..operators.history import join_tails, tails
from ..schemas import PACKETS

FLOW = [*SESSION, "flow_id", "flow_key"]
FLOW_STATE = ("sensor_id string, session_id string, flow_id string, flow_key string, packets bigint, bytes bigint, "
              "start_us bigint, last_us bigint, tail array<struct<seq:bigint,length:int>>")


def read_packet_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Packets from Parquet files that arrive in a folder. Any other streaming
    table with the packet columns will do as well."""
    reader = spark.readStream.schema(PACKETS)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def batch_state(packets: DataFrame, before: DataFrame, cfg: Config = DEFAULT,
                idle_timeout: float | None = None) -> tuple[DataFrame, DataFrame]:
    """State of the flows in a batch before it and after it, one small row per
    flow. A flow silent for more than ``idle_timeout`` seconds begins anew."""
    rows = flow_named(packets)
    now = rows.groupBy(*FLOW).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("length").cast("long")).alias("b"),
        F.min_by("ts_us", "seq").alias("first_us"), F.max_by("ts_us", "seq").alias("newest_us"))
    known = before.join(now.select(*FLOW, "first_us"), FLOW)
    if idle_timeout is not None:
        known = known.filter(F.col("first_us") - F.col("last_us") <= F.lit(int(idle_timeout * 1_000_000)))
    known = known.drop("first_us")
    kept = join_tails(known, tails(rows, FLOW, "seq", ["length"], cfg.rolling_window), FLOW, cfg.rolling_window)
    after = now.join(kept, FLOW).join(known.drop("tail", "last_us"), FLOW, "left").select(
        *FLOW, (F.coalesce("packets", F.lit(0)) + F.col("n")).alias("packets"),
        (F.coalesce("bytes", F.lit(0)) + F.col("b")).alias("bytes"),
        F.coalesce("start_us", "first_us").alias("start_us"), F.col("newest_us").alias("last_us"), "tail")
    return known, after


def flow_history(state: DataFrame) -> DataFrame:
    """Rows to put before a flow's new ones: its last packets, the oldest of
    which stands for all packets up to it."""
    held = F.aggregate("tail", F.lit(0).cast("long"), lambda a, r: a + r.length)
    first = lambda i: i == 0
    return state.select(*FLOW, F.transform("tail", lambda r, i: F.struct(
        r.seq.alias("seq"), r.length.alias("length"),
        F.when(first(i), F.col("packets") - F.size("tail") + 1).otherwise(1).cast("long").alias("_n"),
        F.when(first(i), F.col("bytes") - held + r.length).otherwise(r.length).cast("long").alias("_b"),
        F.col("start_us").alias("_start"))).alias("tail"))
