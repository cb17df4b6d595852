"""The log table on disk: append, read, migrate, export, clear."""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..config import BASELINE_VERDICT, DEFAULT, LEGACY_FLOW_ID, LEGACY_RULE_ID, LOG_COLUMNS
from ..functions import labels as lab
from ..functions.columns import filled
from ..operators.logqueries import newest
from ..schemas import LOGS

KEY = ["sensor_id", "session_id", "id"]
FOLDERS = ("log_date", "ingested")
STORED = T.StructType(LOGS.fields + [
    T.StructField("ingested", T.LongType()), T.StructField("log_date", T.DateType())])


def append_logs(logs: DataFrame, path: str, ingested: int | None = None) -> None:
    """Append logs, in folders by day and ``ingested``. Rows are upserts: of
    rows with one key the latest ``ingested`` counts."""
    stamp = time.time_ns() // 1000 if ingested is None else ingested
    _stamped(logs, stamp).write.mode("append").partitionBy(*FOLDERS).parquet(path)


def append_once(logs: DataFrame, path: str, ingested: int) -> None:
    """Append the logs of a batch that may run again: what is there in full is
    left as it is, what is there in part is replaced."""
    spark, there = logs.sparkSession, 0
    if _exists(path):
        there = stored_logs(spark, path).filter(F.col("ingested") == ingested).count()
    if there and there == logs.count():
        return
    writer = _stamped(logs, ingested).write.option("partitionOverwriteMode", "dynamic").mode("overwrite")
    writer.partitionBy(*FOLDERS).parquet(path)


def _stamped(logs: DataFrame, stamp: int) -> DataFrame:
    return logs.withColumns({"log_date": F.to_date("timestamp"), "ingested": F.lit(stamp).cast("long")})


def _exists(path: str) -> bool:
    from pyarrow import fs
    where, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    return where.get_file_info(name).type == fs.FileType.Directory


def stored_logs(spark: SparkSession, path: str) -> DataFrame:
    """Everything ever appended, with ``ingested`` and ``log_date``."""
    return spark.read.schema(STORED).parquet(path)


def current_logs(spark: SparkSession, path: str, since: dt.date | None = None, until: dt.date | None = None) -> DataFrame:
    """The latest version of each row, from day ``since`` to day ``until``:
    folders of other days are not read. Older versions are dropped in the
    scanning tasks before the shuffle."""
    last = Window.partitionBy(*KEY).orderBy(F.desc("ingested"))
    rows = stored_logs(spark, path)
    if since is not None:
        rows = rows.filter(F.col("log_date") >= F.lit(since))
    if until is not None:
        rows = rows.filter(F.col("log_date") <= F.lit(until))
    rows = rows.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") == 1)
    return rows.select("sensor_id", "session_id", *LOG_COLUMNS)


def compact_logs(spark: SparkSession, path: str, target: str) -> None:
    """Write the latest version of each row as a table of its own, as one
    ``ingested``. Readers go on with the old table until they are pointed to
    the new one."""
    newest = stored_logs(spark, path).agg(F.max("ingested")).first()[0]
    append_logs(current_logs(spark, path), target, newest or 0)


def load_logs(spark: SparkSession, *paths: str, defaults: str = "storage") -> DataFrame:
    """Logs written by any version: absent columns are added, and they and
    nulls get defaults. ``storage`` uses fixed ones, ``runtime`` derives
    severity and signature from the prediction."""
    rows = spark.read.option("mergeSchema", "true").parquet(*paths)
    missing = [f for f in LOGS.fields if f.name not in rows.columns]
    rows = rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})
    severity, signature, rule_id = BASELINE_VERDICT
    if defaults == "storage":
        fallback = {"severity": F.lit(severity), "signature": F.lit(signature), "rule_id": F.lit(rule_id)}
    elif defaults == "runtime":
        fallback = {
            "severity": lab.model_severity("prediction", None, DEFAULT),
            "signature": F.coalesce(filled("prediction"), F.lit(signature)),
            "rule_id": F.lit(LEGACY_RULE_ID)}
    else:
        raise ValueError(f"unknown defaults: {defaults}")
    fallback |= {
        "flow_id": F.lit(LEGACY_FLOW_ID), "flow_packet_count": F.lit(0).cast("long"),
        "flow_byte_count": F.lit(0).cast("long"), "flow_duration": F.lit(0.0)}
    rows = rows.withColumns({c: F.coalesce(F.col(c), v) for c, v in fallback.items()})
    return rows.select("sensor_id", "session_id", *LOG_COLUMNS)


def export_logs(logs: DataFrame, path: str, limit: int | None = None, mode: str = "error") -> None:
    """The latest rows as CSV with a header, ascending; all rows if no limit."""
    rows = logs if limit is None else newest(logs, limit)
    rows.write.mode(mode).csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def clear_logs(spark: SparkSession, path: str) -> None:
    """Empty the table; it can be read and appended to afterwards."""
    empty = spark.createDataFrame([], STORED)
    empty.drop(*FOLDERS).write.mode("overwrite").parquet(path)
