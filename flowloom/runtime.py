"""Session helpers: the shared folder, and cutting lineage through it."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_STEP_TABLES: ContextVar[list[str] | None] = ContextVar("step_tables", default=None)


def build_session(name: str = "flowloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects (UTC, AQE, no UI)."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        b = b.config(key, value)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors reach, as named by ``spark.checkpoint.dir``.

    Only a session on one machine (``local``, ``local[n]``), which has no other
    to share with, falls back to a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^,]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is not set: the cluster must name a shared folder")
    path = tempfile.mkdtemp(prefix="flowloom-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Cuts the lineage, survives lost executors, and gives the planner true
    sizes, so that joins against small tables turn into broadcasts only when
    the files really are below the broadcast threshold.
    """
    spark = df.sparkSession
    path = new_table_path(spark, name)
    made = _STEP_TABLES.get()
    if made is not None:
        made.append(path)
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_table(path: str) -> None:
    """Delete a table's folder, if it is there."""
    from pyarrow import fs
    uri = path if "://" in path else f"file://{path.removeprefix('file:')}"
    where, name = fs.FileSystem.from_uri(uri)
    if where.get_file_info(name).type == fs.FileType.Directory:
        where.delete_dir(name)


@contextmanager
def step_tables() -> Iterator[None]:
    """Tables written by ``write_table`` in this block are deleted at its end.
    For steps that store all they produce, such as a micro-batch, so that a
    long-running stream does not fill the shared folder."""
    made: list[str] = []
    token = _STEP_TABLES.set(made)
    try:
        yield
    finally:
        _STEP_TABLES.reset(token)
        for path in made:
            delete_table(path)
