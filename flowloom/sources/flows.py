"""Reading the raw flow datasets and writing the unified one."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.datasets import normalise_columns
from ..schemas import RAW_FLOWS


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, sorted. Contents are not read."""
    listing = spark.read.format("binaryFile").load(pattern).select("path")
    return sorted(r[0] for r in listing.collect())


def _first_lines(full: int):
    """The first line of each file in a task's splits. A split of ``full`` bytes
    has its task to itself, so no more of it is read than one batch."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            for path, start, size, line in zip(*(c.to_pylist() for c in batch.columns)):
                if start == 0 and path not in seen:
                    seen.add(path)
                    yield pa.RecordBatch.from_pydict({"path": [path], "line": [line]})
            if batch.num_rows and batch.column(2)[0].as_py() >= full:
                return
    return read


def headers(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """First line by path, for all files in one job. Empty files have none."""
    at = F.col("_metadata")
    rows = spark.read.text(paths).select(at.file_path.alias("path"), at.file_block_start.alias("start"), at.file_block_length.alias("size"), "value")
    full = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    found = rows.mapInArrow(_first_lines(int(full)), "path string, line string").collect()  # one short row for each file
    return {r.path: r.line for r in found}


def read_flows(spark: SparkSession, kind: str, path: str, max_files: int | None = None,
               limit_rows: int | None = None) -> DataFrame:
    """CSV flow records of one ``kind`` (cic, netflow, iot) by glob, typed.

    Columns are matched by normalised name; files that order them differently
    are read apart. ``max_files`` takes the first files by name. ``limit_rows``
    keeps that many rows, no particular ones.
    """
    schema = RAW_FLOWS[kind]
    paths = list_files(spark, path)
    if max_files is not None:
        paths = paths[:max_files]
    if not paths:
        raise FileNotFoundError(f"no files match {path}")
    lines = headers(spark, paths)
    by_header: dict[str, list[str]] = {}
    for p in paths:
        by_header.setdefault(lines.get(p, ""), []).append(p)

    def typed(f):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            return c
        number = c.try_cast("double")
        return (number if isinstance(f.dataType, T.DoubleType) else number.try_cast(f.dataType)).alias(f.name)

    parts = []
    for group in by_header.values():
        raw = normalise_columns(spark.read.csv(group, header=True))
        absent = sorted(f.name for f in schema.fields if f.name not in raw.columns)
        if absent:
            raise ValueError(f"{kind} records lack columns: " + ", ".join(absent))
        parts.append(raw.select(*[typed(f) for f in schema.fields]))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.limit(limit_rows) if limit_rows is not None else rows


def write_unified(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """Store the unified table, as Parquet or as CSV with a header."""
    if fmt == "csv":
        df.write.mode(mode).csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    elif fmt == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unknown format: {fmt}")
