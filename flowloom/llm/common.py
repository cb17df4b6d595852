"""Helpers of the corpus operators: folds, shards, binary blocks, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TEXT_BATCH = 1 << 21  # bytes of text that numpy code looks at in one go


def fold(column: str, n: int) -> Column:
    """crc32 of the number as text, modulo ``n``; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def in_fold(column: str, n: int, remainder: int) -> Column:
    """Whether a row is in the fold; a null id is in none."""
    return F.coalesce(fold(column, n) == remainder, F.lit(False))


def shards(spark: SparkSession) -> int:
    """Shards follow ``spark.sql.shuffle.partitions``, which follows the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def pack(array: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(array).tobytes(), 1)


def unpack(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype)


def cut(keys: np.ndarray, n: int) -> np.ndarray:
    """Bounds of the ``n`` equal ranges of the 64-bit space in sorted ``keys``."""
    edges = (np.arange(1, n, dtype=object) * (1 << 64) // n).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def batches(texts: list[bytes], most: int = TEXT_BATCH) -> Iterator[range]:
    """Ranges of texts of about ``most`` bytes; a longer text comes alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield range(first, i)
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield range(first, len(texts))


def encoded(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def slim(batch: pa.RecordBatch, most: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``most`` rows, to bound what Python holds."""
    for at in range(0, batch.num_rows, most):
        yield batch.slice(at, most)


def bounded_sample(df: DataFrame, by: str, of: str, rows: int, seed: int) -> DataFrame:
    """About ``rows`` rows for each value of ``by``, by the hash of ``of``: all
    rows where there are fewer. One counting job, then a filter; copies of a
    text share its hash, so they come or stay away together."""
    counts = df.groupBy(by).count().collect()  # one row for each class
    part = F.xxhash64(F.lit(seed), F.col(of)) / F.lit(float(1 << 63))  # -1 to 1
    keep = F.lit(False)
    for r in counts:
        keep = F.when(F.col(by).eqNullSafe(F.lit(r[0])), part < min(2.0, 2.0 * rows / r[1]) - 1.0 + 1e-12).otherwise(keep)
    return df.filter(keep)


def spread_keys(spark: SparkSession, n: int) -> list[int]:
    """``n`` whole numbers that a hash partitioning over ``n`` partitions puts
    into different partitions, so that blocks and shards are one to a task."""
    found: dict[int, int] = {}
    size = 16 * n
    while len(found) < n:
        ids = spark.range(size).select(F.col("id").cast("int").alias("v"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p"))
        for r in ids.groupBy("p").agg(F.min("v").alias("v")).collect():  # n small rows
            found[r["p"]] = r["v"]
        size *= 4
    return [found[i] for i in range(n)]


def as_key(column: Column, keys: list[int]) -> Column:
    """The key with the number in ``column``."""
    return F.element_at(F.array(*[F.lit(k) for k in keys]), column.cast("int") + 1)


def pack_sorted(keys: np.ndarray, bits: int = 48) -> bytes:
    """Sorted 64-bit keys as the top ``bits`` of each, by difference; the first
    byte tells the width. About four bytes a key in dense ranges."""
    gaps = np.diff(keys >> np.uint64(64 - bits), prepend=np.uint64(0))
    wide = len(gaps) > 1 and gaps[1:].max() >= 1 << 32
    first = np.array(gaps[:1], np.uint64).tobytes()
    rest = gaps[1:] if wide else gaps[1:].astype(np.uint32)
    return (b"\x08" if wide else b"\x04") + first + (zstandard.compress(rest.tobytes(), 1) if len(first) else b"")


def unpack_sorted(data: bytes) -> np.ndarray:
    """The top bits of the keys, as ``pack_sorted`` took them."""
    first = np.frombuffer(data[1:9], np.uint64)
    if not len(first):
        return first
    rest = np.frombuffer(zstandard.decompress(data[9:]), np.uint64 if data[0] == 8 else np.uint32).astype(np.uint64)
    return np.cumsum(np.concatenate([first, rest]), dtype=np.uint64)


def in_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of a key one after the other in one task, by external sort, for
    code that reads them as a stream. Nulls are a key too, and come first."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, a few thousand at a time."""
    for batch in batches:
        for part in slim(batch):
            yield from zip(*(c.to_pylist() for c in part.columns))


def record_batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of at most ``most`` rows or about ``size``
    characters; a longer row comes alone."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if len(held) >= most or chars >= size:
            yield _batch(held, schema)
            held, chars = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on equal keys, nulls alike; the keys of ``left`` stay."""
    other = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return left.join(other, on, how).drop(*[f"_of_{k}" for k in keys])
