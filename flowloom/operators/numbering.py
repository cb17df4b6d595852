"""Row numbers in keys of any size.

A window numbers the rows of a key in one task. ``dense_index`` numbers them by
prefix sums instead: rows are range-partitioned by key and order, each range
counts what it holds of a key, and the counts of the ranges before it are added.
No task sees more than one range, however large a key is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import write_table


def same_keys(keys: list[str]) -> Column:
    """Equality of all keys with those of a table in ``renamed`` form, nulls alike."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])


def renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_of_{k}" for k in keys})


def large_keys(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The keys with more than ``most`` rows: fewer than one for every ``most``
    rows. Map-side partial counts, stored so that joins know the size."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return write_table(counts.filter(F.col("_rows") > most).select(*keys), "large_keys")


def dense_index(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Add ``name``: 1, 2, ... within each key by ``order`` (nulls first). Ties
    are numbered in any order, but only once: the rows are stored."""
    ranges = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = write_table(ranges.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    rows = rows.withColumn("_range", F.shiftright("_at", 33))  # the partition, by how these ids are made
    runs = rows.groupBy(*keys, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(*keys, "_range", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    at = [*keys, "_range"]
    found = rows.join(renamed(runs, at), same_keys(at)).withColumn(name, F.col("_at") + F.col("_shift"))
    return found.select(*df.columns, name)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, most: int) -> DataFrame:
    """As ``dense_index``; only keys with more than ``most`` rows take its way,
    the others one window."""
    window = Window.partitionBy(*keys).orderBy(*order)
    large = renamed(large_keys(df, keys, most), keys)
    if not large.head(1):
        return df.withColumn(name, F.row_number().over(window).cast("long"))
    rest = df.join(large, same_keys(keys), "left_anti")
    hot = df.join(large, same_keys(keys), "left_semi")
    return rest.withColumn(name, F.row_number().over(window).cast("long")).unionByName(dense_index(hot, keys, order, name))


def running_total(df: DataFrame, keys: list[str], order: list[str], amount: Column, name: str, most: int) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over the rows of the key up to each
    row. A key with more than ``most`` rows is summed slice by slice."""
    rows = df.withColumn(name, amount)
    upto = (Window.unboundedPreceding, Window.currentRow)
    plain = F.sum(name).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*upto))
    large = renamed(large_keys(df, keys, most), keys)
    if not large.head(1):
        return rows.withColumn(name, plain)
    rest = rows.join(large, same_keys(keys), "left_anti").withColumn(name, plain)
    hot = dense_index(rows.join(large, same_keys(keys), "left_semi"), keys, order, "_i")
    hot = hot.withColumn("_slice", F.floor((F.col("_i") - 1) / F.lit(most)))
    at = [*keys, "_slice"]
    sums = hot.groupBy(*at).agg(F.sum(name).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = renamed(sums.select(*at, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")), at)
    inside = F.sum(name).over(Window.partitionBy(*at).orderBy("_i").rowsBetween(*upto))
    hot = hot.withColumn(name, inside).join(sums, same_keys(at)).withColumn(name, F.col(name) + F.col("_before"))
    return rest.unionByName(hot.select(*rest.columns))


def total_before(df: DataFrame, order: list[str], amount: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over all rows before each row, by
    ``order`` (unique). Sums of ranges are added, so no task sees all rows."""
    rows = write_table(df.withColumn(name, amount).repartitionByRange(*order).sortWithinPartitions(*order)
                       .withColumn("_at", F.monotonically_increasing_id()), "ranges")
    rows = rows.withColumn("_range", F.shiftright("_at", 33))
    sums = rows.groupBy("_range").agg(F.sum(name).alias("_sum"))  # one row for each task
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = F.sum(name).over(Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    found = rows.withColumn(name, F.coalesce(inside, F.lit(0))).join(sums, "_range")
    return found.withColumn(name, F.col(name) + F.col("_before")).select(*df.columns, name)
