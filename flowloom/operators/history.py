"""Running and rolling windows over keys of any size.

A window group is one task's work, so a key with more than ``slice_rows`` rows
is cut: its rows are numbered by prefix sums over ranges (``numbering``) and
every ``slice_rows`` of them are one slice, however the order values lie. Other
keys stay whole and on the plain plan. Each slice then starts from the state
its key had reached before it: up to
``lookback`` earlier rows, the oldest of which also carries the totals so far. The state rows
are derived in a narrow pre-pass over the large keys (partial aggregates and a
map-side top-n), so they number at most ``lookback`` for each ``slice_rows``
rows, and no large key is ever sorted in one task. Results are the same as
those of a plain window, row for row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from .numbering import dense_index, large_keys

SLICE = "_slice"      # part of every window key
CARRIED = "_carried"  # true on rows that only bring state into a slice


def needs_slices(df: DataFrame, keys: list[str], slice_rows: int) -> bool:
    """Whether any key holds more rows than one task should sort. One counting
    job over the key columns, with map-side partial counts."""
    biggest = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return (biggest or 0) > slice_rows


def with_history(
    df: DataFrame,
    keys: list[str],
    order: str,
    lookback: int,
    slice_rows: int | None,
    totals: dict[str, Column] | None = None,
    starts: dict[str, Column] | None = None,
    keep: list[str] | None = None,
    before: DataFrame | None = None,
) -> DataFrame:
    """Add ``_slice`` and ``_carried``; windows then use ``slice_window(keys, order)``.

    ``totals`` are per-row amounts whose running sum over the slice window must
    equal the sum over the whole key; ``starts`` are values whose ``first`` must
    be that of the whole key. ``keep`` names the columns the rolling frames
    read. ``before`` has rows of earlier batches: the keys and an array ``tail``
    of the order, kept, total and start columns. ``slice_rows=None`` leaves all
    keys whole. Order values must be unique within a key and the keys must not
    be null.
    """
    totals, starts, keep = totals or {}, starts or {}, keep or []
    rows = df.withColumns({**totals, **starts}).withColumn(CARRIED, F.lit(False))
    if before is not None:
        earlier = before.select(*keys, F.inline("tail")).withColumn(CARRIED, F.lit(True))
        rows = rows.unionByName(earlier, allowMissingColumns=True)
    if slice_rows is None:
        return rows.withColumn(SLICE, F.lit(0).cast("long"))

    whole = rows.withColumn(SLICE, F.lit(0).cast("long"))
    large = large_keys(rows, keys, slice_rows)
    if not large.head(1):
        return whole
    cut = dense_index(rows.join(large, keys, "left_semi"), keys, [order], SLICE)
    cut = cut.withColumn(SLICE, F.floor((F.col(SLICE) - 1) / F.lit(slice_rows)).cast("long"))
    rows = whole.join(large, keys, "left_anti").select(*cut.columns).unionByName(cut)
    names = list(dict.fromkeys([order, *keep, *totals, *starts]))
    slim = cut.select(*keys, SLICE, *names)
    group = [*keys, SLICE]

    newest = Window.partitionBy(*group).orderBy(F.desc(order))
    tails = (
        slim.withColumn("_rank", F.row_number().over(newest))
        .filter(F.col("_rank") <= lookback)
        .groupBy(*group)
        .agg(F.sort_array(F.collect_list(F.struct(*names))).alias("_tail"))
    )
    sums = slim.groupBy(*group).agg(
        *[F.sum(t).alias(f"_sum_{t}") for t in totals],
        *[F.min_by(s, order).alias(f"_first_{s}") for s in starts],
        F.count(F.lit(1)).alias("_count"),
    )
    state = sums.join(tails, group)

    by_slice = Window.partitionBy(*keys).orderBy(SLICE)
    # every slice has at least one row, so `lookback` earlier slices are enough
    near = by_slice.rowsBetween(-lookback, -1)
    before = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    gathered = F.flatten(F.collect_list("_tail").over(near))
    history = state.select(
        *group,
        gathered.alias("_all"),
        *[F.sum(f"_sum_{t}").over(before).alias(f"_sum_{t}") for t in totals],
        *[F.first(f"_first_{s}").over(before).alias(f"_first_{s}") for s in starts],
    ).filter(F.size("_all") > 0)
    history = history.withColumn(
        "_tail", F.slice("_all", F.greatest(F.size("_all") - (lookback - 1), F.lit(1)), F.lit(lookback)))
    carried = history.select(*group, "_tail", *[f"_sum_{t}" for t in totals],
                             *[f"_first_{s}" for s in starts],
                             F.posexplode("_tail").alias("_pos", "_row"))
    oldest = F.col("_pos") == 0

    def total(name: str) -> Column:
        own = F.col(f"_row.{name}")
        held = F.aggregate("_tail", F.lit(0).cast("long"), lambda acc, r: acc + r[name])
        return F.when(oldest, F.col(f"_sum_{name}") - held + own).otherwise(own)

    carried = carried.select(
        *group,
        *[F.col(f"_row.{n}").alias(n) for n in names if n not in totals and n not in starts],
        *[total(t).alias(t) for t in totals],
        *[F.col(f"_first_{s}").alias(s) for s in starts],
        F.lit(True).alias(CARRIED),
    )
    return rows.unionByName(carried, allowMissingColumns=True)


def tails(rows: DataFrame, keys: list[str], order: str, columns: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of each key as an array ``tail``, by map-side top-n."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    last = rows.select(*keys, order, *columns).withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= n)
    return last.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("tail"))


def join_tails(before: DataFrame, now: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Tails after a batch, for the keys in it."""
    old = before.select(*keys, F.col("tail").alias("_old"))
    both = F.concat(F.coalesce("_old", F.slice("tail", 1, 0)), F.col("tail"))
    start = F.greatest(F.size(both) - (n - 1), F.lit(1))
    return now.join(old, keys, "left").select(*keys, F.slice(both, start, F.lit(n)).alias("tail"))


def slice_window(keys: list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys, SLICE).orderBy(order)


def drop_history(df: DataFrame, *helpers: str) -> DataFrame:
    """Remove the carried rows and the helper columns."""
    return df.filter(~F.col(CARRIED)).drop(SLICE, CARRIED, *helpers)
