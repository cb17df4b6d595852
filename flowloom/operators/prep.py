"""Cleaning, profiling, balancing and featurising unified flow tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..config import BENIGN_LABELS, EPS, MODEL_FEATURES, NOT_ATTACK_TYPES
from ..functions.columns import is_true
from ..functions.labels import attack_group
from ..runtime import write_table
from .numbering import dense_index

HASH_BITS = 62
BUCKET_BITS = 16


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _floating(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def _is_inf(name: str) -> Column:
    return F.abs(F.col(name)) == F.lit(float("inf"))


def clean(df: DataFrame, bound: float | None = 1e15, dedup: bool = False) -> DataFrame:
    """Rows without null, NaN or infinity, all numbers within the bound.

    One conjunction of plain comparisons, which the scan can take over: null
    fails them all, and NaN sorts above every number.
    """
    floating = set(_floating(df))

    def passes(f: T.StructField) -> Column:
        c = F.col(f.name)
        limit = bound if bound is not None else (float("inf") if f.name in floating else None)
        if limit is None or not isinstance(f.dataType, T.NumericType):
            return c.isNotNull()
        return (c < F.lit(limit)) & (c > F.lit(-limit))

    out = df.filter(reduce(lambda a, b: a & b, [passes(f) for f in df.schema.fields]))
    return out.dropDuplicates() if dedup else out


def profile(df: DataFrame) -> DataFrame:
    """Missing values, infinities, rows and columns, in one pass."""
    floating = set(_floating(df))

    def missing(c: str) -> Column:
        gone = F.col(c).isNull() | F.isnan(c) if c in floating else F.col(c).isNull()
        return F.count_if(gone)

    def total(parts: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, parts, F.lit(0).cast("long"))

    return df.agg(
        total([missing(c) for c in df.columns]).alias("missing"),
        total([F.count_if(_is_inf(c)) for c in df.columns if c in floating]).alias("infinite"),
        F.count(F.lit(1)).alias("row_count"),
    ).withColumn("column_count", F.lit(len(df.columns)))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows and share (three places) per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    share = F.floor(F.col("count") / total * F.lit(1000.0) + F.lit(0.5)) / F.lit(1000.0)
    return counts.withColumn("share", share)


def rare_classes(df: DataFrame, label: str, least: int = 100) -> DataFrame:
    return class_counts(df, label).filter(F.col("count") < least).select(label, "count")


def attack_classes(df: DataFrame, label: str) -> DataFrame:
    """Classes other than the benign ones. None means the wrong label column."""
    names = [n.upper() for n in BENIGN_LABELS]
    return class_counts(df, label).filter(~F.upper(label).isin(*names)).select(label, "count")


def attacks_only(df: DataFrame) -> DataFrame:
    """Malicious rows with a usable attack type, upper-cased and trimmed.

    Filters are moved below projections, and each takes a copy of the expression that
    made its column. A long one (a label by cases) makes methods that are too large for
    the JIT, and then all of the scan runs interpreted. They stop at ``made``.
    """
    kind = F.btrim(F.upper("attack_type"), F.lit(" \t\n\r\x0b\x0c"))
    made = df.select(F.inline(F.array(F.struct(*df.columns))))
    rows = made.filter(F.col("binary_label") == "MALICIOUS").withColumn("attack_type", kind)
    return rows.filter(~F.col("attack_type").isin(*NOT_ATTACK_TYPES))


def group_attacks(df: DataFrame) -> DataFrame:
    return df.withColumn("attack_type", attack_group("attack_type"))


# --- exact draws by hash ----------------------------------------------------

def _row_hash(df: DataFrame, seed: int) -> Column:
    """A non-negative hash of the whole row: the same row always draws the same."""
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns]).bitwiseAND((1 << HASH_BITS) - 1)


def draw(df: DataFrame, label: str, quota: Column, seed: int, bits: int = BUCKET_BITS, key: Column | None = None,
         rest: bool = True) -> DataFrame:
    """Add ``drawn``: true on exactly ``quota`` rows of each class, those with
    the smallest row hashes. ``quota`` is an expression over ``count``. ``key``
    replaces the hash: whole numbers from 0 to 2^62 - 1, spread evenly; rows of
    one key go by their columns. ``rest=False`` leaves out rows not drawn.

    Ranking a class as a whole would put it in one task. Instead the rows are
    stored once with their hash, and counted per class and hash bucket (two
    columns of that table). The bucket in which the quota runs out is the mark:
    rows below it are drawn by a filter. Only rows of that bucket, one in 2^bits,
    are numbered, by prefix sums.
    """
    hashed = df.withColumn("_hash", _row_hash(df, seed) if key is None else key)
    hashed = write_table(hashed.withColumn("_bucket", F.shiftright("_hash", HASH_BITS - bits)), "hashed")

    per_bucket = hashed.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    of_class = Window.partitionBy(label)
    before = of_class.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = per_bucket.withColumns({
        "_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "count": F.sum("_n").over(of_class)})
    edge = edge.withColumn("_quota", quota.cast("long"))
    edge = edge.filter((F.col("_before") < F.col("_quota")) & (F.col("_quota") <= F.col("_before") + F.col("_n")))
    edge = write_table(edge.select(  # one row per class
        F.col(label).alias("_class"), F.col("_bucket").alias("_edge"),
        (F.col("_quota") - F.col("_before")).alias("_left"), (F.col("_quota") == F.col("_before") + F.col("_n")).alias("_full")), "edges")

    rows = hashed.join(edge, F.col(label).eqNullSafe(F.col("_class")), "left")
    at_edge = is_true((F.col("_bucket") == F.col("_edge")) & ~F.col("_full"))
    clear = rows.filter(~at_edge).select(*df.columns, is_true(F.col("_bucket") <= F.col("_edge")).alias("drawn"))
    tied = rows.filter(at_edge).select(*df.columns, "_hash", "_left")
    tied = dense_index(tied, [label], ["_hash", *[c for c in df.columns if c != label]], "_i")
    tied = write_table(tied.select(*df.columns, (F.col("_i") <= F.col("_left")).alias("drawn")), "tied")
    found = clear.unionByName(tied)
    return found if rest else found.filter("drawn")


def cap_classes(df: DataFrame, label: str, n: int = 150_000, seed: int = 42, key: Column | None = None) -> DataFrame:
    """At most ``n`` rows of each class, drawn by hash; smaller classes whole."""
    return draw(df, label, F.least(F.col("count"), F.lit(n)), seed, key=key, rest=False).drop("drawn")


def stratified_split(df: DataFrame, label: str, test: float = 0.2, seed: int = 42, key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test): the given share of every class is for testing. Both are
    read from the same stored rows, by the same mark."""
    marked = draw(df, label, F.floor(F.col("count") * F.lit(test) + F.lit(0.5)), seed, key=key)
    return marked.filter(~F.col("drawn")).drop("drawn"), marked.filter("drawn").drop("drawn")


# --- features ---------------------------------------------------------------

def derive_features(df: DataFrame, burstiness: str = "std") -> DataFrame:
    """Ratios of stored flow columns. ``burstiness`` is ``std`` (spread over
    mean length, as in live scoring) or ``rate`` (packet rate times size)."""
    if burstiness not in ("std", "rate"):
        raise ValueError(f"unknown burstiness: {burstiness}")
    eps = F.lit(EPS)
    pkts, size, dur = F.col("total_packets"), F.col("total_bytes"), F.col("flow_duration")
    out = df.withColumns({
        "bytes_per_packet": size / (pkts + eps),
        "packets_per_second": pkts / (dur + eps),
        "avg_packet_size": size / (pkts + eps),
        "byte_rate": size / (dur + eps),
        "flag_sum": F.col("syn_flag") + F.col("ack_flag") + F.col("rst_flag") + F.col("psh_flag"),
    })
    spread = F.col("pkt_len_std") / (F.col("avg_pkt_len") + eps)
    rate = F.col("packets_per_second") * F.col("avg_packet_size")
    return out.withColumn("burstiness", spread if burstiness == "std" else rate)


def select_features(df: DataFrame, *labels: str) -> DataFrame:
    """The model columns as floats, and any label columns."""
    return df.select(*[F.col(c).cast("float").alias(c) for c in MODEL_FEATURES], *labels)
