"""Per-key tables handed from one micro-batch to the next, in hash buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyarrow import fs

from ..runtime import delete_table

BUCKET = "_k"


class CarryTable:
    """One row per key. Keys are hashed into buckets, and each version of a
    bucket is a folder ``_k=<bucket>/_b=<batch>``.

    A batch reads the newest earlier version of the buckets that its keys fall
    into, and writes these buckets as a whole; the others are neither read nor
    written. One further bucket is swept in turn, so that rows which have expired
    go even if no batch asks for their bucket. A batch that runs again reads the
    same versions and writes over its own. Older versions are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        self.schema = T.StructType.fromDDL(schema)
        self._open: dict[int, list[int]] = {}  # batch -> the buckets it has asked for
        self._fresh: dict[int, bool] = {}

    def bucket(self) -> Column:
        return F.pmod(F.hash(*[F.col(k) for k in self.keys]), F.lit(self.buckets))

    def before(self, batch_id: int, touched: DataFrame) -> DataFrame:
        """The rows, from the batches before this one, of the buckets in which
        the keys of ``touched`` lie."""
        asked = {r[0] for r in touched.select(self.bucket().alias("k")).distinct().collect()}  # at most ``buckets`` numbers
        self._open[batch_id] = sorted(asked | {batch_id % self.buckets})
        paths = [p for k in self._open[batch_id] if (p := self._newest(k, batch_id))]
        self._fresh[batch_id] = not paths
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self._stored()).parquet(*paths).filter(F.col("_row")).select(*self.schema.names)

    def fresh(self, batch_id: int) -> bool:
        """Whether ``before`` found nothing stored for a batch."""
        return self._fresh[batch_id]

    def save(self, batch_id: int, touched: DataFrame, before: DataFrame, keep: Column | None = None,
             named: DataFrame | None = None) -> None:
        """Write the opened buckets: ``touched``, and the rows of ``before`` with
        other keys that ``keep`` holds for. ``named`` has the keys of ``touched``,
        where these are had for less than ``touched`` itself. ``before`` may be
        changed on the way, but has no rows where ``fresh`` holds, unless given."""
        rows = touched.select(*self.schema.names)
        if not self._fresh.get(batch_id) or before.head(1):
            rest = before.join((touched if named is None else named).select(*self.keys), self.keys, "left_anti")
            rows = rows.unionByName(rest if keep is None else rest.filter(keep))
        rows = rows.withColumns({"_row": F.lit(True), BUCKET: self.bucket()})
        # a bucket without rows is written too, or its last version would count
        marks = self.spark.createDataFrame([(False, k) for k in self._open[batch_id]], f"_row boolean, {BUCKET} int")
        out = rows.unionByName(marks, allowMissingColumns=True).withColumn("_b", F.lit(batch_id))
        out.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET, "_b").parquet(self.path)
        for k in self._open[batch_id]:
            for old in self._versions(k, batch_id)[:-1]:
                delete_table(f"{self.path}/{BUCKET}={k}/_b={old}")

    def current(self) -> DataFrame:
        """All rows after the last batch."""
        paths = [p for k in range(self.buckets) if (p := self._newest(k, 1 << 62))]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self._stored()).parquet(*paths).filter(F.col("_row")).select(*self.schema.names)

    def _stored(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("_row", T.BooleanType())])

    def _versions(self, bucket: int, before: int) -> list[int]:
        """Batches before the given one that have written the bucket."""
        uri = self.path if "://" in self.path else f"file://{self.path.removeprefix('file:')}"
        where, root = fs.FileSystem.from_uri(uri)
        found = where.get_file_info(fs.FileSelector(f"{root}/{BUCKET}={bucket}", allow_not_found=True))
        return sorted(b for f in found if f.base_name.startswith("_b=") and (b := int(f.base_name[3:])) < before)

    def _newest(self, bucket: int, before: int) -> str | None:
        versions = self._versions(bucket, before)
        return f"{self.path}/{BUCKET}={bucket}/_b={versions[-1]}" if versions else None
