"""A keyed store in hash buckets: an upsert rewrites the buckets that its patch touches, and no other file.

Rows lie in ``<path>/bucket=<n>`` by the hash of their key, so a patch names its buckets itself: only those are read, joined
and replaced, by Spark's dynamic partition overwrite. The number of buckets is fixed when the store is made and read back from
its name; a store of 100 TB takes some 100,000 buckets of 1 GB. Keys may be null and of any type, null-safe throughout. One
writer at a time: the commit moves one bucket after another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areapulse.operators.ingest import dedupe_keep_last


def bucket_of(key: Column, buckets: int) -> Column:
    """Bucket of a key: its text's hash, so that a key of another width or a null has a fixed place too."""
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


class BucketStore:
    """Rows with a unique key below a folder."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.schema = schema
        self.columns = spark.createDataFrame([], schema).columns

    def _write(self, rows: DataFrame) -> None:
        placed = rows.select(*self.columns, bucket_of(F.col(self.key), self.buckets).alias("bucket"))
        # Rebalancing splits a bucket that is large and joins small ones: files follow bytes, not keys.
        writer = placed.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket")
        writer.option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        """Fill a new store; keys are unique."""
        self._write(rows)

    def rows(self) -> DataFrame:
        """All rows."""
        return self._read().select(*self.columns)

    def _read(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, bucket int").parquet(self.path)

    def _touched(self, patch: DataFrame) -> list[int]:
        """Buckets of a patch: at most as many numbers as there are buckets."""
        return sorted(r["b"] for r in patch.select(bucket_of(F.col(self.key), self.buckets).alias("b")).distinct().collect())

    def _part(self, touched: Sequence[int]) -> DataFrame:
        """Rows of these buckets; the others are pruned before a file is opened."""
        return self._read().where(F.col("bucket").isin(list(touched))).select(*self.columns)

    def upsert(self, patch: DataFrame, order: str | None = None, insert: bool = True) -> list[int]:
        """Set the columns of a patch where it has a value; the buckets rewritten.

        New keys are added if ``insert``, with nulls in columns that the patch lacks. Several patch rows of a key count as the
        last by ``order``; without it keys are unique in the patch. A patch that is applied twice changes nothing more.
        """
        patch = dedupe_keep_last(patch, self.key, order) if order else patch
        touched = self._touched(patch)
        if not touched:
            return []
        named = [c for c in self.columns if c in patch.columns]
        new = patch.select(F.lit(True).alias("_patched"), *[F.col(c).alias(f"_new_{c}") for c in named])
        old = self._part(touched).withColumn("_stored", F.lit(True))
        joined = old.join(new, F.col(self.key).eqNullSafe(F.col(f"_new_{self.key}")), "full_outer" if insert else "left_outer")
        value = lambda c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) if c in named else F.col(c)
        self._write(joined.select(*[value(c).alias(c) for c in self.columns]))
        return touched

    def insert_new(self, incoming: DataFrame, order: str | None = None) -> list[int]:
        """Add rows of unseen keys; the buckets rewritten. Keys already stored keep their rows, a null key is one key."""
        incoming = dedupe_keep_last(incoming, self.key, order) if order else incoming
        stored = self._read().select(F.col(self.key).alias("_key"), "bucket")
        touched = self._touched(incoming)
        known = stored.where(F.col("bucket").isin(touched)).select("_key")
        fresh = incoming.join(known, F.col(self.key).eqNullSafe(F.col("_key")), "left_anti").select(*self.columns)
        changed = self._touched(fresh)
        if changed:
            part = F.col("bucket").isin(changed)
            kept = self._read().where(part).select(*self.columns)
            self._write(kept.unionByName(fresh))
        return changed
