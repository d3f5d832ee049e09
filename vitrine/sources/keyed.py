"""Tables that are looked up by key: rows lie in one folder for each bucket of the key's hash, so a lookup opens only the
buckets of the keys that are asked for, and within them the row groups that may hold them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from vitrine.sources.versions import Manifest, Versions, grown


def bucket(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def buckets_of(spark: SparkSession, keys: Sequence, kind: str, buckets: int) -> list[int]:
    """The buckets of literal keys: folded by the optimizer, without a job."""
    if not keys:
        return []
    row = spark.range(1).select(*[bucket(F.lit(k).cast(kind), buckets).alias(f"b{i}") for i, k in enumerate(keys)]).first()
    return sorted(set(row))


def laid_out(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``df`` with ``bucket``, brought together by bucket and sorted by key. Parts of a large bucket are split, small ones joined."""
    d = df.withColumn("bucket", bucket(key, buckets)).hint("rebalance", F.col("bucket"))
    return d.sortWithinPartitions("bucket", key)


def among(df: DataFrame, key: str, keys: Sequence, buckets: int) -> DataFrame:
    """The rows of a table laid out by ``key`` whose key is one of ``keys``: partition filters on buckets, pushed ones on the key."""
    kind = dict(df.dtypes)[key]
    if not keys:
        return df.where(F.lit(False))
    return df.where(F.col("bucket").isin(buckets_of(df.sparkSession, keys, kind, buckets)) & F.col(key).isin(list(keys)))


class KeyedTable:
    """One row for each key, written in versions. ``buckets`` is fixed when the table is first written."""

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = 64):
        self.versions, self.key = Versions(spark, root), key
        self.buckets = self.versions.manifest().facts.get("buckets", buckets)

    def _facts(self, base: Manifest, facts: dict | None) -> dict:
        return {**base.facts, **(facts or {}), "buckets": self.buckets}

    def write(self, df: DataFrame, facts: dict | None = None) -> Manifest:
        """The table becomes ``df``, which has one row for each key."""
        base = self.versions.manifest()
        return self.versions.commit(base, {"rows": self.versions.write("rows", laid_out(df, self.key, self.buckets), ("bucket",))}, self._facts(base, facts))

    def add(self, df: DataFrame, facts: dict | None = None) -> Manifest:
        """Rows of keys that the table lacks; what is there isn't read. A key that it has would then stand twice."""
        base = self.versions.manifest()
        part = self.versions.write("rows", laid_out(df, self.key, self.buckets), ("bucket",))
        return self.versions.commit(base, {"rows": grown(base.tables.get("rows"), part)}, self._facts(base, facts))

    def put(self, df: DataFrame) -> Manifest:
        """Insert or replace by key. The last part wins, so the other keys are carried over in the same write."""
        if not self.versions.manifest().version:
            return self.write(df)
        old = self.rows()
        return self.write(old.join(df.select(self.key), self.key, "left_anti").unionByName(df))

    def rows(self, version: int | None = None) -> DataFrame:
        return self.versions.read("rows", version).drop("part", "bucket")

    def lookup(self, keys: Sequence) -> DataFrame:
        """One row for each distinct key asked for, in no order; a key that isn't there has nulls. ``keys`` are a request's, so few."""
        spark, table = self.versions.spark, self.versions.read("rows")
        keys = list(dict.fromkeys(keys))
        asked = spark.createDataFrame([(k,) for k in keys], ST.StructType([ST.StructField(self.key, table.schema[self.key].dataType)]))
        return asked.join(among(table, self.key, [k for k in keys if k is not None], self.buckets).drop("part", "bucket"), self.key, "left")
