"""What the catalogue's jobs write, in versions: a reader sees the version before or the one after, never half of one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions import text as T
from vitrine.operators import profiles
from vitrine.sources.keyed import KeyedTable
from vitrine.sources.versions import Manifest, Versions, grown


class CatalogueSink:
    """Products, crawl reports, accepted stores and brand signals under one root, so that they can change together."""

    def __init__(self, spark: SparkSession, root: str):
        self.versions = Versions(spark, root)

    def crawl(self, products: DataFrame, report: DataFrame) -> Manifest:
        """Replace the products and their report in one step."""
        base = self.versions.manifest()
        return self.versions.commit(base, {"products": self.versions.write("products", products), "report": self.versions.write("report", report)})

    def accept(self, stores: DataFrame, key: str = "domain") -> Manifest:
        """Add accepted stores; those that the list has by domain stay as they are, and of equal new ones the first by name comes in."""
        base = self.versions.manifest()
        rest = [c for c in stores.columns if c != key]
        new = stores.groupBy(T.domain(key).alias(key)).agg(F.min(F.struct(*rest)).alias("_s")).select(key, "_s.*").select(*stores.columns)
        entry = base.tables.get("stores")
        if entry:
            new = new.join(self.versions.read("stores", manifest=base).select(key), key, "left_anti").select(*stores.columns)
        return self.versions.commit(base, {"stores": grown(entry, self.versions.write("stores", new))})

    def signals(self, rows: DataFrame) -> Manifest:
        return self.versions.replace("signals", rows)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.versions.read(table, version).drop("part")


def guarded(pid: Column | str) -> Column:
    """The id, if it is one of a profile; else the job fails, and with it the write."""
    p = F.col(pid) if isinstance(pid, str) else pid
    return F.when(F.coalesce(profiles.valid_id(p), F.lit(False)), p).otherwise(F.raise_error(F.concat(F.lit("no profile id: "), F.coalesce(p, F.lit("null")))).cast("string"))


class ProfileSink:
    """Profiles by id (``pid``), replaced one by one; ids that aren't valid are refused by the writer, whoever calls it."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.table = KeyedTable(spark, root, "pid", buckets)

    def put(self, rows: DataFrame) -> Manifest:
        return self.table.put(rows.withColumn("pid", guarded("pid")))

    def get(self, pids: list[str]) -> DataFrame:
        return self.table.lookup(pids)
