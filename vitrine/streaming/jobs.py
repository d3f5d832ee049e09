"""Streams over profile events and usage logs; each gives what its batch form gives over the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitrine.operators.inverted import SearchIndex


def fold(events: DataFrame) -> DataFrame:
    """Per profile and key: events, first and last time, and the last kind; batch or stream."""
    return events.groupBy("pid", "key").agg(
        F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.max_by("kind", F.struct("ts", "event_id")).alias("last_kind")
    )


def visits(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions per profile; state is dropped once events of a session can no longer arrive."""
    return events.withWatermark("ts", late).groupBy("pid", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("pid", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def cost_meter(log: DataFrame) -> DataFrame:
    return log.groupBy("kind").agg(F.count("*").alias("calls"), F.sum("cost_usd").alias("cost_usd"))


def incremental_index(products: DataFrame, cache_path: str, encode, checkpoint: str) -> StreamingQuery:
    """Encode what the cache lacks, batch by batch. ``encode`` adds ``vec`` to rows with ``image_key``.

    A batch that is run again after a failure finds its keys in the cache."""

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("image_key", F.sha1(F.col("image").cast("binary"))).dropDuplicates(["image_key"])
        try:
            new = new.join(spark.read.parquet(cache_path).select("image_key"), "image_key", "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        encode(new).select("image_key", "vec").write.mode("append").parquet(cache_path)

    return products.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def search_index(docs: DataFrame, index: SearchIndex, checkpoint: str) -> StreamingQuery:
    """Merge documents into a search index as they arrive, and rewrite it when too much of it is dead.

    The index knows the last batch that it holds, so one that is run again after a failure is not merged twice. Of a key that
    stands twice in a batch the row with the greatest values counts; a later batch replaces an earlier one."""

    def step(batch: DataFrame, number: int) -> None:
        done = index.facts.get("batches", {})
        if done.get(checkpoint, -1) >= number or batch.isEmpty():
            return
        rest = [c for c in batch.columns if c != index.key]
        one = batch.groupBy(index.key).agg(F.max(F.struct(*rest)).alias("_r")).select(index.key, "_r.*")
        index.merge(one, {"batches": {**done, checkpoint: number}})
        index.compact()

    return docs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_memory(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run over all that is there and return the result as a table; for small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run an aggregation over all that is there; each batch replaces the table at ``path``, so the result never passes the
    driver."""
    query = stream.writeStream.foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(path)).outputMode("complete")
    query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
