"""Sources and sinks. Paths may be in any store that Spark reads."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """JSON lines under an explicit schema; ``tolerant`` skips blank and broken lines, else they fail."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A JSON object file as rows ``key, value``; a missing file has none. ``value`` is the values' type."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], f"key string, value {value}")
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def yaml_dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A YAML list of mappings, as a small table; a hand-kept file, parsed on the driver."""
    import yaml

    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    return spark.createDataFrame(spark.sparkContext.parallelize([json.dumps(x) for x in yaml.safe_load(text) or []], 1).map(lambda x: (x,)), "j string").select(F.from_json("j", schema).alias("r")).select("r.*")


def feed_items(pages: DataFrame, html: str = "html") -> DataFrame:
    """Image links of a feed's text, one per row, the small form of an address replaced by the large one."""
    links = F.regexp_extract_all(F.col(html), F.lit(r'<img[^>]+src="([^"]+)"'), F.lit(1))
    return pages.select(*[c for c in pages.columns if c != html], F.explode(links).alias("_src")).withColumn("src", F.replace("_src", F.lit("/236x/"), F.lit("/564x/"))).drop("_src")


def report(df: DataFrame, path: str, *order: str) -> None:
    """A short ordered report as one JSON file."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").json(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def overwrite_keys(df: DataFrame, path: str, key: str) -> None:
    """Replace the partitions of the keys in ``df`` and leave the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        root = f"file://{tempfile.mkdtemp(prefix='vitrine-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex[:12]}"
