"""Saved store pages: one JSON file a page, in a folder for each store's domain, as a store's paged endpoint returned it.

Pages are read by Spark's own file source, so they may lie in any store that Spark reads, are planned like any table, and
can be followed as a stream. A page that is broken or says nothing is a row with the kind of error, never a lost one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Items of a whole page, and items taken of a store.
PAGE_ROWS, STORE_ROWS = 250, 120
_FILES = "path string, modificationTime timestamp, length long, content binary"


def _pages(files: DataFrame) -> DataFrame:
    text = F.decode("content", "UTF-8")
    # each product stays the text that it is in the file
    listed = F.from_json(text, "struct<products: array<string>>")["products"]
    error = F.when(text.rlike(r"\A\s*\z"), "empty").when(F.try_parse_json(text).isNull(), "torn").when(listed.isNull(), "no products")
    domain = F.url_decode(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    page = F.regexp_extract("path", r"/([0-9]{1,9})\.json$", 1)
    d = files.select(domain.alias("domain"), F.nullif(page, F.lit("")).cast("int").alias("page"), F.col("modificationTime").alias("changed"), error.alias("error"), listed.alias("_l"))
    return d.where("page IS NOT NULL").withColumn("products", F.when(F.col("error").isNull(), F.col("_l"))).drop("_l")


def pages(spark: SparkSession, path: str) -> DataFrame:
    """The saved pages under ``path`` (``<domain>/<number>.json``; other files are none): ``domain, page, changed, error, products``.

    ``error`` is null, ``empty`` (blank), ``torn`` (no whole JSON) or ``no products`` (it lists none); ``products`` are the JSON texts of the
    list's elements, null beside an error. A file without a byte is no page: Spark's readers leave it out."""
    return _pages(spark.read.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.json").load(f"{path.rstrip('/')}/*"))


def arriving(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The same rows as a stream: each trigger brings pages that have come since; a query's checkpoint knows which have."""
    source = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files_per_trigger)
    return _pages(source.load(f"{path.rstrip('/')}/*"))


def taken(found: DataFrame, limit: int = STORE_ROWS) -> DataFrame:
    """The pages that a reader who goes page by page takes: from 1 on, until one is missing, broken or empty, after a page of fewer
    than PAGE_ROWS, or when ``limit`` products are reached; ``before`` is how many were taken earlier.

    A store's page numbers and sizes are gathered, never its products."""
    size = F.when(F.col("error").isNull(), F.size("products")).otherwise(0).cast("long")
    sizes = found.where(size > 0).groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("page", size.alias("n")))).alias("_s"))
    state = lambda page, rows, over: F.struct(page.alias("next"), rows.cast("long").alias("rows"), over.alias("over"))

    def step(s: Column, p: Column) -> Column:
        rows = s["rows"] + p["n"]
        taken_too = state(s["next"] + 1, rows, (rows >= limit) | (p["n"] < PAGE_ROWS))
        return F.when(~s["over"] & (p["page"] == s["next"]), taken_too).otherwise(state(s["next"], s["rows"], F.lit(True)))

    last = sizes.select(F.col("domain").alias("_d"), (F.aggregate("_s", state(F.lit(1), F.lit(0), F.lit(False)), step)["next"] - 1).alias("_last"))
    before = F.sum(F.size("products")).over(Window.partitionBy("domain").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    d = found.join(last, (F.col("domain") == F.col("_d")) & (F.col("page") <= F.col("_last"))).drop("_d", "_last")
    return d.withColumn("before", F.coalesce(before, F.lit(0)))


def products(spark: SparkSession, path: str, raw_schema: str, limit: int = STORE_ROWS) -> DataFrame:
    """``domain`` and the columns of ``raw_schema`` of the first ``limit`` products of each store, in page order. A product that
    isn't an object has nulls."""
    d = taken(pages(spark, path), limit)
    left = F.greatest(F.lit(limit) - F.col("before"), F.lit(0)).cast("int")
    return parsed(d.withColumn("products", F.slice("products", F.lit(1), left)), raw_schema)


def parsed(found: DataFrame, raw_schema: str) -> DataFrame:
    """The products of pages, with their ``domain``; batch or stream."""
    one = found.where("error IS NULL").select("domain", F.explode("products").alias("_p"))
    return one.select("domain", F.from_json("_p", StructType.fromDDL(raw_schema)).alias("_r")).select("domain", "_r.*")


def store_status(stores: DataFrame, found: DataFrame) -> DataFrame:
    """Rows per store of ``stores`` (``domain``): the crawl report."""
    n = found.groupBy("domain").agg(F.count("*").alias("rows"))
    return stores.select("domain").join(n, "domain", "left").select("domain", F.coalesce("rows", F.lit(0)).alias("rows"), F.when(F.col("rows") > 0, "ok").otherwise("empty").alias("status"))


def page_errors(found: DataFrame) -> DataFrame:
    """The pages that gave nothing, and why."""
    return found.where("error IS NOT NULL").select("domain", "page", "error")
