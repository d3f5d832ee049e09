"""Vector expressions over ``array<float>`` or ``array<double>``; sums are double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Divided by its norm; a zero vector stays."""
    norm = F.coalesce(F.nullif(F.sqrt(dot(v, v)), F.lit(0.0)), F.lit(1.0))
    return F.transform(v, lambda x: x.cast("double") / norm)


def with_zscore(df: DataFrame, value: str, out: str, by: tuple[str, ...] = (), guard: bool = False, few: bool = False) -> DataFrame:
    """Add ``(value - mean) / deviation`` over all rows, or each group of ``by``.

    With ``guard`` a deviation up to 1e-6 counts as 1, else 1e-6 is added to it. The statistics are one row, or
    one per group: they aggregate on the map side and are joined back. With ``few``, groups are those of a hand-held list (traits,
    anchors, names): their statistics are broadcast, and no row of ``df`` is shuffled for them."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_sd"))
    sd = F.when(F.col("_sd") > 1e-6, F.col("_sd")).otherwise(1.0) if guard else F.col("_sd") + 1e-6
    both = df.join(F.broadcast(stats) if few else stats, list(by)) if by else df.crossJoin(F.broadcast(stats))
    return both.withColumn(out, (F.col(value) - F.col("_m")) / sd).drop("_m", "_sd")


def mean_vector(df: DataFrame, vec: str, by: list[str]) -> DataFrame:
    """Element-wise mean per group as a unit vector: ``by..., vec``."""
    parts = df.select(*by, F.posexplode(vec).alias("_i", "_x")).groupBy(*by, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_x"))
    rows = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_v"))
    return rows.select(*by, unit(F.transform("_v", lambda s: s["_x"])).alias("vec"))
