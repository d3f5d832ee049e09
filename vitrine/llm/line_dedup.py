"""Line dedup by distinct-site spread: lines that stand on many sites, in as many different texts, are boilerplate.

HyperLogLog sketches of the sites and of the texts merge per line hash by aggregation; lines whose estimate lies near the
threshold get exact distinct counts. A text that is copied to many sites is one text, so whole copies don't make their lines
boilerplate. DataFrame code throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import forget, written

#: Sites on which a line must stand to be boilerplate.
MIN_SITES = 8
#: log2 of a sketch's registers, and the relative error (about five standard deviations) within which lines are counted.
LG_K, NEAR = 12, 0.08
#: Parts over which the rows of a line are dealt.
SALT = 16
_KEY = ["k1", "k2"]


def line_keys(line: Column) -> list[Column]:
    """128 hash bits of the line without outer blanks."""
    bare = F.btrim(line, F.lit(" \t\r"))
    return [F.xxhash64(bare).alias("k1"), F.xxhash64(F.lit(1), bare).alias("k2")]


def _held(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The ``rows`` whose line is one of ``keys`` (distinct). A line that many rows hold is dealt over SALT tasks."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c not in _KEY]), F.lit(SALT)))
    every = keys.select(*_KEY, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))).alias("salt"))
    return salted.join(every, [*_KEY, "salt"], "left_semi").drop("salt")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Keys (``k1``, ``k2``) of the lines on at least ``min_sites`` distinct sites and in as many distinct texts, from rows of (``k1``,
    ``k2``, ``site``, ``text``, ...), ``text`` a hash of the whole text that holds the line.

    Null sites count for nothing, nor do their texts. Lines on too few rows, on one site or in one text are dropped by plain
    counts before any sketch is made."""
    ends = [f(c).alias(f"{c}{i}") for c in ("site", "text") for i, f in enumerate((F.min, F.max))]
    often = lines.where("site IS NOT NULL").groupBy(*_KEY).agg(F.count("*").alias("n"), *ends)
    often = often.where((F.col("n") >= min_sites) & (((F.col("site0") < F.col("site1")) & (F.col("text0") < F.col("text1"))) | F.lit(min_sites <= 1))).select(*_KEY)
    seen = written(_held(lines.where("site IS NOT NULL"), often).select(*_KEY, "site", "text"), "line-sites")
    spread = seen.groupBy(*_KEY).agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(c, LG_K)).alias(c) for c in ("site", "text")])
    few = F.least("site", "text")
    spread = written(spread.where(few >= min_sites * (1 - NEAR) - 1), "line-spread")
    sure = few > min_sites * (1 + NEAR) + 1
    close = _held(seen, spread.where(~sure))
    exact = [close.groupBy(*_KEY, c).count().groupBy(*_KEY).agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select(*_KEY) for c in ("site", "text")]
    return spread.where(sure).select(*_KEY).unionByName(exact[0].join(exact[1], _KEY, "left_semi"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """Remove boilerplate lines from ``docs`` (``doc_id``, ``text``, ``site``); other columns pass through, whatever their names.

    Lines are split at ``\\n``; blank ones are never boilerplate. A line that stands on ``min_sites`` sites, in as many different
    texts, goes from every document, whatever share of it that is: a page of nothing else becomes empty, and of near copies
    on as many sites their common lines go too, while exact copies keep theirs. ``text`` becomes the remaining lines;
    ``n_lines`` and ``n_removed`` are added, in the place of columns of these names. Null texts stay null with 0 and 0. Rows with
    equal id and text are one for the removal and stay as many; null ids are ordinary. An empty table gives no rows."""
    text = F.col("_row.text")
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    key = {"_h": F.xxhash64(text), "_c": F.crc32(text.cast("binary"))}
    lines = rows.where(text.isNotNull()).select(F.col("_row.doc_id").alias("_d"), *[c.alias(n) for n, c in key.items()], F.col(f"_row.{site}").cast("string").alias("site"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    lines = lines.where(F.btrim("line", F.lit(" \t\r")) != "").withColumn("text", F.col("_h"))
    lines = written(lines.select("_d", "_h", "_c", "site", "text", "pos", *line_keys(F.col("line"))), "lines")
    common = written(boilerplate(lines, min_sites), "boilerplate")
    # rows of one id and text repeat their lines
    gone = written(_held(lines, common).groupBy("_d", "_h", "_c").agg(F.collect_set("pos").alias("_gone")), "gone")
    forget(lines)
    same = [F.col("a._row.doc_id").eqNullSafe(F.col("b._d")), *[F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("_h", "_c")]]
    d = rows.withColumns(key).alias("a").join(gone.alias("b"), same, "left").select("_row", "_gone")
    d = d.withColumn("_all", F.split(text, "\n"))
    left = F.expr("array_except(sequence(0, size(_all) - 1), _gone)")
    d = d.withColumn("_left", F.when(F.col("_gone").isNotNull(), F.transform(left, lambda i: F.element_at("_all", i + 1))))
    made = {"text": F.when(F.col("_left").isNotNull(), F.array_join("_left", "\n")).otherwise(text)}
    added = {"n_lines": F.coalesce(F.size("_all"), F.lit(0)).cast("long"), "n_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("long")}
    kept = [made.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns if c not in added]
    return d.select(*kept, *[c.alias(n) for n, c in added.items()])
