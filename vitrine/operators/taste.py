"""Taste: anchors from a profile, refinement of traits, and the feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions import vector as V
from vitrine.operators import recommend, records
from vitrine.operators.encoders import Encoder, encoded


def anchors(items: DataFrame, liked_brands: DataFrame, images: DataFrame, liked: DataFrame, skipped: DataFrame, encoder: Encoder | None = None, known: DataFrame | None = None) -> DataFrame:
    """``anchor, q, positive``: centroids of liked brands (``brand``), image vectors (``id, vec``), and liked and skipped items (``id``).

    A liked brand without items has the vector of its description (``known``: ``name, description``, else a sentence with its name) if there is
    an ``encoder``, and drops out without one, as unknown items do. What a profile likes is a short list, yet it is joined by
    whatever way its size calls for."""
    wanted = liked_brands.select(F.trim("brand").alias("_n"), F.lower(F.trim("brand")).alias("_b")).dropDuplicates(["_b"])
    mine = items.join(wanted.select("_b"), F.lower(F.trim("brand")) == F.col("_b"), "left_semi")
    means = V.mean_vector(mine, "vec", ["brand"])
    brand = means.select(F.concat(F.lit("brand:"), "brand").alias("anchor"), F.col("vec").alias("q"), F.lit(True).alias("positive"))
    double = F.transform("vec", lambda x: x.cast("double"))
    image = images.select(F.concat(F.lit("image:"), F.col("id").cast("string")).alias("anchor"), double.alias("q"), F.lit(True).alias("positive"))
    of = lambda ids, yes: items.join(ids.select("id").distinct(), "id", "left_semi").select(F.concat(F.lit("item:" if yes else "skip:"), F.col("id").cast("string")).alias("anchor"), double.alias("q"), F.lit(yes).alias("positive"))
    out = brand.unionByName(image).unionByName(of(liked, True)).unionByName(of(skipped, False))
    if encoder is None:
        return out
    none = known if known is not None else liked_brands.sparkSession.createDataFrame([], "name string, description string")
    unseen = wanted.join(means.select(F.lower(F.trim("brand")).alias("_b")), "_b", "left_anti").select(F.col("_n").alias("name"))
    said = records.descriptions(unseen, none, none.limit(0)).withColumn("vec", encoded(F.col("description"), encoder))
    return out.unionByName(said.select(F.concat(F.lit("brand:"), "name").alias("anchor"), double.alias("q"), F.lit(True).alias("positive")))


def feed(items: DataFrame, anchor: DataFrame, exclude_brands: DataFrame, exclude_ids: DataFrame, pid: str, limit: int = 48) -> DataFrame:
    """The ranked feed of a profile with the anchor that explains each piece; without anchors, the cold start."""
    known = items.join(exclude_brands.select(F.lower("brand").alias("_b")).distinct(), F.lower("brand") == F.col("_b"), "left_anti")
    known = known.where("available").join(exclude_ids.select("id").distinct(), "id", "left_anti")
    if anchor.isEmpty():
        return recommend.cold_start(known, limit).select("id", "brand", F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("because"))
    # means and deviations are over the whole catalog
    s = recommend.taste_scores(items, anchor).join(known.select("id", "vec"), "id").withColumn("pid", F.lit(pid))
    return recommend.rank_feed(s, limit).join(s.select("id", "because"), "id").orderBy("position").select("id", "brand", "score", "because")


def refined(traits: DataFrame, polished: DataFrame, kinds: tuple[str, ...] = ("image", "quiz", "pin")) -> DataFrame:
    """Replace what images, quizzes and pins gave by polished texts (``text``) that carry all their sources.

    ``traits``: ``text, sources array<struct<kind,ref>>, user_added``."""
    own = F.filter("sources", lambda s: ~s["kind"].isin(*kinds))
    gone = traits.select(F.explode(F.filter("sources", lambda s: s["kind"].isin(*kinds))).alias("s")).select("s.kind", "s.ref").distinct()
    all_sources = gone.agg(F.array_sort(F.collect_list(F.struct("kind", "ref"))).alias("sources"))
    kept = traits.withColumn("sources", own).where((F.size("sources") > 0) | F.col("user_added"))
    new = polished.select("text").distinct().crossJoin(F.broadcast(all_sources)).withColumn("user_added", F.lit(False))
    both = kept.unionByName(new.select(kept.columns))
    return both.groupBy("text").agg(F.array_distinct(F.flatten(F.collect_list("sources"))).alias("sources"), F.max("user_added").alias("user_added"))
