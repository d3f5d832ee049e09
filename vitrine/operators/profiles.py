"""Shopper profiles as folds of an event log ``event_id, pid, ts, kind, key``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROFILE_ID = r"\A[a-f0-9]{32}\z"


def latest(events: DataFrame, by: list[str], order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The last event of each key. An aggregation, so it combines before the shuffle and one key's events never meet
    in a window."""
    rest = [c for c in events.columns if c not in by]
    best = events.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_e"))
    return best.select(*by, "_e.*")


def saved(events: DataFrame, add: str, remove: str) -> DataFrame:
    """Keys whose last event is ``add``, newest first: ``pid, key, ts``."""
    last = latest(events.where(F.col("kind").isin(add, remove)), ["pid", "key"])
    return last.where(F.col("kind") == add).select("pid", "key", "ts")


def after_reset(events: DataFrame, reset: str) -> DataFrame:
    """Events after the profile's last reset."""
    at = events.where(F.col("kind") == reset).groupBy("pid").agg(F.max(F.struct("ts", "event_id")).alias("_r"))
    d = events.join(at, "pid", "left").where(F.col("_r").isNull() | (F.struct("ts", "event_id") > F.col("_r")))
    return d.drop("_r")


def discovered(events: DataFrame) -> DataFrame:
    """Per profile and key: first and last time, count, and the kind that came first."""
    first = F.min_by("kind", F.struct("ts", "event_id")).alias("via")
    return events.groupBy("pid", "key").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"), first)


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys added and removed, letter case aside: ``key, change``."""
    a, b = (d.select(F.lower(F.trim(key)).alias("key")).distinct() for d in (old, new))
    added = b.join(a, "key", "left_anti").select("key", F.lit("added").alias("change"))
    return added.unionByName(a.join(b, "key", "left_anti").select("key", F.lit("removed").alias("change")))


def upserted(table: DataFrame, changed: DataFrame, key: str, order: str) -> DataFrame:
    """Latest row per key of both; a latest row with a null ``value`` deletes."""
    rows = table.unionByName(changed)
    rest = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return last.select(key, "_r.*").where("value IS NOT NULL")


def with_sources(traits: DataFrame, entries: DataFrame) -> DataFrame:
    """Merge ``entries`` (``text, kind, ref``) into traits (``text, sources array<struct<kind,ref>>``): sources are added
    if absent, new texts become traits."""
    new = entries.groupBy("text").agg(F.array_sort(F.collect_set(F.struct("kind", "ref"))).alias("_new"))
    d = traits.join(new, "text", "full_outer")
    none = F.array().cast("array<struct<kind:string,ref:string>>")
    return d.withColumn("sources", F.array_union(F.coalesce("sources", none), F.coalesce("_new", none))).drop("_new")


def without_source(traits: DataFrame, kind: str, ref: str) -> DataFrame:
    """Forget a source; traits left without any go, unless a user added them."""
    left = F.filter("sources", lambda s: ~((s["kind"] == kind) & (s["ref"] == ref)))
    return traits.withColumn("sources", left).where((F.size("sources") > 0) | F.col("user_added"))


def valid_id(pid: Column) -> Column:
    return pid.rlike(PROFILE_ID)


def saved_cards(saved_keys: DataFrame, items: DataFrame) -> DataFrame:
    """Cards of a profile's saved items (``pid, key, ts``), the last saved first: ``position`` from 0; unknown ids drop out."""
    d = saved_keys.join(items, F.col("key") == F.col("id"))
    order = Window.partitionBy("pid").orderBy(F.desc("ts"), "key")
    return d.withColumn("position", F.row_number().over(order) - 1).withColumn("saved", F.lit(True)).drop("key", "ts")


def recent_brands(found: DataFrame, items: DataFrame, stores: DataFrame, traits: DataFrame, previews: int = 4) -> DataFrame:
    """Discovered brands (``pid, brand, last``), the latest first: ``domain`` and ``tags`` of the store (``name, domain, tags``), ``in_stock`` and the first
    ``preview`` pictures of its items in stock, and the cached ``traits`` (``key, traits``); what is missing is empty, or null for the
    domain. A brand's items are cut to its first few before the shuffle."""
    stock = items.where("available")
    counts = stock.groupBy("brand").agg(F.count("*").alias("in_stock"))
    first = stock.withColumn("_n", F.row_number().over(Window.partitionBy("brand").orderBy("id"))).where(F.col("_n") <= previews)
    shown = first.groupBy("brand").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "image"))), lambda x: x["image"]).alias("preview"))
    known = stores.groupBy(F.col("name").alias("brand")).agg(F.max_by(F.struct("domain", "tags"), F.coalesce("domain", F.lit(""))).alias("_m"))
    d = found.join(counts, "brand", "left").join(shown, "brand", "left").join(known, "brand", "left").withColumn("_k", F.lower("brand"))
    d = d.join(traits.select(F.col("key").alias("_k"), "traits"), "_k", "left")
    none = F.array().cast("array<string>")
    d = d.withColumns({"domain": F.col("_m.domain"), "tags": F.coalesce("_m.tags", none), "in_stock": F.coalesce("in_stock", F.lit(0)), "preview": F.coalesce("preview", none), "traits": F.coalesce("traits", none)}).drop("_m", "_k")
    return d.withColumn("position", F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("last"), "brand")) - 1)


def new_pins(pins: DataFrame, have: DataFrame) -> DataFrame:
    """Pins (``n, source, link``) whose picture the profile lacks (``have``: ``source``), one per picture: its last link."""
    fresh = pins.join(have.select("source").distinct(), "source", "left_anti")
    return fresh.groupBy("source").agg(F.max_by("link", "n").alias("link"))


def traits_added(traits: DataFrame, new: DataFrame) -> DataFrame:
    """Add ``new`` traits (``pid, trait_id, text``): a text that the profile has, or that came earlier by id, is refused."""
    first = new.groupBy("pid", "text").agg(F.min("trait_id").alias("trait_id"))
    fresh = first.join(traits.select("pid", "text").distinct(), ["pid", "text"], "left_anti").withColumn("enabled", F.lit(True)).withColumn("user_added", F.lit(True))
    return traits.unionByName(fresh, allowMissingColumns=True)


def traits_patched(traits: DataFrame, patches: DataFrame) -> DataFrame:
    """Apply patches (``trait_id, n, enabled, text``; null: as before): the last one given of each field holds. A changed
    text has ``encode`` true: its vector is to be made anew."""
    last = patches.groupBy("trait_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("n"))).alias(f"_{c}") for c in ("enabled", "text")])
    d = traits.join(last, "trait_id", "left").withColumn("encode", F.coalesce(F.col("_text") != F.col("text"), F.lit(False)))
    return d.withColumns({c: F.coalesce(f"_{c}", c) for c in ("enabled", "text")}).drop("_enabled", "_text")


def traits_deleted(traits: DataFrame, ids: DataFrame) -> DataFrame:
    return traits.join(ids.select("trait_id").distinct(), "trait_id", "left_anti")


def with_picks(profiles: DataFrame, picked: DataFrame, items: DataFrame) -> DataFrame:
    """Profiles (``pid, quiz_picks``) with the pieces picked in a quiz (``pid, n, id``) after those that they have, each once, in the order of ``n``;
    unknown pieces don't count. A quiz shows a few dozen pieces, so picks are a short list."""
    real = picked.join(items.select("id"), "id", "left_semi").groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("n", "id"))).alias("_new"))
    d = profiles.join(real, "pid", "left")
    both = F.concat(F.coalesce("quiz_picks", F.array().cast(profiles.schema["quiz_picks"].dataType)), F.transform("_new", lambda x: x["id"]))
    return d.withColumn("quiz_picks", F.when(F.col("_new").isNull(), F.col("quiz_picks")).otherwise(F.array_distinct(both))).drop("_new")


def with_defaults(given: Column, defaults: Column) -> Column:
    """A map with the defaults of the keys that it lacks."""
    return F.map_zip_with(F.coalesce(given, F.create_map().cast("map<string,string>")), defaults, lambda k, a, b: F.coalesce(a, b))


def settings(given: Column, allowed: tuple[str, ...]) -> Column:
    """Only the entries that a user may set and that say something; a currency in capitals."""
    said = F.map_filter(given, lambda k, v: k.isin(*allowed) & (F.coalesce(v, F.lit("")) != ""))
    return F.transform_values(said, lambda k, v: F.when(k == "currency", F.upper(v)).otherwise(v))
