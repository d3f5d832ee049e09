"""Registered queries of records, totals, curation lists and profiles, each with DuckDB SQL; stand-ins as in ``catalogue``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators import curate, encoders, profiles, records, search
from vitrine.plans import catalogue as C

_Q, _SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _products(spark: SparkSession, d: str) -> DataFrame:
    """Parts as records with gaps: no brand on one, no images or sizes on some, a document as description."""
    name, key = F.col("p_name"), F.col("p_partkey")
    words, none = F.split(name, " "), F.array().cast("array<string>")
    shots = F.transform(F.sequence(F.lit(0), F.col("p_size") % 9), lambda i: F.concat(F.lit("img"), i.cast("string")))
    text = C._t(spark, d, "documents").select(F.col("doc_id").alias("p_partkey"), "text")
    return C._t(spark, d, "part").join(text, "p_partkey", "left").select(
        key.alias("id"), F.nullif("p_brand", F.lit("Brand#11")).alias("brand"), F.lit(None).cast("string").alias("domain"), name.alias("title"), F.concat(F.lit("/p/"), key.cast("string")).alias("url"),
        F.lit("first").alias("image"), F.col("p_retailprice").alias("price"), F.lit("USD").alias("currency"), F.col("p_type").alias("product_type"), (F.col("p_size") > 3).alias("available"),
        F.when(F.col("p_size") > 3, F.array(F.lit("M"))).otherwise(none).alias("sizes_in_stock"), F.when(F.col("p_size") > 1, F.array(F.lit("M"))).otherwise(none).alias("sizes_offered"),
        F.when(key % 10 > 0, F.concat(words, words, words, words)).alias("tags"), F.when(key % 7 > 0, shots).alias("images"), F.col("text").alias("description"), F.lit("v").alias("vendor"), F.lit("t").alias("published_at"),
    )


@query("""SELECT p_partkey AS id, coalesce(nullif(p_brand, 'Brand#11'), '') AS brand, '' AS domain, p_type AS product_type,
array_to_string(CASE WHEN p_partkey % 10 > 0 THEN list_concat(string_split(p_name, ' '), string_split(p_name, ' '), string_split(p_name, ' '), string_split(p_name, ' '))[1:6] ELSE [] END, '|') AS tags,
array_to_string(CASE WHEN p_partkey % 7 > 0 THEN list_transform(range(0, least(p_size % 9 + 1, 5)), lambda i: 'img' || i) ELSE ['first'] END, '|') AS images,
CASE WHEN p_partkey % 7 > 0 THEN 'img0' ELSE 'first' END AS image, left(coalesce(text, ''), 400) AS description FROM part LEFT JOIN documents ON doc_id = p_partkey""")
def full_records(spark, d):
    """A card's description is at most 400 characters long: that is the record's shape."""
    r = records.full(_products(spark, d))
    return r.select("id", "brand", "domain", "product_type", F.array_join("tags", "|").alias("tags"), F.array_join("images", "|").alias("images"), "image", "description")


@query("""SELECT p_partkey AS id, coalesce(nullif(p_brand, 'Brand#11'), '') AS brand, '' AS domain, p_name AS title, '/p/' || p_partkey AS url, CASE WHEN p_partkey % 7 > 0 THEN 'img0' ELSE 'first' END AS image, p_retailprice AS price,
'USD' AS currency, p_type AS product_type, p_size > 3 AS available, CASE WHEN p_size > 3 THEN 'M' ELSE '' END AS sizes_in_stock, CASE WHEN p_size > 1 THEN 'M' ELSE '' END AS sizes_offered FROM part""")
def lean_items(spark, d):
    return records.lean(_products(spark, d)).withColumns({c: F.array_join(c, "|") for c in ("sizes_in_stock", "sizes_offered")})


@query(f"""WITH {C._SCORED}, {C._PAGE}, p AS (SELECT brand FROM r ORDER BY (rk > 2), r.score DESC, id LIMIT 24)
SELECT count(*) AS total, ceil(count(*) / 24)::BIGINT AS pages, (SELECT count(DISTINCT brand) FROM p) AS brands_on_page FROM r""")
def page_totals(spark, d):
    found = C._found(spark, d)
    return records.totals(found, search.first_page(found))


_STORES = "m AS (SELECT DISTINCT p_brand AS name, replace(lower(p_brand), '#', '') || '.com' AS domain FROM part WHERE p_brand < 'Brand#41')"


def _stores(spark: SparkSession, d: str) -> DataFrame:
    b = C._t(spark, d, "part").where("p_brand < 'Brand#41'").select(F.col("p_brand").alias("name")).distinct()
    return b.withColumns({"domain": F.concat(F.replace(F.lower("name"), F.lit("#"), F.lit("")), F.lit(".com")), "tags": F.array(F.lit("knit"), F.lower("name"))})


@query(f"WITH {_STORES} SELECT p_brand AS name, domain, CASE WHEN domain IS NULL THEN '' ELSE 'knit|' || lower(p_brand) END AS tags, count(*) AS count FROM part LEFT JOIN m ON m.name = p_brand GROUP BY ALL")
def brand_list(spark, d):
    items = C._t(spark, d, "part").select(F.col("p_brand").alias("brand"))
    return records.brand_list(items, _stores(spark, d)).withColumn("tags", F.array_join("tags", "|"))


@query("""WITH b AS (SELECT DISTINCT coalesce(nullif(p_brand, 'Brand#11'), '') AS brand FROM part)
SELECT count(*) AS items, (SELECT count(*) FROM b) AS brands, count(*) FILTER (WHERE p_size > 1) AS sized, (SELECT string_agg(brand, '|' ORDER BY brand) FROM b) AS catalog_brands FROM part""")
def meta_full(spark, d):
    return records.meta(records.lean(_products(spark, d))).withColumn("catalog_brands", F.array_join("catalog_brands", "|"))


_VENDOR = "CASE WHEN p_size % 5 = 0 THEN upper(p_brand) WHEN p_size % 7 = 0 THEN '' ELSE p_type || ' ' || p_size % 3 END"


@query(f"""WITH v AS (SELECT p_brand AS brand, {_VENDOR} AS vendor, count(*) AS n FROM part WHERE {_VENDOR} <> '' GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY n DESC, vendor) AS k FROM v WHERE lower(vendor) <> lower(brand))
SELECT v.brand, count(DISTINCT v.vendor) AS vendors, (SELECT string_agg(vendor, '|' ORDER BY k) FROM o WHERE o.brand = v.brand AND k <= 5) AS other_vendors FROM v GROUP BY v.brand""")
def brand_vendors(spark, d):
    return records.vendors(C._t(spark, d, "part").selectExpr("p_brand AS brand", f"{_VENDOR} AS vendor")).withColumn("other_vendors", F.array_join("other_vendors", "|"))


@query(f"WITH {C._TIERS} SELECT brand, tier, decision FROM b LEFT JOIN t ON t.key = lower(brand) LEFT JOIN rv ON rv.key = lower(brand) WHERE tier = 'C' AND contains(lower(brand), '#2') UNION ALL SELECT brand, tier, NULL FROM b LEFT JOIN t ON t.key = lower(brand) WHERE coalesce(tier, '') = ''")
def curation_list(spark, d):
    view = curate.effective(*C._tiers(spark, d)).select("brand", "tier", "decision")
    return records.listed(view, "C", "D#2").unionByName(records.listed(view, "?").withColumn("decision", F.lit(None).cast("string")))


_GRADED = """p AS (SELECT p_partkey AS id, p_brand AS brand, p_name AS title, p_retailprice AS price, p_size > 3 AS available, CASE WHEN p_size % 5 = 0 THEN upper(p_brand) WHEN p_size % 7 = 0 THEN '' ELSE p_type || ' ' || p_size % 3 END AS vendor FROM part),
n AS (SELECT brand, id, left(title, 60) AS title, row_number() OVER (PARTITION BY brand ORDER BY id) AS n FROM p WHERE available),
s AS (SELECT brand, string_agg('img' || id, '|' ORDER BY n) AS preview, string_agg(title, '|' ORDER BY n) FILTER (WHERE n <= 4) AS sample_titles FROM n WHERE n <= 6 GROUP BY brand),
v AS (SELECT brand, vendor, count(*) AS n FROM p WHERE vendor <> '' GROUP BY ALL), o AS (SELECT brand, vendor, row_number() OVER (PARTITION BY brand ORDER BY n DESC, vendor) AS k FROM v WHERE lower(vendor) <> lower(brand)),
w AS (SELECT brand, count(*) AS vendors FROM v GROUP BY brand), ov AS (SELECT brand, string_agg(vendor, '|' ORDER BY k) AS other_vendors FROM o WHERE k <= 5 GROUP BY brand),
a AS (SELECT brand, count(*) AS items, round_even(median(price) FILTER (WHERE price >= 3), 0) AS median_usd, arg_min('shop' || id, id) AS domain FROM p GROUP BY brand)"""


def _overview(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    return curate.overview(C._t(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"), F.lit("USD").alias("currency"),
        (F.col("p_size") > 3).alias("available"), F.expr(_VENDOR).alias("vendor"), F.concat(F.lit("shop"), key).alias("domain"), F.concat(F.lit("img"), key).alias("image"),
    ))


@query(f"""WITH {_GRADED} SELECT brand, lower(brand) AS key, domain, 'USD' AS currency, items, median_usd, coalesce(vendors, 0) AS vendors, coalesce(other_vendors, '') AS other_vendors, coalesce(preview, '') AS preview, coalesce(sample_titles, '') AS sample_titles
FROM a LEFT JOIN s USING (brand) LEFT JOIN w USING (brand) LEFT JOIN ov USING (brand)""")
def curation_overview(spark, d):
    return _overview(spark, d).withColumns({c: F.array_join(c, "|") for c in ("other_vendors", "preview", "sample_titles")})


@query(f"""WITH {C._TIERS}, g AS (SELECT brand, coalesce(tier, '?') AS tier, coalesce(verified, FALSE) AS verified, decision FROM b LEFT JOIN t ON t.key = lower(brand) LEFT JOIN rv ON rv.key = lower(brand))
SELECT count(*) AS brands, (SELECT string_agg(tier || ':' || n, '|' ORDER BY tier) FROM (SELECT tier, count(*) AS n FROM g GROUP BY tier)) AS tiers, count(decision) AS decided,
  count(*) FILTER (WHERE coalesce(decision = 'keep', NOT (tier = 'C' AND verified))) AS live, count(*) FILTER (WHERE verified) AS verified FROM g""")
def curation_totals(spark, d):
    _, tiers, review = C._tiers(spark, d)
    more = {c: F.lit(c) for c in ("reason", "based_in", "evidence")}
    view = curate.graded(_overview(spark, d), tiers.withColumns(more), review, tiers.select("key", F.array("tier").alias("traits")))
    counts = F.transform(F.map_entries("tiers"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return curate.summary(view).withColumn("tiers", F.array_join(counts, "|"))


@query(f"WITH {_STORES}, s AS ({C.oracle_sql()['brand_signals']}), z AS (SELECT p_brand AS brand, round_even(avg(CASE WHEN p_size > 7 THEN 1.0 ELSE 0 END), 2) AS sized FROM part GROUP BY ALL) SELECT brand, suspicion, p10_usd, sized, domain, CASE WHEN domain IS NULL THEN NULL ELSE 'GBP' END AS currency, CASE WHEN domain IS NULL THEN '' ELSE 'knit|' || lower(brand) END AS tags FROM s JOIN z USING (brand) LEFT JOIN m ON m.name = brand")
def brand_audit(spark, d):
    """Signals with what the store list says."""
    p = C._signal_rows(spark, d).withColumn("sizes_offered", F.when(F.col("_size") > 7, F.array(F.lit("M"))).otherwise(F.when(F.col("_size") > 3, F.array().cast("array<string>"))))
    s = curate.signals(p, _stores(spark, d).withColumn("currency", F.lit("GBP")))
    return s.select("brand", "suspicion", "p10_usd", "sized", "domain", "currency", F.array_join("tags", "|").alias("tags"))


@query(f"SELECT brand, suspicion FROM ({C.oracle_sql()['brand_signals']}) ORDER BY suspicion DESC, brand LIMIT 60")
def suspicion_order(spark, d):
    return C.queries()["brand_signals"](spark, d).orderBy(F.desc("suspicion"), "brand").limit(60).select("brand", "suspicion")


@query("SELECT round(sum(abs(value)) / 1e3, 6) AS spent, round(greatest(0, 5e3 - sum(abs(value)) / 1e3), 6) AS remaining, sum(abs(value)) / 1e3 < 5e3 AS allowed FROM events")
def budget_gate(spark, d):
    b = records.budget(C._log(spark, d).select((F.abs("value") / 1e3).alias("cost_usd")), 5e3)
    return b.withColumns({c: F.round(c, 6) for c in ("spent", "remaining")})


_NOTE = """CASE WHEN t >= 5 AND s >= 3 THEN 'based on ' || t || ' traits from ' || s || ' sources'
WHEN t >= 3 THEN 'based on ' || t || ' traits from ' || s || ' source' || CASE WHEN s <> 1 THEN 's' ELSE '' END || ' — a couple more screenshots or brands will sharpen this'
WHEN t >= 1 THEN 'based on only ' || t || ' trait' || CASE WHEN t <> 1 THEN 's' ELSE '' END || ' so far — add a few screenshots or a brand you shop' ELSE 'nothing to go on yet' END"""


@query(f"WITH c AS (SELECT user_id AS pid, count(DISTINCT event_id % 40) FILTER (WHERE event_type = 'error') % 6 AS t, count(DISTINCT event_type) AS s FROM events GROUP BY ALL) SELECT pid, {_NOTE} AS note FROM c")
def confidence_note(spark, d):
    c = C._log(spark, d).groupBy("pid").agg((F.count_distinct(F.when(F.col("kind") == "error", F.col("key"))) % 6).alias("t"), F.count_distinct("kind").alias("s"))
    return c.select("pid", records.confidence_note(F.col("t"), F.col("s")).alias("note"))


@query("SELECT p_type || p_size % 4 AS status, count(*) AS n FROM part GROUP BY ALL ORDER BY n DESC, status LIMIT 6")
def reject_summary(spark, d):
    return records.rejects(C._t(spark, d, "part").select(F.concat("p_type", (F.col("p_size") % 4).cast("string")).alias("status")))


@query(f"WITH {_STORES} SELECT name, domain FROM m UNION ALL SELECT DISTINCT p_brand, NULL FROM part WHERE p_brand > 'Brand#31'")
def grown_stores(spark, d):
    new = C._t(spark, d, "part").where("p_brand > 'Brand#31'").select(F.col("p_brand").alias("name")).distinct()
    return records.grown(_stores(spark, d).select("name", "domain"), new)


@query(f"WITH {C._ITEMS}, q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7) SELECT id, title, round(list_inner_product(vec, q), 6) AS sim FROM i, q ORDER BY list_inner_product(vec, q) DESC, id LIMIT 12")
def nearest_titles(spark, d):
    return records.nearest_titles(C._items(spark, d), C._vectors(spark, d, [7], "k")).withColumn("sim", F.round("sim", 6))


@query("""WITH b AS (SELECT DISTINCT p_brand AS name FROM part) SELECT name, CASE WHEN name < 'Brand#31' THEN 'known ' || lower(name) WHEN name < 'Brand#51' THEN 'read ' || lower(name) ELSE 'clothing from the fashion brand ' || name END AS description FROM b""")
def brand_descriptions(spark, d):
    b = C._t(spark, d, "part").select(F.col("p_brand").alias("name")).distinct()
    said = lambda word, below: b.where(F.col("name") < below).select(F.upper("name").alias("name"), F.concat(F.lit(word), F.lower("name")).alias("description"))
    return records.descriptions(b, said("known ", "Brand#31"), said("read ", "Brand#51"))


_SAVED = """l AS (SELECT user_id AS pid, event_id % 40 AS key, event_type AS kind, ts, row_number() OVER (PARTITION BY user_id, event_id % 40 ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type IN ('signup', 'purchase')),
s AS (SELECT pid, key, ts FROM l WHERE n = 1 AND kind = 'purchase')"""


@query(f"WITH {_SAVED} SELECT pid, p_partkey AS id, p_name AS title, row_number() OVER (PARTITION BY pid ORDER BY ts DESC, key) - 1 AS position, TRUE AS saved FROM s JOIN part ON p_partkey = key")
def saved_cards(spark, d):
    items = C._t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return profiles.saved_cards(profiles.saved(C._log(spark, d), "purchase", "signup"), items).withColumn("position", F.col("position").cast("long"))


@query(f"""WITH {_STORES}, f AS (SELECT user_id AS pid, 'Brand#' || event_id % 40 AS brand, max(ts) AS last FROM events GROUP BY ALL),
s AS (SELECT p_brand AS brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part WHERE p_size > 3),
k AS (SELECT brand, count(*) AS n, string_agg('img' || p_partkey, '|' ORDER BY n) FILTER (WHERE n <= 4) AS preview FROM s GROUP BY brand)
SELECT pid, f.brand, last, m.domain, CASE WHEN m.domain IS NULL THEN '' ELSE 'knit|' || lower(f.brand) END AS tags, coalesce(n, 0) AS in_stock, coalesce(preview, '') AS preview, CASE WHEN f.brand < 'Brand#3' AND n > 0 THEN 'seen|' || lower(f.brand) ELSE '' END AS traits,
  row_number() OVER (PARTITION BY pid ORDER BY last DESC, f.brand) - 1 AS position FROM f LEFT JOIN k ON k.brand = f.brand LEFT JOIN m ON m.name = f.brand""")
def recent_brands(spark, d):
    found = profiles.discovered(C._log(spark, d)).select("pid", F.concat(F.lit("Brand#"), F.col("key").cast("string")).alias("brand"), "last")
    items = C._t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), (F.col("p_size") > 3).alias("available"), F.concat(F.lit("img"), F.col("p_partkey").cast("string")).alias("image"))
    traits = items.where("available AND brand < 'Brand#3'").select(F.lower("brand").alias("key")).distinct().withColumn("traits", F.array(F.lit("seen"), F.col("key")))
    out = profiles.recent_brands(found, items, _stores(spark, d), traits)
    return out.withColumns({**{c: F.array_join(c, "|") for c in ("tags", "preview", "traits")}, "position": F.col("position").cast("long")})


@query("SELECT url AS source, arg_max('pin ' || page_id, page_id) AS link FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0) GROUP BY url")
def new_pins(spark, d):
    p = C._t(spark, d, "pages").select(F.col("page_id").alias("n"), F.col("url").alias("source"), F.concat(F.lit("pin "), F.col("page_id").cast("string")).alias("link"))
    return profiles.new_pins(p, p.where("n % 3 = 0"))


@query("""WITH base AS (SELECT user_id AS pid, min(event_id) AS trait_id, 't' || event_id % 40 AS text FROM events WHERE event_type = 'view' GROUP BY ALL),
added AS (SELECT pid, trait_id, text, FALSE AS user_added FROM base UNION ALL SELECT pid, trait_id, text, TRUE FROM (SELECT user_id AS pid, min(event_id) AS trait_id, 't' || event_id % 40 AS text FROM events WHERE event_type = 'purchase' GROUP BY ALL) n WHERE NOT EXISTS (FROM base b WHERE b.pid = n.pid AND b.text = n.text)),
c AS (SELECT event_id - event_id % 3 AS trait_id, event_id AS n, event_id % 2 = 0 AS enabled, CASE WHEN event_id % 5 = 0 THEN 'u' || event_id END AS text FROM events WHERE event_type = 'click'),
pt AS (SELECT trait_id, arg_max(enabled, n) FILTER (WHERE enabled IS NOT NULL) AS enabled, arg_max(text, n) FILTER (WHERE text IS NOT NULL) AS text FROM c GROUP BY ALL)
SELECT pid, a.trait_id, coalesce(pt.text, a.text) AS text, coalesce(pt.enabled, TRUE) AS enabled, user_added, coalesce(pt.text <> a.text, FALSE) AS encode FROM added a LEFT JOIN pt USING (trait_id)
WHERE a.trait_id NOT IN (SELECT event_id - 1 FROM events WHERE event_type = 'error')""")
def trait_edits(spark, d):
    """Traits added with a guard against repeats, changed and deleted."""
    log, text = C._log(spark, d), F.concat(F.lit("t"), F.col("key").cast("string")).alias("text")
    own = log.where("kind = 'view'").groupBy("pid", text).agg(F.min("event_id").alias("trait_id")).withColumns({"enabled": F.lit(True), "user_added": F.lit(False)})
    new = log.where("kind = 'purchase'").select("pid", F.col("event_id").alias("trait_id"), text)
    changed = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("u"), F.col("event_id").cast("string"))).alias("text")
    patches = log.where("kind = 'click'").select((F.col("event_id") - F.col("event_id") % 3).alias("trait_id"), F.col("event_id").alias("n"), (F.col("event_id") % 2 == 0).alias("enabled"), changed)
    gone = log.where("kind = 'error'").select((F.col("event_id") - 1).alias("trait_id"))
    return profiles.traits_deleted(profiles.traits_patched(profiles.traits_added(own, new), patches), gone)


@query("SELECT user_id AS pid, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'x' || count(*) FILTER (WHERE event_type = 'error') ELSE 'none' END AS error, CASE WHEN count(*) FILTER (WHERE event_type = 'view') > 0 THEN 'x' || count(*) FILTER (WHERE event_type = 'view') ELSE '0' END AS view, 2 AS kept FROM events GROUP BY user_id")
def profile_defaults(spark, d):
    """A profile's map with defaults, of which only two keys may be set."""
    n = C._log(spark, d).groupBy("pid", "kind").agg(F.concat(F.lit("x"), F.count("*").cast("string")).alias("v"))
    m = n.groupBy("pid").agg(F.map_from_entries(F.collect_list(F.struct("kind", "v"))).alias("m"))
    whole = profiles.with_defaults(F.col("m"), F.create_map(*map(F.lit, ("error", "none", "view", "0", "currency", "USD"))))
    s = m.select("pid", profiles.settings(whole, ("error", "view")).alias("m"))
    return s.select("pid", F.col("m")["error"].alias("error"), F.col("m")["view"].alias("view"), F.size("m").alias("kept"))


@query("""WITH t AS (SELECT lower(trim(p_brand)) AS key, p_partkey, p_name, p_type, row_number() OVER (PARTITION BY lower(trim(p_brand)) ORDER BY p_partkey) AS n FROM part)
SELECT key, string_agg(p_name, '|' ORDER BY n) FILTER (WHERE n <= 80) AS titles, (SELECT string_agg(p_type, '|' ORDER BY p_type) FROM (SELECT DISTINCT p_type FROM t x WHERE x.key = t.key)) AS types FROM t GROUP BY key""")
def brand_samples(spark, d):
    """What a reader sees of each brand: eighty titles and the types."""
    items = C._t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("title"), F.col("p_type").alias("product_type"))
    return encoders.brand_samples(items).withColumns({c: F.array_join(c, "|") for c in ("titles", "types")})


@query("""WITH w AS (SELECT DISTINCT lower(p_name) AS phrase FROM part WHERE p_size <= 10), n AS (SELECT DISTINCT lower(p_name) || ' ' || lower(p_type) AS phrase FROM part WHERE p_size > 40 UNION SELECT phrase FROM w WHERE phrase > 'n')
SELECT phrase FROM w UNION ALL SELECT phrase FROM n WHERE phrase NOT IN (SELECT phrase FROM w)""")
def learned_phrases(spark, d):
    """A vocabulary and what a reader said beside it, cleaned; what is known isn't learned again."""
    p, name = C._t(spark, d, "part"), F.lower("p_name")
    words = p.where("p_size <= 10").select(name.alias("phrase")).distinct()
    said = p.where("p_size > 40").select(F.concat(F.lit(" "), F.upper("p_name"), F.lit("  "), F.col("p_type"), F.lit(".")).alias("phrase")).union(words.where("phrase > 'n'"))
    return encoders.learned(words, said)


@query("""WITH c AS (SELECT event_id % 700 AS key, arg_max(CASE WHEN event_type = 'error' THEN NULL ELSE value END, event_id) AS v, arg_max(event_type, event_id) AS kind, max(event_id) AS n FROM events GROUP BY ALL),
t AS (SELECT p_partkey AS key, p_retailprice AS value FROM part WHERE p_partkey < 1500)
SELECT coalesce(t.key, c.key) AS key, CASE WHEN c.key IS NULL THEN t.value ELSE (SELECT e.value FROM events e WHERE e.event_id = c.n) END AS value FROM t FULL JOIN c ON c.key = t.key WHERE c.key IS NULL OR c.kind <> 'error'""")
def keyed_upserts(spark, d):
    """A table with the last change of each key; a change without a value deletes."""
    t = C._t(spark, d, "part").where("p_partkey < 1500").select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("value"), F.lit(-1).cast("long").alias("n"))
    c = C._t(spark, d, "events").select((F.col("event_id") % 700).alias("key"), F.when(F.col("event_type") != "error", F.col("value")).alias("value"), F.col("event_id").alias("n"))
    return profiles.upserted(t, c, "key", "n").select("key", "value")


@query(f"""WITH {C._SCORED}, {C._PAGE}, p AS (SELECT id FROM r ORDER BY (rk > 2), r.score DESC, id LIMIT 24)
SELECT p_partkey AS id, p_name AS title, p_type AS product_type, p_size AS size FROM part SEMI JOIN p ON p.id = p_partkey""")
def page_details(spark, d):
    """The full rows of the first page."""
    full = C._t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("product_type"), F.col("p_size").alias("size"))
    return search.with_details(search.first_page(C._found(spark, d)), full)


@query("""WITH t AS (SELECT DISTINCT 't' || event_id % 9 AS text FROM events WHERE event_type = 'signup'), n AS (SELECT DISTINCT 't' || event_id % 12 AS text, event_type AS kind, 'r' || user_id % 3 AS ref FROM events WHERE event_type <> 'signup')
SELECT coalesce(t.text, n.text) AS text, string_agg(kind || ':' || ref, '|' ORDER BY kind, ref) AS sources FROM (SELECT text, 'base' AS kind, '0' AS ref FROM t UNION ALL SELECT * FROM n) n LEFT JOIN t ON FALSE GROUP BY ALL""")
def merged_sources(spark, d):
    """Traits with the sources that they have and those that entries bring."""
    e = C._t(spark, d, "events")
    name = lambda n: F.concat(F.lit("t"), (F.col("event_id") % n).cast("string")).alias("text")
    base = F.array(F.struct(F.lit("base").alias("kind"), F.lit("0").alias("ref")))
    traits = e.where("event_type = 'signup'").select(name(9)).distinct().withColumn("sources", base)
    entries = e.where("event_type <> 'signup'").select(name(12), F.col("event_type").alias("kind"), F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")).alias("ref"))
    out = profiles.with_sources(traits, entries)
    return out.select("text", F.array_join(F.array_sort(F.transform("sources", lambda s: F.concat_ws(":", s["kind"], s["ref"]))), "|").alias("sources"))


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
