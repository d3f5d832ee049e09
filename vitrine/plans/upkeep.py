"""Registered queries of what is kept between calls: budgets, vocabularies, lookups, catalogues, images and feeds. Stand-ins as
in ``catalogue``; what a query keeps goes to a new folder of the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions import constants as K
from vitrine.operators import images, ingest, recommend, vocabulary
from vitrine.operators.encoders import HashEncoder
from vitrine.plans import catalogue as C
from vitrine.sources import feeds, files, sinks
from vitrine.sources.keyed import KeyedTable
from vitrine.streaming import budget

_Q, _SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


#: An account's budget, and a time that parts the log in two loads.
LIMIT_USD, HALF = 1.5, "2024-01-16"


@query(f"""WITH c AS (SELECT user_id::VARCHAR AS account, event_id, ts, event_type AS kind, round(value * 1000)::BIGINT AS cost FROM events),
a AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY account ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT account, event_id, kind, cost, least(before, coalesce(min(before) FILTER (WHERE before >= {round(LIMIT_USD * budget.MICRO)}) OVER (PARTITION BY account), before))::BIGINT AS spent, before < {round(LIMIT_USD * budget.MICRO)} AS admitted FROM a""")
def budget_admission(spark: SparkSession, d: str) -> DataFrame:
    """The log in two loads, each a run of the stream that goes on from the checkpoint of the one before."""
    e = C._t(spark, d, "events")
    calls = e.select(F.col("user_id").cast("string").alias("account"), "event_id", "ts", F.col("event_type").alias("kind"), F.round(F.col("value") * 1000).cast("long").alias("cost"))
    src, out, ck = (files.scratch(spark, f"budget-{x}") for x in ("calls", "admitted", "state"))
    for part in (calls.where(F.col("ts") < HALF), calls.where(F.col("ts") >= HALF)):
        part.write.mode("append").parquet(src)
        stream = spark.readStream.schema(calls.schema).parquet(src)
        budget.write(budget.admitted(stream, LIMIT_USD), out, ck).awaitTermination()
    return spark.read.parquet(out).select("account", "event_id", "kind", "cost", "spent", "admitted")


@query("""WITH a AS (SELECT DISTINCT lower(p_name) AS phrase FROM part WHERE p_size <= 30), b AS (SELECT DISTINCT lower(p_name) || ' ' || lower(p_type) AS phrase FROM part WHERE p_size > 20 UNION SELECT phrase FROM a WHERE phrase > 'm')
SELECT phrase, CASE WHEN phrase IN (SELECT phrase FROM a) THEN 1 ELSE 2 END AS since, 64 AS dim FROM b""")
def vocabulary_refresh(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary after its list was rewritten: phrases of both lists keep the vector of the first refresh."""
    part, path = C._t(spark, d, "part"), files.scratch(spark, "phrases")
    name = F.lower("p_name")
    one = part.where("p_size <= 30").select(name.alias("phrase")).distinct()
    two = part.where("p_size > 20").select(F.concat_ws(" ", name, F.lower("p_type")).alias("phrase")).union(one.where("phrase > 'm'")).distinct()
    v = vocabulary.Vocabulary(spark, files.scratch(spark, "vocabulary"), path)
    for words in (one, two):
        vocabulary.write_lists(words, path, "overwrite")
        v.refresh(HashEncoder())
    return v.table.rows().select("phrase", "since", F.size("vec").alias("dim"))


ASKED = (17, 4, 100_000_000, 199, 4)


@query("SELECT k.id, p_name AS title, p_retailprice AS price FROM (VALUES (17), (4), (100000000), (199)) k(id) LEFT JOIN part ON p_partkey = k.id")
def item_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Items by id from a table in buckets; an unknown id has nulls."""
    t = KeyedTable(spark, files.scratch(spark, "items"), "id", buckets=16)
    t.write(C._t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("price")))
    return t.lookup(ASKED)


@query("""SELECT page_id, 0 AS n, 'https://i/564x/' || page_id || '.jpg' AS source, CASE WHEN page_id % 3 = 0 THEN url ELSE 'https://i/564x/' || page_id || '.jpg' END AS link, NULL AS error FROM pages WHERE page_id % 5 < 3
UNION ALL SELECT page_id, 1, 'b' || page_id, url, NULL FROM pages WHERE page_id % 5 = 2
UNION ALL SELECT page_id, -1, NULL, NULL, CASE page_id % 5 WHEN 3 THEN 'unreadable' ELSE 'no pins' END FROM pages WHERE page_id % 5 >= 3""")
def feed_pins(spark: SparkSession, d: str) -> DataFrame:
    """Each page's address as a feed of one or two pins; one in five is cut off, one in five has no picture."""
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    key, k = F.col("page_id").cast("string"), F.col("page_id") % 5
    link = F.concat(F.lit("<link>"), esc(F.col("url")), F.lit("</link>"))
    item = lambda image, rest: F.concat(F.lit("<item><description>"), esc(F.concat(F.lit('<p><img alt="" src="'), image, F.lit('"> & more'))), F.lit("</description>"), rest, F.lit("</item>"))
    one = item(F.concat(F.lit("https://i/236x/"), key, F.lit(".jpg")), F.when(F.col("page_id") % 3 == 0, link).otherwise(""))
    held = F.when(k == 2, F.concat(one, item(F.concat(F.lit("b"), key), link))).when(k == 4, F.lit("<item><description>words</description></item>")).otherwise(one)
    whole = F.concat(F.lit('<rss version="2.0"><channel><title>t</title>'), held, F.lit("</channel></rss>"))
    pages = C._t(spark, d, "pages").select("page_id", F.when(k == 3, F.left(whole, F.length(whole) - 20)).otherwise(whole).alias("text"))
    return feeds.items(pages).withColumn("n", F.coalesce("n", F.lit(-1)))


_DOMAIN = "regexp_replace(split_part(regexp_replace(lower(trim(url)), '^https?://', ''), '/', 1), '^www\\.', '')"


@query(f"""WITH p AS (SELECT {_DOMAIN} AS domain, 'shop ' || page_id AS name, page_id >= (SELECT avg(page_id) FROM pages) AS late FROM pages)
SELECT domain, coalesce(min(name) FILTER (WHERE late), min(name)) AS name FROM p GROUP BY domain""")
def store_list(spark: SparkSession, d: str) -> DataFrame:
    """Stores accepted in two rounds; those of the first stay as they are in the second."""
    pages = C._t(spark, d, "pages")
    found = pages.crossJoin(F.broadcast(pages.agg(F.avg("page_id").alias("mid")))).select(F.concat(F.lit("shop "), F.col("page_id").cast("string")).alias("name"), F.col("url").alias("domain"), (F.col("page_id") >= F.col("mid")).alias("late"))
    sink = sinks.CatalogueSink(spark, files.scratch(spark, "catalogue"))
    sink.accept(found.where("late").drop("late"))
    sink.accept(found.drop("late"))
    return sink.read("stores").select("domain", "name")


_SOURCE = "CASE event_type WHEN 'view' THEN 'image' WHEN 'click' THEN 'pin' ELSE 'quiz' END"


@query(f"""WITH e AS (SELECT event_id, ts, user_id AS pid, CASE event_type WHEN 'error' THEN 'remove' WHEN 'signup' THEN 'keep' ELSE 'add' END AS action,
  CASE WHEN event_type = 'error' THEN ['image', 'pin', 'quiz'][event_id % 3 + 1] ELSE {_SOURCE} END AS kind, 'r' || event_id % 5 AS ref, 'trait ' || event_id % 4 AS text FROM events),
g AS (SELECT pid, kind, ref, max((ts, event_id)) AS gone FROM e WHERE action = 'remove' GROUP BY ALL),
f AS (SELECT pid, text, kind, ref, min((ts, event_id)) AS came FROM e LEFT JOIN g USING (pid, kind, ref) WHERE action = 'add' AND (gone IS NULL OR (ts, event_id) > gone) GROUP BY ALL),
k AS (SELECT DISTINCT pid, text FROM e WHERE action = 'keep'), t AS (SELECT pid, text FROM f UNION SELECT pid, text FROM k)
SELECT t.pid, t.text, coalesce((SELECT string_agg(kind || ':' || ref, ',' ORDER BY came) FROM f WHERE f.pid = t.pid AND f.text = t.text), '') AS sources, k.pid IS NOT NULL AS user_added FROM t LEFT JOIN k USING (pid, text)""")
def trait_source_fold(spark: SparkSession, d: str) -> DataFrame:
    """Profile events as pictures, pins and quiz picks that come and go."""
    e, t = C._t(spark, d, "events"), F.col("event_type")
    source = F.when(t == "view", "image").when(t == "click", "pin").otherwise("quiz")
    any_kind = F.element_at(F.array(*map(F.lit, ("image", "pin", "quiz"))), (F.col("event_id") % 3 + 1).cast("int"))
    log = e.select(
        "event_id", "ts", F.col("user_id").alias("pid"), F.when(t == "error", "remove").when(t == "signup", "keep").otherwise("add").alias("action"), F.when(t == "error", any_kind).otherwise(source).alias("kind"),
        F.concat(F.lit("r"), (F.col("event_id") % 5).cast("string")).alias("ref"), F.concat(F.lit("trait "), (F.col("event_id") % 4).cast("string")).alias("text"),
    )
    joined = F.array_join(F.transform("sources", lambda s: F.concat_ws(":", s["kind"], s["ref"])), ",")
    return images.trait_sources(log).withColumn("sources", joined)


@query("""WITH w AS (SELECT 'phrase ' || vec_id AS phrase, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id < 60),
s AS (SELECT vec_id AS image_id, coalesce(label, -1) AS pid, phrase, list_inner_product(embedding::DOUBLE[], q) AS s FROM embeddings, w),
z AS (SELECT *, (s - avg(s) OVER i) / (stddev_pop(s) OVER i + 1e-6) AS z FROM s WINDOW i AS (PARTITION BY image_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY z DESC, phrase) AS n FROM z),
b AS (SELECT pid, phrase, count(*) AS n_images, sum(z) AS score, min(image_id) AS low, max(image_id) AS high FROM r WHERE n <= 3 AND z >= 1.5 GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY n_images DESC, score DESC, phrase) AS n FROM b)
SELECT pid, phrase AS text, n_images, round(score, 6) AS score, low, high FROM t WHERE n <= 6""")
def image_traits(spark: SparkSession, d: str) -> DataFrame:
    """What the pictures of each profile show, of a vocabulary of sixty phrases; labels stand for profiles."""
    e = C._t(spark, d, "embeddings")
    pictures = e.select(F.coalesce("label", F.lit(-1)).alias("pid"), F.col("vec_id").alias("image_id"), F.col("embedding").alias("vec"))
    words = e.where("vec_id < 60").select(F.concat(F.lit("phrase "), F.col("vec_id").cast("string")).alias("phrase"), F.col("embedding").alias("q"))
    t = images.read_traits(pictures, words)
    return t.select("pid", "text", "n_images", F.round("score", 6).alias("score"), F.array_min("sources.ref").alias("low"), F.array_max("sources.ref").alias("high"))


_SAYS = ("silk dress", "wide trousers", "leather bag", "quiet luxury")
_GOOD = "CASE kw " + " ".join(f"WHEN '{c}' THEN [{', '.join(repr(x) for x in ([c] if c in K.NON_CLOTHING else K.COMPATIBLE[c]))}]" for c in K.CATEGORIES) + " END"


@query(f"""WITH {C._CAT}, {C._TRAITS}, t AS (SELECT trait_id, [{', '.join(map(repr, _SAYS))}][trait_id % 4 + 1] AS says, q FROM tr), w AS (SELECT *, {C._kw('says')} AS kw FROM t),
s AS (SELECT id, trait_id, kw, list_inner_product(vec, q) AS sim FROM i, w), z AS (SELECT *, (sim - avg(sim) OVER g) / CASE WHEN stddev_pop(sim) OVER g > 1e-6 THEN stddev_pop(sim) OVER g ELSE 1 END AS z FROM s WINDOW g AS (PARTITION BY trait_id))
SELECT id, trait_id, round(CASE WHEN margin > (SELECT quantile_cont(margin, 0.25) FROM ct) AND CASE WHEN kw IS NULL THEN ct.category IN ({', '.join(map(repr, K.NON_CLOTHING))}) ELSE NOT list_contains({_GOOD}, ct.category) END THEN -10.0 ELSE z END, 6) AS z FROM z JOIN ct USING (id)""")
def trait_mask(spark: SparkSession, d: str) -> DataFrame:
    """Scores of every piece for every trait, those of the wrong category masked."""
    items = C._items(spark, d)
    both = items.join(recommend.categorise(items, C._prompts(spark, d)), "id")
    says = F.element_at(F.array(*map(F.lit, _SAYS)), (F.col("trait_id") % 4 + 1).cast("int"))
    z, _ = recommend.trait_scores(both, C._traits(spark, d).withColumn("text", says))
    return z.select("id", "trait_id", F.round("z", 6).alias("z"))


_LABELS = ("L", "S", "M", "XS")


@query(f"""WITH v AS (SELECT p_partkey, p_brand, p_name, p_size, unnest(range(p_size % 4 + 1)) AS k, p_retailprice FROM part WHERE p_size % 5 > 0 AND p_partkey % 11 > 0),
l AS (SELECT *, [{', '.join(map(repr, _LABELS))}][k + 1] AS label, (p_partkey + k) % 3 = 0 AS available, CASE WHEN k >= p_size % 2 THEN p_retailprice + k END AS price, [2, 0, 1, -1][k + 1] AS place FROM v)
SELECT lower(p_brand) || '.com#' || p_partkey AS id, p_brand AS brand, any_value(p_name) AS title, arg_min(price, k) FILTER (WHERE price IS NOT NULL) AS price, bool_or(available) AS available,
  coalesce(string_agg(label, '|' ORDER BY place) FILTER (WHERE available), '') AS sizes_in_stock, string_agg(label, '|' ORDER BY place) AS sizes_offered, 'https://' || lower(p_brand) || '.com/products/h' || p_partkey AS url FROM l GROUP BY p_partkey, p_brand""")
def product_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Nested store records to products: no pictures and gift cards go, the first price that can be read, sizes from the variants."""
    key, n = F.col("p_partkey"), F.col("p_size")
    none = F.lit(None).cast("string")

    def variant(k):
        price = F.when(k < n % 2, "n/a").otherwise((F.col("p_retailprice") + k).cast("string"))
        label = F.element_at(F.array(*map(F.lit, _LABELS)), k + 1)
        return F.struct(F.lit("t").alias("title"), price.alias("price"), ((key + k) % 3 == 0).alias("available"), label.alias("option1"), none.alias("option2"), none.alias("option3"))

    option = F.struct(F.lit("Size").alias("name"), F.lit(1).alias("position"), F.array(*map(F.lit, _LABELS)).alias("values"))
    raw = C._t(spark, d, "part").select(
        F.concat(F.lower("p_brand"), F.lit(".com")).alias("domain"), key.alias("id"), F.when(key % 11 == 0, "Gift Card 50").otherwise(F.col("p_name")).alias("title"), F.concat(F.lit("h"), key.cast("string")).alias("handle"),
        F.col("p_type").alias("product_type"), F.lit("v").alias("vendor"), F.lit("<p>text</p>").alias("body_html"), F.array(F.lit("t")).alias("tags"), none.alias("published_at"),
        F.when(n % 5 == 0, F.array().cast("array<struct<src:string>>")).otherwise(F.array(F.struct(F.lit("i.jpg").alias("src")))).alias("images"), F.array(option).alias("options"),
        F.transform(F.sequence(F.lit(0), n % 4), variant).alias("variants"),
    )
    brands = raw.select("domain").distinct().join(C._t(spark, d, "part").select(F.col("p_brand").alias("name"), F.concat(F.lower("p_brand"), F.lit(".com")).alias("domain")).distinct(), "domain").withColumn("currency", F.lit("USD"))
    out = ingest.normalise_products(raw, brands)
    return out.select("id", "brand", "title", "price", "available", F.array_join("sizes_in_stock", "|").alias("sizes_in_stock"), F.array_join("sizes_offered", "|").alias("sizes_offered"), "url")


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
