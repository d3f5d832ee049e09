"""The registered queries over the test tables, each with DuckDB SQL where SQL can say it.

The tables stand in for a catalog: an item is a ``part`` with the ``embeddings`` row of its key; brands, titles, types
and prices are the part's; trait, query and prompt vectors are embeddings of fixed ids or label means; ``events`` are
profile events."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions import constants as K
from vitrine.functions import sizes as S
from vitrine.functions import text as T
from vitrine.functions import vector as V
from vitrine.operators import curate, ingest, profiles, ranking, recommend, search
from vitrine.operators.inverted import SearchIndex
from vitrine.sources import files
from vitrine.streaming import jobs

_Q, _SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _items(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("title"), F.col("p_type").alias("product_type"), F.col("p_retailprice").alias("price"),
        F.lit("USD").alias("currency"), (F.col("p_size") > 3).alias("available"),
    )
    vec = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return part.join(vec, "id")


def _vectors(spark: SparkSession, d: str, ids: list[int], key: str) -> DataFrame:
    return _t(spark, d, "embeddings").where(F.col("vec_id").isin(ids)).select(F.col("vec_id").alias(key), F.col("embedding").alias("q"))


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    """A category's prompt vector: the mean of a label."""
    means = V.mean_vector(_t(spark, d, "embeddings").where("label IS NOT NULL"), "embedding", ["label"])
    names = F.element_at(F.array(*[F.lit(c) for c in K.CATEGORIES]), F.col("label") + 1)
    return means.select(names.alias("category"), F.col("vec").alias("q"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    return e.select("event_id", F.col("user_id").alias("pid"), "ts", F.col("event_type").alias("kind"), (F.col("event_id") % 40).alias("key"), "value", "props")


# ---------- SQL pieces: the same constants, written for DuckDB ----------

_L = "lambda x:"
_STOP = ", ".join(f"'{w}'" for w in K.STOP)
_STEM = (
    "CASE WHEN length({t}) > 4 AND ends_with({t}, 'ies') THEN left({t}, length({t}) - 3) || 'y' "
    "WHEN length({t}) > 3 AND ends_with({t}, 's') AND NOT ends_with({t}, 'ss') THEN left({t}, length({t}) - 1) ELSE {t} END"
)


def _tok(c: str) -> str:
    stem = _STEM.format(t="x")
    return f"list_transform(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'), {_L} x NOT IN ({_STOP})), {_L} {stem})"


_ITEMS = """i AS (SELECT p_partkey AS id, p_brand AS brand, p_name AS title, p_type AS product_type, p_retailprice AS price, p_size > 3 AS available, embedding::DOUBLE[] AS vec
  FROM part JOIN embeddings ON p_partkey = vec_id)"""
_PROMPTS = """pm AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings WHERE label IS NOT NULL) GROUP BY ALL),
pl AS (SELECT label, list(x ORDER BY pos) AS v FROM pm GROUP BY label),
prompts AS (SELECT ([{names}])[label + 1] AS category, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS q FROM pl)""".format(names=", ".join(f"'{c}'" for c in K.CATEGORIES))
_KEYWORD = "CASE " + " ".join(f"WHEN contains({{c}}, '{word}') THEN '{name}'" for word, name in K.KEYWORDS) + " END"
_FX = "CASE {c} " + " ".join(f"WHEN '{c}' THEN {r!r}" for c, r in K.FX.items()) + " ELSE 1.0 END"


def _kw(c: str) -> str:
    return _KEYWORD.format(c=f"(' ' || lower(coalesce({c}, '')) || ' ')")


def _bm25(asked: list[str]) -> str:
    values = ", ".join(f"'{t}'" for t in sorted(set(asked)))
    return f"""pt AS (SELECT id, token, sum(w) AS tf FROM (SELECT id, unnest({_tok('title')}) AS token, 3.0 AS w FROM i UNION ALL SELECT id, unnest({_tok('product_type')}), 2.0 FROM i) GROUP BY ALL),
dl AS (SELECT id, sum(tf) AS dl FROM pt GROUP BY id), av AS (SELECT (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM i) AS avg, (SELECT count(*) FROM i) AS n),
df AS (SELECT token, count(*) AS df FROM pt WHERE token IN ({values}) GROUP BY token),
tx AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))) AS text_score FROM pt JOIN df USING (token) JOIN dl USING (id), av GROUP BY id)"""


_JUNK = K.JUNK.replace("'", "''")

_SCORED = f"""{_ITEMS}, {_bm25(['red', 'ring'])},
s AS (SELECT i.*, list_inner_product(vec, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS sim, {_tok('title')} AS tt FROM i),
st AS (SELECT avg(sim) AS m, stddev_pop(sim) AS sd FROM s), mx AS (SELECT max(text_score) AS top FROM tx),
sc AS (SELECT s.id, brand, title, product_type, price, available, (sim - m) / (sd + 1e-6) AS z, coalesce(text_score, 0) AS text_score,
  (sim - m) / (sd + 1e-6) + CASE WHEN top > 0 THEN 2.5 * coalesce(text_score, 0) / top ELSE 0 END
  + CASE WHEN coalesce(text_score, 0) > 0 THEN CASE WHEN contains(array_to_string(tt, ' '), 'red ring') THEN 0.8 ELSE 0 END + CASE WHEN list_contains(tt, 'red') THEN 0.5 ELSE 0 END ELSE 0 END AS score
  FROM s LEFT JOIN tx USING (id), st, mx),
kept AS (SELECT * FROM sc WHERE available AND NOT regexp_matches(title, '{_JUNK}') AND price >= 5 AND (text_score > 0 OR z >= 1.5))"""
_PAGE = """w AS (SELECT *, row_number() OVER (PARTITION BY brand, trim(regexp_replace(lower(title), '\\s*[-|~(].*$', '')) ORDER BY score DESC, id) AS n FROM kept),
r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY score DESC, id) AS rk FROM w WHERE n = 1)"""

RED_RING = search.Query("red ring")


def _index(spark: SparkSession, d: str, name: str, docs: DataFrame, key: str, fields: dict[str, float], tables: list[str]) -> SearchIndex:
    """The persistent index of a folder's tables, in the shared folder; built where the tables aren't those it was built of."""
    root = f"{files.shared(spark)}/index-{name}-{hashlib.sha1(d.encode()).hexdigest()[:12]}"
    return SearchIndex(spark, root, key, fields, 16).ensure(docs, *(f"{d}/{t}.parquet" for t in tables))


def _items_index(spark: SparkSession, d: str) -> SearchIndex:
    items = _items(spark, d)
    return _index(spark, d, "items", items, "id", {f: w for f, w in K.FIELD_WEIGHTS.items() if f in items.columns}, ["part", "embeddings"])


def _documents_index(spark: SparkSession, d: str) -> SearchIndex:
    return _index(spark, d, "documents", _t(spark, d, "documents").select("doc_id", "text"), "doc_id", {"text": 0.5}, ["documents"])


def _found(spark: SparkSession, d: str, q: search.Query = RED_RING) -> DataFrame:
    return search.scored(_items(spark, d), q, _vectors(spark, d, [0], "k"), index=_items_index(spark, d))


@query(f"WITH {_SCORED}, {_PAGE} SELECT id, brand, title, round(score, 6) AS score FROM r ORDER BY (rk > 2), r.score DESC, id LIMIT 24")
def hybrid_search_page0(spark, d):
    return search.first_page(_found(spark, d)).select("id", "brand", "title", F.round("score", 6).alias("score"))


@query(f"""WITH {_SCORED}, {_PAGE}, p AS (SELECT *, list_filter(['red', 'ring'], lambda x: list_contains({_tok('title')}, x)) AS hits FROM r ORDER BY (rk > 2), r.score DESC, id LIMIT 24)
SELECT id, CASE WHEN len(hits) > 0 THEN 'title matches ' || array_to_string(hits, ', ') WHEN text_score > 0 THEN 'tagged as a match' ELSE 'looks like what you asked for' END AS why, round_even(price, 2) AS price_usd FROM p""")
def search_explained(spark, d):
    page = search.explained(search.first_page(_found(spark, d)), ["red", "ring"])
    return page.select("id", F.array_join("why", "|").alias("why"), "price_usd")


@query(f"WITH {_SCORED} SELECT id, round(price * 1.0, 2) AS usd, round(score, 6) AS score FROM kept WHERE price BETWEEN 10 AND 950 AND brand <> 'Brand#12' ORDER BY usd, kept.score DESC, id LIMIT 30")
def price_sorted(spark, d):
    found = _found(spark, d, search.Query("red ring", min_usd=10.0, max_usd=950.0, exclude_brands=("Brand#12",), sort="price_asc"))
    return found.orderBy(*search.ordering("price_asc")).limit(30).select("id", F.round("usd", 2).alias("usd"), F.round("score", 6).alias("score"))


_PAGED = [0, 1, 2, 3]
_ALL_PAGES = f"""WITH RECURSIVE {_ITEMS},
s AS (SELECT q.vec_id AS query_id, id, brand, title, round(list_inner_product(vec, q.embedding::DOUBLE[]), 9) AS score FROM i, embeddings q WHERE available AND q.vec_id IN ({', '.join(map(str, _PAGED))})),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id, brand, trim(regexp_replace(lower(title), '\\s*[-|~(].*$', '')) ORDER BY score DESC, id) AS way FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM w WHERE way = 1),
st(query_id, n, page_no, placed, waiting, used) AS (
  SELECT DISTINCT query_id, 0::BIGINT, 0::BIGINT, []::BIGINT[], []::STRUCT(n BIGINT, b VARCHAR)[], []::VARCHAR[] FROM r
  UNION ALL
  SELECT query_id, n, CASE WHEN due THEN len(placed) // 24 ELSE page_no END, CASE WHEN due THEN list_concat(placed, list_transform(go, lambda x: x.n)) ELSE placed END,
    CASE WHEN due THEN list_filter(waiting, lambda x: NOT list_contains(go, x)) ELSE waiting END, CASE WHEN due THEN list_transform(go, lambda x: x.b) ELSE used END
  FROM (SELECT *, CASE WHEN due THEN list_filter(waiting, lambda x, k: len(list_filter(waiting[1:k - 1], lambda y: y.b = x.b)) < 2) ELSE [] END AS go
    FROM (SELECT *, len(placed) > 0 AND len(placed) % 24 = 0 AND len(placed) // 24 <> page_no AS due
      FROM (SELECT query_id, n, page_no, CASE WHEN ok THEN list_append(placed, n) ELSE placed END AS placed,
          CASE WHEN ok THEN waiting ELSE list_append(waiting, struct_pack(n := n, b := brand)) END AS waiting, CASE WHEN ok THEN list_append(used, brand) ELSE used END AS used
        FROM (SELECT st.query_id, r.n, page_no, placed, waiting, used, r.brand, len(list_filter(used, lambda x: x = r.brand)) < 2 AS ok FROM st JOIN r ON r.query_id = st.query_id AND r.n = st.n + 1))))),
e AS (SELECT query_id, list_concat(max_by(placed, n), list_transform(max_by(waiting, n), lambda x: x.n)) AS ns FROM st GROUP BY query_id),
p AS (SELECT query_id, unnest(ns) AS n, unnest(range(len(ns))) AS position FROM e)
SELECT query_id, id, brand, score, position FROM p JOIN r USING (query_id, n)"""


@query(_ALL_PAGES)
def page_diversity_full(spark, d):
    """Every page of four queries, each over all items in stock."""
    items = _items(spark, d).where("available")
    found = recommend.similarities(items, _vectors(spark, d, _PAGED, "query_id"), "query_id")
    return ranking.all_pages(found.select("query_id", "id", "brand", "title", F.round("sim", 9).alias("score")))


_DOCS = f"""t AS (SELECT doc_id AS id, unnest({_tok('text')}) AS token FROM documents), pt AS (SELECT id, token, count(*) * 0.5 AS tf FROM t GROUP BY ALL),
dl AS (SELECT id, sum(tf) AS dl FROM pt GROUP BY id), n AS (SELECT count(*) AS n FROM documents), av AS (SELECT sum(dl) / max(n) AS avg, max(n) AS n FROM dl, n),
df AS (SELECT token, count(*) AS df FROM pt WHERE token IN ('tion', 'ing') GROUP BY token)"""


_BM25_TOP = "SELECT id AS doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))), 6) AS score FROM pt JOIN df USING (token) JOIN dl USING (id), av GROUP BY id ORDER BY score DESC, doc_id LIMIT 20"


def _top20(scores: DataFrame) -> DataFrame:
    return scores.select("doc_id", F.round("text_score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query(f"WITH {_DOCS} {_BM25_TOP}")
def bm25_topk(spark, d):
    return _top20(_documents_index(spark, d).search(["tion", "ing"]))


@query(f"WITH {_DOCS.replace('FROM documents', 'FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id)')} {_BM25_TOP}")
def index_merge_search(spark, d):
    """An index of drafts of the labelled documents and all others, into which the documents as they are are merged; the toxic
    ones are deleted."""
    docs, labels = _t(spark, d, "documents").select("doc_id", "text"), _t(spark, d, "labels")
    labelled = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    drafts = labelled.select("doc_id", F.concat(F.lit("ting draft "), F.reverse("text")).alias("text"))
    index = SearchIndex(spark, files.scratch(spark, "index"), "doc_id", {"text": 0.5}, 16)
    index.build(docs.join(labelled.select("doc_id"), "doc_id", "left_anti").unionByName(drafts))
    index.merge(labelled)
    index.delete(labels.where("toxic = 1").select("doc_id"))
    return _top20(index.search(["tion", "ing"]))


@query(f"WITH {_DOCS} {_BM25_TOP}")
def index_stream_search(spark, d):
    """The same search over an index that grew document by document, as languages arrived one after another."""
    src, docs = files.scratch(spark, "arriving"), _t(spark, d, "documents").select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang"))
    docs.hint("rebalance", F.col("lang")).write.partitionBy("lang").parquet(src)  # a large language is written by several tasks
    index = SearchIndex(spark, files.scratch(spark, "index"), "doc_id", {"text": 0.5}, 16)
    names = spark.read.parquet(src).inputFiles()
    two = max(2, round(2 * len(names) / max(1, len({n.rsplit("/", 2)[1] for n in names}))))  # a batch is as many files as two languages have
    stream = spark.readStream.schema("doc_id long, text string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", two).parquet(src)
    jobs.search_index(stream, index, files.scratch(spark, "index-state")).awaitTermination()
    return _top20(index.search(["tion", "ing"]))


@query("SELECT vec_id, round(sim, 6) AS sim, round((sim - avg(sim) OVER ()) / (stddev_pop(sim) OVER () + 1e-6), 6) AS z FROM (SELECT vec_id, list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)) AS sim FROM embeddings) ORDER BY sim DESC, vec_id LIMIT 50")
def vector_zscore(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    z = V.with_zscore(recommend.similarities(e, _vectors(spark, d, [3], "k"), "k"), "sim", "z")
    return z.orderBy(F.desc("sim"), "id").limit(50).select(F.col("id").alias("vec_id"), F.round("sim", 6).alias("sim"), F.round("z", 6).alias("z"))


_SIM = f"WITH {_ITEMS}, o AS (SELECT vec AS v, brand AS b FROM i WHERE id = 7), s AS (SELECT id, brand, list_inner_product(vec, v) AS sim, b FROM i, o WHERE available AND id <> 7)"


@query(_SIM + ", r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY sim DESC, id) AS n FROM s WHERE brand <> b) SELECT id, brand, round(sim, 6) AS sim FROM r WHERE n = 1 ORDER BY r.sim DESC, id LIMIT 12")
def similar_items(spark, d):
    return search.similar(_items(spark, d), 7).select("id", "brand", F.round("sim", 6).alias("sim"))


@query(_SIM + " SELECT id, brand, round(sim, 6) AS sim FROM s WHERE brand = b ORDER BY s.sim DESC, id LIMIT 8")
def similar_same_brand(spark, d):
    return search.similar(_items(spark, d), 7, 8, same_brand=True).select("id", "brand", F.round("sim", 6).alias("sim"))


@query(f"SELECT p_partkey, coalesce({_kw('p_name')}, {_kw('p_type')}) AS category, regexp_matches(p_name, '{_JUNK}') AS junk FROM part")
def keyword_category(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.coalesce(T.keyword_category("p_name"), T.keyword_category("p_type")).alias("category"), T.is_junk("p_name").alias("junk"))


@query(f"SELECT doc_id, {_kw('text')} AS category FROM documents")
def document_category(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.keyword_category("text").alias("category"))


_CAT = f"""{_ITEMS}, {_PROMPTS}, cs AS (SELECT id, category, list_inner_product(vec, q) AS sim FROM i, prompts),
cr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, category DESC) AS n FROM cs),
ct AS (SELECT id, max(category) FILTER (WHERE n = 1) AS category, max(sim) FILTER (WHERE n = 1) - max(sim) FILTER (WHERE n = 2) AS margin FROM cr GROUP BY id)"""


@query(f"WITH {_CAT} SELECT id, category, round(margin, 6) AS margin FROM ct")
def zero_shot_category(spark, d):
    return recommend.categorise(_items(spark, d), _prompts(spark, d)).select("id", "category", F.round("margin", 6).alias("margin"))


@query(f"WITH {_CAT} SELECT category, count(*) AS n, round(median(margin), 6) AS median_margin FROM ct GROUP BY category")
def category_histogram(spark, d):
    c = recommend.categorise(_items(spark, d), _prompts(spark, d))
    return c.groupBy("category").agg(F.count("*").alias("n"), F.round(F.median("margin"), 6).alias("median_margin"))


@query(f"WITH {_CAT} SELECT id, ct.category FROM ct JOIN i USING (id) WHERE (ct.category IN ('trousers', 'jeans', 'set') OR margin <= (SELECT quantile_cont(margin, 0.25) FROM ct)) AND coalesce({_kw('title')}, {_kw('product_type')}, 'set') IN ('trousers', 'jeans', 'set')")
def category_facet(spark, d):
    items = _items(spark, d)
    c = items.join(recommend.categorise(items, _prompts(spark, d)), "id")
    p25 = c.agg(F.percentile("margin", F.lit(0.25)).alias("p25"))
    return c.crossJoin(F.broadcast(p25)).where(search.category_ok("trousers")).select("id", "category")


_CURRENCY = "([{}])[(s_nationkey % 29) + 1]".format(", ".join(f"'{c}'" for c in K.FX))


@query(f"SELECT s_suppkey, {_CURRENCY} AS currency, round(s_acctbal * {_FX.format(c=_CURRENCY)}, 6) AS usd FROM supplier WHERE s_acctbal * {_FX.format(c=_CURRENCY)} BETWEEN 5 AND 2000")
def price_filter_fx(spark, d):
    cur = F.element_at(F.array(*[F.lit(c) for c in K.FX]), F.col("s_nationkey") % 29 + 1)
    s = _t(spark, d, "supplier").withColumn("currency", cur).withColumn("_u", T.usd("s_acctbal", "currency"))
    return s.where(F.col("_u").between(5, 2000)).select("s_suppkey", "currency", F.round("_u", 6).alias("usd"))


@query("SELECT page_id, left(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\\s\\x{A0}\\x{85}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x0B]+', ' ', 'g')), 700) AS body FROM pages")
def html_strip(spark, d):
    return _t(spark, d, "pages").select("page_id", T.strip_html("html").alias("body"))


@query("SELECT page_id, regexp_replace(split_part(regexp_replace(lower(trim(url)), '^https?://', ''), '/', 1), '^www\\.', '') AS domain, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'width=512' AS sized FROM pages")
def domain_normalise(spark, d):
    return _t(spark, d, "pages").select("page_id", T.domain("url").alias("domain"), T.image_url("url").alias("sized"))


@query("""WITH c AS (SELECT regexp_replace(split_part(regexp_replace(lower(trim(url)), '^https?://', ''), '/', 1), '^www\\.', '') AS domain, 'shop ' || page_id AS name FROM pages),
k AS (SELECT 'blog.' || lower(s_name) || '.example.com' AS domain, s_name AS name FROM supplier UNION ALL SELECT 'tionsh.example.net', 'shop 3')
SELECT domain, min(name) AS name FROM c WHERE contains(domain, '.') AND domain NOT IN (SELECT domain FROM k) AND lower(name) NOT IN (SELECT lower(name) FROM k) GROUP BY domain""")
def grow_candidates(spark, d):
    c = _t(spark, d, "pages").select(F.concat(F.lit("shop "), F.col("page_id").cast("string")).alias("name"), F.col("url").alias("domain"))
    known = _t(spark, d, "supplier").select(F.col("s_name").alias("name"), F.concat(F.lit("blog."), F.lower("s_name"), F.lit(".example.com")).alias("domain"))
    known = known.unionByName(spark.createDataFrame([("shop 3", "tionsh.example.net")], "name string, domain string"))
    return ingest.new_candidates(c, known)


_CACHE = "cache AS (SELECT sha1(text) AS image_key, doc_id AS v FROM documents JOIN labels USING (doc_id) WHERE quality = 1)"


@query(f"WITH {_CACHE} SELECT doc_id, sha1(text) AS image_key FROM documents WHERE sha1(text) NOT IN (SELECT image_key FROM cache)")
def embed_cache_miss(spark, d):
    return ingest.missing(_t(spark, d, "documents"), _cache(spark, d), "text").select("doc_id", "image_key")


@query(f"WITH {_CACHE}, u AS (SELECT image_key, min(v) AS v FROM cache GROUP BY 1) SELECT doc_id, v FROM documents JOIN u ON sha1(text) = image_key")
def embed_cache_hit(spark, d):
    return ingest.indexed(_t(spark, d, "documents"), _cache(spark, d), "text").select("doc_id", F.col("vec").alias("v"))


def _cache(spark, d):
    good = _t(spark, d, "labels").where("quality = 1").select("doc_id")
    c = _t(spark, d, "documents").join(good, "doc_id").select(F.sha1(F.col("text").cast("binary")).alias("image_key"), "doc_id")
    return c.groupBy("image_key").agg(F.min("doc_id").alias("vec"))


_TIERS = """b AS (SELECT DISTINCT p_brand AS brand FROM part), t AS (SELECT lower('Brand#' || (11 + doc_id % 40)) AS key, CASE WHEN sum(1 - quality) * 4 > count(*) THEN 'C' ELSE 'A' END AS tier, sum(toxic) > 0 AS verified FROM labels GROUP BY 1),
rv AS (SELECT lower('Brand#' || (11 + doc_id % 40)) AS key, 'keep' AS decision FROM labels WHERE toxic = 1 AND doc_id % 7 = 0 GROUP BY 1)"""


def _tiers(spark, d):
    key = F.lower(F.concat(F.lit("Brand#"), (11 + F.col("doc_id") % 40).cast("string"))).alias("key")
    lab = _t(spark, d, "labels")
    tiers = lab.groupBy(key).agg(F.when(F.sum(1 - F.col("quality")) * 4 > F.count("*"), "C").otherwise("A").alias("tier"), (F.sum("toxic") > 0).alias("verified"))
    review = lab.where("toxic = 1 AND doc_id % 7 = 0").select(key, F.lit("keep").alias("decision")).distinct()
    return _t(spark, d, "part").select(F.col("p_brand").alias("brand")).distinct(), tiers, review


@query(f"WITH {_TIERS} SELECT brand, tier, decision, coalesce(decision = 'keep', NOT (tier = 'C' AND verified), TRUE) AS live FROM b LEFT JOIN t ON t.key = lower(brand) LEFT JOIN rv ON rv.key = lower(brand)")
def curation_gate(spark, d):
    return curate.effective(*_tiers(spark, d)).select("brand", "tier", "decision", "live")


@query(f"WITH {_TIERS} SELECT tier, count(*) AS brands, count(decision) AS decided, count(*) FILTER (WHERE coalesce(decision = 'keep', NOT (tier = 'C' AND verified), TRUE)) AS live FROM b LEFT JOIN t ON t.key = lower(brand) LEFT JOIN rv ON rv.key = lower(brand) GROUP BY tier")
def curation_summary(spark, d):
    return curate.effective(*_tiers(spark, d)).groupBy("tier").agg(F.count("*").alias("brands"), F.count("decision").alias("decided"), F.count_if("live").alias("live"))


_SEO = K.SEO_WORDS.replace("'", "''")


@query(f"""WITH p AS (SELECT p_brand AS brand, p_name AS title, CASE WHEN p_retailprice >= 3 THEN p_retailprice END AS usd, lower(trim(CASE WHEN p_size % 5 = 0 THEN p_brand ELSE p_type END)) AS vendor FROM part),
r AS (SELECT brand, usd, row_number() OVER (PARTITION BY brand ORDER BY usd) AS n, count(*) OVER (PARTITION BY brand) AS c FROM p WHERE usd IS NOT NULL),
s AS (SELECT brand, count(*) AS items, round_even(median(usd), 0) AS median_usd, round_even(avg(CASE WHEN regexp_matches(title, '{_SEO}') THEN 1.0 ELSE 0 END), 2) AS seo_titles,
  round_even(avg(CASE WHEN len(regexp_split_to_array(trim(title), '\\s+')) >= 8 THEN 1.0 ELSE 0 END), 2) AS long_titles,
  round_even(avg(CASE WHEN (upper(title) = title AND lower(title) <> title) OR regexp_matches(title, '[A-Z0-9_]{{6,}}') THEN 1.0 ELSE 0 END), 2) AS caps_titles,
  round_even(avg(len(string_split(title, ' '))), 1) AS avg_tags, count(DISTINCT vendor) AS distinct_vendors, round_even(avg(CASE WHEN vendor = lower(brand) THEN 1.0 ELSE 0 END), 2) AS own_vendor_share FROM p GROUP BY brand)
SELECT s.*, round_even(usd, 0) AS p10_usd, round_even(CASE WHEN median_usd < 25 THEN 3 WHEN median_usd < 40 THEN 2 WHEN median_usd < 60 THEN 1 ELSE 0 END + 3 * seo_titles + 2 * long_titles
  + CASE WHEN distinct_vendors >= 5 THEN 2 WHEN distinct_vendors >= 3 THEN 1 ELSE 0 END + CASE WHEN caps_titles >= 0.5 THEN 1 ELSE 0 END, 2) AS suspicion
FROM s LEFT JOIN r ON r.brand = s.brand AND n = floor(c / 10) + 1""")
def brand_signals(spark, d):
    return curate.signals(_signal_rows(spark, d))


def _signal_rows(spark: SparkSession, d: str) -> DataFrame:
    vendor = F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_type")).alias("vendor")
    return _t(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"), F.lit("USD").alias("currency"), vendor, F.split("p_name", " ").alias("tags"), F.col("p_size").alias("_size"))


_TRAIT_IDS = [11, 23, 35, 47, 59, 71, 83, 95]
_TRAITS = f"tr AS (SELECT vec_id AS trait_id, 'trait ' || vec_id AS text, embedding::DOUBLE[] AS q, 1 + vec_id % 5 AS n_sources FROM embeddings WHERE vec_id IN ({', '.join(map(str, _TRAIT_IDS))}))"
_Z = f"""{_ITEMS}, {_TRAITS}, ts AS (SELECT trait_id, id, brand, available, list_inner_product(vec, q) AS sim FROM i, tr),
tz AS (SELECT trait_id, id, brand, available, (sim - avg(sim) OVER w) / CASE WHEN stddev_pop(sim) OVER w > 1e-6 THEN stddev_pop(sim) OVER w ELSE 1 END AS z FROM ts WINDOW w AS (PARTITION BY trait_id)),
bars AS (SELECT trait_id, greatest(2.5, 0.85 * avg(z)) AS bar FROM (SELECT *, row_number() OVER (PARTITION BY trait_id ORDER BY z DESC, id) AS n FROM tz) WHERE n <= 10 GROUP BY trait_id)"""


def _traits(spark, d):
    t = _vectors(spark, d, _TRAIT_IDS, "trait_id")
    return t.select("trait_id", F.concat(F.lit("trait "), F.col("trait_id").cast("string")).alias("text"), "q", (1 + F.col("trait_id") % 5).alias("n_sources"))


@query(f"WITH {_Z} SELECT trait_id, round(bar, 6) AS bar, (SELECT count(*) FROM tz WHERE tz.trait_id = bars.trait_id AND z >= bar) AS above FROM bars")
def trait_bars(spark, d):
    z, bars = recommend.trait_scores(_items(spark, d), _traits(spark, d))
    above = z.join(F.broadcast(bars), "trait_id").groupBy("trait_id", "bar").agg(F.count_if(F.col("z") >= F.col("bar")).alias("above"))
    return above.select("trait_id", F.round("bar", 6).alias("bar"), "above")


_CARDS = f"""WITH {_Z}, a AS (SELECT brand, bool_or(available) AS has_any FROM i GROUP BY brand), stock AS (SELECT i.* FROM i JOIN a USING (brand) WHERE available OR NOT has_any),
al AS (SELECT brand, count(*) AS items FROM i GROUP BY brand),
sz AS (SELECT brand, items, quantile_cont(nullif(price, 0), 0.15) AS lo, quantile_cont(nullif(price, 0), 0.85) AS hi FROM stock JOIN al USING (brand) GROUP BY ALL HAVING count(*) >= 3),
tk AS (SELECT *, row_number() OVER (PARTITION BY brand, trait_id ORDER BY z DESC, id) AS n FROM tz WHERE id IN (SELECT id FROM stock)),
tp AS (SELECT brand, trait_id, avg(z) AS strength, arg_min(id, n) AS best FROM tk WHERE n <= 3 GROUP BY ALL),
m AS (SELECT brand, tp.trait_id, text, strength, bar, best, strength - bar AS over, least(3.0, 1 + 0.5 * greatest(n_sources - 1, 0)) AS w FROM tp JOIN bars USING (trait_id) JOIN tr USING (trait_id)),
c AS (SELECT brand, count(*) FILTER (WHERE over >= 0) AS n_matched, count(*) AS n_traits, coalesce(sum(w) FILTER (WHERE over >= 0), 0) / sum(w) * 10 + 0.5 * coalesce(sum(over) FILTER (WHERE over >= 0), 0) AS score,
  coalesce(list(text ORDER BY over DESC, trait_id) FILTER (WHERE over >= 0), []) AS names, coalesce(string_agg(text, '|' ORDER BY trait_id) FILTER (WHERE over < 0), '') AS missing FROM m GROUP BY brand)"""


@query(_CARDS + f""" SELECT brand, items, n_matched, n_traits, round(score, 6) AS score, trunc(lo)::INT AS price_low, trunc(hi)::INT AS price_high, array_to_string(names, '|') AS matched, missing,
'Carries ' || CASE WHEN n_matched = 1 THEN names[1] ELSE array_to_string(names[1:least(n_matched, {K.WHY_MAX}) - 1], ', ') || ' and ' || names[least(n_matched, {K.WHY_MAX})] END || CASE WHEN n_matched > {K.WHY_MAX} THEN ' (+' || n_matched - {K.WHY_MAX} || ' more)' ELSE '' END
  || ' — ' || n_matched || ' of ' || n_traits || ' of your traits.' AS why FROM c JOIN sz USING (brand) WHERE n_matched > 0 AND brand <> 'Brand#13' ORDER BY c.score DESC, brand LIMIT 12""")
def brand_recommend(spark, d):
    c = recommend.score_brands(_items(spark, d), _traits(spark, d), exclude=("Brand#13",))
    matched = F.array_join(F.transform("matched", lambda m: m["text"]), "|")
    return c.select("brand", "items", "n_matched", "n_traits", F.round("score", 6).alias("score"), "price_low", "price_high", matched.alias("matched"), F.array_join("missing", "|").alias("missing"), "why")


@query(_CARDS + """, k AS (SELECT brand, score FROM c JOIN sz USING (brand) WHERE n_matched > 0 ORDER BY c.score DESC, brand LIMIT 12)
SELECT brand, CASE WHEN brand < 'Brand#4' THEN lower(brand) || '.com' END AS domain, CASE WHEN brand < 'Brand#4' THEN 'https://' || lower(brand) || '.com' END AS url, CASE WHEN brand < 'Brand#4' THEN 'EUR' ELSE 'USD' END AS currency, n_matched || ' of ' || n_traits AS coverage,
  (SELECT string_agg(text || ':' || round_even(strength, 2) || ':' || round_even(bar, 2) || ':' || title || ':' || price, '|' ORDER BY over DESC, m.trait_id) FROM m JOIN i ON i.id = best WHERE m.brand = c.brand AND over >= 0) AS evidence
FROM c SEMI JOIN k USING (brand)""")
def brand_cards(spark, d):
    """Cards of the best brands with their stores and the piece that proves each trait."""
    items = _items(spark, d)
    stores = items.where("brand < 'Brand#4'").select(F.col("brand").alias("name")).distinct()
    stores = stores.withColumns({"domain": F.concat(F.lower("name"), F.lit(".com")), "currency": F.lit("EUR"), "tags": F.array(F.lit("knit"))})
    c = recommend.with_evidence(recommend.with_stores(recommend.score_brands(items, _traits(spark, d)), stores), items, "title", "price")
    told = F.transform("matched", lambda m: F.concat_ws(":", m["text"], m["strength"].cast("string"), m["bar"].cast("string"), m["evidence"]["title"], m["evidence"]["price"].cast("string")))
    return c.select("brand", "domain", "url", "currency", "coverage", F.array_join(told, "|").alias("evidence"))


@query(f"WITH {_ITEMS} SELECT id, round(list_inner_product(vec, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 11)), 6) AS sim FROM i WHERE brand = (SELECT min(brand) FROM i) ORDER BY sim DESC, id LIMIT 12")
def brand_items(spark, d):
    items = _items(spark, d)
    first = items.agg(F.min("brand")).first()[0]
    return recommend.brand_items(items, first, _vectors(spark, d, [11], "k")).select("id", F.round("sim", 6).alias("sim"))


@query("""SELECT user_id AS pid, count(DISTINCT event_type) AS traits, count(DISTINCT (event_type, event_id % 5)) AS sources, round(least(3.0, 1 + 0.5 * greatest(count(*) - 1, 0)), 6) AS weight,
CASE WHEN count(DISTINCT event_type) >= 5 AND count(DISTINCT (event_type, event_id % 5)) >= 3 THEN 'high' WHEN count(DISTINCT event_type) >= 3 THEN 'medium' ELSE 'low' END AS level FROM events GROUP BY user_id""")
def confidence_level(spark, d):
    n = _log(spark, d).groupBy("pid").agg(F.count_distinct("kind").alias("traits"), F.count_distinct(F.struct("kind", F.col("event_id") % 5)).alias("sources"), F.count("*").alias("n"))
    return n.select("pid", "traits", "sources", F.round(recommend.trait_weight(F.col("n")), 6).alias("weight"), recommend.confidence(F.col("traits"), F.col("sources")).alias("level"))


@query("""WITH s AS (SELECT a.vec_id AS id, 'phrase ' || b.vec_id AS phrase, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a, embeddings b WHERE b.vec_id BETWEEN 200 AND 249),
z AS (SELECT id, phrase, (sim - avg(sim) OVER w) / (stddev_pop(sim) OVER w + 1e-6) AS z FROM s WINDOW w AS (PARTITION BY id)),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY z DESC, phrase) AS n FROM z)
SELECT phrase, count(*) AS n_images, round(sum(z), 6) AS score, array_to_string(list(id ORDER BY id), ',') AS images FROM r WHERE n <= 3 AND z >= 1.5 GROUP BY phrase ORDER BY n_images DESC, sum(z) DESC, phrase LIMIT 6""")
def vocab_read(spark, d):
    e = _t(spark, d, "embeddings")
    images = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    words = e.where("vec_id BETWEEN 200 AND 249").select(F.concat(F.lit("phrase "), F.col("vec_id").cast("string")).alias("phrase"), F.col("embedding").alias("q"))
    return recommend.read_vocabulary(images, words).select("phrase", "n_images", F.round("score", 6).alias("score"), F.array_join(F.col("images").cast("array<string>"), ",").alias("images"))


@query("""WITH l AS (SELECT doc_id, list_transform(string_split(text, '.'), lambda x: regexp_replace(lower(trim(trim(x, ' '), '.,;:!"''')), '\\s+', ' ', 'g')) AS ts FROM documents)
SELECT doc_id, array_to_string(list_filter(ts, lambda x, i: x <> '' AND len(string_split(x, ' ')) <= 8 AND NOT regexp_matches(x, '{}') AND NOT list_contains(ts[1:i - 1], x)), '|') AS traits FROM l""".format(K.BANNED_TRAITS.replace("'", "''")))
def trait_clean(spark, d):
    t = _t(spark, d, "documents").select("doc_id", F.split("text", r"\.").alias("ts"))
    return t.select("doc_id", F.array_join(T.clean_traits("ts"), "|").alias("traits"))


_TASTE = f"""{_ITEMS}, an AS (SELECT vec_id AS anchor, embedding::DOUBLE[] AS q, vec_id < 300 AS positive FROM embeddings WHERE vec_id IN (5, 15, 25, 305)),
s AS (SELECT id, brand, anchor, positive, list_inner_product(vec, q) AS sim FROM i, an),
z AS (SELECT *, (sim - avg(sim) OVER w) / CASE WHEN stddev_pop(sim) OVER w > 1e-6 THEN stddev_pop(sim) OVER w ELSE 1 END AS z FROM s WINDOW w AS (PARTITION BY anchor))"""


def _taste(spark, d):
    anchors = _vectors(spark, d, [5, 15, 25, 305], "anchor").withColumn("positive", F.col("anchor") < 300)
    return recommend.taste_scores(_items(spark, d), anchors)


@query(f"WITH {_TASTE} SELECT id, brand, round(0.6 * max(z) FILTER (WHERE positive) + 0.4 * avg(z) FILTER (WHERE positive) - 0.5 * greatest(coalesce(max(z) FILTER (WHERE NOT positive), 0) - 1.5, 0), 6) AS score, arg_max(anchor, z) FILTER (WHERE positive) AS because FROM z GROUP BY id, brand")
def taste_feed_scores(spark, d):
    return _taste(spark, d).select("id", "brand", F.round("score", 6).alias("score"), "because")


@query(f"""WITH RECURSIVE {_TASTE}, sc AS (SELECT id, brand, 0.6 * max(z) FILTER (WHERE positive) + 0.4 * avg(z) FILTER (WHERE positive) - 0.5 * greatest(coalesce(max(z) FILTER (WHERE NOT positive), 0) - 1.5, 0) AS score FROM z GROUP BY id, brand),
r AS (SELECT sc.*, vec, row_number() OVER (ORDER BY score DESC, sc.id) AS n FROM sc JOIN i ON i.id = sc.id WHERE available),
f(n, picks) AS (SELECT 0::BIGINT, []::STRUCT(id BIGINT, brand VARCHAR, score DOUBLE, vec DOUBLE[])[] UNION ALL
  SELECT r.n, CASE WHEN len(picks) < {K.FEED_LIMIT} AND len(list_filter(picks, lambda p: p.brand = r.brand)) < {K.FEED_PER_BRAND} AND len(list_filter(picks, lambda p: list_inner_product(p.vec, r.vec) > {K.FEED_DEDUPE})) = 0
    THEN list_append(picks, struct_pack(id := id, brand := brand, score := score, vec := vec)) ELSE picks END FROM f JOIN r ON r.n = f.n + 1),
p AS (SELECT unnest(picks) AS p, unnest(range(len(picks))) AS position FROM (SELECT max_by(picks, n) AS picks FROM f))
SELECT 0 AS pid, p.id, p.brand, round(p.score, 6) AS score, position FROM p""")
def taste_feed_rank(spark, d):
    items = _items(spark, d).where("available").select("id", "vec")
    return recommend.rank_feed(_taste(spark, d).join(items, "id").withColumn("pid", F.lit(0))).withColumn("score", F.round("score", 6))


@query("""WITH m AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings WHERE label IS NOT NULL) GROUP BY ALL),
l AS (SELECT label, list(x ORDER BY pos) AS v FROM m GROUP BY label) SELECT label, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first, round(v[64] / sqrt(list_inner_product(v, v)), 6) AS last FROM l""")
def taste_vector(spark, d):
    m = V.mean_vector(_t(spark, d, "embeddings").where("label IS NOT NULL"), "embedding", ["label"])
    return m.select("label", F.round(F.element_at("vec", 1), 6).alias("first"), F.round(F.element_at("vec", 64), 6).alias("last"))


@query(f"WITH {_ITEMS}, h AS (SELECT id, brand, md5(id || ':0') AS h FROM i WHERE available), r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY h, id) AS n FROM h) SELECT id, brand FROM r WHERE n = 1 ORDER BY h, id LIMIT 48")
def cold_start(spark, d):
    return recommend.cold_start(_items(spark, d)).select("id", "brand")


@query("""WITH c AS (SELECT vec_id AS k, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id < 20),
s AS (SELECT e.vec_id AS id, k, row_number() OVER (PARTITION BY e.vec_id ORDER BY list_inner_product(embedding::DOUBLE[], q) DESC, k) AS n FROM embeddings e, c) SELECT k, count(*) AS n, min(id) AS low, max(id) AS high FROM s WHERE n = 1 GROUP BY k""")
def quiz_step(spark, d):
    points = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    assigned, _ = recommend.lloyd_step(points, _vectors(spark, d, list(range(20)), "k"))
    return assigned.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))


_QUIZ = f"""WITH RECURSIVE {_ITEMS},
pool AS (SELECT * FROM i WHERE available AND price > 0 AND length(title) > 8 AND NOT regexp_matches(title, '[A-Z0-9_]{{6,}}')),
c0 AS (SELECT row_number() OVER (ORDER BY md5(id || ':1'), id) - 1 AS k, vec AS q FROM pool ORDER BY md5(id || ':1'), id LIMIT 20),
it(step, k, q) AS (SELECT 0, k, q FROM c0 UNION ALL
  SELECT o.step + 1, o.k, coalesce(m.q, o.q) FROM it o LEFT JOIN (SELECT k, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS q FROM (SELECT k, list(x ORDER BY pos) AS v FROM (
    SELECT k, pos, avg(x) AS x FROM (SELECT k, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM (SELECT arg_max(it.k, (list_inner_product(vec, q), -it.k)) AS k, any_value(vec) AS vec FROM pool, it GROUP BY pool.id)) GROUP BY ALL) GROUP BY k)) m ON m.k = o.k
  WHERE o.step < 15),
a AS (SELECT pool.id, any_value(brand) AS brand, any_value(title) AS title, any_value(vec) AS vec, arg_max(k, (list_inner_product(vec, q), -k)) AS k FROM pool, it WHERE step = 14 GROUP BY pool.id),
s AS (SELECT a.k, a.id, brand, title, list_inner_product(vec, q) AS sim FROM a JOIN it ON it.k = a.k AND step = 15),
l AS (SELECT k, list(struct_pack(id := id, brand := brand, title := title) ORDER BY sim DESC, id) AS cards FROM s GROUP BY k),
g(k, picks, brands) AS (SELECT -1::BIGINT, []::STRUCT(k BIGINT, id BIGINT, brand VARCHAR, title VARCHAR)[], []::VARCHAR[] UNION ALL
  SELECT k, CASE WHEN f IS NULL THEN picks ELSE list_append(picks, struct_pack(k := k, id := f.id, brand := f.brand, title := f.title)) END, CASE WHEN f IS NULL THEN brands ELSE list_append(brands, f.brand) END
  FROM (SELECT g.k + 1 AS k, picks, brands, list_filter(cards, lambda x: NOT list_contains(brands, x.brand))[1] AS f FROM g LEFT JOIN l ON l.k = g.k + 1 WHERE g.k < 19))
SELECT p.id, p.brand, p.title FROM (SELECT unnest(max_by(picks, k)) AS p FROM g)"""


@query(_QUIZ)
def quiz_spread(spark, d):
    return recommend.quiz(_items(spark, d)).select("id", "brand", "title")


@query(f"""WITH {_ITEMS}, k AS (SELECT 'known ' || vec_id AS name, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id BETWEEN 400 AND 409), s AS (SELECT name, id, brand, list_inner_product(vec, q) AS sim FROM i, k),
z AS (SELECT *, (sim - avg(sim) OVER w) / CASE WHEN stddev_pop(sim) OVER w > 1e-6 THEN stddev_pop(sim) OVER w ELSE 1 END AS z FROM s WINDOW w AS (PARTITION BY name)),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY z DESC, id) AS n FROM z), t AS (SELECT name, brand, min(n) AS n FROM r WHERE n <= 12 GROUP BY ALL)
SELECT name, count(*) FILTER (WHERE z > 2.5) AS strong, count(DISTINCT brand) FILTER (WHERE z > 2.5) AS brands, (SELECT string_agg(brand, '|' ORDER BY n) FROM t WHERE t.name = r.name) AS top FROM r GROUP BY name""")
def coverage_audit(spark, d):
    known = _vectors(spark, d, list(range(400, 410)), "k").select(F.concat(F.lit("known "), F.col("k").cast("string")).alias("name"), "q")
    return recommend.coverage(_items(spark, d), known).withColumn("top", F.array_join("top", "|"))


@query("""WITH e AS (SELECT event_type AS kind, 'm' || event_id % 3 AS model, cast(floor(abs(value)) AS BIGINT) AS i, event_id % 100 AS o FROM events),
c AS (SELECT *, (i * CASE model WHEN 'm0' THEN 3.0 WHEN 'm1' THEN 1.0 ELSE 5.0 END + o * CASE model WHEN 'm0' THEN 15.0 WHEN 'm1' THEN 5.0 ELSE 25.0 END) / 1e6 AS cost FROM e)
SELECT coalesce(kind, 'total') AS kind, count(*) AS calls, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, round(sum(cost), 6) AS cost_usd FROM c GROUP BY ROLLUP (kind)""")
def llm_usage(spark, d):
    e = _log(spark, d).select("kind", F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("model"), F.floor(F.abs("value")).cast("long").alias("input_tokens"), (F.col("event_id") % 100).alias("output_tokens"))
    prices = spark.createDataFrame([("m0", 3.0, 15.0), ("m1", 1.0, 5.0)], "model string, input double, output double")
    u = curate.usage(curate.costed(e, prices, (5.0, 25.0)))
    return u.select(F.coalesce("kind", F.lit("total")).alias("kind"), "calls", "input_tokens", "output_tokens", F.round("cost_usd", 6).alias("cost_usd"))


@query("""WITH l AS (SELECT user_id AS pid, event_id % 40 AS key, event_type AS kind, ts, row_number() OVER (PARTITION BY user_id, event_id % 40 ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type IN ('signup', 'purchase')) SELECT pid, key, ts FROM l WHERE n = 1 AND kind = 'purchase'""")
def profile_saved(spark, d):
    return profiles.saved(_log(spark, d), "purchase", "signup").select("pid", "key", "ts")


@query("""WITH r AS (SELECT user_id, max((ts, event_id)) AS at FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT e.user_id AS pid, count(*) AS n FROM events e LEFT JOIN r ON r.user_id = e.user_id WHERE r.at IS NULL OR (e.ts, e.event_id) > r.at GROUP BY e.user_id""")
def profile_reset(spark, d):
    return profiles.after_reset(_log(spark, d), "error").groupBy("pid").agg(F.count("*").alias("n"))


@query("SELECT user_id AS pid, event_id % 40 AS key, min(ts) AS first, max(ts) AS last, count(*) AS n, arg_min(event_type, (ts, event_id)) AS via FROM events GROUP BY ALL")
def profile_discovered(spark, d):
    return profiles.discovered(_log(spark, d))


@query("""WITH a AS (SELECT DISTINCT lower(p_brand) AS key FROM part WHERE p_brand < 'Brand#41'), b AS (SELECT DISTINCT lower(upper(p_brand)) AS key FROM part WHERE p_brand > 'Brand#21')
SELECT key, 'added' AS change FROM b WHERE key NOT IN (SELECT key FROM a) UNION ALL SELECT key, 'removed' FROM a WHERE key NOT IN (SELECT key FROM b)""")
def profile_set_diff(spark, d):
    p = _t(spark, d, "part")
    return profiles.changes(p.where("p_brand < 'Brand#41'"), p.where("p_brand > 'Brand#21'").withColumn("p_brand", F.upper("p_brand")), "p_brand")


@query("""WITH s AS (SELECT x.vec_id AS q, e.vec_id AS id, row_number() OVER (PARTITION BY x.vec_id ORDER BY list_inner_product(e.embedding::DOUBLE[], x.embedding::DOUBLE[]) DESC, e.vec_id) AS n FROM embeddings e, embeddings x WHERE x.vec_id IN (1, 2))
SELECT count(*) AS overlap FROM (SELECT id FROM s WHERE n <= 50 GROUP BY id HAVING count(*) = 2)""")
def top50_overlap(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    top = [recommend.similarities(e, _vectors(spark, d, [k], "k"), "k").orderBy(F.desc("sim"), "id").limit(50).select("id") for k in (1, 2)]
    return top[0].intersect(top[1]).agg(F.count("*").alias("overlap"))


@query("SELECT count(*) AS items, count(DISTINCT p_brand) AS brands, count(*) FILTER (WHERE p_size > 3) AS available FROM part")
def meta_stats(spark, d):
    return _t(spark, d, "part").agg(F.count("*").alias("items"), F.count_distinct("p_brand").alias("brands"), F.count_if(F.col("p_size") > 3).alias("available"))


@query("SELECT event_type AS kind, count(*) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY event_type")
def json_props(spark, d):
    return _log(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


_US = " ".join(f"WHEN {n} THEN '{x}'" for n, x in K.NUMERIC["US"].items())


@query(f"""WITH p AS (SELECT p_brand, p_type, min(p_partkey) AS low, list(DISTINCT p_size) AS sizes FROM part GROUP BY ALL), u AS (SELECT p_brand, p_type, sizes, unnest(sizes) AS s FROM p)
SELECT p_brand, p_type, 'US ' || s AS label, CASE WHEN list_max(sizes) <= 5 AND list_min(sizes) <= 1 AND len(sizes) >= 2 THEN ['XS', 'S', 'M', 'L', 'XL', 'XXL'][s + 1] ELSE CASE s {_US} END END AS letter FROM u""")
def size_normalise(spark, d):
    p = _t(spark, d, "part").groupBy("p_brand", "p_type").agg(F.collect_set(F.concat(F.lit("US "), F.col("p_size").cast("string"))).alias("labels"))
    n = p.select("p_brand", "p_type", F.explode(S.normalise(F.col("labels"), F.lit("GBP"), F.lit("top"))).alias("s"))
    return n.select("p_brand", "p_type", "s.label", F.get("s.canon", F.lit(0)).alias("letter"))


@query("SELECT user_id AS pid, event_id % 40 AS key, count(*) AS n, min(ts) AS first, max(ts) AS last, arg_max(event_type, (ts, event_id)) AS last_kind FROM events GROUP BY ALL")
def profile_fold(spark, d):
    return jobs.fold(_log(spark, d))


@query(_SQL["profile_fold"])
def stream_profile_fold(spark, d):
    """The same fold as a stream."""
    raw = spark.readStream.schema(_t(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    e = raw.select("event_id", F.col("user_id").alias("pid"), "ts", F.col("event_type").alias("kind"), (F.col("event_id") % 40).alias("key"))
    return jobs.run_to_table(jobs.fold(e), files.scratch(spark, "fold"), files.scratch(spark, "fold-state"))


@query(f"""WITH {_ITEMS}, sv AS (SELECT DISTINCT event_id % 40 AS id FROM events WHERE event_type = 'purchase') SELECT i.id, sv.id IS NOT NULL AS saved FROM i LEFT JOIN sv ON sv.id = i.id WHERE brand = (SELECT max(brand) FROM i)""")
def saved_marks(spark, d):
    items = _items(spark, d)
    last = items.agg(F.max("brand").alias("_b"))
    page = items.crossJoin(F.broadcast(last)).where("brand = _b").select("id")
    return search.marked(page, _log(spark, d).where("kind = 'purchase'").select(F.col("key").alias("id")))


_WANT = "['XXS', 'XS', 'S', 'M', 'L', 'XL', 'XXL', 'ONE'][id % 8 + 1]"


@query(f"WITH {_CAT} SELECT id FROM ct WHERE CASE WHEN ct.category NOT IN ('dress', 'jumpsuit', 'set', 'trousers', 'jeans', 'skirt', 'shorts') THEN TRUE WHEN id % 11 = 0 THEN TRUE WHEN id % 5 = 0 THEN FALSE WHEN ct.category IN ('dress', 'jumpsuit', 'set') THEN {_WANT} IN ('M', 'ONE') ELSE {_WANT} IN ('L', 'ONE') END")
def size_facet(spark, d):
    items = _items(spark, d)
    letter = F.element_at(F.array(*[F.lit(x) for x in [*K.LETTERS, "ONE"]]), (F.col("id") % 8 + 1).cast("int"))
    none = F.array().cast("array<string>")
    c = recommend.categorise(items, _prompts(spark, d)).withColumn("sizes_offered", F.when(F.col("id") % 11 == 0, none).otherwise(F.array(letter)))
    c = c.withColumn("sizes_in_stock", F.when((F.col("id") % 11 == 0) | (F.col("id") % 5 == 0), none).otherwise(F.array(letter)))
    return c.where(search.size_ok({"dresses": "M", "bottoms": "L"}, True)).select("id")


_REPLY = """CASE conv_id % 4 WHEN 0 THEN text WHEN 1 THEN to_json(string_split(text, ' '))::VARCHAR WHEN 2 THEN 'Here: ' || to_json(string_split(text, ' '))::VARCHAR || ' done' ELSE '- "' || text || '"' || chr(10) || '* end' END"""


@query(rf"""WITH r AS (SELECT conv_id, turn, {_REPLY} AS reply FROM conversations), s AS (SELECT *, regexp_extract(reply, '(?s)\[.*\]') AS bracketed FROM r),
j AS (SELECT *, CASE WHEN json_valid(reply) THEN json_type(reply) = 'ARRAY' ELSE FALSE END AS whole, CASE WHEN json_valid(bracketed) THEN json_type(bracketed) = 'ARRAY' ELSE FALSE END AS part FROM s)
SELECT conv_id, turn, array_to_string(CASE WHEN whole THEN from_json(reply, '["VARCHAR"]') WHEN part THEN from_json(bracketed, '["VARCHAR"]')
  ELSE list_transform(list_filter(regexp_split_to_array(reply, '\r\n|[\n\r]'), lambda x: trim(x) <> ''), lambda x: trim(x, '-*• ' || chr(9) || '"' || chr(39))) END, '|') AS items FROM j""")
def json_reply_parse(spark, d):
    """Every turn as a reply: as it is, as a JSON list, as one within a sentence, and as bullet lines with quotes."""
    listed = F.to_json(F.split("text", " "))
    k = F.col("conv_id") % 4
    reply = F.when(k == 0, F.col("text")).when(k == 1, listed).when(k == 2, F.concat(F.lit("Here: "), listed, F.lit(" done"))).otherwise(F.concat(F.lit('- "'), F.col("text"), F.lit('"\n* end')))
    c = _t(spark, d, "conversations").withColumn("reply", reply)
    return c.select("conv_id", "turn", F.array_join(T.json_list("reply"), "|").alias("items"))


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
