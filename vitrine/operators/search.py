"""Hybrid search over a catalog of items.

Items: ``id, brand, title, product_type, price, currency, available, vec`` and, where used, ``tags, description,
category, margin, sizes_in_stock, sizes_offered``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import constants as K
from vitrine.functions import text as T
from vitrine.functions import vector as V
from vitrine.operators.inverted import SearchIndex, weighted_tokens


def postings(docs: DataFrame, key: str, fields: dict[str, float]) -> DataFrame:
    """Weighted term frequencies ``key, token, tf`` over the given text columns and their weights.

    Arrays of strings are joined by spaces. Counts combine on the map side before the one shuffle."""

    return docs.select(key, F.explode(weighted_tokens(docs, fields)).alias("t")).groupBy(key, "t.token").agg(F.sum("t.w").alias("tf"))


def bm25(post: DataFrame, key: str, query: list[str], n_docs: DataFrame) -> DataFrame:
    """``key, text_score`` of the documents that hold a query token; a token counts once however often it is asked.

    ``n_docs`` is one row with ``n``. Average length is over all documents, empty ones included."""
    asked = sorted(set(query))
    length = post.groupBy(key).agg(F.sum("tf").alias("dl"))
    hits = post.where(F.col("token").isin(asked)) if asked else post.limit(0)
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    whole = F.broadcast(length.agg(F.sum("dl").alias("all")).crossJoin(n_docs).select("n", (F.col("all") / F.col("n")).alias("avg")))
    # at most one row for each query token, so it is small whatever the corpus
    scored = hits.join(F.broadcast(df), "token").join(length, key).crossJoin(whole)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * F.col("dl") / F.col("avg"))
    return scored.groupBy(key).agg(F.sum(idf * F.col("tf") * (K.BM25_K1 + 1) / norm).alias("text_score"))


@dataclass(frozen=True)
class Query:
    """A search request; the text is parsed into tokens, pairs, colours and a category on the driver."""

    text: str
    category: str | None = None
    brands: tuple[str, ...] = ()
    exclude_brands: tuple[str, ...] = ()
    min_usd: float | None = None
    max_usd: float | None = None
    sizes: tuple[tuple[str, str], ...] = ()
    include_unknown_size: bool = True
    sort: str = "relevance"

    def parsed(self, spark) -> dict:
        one = spark.createDataFrame([(self.text,)], "q string")
        toks = T.tokens("q")
        row = one.select(toks.alias("tokens"), T.bigrams(toks).alias("bigrams"), T.colours("q").alias("colours"), T.keyword_category("q").alias("category")).first()
        return row.asDict()


def sellable() -> Column:
    """Available, not junk, and at least the least price."""
    return F.col("available") & ~T.is_junk("title") & (F.coalesce(T.usd("price", "currency"), F.lit(0.0)) >= K.MIN_USD)


def category_ok(category: str) -> Column:
    """Assigned to a compatible category or unsure of it, and not named otherwise; needs ``category, margin, p25``."""
    if category not in K.COMPATIBLE:
        raise ValueError(f"unknown category {category!r}; known: {', '.join(K.CATEGORIES)}")
    good = K.COMPATIBLE[category]
    named = F.coalesce(T.keyword_category("title"), T.keyword_category("product_type"))
    return (F.col("category").isin(good) | (F.col("margin") <= F.col("p25"))) & (named.isNull() | named.isin(good))


def size_ok(sizes: dict[str, str], include_unknown: bool) -> Column:
    """The wanted size of the item's garment group is in stock; groups without a wish pass. An item of which no sizes are
    known at all passes with ``include_unknown``; one that is sold out does not."""
    ok = F.lit(True)
    for group, cats in K.SIZE_GROUPS.items():
        if group in sizes:
            has = F.array_contains("sizes_in_stock", sizes[group]) | F.array_contains("sizes_in_stock", "ONE")
            none = F.coalesce(F.size("sizes_in_stock") <= 0, F.lit(True)) & F.coalesce(F.size("sizes_offered") <= 0, F.lit(True))
            ok = F.when(F.col("category").isin(cats), F.when(none, include_unknown).otherwise(F.coalesce(has, F.lit(False)))).otherwise(ok)
    return ok


def scored(items: DataFrame, query: Query, query_vec: DataFrame, taste: DataFrame | None = None, index: SearchIndex | None = None) -> DataFrame:
    """All sellable and relevant items with ``score, z, text_score, usd``. ``query_vec`` and ``taste`` are one row ``q``.

    With an ``index`` over the same items, text scores are read from its postings; without one all texts are tokenised. Means, deviations and the text maximum are over all items, before any filter."""
    p = query.parsed(items.sparkSession)
    sims = items.crossJoin(F.broadcast(query_vec.select(F.col("q").alias("_q")))).withColumn("sim", V.dot(F.col("vec"), F.col("_q"))).drop("_q")
    if taste is not None:
        sims = sims.crossJoin(F.broadcast(taste.select(F.col("q").alias("_t")))).withColumn("tsim", V.dot(F.col("vec"), F.col("_t"))).drop("_t")
    d = V.with_zscore(sims.drop("vec"), "sim", "z")
    fields = {f: w for f, w in K.FIELD_WEIGHTS.items() if f in items.columns}
    text = index.search(p["tokens"]) if index else bm25(postings(items, "id", fields), "id", p["tokens"], items.agg(F.count("*").alias("n")))
    d = d.join(text, "id", "left").withColumn("text_score", F.coalesce("text_score", F.lit(0.0)))
    top = text.agg(F.max("text_score").alias("_top"))
    d = d.crossJoin(F.broadcast(top))
    title = T.tokens("title")
    line, bonus = F.array_join(title, " "), F.lit(0.0)
    for b in p["bigrams"]:
        bonus = bonus + F.when(F.contains(line, F.lit(b)), K.PHRASE_BONUS).otherwise(0.0)
    for c in p["colours"]:
        bonus = bonus + F.when(F.array_contains(title, T.stem(F.lit(c))), K.COLOUR_BONUS).otherwise(0.0)
    score = F.col("z") + F.when(F.col("_top") > 0, K.TEXT_WEIGHT * F.col("text_score") / F.col("_top")).otherwise(0.0)
    score = score + F.when(F.col("text_score") > 0, bonus).otherwise(0.0)
    if taste is not None:
        d = V.with_zscore(d, "tsim", "tz")
        score = score + K.TASTE_WEIGHT * F.col("tz")
    d = d.withColumns({"score": score, "usd": F.coalesce(T.usd("price", "currency"), F.lit(0.0))})
    keep = sellable()
    if not query.brands:
        keep = keep & ((F.col("text_score") > 0) | (F.col("z") >= K.RELEVANT_Z))
    category = query.category or p["category"]
    if category and "margin" in items.columns:
        d = d.crossJoin(F.broadcast(items.agg(F.percentile("margin", F.lit(0.25)).alias("p25"))))
        keep = keep & category_ok(category)
    if query.min_usd is not None:
        keep = keep & (F.col("usd") >= query.min_usd)
    if query.max_usd is not None:
        keep = keep & (F.col("usd") <= query.max_usd) & (F.col("usd") > 0)
    if query.brands:
        keep = keep & F.col("brand").isin(*query.brands)
    if query.exclude_brands:
        keep = keep & ~F.col("brand").isin(*query.exclude_brands)
    if query.sizes:
        keep = keep & size_ok(dict(query.sizes), query.include_unknown_size)
    return d.where(keep)


def ordering(sort: str = "relevance") -> list[Column]:
    """Every order ends with the id."""
    first = {"relevance": [], "price_asc": [F.asc("usd")], "price_desc": [F.desc("usd")]}[sort]
    return [*first, F.desc("score"), F.asc("id")]


def first_page(found: DataFrame, sort: str = "relevance", page: int = K.PAGE) -> DataFrame:
    """The first page: one card per (brand, colourway), at most PER_BRAND of a brand before others.

    The windows are per brand; the page itself is a top-k, so nothing is sorted whole."""
    by = [F.desc(c) if d else F.asc(c) for c, d in (("usd", sort == "price_desc"), ("score", True), ("id", False))][0 if sort != "relevance" else 1 :]
    ways = found.withColumn("_way", T.colourway("title"))
    one = ways.withColumn("_n", F.row_number().over(Window.partitionBy("brand", "_way").orderBy(*by))).where("_n = 1")
    # of a brand no more than a page can show
    one = one.withColumn("_rank", F.row_number().over(Window.partitionBy("brand").orderBy(*by))).where(F.col("_rank") <= page)
    return one.orderBy((F.col("_rank") > K.PER_BRAND).asc(), *by).limit(page).drop("_way", "_n", "_rank")


def similar(items: DataFrame, item_id, limit: int = 12, same_brand: bool = False) -> DataFrame:
    """Nearest available items: the best one of each other brand, or the best of the same brand."""
    one = items.where(F.col("id") == item_id).select(F.col("vec").alias("_v"), F.col("brand").alias("_b")).limit(1)
    d = items.where(F.col("available") & (F.col("id") != item_id)).crossJoin(F.broadcast(one)).withColumn("sim", V.dot(F.col("vec"), F.col("_v")))
    if same_brand:
        d = d.where(F.col("brand") == F.col("_b"))
    else:
        best = Window.partitionBy("brand").orderBy(F.desc("sim"), "id")
        d = d.where(F.col("brand") != F.col("_b")).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    return d.orderBy(F.desc("sim"), "id").limit(limit).drop("_v", "_b")


# fixed texts of an explanation
WHY_TITLE, WHY_TAG, WHY_LOOK = "title matches ", "tagged as a match", "looks like what you asked for"


def explained(found: DataFrame, query_tokens: list[str]) -> DataFrame:
    """Add ``why``, a list with one reason (the query's words that the title holds, else that tags or description do, else that it
    looks alike), and ``price_usd``."""
    asked = F.array(*[F.lit(t) for t in query_tokens]).cast("array<string>")
    in_title = F.array_intersect(asked, T.tokens("title"))
    why = F.when(F.size(in_title) > 0, F.concat(F.lit(WHY_TITLE), F.array_join(in_title, ", "))).when(F.col("text_score") > 0, WHY_TAG).otherwise(WHY_LOOK)
    return found.withColumns({"why": F.array(why), "price_usd": F.nullif(F.bround("usd", 2), F.lit(0.0))})


def with_details(page: DataFrame, full: DataFrame) -> DataFrame:
    """Full rows of a page of ids: the page is at most a screenful, so it is what is broadcast."""
    return full.join(F.broadcast(page.select("id")), "id", "left_semi")


def marked(page: DataFrame, saved: DataFrame, key: str = "id") -> DataFrame:
    """Add ``saved``: whether the key is among those of ``saved``."""
    mine = saved.select(F.col(key).alias("_s")).distinct()
    return page.join(mine, page[key] == F.col("_s"), "left").withColumn("saved", F.col("_s").isNotNull()).drop("_s")
